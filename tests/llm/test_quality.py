import random
import re
from collections import Counter, defaultdict

from watchgrid.llm.quality import host_verdicts, judged, measured

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    hit = {i + k for i, g in enumerate(wins) if n[g] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_match_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\x0b ", "a b c d e a b c d e", "x " * 40, "é🙂  nbsp em", "l\n\nl\n l\nl", "\r\na\r\nb\r\n", "z" * 20000]
    texts += ["".join(rng.choice("ab #|\n\t") for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [" ".join(rng.choice(["p", "q", "r"]) for _ in range(2000))]
    rows = [(i % 140, t, rng.choice(["h1", "h2", None]), 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words int").repartition(3)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = judged(docs).select("row.doc_id", *columns, "base_failed").collect()
    want = [(i, *(b := brute(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t, *_ in rows]
    assert sorted(map(tuple, got)) == sorted(want)
    assert judged(docs.limit(0)).count() == 0


def test_host_verdicts(spark):
    clean = "plain words that say a thing or two about nothing in particular today {}"
    mild = "symbols # here * some of them and words that say a thing {}"  # over the mild bound, under the severe one
    junk = "a% b% c% d% e% f% g% h% i% j% k% l% {}"
    rows = []
    for h in range(20):
        rows += [(f"host{h}", clean)] * 30 + [(f"host{h}", mild)]
    rows += [("bad", mild)] * 40 + [("bad", clean)] * 5 + [("tiny", mild), (None, clean), ("host1", junk)]
    docs = spark.createDataFrame([(i, t.format(i), h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in judged(docs).select("row.doc_id", "kept").collect()}
    by = defaultdict(set)
    for i, (h, t) in enumerate(rows):
        by[h if h in ("bad", "tiny") else "other", t].add(kept[i])
    assert by["other", clean] == by["bad", clean] == by["other", mild] == by["tiny", mild] == {True}
    assert by["bad", mild] == by["other", junk] == {False}
    verdicts = {r.of_host: r for r in host_verdicts(measured(docs)).collect()}
    assert verdicts["bad"].condemned_symbols and not verdicts["tiny"].condemned_symbols
    assert 0 < verdicts["tiny"].rate_symbols < 1
