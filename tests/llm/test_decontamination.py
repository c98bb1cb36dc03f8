import hashlib
import random
import re

from watchgrid.llm.decontamination import contamination, summarised

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            n = min(10, len(b))
            for j in range(len(b) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_matches_brute_force_in_one_block_and_in_many(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of", "Été", "b2", "zeta", "kilo", "rho", "x"]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(1, 16))) for i in range(30)] + [(3, "the"), (40, None), (41, "!!"), (42, "zeta zeta zeta")]
    items += [(50, text(40)), (51, "of " * 12)]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)] + [(1, None), (2, ""), (None, "THE, Zeta"), (7, "of " * 40)]
    docs += [(100 + i, text(5) + " " + items[-2][1] + " " + text(3)) for i in range(3)] * 2
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, spans int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (500_000, 7):
        got = summarised(contamination(d, b, max_windows=most)).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)
    none = summarised(contamination(d, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert contamination(d.limit(0), b).count() == 0
