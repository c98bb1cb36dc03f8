import random

import corpus_pipeline
from watchgrid.llm.near_duplicates import near_duplicates


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, 6, 8, 40, 120]))]
        for _ in range(12):
            text = " ".join(edited(rng, words, rng.choice([0, 1, 2, 3])))
            rows.append(text.upper() if rng.random() < 0.2 else text.replace(" ", "\n", 2))
        chain = words * 3
        for _ in range(8):  # a chain: neighbours are alike, its ends are not
            chain = edited(rng, chain, 2)
            rows.append(" ".join(chain))
    shared = [f"s{i}" for i in range(60)]
    rows += [" ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(40)]  # a common passage
    rows += ["", " \n\t", "a b", "A  b", "İstanbul x", "istanbul x"]
    rng.shuffle(rows)
    table = list(enumerate(rows))
    docs = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, bands string").repartition(4)
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == brute(table)


def test_a_large_group_of_edited_copies_stays_linear(spark, monkeypatch):
    from watchgrid.llm import near_duplicates as nd

    rng = random.Random(31)
    base = [f"v{rng.randrange(9000)}" for _ in range(260)]
    # The smallest number is far from most; edits of up to a tenth of the words break up to a third of the shingles.
    rows = [" ".join(edited(rng, base, 16))] + [" ".join(edited(rng, base, rng.randrange(0, 14))) for _ in range(420)]
    table = list(enumerate(rows))
    seen, joined = [], nd.prefix_pairs

    def counted(live, sets, percent):
        pairs = joined(live, sets, percent)
        seen.append((live.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(nd, "prefix_pairs", counted)
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in near_duplicates(docs).collect()) == brute(table)
    assert seen[0][1] <= 12 * len(rows)  # all pairs: 210 times the rows


def test_a_very_long_text_is_whole(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "other"])), (3, " ".join(long[:100_000]))]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nulls_repeats_and_empty(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (2, "ONE two three four five six"), (None, "one two three four five six"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2, 2, False), (5, 2, 2, False), (2, 2, 2, True), (None, 2, None, True), (7, 0, 7, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_several_texts(spark):
    words = [f"v{i}" for i in range(60)]
    near, other = [*words[:-1], "end"], [f"o{i}" for i in range(60)]
    texts = [(5, words), (5, near), (5, other), (9, [*other[:-1], "end"]), (3, ["z1", "z2"]), (7, [w.upper() for w in words])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = [tuple(r) for r in near_duplicates(docs).select("doc_id", "component_id", "kept").collect()]
    # words, its near copy and id 7 are one component, other and id 9 another; each keeps one text of id 5.
    assert sorted(got) == [(3, 3, True), (5, 5, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]
    left = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(left) == 3 and {(3, "z1 z2"), (5, " ".join(other))} < set(left)
    assert sum(t in (" ".join(words), " ".join(near)) for _, t in left) == 1
