import math
import random
from collections import Counter

import pytest

from watchgrid.llm.lm_scoring import lm_scores


def brute(texts, order, alpha=0.4):
    docs = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    every = [sum((grams(w, n) for w in docs), Counter()) for n in range(1, order + 1)]
    words, out = sum(map(len, docs)), []
    for w in docs:
        own = [grams(w, n) for n in range(1, order + 1)]
        left = lambda g: every[len(g) - 1][g] - own[len(g) - 1][g]
        total = 0.0
        for i in range(len(w)):
            n, penalty = min(order, i + 1), 0.0
            while n > 1 and not left(tuple(w[i - n + 1 : i + 1])):
                n, penalty = n - 1, penalty + math.log(alpha)
            g = tuple(w[i - n + 1 : i + 1])
            total += penalty + (math.log(left(g) / left(g[:-1])) if n > 1 else math.log(max(left(g), 0.5) / max(1, words - len(w))))
        out.append((len(w), round(total, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    rng = random.Random(order)
    texts = [" ".join(rng.choice(["the", "The", "of", "é", "b,", "c."]) for _ in range(rng.randrange(30))) for _ in range(80)]
    texts += ["the of the of"] * 5 + ["", None, " \n", "solitary", "never seen words here"]
    rows = [(i, t, 0.0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_score double").repartition(4)
    for block, entries in ((8_000_000, 4_000_000), (150, 90)):
        got = lm_scores(docs, order=order, block_bytes=block, range_entries=entries).collect()
        assert sorted((r.row.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == [(i, *b) for i, b in enumerate(brute(texts, order))]
    same = spark.createDataFrame([(1, "a b")] * 6, "doc_id long, text string").repartition(3)
    assert [r.n_words for r in lm_scores(same).collect()] == [2] * 6
    assert lm_scores(docs.limit(0)).count() == 0
