import math
import random

import numpy as np
import pytest

from watchgrid.llm import hard_negatives as hn


def brute(rows, every=100, positives=5, negatives=10):
    """rows: (vec_id, label, vector). One anchor per distinct row whose id is divisible by ``every``."""
    usable = [
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, q in sorted({u for u in usable if u[0] % every == 0}):
        met = [(sum(a * b for a, b in zip(q, r)), j, other) for j, other, r in usable if j != i and len(r) == len(q)]
        first = sorted(((s, j) for s, j, other in met if other == label), key=lambda t: (-t[0], t[1]))[:positives]
        for k, (s, j) in enumerate(first, 1):
            inside = [(t, n) for t, n, other in met if other != label and 30 * s <= 100 * t <= 90 * s]
            for rank, (t, n) in enumerate(sorted(inside, key=lambda t: (-t[0], t[1]))[:negatives], 1):
                out.append((i, j, k, rank, n, s, t))
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, score double, g string"


def make(seed, n=900, dims=19):
    rng = random.Random(seed)
    vector = lambda: [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dims)]
    common = vector()
    rows = [(i, rng.randrange(4), common if i % 3 == 0 else vector()) for i in range(n)]  # a third are one vector: ties
    rows += [(5000 + i, i % 4, [0.0] * dims) for i in range(20)]
    rows += [(7000, 1, None), (7001, None, vector()), (None, 1, vector()), (7002, 1, [math.nan] * dims), (7100, 1, [math.inf] * dims)]
    rows += [(7003, 1, [None] * dims), (8000, 1, [0.5] * 3), (8001, 1, [0.25] * 3), (8002, 2, [0.2] * 3), (8100, 0, []), (8101, 0, []), (8102, 1, [])]
    return rows + rows[100:102] + [(200, 3, vector())]  # repeated rows, and one id with two vectors


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, 0.5, "x") for i, label, v in rows], SCHEMA).repartition(parts)


def rows_of(df):
    names = ("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("size,anchors", [(2048, 512), (37, 2)])
def test_equal_to_brute_force_at_any_block_size(spark, monkeypatch, size, anchors):
    monkeypatch.setattr(hn, "BLOCK_ROWS", size)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", anchors)
    rows = make(size)
    got = rows_of(hn.hard_negatives(table(spark, rows)))
    assert got == brute(rows) and len(got) > 50


def test_empty_tables_and_lonely_anchors(spark):
    assert hn.hard_negatives(table(spark, [])).count() == 0
    assert hn.hard_negatives(table(spark, [(0, 1, [0.5]), (1, 2, [0.5])], 1)).count() == 0
    assert hn.hard_negatives(table(spark, [(1, 1, [0.5]), (2, 2, [0.5])], 1)).count() == 0


def test_bounds_prune_but_never_lose(monkeypatch):
    rng = np.random.default_rng(4)
    cells = rng.integers(-60, 60, (40, 500))
    cells[:, :30] *= 6
    block = hn.Block(40, np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), cells.astype(np.int32).tobytes()).typed(np.int64)
    q = (cells[:, 3] * 0.9).astype(np.int64)
    want = q @ cells
    left = []

    def keep(lower, upper):
        assert ((lower <= want[alive_at[-1]]) & (want[alive_at[-1]] <= upper)).all()
        stays = hn.best_rule(5)(lower, upper)
        alive_at.append(alive_at[-1][stays])
        left.append(int(stays.sum()))
        return stays

    alive_at = [np.arange(500)]
    there, scores = hn.vertical_scan(block, q, np.arange(500), keep)
    assert (scores == want[there]).all() and len(there) < 500 and left[-2] < 500
    assert set(np.argsort(-want, kind="stable")[:5]) <= set(there)


def test_windows_are_exact_at_their_edges():
    for p in range(-25, 40):
        low, high = hn.window_of(p, 30, 90)
        assert [s for s in range(-60, 60) if 30 * p <= 100 * s <= 90 * p] == [s for s in range(-60, 60) if low <= s <= high]
