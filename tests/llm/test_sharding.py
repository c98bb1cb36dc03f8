import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from watchgrid.llm import sharding
from watchgrid.llm.sharding import Outline, cut_positions, shard_documents, smallest_capacity


def feasible(sizes, capacity, shards):
    used, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > room:
            used, room = used + 1, capacity
        room -= s
    return used <= shards


@pytest.mark.parametrize("seed", range(6))
def test_capacity_matches_brute_force(seed, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_PREFIX", 1)
    monkeypatch.setattr(sharding, "NEXT_PREFIX", 1)
    rng = random.Random(seed)
    groups = {f"{rng.getrandbits(256):064x}": rng.choice([1, 5, 40, 900 if seed % 2 else 3]) for _ in range(300)}
    if seed == 5:
        groups = {k: 7 for k in list(groups)[:3]}

    def fetch(prefixes, length):
        found = defaultdict(list)
        for key, size in groups.items():
            if not prefixes or any(key.startswith(p) for p in prefixes):
                found[key[:length]].append(size)
        return [(p, len(v), sum(v), max(v)) for p, v in found.items()]

    outline = Outline(fetch)
    capacity = smallest_capacity(outline, 16)
    sizes = [groups[k] for k in sorted(groups)]
    assert feasible(sizes, capacity, 16) and not feasible(sizes, capacity - 1, 16)
    cuts = [0, *cut_positions(outline, 16, capacity), sum(sizes)]
    borders = {0}
    for s in sizes:
        borders.add(max(borders) + s)
    assert set(cuts) <= borders and max(b - a for a, b in zip(cuts, cuts[1:])) <= capacity


def test_rows_groups_and_slots(spark):
    rows = [(i, ["same", None, "", f"text {i} " + "é" * (i % 50)][min(i % 7, 3)]) for i in range(500)] + [(3, "twice"), (3, "twice"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(5)
    got = shard_documents(docs).collect()
    assert len(got) == len(rows)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r)
        by_text[r.text_key].add(r.shard)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in by_text.values()) and set(by_shard) <= set(range(16))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    assert shard_documents(docs.limit(0)).count() == 0
