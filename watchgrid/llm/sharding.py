"""Sharding by a minimax contiguous partition.

Rows of equal text form one atomic group. Groups stand in the order of their text's digest, and each shard takes a
contiguous run of them. The smallest feasible capacity of a shard is found by binary search, each candidate checked
greedily; the cuts then go as near to equal shares as that capacity allows.

The driver never sees the groups. It holds totals of digest prefixes (65,536 at first); a check keeps lower and upper
bounds of every cut, and only prefixes that leave an answer open are opened further, by one small aggregate each time.

Defined results: a null text counts as empty; equal rows stay together; an empty table gives an empty result; fewer
groups than shards leave shards empty; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from watchgrid.llm.common import number_within
from watchgrid.session import cut_lineage

FIRST_PREFIX = 4
NEXT_PREFIX = 3


class Outline:
    """Group sizes in digest order, known by prefix and opened further on demand."""

    def __init__(self, fetch: Callable[[list[str], int], list[tuple[str, int, int, int]]]):
        """``fetch(prefixes, length)``: (prefix of that length, groups, bytes, largest group) below the given prefixes."""
        self._fetch = fetch
        self._parts = {row[0]: row for row in fetch([], FIRST_PREFIX)}
        self._index()

    def _index(self) -> None:
        self.prefixes = sorted(self._parts)
        rows = [self._parts[p] for p in self.prefixes]
        self.count = np.array([r[1] for r in rows], dtype=np.int64)
        self.largest = np.array([r[3] for r in rows], dtype=np.int64)
        self.ends = np.cumsum(np.array([r[2] for r in rows], dtype=np.int64))
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if len(rows) else self.ends
        self.total = int(self.ends[-1]) if len(rows) else 0

    def at(self, position: int) -> int:
        """The part inside which the position lies (their number, if it is the end)."""
        return int(np.searchsorted(self.ends, position, side="right"))

    def open(self, parts: set[int]) -> None:
        """Replace parts of several groups by what lies one step below their prefixes."""
        by_length: dict[int, list[str]] = {}
        for i in parts:
            by_length.setdefault(len(self.prefixes[i]), []).append(self.prefixes[i])
        for length, prefixes in by_length.items():
            below = self._fetch(prefixes, min(64, length + NEXT_PREFIX))
            for prefix in prefixes:
                del self._parts[prefix]
            self._parts.update({row[0]: row for row in below})
        self._index()

    def floor(self, position: int) -> tuple[int, int]:
        """Bounds of the last group border at or before the position."""
        i = self.at(position)
        if i >= len(self.ends):
            return self.total, self.total
        start = int(self.starts[i])
        if self.count[i] == 1 or start == position:
            return start, start
        return max(start, position - int(self.largest[i]) + 1), position

    def border(self, position: int, after: bool = False) -> int:
        """The last group border at or before the position, or the first at or after it."""
        position = max(0, min(position, self.total))
        while True:
            i = self.at(position)
            if i >= len(self.ends):
                return self.total
            if self.count[i] == 1 or int(self.starts[i]) == position:
                start = int(self.starts[i])
                return int(self.ends[i]) if after and start < position else start
            self.open({i})

    def check(self, capacity: int, shards: int) -> bool | set[int]:
        """Whether greedy filling at this capacity needs no more than the shards; else the parts that must be opened."""
        low = high = 0
        unsure: set[int] = set()
        for _ in range(shards):
            targets = (low + capacity, high + capacity)
            for i in range(self.at(targets[0]), min(self.at(targets[1]), len(self.ends) - 1) + 1):
                if self.count[i] > 1:
                    unsure.add(i)
            low, high = self.floor(targets[0])[0], self.floor(targets[1])[1]
        if low >= self.total:
            return True
        return False if high < self.total else unsure


def smallest_capacity(outline: Outline, shards: int) -> int:
    largest = int(outline.largest.max()) if len(outline.largest) else 0
    low = max(-(-outline.total // shards), largest)
    high = -(-outline.total // shards) + largest
    while low < high:
        middle = (low + high) // 2
        while not isinstance(answer := outline.check(middle, shards), bool):
            outline.open(answer)
        low, high = (low, middle) if answer else (middle + 1, high)
    return low


def cut_positions(outline: Outline, shards: int, capacity: int) -> list[int]:
    """Borders between shards: none over the capacity, each as near its equal share as that leaves open."""
    total = outline.total
    earliest = [total] * (shards + 1)
    for j in range(shards - 1, 0, -1):
        earliest[j] = outline.border(earliest[j + 1] - capacity, after=True)
    cuts, last = [], 0
    for j in range(1, shards):
        ideal = total * j // shards
        before, behind = outline.border(ideal), outline.border(ideal, after=True)
        nearest = before if ideal - before <= behind - ideal else behind
        last = max(earliest[j], min(nearest, outline.border(last + capacity)), last)
        cuts.append(last)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``text_key``, ``shard``, ``slot``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("text_key"),
        )
    )
    groups = cut_lineage(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")))

    def fetch(prefixes: list[str], length: int) -> list[tuple[str, int, int, int]]:
        part = groups
        if prefixes:
            part = part.where(F.substring("text_key", 1, len(prefixes[0])).isin(prefixes))
        found = part.groupBy(F.substring("text_key", 1, length).alias("prefix")).agg(
            F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")
        )
        return [(r.prefix, r.n, r.bytes, r.largest) for r in found.collect()]

    outline = Outline(fetch)
    cuts = cut_positions(outline, shards, smallest_capacity(outline, shards))
    at = [outline.at(c) for c in cuts]
    keys = [outline.prefixes[i] for i in at if i < len(outline.prefixes)]
    shard = F.lit(0)
    for key in keys:
        shard = shard + (F.col("text_key") >= F.lit(key)).cast("int")
    return number_within(rows.withColumn("shard", shard.cast("int")), "shard", "slot")
