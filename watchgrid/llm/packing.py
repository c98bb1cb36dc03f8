"""Best-fit packing of token pieces into sequences, led by exact complements.

Documents become token ids and one end mark. Only a document longer than a sequence is cut: into whole sequences, the
first piece taking what is left over. What has to be packed is then described fully by how many pieces there are of each
length, at most ``capacity`` numbers, so the plan is made from that histogram on the driver, whatever the corpus holds:

* Exact complements. Sets of lengths index which single, pair and triple sums are to be had. From the longest length down,
  a combination that fills the gap exactly is used as often as the counts allow; each use leaves some length short. Plans
  that spare more or fewer short pieces are compared, and the one of fewest sequences is taken.
* Best fit. What no combination completes goes, longest first, into the open sequences with the smallest sufficient gap.

A plan entry says: pieces of this length with these ranks go into these sequences at this place. There are a few thousand
entries at most. Pieces are ranked within their length where they lie and look their places up.

Defined results: null and empty texts are one piece holding the end mark alone; repeated rows are packed one by one; an
empty table gives no sequence; columns other than those named travel only inside ``row``.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from watchgrid.llm.common import number_within, slices, texts_of, with_row
from watchgrid.llm.vocabulary import SPLIT, Remembered, plain_lines, special_ids
from watchgrid.session import cut_lineage

_RANK_BITS = 44
#: Sixteenths of a sequence under which pieces are kept from complements, in the plans that are compared.
SPARED = (0, 1, 2, 4, 6, 8)
#: Words that a worker remembers the ids of, at the start of a line and after a blank each.
REMEMBERED = 60_000


class Encoder:
    """Token ids as little-endian 32-bit bytes; ``ranks_path`` and ``path`` hold the same vocabulary."""

    def __init__(self, ranks_path: str, path: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        special = special_ids(path)
        self._encoding = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)
        ordinary = self._encoding.encode_ordinary
        self._words = Remembered(lambda word: array("I", ordinary(" " + word)).tobytes(), REMEMBERED)
        self._firsts = Remembered(lambda word: array("I", ordinary(word)).tobytes(), REMEMBERED)
        self._feed = array("I", ordinary("\n")).tobytes()

    def encode(self, text: str) -> bytes:
        lines = None if any(s in text for s in self._special) else plain_lines(text)
        if lines is None:
            return array("I", self._encoding.encode(text, allowed_special=self._special)).tobytes()
        words, firsts = self._words.__getitem__, self._firsts
        return self._feed.join([firsts[line[0]] + b"".join(map(words, line[1:])) for line in lines])


@lru_cache(maxsize=2)
def encoder(ranks_path: str, path: str) -> Encoder:
    return Encoder(ranks_path, path)


def piece_starts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole sequences behind a first piece that may be shorter."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((start, capacity) for start in range(head, length, capacity))]


def tokenise(
    docs: DataFrame, ranks_path: str, path: str, end_id: int, capacity: int, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Per piece: ``row`` (the carried columns), ``piece``, ``start``, ``length``, ``ids`` (little-endian 32-bit)."""
    narrow = with_row(docs, carry)
    schema = StructType(
        [
            narrow.schema["row"],
            StructField("piece", IntegerType()),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks_path, path).encode, array("I", [end_id]).tobytes()
        for batch in slices(batches):
            taken, pieces, starts, lengths, ids = [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                found = encode(text or "") + end
                for k, (start, length) in enumerate(piece_starts(len(found) // 4, capacity)):
                    taken.append(i)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(length)
                    ids.append(found[4 * start : 4 * (start + length)])
            rows = batch.column(0).take(pa.array(taken, pa.int64()))
            columns = [rows, pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return narrow.mapInArrow(run, schema)


class Complements:
    """Which lengths can still be had, indexed so that single, pair and triple sums are found by bit operations."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, [0] * (capacity + 1)
        self._present = self._mirrored = 0
        for length, n in counts.items():
            self._set(length, n)

    def _set(self, length: int, n: int) -> None:
        self.left[length] = n
        bit, mirror = 1 << length, 1 << (self.capacity - length)
        self._present = self._present | bit if n else self._present & ~bit
        self._mirrored = self._mirrored | mirror if n else self._mirrored & ~mirror

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be used."""
        return min(self.left[length] // need for length, need in Counter(lengths).items())

    def use(self, lengths: tuple[int, ...], times: int) -> None:
        for length, need in Counter(lengths).items():
            self._set(length, self.left[length] - need * times)

    def _pair(self, held: tuple[int, ...], total: int) -> tuple[int, int] | None:
        bits = self._present & (self._mirrored >> (self.capacity - total)) & ((1 << total) - 1) & ~1
        while bits:
            a = bits.bit_length() - 1
            if 2 * a < total:
                return None
            if self.times((*held, a, total - a)):
                return a, total - a
            bits &= ~(1 << a)
        return None

    def filling(self, length: int) -> tuple[int, ...] | None:
        """A combination with ``length`` that makes a whole sequence, of as few pieces as may be."""
        gap, held = self.capacity - length, (length,)
        if not gap:
            return held
        if self.left[gap] and self.times((length, gap)):
            return length, gap
        if pair := self._pair(held, gap):
            return (*held, *pair)
        bits = self._present & ((1 << gap) - 1) & ~1
        while bits:
            a = bits.bit_length() - 1
            if 3 * a < gap:
                return None
            if self.times((*held, a)) and (pair := self._pair((*held, a), gap - a)):
                return (*held, a, *pair)
            bits &= ~(1 << a)
        return None


def best_fit(left: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the smallest sufficient gap; equal sequences are kept as one pattern with a count."""
    gaps: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if not gap:
            full.append((pattern, times))
            return
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append((pattern, times))

    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                each = min(n, capacity // length)
                put((length,) * each, n // each)
                n %= each
                continue
            gap = gaps[i]
            pattern, times = groups[gap].pop()
            used = min(n, times)
            if times > used:
                groups[gap].append((pattern, times - used))
            if not groups[gap]:
                del groups[gap]
                gaps.pop(i)
            put((*pattern, length), used)
            n -= used
    return full + [group for gap in gaps for group in groups[gap]]


def led_by_complements(counts: dict[int, int], capacity: int, shortest: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements among pieces of at least ``shortest``, then best fit for all that is left."""
    index = Complements({length: n for length, n in counts.items() if length >= shortest}, capacity)
    patterns = []
    for length in range(capacity, 0, -1):
        while index.left[length] and (pattern := index.filling(length)):
            times = index.times(pattern)
            index.use(pattern, times)
            patterns.append((pattern, times))
    left = [n if length >= shortest else counts.get(length, 0) for length, n in enumerate(index.left)]
    return patterns + best_fit(left, capacity)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of piece lengths, each with the number of sequences that follow it.

    Short pieces are worth most at the end, in gaps that no combination fills. How many of them complements may use up is
    tried out, from all to none but the longest; the plan of fewest sequences is taken, the one led furthest of equal ones."""
    plans = (led_by_complements(counts, capacity, max(1, capacity * part // 16)) for part in SPARED)
    return min(plans, key=lambda found: sum(times for _, times in found))


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted first (length, rank) of each run of pieces, with its first sequence and the offset in each of them."""
    used: Counter[int] = Counter()
    entries, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            entries.append(((length << _RANK_BITS) | used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    entries.sort()
    table = np.array(entries, dtype=np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces with a column ``length`` from 1 to ``capacity``."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, sequence, offset = places(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << _RANK_BITS) | rank.to_numpy(np.int64)
        at = np.searchsorted(first, key, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + key - first[at], "offset": offset[at]})

    ranked = number_within(pieces, "length", "__rank").withColumn("__place", place("length", "__rank"))
    return ranked.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: one row of at most ``capacity`` ids each, from pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "").alias("x")).select(
        "sequence_id", F.unhex("x").alias("ids")
    )


def pack_documents(docs: DataFrame, ranks_path: str, path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    pieces = tokenise(docs, ranks_path, path, end_id, capacity)
    narrow = pieces.select("row.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut_lineage(narrow), capacity)
