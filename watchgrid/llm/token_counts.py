"""Token counts by byte-pair merging with a heap over a linked list.

The count of a piece is its number of bytes less the merges that apply: the adjacent pair of lowest rank is popped from a
heap, its two neighbours are linked, and the new pairs are pushed. No identifier is ever looked up. Pieces repeat, so each
worker remembers the counts of the words seen lately (two bounded generations); what was forgotten is counted again.

Defined results: null and empty texts have 0 tokens; special strings count as one token each, as the library does by
default; repeated rows are counted one by one; columns other than the ones named are carried only inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from watchgrid.llm.vocabulary import SPLIT, Remembered, byte_letters, merge_ranks, plain_lines, special_split


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when every mergeable pair has been merged, lowest rank first, leftmost among equals."""
    count = len(symbols)
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    heap = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapify(heap)
    end, left = count, count
    while heap:
        _, i, (first, second) = heappop(heap)
        j = after[i]
        if symbols[i] != first or j == end or symbols[j] != second:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = first + second, ""
        left -= 1
        k = after[i] = after[j]
        after[j] = end
        if k != end:
            before[k] = i
            pair = (symbols[i], symbols[k])
            if (rank := ranks.get(pair)) is not None:
                heappush(heap, (rank, i, pair))
        h = before[i]
        if h >= 0:
            pair = (symbols[h], symbols[i])
            if (rank := ranks.get(pair)) is not None:
                heappush(heap, (rank, h, pair))
    return left


class Counter:
    def __init__(self, path: str):
        ranks, letters, pieces_of = merge_ranks(path), byte_letters(), regex.compile(SPLIT).findall
        pieces = Remembered(lambda piece: merged_length([letters[b] for b in piece.encode("utf-8")], ranks))
        self._pieces, self._pieces_of, self._special = pieces, pieces_of, special_split(path)
        self._words = Remembered(lambda word: sum(map(pieces.__getitem__, pieces_of(" " + word))))

    def count(self, text: str) -> int:
        parts = self._special.split(text) if self._special and self._special.search(text) else [text]
        return sum(map(self._plain, parts[::2])) + len(parts) // 2

    def _plain(self, text: str) -> int:
        lines = plain_lines(text)
        pieces = self._pieces.__getitem__
        if lines is None:
            return sum(map(pieces, self._pieces_of(text)))
        total = (len(lines) - 1) * pieces("\n")
        for words in lines:
            total += sum(map(self._words.__getitem__, words)) if len(words) > 1 else 0
            first = words[0]
            total += sum(map(pieces, self._pieces_of(first))) - (self._words[first] if len(words) > 1 else 0)
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: ``row`` (the carried columns), ``n_bytes``, ``n_tokens``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.struct(*carry).alias("row"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = StructType([narrow.schema["row"], narrow.schema["n_bytes"], StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            found = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["row", "n_bytes", "n_tokens"])

    return narrow.mapInArrow(run, schema)
