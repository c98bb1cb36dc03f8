"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A benchmark item is cut into windows of ten consecutive words (a shorter item is one window). A document holds a window
only if it holds every word of it, so one word is a sufficient join prefix; the words are ordered by how many documents
use them, counted over all documents, and the rarest one is each window's prefix. Documents are joined to windows on that
word. A candidate passes the length bound (the document is as long as the window), the positional bound (the window, laid
so that the prefix words meet, lies inside the document) and an exact comparison of the words.

Windows reach the documents in blocks of at most ``max_windows``; a larger benchmark is joined block by block, each block
to all documents, so a block's size is bounded however many items there are. Documents are never shuffled.

Defined results: a null or empty text has no words, no hits and is not contaminated; items without words hold no window;
repeated items count once by id, a null id as the string "null"; repeated documents are judged one by one; an empty
benchmark hits nothing; columns other than those named travel only inside ``row``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from watchgrid.session import cut_lineage

WINDOW = 10
MAX_WINDOWS = 500_000

#: Digits, letters a to z and every byte over 127 make words; capitals become small, all else separates.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

FOUND = [
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(LongType())),
    StructField("items", ArrayType(StringType())),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TO_WORDS).split()


def item_windows(item_id, text: str | None, width: int) -> list[tuple[tuple[bytes, ...], str]]:
    words = words_of(text)
    name = "null" if item_id is None else str(item_id)
    if not words:
        return []
    return [(tuple(words[i : i + width]), name) for i in range(max(1, len(words) - width + 1))]


def window_blocks(items: Iterable, width: int, most: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    block: dict[tuple[bytes, ...], set[str]] = {}
    for item in items:
        for window, name in item_windows(item[0], item[1], width):
            block.setdefault(window, set()).add(name)
        if len(block) >= most:
            yield block
            block = {}
    if block:
        yield block


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of the vocabulary stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}  # no more rows than the vocabulary of one block


def prefix_index(block: dict[tuple[bytes, ...], set[str]], frequency: dict[bytes, int]) -> dict[bytes, dict[tuple[int, int], dict]]:
    """Rarest word -> (its place in the window, words of the window) -> windows with their items."""
    index: dict[bytes, dict[tuple[int, int], dict]] = {}
    for window, names in block.items():
        place = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
        index.setdefault(window[place], {}).setdefault((place, len(window)), {})[window] = sorted(names)
    return index


def find(words: list[bytes], index: dict, spans: list[int], items: set[str]) -> None:
    """Add the spans (first word, end) and items of the windows that occur among the words."""
    count = len(words)
    for at, word in enumerate(words):
        for (place, length), windows in index.get(word, {}).items():
            start = at - place
            if start >= 0 and start + length <= count and (names := windows.get(tuple(words[start : start + length]))):
                spans += (start, start + length)
                items.update(names)


def merged_spans(spans: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def _search(index: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans_out, items_out = [], [], []
            earlier = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            for text, (spans, items) in zip(batch.column(1).to_pylist(), earlier):
                words, found = words_of(text), set(items)
                if not index.keys().isdisjoint(words):
                    find(words, index, spans, found)
                sizes.append(len(words))
                spans_out.append(merged_spans(spans))
                items_out.append(sorted(found))
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans_out, pa.list_(pa.int64())), pa.array(items_out, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "n_words", "spans", "items"])

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    width: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the carried columns), ``n_words``, ``spans`` (start, end, start, ... in words), ``items``."""
    found = docs.select(
        F.struct(*carry).alias("row"),
        "text",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<bigint>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = StructType([found.schema["row"], StructField("text", StringType()), *FOUND])
    items = benchmark.select("item_id", "text").toLocalIterator()
    blocks = 0
    for block in window_blocks(items, width, max_windows):
        vocabulary = {word for window in block for word in window}
        index = prefix_index(block, document_frequency(docs, vocabulary))
        if blocks:
            found = cut_lineage(found)
        found = found.mapInArrow(_search(index), schema)
        blocks += 1
    if not blocks:
        found = found.mapInArrow(_search({}), schema)
    return found.drop("text")


def summarised(found: DataFrame) -> DataFrame:
    """``row`` and the figures of a report: words, hit words, items, a digest of the items, and the verdict."""
    hit = "aggregate(sequence(0, size(spans) div 2), 0L, (n, i) -> n + coalesce(get(spans, 2 * i + 1) - get(spans, 2 * i), 0L))"
    return found.select(
        "row",
        "n_words",
        F.expr(hit).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

