"""Stupid-backoff scores of every document under the counts of all other documents.

N-grams of every order are counted over the whole corpus in tables partitioned by hash range, the counts are joined back to
each document's n-grams, and the logarithms are summed per document. A document's own occurrences are taken off first, so a
score says how well the rest of the corpus foretells the text: log(c(context, word) / c(context)) where the n-gram occurs
elsewhere, otherwise the next lower order's score plus log(``alpha``); a single word is worth c(word) / N, and half an
occurrence if no other document has it.

What is shuffled is packed. Documents are handled in blocks of a few megabytes; a block counts its n-grams once, sorted by
hash, and sends one slice to each hash range. Each range adds up its slices and answers every block with the totals in the
order in which the block sent its hashes, so answers need no keys. The block's texts, compressed, wait beside the answers.
A frequent n-gram so is one entry per block, never a hot key. Ranges are as many as keep about ``range_entries`` in each.

Defined results: null, empty and blank texts have no words and a score of 0 (mean null); repeated rows are documents of their
own; a corpus of one document scores every word as unseen; columns other than those named travel only inside ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Bigrams: trigrams would double what is shuffled.
ORDER = 2
ALPHA = 0.4
BLOCK_BYTES = 8_000_000
RANGE_ENTRIES = 4_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_hashes(text: str, order: int) -> list[np.ndarray]:
    """For each order from 1, the hash of the n-gram that ends at each word from the n-th on."""
    words = text.encode("utf-8").translate(_LOWER).split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    out, rolled = [], each
    for n in range(1, order + 1):
        if n > 1:
            rolled = rolled[:-1] * _STEP + each[n - 1 :]
        out.append(_mixed(rolled + np.uint64(n)))
        if not len(rolled):
            rolled = each[:0]
    return out


def _packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, in which small numbers compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def range_width(ranges: int) -> int:
    return (1 << 64) // ranges + 1


def block_entries(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the block's n-grams, and how often each occurs in it."""
    found = [h for text in texts for h in ngram_hashes(text, order)]
    joined = np.concatenate(found) if found else np.empty(0, np.uint64)
    return np.unique(joined, return_counts=True)


def text_scores(text: str, order: int, alpha: float, hashes: np.ndarray, totals: np.ndarray, words: int) -> tuple[int, float]:
    """Words of the text and the sum of their log scores, given total counts of (at least) its n-grams."""
    grams = ngram_hashes(text, order)
    size = len(grams[0])
    if not size:
        return 0, 0.0
    left = []
    for found in grams:
        distinct, place, own = np.unique(found, return_inverse=True, return_counts=True)
        others = totals[np.searchsorted(hashes, distinct)].astype(np.int64) - own
        left.append(others[place])
    rest = max(1, words - size)
    score = np.log(np.maximum(left[0], 0.5) / rest)
    for n in range(2, order + 1):
        if size < n:
            break
        count, context = left[n - 1], left[n - 2][: size - n + 1]
        seen = count > 0
        known = np.log(np.where(seen, count, 1) / np.maximum(context, 1))
        score[n - 1 :] = np.where(seen, known, math.log(alpha) + score[n - 1 :])
    return size, float(score.sum())


def count_words(docs: DataFrame) -> int:
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    return docs.agg(F.sum(words.cast("long"))).first()[0] or 0


def lm_scores(
    docs: DataFrame,
    carry: tuple[str, ...] = ("doc_id",),
    order: int = ORDER,
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
    range_entries: int = RANGE_ENTRIES,
) -> DataFrame:
    """Per row of ``docs``: ``row`` (the carried columns), ``n_words``, ``log_score``, ``mean_log_score``."""
    words = count_words(docs)
    ranges = max(1, -(-words * order // range_entries))
    width = range_width(ranges)
    narrow = docs.select(F.struct(*carry).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    slices_schema = "block string, part int, hashes binary, counts binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents again, cut into batches of about ``block_bytes``."""
        for batch in batches:
            sizes = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
            start = 0
            while start < batch.num_rows:
                base = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, base + block_bytes, side="right")))
                yield batch.slice(start, end - start)
                start = end

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([part * width for part in range(1, ranges)], dtype=np.uint64)
        for batch in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            kept = sink.getvalue().to_pybytes()
            name = xxhash.xxh128_hexdigest(kept)  # the same if the task has to be run again
            hashes, counts = block_entries(batch.column(1).to_pylist(), order)
            cuts = np.searchsorted(hashes, borders)
            starts, ends = np.r_[0, cuts].astype(np.int64), np.r_[cuts, len(hashes)].astype(np.int64)
            rows = [(name, -1, kept, b"")]
            for part, (a, b) in enumerate(zip(starts, ends)):
                if b > a:
                    steps = np.diff(hashes[a:b], prepend=np.uint64(part * width))
                    rows.append((name, part, _packed(steps), _packed(counts[a:b])))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "hashes", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        """One hash range: totals over all blocks, given back to each in its order; texts pass."""
        part = table.column("part")[0].as_py()
        names, sent, counted = (table.column(c).to_pylist() for c in ("block", "hashes", "counts"))
        if part < 0:
            return table.select(["block", "part", "hashes"]).rename_columns(["block", "part", "data"])
        hashes = [np.cumsum(_unpacked(d), dtype=np.uint64) + np.uint64(part * width) for d in sent]
        counts = np.concatenate([_unpacked(d) for d in counted])
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.uint64)
        given, ends = totals[place], np.cumsum([len(h) for h in hashes])
        data = [_packed(given[e - len(h) : e]) for h, e in zip(hashes, ends)]
        return pa.table({"block": pa.array(names, pa.string()), "part": pa.array([part] * len(names), pa.int32()), "data": pa.array(data, pa.binary())})

    schema = StructType([narrow.schema["row"], StructField("n_words", LongType()), StructField("log_score", DoubleType())])

    def score(table: pa.Table) -> pa.Table:
        """One block: its texts and the totals of its n-grams."""
        got = sorted(zip(table.column("part").to_pylist(), table.column("data").to_pylist()))
        copies = [d for p, d in got if p < 0]  # equal blocks have one name; each answers for itself
        answers = {p: d for p, d in got if p >= 0}
        batch = pa.ipc.open_stream(copies[0]).read_next_batch()
        texts = batch.column(1).to_pylist()
        hashes, _ = block_entries(texts, order)
        totals = np.concatenate([_unpacked(answers[p]) for p in sorted(answers)]) if answers else np.empty(0, np.uint64)
        if len(totals) != len(hashes):
            raise RuntimeError(f"{len(totals)} totals for {len(hashes)} n-grams")
        found = [text_scores(t, order, alpha, hashes, totals, words) for t in texts]
        one = pa.table({"row": batch.column(0), "n_words": pa.array([f[0] for f in found], pa.int64()), "log_score": pa.array([f[1] for f in found], pa.float64())})
        return pa.concat_tables([one] * len(copies))

    sent = narrow.mapInArrow(send, slices_schema)
    # Slices meet by range. Texts pass through the same shuffle, by block, so that the documents are read only once.
    dealt = sent.groupBy("part", F.when(F.col("part") < 0, F.col("block")).alias("of"))
    answers = dealt.applyInArrow(add_up, "block string, part int, data binary")
    scored = answers.groupBy("block").applyInArrow(score, schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("mean_log_score", mean)
