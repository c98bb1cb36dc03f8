"""A quality classifier on random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing: every word has a fixed sparse index vector of two signed ones, drawn from its hash. Its context vector
is the sum of the index vectors of the words within two places of it, over every occurrence in the whole corpus. Words
(letters, digits and all that is not ASCII, or a run of signs, case kept) fall into a fixed number of hash buckets, so the
table of sums has the same size for any corpus. Words are found and hashed in the bytes of many texts at once. Each task
sums into a table of its own; the tables are added block by block, and integer sums make the result independent of the
order.

A document is pooled into the mean of its word vectors and how much neighbours resemble each other; a network of one hidden layer, in numpy, is trained on a bounded sample of labelled documents (``most_labelled``), and a
temperature fitted on a fold of its own turns its margins into probabilities. Scoring reads every document once and
shuffles nothing.

Defined results: null and empty texts are pooled to zeros and scored so; unlabelled, null and clashing labels (the
highest counts) are no error; without both labels every score is the share of label 1, 0 if there is none; a null id is
never held out; repeated rows are scored one by one, but a labelled id is learned from once; a very long text is pooled
whole, a stretch at a time; an empty table gives no row; other columns travel only inside ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5
HELD_OUT = 0
CALIBRATION = 1
MOST_LABELLED = 20_000
THRESHOLD = 0.3
BUCKETS = 1 << 15
DIMS = 32
#: Signed ones of an index vector, and how far the context reaches.
ONES = 2
REACH = 2
#: Buckets that are added up as one row, and words that are worked on at a time.
BLOCK = 256
STRETCH = 1 << 18
FEATURES = DIMS + REACH + 1
#: Bytes that are searched for words at a time, if there is white space to cut at.
PIECE = 1 << 20
_FACTOR, _MIX = 0x100000001B3, 0x9E3779B97F4A7C15
_KIND = np.array([0 if b in b"\t\n\v\f\r " else 1 if b > 127 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse, modulo 2**64."""
    inverse = pow(_FACTOR, -1, 1 << 64)
    return tuple(np.r_[np.uint64(1), np.full(size, f, np.uint64)].cumprod(dtype=np.uint64) for f in (_FACTOR, inverse))


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and first byte of every word: maximal runs of one kind of byte, white space apart. A word's hash is a
    polynomial in its bytes, taken from running sums over all of them."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    powers, inverse = _powers(1 << max(PIECE.bit_length(), len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    mixed = (sums[ends] - sums[starts]) * inverse[starts] * np.uint64(_MIX)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), starts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per bucket the places of its signed ones, and the signs."""
    rng = np.random.default_rng(20)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :ONES]
    return places.astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, ONES))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words of the texts, and which text each belongs to."""
    data = b" ".join(texts)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    words, places, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            following = [c for c in (data.find(b" ", end), data.find(b"\n", end)) if c >= 0]
            end = cut if cut > at else min(following, default=len(data))
        found, starts = words_of(data[at:end])
        words.append(found)
        places.append(starts + at)
        at = end
    return np.concatenate(words), np.searchsorted(begins, np.concatenate(places), side="right") - 1


def add_contexts(table: np.ndarray, words: np.ndarray, of: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add the contexts of all words to ``table`` (buckets x dimensions, and a last column with their number)."""
    for start in range(0, len(words), STRETCH):
        stop = min(start + STRETCH, len(words))
        at, put = [], []
        for far in range(1, REACH + 1):
            left = np.arange(max(start - far, 0), stop - far)
            left = left[of[left] == of[left + far]]
            for word, near in ((words[left], words[left + far]), (words[left + far], words[left])):
                at.append((word[:, None] * np.int64(DIMS + 1) + places[near]).ravel())
                put.append(signs[near].ravel())
        at.append(words[start:stop] * np.int64(DIMS + 1) + DIMS)
        put.append(np.ones(stop - start))
        table += np.bincount(np.concatenate(at), np.concatenate(put), table.size).astype(np.int64).reshape(table.shape)


def context_sums(docs: DataFrame) -> np.ndarray:
    """The table of all contexts of the corpus; its size is fixed, so it may come to the driver."""
    width = DIMS + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (places, signs) = np.zeros((BUCKETS, width), np.int64), index_vectors()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                words, of = numbered(batch.column(0).slice(start, 1000).to_pylist())
                add_contexts(table, words, of, places, signs)
        seen = [b for b in range(BUCKETS // BLOCK) if table[b * BLOCK : (b + 1) * BLOCK].any()]
        sums = [pa.compress(table[b * BLOCK : (b + 1) * BLOCK].tobytes(), "zstd", asbytes=True) for b in seen]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(sums, pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                more = np.frombuffer(pa.decompress(sums.as_py(), BLOCK * width * 8, "zstd"), np.int64)
                total[block] = total[block] + more if block in total else more
        blocks = list(total)
        sums = pa.array([total[b].tobytes() for b in blocks], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), sums], names=["block", "sums"])

    parts = docs.select(_bytes("text")).mapInArrow(count, "block int, sums binary")
    table = np.zeros((BUCKETS, width), np.int64)
    for block, sums in parts.repartition("block").mapInArrow(add, "block int, sums binary").collect():  # at most BUCKETS / BLOCK rows
        table[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums, np.int64).reshape(BLOCK, width)
    return table


def word_vectors(table: np.ndarray) -> np.ndarray:
    """Unit vectors: contexts less what all words share, and the word's own index vector, in equal parts."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIMS))
    np.put_along_axis(own, places, signs / np.sqrt(ONES), axis=1)
    sums, seen = table[:, :DIMS].astype(float), table[:, DIMS:].astype(float)
    mean = sums / np.maximum(seen, 1)
    mean -= sums.sum(axis=0) / max(1.0, seen.sum())
    mean[seen[:, 0] == 0] = 0
    mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    both = mean + own
    return (both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    words, of = numbered(texts)
    count = np.bincount(of, minlength=len(texts)).astype(float)
    total = np.zeros((len(texts), DIMS + REACH))
    for start in range(0, len(words), STRETCH):
        before = min(REACH, start)
        here = of[start - before : start + STRETCH]
        mine = vectors[words[start - before : start + STRETCH]]
        alike = np.zeros((len(here), REACH), np.float32)
        for far in range(1, REACH + 1):
            same = here[far:] == here[:-far]
            alike[far:, far - 1] = np.einsum("ij,ij->i", mine[far:], mine[:-far]) * same
        here = here[before:]
        edges = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        total[here[edges], :DIMS] += np.add.reduceat(mine[before:], edges, axis=0)
        total[here[edges], DIMS:] += np.add.reduceat(alike[before:], edges, axis=0)
    return np.concatenate([total / np.maximum(count, 1)[:, None], np.log1p(count)[:, None]], axis=1)


class Network:
    """Two layers with a temperature. Fitted by Adam on standardised features; deterministic for given rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 5e-3, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-6, 1.0
        x = (x - self.mean) / self.scale
        shapes = ((x.shape[1], hidden), (hidden,), (hidden,), ())
        self.weights = [rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) if i % 2 == 0 else np.zeros(s) for i, s in enumerate(shapes)]
        first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 64):
                step += 1
                rows = order[at : at + 64]
                for k, g in enumerate(self._slopes(x[rows], y[rows], decay)):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = self.weights[k] - rate * move

    def _slopes(self, x: np.ndarray, y: np.ndarray, decay: float) -> list[np.ndarray]:
        w1, b1, w2, b2 = self.weights
        inner = np.tanh(x @ w1 + b1)
        off = (1 / (1 + np.exp(-np.clip(inner @ w2 + b2, -30, 30))) - y) / len(x)
        back = np.outer(off, w2) * (1 - inner**2)
        return [x.T @ back + decay * w1, back.sum(axis=0), inner.T @ off + decay * w2, off.sum()]

    def margins(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss, by golden-section search over its logarithm."""
        margins = self.margins(x)

        def loss(log_t: float) -> float:
            z = margins / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, z) - y * z))

        low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
        for _ in range(60):
            one, two = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, two) if loss(one) < loss(two) else (one, high)
        self.temperature = float(np.exp((low + high) / 2))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x) / self.temperature, -30, 30)))


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def mapped(docs: DataFrame, carry: tuple[str, ...], name: str, kind: str, make: Callable) -> DataFrame:
    """``row`` (the carried columns) and one column made from the texts, 1000 at a time."""
    narrow = docs.select(F.struct(*carry).alias("row"), _bytes("text"))
    schema = narrow.select("row", F.lit(None).cast(kind).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), make(part.column(1).to_pylist())], names=["row", name])

    return narrow.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """``doc_id``, ``text``, ``label``, ``part`` of at most ``most_labelled`` labelled ids, none of them held out."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("label"))
    ours = known.withColumn("part", remainder(F.col("doc_id"))).where(F.col("part") != HELD_OUT)
    ids = ours.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # At most ``most_labelled`` rows of three small columns: a fixed bound.
    chosen = F.broadcast(ids.withColumnRenamed("doc_id", "of_id"))
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("of_id")).select("doc_id", "text", "label", "part")


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Callable[..., DataFrame]:
    """A scorer: ``score(docs, carry)`` gives ``row``, ``held_out``, ``score``, ``predicted``."""
    vectors = word_vectors(context_sums(docs))

    def dense(texts: list[bytes]) -> pa.Array:
        return pa.array(list(pooled(texts, vectors)), pa.list_(pa.float64()))

    sample = mapped(labelled_sample(docs, labels, most_labelled), ("doc_id", "label", "part"), "dense", "array<double>", dense)
    once = sample.groupBy("row.doc_id").agg(F.min(F.struct("row.label", "row.part", "dense")).alias("it"))
    rows = sorted(once.select("doc_id", "it.*").collect())  # at most ``most_labelled`` rows of FEATURES numbers
    x = np.array([r.dense for r in rows]).reshape(len(rows), FEATURES)
    y, part = np.array([float(r.label) for r in rows]), np.array([r.part for r in rows])
    fitted, rest = part != CALIBRATION, part == CALIBRATION
    share = float(y.mean()) if len(y) else 0.0
    network = None
    if len(set(y[fitted])) == 2:
        network = Network(x[fitted], y[fitted])
        if len(set(y[rest])) == 2:
            network.calibrate(x[rest], y[rest])

    def rated(texts: list[bytes]) -> pa.Array:
        found = network.probabilities(pooled(texts, vectors)) if network else np.full(len(texts), share)
        return pa.array(found, pa.float64())

    def score(what: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        return mapped(what, carry, "score", "double", rated).select(
            "row",
            (remainder(F.col("row.doc_id")) == HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )

    return score
