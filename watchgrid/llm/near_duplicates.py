"""Near-duplicates by min-max hashing, banding and exact confirmation.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so 64 permutations make a
signature of 128 values. Each agrees between two documents with the probability of their Jaccard similarity; values in a
band come from different permutations. 32 bands of four values miss a pair at similarity 0.75 with probability 5e-6.

Documents with equal shingle sets form a class, and only its number goes on, so an id with several texts has a class for each;
the smallest id names a component at the end, and of its classes with that id the first by digest is kept. Classes that share a band are not paired
all with all: each member of a bucket is compared with one pivot of the bucket a round, which joins nearly all of a group of
copies within a few rounds. Members of buckets that are then still of several components meet once more in a prefix-filtered
join across components only: the rarest shingles of both must meet, so members of a large group that are too far edited to be
linked with any other find no partner there. No link between components is lost, and every link is confirmed on the full
shingle sets, which are made again from the texts of bucket members only.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is kept; a null id is linked with
nothing, its ``component_id`` is null and it is kept; repeated rows each get the same result; a very long text is shingled
whole, its signature taken in stretches; an empty table gives none;
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from watchgrid.llm.common import sent_if_small
from watchgrid.session import cut_lineage, free_finished

SHINGLE = 5
PERMUTATIONS = 64
BAND = 4
PERCENT = 75
#: Rounds of pivots at most, and the share of components a round must leave under to be followed by another. What the
#: rounds leave apart is settled by the prefix join, whatever these are.
MOST_TURNS = 10
LEAST_GAIN = 0.9

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * _STEP)
_FACTORS = (_SEEDS[:PERMUTATIONS] | np.uint64(1))[:, None]
_SHIFTS = _SEEDS[PERMUTATIONS:][:, None]


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, one of none has none."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    rolled = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _STEP + each[i : i + len(rolled)]
    return np.unique(_mixed(rolled))


def signature(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The minima of all permutations, then their maxima."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for start in range(0, len(shingles), block):
        turned = shingles[start : start + block][None, :] * _FACTORS + _SHIFTS
        np.minimum(low, turned.min(axis=1), out=low)
        np.maximum(high, turned.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands never sharing one but by chance."""
    bands = values.reshape(-1, BAND)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(BAND):
        key = _mixed(key * _STEP + bands[:, i])
    return key.view(np.int64)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text)
                sizes.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(signature(found)) if len(found) else [])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """Add ``name``, the digest of the text's shingle set (null without shingles), to all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = map(shingle_set, batch.column(at).to_pylist())
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and its shingle hashes, for the classes in some bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text) for text in batch.column(2).to_pylist()]
            same = [xxhash.xxh128_digest(s.tobytes()) == d for s, d in zip(found, batch.column(1).to_pylist())]
            sets = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["rep", "shingles"]).filter(pa.array(same, pa.bool_()))

    texts = docs.join(wanted, F.col("doc_id") == F.col("id")).select("rep", "digest", "text")
    return texts.mapInArrow(run, "rep long, shingles array<long>").groupBy("rep").agg(F.first("shingles").alias("shingles"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (its component's smallest node) for every node but the roots, by star contraction of links a, b."""
    stars = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    while True:
        both = stars.union(stars.select(F.col("b"), F.col("a"))).toDF("a", "b")
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        stars = cut_lineage(small.union(least.select("a", "m")).toDF("a", "b").distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return stars.toDF("node", "root")
        state = now


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("of_a"))
    other = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    sizes = F.size("of_a") + F.size("of_b")
    met = pairs.join(one, "a").join(other, "b").select("a", "b", shared.alias("shared"), sizes.alias("sizes"))
    return met.where(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select("a", "b")


def prefix_pairs(live: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different components that can be similar: they share one of the rarest shingles of either.

    Two sets of similarity t agree somewhere in their first n - ceil(t n) + 1 shingles, whatever the common order; with the
    rarest first, a copy's own edits come before what the whole group has. The places where they meet bound the overlap.
    """
    tokens = live.join(sets, "rep").select("rep", "n", "comp", F.explode("shingles").alias("shingle"))
    common = tokens.groupBy("shingle").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    needed = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    ranked = tokens.join(common, "shingle").withColumn("place", F.row_number().over(order))
    first = ranked.where((F.col("place") <= F.col("n") - needed + 1) & (F.col("df") > 1))
    first = cut_lineage(first.select("shingle", "rep", "n", "comp", "place"))
    one, other = (first.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "n", "comp", "place")]) for x in "ab")
    overlap = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    met = one.join(other, "shingle").where(
        (F.col("rep_a") < F.col("rep_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & ((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b")))
    )
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def _pivot_links(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found by rounds of pivots, and the members (``rep``, ``n``, ``comp``) whose buckets still hold several components.

    In a round every member of a bucket that is not in the pivot's component is compared with the pivot, so a round is
    linear in the members. The first pivot is the bucket's smallest number; later ones are drawn by a hash of the round,
    since an outlier as pivot ties nobody. Rounds go on while they bring members together."""
    placed, links, before = members.select("key", "rep", "n", F.col("rep").alias("comp")), None, None
    for turn in range(MOST_TURNS):
        order = F.struct("rep") if turn == 0 else F.struct(F.xxhash64("rep", F.lit(turn)), "rep")
        hubs = placed.groupBy("key").agg(F.min_by(F.struct("rep", "n", "comp"), order).alias("hub"))
        alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
        others = placed.join(hubs, "key").where((F.col("comp") != F.col("hub.comp")) & alike)
        pairs = others.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
        found = cut_lineage(_confirmed(pairs, sets, percent))
        links = found if links is None else cut_lineage(links.union(found))
        roots = components(links)
        placed = members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("comp"))
        apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
        placed = cut_lineage(placed.join(apart, "key"))
        now = placed.select("key", "comp").distinct().count()
        if not now or (before is not None and now > LEAST_GAIN * before):
            break
        before = now
        free_finished(members.sparkSession)
    return links, placed.select("rep", "n", "comp").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and, if asked for, ``digest``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut_lineage(_sketches(docs))
    classes = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = cut_lineage(classes.withColumn("rep", F.monotonically_increasing_id()))  # numbers hold once they are stored
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = cut_lineage(banded.join(shared, "key"))
    wanted = classes.select("rep", "digest", "id").join(members.select("rep").distinct(), "rep", "left_semi")
    sets = cut_lineage(_sets(docs, wanted))
    free_finished(docs.sparkSession)
    links, live = _pivot_links(members, sets, percent)
    more = _confirmed(cut_lineage(prefix_pairs(live, sets, percent)), sets, percent)
    free_finished(docs.sparkSession)
    roots = components(links.union(more))
    # A component is named by its smallest id; of several classes with that id the first stays.
    placed = roots.union(roots.select("root", F.col("root")).distinct()).toDF("node", "root")
    first = placed.join(classes.select("rep", "id", "digest"), F.col("node") == F.col("rep")).groupBy("root").agg(
        F.min(F.struct("id", "digest")).alias("first")
    )
    named = placed.join(sent_if_small(cut_lineage(first)), "root").select("node", "first")
    group = classes.join(named, F.col("rep") == F.col("node"), "left").select(
        F.col("digest").alias("of"),
        F.coalesce("first.id", "id").alias("component"),
        F.coalesce(F.col("first.digest") == F.col("digest"), F.lit(True)).alias("stays"),
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sketches.join(group, F.col("digest") == F.col("of"), "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce((F.col("doc_id") == component) & F.coalesce("stays", F.lit(True)), F.col("doc_id").isNull()).alias("kept"),
        *(["digest"] if digest else []),
    )
