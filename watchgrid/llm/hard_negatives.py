"""Hard negatives by a vertical scan of decomposed vectors with branch-and-bound (BOND).

Vectors are cut into blocks that store one dimension after another. An anchor reads a block's dimensions in descending
order of its own magnitudes, a few at a time. What the dimensions still unread can add lies between the sums of their
smallest and largest contributions, which the block's minimum and maximum per dimension give; with them every row still
a candidate has a lower and an upper bound of its score. Rows whose bounds rule them out leave the bitmap; the rows
that are left when all dimensions are read have exact scores.

* Positives: a row goes when its upper bound is under the k-th best lower bound.
* Negatives: each positive opens a window of admitted scores. A row goes when it lies outside every window, or when a
  window already has k rows that are surely inside and surely better.

Anchors meet blocks in an equi-join on (group of anchors, lane of blocks): every cell is one block of rows and one block
of anchors, both bounded, so nothing is collected and no key is hot. A cell answers with its own first rows per anchor;
a ranked window, which Spark trims before its shuffle, takes the first of those.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; an empty
vector scores 0; vectors of different lengths do not meet; rows of the anchor's own id are not "other" rows; repeated
anchors are one anchor, other repeated rows count one by one; ties go to the smaller id; an anchor without positives or
a positive without negatives gives no row; very long vectors only make blocks larger; an empty table gives no row; other
columns are ignored. A component of 2**20 or more in absolute value is an error, since scores are computed as long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from watchgrid.session import cut_lineage

SCALE = 256
#: Rows of a block, anchors of a block, and dimensions that are read between two looks at the bounds.
BLOCK_ROWS = 2048
BLOCK_ANCHORS = 512
STEP = 8
#: Rows with the same lane meet the anchors in the same place; anchors are repeated once per lane.
LANES = 64
LIMIT = 2.0**20


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``q`` (floor(scale * x) as long) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    fits = F.forall("x", lambda v: F.abs(v) < LIMIT)
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite
    )
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    message = F.lit(f"a component is not under {LIMIT:.0f} in absolute value")
    return kept.select("vec_id", "label", F.when(fits, whole).otherwise(F.raise_error(message)).alias("q"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows with equal ``g`` and vector length: ids, labels, and cells dimension by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        count = 0

        def blocks() -> pa.RecordBatch:
            keys = list(held)
            out = [[np.concatenate(part) for part in zip(*held[k])] for k in keys]
            columns = [
                pa.array([g for g, _ in keys], pa.int32()),
                pa.array([dims for _, dims in keys], pa.int32()),
                *[pa.array([b[i].tobytes() for b in out], pa.binary()) for i in (0, 1)],
                pa.array([np.ascontiguousarray(b[2].T).tobytes() for b in out], pa.binary()),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["g", "dims", "ids", "labels", "cells"])

        for batch in batches:
            g, ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.r_[0, np.cumsum(sizes)]
            for start in range(0, len(ids), size):
                there = np.arange(start, min(start + size, len(ids)))
                if count + len(there) > size:
                    yield blocks()
                    count = 0
                count += len(there)
                for key in set(zip(g[there].tolist(), sizes[there].tolist())):
                    mine = there[(g[there] == key[0]) & (sizes[there] == key[1])]
                    cells = flat[ends[mine][:, None] + np.arange(key[1])]
                    held.setdefault(key, []).append((ids[mine].astype(np.int64), labels[mine].astype(np.int64), cells))
        if held:
            yield blocks()

    return rows.select("g", "vec_id", "label", "q").mapInArrow(run, "g int, dims int, ids binary, labels binary, cells binary")


class Block:
    def __init__(self, dims: int, ids: bytes, labels: bytes, cells: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        # Sums of products stay under 2**53 for embeddings as usual, where floating point is exact and quicker.
        self.cells = np.frombuffer(cells, np.int32).reshape(dims, len(self.ids))
        self.top = int(np.abs(self.cells).max(initial=0))

    def typed(self, kind: type) -> "Block":
        self.cells = self.cells.astype(kind)
        self.low = self.cells.min(axis=1) if len(self.ids) else None
        self.high = self.cells.max(axis=1) if len(self.ids) else None
        return self


def vertical_scan(block: Block, q: np.ndarray, alive: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates ``alive`` that ``keep(lower, upper)`` never rules out."""
    order = np.argsort(-np.abs(q), kind="stable")
    one, two = q * block.low, q * block.high
    least = np.r_[np.cumsum(np.minimum(one, two)[order][::-1])[::-1], 0].astype(q.dtype)
    most = np.r_[np.cumsum(np.maximum(one, two)[order][::-1])[::-1], 0].astype(q.dtype)
    score = np.zeros(len(alive), q.dtype)
    for start in range(0, len(order), STEP):
        read = order[start : start + STEP]
        cells = block.cells[read] if len(alive) == len(block.ids) else block.cells[read[:, None], alive]
        score = score + q[read] @ cells
        end = start + len(read)
        stays = keep(score + least[end], score + most[end])
        if not stays.all():
            alive, score = alive[stays], score[stays]
        if not len(alive):
            break
    return alive, score


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def best_rule(k: int) -> Callable:
    return lambda lower, upper: upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), bool)


def window_rule(windows: list[tuple[int, int]], k: int) -> Callable:
    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(lower), bool)
        for low, high in windows:
            sure = lower[(lower >= low) & (upper <= high)]
            least = _kth(sure, k) if len(sure) >= k else low
            stays |= (upper >= least) & (lower <= high)
        return stays

    return keep


def first_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive; empty (first above second) if there are none."""
    return -(-low * positive // 100), high * positive // 100


def _pairs(blocks: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Every block of rows beside every block of anchors of the same vector length, one such cell per row."""
    lane = F.pmod(F.col("block"), F.lit(LANES)).cast("int")
    left = blocks.select("block", "dims", "ids", "labels", "cells", lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("lane"))
    return left.join(right, ["g", "lane", "dims"])


def _typed(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block, Block]]:
    for row in batch.to_pylist():
        block = Block(row["dims"], row["ids"], row["labels"], row["cells"])
        asking = Block(row["dims"], row["a_ids"], row["a_labels"], row["a_cells"])
        kind = np.float64 if block.top * asking.top * max(1, row["dims"]) < 2**52 else np.int64
        yield row, block.typed(kind), asking.typed(kind)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = SCALE,
) -> DataFrame:
    """Per anchor (``vec_id`` divisible by ``every``) and positive the first ``negatives`` rows of other labels whose score
    is ``low`` to ``high`` per cent of the positive's: anchor_id, positive_id, positive_rank, rank, negative_id,
    positive_score, negative_score."""
    rows = quantised(vectors, scale)
    blocks = packed(rows.withColumn("g", F.lit(0)), BLOCK_ROWS).withColumn("block", F.monotonically_increasing_id())
    blocks = cut_lineage(blocks)
    asking = rows.where(F.col("vec_id") % every == 0).distinct()
    groups = max(1, -(-asking.count() // BLOCK_ANCHORS))
    grouped = asking.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    anchors = packed(grouped.repartition("g").sortWithinPartitions("g", F.size("q")), BLOCK_ANCHORS)
    anchors = cut_lineage(
        anchors.select(
            "g", "dims", F.monotonically_increasing_id().alias("asking"),
            *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "cells")],
        )
    )

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, wanted in _typed(batch):
                out = []
                for i, (anchor, label) in enumerate(zip(wanted.ids.tolist(), wanted.labels.tolist())):
                    mine = np.flatnonzero((block.labels == label) & (block.ids != anchor))
                    there, scores = vertical_scan(block, wanted.cells[:, i], mine, best_rule(positives)) if len(mine) else (mine, mine)
                    for j in first_rows(block.ids[there], scores, positives):
                        out.append((row["asking"], i, anchor, int(block.ids[there[j]]), int(scores[j])))
                yield _batch(out, "asking", "at", "anchor_id", "vec_id", "score")

    ranked = Window.partitionBy("asking", "at").orderBy(F.desc("score"), "vec_id")
    found = _pairs(blocks, anchors, groups).mapInArrow(find_positives, "asking long, at long, anchor_id long, vec_id long, score long")
    found = found.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= positives)
    wanted = found.groupBy("asking").agg(F.collect_list(F.struct("at", "k", "vec_id", "score")).alias("chosen"))
    armed = cut_lineage(anchors.join(wanted, "asking"))

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block, wanted in _typed(batch):
                out, chosen = [], {}
                for c in sorted(row["chosen"], key=lambda c: (c["at"], c["k"])):
                    chosen.setdefault(c["at"], []).append((c, window_of(c["score"], low, high)))
                for i, asked in chosen.items():
                    anchor = int(wanted.ids[i])
                    open_ = [w for _, w in asked if w[0] <= w[1]]
                    other = np.flatnonzero((block.labels != wanted.labels[i]) & (block.ids != anchor))
                    if not open_ or not len(other):
                        continue
                    there, scores = vertical_scan(block, wanted.cells[:, i], other, window_rule(open_, negatives))
                    ids = block.ids[there]
                    for c, (least, most) in asked:
                        inside = np.flatnonzero((scores >= least) & (scores <= most))
                        for j in inside[first_rows(ids[inside], scores[inside], negatives)]:
                            out.append((row["asking"], i, anchor, c["vec_id"], c["k"], c["score"], int(ids[j]), int(scores[j])))
                yield _batch(out, "asking", "at", "anchor_id", "positive_id", "positive_rank", "positive_score", "negative_id", "negative_score")

    ranked = Window.partitionBy("asking", "at", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    fields = ("asking", "at", "anchor_id", "positive_id", "positive_rank", "positive_score", "negative_id", "negative_score")
    met = _pairs(blocks, armed, groups).mapInArrow(find_negatives, ", ".join(f"{f} long" for f in fields))
    met = met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return met.select(
        "anchor_id", "positive_id", F.col("positive_rank").cast("int"), "rank", "negative_id", "positive_score", "negative_score"
    )


def _batch(rows: list[tuple], *names: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))
