"""Which frames, images and keys a job looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.operators import scans
from watchgrid.sources.detections import capture_instant

FRAME_CHUNK = 65_536


def mark_repeats(frames: DataFrame, chunk: Column, order: Sequence[str] = ("ts", "frame_index")) -> DataFrame:
    """Flag frames whose signature equals the camera's previous one: a still served twice is one observation."""
    seen = scans.previous(
        frames.withColumn("_first", F.lit(True)),
        ["camera_id"],
        chunk,
        list(order),
        {"_prev_signature": F.col("signature"), "_has_prev": F.col("_first")},
    )
    repeat = F.col("_has_prev").isNotNull() & F.col("signature").eqNullSafe(F.col("_prev_signature"))
    return seen.withColumn("is_repeat", repeat).drop("_first", "_prev_signature", "_has_prev")


def drop_repeats(frames: DataFrame, chunk: Column, order: Sequence[str] = ("ts", "frame_index")) -> DataFrame:
    return mark_repeats(frames, chunk, order).filter(~F.col("is_repeat")).drop("is_repeat")


def stride_of(total: Column, max_frames: int) -> Column:
    """Examine every ``total // max_frames``-th frame, so between one and two times ``max_frames`` are kept."""
    return F.when(total > max_frames, F.greatest(F.lit(1), F.floor(total / max_frames))).otherwise(F.lit(1)).cast("long")


def stride_frames(frames: DataFrame, stride: int | Column) -> DataFrame:
    """Keep every n-th source frame and re-index the kept ones; timestamps stay real."""
    stride = F.lit(stride) if isinstance(stride, int) else stride
    kept = frames.filter(F.col("source_frame") % stride == 0)
    return kept.withColumn("frame_index", F.floor(F.col("source_frame") / stride).cast("long"))


def pick_positions(total: Column, k: int = 6) -> Column:
    """Positions ``int(total * (i + 0.5) / k)`` for i < k."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.floor(F.greatest(total, F.lit(1)) * (i + F.lit(0.5)) / F.lit(k)).cast("long"),
    )


def even_picks(frames: DataFrame, totals: DataFrame, k: int = 6, key: str = "clip") -> DataFrame:
    """Evenly spaced frames of each clip; ``totals`` (clip, total) holds frame counts, positions are 0-based."""
    picks = totals.select(key, F.posexplode(pick_positions(F.col("total"), k)).alias("pick", "position"))
    return frames.join(picks, [key, "position"])


def strided_limit(df: DataFrame, limit: int, order: Column, chunk: Column) -> DataFrame:
    """At most ``limit`` rows spread over the whole order instead of its first rows."""
    numbered = scans.ordinal(df.withColumn("_all", F.lit(0)), ["_all"], chunk, [order], "_n")
    total = df.agg(F.count("*")).scalar()
    stride = F.greatest(F.lit(1), F.floor(total / limit))
    position = F.col("_n") - 1
    return numbered.filter((position % stride == 0) & (position / stride < limit)).select(*df.columns)


def ignition_window(frames: DataFrame, limit: int, negatives_only: bool = False, key: str = "sequence") -> DataFrame:
    """The frames around an event: the latest ``ceil(limit / 2)`` before and the earliest ``limit // 2`` after it; or
    only the ``limit`` earliest before it, which are surely free of it."""
    before, after = F.col("offset") < 0, F.col("offset") > 0

    def first(rows: DataFrame, order: Column, n: int) -> DataFrame:
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, "file")))
        return ranked.filter(F.col("_n") <= n).drop("_n")

    if negatives_only:
        return first(frames.filter(before), F.col("offset").asc(), limit)
    latest = first(frames.filter(before), F.col("offset").desc(), -(-limit // 2))
    return latest.unionByName(first(frames.filter(after), F.col("offset").asc(), limit // 2))


def first_per_index(frames: DataFrame, start: int, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The alphabetically first file per capture index, for indexes in ``[start, start + n)``."""
    inside = frames.filter((F.col("capture_index") >= start) & (F.col("capture_index") < start + n))
    return inside.groupBy(*keys, "capture_index").agg(F.min("path").alias("path"))


def daylight(keys: DataFrame, start: int = 14, end: int = 24, last: int | None = None) -> DataFrame:
    """Stills taken in UTC hours ``[start, end)``, optionally only the newest ``last`` per camera."""
    captured = keys.withColumn("captured_at", capture_instant(F.col("key")))
    hour = F.floor(F.col("captured_at") % 86400 / 3600)
    lit = captured.filter((hour >= start) & (hour < end))
    if last is None:
        return lit
    newest = Window.partitionBy("camera_id").orderBy(F.desc("captured_at"), F.desc("key"))
    return lit.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last).drop("_n")


def tile_grid(frames: DataFrame, tile: int = 512, overlap: float = 0.2) -> DataFrame:
    """Overlapping tiles over each frame; the last row and column align with the frame's edge."""
    stride = int(tile * (1 - overlap))

    def origins(extent: Column) -> Column:
        last = F.greatest(extent - tile, F.lit(0))
        return F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last))

    columns = frames.columns
    gridded = frames.withColumn("tile_y1", F.explode(origins(F.col("height").cast("int")))).withColumn(
        "tile_x1", F.explode(origins(F.col("width").cast("int")))
    )
    return gridded.select(
        *columns,
        "tile_x1",
        "tile_y1",
        F.least(F.col("tile_x1") + tile, F.col("width").cast("int")).alias("tile_x2"),
        F.least(F.col("tile_y1") + tile, F.col("height").cast("int")).alias("tile_y2"),
    )


# Splits. A seeded hash order stands in for a shuffle: any executor computes the same split.


def hash_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def camera_folds(sequences: DataFrame, chunk: Column | None = None, camera: str = "camera_id") -> DataFrame:
    """Distinct cameras, sorted and alternated into folds A and B. ``chunk`` cuts the order for very many cameras."""
    cameras = sequences.select(camera).distinct().withColumn("_all", F.lit(0))
    chunk = F.lit(0) if chunk is None else chunk
    numbered = scans.ordinal(cameras, ["_all"], chunk, [F.col(camera)], "_n")
    return numbered.select(camera, F.when(F.col("_n") % 2 == 1, "A").otherwise("B").alias("fold"))


def _ranked_in_stratum(items: DataFrame, stratum: str, order: Column, buckets: int) -> DataFrame:
    ordered = items.withColumn("_o", order)
    # The order column spans all 64-bit integers; its high bits cut every stratum into even chunks.
    chunk = F.floor(F.col("_o") / F.lit(float(2**64 // buckets))).cast("long")
    ranked = scans.ordinal(ordered, [stratum], chunk, [F.col("_o")], "_n")
    sizes = items.groupBy(stratum).agg(F.count("*").alias("_size"))
    return ranked.join(sizes, stratum)


def stratified_split(
    items: DataFrame, stratum: str, fraction: float, order: Column, buckets: int = 64
) -> DataFrame:
    """Mark ``max(1, int(n * fraction))`` items of each stratum as validation, the rest as training."""
    ranked = _ranked_in_stratum(items, stratum, order, buckets)
    held = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(fraction)))
    return ranked.select(*items.columns, F.when(F.col("_n") <= held, "validation").otherwise("training").alias("split"))


def capped_split(
    items: DataFrame, stratum: str, cap: int, index: Column, order: Column, chunk: Column, buckets: int = 64
) -> DataFrame:
    """Split every class by capture index, first four fifths training, then keep at most ``cap`` training and
    ``max(40, cap // 4)`` test items of each class in hash order; the cap is the sampling feature itself."""
    numbered = scans.ordinal(items, [stratum], chunk, [index], "_i")
    sizes = items.groupBy(stratum).agg(F.count("*").alias("_all"))
    split = numbered.join(sizes, stratum).withColumn(
        "split", F.when(F.col("_i") <= F.floor(F.col("_all") * F.lit(0.8)), "training").otherwise("test")
    )
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order))

    def first(side: str, n: int) -> DataFrame:
        # A literal limit lets every task keep only its own first n before the shuffle.
        return split.filter(F.col("split") == side).withColumn("_r", rank).filter(F.col("_r") <= n)

    kept = first("training", cap).unionByName(first("test", max(40, cap // 4)))
    return kept.select(*items.columns, "split")
