"""From raw predictions to detections: decoding, suppression of overlaps, class handling, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.functions import geometry as geo
from watchgrid.functions.stats import argmax, sigmoid
from watchgrid.session import cut_lineage
from watchgrid.sources import dims


def above_floor(det: DataFrame, floor: float) -> DataFrame:
    return det.filter(F.col("confidence") >= floor)


def label_for(class_id: Column, names: Sequence[str], base: int = 0) -> Column:
    """Class number to name, ``class_<id>`` outside the list. ``base`` 1 serves one-based numbering."""
    table = F.array(*[F.lit(n) for n in names])
    position = class_id - base
    known = (position >= 0) & (position < len(names))
    return F.when(known, F.get(table, position.cast("int"))).otherwise(F.concat(F.lit("class_"), class_id.cast("string")))


def tag_context(det: DataFrame, alarm_labels: Sequence[str], include_context: bool = False) -> DataFrame:
    """Mark labels that may not raise an alarm as context; they are dropped unless asked for."""
    tagged = det.withColumn("is_context", ~F.col("label").isin(list(alarm_labels)))
    return tagged if include_context else tagged.filter(~F.col("is_context"))


def merge_classes(
    det: DataFrame,
    merge: DataFrame,
    alarm_labels: Sequence[str] = tuple(dims.ALARM_LABELS["building_access"]),
    include_context: bool = False,
    keep_unmerged: bool = False,
) -> DataFrame:
    """Fold model classes into merged ones, keeping the original as ``model_class``. Unmapped classes are dropped, or
    kept as context under their own name."""
    joined = det.withColumn("model_class", F.col("label")).join(
        merge, "model_class", "left" if keep_unmerged else "inner"
    )
    alarm = F.col("merged_class").isin(list(alarm_labels))
    tagged = joined.withColumn("label", F.coalesce("merged_class", "model_class")).withColumn(
        "is_context", F.coalesce(~alarm, F.lit(True))
    )
    kept = tagged if include_context else tagged.filter(~F.col("is_context") | F.col("merged_class").isNull())
    return kept.select(*det.columns, "model_class", "is_context")


def redaction_plan(det: DataFrame, frames: DataFrame, divisor: int = 6) -> DataFrame:
    """Where to blur: person labels only, integer boxes clipped to the frame, an odd kernel scaled to the box.
    ``frames`` gives (camera_id, frame_index, width, height)."""
    people = det.filter(F.col("label").isin(dims.PERSON_LABELS)).join(frames, ["camera_id", "frame_index"])

    def pixel(name: str) -> Column:
        return F.bround(F.col(name), 0).cast("long")

    boxed = people.select(
        "camera_id",
        "frame_index",
        "det_seq",
        "label",
        F.greatest(F.lit(0), pixel("x1")).alias("rx1"),
        F.greatest(F.lit(0), pixel("y1")).alias("ry1"),
        F.least(F.col("width").cast("long"), pixel("x2")).alias("rx2"),
        F.least(F.col("height").cast("long"), pixel("y2")).alias("ry2"),
    ).filter((F.col("rx2") > F.col("rx1")) & (F.col("ry2") > F.col("ry1")))
    short = F.least(F.col("ry2") - F.col("ry1"), F.col("rx2") - F.col("rx1"))
    kernel = F.greatest(F.lit(3), F.floor(short / divisor).bitwiseOR(F.lit(1)))
    return boxed.withColumn("kernel", kernel.cast("long"))


def attach_water_context(det: DataFrame, readings: DataFrame) -> DataFrame:
    """Detections with the water readings of their frame; the rate is the level's where there is one."""
    context = readings.select(
        "camera_id",
        "frame_index",
        F.col("area_fraction").alias("coverage"),
        "level_fraction",
        "level_metres",
        "trend",
        F.coalesce("level_rate_per_min", "area_rate_per_min").alias("rate_per_min"),
    )
    return det.join(context, ["camera_id", "frame_index"])


#: Pixel rows in one band; boxes and pixel runs meet by frame and band.
_BAND_ROWS = 32


def grey_fractions(
    boxes: DataFrame, pixels: DataFrame, cuts: Sequence[int], min_value: int = 50, keys=("camera_id", "frame_index")
) -> DataFrame:
    """Share of a box's pixels that are bright and hardly saturated, for every saturation cut at once (``grey_<cut>``).
    ``pixels``: keys, y, x0, x1, saturation, value as horizontal runs. Boxes without an overlapping pixel have no row."""
    wide = F.least(F.col("x1p"), F.col("bx2")) - F.greatest(F.col("x0p"), F.col("bx1"))
    runs = pixels.select(
        *keys,
        F.col("y").alias("yp"),
        F.col("x0").alias("x0p"),
        F.col("x1").alias("x1p"),
        "saturation",
        "value",
        F.floor(F.col("y") / _BAND_ROWS).cast("long").alias("_band"),
    )
    clipped = boxes.select(
        *keys,
        "det_seq",
        *[F.bround(F.col(n), 0).cast("long").alias(f"b{n}") for n in ("x1", "y1", "x2", "y2")],
    ).filter("by2 > by1")
    bands = F.sequence(F.floor(F.col("by1") / _BAND_ROWS), F.floor((F.col("by2") - 1) / _BAND_ROWS))
    banded = clipped.withColumn("_band", F.explode(bands.cast("array<bigint>")))
    inside = (F.col("yp") >= F.col("by1")) & (F.col("yp") < F.col("by2")) & (wide > 0)

    def share(cut: int) -> Column:
        grey = (F.col("saturation") <= cut) & (F.col("value") >= min_value)
        return (F.sum(F.when(grey, wide).otherwise(0)) / F.sum(wide)).alias(f"grey_{cut}")

    met = banded.join(runs, [*keys, "_band"]).filter(inside)
    return met.groupBy(*keys, "det_seq").agg(*[share(cut) for cut in cuts])


def grey_fraction(boxes: DataFrame, pixels: DataFrame, cut: int, min_value: int = 50, keys=("camera_id", "frame_index")) -> DataFrame:
    """``grey_fractions`` at one cut. Boxes without an overlapping pixel get no share and fail the test."""
    return grey_fractions(boxes, pixels, [cut], min_value, keys).withColumnRenamed(f"grey_{cut}", "grey_fraction")


def grey_enough(cut: int, min_fraction: float = 0.10) -> Column:
    return F.col(f"grey_{cut}") >= min_fraction


def passes_grey(boxes: DataFrame, shares: DataFrame, cut: int, min_fraction: float = 0.10, keys=("camera_id", "frame_index")) -> DataFrame:
    """The boxes whose share at the cut (from ``grey_fractions``) is large enough."""
    enough = shares.filter(grey_enough(cut, min_fraction))
    return boxes.join(enough.select(*keys, "det_seq"), [*keys, "det_seq"], "left_semi")


# Geometry between boxes of one frame.


#: Frames of at most so many boxes, both sides together, are compared box by box.
FRAME_BOXES = 64
#: No box spans more than this many cells of its frame's grid, plus one, in either direction.
_WIDEST = 16


def _cell_sizes(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per frame the grid cell that nine of ten boxes fit into, whatever unit the boxes are in."""
    side = F.greatest(F.col("box.x2") - F.col("box.x1"), F.col("box.y2") - F.col("box.y1"))
    size = F.greatest(F.percentile_approx(side, 0.9, 1000), F.max(side) / _WIDEST)
    return boxes.filter(side > 0).groupBy(*keys).agg(size.alias("_cell"))


def oversize(counted: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The keys holding more than ``limit`` rows, or None when there are none."""
    large = counted.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*keys)
    large = cut_lineage(large)
    return large if large.limit(1).count() else None


def split_off(df: DataFrame, large: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def iou_pairs(
    a: DataFrame, b: DataFrame, threshold: float, keys: Sequence[str], cell: float | None = None, frame_boxes: int = FRAME_BOXES
) -> DataFrame:
    """Pairs of boxes of the same frame with IoU >= threshold (> 0). ``a``, ``b``: keys, det_seq, box. In frames of at most
    ``frame_boxes`` boxes all pairs are compared. In larger ones boxes meet only where they share a grid cell, and the cell
    that holds the overlap's upper left corner reports the pair once. Without ``cell`` each frame's cell follows from the
    boxes of ``a``; a given cell serves all frames, small ones too."""
    keys, box = list(keys), F.col("box")
    valid = (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])
    a, b = (df.filter(valid).select(*keys, "det_seq", "box") for df in (a, b))
    if cell is not None or frame_boxes == 0:
        return _pairs_by_grid(a, b, threshold, keys, cell)
    large = oversize(a.select(*keys).unionByName(b.select(*keys)), keys, frame_boxes)
    if large is None:
        return _pairs_in_frame(a, b, threshold, keys)
    (a_few, a_many), (b_few, b_many) = split_off(a, large, keys), split_off(b, large, keys)
    return _pairs_in_frame(a_few, b_few, threshold, keys).unionByName(_pairs_by_grid(a_many, b_many, threshold, keys, None))


_SIDES = ("x1", "y1", "x2", "y2")


def _flat(df: DataFrame, side: str) -> DataFrame:
    """Coordinates in plain columns and the area once per box, so that what is left to do per pair is short."""
    box = F.col("box")
    named = [box[c].alias(f"{side}_{c}") for c in _SIDES]
    return df.select(*[c for c in df.columns if c not in ("det_seq", "box")], F.col("det_seq").alias(f"{side}_seq"), *named, geo.box_area(box).alias(f"{side}_area"))


def _corner(name: str) -> Column:
    return F.greatest(F.col(f"a_{name}"), F.col(f"b_{name}"))


def _enough(pairs: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    wide = F.least(F.col("a_x2"), F.col("b_x2")) - _corner("x1")
    high = F.least(F.col("a_y2"), F.col("b_y2")) - _corner("y1")
    shared = wide * high
    overlap = F.try_divide(shared, F.col("a_area") + F.col("b_area") - shared)
    found = pairs.filter((wide > 0) & (high > 0)).select(*keys, "a_seq", "b_seq", overlap.alias("iou"))
    return found.filter((F.col("iou") >= threshold) & (F.col("iou") > 0))


def _pairs_in_frame(a: DataFrame, b: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    return _enough(_flat(a, "a").join(_flat(b, "b"), keys), threshold, keys)


def _pairs_by_grid(a: DataFrame, b: DataFrame, threshold: float, keys: list[str], given: float | None) -> DataFrame:
    if given is None:
        sizes = _cell_sizes(a, keys)
        a, b = a.join(sizes, keys), b.join(sizes, keys)
    else:
        a, b = a.withColumn("_cell", F.lit(float(given))), b.withColumn("_cell", F.lit(float(given)))
    cell = F.col("_cell")

    def cells(df: DataFrame, side: str) -> DataFrame:
        box = F.col("box")
        xs = F.sequence(F.floor(box["x1"] / cell), F.floor(box["x2"] / cell))
        ys = F.sequence(F.floor(box["y1"] / cell), F.floor(box["y2"] / cell))
        spread = df.select("*", F.explode(xs).alias("_cx"), ys.alias("_ys")).select(*df.columns, "_cx", F.explode("_ys").alias("_cy"))
        return _flat(spread, side)

    left, right = cells(a, "a"), cells(b, "b").drop("_cell")
    joined = left.join(right, [*keys, "_cx", "_cy"])
    at_corner = (F.floor(_corner("x1") / cell) == F.col("_cx")) & (F.floor(_corner("y1") / cell) == F.col("_cy"))
    return _enough(joined.filter(at_corner), threshold, keys)


def top_k(det: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The k most confident detections per image, ties in input order."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.asc("det_seq"))
    return det.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def by_confidence(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detections most confident first, stable on input order."""
    return det.orderBy(*keys, F.desc("confidence"), F.asc("det_seq"))


def regions_by_area(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    area = geo.box_area(geo.box_of())
    return det.orderBy(*keys, area.desc(), F.asc("det_seq"))


def best_candidate(candidates: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    row = F.struct(*[c for c in candidates.columns if c not in keys])
    return candidates.groupBy(*keys).agg(F.max_by(row, F.col(score)).alias("_best")).select(*keys, "_best.*")
