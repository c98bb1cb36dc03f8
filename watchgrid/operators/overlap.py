"""Greedy choices between overlapping boxes: suppression within a frame, and matching predictions to truth.

Both are folds over one image's boxes, done on arrays inside the JVM while an image holds at most ``ARRAY_BOXES``
boxes. Larger images never become one array: their overlaps are found by a grid join and the same greedy outcome is
reached by rounds of joins, each settling every box whose stronger rivals are settled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.functions import geometry as geo
from watchgrid.functions.stats import argmax, sigmoid
from watchgrid.operators.detect import iou_pairs, label_for, oversize, split_off, top_k
from watchgrid.session import cut_lineage

ARRAY_BOXES = 4_096


# Suppression.


def nms(
    boxes: DataFrame, iou: float, keys: Sequence[str], *, keep_equal: bool = True, array_boxes: int = ARRAY_BOXES
) -> DataFrame:
    """Keep, most confident first, every box that overlaps no kept one. ``boxes``: keys, det_seq, confidence, box, any
    other columns. An overlap equal to the limit survives when ``keep_equal`` (decoding), else not (merging)."""
    keys = list(keys)
    # Limits that settle every pair alike, however many boxes there are.
    if iou < 0 or (iou == 0 and not keep_equal):
        row = F.struct(*[c for c in boxes.columns if c not in keys])
        strongest = F.min_by(row, F.struct(-F.col("confidence"), F.col("det_seq"))).alias("_b")
        return boxes.groupBy(*keys).agg(strongest).select(*keys, "_b.*")
    if iou > 1 or (iou == 1 and keep_equal):
        return boxes
    large = oversize(boxes, keys, array_boxes)
    if large is None:
        return _nms_fold(boxes, iou, keys, keep_equal)
    small_part, large_part = split_off(boxes, large, keys)
    return _nms_fold(small_part, iou, keys, keep_equal).unionByName(
        _nms_rounds(_drop_copies(large_part, keys), iou, keys, keep_equal)
    )


def _drop_copies(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Of equal boxes only the strongest can be kept, since at limits under 1 each suppresses the rest; empty boxes overlap
    nothing."""
    flat = {f"_{c}": F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")}
    row = F.struct(*[c for c in boxes.columns if c not in keys])
    has_area = geo.box_area(F.col("box")) > 0
    strongest = (
        boxes.filter(has_area)
        .withColumns(flat)
        .groupBy(*keys, *flat)
        .agg(F.min_by(row, F.struct(-F.col("confidence"), F.col("det_seq"))).alias("_b"))
        .select(*keys, "_b.*")
    )
    return strongest.unionByName(boxes.filter(~has_area))


def _nms_fold(boxes: DataFrame, iou: float, keys: list[str], keep_equal: bool) -> DataFrame:
    others = [c for c in boxes.columns if c not in keys]
    item = F.struct(
        (-F.col("confidence")).alias("_order"), F.col("det_seq").alias("_seq"), F.struct(*others).alias("row"), geo.box_area(F.col("box")).alias("a")
    )
    ordered = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_sorted"))
    empty = F.array().cast(ordered.schema["_sorted"].dataType)

    def keep(kept: Column, candidate: Column) -> Column:
        # Areas are known and each intersection is computed once; boxes that do not touch are apart at any limit left here.
        def shared(other: Column) -> Column:
            return F.struct(geo.intersection(other["row"]["box"], candidate["row"]["box"]).alias("i"), other["a"].alias("a"))

        def apart(m: Column) -> Column:
            union = m["a"] + candidate["a"] - m["i"]
            overlap = F.when(union > 0, m["i"] / union).otherwise(F.lit(0.0))
            return (m["i"] <= 0) | (overlap <= iou if keep_equal else overlap < iou)

        return F.when(F.forall(F.transform(kept, shared), apart), F.concat(kept, F.array(candidate))).otherwise(kept)

    kept = ordered.select(*keys, F.explode(F.aggregate("_sorted", empty, keep)).alias("_k"))
    return kept.select(*keys, "_k.row.*")


def _nms_rounds(boxes: DataFrame, iou: float, keys: list[str], keep_equal: bool) -> DataFrame:
    boxes = cut_lineage(boxes)
    rank = [*keys, "det_seq"]
    pairs = iou_pairs(boxes, boxes, iou if iou > 0 else 1e-300, keys, frame_boxes=0)
    if keep_equal:
        pairs = pairs.filter(F.col("iou") > iou)
    order = boxes.select(*keys, "det_seq", "confidence")
    edges = (
        pairs.filter("a_seq <> b_seq")
        .join(order.select(*keys, F.col("det_seq").alias("a_seq"), F.col("confidence").alias("a_conf")), [*keys, "a_seq"])
        .join(order.select(*keys, F.col("det_seq").alias("b_seq"), F.col("confidence").alias("b_conf")), [*keys, "b_seq"])
        .filter("a_conf > b_conf OR (a_conf = b_conf AND a_seq < b_seq)")
        .select(*keys, F.col("a_seq").alias("over"), F.col("b_seq").alias("under"))
    )
    edges = cut_lineage(edges)
    dropped = None
    while edges.limit(1).count():
        # Boxes without an open stronger rival are kept; what they overlap is dropped, with all its edges.
        under = edges.select(*keys, F.col("under").alias("det_seq")).distinct()
        kept = edges.select(*keys, F.col("over").alias("det_seq")).distinct().join(under, rank, "left_anti")
        gone = edges.join(kept.withColumnRenamed("det_seq", "over"), [*keys, "over"], "left_semi")
        gone = cut_lineage(gone.select(*keys, F.col("under").alias("det_seq")).distinct())
        edges = cut_lineage(
            edges.join(gone.withColumnRenamed("det_seq", "under"), [*keys, "under"], "left_anti").join(
                gone.withColumnRenamed("det_seq", "over"), [*keys, "over"], "left_anti"
            )
        )
        dropped = gone if dropped is None else cut_lineage(dropped.unionByName(gone))
    return boxes if dropped is None else boxes.join(dropped, rank, "left_anti")


# Matching.


def match_predictions(
    pred: DataFrame, truth: DataFrame, iou: float, keys: Sequence[str], *, array_boxes: int = ARRAY_BOXES
) -> DataFrame:
    """Per prediction the truth it claims: most confident first, each takes the unclaimed truth it overlaps most (the
    first of equals) if that overlap reaches ``iou``. ``pred``: keys, det_seq, confidence, box. ``truth``: keys,
    truth_seq, box. Returns keys, det_seq, confidence, truth_seq and match_iou (null where nothing was claimed)."""
    keys = list(keys)
    sized = pred.select(*keys).unionByName(truth.select(*keys))
    large = oversize(sized, keys, array_boxes)
    if large is None:
        return _match_fold(pred, truth, iou, keys)
    small_pred, large_pred = split_off(pred, large, keys)
    small_truth, large_truth = split_off(truth, large, keys)
    return _match_fold(small_pred, small_truth, iou, keys).unionByName(
        _match_rounds(large_pred, large_truth, iou, keys)
    )


def _match_fold(pred: DataFrame, truth: DataFrame, iou: float, keys: list[str]) -> DataFrame:
    area = geo.box_area(F.col("box")).alias("a")
    found = pred.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("det_seq").alias("s"), "box", area))
        ).alias("_p")
    )
    wanted = truth.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("truth_seq").alias("t"), "box", area))).alias("_t")
    )
    both = found.join(wanted, keys, "left")
    truths = F.coalesce(F.col("_t"), F.array().cast(both.schema["_t"].dataType))

    def options(p: Column) -> Column:
        # Best overlap first, the first truth of equals; only overlaps that reach the limit. Each is computed once.
        shared = F.transform(truths, lambda t: F.struct(geo.intersection(p["box"], t["box"]).alias("i"), t["a"].alias("a"), t["t"].alias("t")))
        touching = F.filter(shared, lambda m: m["i"] > 0)
        rated = F.transform(touching, lambda m: F.struct((-(m["i"] / (p["a"] + m["a"] - m["i"]))).alias("v"), m["t"].alias("t")))
        return F.array_sort(F.filter(rated, lambda m: m["v"] <= -iou))

    listed = both.select(
        *keys, F.transform("_p", lambda p: F.struct(p["o"].alias("o"), p["s"].alias("s"), options(p).alias("w"))).alias("_l")
    )
    start = F.array().cast("array<struct<s:bigint,c:double,t:bigint,v:double>>")

    def claim(done: Column, p: Column) -> Column:
        free = F.filter(p["w"], lambda m: ~F.exists(done, lambda d: d["t"].eqNullSafe(m["t"])))
        best = F.get(free, F.lit(0))
        entry = F.struct(
            p["s"].cast("bigint").alias("s"),
            (-p["o"]).cast("double").alias("c"),
            best["t"].cast("bigint").alias("t"),
            (-best["v"]).cast("double").alias("v"),
        )
        return F.concat(done, F.array(entry))

    folded = listed.select(*keys, F.explode(F.aggregate("_l", start, claim)).alias("_m"))
    return folded.select(
        *keys,
        F.col("_m.s").alias("det_seq"),
        F.col("_m.c").alias("confidence"),
        F.col("_m.t").alias("truth_seq"),
        F.col("_m.v").alias("match_iou"),
    )


def _match_rounds(pred: DataFrame, truth: DataFrame, iou: float, keys: list[str]) -> DataFrame:
    """Every open prediction asks for its best open truth; a truth asked for by its strongest remaining candidate is
    granted for good. Truths rank predictions alike, so the greedy order and this one end the same."""
    pred = cut_lineage(pred.select(*keys, "det_seq", "confidence", "box"))
    pairs = iou_pairs(
        pred.select(*keys, "det_seq", "box"),
        truth.select(*keys, F.col("truth_seq").alias("det_seq"), "box"),
        iou if iou > 0 else 1e-300,
        keys,
        frame_boxes=0,
    )
    open_pairs = cut_lineage(
        pairs.join(pred.select(*keys, F.col("det_seq").alias("a_seq"), "confidence"), [*keys, "a_seq"])
    )
    strength = F.struct(F.col("confidence"), -F.col("a_seq"))
    granted = None
    while open_pairs.limit(1).count():
        asks = open_pairs.groupBy(*keys, "a_seq").agg(
            F.max_by(F.struct("b_seq", "iou", "confidence"), F.struct(F.col("iou"), -F.col("b_seq"))).alias("_w")
        ).select(*keys, "a_seq", "_w.*")
        strongest = open_pairs.groupBy(*keys, "b_seq").agg(F.max_by("a_seq", strength).alias("a_seq"))
        done = cut_lineage(asks.join(strongest, [*keys, "a_seq", "b_seq"]))
        open_pairs = cut_lineage(
            open_pairs.join(done.select(*keys, "a_seq"), [*keys, "a_seq"], "left_anti").join(
                done.select(*keys, "b_seq"), [*keys, "b_seq"], "left_anti"
            )
        )
        granted = done if granted is None else cut_lineage(granted.unionByName(done))
    if granted is None:
        return pred.select(
            *keys, "det_seq", "confidence", F.lit(None).cast("long").alias("truth_seq"), F.lit(None).cast("double").alias("match_iou")
        )
    claims = granted.select(
        *keys, F.col("a_seq").alias("det_seq"), F.col("b_seq").alias("truth_seq"), F.col("iou").alias("match_iou")
    )
    return pred.drop("box").join(claims, [*keys, "det_seq"], "left")


def match_boxes(pred: DataFrame, truth: DataFrame, iou: float = 0.3, keys: Sequence[str] = ("image_id",), **options) -> DataFrame:
    """Per image: true positives, false positives and false negatives."""
    keys = list(keys)
    found = (
        match_predictions(pred, truth, iou, keys, **options)
        .groupBy(*keys)
        .agg(F.count("truth_seq").alias("tp"), F.count("*").alias("_pred"))
    )
    wanted = truth.groupBy(*keys).agg(F.count("*").alias("_truth"))
    tp = F.coalesce("tp", F.lit(0))
    return found.join(wanted, keys, "full").select(
        *keys,
        tp.alias("tp"),
        (F.coalesce("_pred", F.lit(0)) - tp).alias("fp"),
        (F.coalesce("_truth", F.lit(0)) - tp).alias("fn"),
    )


# Decoding raw predictions.


def decode_grid_predictions(
    predictions: DataFrame,
    images: DataFrame,
    *,
    class_names: Sequence[str],
    floor: float,
    iou: float,
    k: int = 300,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Anchor rows (keys, anchor_id, cx, cy, w, h, scores) to detections: best class, floor, corners, padding undone,
    clipped, overlaps suppressed, top k. ``scores`` may run on into mask coefficients; only named classes count.
    ``images``: keys, width, height, scale, pad_left, pad_top."""
    keys = list(keys)
    scores = F.slice("scores", 1, len(class_names))
    strong = (
        predictions.withColumn("confidence", F.array_max(scores))
        .filter(F.col("confidence") >= floor)
        .withColumn("class_id", argmax(scores))
    )
    placed = strong.join(images, keys)
    raw = geo.from_centre_size(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))
    unpadded = geo.undo_padding(F.col("_raw"), F.col("scale"), F.col("pad_left"), F.col("pad_top"))
    boxed = (
        placed.withColumn("_raw", raw)
        .withColumn("_box", unpadded)
        .select(
            *keys,
            F.col("anchor_id").cast("long").alias("det_seq"),
            F.col("confidence").cast("double").alias("confidence"),
            label_for(F.col("class_id"), class_names).alias("label"),
            geo.clip(F.col("_box"), F.col("width"), F.col("height")).alias("box"),
        )
    )
    return top_k(nms(boxed, iou, keys), k, keys)


def decode_query_predictions(
    predictions: DataFrame,
    images: DataFrame,
    *,
    class_names: Sequence[str],
    floor: float = 0.30,
    k: int = 100,
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Query rows (keys, query_id, cx, cy, w, h in 0-1, logits) to detections: independent sigmoid scores, best of the
    named slots only, no suppression, top k. ``images``: keys, width, height."""
    keys = list(keys)
    named = F.slice("logits", 1, len(class_names))
    # The sigmoid is monotone, so the best logit is the best class.
    strong = predictions.withColumn("confidence", sigmoid(F.array_max(named))).filter(F.col("confidence") >= floor)
    placed = strong.withColumn("class_id", argmax(named)).join(images, keys)
    box = geo.denormalise(
        geo.from_centre_size(F.col("cx"), F.col("cy"), F.col("w"), F.col("h")), F.col("width"), F.col("height")
    )
    boxed = placed.withColumn("_box", box).select(
        *keys,
        F.col("query_id").cast("long").alias("det_seq"),
        "confidence",
        label_for(F.col("class_id"), class_names).alias("label"),
        geo.clip(F.col("_box"), F.col("width"), F.col("height")).alias("box"),
    )
    return top_k(boxed, k, keys)


def merge_tiles(full: DataFrame, tiles: DataFrame, iou: float = 0.5, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Full-frame detections and tile detections (box relative to tile_x1, tile_y1) merged by suppression. On equal
    confidence the full frame comes first, then tiles by row and column; ``det_seq`` numbers what is kept in that order."""
    keys = list(keys)
    moved = tiles.withColumn("box", geo.offset(F.col("box"), F.col("tile_x1"), F.col("tile_y1")))
    columns = [*keys, "confidence", "box"]
    everything = full.select(
        *columns, F.lit(0).alias("_pass"), F.lit(0).alias("_ty"), F.lit(0).alias("_tx"), F.col("det_seq").alias("_seq")
    ).unionByName(
        moved.select(
            *columns,
            F.lit(1).alias("_pass"),
            F.col("tile_y1").alias("_ty"),
            F.col("tile_x1").alias("_tx"),
            F.col("det_seq").alias("_seq"),
        )
    )
    place = F.struct("_pass", "_ty", "_tx", "_seq")
    merged = nms(everything.select(*columns, place.alias("det_seq")), iou, keys, keep_equal=False)
    order = Window.partitionBy(*keys).orderBy("det_seq")
    return merged.withColumn("det_seq", F.row_number().over(order).cast("long"))
