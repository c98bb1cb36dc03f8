"""Confusion counts and the rates derived from them, at box, image, frame and pixel level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.functions.stats import fbeta, safe_ratio, wilson
from watchgrid.operators.overlap import match_predictions
from watchgrid.session import cut_lineage


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": fbeta(precision, recall, 1.0),
        "f2": fbeta(precision, recall, 2.0),
        "false_alarm_rate": safe_ratio(fp, fp + tn),
    }


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Add precision, recall, F1, F2 and false-alarm rate to tp, fp, fn, tn; 0 where undefined."""
    named = rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[c.alias(n) for n, c in named.items()])


def aggregate_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def image_confusion(pred: DataFrame, truth: DataFrame, images: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Did each image alarm, and should it have? ``images`` lists all of them, silent ones included."""
    alarmed = pred.select(*keys).distinct().withColumn("all", F.lit(True))
    return image_confusions(alarmed, truth, images, keys, ["all"], "arm").drop("arm")


def image_confusions(
    alarmed: DataFrame, truth: DataFrame, images: DataFrame, keys: Sequence[str], arms: Sequence[str], name: str
) -> DataFrame:
    """``image_confusion`` of several arms from one pass over the images. ``alarmed``: keys, once each, and a boolean column
    per arm (null: no alarm). Returns a row per arm, named in the last column, ``name``."""
    keys = list(keys)
    wanted = truth.select(*keys).distinct().withColumn("_truth", F.lit(True))
    joined = images.select(*keys).join(alarmed, keys, "left").join(wanted, keys, "left")
    t = F.col("_truth").isNotNull()

    def counts(arm: str) -> list[Column]:
        a = F.coalesce(F.col(f"`{arm}`"), F.lit(False))
        sides = {"tp": a & t, "fp": a & ~t, "fn": ~a & t, "tn": ~a & ~t}
        return [F.count(F.when(side, 1)).alias(f"{arm}_{n}") for n, side in sides.items()]

    summed = joined.agg(*[c for arm in arms for c in counts(arm)])
    rows = [F.struct(F.lit(arm).alias(name), *[F.col(f"`{arm}_{n}`").alias(n) for n in ("tp", "fp", "fn", "tn")]) for arm in arms]
    made = confusion_metrics(summed.select(F.inline(F.array(*rows))))
    return made.select(*[c for c in made.columns if c != name], name)


def per_class_metrics(pred: DataFrame, truth: DataFrame, iou: float = 0.3, key: str = "image_id") -> DataFrame:
    """Box metrics per class; predictions and truth (key, class, ...) match within an image and class."""
    matched = match_predictions(pred, truth, iou, [key, "class"])
    found = matched.groupBy("class").agg(F.count("truth_seq").alias("tp"), F.count("*").alias("_pred"))
    wanted = truth.groupBy("class").agg(F.count("*").alias("_truth"))
    tp = F.coalesce("tp", F.lit(0))
    counts = found.join(wanted, "class", "full").select(
        "class",
        tp.alias("tp"),
        (F.coalesce("_pred", F.lit(0)) - tp).alias("fp"),
        (F.coalesce("_truth", F.lit(0)) - tp).alias("fn"),
        F.lit(0).cast("long").alias("tn"),
    )
    return confusion_metrics(counts)


def floor_of(confidence: Column, floors: Sequence[float]) -> Column:
    """The largest floor not above a confidence; null below all of them."""
    levels = sorted((float(f) for f in floors), reverse=True)
    decision = F.when(confidence >= levels[0], F.lit(levels[0]))
    for level in levels[1:]:
        decision = decision.when(confidence >= level, F.lit(level))
    return decision


def at_or_above(histogram: DataFrame, floors: Sequence[float], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts held per ``floor`` bucket to counts at or above every floor; the table is as small as the floor list."""
    groups = histogram.select(*keys).distinct() if keys else histogram.sparkSession.range(1)
    ladder = F.array(*[F.lit(float(f)) for f in floors])
    grid = groups.select(*keys, F.explode(ladder).alias("floor"))
    full = grid.join(histogram, [*keys, "floor"], "left")
    above = Window.partitionBy(*keys).orderBy(F.desc("floor")).rowsBetween(Window.unboundedPreceding, 0)
    return full.select(
        *keys, "floor", *[F.coalesce(F.sum(c).over(above), F.lit(0)).cast("long").alias(c) for c in columns]
    )


def confidence_sweep(
    pred: DataFrame, truth: DataFrame, images: DataFrame, floors: Sequence[float], iou: float = 0.3, key: str = "image_id"
) -> DataFrame:
    """Box- and image-level metrics per confidence floor from one matching run.

    A floor keeps a prefix of the confidence order, and greedy claims never depend on weaker predictions, so the claims
    of the lowest floor hold for all floors; each prediction is counted once in the bucket of the largest floor it
    meets, and the buckets are summed from the top.
    """
    kept = pred.filter(F.col("confidence") >= float(min(floors)))
    matched = match_predictions(kept, truth, iou, [key])
    boxes = matched.groupBy(floor_of(F.col("confidence"), floors).alias("floor")).agg(
        F.count("truth_seq").alias("box_tp"), F.count("*").alias("_pred")
    )
    boxes = at_or_above(boxes, floors, [], ["box_tp", "_pred"])
    peaks = kept.groupBy(key).agg(F.max("confidence").alias("_peak"))
    wanted = truth.select(key).distinct().withColumn("_truth", F.lit(True))
    flags = images.select(key).join(wanted, key, "left").join(peaks, key, "left")
    should = F.col("_truth").isNotNull()
    # Images without an alarm are the row without a floor, so one pass over the images serves alarms and totals.
    sides = flags.groupBy(floor_of(F.col("_peak"), floors).alias("floor")).agg(
        F.count(F.when(should, 1)).alias("img_tp"), F.count(F.when(~should, 1)).alias("img_fp")
    )
    sides = cut_lineage(sides)
    alarmed = at_or_above(sides.filter("floor IS NOT NULL"), floors, [], ["img_tp", "img_fp"])
    table = boxes.join(alarmed, "floor")
    table = attach_totals(table, sides, [], {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in (("_pos", "img_tp"), ("_neg", "img_fp"))})
    table = attach_totals(table, truth, [], {"_truths": F.count("*")})
    box = rates(F.col("box_tp"), F.col("box_fp"), F.col("box_fn"), F.lit(0))
    img = rates(F.col("img_tp"), F.col("img_fp"), F.col("img_fn"), F.col("img_tn"))
    return (
        table.withColumn("box_fp", F.col("_pred") - F.col("box_tp"))
        .withColumn("box_fn", F.col("_truths") - F.col("box_tp"))
        .withColumn("img_fn", F.col("_pos") - F.col("img_tp"))
        .withColumn("img_tn", F.col("_neg") - F.col("img_fp"))
        .select(
            "floor",
            "box_tp",
            "box_fp",
            "box_fn",
            *[box[n].alias(f"box_{n}") for n in ("precision", "recall", "f1", "f2")],
            "img_tp",
            "img_fp",
            "img_fn",
            "img_tn",
            *[img[n].alias(f"img_{n}") for n in ("precision", "recall", "f2", "false_alarm_rate")],
        )
    )


def attach_totals(table: DataFrame, source: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add aggregates of ``source`` to every row of a small table: per group by a join, overall by a scalar subquery."""
    if by:
        return table.join(source.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()]), list(by))
    whole = source.agg(F.struct(*[c.alias(n) for n, c in totals.items()])).scalar()
    return table.withColumn("_totals", whole).select(*table.columns, *[F.col(f"_totals.{n}").alias(n) for n in totals])


# Frames of event-relative sequences.


def detection_alarms(det: DataFrame, floor: float, keys: Sequence[str]) -> DataFrame:
    """Per frame with any detection at or above the floor: the number of them (the unvalidated arm)."""
    return (
        det.filter(F.col("confidence") >= floor).groupBy(*keys).agg(F.count("*").alias("alerts"))
    )


def event_alarms(annotated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per configuration and frame with any confirmed event: the number of them (the validated arm)."""
    return (
        annotated.filter(F.col("rejected_by").isNull())
        .groupBy("config_id", *keys)
        .agg(F.count("*").alias("alerts"))
    )


def frame_alarms(frames: DataFrame, alarms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every frame with its alarm flag; frames without an alarm are kept."""
    joined = frames.join(alarms, list(keys), "left")
    return joined.withColumn("alerts", F.coalesce("alerts", F.lit(0))).withColumn("alarmed", F.col("alerts") > 0)


def median_upper(value: str) -> Column:
    """Aggregate: the element n // 2 of the ascending order. It keeps one counter per distinct value, which is bounded
    for alert delays in whole sampling steps; ``medians.exact_medians`` serves unbounded values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def event_sides(columns: Sequence[str]) -> tuple[Column, Column]:
    """Which frames count as before and as after the event. With a ``role`` column ("negative" or "positive" set), only
    negative sequences count towards false alarms and only positive ones towards detection."""
    before = F.col("offset") < 0
    if "role" not in columns:
        return before, ~before
    return before & (F.col("role") == "negative"), ~before & (F.col("role") == "positive")


def sequence_metrics(
    frames: DataFrame,
    alarms: DataFrame,
    *,
    sequence: Sequence[str],
    by: Sequence[str] = (),
    detected: str = "any_after",
    config_ids: Sequence[str] | None = None,
) -> DataFrame:
    """False-alarm rate before the event, detection rate after it, and minutes to the first alert.

    ``frames``: by, sequence, offset. ``alarms``: config_id, by, sequence, offset, alerts for alarmed frames only, so
    silent frames are counted once and not once per configuration. ``detected`` "any_after": some alarm has a positive
    offset; "first_ever": the first alarm of all has one, so an early false alarm hides the detection.
    ``config_ids`` also reports configurations that never alarmed. Frames and alarms may both carry ``role``, see
    ``event_sides``; all sequences then still run through the cascade from their first frame.
    """
    if detected not in ("any_after", "first_ever"):
        raise ValueError(f"unknown detection rule {detected!r}")
    by, sequence = list(by), list(sequence)
    before, after = event_sides(frames.columns)
    wanted = (F.col("role") == "positive") if "role" in frames.columns else F.lit(True)
    per_sequence = frames.groupBy(*by, *sequence).agg(
        F.count("*").alias("frames"),
        F.count(F.when(before, 1)).alias("pre_frames"),
        F.count(F.when(after, 1)).alias("post_frames"),
        F.max(wanted).alias("_wanted"),
    )
    totals = {
        "total_sequences": F.count(F.when(F.col("_wanted"), 1)),
        "frames": F.sum("frames"),
        "pre_frames": F.sum("pre_frames"),
        "post_frames": F.sum("post_frames"),
    }
    seen = alarms.groupBy("config_id", *by, *sequence).agg(
        F.count(F.when(before, 1)).alias("alarmed_pre"),
        F.count(F.when(after, 1)).alias("alarmed_post"),
        F.coalesce(F.sum(F.when(before, F.col("alerts"))), F.lit(0)).alias("alerts_pre"),
        F.coalesce(F.sum(F.when(after, F.col("alerts"))), F.lit(0)).alias("alerts_post"),
        F.min(F.when(wanted, F.col("offset"))).alias("first_alert"),
        F.min(F.when(after & (F.col("offset") > 0), F.col("offset"))).alias("first_after"),
    )
    first = F.col("first_after") if detected == "any_after" else F.when(F.col("first_alert") > 0, F.col("first_alert"))
    summed = (
        seen.withColumn("_minutes", first / 60.0)
        .groupBy("config_id", *by)
        .agg(
            *[F.sum(c).alias(c) for c in ("alarmed_pre", "alarmed_post", "alerts_pre", "alerts_post")],
            F.count("_minutes").alias("sequences_detected"),
            median_upper("_minutes").alias("median_minutes_to_detect"),
        )
    )
    if config_ids is not None:
        groups = frames.select(*by).distinct() if by else frames.sparkSession.range(1)
        ids = F.array(*[F.lit(i) for i in config_ids])
        summed = (
            groups.select(*by, F.explode(ids).alias("config_id"))
            .join(summed, [*by, "config_id"], "left")
            .fillna(0, ["alarmed_pre", "alarmed_post", "alerts_pre", "alerts_post", "sequences_detected"])
        )
    joined = attach_totals(summed, per_sequence, by, totals)
    return joined.select(
        "config_id",
        *by,
        "frames",
        "pre_frames",
        "post_frames",
        F.when(F.col("pre_frames") > 0, F.col("alarmed_pre") / F.col("pre_frames")).alias("false_alarm_rate"),
        F.when(F.col("post_frames") > 0, F.col("alarmed_post") / F.col("post_frames")).alias("detection_rate"),
        "sequences_detected",
        "total_sequences",
        "alerts_pre",
        "alerts_post",
        (F.col("alerts_pre") + F.col("alerts_post")).alias("alerts"),
        "median_minutes_to_detect",
    )


# Pixels.


def segmentation_metrics(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pooled over images: ``counts`` holds tp, fp, fn, tn pixels per image."""
    pooled = counts.groupBy(*keys).agg(
        F.count("*").alias("images"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return pooled.select(
        *keys,
        "images",
        safe_ratio(tp, tp + fp + fn).alias("water_iou"),
        precision.alias("precision"),
        recall.alias("recall"),
        safe_ratio(2 * precision * recall, precision + recall).alias("f1"),
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("pixel_accuracy"),
    )


def stratified_iou(counts: DataFrame, flag: str) -> DataFrame:
    """IoU over every image and over the flagged subset alone, side by side."""
    flagged = F.col(flag)
    hit, any_ = F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")
    return counts.agg(
        F.count("*").alias("images"),
        F.count(F.when(flagged, 1)).alias("flagged_images"),
        safe_ratio(F.sum(hit), F.sum(any_)).alias("pooled_iou"),
        safe_ratio(
            F.coalesce(F.sum(F.when(flagged, hit)), F.lit(0)), F.coalesce(F.sum(F.when(flagged, any_)), F.lit(0))
        ).alias("flagged_iou"),
    )


def accuracy_by_class(pred: DataFrame) -> DataFrame:
    """(truth, predicted) to accuracy per true class and, under class null, overall."""
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    return pred.rollup("truth").agg(F.count("*").alias("total"), F.sum(hit).cast("long").alias("correct"), F.avg(hit).alias("accuracy"))


def interval_table(counts: DataFrame, z: float = 1.96) -> DataFrame:
    """Proportions (name, k, n) with their Wilson intervals."""
    bounded = counts.withColumn("_w", wilson(F.col("k"), F.col("n"), z))
    return bounded.select(
        *counts.columns,
        safe_ratio(F.col("k"), F.col("n")).alias("share"),
        F.col("_w.lo").alias("lo"),
        F.col("_w.hi").alias("hi"),
    )


def mask_value_share(histogram: DataFrame, labels: DataFrame) -> DataFrame:
    """(value, pixels) to totals and shares, with label, water flag and whether the value is documented at all."""
    totals = histogram.groupBy("value").agg(F.sum("pixels").alias("pixels"))
    whole = totals.agg(F.sum("pixels")).scalar()
    return (
        totals.join(labels, "value", "left")
        .select(
            "value",
            "pixels",
            safe_ratio(F.col("pixels"), whole).alias("share"),
            "name",
            F.coalesce("is_water", F.lit(False)).alias("is_water"),
            F.col("name").isNotNull().alias("is_known"),
        )
    )
