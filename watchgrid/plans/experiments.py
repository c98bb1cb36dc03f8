"""Evaluation jobs: many configurations over the same detections, read and shuffled once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.operators import metrics, reports
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.operators.detect import grey_enough, grey_fractions, passes_grey
from watchgrid.operators.overlap import merge_tiles
from watchgrid.operators.sampling import camera_folds
from watchgrid.operators.validator import validate
from watchgrid.session import cut_lineage

#: The floors a threshold search walks through.
SWEEP_FLOORS = [step / 100 for step in range(20, 96)]
RAW = "raw"



def replay(
    det: DataFrame, frames: DataFrame | None, configs: Sequence[ValidatorConfig], keys: Sequence[str], **options
) -> DataFrame:
    """All configurations over one ordered pass; the sequence is part of the key, so no state crosses sequences."""
    return validate(det, configs, frames, keys=keys, **options)


def arms(
    det: DataFrame,
    frames: DataFrame,
    configs: Sequence[ValidatorConfig],
    keys: Sequence[str],
    raw_floor: float | None = 0.20,
    by: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(alarms per configuration and alarmed frame, annotated detections). The raw arm keeps its own fixed floor
    whatever the configurations say. Detections must carry ``offset`` (and ``by``)."""
    role = ["role"] if "role" in det.columns else []
    annotated = replay(det, None, configs, keys, carry=["offset", *by, *role], **options)
    frame = [*by, *keys, *role, "frame_index", "offset"]
    alarms = metrics.event_alarms(annotated, frame)
    if raw_floor is not None:
        raw = metrics.detection_alarms(det, raw_floor, frame).withColumn("config_id", F.lit(RAW))
        alarms = alarms.unionByName(raw)
    return alarms, annotated


def ablation_configs(floor: float = 0.20) -> list[ValidatorConfig]:
    base = ValidatorConfig(min_confidence=floor, min_frames=3, enable_cooldown=False)
    rows = [base.with_(config_id=f"persistence_{n}", min_frames=n) for n in (2, 3, 4, 5)]
    rows.append(base.with_(config_id="minus_confidence", enable_confidence=False))
    rows.append(base.with_(config_id="minus_persistence", enable_persistence=False))
    rows.append(base.with_(config_id="low_confidence_association", low_confidence_association=True))
    return rows


def ablation(
    det: DataFrame, frames: DataFrame, keys: Sequence[str], floor: float = 0.20, by: Sequence[str] = (), **options
) -> DataFrame:
    """Raw detector against the cascade, level by level; the false-alarm reduction is relative to the raw arm."""
    configs = ablation_configs(floor)
    alarms, _ = arms(det, frames, configs, keys, by=by, **options)
    table = metrics.sequence_metrics(
        frames, alarms, sequence=keys, by=by, config_ids=[RAW, *[c.config_id for c in configs]]
    )
    # One row per configuration and group by now, so the raw row can be looked up in a window.
    raw = F.max(F.when(F.col("config_id") == RAW, F.col("false_alarm_rate"))).over(Window.partitionBy(*by))
    return table.withColumn("far_reduction", F.when(raw > 0, 1 - F.col("false_alarm_rate") / raw))


def sequence_evaluation(
    det: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    floor: float = 0.20,
    min_frames: Sequence[int] = (2, 3, 4),
    cooldown: bool = False,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, level statistics) of the raw detector and a persistence sweep. Here a sequence counts as detected
    only if its first alarm of all comes after the event."""
    configs = [
        ValidatorConfig(f"persistence_{n}", None, min_confidence=floor, min_frames=n, enable_cooldown=cooldown, cooldown_seconds=600.0)
        for n in min_frames
    ]
    alarms, annotated = arms(det, frames, configs, keys, raw_floor=floor, **options)
    ids = [RAW, *[c.config_id for c in configs]]
    table = metrics.sequence_metrics(frames, alarms, sequence=keys, detected="first_ever", config_ids=ids)
    return table, reports.level_stats(annotated)


def floor_sweep(
    det: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    floors: Sequence[float] = SWEEP_FLOORS,
    by: Sequence[str] = (),
) -> DataFrame:
    """The raw detector at every floor. Detections are reduced to one row per frame and then to one per (sequence,
    floor bucket) before any floor is expanded, so the size of the sweep never multiplies the data."""
    by, keys = list(by), list(keys)
    bucket = metrics.floor_of(F.col("confidence"), floors)
    kept = det.filter(F.col("confidence") >= float(min(floors)))
    alerts = metrics.at_or_above(
        kept.groupBy(*by, bucket.alias("floor")).agg(F.count("*").alias("alerts")), floors, by, ["alerts"]
    )
    before, after = metrics.event_sides(frames.columns)
    role = ["role"] if "role" in det.columns else []
    peaks = kept.groupBy(*by, *keys, *role, "frame_index", "offset").agg(F.max("confidence").alias("_peak"))
    peaks = peaks.withColumn("floor", metrics.floor_of(F.col("_peak"), floors))
    per_sequence = peaks.groupBy(*by, *keys, "floor").agg(
        F.count(F.when(before, 1)).alias("alarmed_pre"),
        F.count(F.when(after, 1)).alias("alarmed_post"),
        F.min(F.when(after & (F.col("offset") > 0), F.col("offset"))).alias("_first"),
    )
    frames_alarmed = metrics.at_or_above(
        per_sequence.groupBy(*by, "floor").agg(*[F.sum(c).alias(c) for c in ("alarmed_pre", "alarmed_post")]),
        floors,
        by,
        ["alarmed_pre", "alarmed_post"],
    )
    # A sequence's first alert at a floor is the earliest over all stronger buckets. It holds from a bucket's floor down to
    # the next weaker bucket, so a sequence has at most one row per floor and none is merged again.
    ladder = F.array(*[F.lit(float(f)) for f in floors])
    stronger = Window.partitionBy(*by, *keys).orderBy(F.desc("floor"))
    weaker = F.coalesce(F.lead("floor").over(stronger), F.lit(float("-inf")))
    earliest = F.min("_first").over(stronger.rowsBetween(Window.unboundedPreceding, 0))
    firsts = (
        per_sequence.filter(F.col("_first").isNotNull())
        .select(*by, *keys, "floor", weaker.alias("_weaker"), (earliest / 60.0).alias("_minutes"))
        .withColumn("floor", F.explode(F.filter(ladder, lambda f: (f <= F.col("floor")) & (f > F.col("_weaker")))))
        .groupBy(*by, "floor")
        .agg(F.count("*").alias("sequences_detected"), metrics.median_upper("_minutes").alias("median_minutes_to_detect"))
    )
    joined = frames_alarmed.join(alerts, [*by, "floor"]).join(firsts, [*by, "floor"], "left")
    joined = metrics.attach_totals(
        joined, frames, by, {"pre_frames": F.count(F.when(before, 1)), "post_frames": F.count(F.when(after, 1))}
    )
    pre, post = F.col("pre_frames"), F.col("post_frames")
    return joined.select(
        *by,
        "floor",
        F.when(pre > 0, F.col("alarmed_pre") / pre).alias("false_alarm_rate"),
        F.when(post > 0, F.col("alarmed_post") / post).alias("detection_rate"),
        F.coalesce("sequences_detected", F.lit(0)).alias("sequences_detected"),
        "alerts",
        "median_minutes_to_detect",
    )


def match_operating_point(sweep: DataFrame, targets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per target the lowest floor whose rounded false-alarm rate is no worse; null when no floor gets there.
    ``targets``: by, target_far."""
    reached = F.bround("false_alarm_rate", 4) <= F.col("target_far")
    if not by:
        # All floors as one array, a scalar to the targets.
        points = sweep.agg(F.collect_list(F.struct("false_alarm_rate", "floor"))).scalar()
        listed = targets.withColumn("_points", points).select("target_far", F.explode_outer("_points").alias("_p"))
        joined = listed.select("target_far", "_p.*")
    else:
        joined = targets.join(sweep, list(by), "left")
    floor = F.min(F.when(reached, F.col("floor")))
    return joined.groupBy(*by, "target_far").agg(floor.alias("matched_floor"))


def threshold_matched(det: DataFrame, frames: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """Can a raised floor alone reach the cascade's false-alarm rate? The sweep, with the matched floor marked."""
    cascade = ValidatorConfig("cascade", min_confidence=0.20, min_frames=3, enable_cooldown=False)
    alarms, _ = arms(det, frames, [cascade], keys, raw_floor=None, **options)
    reference = metrics.sequence_metrics(frames, alarms, sequence=keys, config_ids=["cascade"])
    target = reference.select(F.bround("false_alarm_rate", 4).alias("target_far"))
    sweep = cut_lineage(floor_sweep(det, frames, keys))
    found = match_operating_point(sweep, target).agg(F.struct(F.max("target_far").alias("far"), F.max("matched_floor").alias("floor"))).scalar()
    return sweep.withColumn("_found", found).select(
        *sweep.columns,
        F.col("_found.far").alias("target_far"),
        F.coalesce(F.col("floor") == F.col("_found.floor"), F.lit(False)).alias("is_matched"),
    )


def threshold_transfer(
    det: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    target_far: float = 0.010,
    camera: str = "camera_id",
    fallback: float = 0.95,
    chunk: Column | None = None,
    **options,
) -> DataFrame:
    """Tune a floor on one half of the cameras, apply it to the other, both ways, against the untuned cascade. ``chunk``
    cuts the order of very many cameras (see ``camera_folds``)."""
    folds = cut_lineage(camera_folds(frames, chunk, camera))
    det, frames = det.join(folds, camera), frames.join(folds, camera)
    sweep = cut_lineage(floor_sweep(det, frames, keys, by=["fold"]))
    targets = folds.select("fold").distinct().withColumn("target_far", F.lit(float(target_far)))
    tuned = match_operating_point(sweep, targets, ["fold"]).select(
        "fold", F.coalesce("matched_floor", F.lit(fallback)).alias("floor")
    )
    at_floor = sweep.select("fold", "floor", "false_alarm_rate", "detection_rate")
    own = tuned.join(at_floor, ["fold", "floor"])
    cascade = ValidatorConfig("cascade", min_confidence=0.20, min_frames=3, enable_cooldown=False)
    alarms, _ = arms(det, frames, [cascade], keys, raw_floor=None, by=["fold"], **options)
    validated = metrics.sequence_metrics(frames, alarms, sequence=keys, by=["fold"], config_ids=["cascade"])
    other = F.when(F.col("fold") == "A", "B").otherwise("A")
    train = own.select(
        F.col("fold").alias("train_fold"),
        other.alias("fold"),
        F.col("floor").alias("tuned_floor"),
        F.col("false_alarm_rate").alias("far_on_train"),
    )
    transferred = train.join(
        at_floor.select(
            "fold",
            F.col("floor").alias("tuned_floor"),
            F.col("false_alarm_rate").alias("transfer_far"),
            F.col("detection_rate").alias("transfer_recall"),
        ),
        ["fold", "tuned_floor"],
    )
    oracle = own.select("fold", F.col("floor").alias("oracle_floor"), F.col("false_alarm_rate").alias("oracle_far"))
    judged = validated.select(
        "fold", F.col("false_alarm_rate").alias("cascade_far"), F.col("detection_rate").alias("cascade_recall")
    )
    sizes = folds.groupBy("fold").agg(F.count("*").alias("test_cameras"))
    return (
        transferred.join(oracle, "fold")
        .join(judged, "fold")
        .join(sizes, "fold")
        .select(
            F.concat("train_fold", F.lit("->"), "fold").alias("direction"),
            "tuned_floor",
            "far_on_train",
            "transfer_far",
            "transfer_recall",
            "oracle_floor",
            "oracle_far",
            "cascade_far",
            "cascade_recall",
            "test_cameras",
        )
    )


def transfer_verdict(directions: DataFrame) -> DataFrame:
    """Mean drift of both arms and which one holds on unseen cameras."""
    mean = directions.agg(
        F.avg("transfer_far").alias("mean_transfer_far"), F.avg("cascade_far").alias("mean_cascade_far")
    )
    drifts = F.col("mean_transfer_far") > F.col("mean_cascade_far") + 1e-9
    return mean.withColumn("cascade_holds_better", drifts)


def multi_hazard(
    det: DataFrame, configs: Sequence[ValidatorConfig], raw_floor: float = 0.25, keys: Sequence[str] = ("camera_id", "hazard"), **options
) -> tuple[DataFrame, DataFrame]:
    """One validator over several hazards that differ only in configuration rows: (suppression per hazard against the
    raw arm at its own floor, level statistics per hazard)."""
    hazards = [c.hazard for c in configs]
    kept = det.filter(F.col("hazard").isin(hazards))
    annotated = validate(kept, configs, keys=keys, **options)
    table = reports.suppression_between(reports.raw_arm(kept, raw_floor), annotated)
    return table, reports.level_stats(annotated, ["hazard"])


def sliced_vs_full(
    full: DataFrame,
    tiles: DataFrame,
    truth: DataFrame,
    images: DataFrame,
    floors: Sequence[float] = (0.3, 0.5),
    key: str = "image_id",
) -> DataFrame:
    """Metrics of full-frame detections against full frame and tiles merged, per floor."""
    merged = cut_lineage(merge_tiles(full, tiles, 0.5, [key]))
    arms_ = {"baseline": full.select(key, "det_seq", "confidence", "box"), "sliced": merged}
    parts = [
        metrics.confidence_sweep(rows, truth, images, floors, 0.3, key).withColumn("mode", F.lit(mode))
        for mode, rows in arms_.items()
    ]
    return parts[0].unionByName(parts[1])


def colour_prior_stills(
    det: DataFrame,
    pixels: DataFrame,
    truth: DataFrame,
    images: DataFrame,
    cutoffs: Sequence[int] = (40, 60, 80, 100, 120),
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Image-level confusion with and without a prior on achromatic boxes, per saturation cut."""
    shares = grey_fractions(det, pixels, cutoffs, keys=tuple(keys))
    # An image passes a cut if any of its boxes does, so one row per image serves every cut.
    passed = shares.groupBy(*keys).agg(*[F.max(grey_enough(cut)).alias(f"S<={cut}") for cut in cutoffs])
    alarmed = det.select(*keys).distinct().withColumn("colour off", F.lit(True)).join(passed, list(keys), "left")
    return metrics.image_confusions(alarmed, truth, images, keys, ["colour off", *[f"S<={cut}" for cut in cutoffs]], "prior")


def colour_prior_sequences(
    det: DataFrame,
    pixels: DataFrame,
    frames: DataFrame,
    cutoffs: Sequence[int] = (40, 60, 80, 100, 120),
    keys: Sequence[str] = ("camera_id", "hazard"),
    **options,
) -> DataFrame:
    """The same prior in front of the cascade, judged on event-relative sequences. ``det`` and ``frames`` must be
    numbered densely (``frame_no``), since the prior empties frames that still count."""
    config = ValidatorConfig("cascade", min_confidence=0.20, min_frames=3, enable_cooldown=False)
    arms_: list[tuple[str, DataFrame]] = [("colour off", det)]
    box_keys = (*keys, "frame_index")
    shares = cut_lineage(grey_fractions(det, pixels, cutoffs, keys=box_keys))
    arms_ += [(f"S<={cut}", passes_grey(det, shares, cut, keys=box_keys)) for cut in cutoffs]
    out = None
    for name, rows in arms_:
        alarms, _ = arms(rows, frames, [config], keys, raw_floor=None, **options)
        table = metrics.sequence_metrics(frames, alarms, sequence=keys, config_ids=["cascade"])
        table = table.withColumn("prior", F.lit(name))
        out = table if out is None else out.unionByName(table)
    return out


# Audits.

TOLERANCE = 5e-4


def verify_claims(claims: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Claims (model, figure, file, path, claimed) and facts (file, path, value) held against each other, whole on both
    sides: every claim has a status, and so has every fact that no claim cites (``unclaimed``, model and figure null).

    A cited file of which there is no fact at all is ``file_absent``; a file that is there without the cited path is
    ``path_absent``; a path whose value is null or no number is ``absent_from_results``."""
    files = facts.filter("file IS NOT NULL").select("file").distinct().withColumn("_there", F.lit(True))
    known = facts.select("file", "path", F.expr("try_cast(value AS double)").alias("value"), F.lit(True).alias("_fact"))
    joined = claims.withColumn("_claim", F.lit(True)).join(known, ["file", "path"], "full").join(files, "file", "left")
    off = F.abs(F.col("claimed") - F.col("value")) > tolerance
    status = (
        F.when(F.col("_claim").isNull(), "unclaimed")
        .when(F.col("file").isNull(), "no_source_cited")
        .when(F.col("claimed").isNull(), "absent_from_registry")
        .when(F.col("_there").isNull(), "file_absent")
        .when(F.col("_fact").isNull(), "path_absent")
        .when(F.col("value").isNull(), "absent_from_results")
        .when(off, "mismatch")
        .otherwise("ok")
    )
    return joined.select("model", "figure", "file", "path", "claimed", "value", status.alias("status"))


def audit_results(claims: DataFrame, facts: DataFrame, models: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """All failures: claims that do not match, facts that nobody claims, and measured models that cite no file or name no
    harness. ``models``: model, status, results_file, harness. ``file`` and ``path`` name what a claim or fact is about."""
    failed = verify_claims(claims, facts, tolerance).filter("status <> 'ok'").select("model", "figure", "file", "path", "status")
    measured = models.filter(F.col("status").isNotNull() & (F.col("status") != "not_yet_measured"))
    gaps = measured.select(
        "model",
        *[F.lit(None).cast("string").alias(c) for c in ("figure", "file", "path")],
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce("results_file", F.lit("")) == "", "cites_no_results_file"),
                    F.when(F.coalesce("harness", F.lit("")) == "", "names_no_harness"),
                )
            )
        ).alias("status"),
    )
    return failed.unionByName(gaps)


def gauge_validation(coverage: DataFrame, gauge: DataFrame, keys: Sequence[str], tolerance: float = 1800.0, **options) -> DataFrame:
    """Correlation of segmented coverage with the nearest measured gauge height, per site."""
    from watchgrid.operators.series import nearest_join, paired_corr

    paired = nearest_join(coverage, gauge, tolerance, keys, **options).filter(F.col("nearest").isNotNull())
    return paired_corr(paired.withColumn("height", F.col("nearest.height")), "area_fraction", "height", keys)


def proportion_counts(metric_counts: DataFrame) -> DataFrame:
    """(name, tp, fp, fn, tn) to the proportions an interval table reports: (name, measure, k, n)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = F.array(
        F.struct(F.lit("precision").alias("measure"), tp.alias("k"), (tp + fp).alias("n")),
        F.struct(F.lit("recall").alias("measure"), tp.alias("k"), (tp + fn).alias("n")),
        F.struct(F.lit("false_alarm_rate").alias("measure"), fp.alias("k"), (fp + tn).alias("n")),
    )
    return metric_counts.select("name", F.inline(rows))
