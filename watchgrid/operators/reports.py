"""Reports over annotated detections and confirmed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.functions import geometry as geo
from watchgrid.functions.stats import safe_ratio
from watchgrid.operators.cascade import LEVELS
from watchgrid.operators.medians import exact_medians
from watchgrid.session import cut_lineage
from watchgrid.sources import dims


def level_stats(annotated: DataFrame, keys: Sequence[str] = ("config_id",)) -> DataFrame:
    """Per level: seen, passed, rejected and rejection rate. Each level sees what the one before passed."""
    reason = F.col("rejected_by")
    counts = annotated.groupBy(*keys).agg(
        F.count("*").alias("_all"), *[F.count(F.when(reason == level, 1)).alias(f"_{level}") for level in LEVELS]
    )
    remaining, rows = F.col("_all"), []
    for level in LEVELS:
        rejected = F.col(f"_{level}")
        rows.append(F.struct(F.lit(level).alias("level"), remaining.alias("seen"), rejected.alias("rejected")))
        remaining = remaining - rejected
    return counts.select(*keys, F.inline(F.array(*rows))).select(
        *keys,
        "level",
        "seen",
        (F.col("seen") - F.col("rejected")).alias("passed"),
        "rejected",
        safe_ratio(F.col("rejected"), F.col("seen")).alias("rejection_rate"),
    )


def _outcomes() -> list[Column]:
    reason = F.col("rejected_by")
    return [
        F.count("*").alias("proposed"),
        F.count(F.when(reason.isin("confidence", "persistence"), 1)).alias("filtered"),
        F.count(F.when(reason == "cooldown", 1)).alias("deduplicated"),
        F.count(F.when(reason.isNull(), 1)).alias("confirmed"),
    ]


def _outcome_rates(df: DataFrame) -> DataFrame:
    proposed = F.col("proposed")
    return df.withColumns(
        {
            "suppression_rate": F.when(proposed > 0, 1 - F.col("confirmed") / proposed).otherwise(F.lit(0.0)),
            "filtering_rate": safe_ratio(F.col("filtered"), proposed),
            "deduplication_rate": safe_ratio(F.col("deduplicated"), proposed),
        }
    )


def suppression(annotated: DataFrame, keys: Sequence[str] = ("config_id", "camera_id", "hazard"), totals: bool = False) -> DataFrame:
    """What became of proposals: not credible (filtered), repeats of a reported event (deduplicated), confirmed.
    ``totals`` adds the sub-totals of every leading part of ``keys``."""
    grouped = annotated.rollup(*keys) if totals else annotated.groupBy(*keys)
    return _outcome_rates(grouped.agg(*_outcomes()))


def suppression_shares(annotated: DataFrame, key: str = "hazard") -> DataFrame:
    """Filtered, deduplicated and confirmed as parts that sum to 1, per hazard and (key null) in total."""
    counted = annotated.rollup(key).agg(*_outcomes())
    return counted.filter("proposed > 0").select(
        key,
        "proposed",
        *[(F.col(c) / F.col("proposed")).alias(f"{c}_share") for c in ("filtered", "deduplicated", "confirmed")],
    )


def pipeline_report(frames: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per camera and, with hazard null, over all its hazards: frames, proposals and outcomes. ``frames`` holds one row
    per processed (camera_id, frame_index), once per hazard or once in all."""
    processed = frames.select("camera_id", "frame_index").distinct().groupBy("camera_id").agg(F.count("*").alias("frames"))
    by_hazard = annotated.groupingSets([["camera_id", "hazard"], ["camera_id"]], "camera_id", "hazard").agg(*_outcomes())
    silent = processed.select(
        "camera_id",
        F.lit(None).cast("string").alias("hazard"),
        *[F.lit(0).cast("long").alias(c) for c in ("proposed", "filtered", "deduplicated", "confirmed")],
    ).join(annotated.select("camera_id").distinct(), "camera_id", "left_anti")
    return _outcome_rates(by_hazard.unionByName(silent).join(processed, "camera_id"))


def suppression_between(raw_counts: DataFrame, annotated: DataFrame, keys: Sequence[str] = ("hazard",)) -> DataFrame:
    """``1 - events / raw`` between two arms that may use different floors. ``raw_counts``: keys, raw_detections."""
    events = annotated.filter(F.col("rejected_by").isNull()).groupBy(*keys).agg(F.count("*").alias("confirmed_events"))
    joined = raw_counts.join(events, list(keys), "left")
    confirmed = F.coalesce("confirmed_events", F.lit(0))
    return joined.select(
        *keys,
        "raw_detections",
        confirmed.alias("confirmed_events"),
        F.when(F.col("raw_detections") > 0, 1 - confirmed / F.col("raw_detections")).otherwise(F.lit(0.0)).alias("suppression"),
    )


def raw_arm(det: DataFrame, floor: float = 0.25, keys: Sequence[str] = ("hazard",)) -> DataFrame:
    """The unvalidated arm at its own floor: detections and frames with any."""
    kept = det.filter(F.col("confidence") >= floor)
    per_frame = kept.groupBy(*keys, "camera_id", "frame_index").agg(F.count("*").alias("_n"))
    return per_frame.groupBy(*keys).agg(
        F.sum("_n").alias("raw_detections"), F.count("*").alias("raw_frames_with_detection")
    )


# Clip analysis.


def probe_scores(hits: DataFrame) -> DataFrame:
    """How strongly each detector claims a clip: frames with hits times mean confidence.
    ``hits``: clip, hazard, frame_index, confidence, and coverage for water. Water counts a frame only above 5 %
    coverage, with coverage divided by its regions as the frame's single confidence."""
    water = F.col("hazard") == "flood"
    per_frame = hits.groupBy("clip", "hazard", "frame_index").agg(
        F.count("*").alias("_hits"),
        F.sum("confidence").alias("_sum"),
        F.max("confidence").alias("_max"),
        F.max("coverage").alias("_coverage"),
    )
    counted = per_frame.filter(~water | (F.col("_coverage") > 0.05))
    single = F.col("_coverage") / F.col("_hits")
    scored = counted.groupBy("clip", "hazard").agg(
        F.count("*").alias("frames_with_hits"),
        F.sum("_hits").alias("hits"),
        F.max(F.when(water, single).otherwise(F.col("_max"))).alias("best_confidence"),
        (
            F.sum(F.when(water, single).otherwise(F.col("_sum"))) / F.sum(F.when(water, F.lit(1)).otherwise(F.col("_hits")))
        ).alias("mean_confidence"),
    )
    ranked = scored.withColumn("score", F.col("frames_with_hits") * F.col("mean_confidence"))
    order = Window.partitionBy("clip").orderBy(F.desc("score"), "hazard")
    return ranked.withColumn("rank", F.row_number().over(order))


def route_clip(frame_probs: DataFrame, known: Sequence[str] = ("fire", "flood", "drowning", "building_access")) -> DataFrame:
    """Mean probability per class over a clip's sampled frames, ranked; the best known class is suggested. A class the
    classifier does not know is offered last and unranked. ``frame_probs``: clip, class, probability."""
    mean = frame_probs.filter(F.col("class").isin(list(known))).groupBy("clip", "class").agg(
        F.avg("probability").alias("certainty")
    )
    order = Window.partitionBy("clip").orderBy(F.desc("certainty"), "class")
    ranked = mean.withColumn("rank", F.row_number().over(order)).withColumn("suggested", F.col("rank") == 1)
    clips = frame_probs.select("clip").distinct()
    unranked = clips.select(
        "clip",
        F.explode(F.array(*[F.lit(h) for h in dims.HAZARDS if h not in known])).alias("class"),
        F.lit(None).cast("double").alias("certainty"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(False).alias("suggested"),
    )
    return ranked.unionByName(unranked)


def needs_choice(clips: DataFrame, routed: DataFrame) -> DataFrame:
    """Clips for which no class could be suggested; a person has to choose."""
    return clips.select("clip").distinct().join(routed.filter("suggested").select("clip"), "clip", "left_anti")


def clip_report(frames: DataFrame, annotated: DataFrame, events: DataFrame, key: str = "camera_id") -> DataFrame:
    """Per clip: frames examined, proposals by outcome. Findings are kept apart (``clip_findings``) because a long clip
    may hold any number of them."""
    examined = frames.groupBy(key).agg(F.count("*").alias("frames_examined"))
    outcome = annotated.groupBy(key).agg(*_outcomes())
    del events
    return examined.join(outcome, key, "left").fillna(0, ["proposed", "filtered", "deduplicated", "confirmed"])


def clip_findings(events: DataFrame, frames: DataFrame, key: str = "camera_id") -> DataFrame:
    """Confirmed events with boxes as shares of the frame. ``frames``: key, frame_index, width, height."""
    sized = frames.select(key, F.col("frame_index").alias("confirmed_frame"), "width", "height")
    box = geo.normalise(geo.box_of(), F.col("width"), F.col("height"))
    return (
        events.join(sized, [key, "confirmed_frame"])
        .withColumn("_box", box)
        .select(
            key,
            "hazard",
            "confirmed_frame",
            F.col("confirmed_time").alias("seconds"),
            "confidence",
            F.col("supporting_detections").alias("supporting"),
            *[F.col(f"_box.{c}").alias(f"n{c}") for c in ("x1", "y1", "x2", "y2")],
        )
    )


def best_frame(frame_counts: DataFrame, keys: Sequence[str] = ("clip",)) -> DataFrame:
    """The frame with the most events or detections; the first of equals."""
    best = F.max_by(F.struct("frame_index", "n"), F.struct(F.col("n"), -F.col("frame_index")))
    return frame_counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def usable_clips(manifest: DataFrame) -> DataFrame:
    """Clips fit to demonstrate on: publishable, truly sequential and not for reference only."""
    return manifest.withColumn("demo_ready", F.col("publishable") & F.col("temporal") & ~F.col("reference_only"))


def uncovered_hazards(manifest: DataFrame) -> DataFrame:
    """Hazards with footage but none that may be published."""
    # One row per hazard before the sides are compared: clips, not hazards, would be held in memory otherwise.
    sides = manifest.groupBy("hazard").agg(F.max(~F.col("reference_only")).alias("_wanted"), F.max("publishable").alias("_published"))
    return sides.filter(F.col("_wanted") & ~F.coalesce("_published", F.lit(False))).select("hazard")


def coverage_gaps(emitted_people: DataFrame, context_hazards: DataFrame) -> DataFrame:
    """Person labels a detector emits that no redaction covers, and contexts that map to no hazard."""
    spark = emitted_people.sparkSession
    redacted = spark.createDataFrame([(label,) for label in dims.PERSON_LABELS], "label string")
    unredacted = emitted_people.select("label").distinct().join(F.broadcast(redacted), "label", "left_anti")
    idle = context_hazards.filter(F.size("context_hazards") == 0).select("context")
    return unredacted.select(F.lit("unredacted_label").alias("gap"), F.col("label").alias("name")).unionByName(
        idle.select(F.lit("context_without_hazard").alias("gap"), F.col("context").alias("name"))
    )


def far_recall_frontier(sweep: DataFrame) -> DataFrame:
    """Per achieved false-alarm rate the best recall and the lowest floor that reaches it."""
    best = F.max_by(F.struct("recall", "floor"), F.struct(F.col("recall"), -F.col("floor")))
    return sweep.groupBy("false_alarm_rate").agg(best.alias("_b")).select("false_alarm_rate", "_b.*")


def label_balance(images: DataFrame) -> DataFrame:
    """(image_id, camera_id, annotations) to image and distinct camera counts with and without labels."""
    positive = F.coalesce(F.length(F.trim("annotations")) > 0, F.lit(False))
    return images.agg(
        F.count("*").alias("images"),
        F.count(F.when(positive, 1)).alias("positives"),
        F.count(F.when(~positive, 1)).alias("negatives"),
        F.countDistinct(F.when(positive, F.col("camera_id"))).alias("positive_cameras"),
        F.countDistinct(F.when(~positive, F.col("camera_id"))).alias("negative_cameras"),
    )


def source_status(marked: DataFrame, cameras: DataFrame, as_of: Column, default_interval: float = 60.0) -> DataFrame:
    """Per camera: new frames, repeats skipped, last capture and its age in publisher intervals. ``marked`` carries
    ``is_repeat``; ``cameras``: camera_id, interval_seconds."""
    seen = marked.groupBy("camera_id").agg(
        F.count(F.when(~F.col("is_repeat"), 1)).alias("images_seen"),
        F.count(F.when(F.col("is_repeat"), 1)).alias("repeats_skipped"),
        F.max("ts").alias("last_capture"),
    )
    interval = F.coalesce(F.col("interval_seconds").cast("double"), F.lit(float(default_interval)))
    joined = cameras.select("camera_id", "interval_seconds").join(seen, "camera_id", "left")
    return joined.select(
        "camera_id",
        F.coalesce("images_seen", F.lit(0)).alias("images_seen"),
        F.coalesce("repeats_skipped", F.lit(0)).alias("repeats_skipped"),
        "last_capture",
        interval.alias("interval_seconds"),
        ((as_of - F.col("last_capture")) / interval).alias("intervals_behind"),
        F.coalesce((as_of - F.col("last_capture")) > interval, F.lit(True)).alias("stale"),
    )


def region_stability(regions: DataFrame) -> DataFrame:
    """Median regions per mask, median share of water in the largest region, and median overlap of the largest box
    from frame to frame. ``regions``: camera_id, frame_index, x1..y2, area."""
    per_frame = regions.groupBy("camera_id", "frame_index").agg(
        F.count("*").alias("_n"),
        (F.max("area") / F.sum("area")).alias("_largest"),
        F.max_by(geo.box_of(), F.struct("area", -F.col("y1"), -F.col("x1"))).alias("_box"),
    )
    per_frame = cut_lineage(per_frame)
    step = per_frame.withColumn("_next", F.col("frame_index") + 1)
    # The previous frame is an equi-join away, so no camera is ever sorted as a whole.
    pairs = per_frame.join(
        step.select("camera_id", F.col("_next").alias("frame_index"), F.col("_box").alias("_before")),
        ["camera_id", "frame_index"],
        "left",
    ).withColumn("_iou", geo.iou(F.col("_before"), F.col("_box")))
    measures = {
        "median_regions": F.col("_n").cast("double"),
        "median_largest_share": F.col("_largest"),
        "median_step_iou": F.when(F.col("_before").isNotNull(), F.col("_iou")),
    }
    # The medians read the measures several times; the join is run once.
    measured = cut_lineage(pairs.select(*[c.alias(n) for n, c in measures.items()]))
    listed = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures])
    middles = exact_medians(measured.select(F.inline(listed)), ["measure"], "value")
    named = [F.max(F.when(F.col("measure") == n, F.col("middle"))).alias(n) for n in measures]
    masks = F.max(F.when(F.col("measure") == "median_regions", F.col("n"))).alias("masks")
    return middles.agg(masks, *named)


def pair_by_stem(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """Images and masks that share a file stem, whatever folders and ``_lab`` / ``_mask`` endings they carry."""

    def stem(column: Column) -> Column:
        name = F.regexp_replace(F.regexp_extract(column, r"([^/]*)$", 1), r"\.[^.]*$", "")
        return F.regexp_replace(F.regexp_replace(name, "_lab", ""), "_mask", "")

    raw = F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    left = a.select(raw.alias("stem"), F.col(path).alias("image_path"))
    # One mask per stem; the alphabetically last stands for its copies.
    right = b.groupBy(stem(F.col(path)).alias("stem")).agg(F.max(path).alias("mask_path"))
    return left.join(right, "stem")


def with_empty_frames(frames: DataFrame, det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All frames with their detections; a frame without any keeps one row of nulls."""
    extra = [c for c in det.columns if c not in frames.columns or c in keys]
    return frames.join(det.select(*extra), list(keys), "left")


def running_track_stats(annotated: DataFrame) -> DataFrame:
    """Per sighting the track's mean and peak confidence so far, which the ordered pass has already kept."""
    return annotated.filter(F.col("track").isNotNull()).withColumnsRenamed(
        {"mean": "mean_confidence", "peak": "peak_confidence"}
    )


def first_alerts(alarms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the first alarmed offset and the first one after the event."""
    return alarms.groupBy(*keys).agg(
        F.min("offset").alias("first_alert"),
        F.min(F.when(F.col("offset") > 0, F.col("offset"))).alias("first_after_event"),
    )


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, keys: Sequence[str] = ("hazard",)) -> DataFrame:
    """Events per tumbling or sliding window of ``event_time``; works on tables and on streams alike."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return events.groupBy(*keys, window.alias("_w")).agg(F.count("*").alias("events"), F.max("confidence").alias("peak")).select(
        *keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "events", "peak"
    )


def event_sessions(
    events: DataFrame, gap: str = "6 hours", keys: Sequence[str] = ("hazard",), chunk: str = "1 day"
) -> DataFrame:
    """Events joined into sessions that end after ``gap`` without one; an event exactly ``gap`` later still belongs. A stream
    is handed to the engine's own session window, whose state is one open session per key and whose rule this is.

    On a table no key is brought together. Inside (key, ``chunk`` of time) events fall into runs; runs between a chunk's
    first and last are sessions already. First and last runs, two small rows per chunk, are put in order and merged over
    the borders, however many chunks a session spans or a pause skips."""
    keys = list(keys)
    if events.isStreaming:
        return events.groupBy(*keys, F.session_window("event_time", gap).alias("_w")).agg(F.count("*").alias("events")).select(
            *keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "events"
        )
    pause = F.expr(f"INTERVAL {gap}")

    def numbered(runs: DataFrame, by: list[str]) -> DataFrame:
        """Count up where a run begins more than ``gap`` behind the end of the one before."""
        order = Window.partitionBy(*by).orderBy("_start", "_last")
        fresh = F.coalesce(F.col("_start") > F.lag("_last").over(order) + pause, F.lit(True))
        return runs.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order))

    def merged(runs: DataFrame, by: list[str]) -> DataFrame:
        return runs.groupBy(*by, "_run").agg(F.min("_start").alias("_start"), F.max("_last").alias("_last"), F.sum("events").alias("events"))

    # Events of one instant are one row before anything is ordered; events without a time belong to no session.
    instants = events.filter("event_time IS NOT NULL").groupBy(*keys, "event_time").agg(F.count("*").alias("events"))
    single = instants.select(*keys, F.col("event_time").alias("_start"), F.col("event_time").alias("_last"), "events")
    placed = single.withColumn("_chunk", F.window("_start", chunk)["start"])
    runs = merged(numbered(placed, [*keys, "_chunk"]), [*keys, "_chunk"])
    ends = runs.withColumn("_runs", F.max("_run").over(Window.partitionBy(*keys, "_chunk")))
    at_border = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    closed = ends.filter(~at_border).select(*keys, "_start", "_last", "events")
    joined = merged(numbered(ends.filter(at_border).drop("_run", "_runs", "_chunk"), keys), keys)
    sessions = closed.unionByName(joined.drop("_run"))
    return sessions.select(*keys, F.col("_start").alias("window_start"), (F.col("_last") + pause).alias("window_end"), "events")
