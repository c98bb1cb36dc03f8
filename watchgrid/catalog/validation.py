"""Registered queries: the temporal cascade and reports over its output."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6, rounded
from watchgrid.operators import gate as gates
from watchgrid.operators import reports, series
from watchgrid.operators.cascade import DEFAULT_SETTINGS, ValidatorConfig, default_configs
from watchgrid.operators.validator import confidence_level, confirmed_events, validate
from watchgrid.session import cut_lineage
from watchgrid.sources import alerts

DEFAULTS = fx.cascade_configs()
_ANNOTATED = fx.cascade_sql(DEFAULTS)
_RATES = """
    CASE WHEN proposed > 0 THEN round(1 - confirmed / proposed, 6) ELSE 0.0 END AS suppression_rate,
    CASE WHEN proposed > 0 THEN round(filtered / proposed, 6) ELSE 0.0 END AS filtering_rate,
    CASE WHEN proposed > 0 THEN round(deduplicated / proposed, 6) ELSE 0.0 END AS deduplication_rate"""
_OUTCOMES = """count(*) AS proposed, count(*) FILTER (rejected_by IN ('confidence', 'persistence')) AS filtered,
    count(*) FILTER (rejected_by = 'cooldown') AS deduplicated, count(*) FILTER (rejected_by IS NULL) AS confirmed"""
_EVENTS = {
    "confirmed_rows": "SELECT * FROM annotated WHERE rejected_by IS NULL",
}


def cascade(sql: str, *names: str, configs=None, extra=None, source="detections", carry=()) -> str:
    ctes = _ANNOTATED if configs is None else fx.cascade_sql(configs, source, carry)
    return fx.with_ctes(sql, "detections", *names, extra={**ctes, **(extra or {})}, recursive=True)


def annotated(spark, sf_dir, configs=DEFAULTS):
    return validate(fx.stored_detections(spark, sf_dir), configs)


@query(
    "flagship_gated_suppression",
    fx.with_ctes(
        f"""SELECT camera_id, hazard, proposed, filtered, deduplicated, confirmed, {_RATES} FROM (
              SELECT camera_id, hazard, {_OUTCOMES} FROM annotated GROUP BY ROLLUP (camera_id, hazard))""",
        "detections",
        *fx.GATE,
        extra={
            "gated": "SELECT d.* FROM detections d SEMI JOIN gate g ON g.camera_id = d.camera_id AND g.hazard = d.hazard",
            **fx.cascade_sql(DEFAULTS, "gated"),
        },
        recursive=True,
    ),
)
def flagship(spark, sf_dir):
    gate_rows = cut_lineage(gates.gate(fx.cameras(spark, sf_dir)))
    kept = gates.gated(fx.stored_detections(spark, sf_dir), gate_rows)
    report = reports.suppression(validate(kept, DEFAULTS), ["camera_id", "hazard"], totals=True)
    return rounded(report, "suppression_rate", "filtering_rate", "deduplication_rate")


@query(
    "v01_confidence_level",
    fx.with_ctes(
        """SELECT camera_id, hazard, det_seq, CASE WHEN confidence < 0.2 THEN 'confidence' END AS rejected_by,
             confidence < 0.2 AND confidence >= 0.05 AS may_refresh FROM detections""",
        "detections",
    ),
)
def v01(spark, sf_dir):
    det = confidence_level(fx.raw_detections(spark, sf_dir), ValidatorConfig(min_confidence=0.20))
    return det.select("camera_id", "hazard", "det_seq", "rejected_by", "may_refresh")


_TRACKED = "SELECT camera_id, hazard, det_seq, frame_index, track, hits, round(peak, 6) AS peak, first_frame FROM annotated"


@query("v02_tracks", cascade(f"{_TRACKED} WHERE track IS NOT NULL"))
def v02(spark, sf_dir):
    rows = annotated(spark, sf_dir).filter("track IS NOT NULL")
    return rows.select("camera_id", "hazard", "det_seq", "frame_index", "track", "hits", r6("peak").alias("peak"), "first_frame")


ASSOCIATION = [
    ValidatorConfig("assoc", min_confidence=0.45, association_floor=0.10, low_confidence_association=True, max_misses=2, enable_cooldown=False)
]


@query(
    "v03_low_confidence_association",
    cascade(
        "SELECT camera_id, hazard, det_seq, rejected_by, track, hits, round(peak, 6) AS peak FROM annotated", configs=ASSOCIATION
    ),
)
def v03(spark, sf_dir):
    rows = annotated(spark, sf_dir, ASSOCIATION)
    return rows.select("camera_id", "hazard", "det_seq", "rejected_by", "track", "hits", r6("peak").alias("peak"))


@query(
    "v04_persistence_level",
    cascade(
        """SELECT hazard, hits, rejected_by = 'persistence' AS too_short, count(*) AS detections
           FROM (SELECT hazard, hits, coalesce(rejected_by, '') AS rejected_by FROM annotated WHERE hits IS NOT NULL) GROUP BY ALL"""
    ),
)
def v04(spark, sf_dir):
    tracked = annotated(spark, sf_dir).filter("hits IS NOT NULL")
    short = F.coalesce(F.col("rejected_by") == "persistence", F.lit(False))
    return tracked.groupBy("hazard", "hits", short.alias("too_short")).agg(F.count("*").alias("detections"))


@query(
    "v05_cooldown_level",
    cascade(
        """SELECT camera_id, hazard, det_seq, coalesce(rejected_by, '') = 'cooldown' AS cooling FROM annotated
           WHERE rejected_by IS NULL OR rejected_by = 'cooldown'"""
    ),
)
def v05(spark, sf_dir):
    reached = annotated(spark, sf_dir).filter("rejected_by IS NULL OR rejected_by = 'cooldown'")
    return reached.select("camera_id", "hazard", "det_seq", F.col("rejected_by").isNotNull().alias("cooling"))


@query(
    "v06_confirmed_events",
    cascade(
        """SELECT camera_id, hazard, round(peak, 6) AS confidence, first_frame AS first_seen_frame,
             frame_index AS confirmed_frame, hits AS supporting_detections, track AS track_id,
             frame_index - first_frame + 1 AS frames_to_confirm, round(ts - first_ts, 3) AS seconds_to_confirm
           FROM confirmed_rows""",
        extra=_EVENTS,
    ),
)
def v06(spark, sf_dir):
    events = confirmed_events(annotated(spark, sf_dir))
    return events.select(
        "camera_id", "hazard", r6("confidence").alias("confidence"), "first_seen_frame", "confirmed_frame",
        "supporting_detections", "track_id", "frames_to_confirm", F.round("seconds_to_confirm", 3).alias("seconds_to_confirm"),
    )


SWITCHES = [
    ValidatorConfig("all", cooldown_seconds=fx.COOLDOWN),
    ValidatorConfig("no_confidence", enable_confidence=False, cooldown_seconds=fx.COOLDOWN),
    ValidatorConfig("no_persistence", enable_persistence=False, cooldown_seconds=fx.COOLDOWN),
    ValidatorConfig("no_cooldown", enable_cooldown=False),
    ValidatorConfig("none", enable_confidence=False, enable_persistence=False, enable_cooldown=False),
]


@query(
    "v07_cascade_with_switchable_levels",
    cascade(
        "SELECT config_id, hazard, coalesce(rejected_by, 'confirmed') AS outcome, count(*) AS detections FROM annotated GROUP BY ALL",
        configs=SWITCHES,
    ),
)
def v07(spark, sf_dir):
    rows = annotated(spark, sf_dir, SWITCHES)
    outcome = F.coalesce("rejected_by", F.lit("confirmed"))
    return rows.groupBy("config_id", "hazard", outcome.alias("outcome")).agg(F.count("*").alias("detections"))


@query("v07_annotated_detections", cascade("SELECT camera_id, hazard, det_seq, rejected_by, track, hits FROM annotated"))
def v07_rows(spark, sf_dir):
    return annotated(spark, sf_dir).select("camera_id", "hazard", "det_seq", "rejected_by", "track", "hits")


@query(
    "v08_default_configs",
    fx.with_ctes(
        """SELECT hazard, min_confidence, min_frames, cooldown_seconds, count(*) AS detections,
             count(*) FILTER (confidence >= min_confidence) AS above_floor
           FROM detections JOIN (VALUES ('fire', 0.20, 3, 60.0), ('flood', 0.50, 2, 300.0), ('traffic', 0.25, 3, 60.0),
             ('drowning', 0.30, 3, 60.0), ('building_access', 0.20, 3, 60.0)) AS c(hazard, mc, min_frames, cs) USING (hazard),
             LATERAL (SELECT mc::DOUBLE AS min_confidence, cs::DOUBLE AS cooldown_seconds) GROUP BY ALL""",
        "detections",
    ),
)
def v08(spark, sf_dir):
    rows = [(c.hazard, c.min_confidence, c.min_frames, c.cooldown_seconds) for c in default_configs()]
    dim = spark.createDataFrame(rows, "hazard string, min_confidence double, min_frames int, cooldown_seconds double")
    joined = fx.raw_detections(spark, sf_dir).join(F.broadcast(dim), "hazard")
    return joined.groupBy("hazard", "min_confidence", "min_frames", "cooldown_seconds").agg(
        F.count("*").alias("detections"),
        F.count(F.when(F.col("confidence") >= F.col("min_confidence"), 1)).alias("above_floor"),
    )


SWEEP = [
    ValidatorConfig(f"p{n}_m{m}", min_frames=n, max_misses=m, enable_cooldown=False) for n in (2, 3, 4, 5) for m in (1, 5)
]


@query(
    "v09_multi_config_replay",
    cascade("SELECT config_id, camera_id, hazard, count(*) FILTER (rejected_by IS NULL) AS confirmed FROM annotated GROUP BY ALL", configs=SWEEP),
)
def v09(spark, sf_dir):
    rows = annotated(spark, sf_dir, SWEEP)
    return rows.groupBy("config_id", "camera_id", "hazard").agg(F.count(F.when(F.col("rejected_by").isNull(), 1)).alias("confirmed"))

#: So many clips a camera may have before its numbers run into those of the next one.
_CLIPS = 2**32


@query(
    "v10_state_reset_between_clips",
    fx.with_ctes(
        "SELECT camera_id, hazard, det_seq, rejected_by, track FROM annotated",
        extra={
            "clips": fx.SQL["detections"]
            .replace("user_id AS camera_id", f"user_id * {_CLIPS} + event_id // 2500 AS camera_id")
            .replace("PARTITION BY user_id, event_type", "PARTITION BY user_id, event_id // 2500, event_type"),
            **fx.cascade_sql(DEFAULTS, "clips"),
        },
        recursive=True,
    ),
)
def v10(spark, sf_dir):
    """The clip is part of the key, so each clip starts with fresh tracks and its own track numbers."""
    clip = F.col("camera_id") * _CLIPS + F.floor(F.col("det_seq") / 2500)
    clips = fx.raw_detections(spark, sf_dir).withColumn("camera_id", clip)
    chunk = fx.scans.chunk_of(F.col("ts"), fx.MONTH)
    det = cut_lineage(fx.scans.ordinal(clips, ["camera_id", "hazard"], chunk, [F.col("ts"), F.col("det_seq")], "frame_index"))
    return validate(det, DEFAULTS).select("camera_id", "hazard", "det_seq", "rejected_by", "track")


@query(
    "v11_frame_alarms",
    cascade(
        """SELECT f.camera_id, f.hazard, f.frame_index, coalesce(a.alerts, 0) AS alerts, coalesce(a.alerts, 0) > 0 AS alarmed
           FROM frames f LEFT JOIN (SELECT camera_id, hazard, frame_index, count(*) AS alerts FROM confirmed_rows GROUP BY ALL) a
           USING (camera_id, hazard, frame_index)""",
        "frames",
        extra=_EVENTS,
    ),
)
def v11(spark, sf_dir):
    from watchgrid.operators.metrics import event_alarms, frame_alarms

    det = fx.stored_detections(spark, sf_dir)
    key = ["camera_id", "hazard", "frame_index"]
    alarms = event_alarms(validate(det, DEFAULTS), key).drop("config_id")
    return frame_alarms(fx.frames(det).drop("ts"), alarms, key)


@query(
    "g06_level_stats",
    cascade(
        """SELECT hazard, level, seen, seen - rejected AS passed, rejected,
             CASE WHEN seen > 0 THEN round(rejected / seen, 6) ELSE 0.0 END AS rejection_rate FROM (
           SELECT hazard, unnest(['confidence', 'persistence', 'cooldown']) AS level, unnest([n, n - c, n - c - p]) AS seen,
                  unnest([c, p, d]) AS rejected FROM (
             SELECT hazard, count(*) AS n, count(*) FILTER (rejected_by = 'confidence') AS c,
               count(*) FILTER (rejected_by = 'persistence') AS p, count(*) FILTER (rejected_by = 'cooldown') AS d
             FROM annotated GROUP BY hazard))"""
    ),
)
def g06(spark, sf_dir):
    return rounded(reports.level_stats(annotated(spark, sf_dir), ["hazard"]), "rejection_rate")


@query(
    "g07_suppression",
    cascade(
        f"""SELECT camera_id, hazard, proposed, filtered, deduplicated, confirmed, {_RATES} FROM (
              SELECT camera_id, hazard, {_OUTCOMES} FROM annotated GROUP BY ROLLUP (camera_id, hazard))"""
    ),
)
def g07(spark, sf_dir):
    report = reports.suppression(annotated(spark, sf_dir), ["camera_id", "hazard"], totals=True)
    return rounded(report, "suppression_rate", "filtering_rate", "deduplication_rate")


@query("g10_counts_by_hazard", cascade("SELECT hazard, count(*) AS alerts FROM confirmed_rows GROUP BY ALL", extra=_EVENTS))
def g10(spark, sf_dir):
    return alerts.counts_by_hazard(confirmed_events(annotated(spark, sf_dir)))


@query(
    "g11_pipeline_report",
    cascade(
        f"""SELECT camera_id, hazard, frames, proposed, filtered, deduplicated, confirmed, {_RATES} FROM (
              SELECT camera_id, hazard, {_OUTCOMES} FROM annotated GROUP BY GROUPING SETS ((camera_id, hazard), (camera_id)))
            JOIN (SELECT camera_id, count(DISTINCT frame_index) AS frames FROM frames GROUP BY ALL) USING (camera_id)""",
        "frames",
    ),
)
def g11(spark, sf_dir):
    det = fx.stored_detections(spark, sf_dir)
    report = reports.pipeline_report(fx.frames(det), validate(det, DEFAULTS))
    return rounded(report, "suppression_rate", "filtering_rate", "deduplication_rate")


TWO_HAZARDS = [
    ValidatorConfig("multi", "fire", min_confidence=0.20, cooldown_seconds=fx.COOLDOWN),
    ValidatorConfig("multi", "traffic", min_confidence=0.40, cooldown_seconds=fx.COOLDOWN / 3, track_iou=0.15),
]


@query(
    "g25_suppression_between_arms",
    cascade(
        """SELECT hazard, raw_detections, coalesce(n, 0) AS confirmed_events,
             round(1 - coalesce(n, 0) / raw_detections, 6) AS suppression
           FROM (SELECT hazard, count(*) AS raw_detections FROM detections WHERE confidence >= 0.25 GROUP BY ALL)
           LEFT JOIN (SELECT hazard, count(*) AS n FROM confirmed_rows GROUP BY ALL) USING (hazard)""",
        extra=_EVENTS,
    ),
)
def g25(spark, sf_dir):
    det = fx.stored_detections(spark, sf_dir)
    raw = reports.raw_arm(det, 0.25).select("hazard", "raw_detections")
    return rounded(reports.suppression_between(raw, validate(det, DEFAULTS)), "suppression")


@query(
    "g27_suppression_shares",
    cascade(
        f"""SELECT hazard, proposed, round(filtered / proposed, 6) AS filtered_share,
              round(deduplicated / proposed, 6) AS deduplicated_share, round(confirmed / proposed, 6) AS confirmed_share
            FROM (SELECT hazard, {_OUTCOMES} FROM annotated GROUP BY ROLLUP (hazard))"""
    ),
)
def g27(spark, sf_dir):
    shares = reports.suppression_shares(annotated(spark, sf_dir))
    return rounded(shares, "filtered_share", "deduplicated_share", "confirmed_share")


@query(
    "g31_best_frame",
    cascade(
        """SELECT camera_id, arg_max(frame_index, n * 1000000 - frame_index) AS frame_index, max(n) AS n
           FROM (SELECT camera_id, frame_index, count(*) AS n FROM confirmed_rows GROUP BY ALL) GROUP BY ALL""",
        extra=_EVENTS,
    ),
)
def g31(spark, sf_dir):
    events = confirmed_events(annotated(spark, sf_dir))
    counts = events.groupBy("camera_id", F.col("confirmed_frame").alias("frame_index")).agg(F.count("*").alias("n"))
    return reports.best_frame(counts, ["camera_id"])


@query(
    "w07_recent_events",
    cascade(
        """SELECT hazard, recency, camera_id, det_seq FROM (
             SELECT hazard, camera_id, det_seq, row_number() OVER (PARTITION BY hazard ORDER BY ts DESC, det_seq DESC)::INTEGER AS recency
             FROM confirmed_rows) WHERE recency <= 25""",
        extra=_EVENTS,
    ),
)
def w07_events(spark, sf_dir):
    events = confirmed_events(annotated(spark, sf_dir))
    newest = series.recent(events, 25, ["hazard"], [F.desc("confirmed_time"), F.desc("det_seq")])
    return newest.select("hazard", "recency", "camera_id", "det_seq")


@query(
    "w07_timeline",
    cascade(
        """SELECT hazard, camera_id, frame_index, proposed, confirmed, suppressed, recency FROM (
             SELECT hazard, camera_id, frame_index, count(*) AS proposed, count(*) FILTER (rejected_by IS NULL) AS confirmed,
               count(*) FILTER (rejected_by IS NOT NULL) AS suppressed,
               row_number() OVER (PARTITION BY hazard, camera_id ORDER BY frame_index DESC)::INTEGER AS recency
             FROM annotated GROUP BY ALL) WHERE recency <= 240""".replace("GROUP BY ALL)", "GROUP BY hazard, camera_id, frame_index)")
    ),
)
def w07_timeline(spark, sf_dir):
    none = F.col("rejected_by").isNull()
    per_frame = annotated(spark, sf_dir).groupBy("hazard", "camera_id", "frame_index").agg(
        F.count("*").alias("proposed"), F.count(F.when(none, 1)).alias("confirmed"), F.count(F.when(~none, 1)).alias("suppressed")
    )
    return series.recent(per_frame, 240, ["hazard", "camera_id"], [F.desc("frame_index")])


OPEN = [ValidatorConfig("open", enable_cooldown=False, min_frames=2)]


@query(
    "w08_track_trails",
    cascade(
        """SELECT camera_id, hazard, track_id, frame_no, trail_length, frame_no + trail_length AS fades_at, newest_x FROM trails""",
        configs=OPEN,
        extra={
            "sighted": """SELECT camera_id, hazard, track AS track_id, frame_index AS frame_no, (cell * 100 + 30)::INTEGER AS newest_x,
                row_number() OVER (PARTITION BY camera_id, hazard, track ORDER BY frame_index) AS n FROM annotated WHERE rejected_by IS NULL""",
            "trails": """SELECT camera_id, hazard, track_id, frame_no, newest_x, n, 1 AS trail_length FROM sighted WHERE n = 1
                UNION ALL SELECT s.camera_id, s.hazard, s.track_id, s.frame_no, s.newest_x, s.n,
                  least(24, greatest(0, t.trail_length - (s.frame_no - t.frame_no - 1)) + 1)::INTEGER
                FROM trails t JOIN sighted s ON s.camera_id = t.camera_id AND s.hazard = t.hazard AND s.track_id = t.track_id AND s.n = t.n + 1""",
        },
    ),
)
def w08(spark, sf_dir):
    rows = annotated(spark, sf_dir, OPEN).filter("track_id > 0")
    trails = series.track_trails(rows)
    newest = F.element_at("trail", -1)["x"].alias("newest_x")
    return trails.select("camera_id", "hazard", "track_id", "frame_no", "trail_length", "fades_at", newest)


@query(
    "w09_running_track_stats",
    cascade(
        """SELECT camera_id, hazard, det_seq, track, hits, round(peak, 6) AS peak_confidence,
             round(avg(confidence) OVER (PARTITION BY camera_id, hazard, track ORDER BY frame_index), 6) AS mean_confidence
           FROM annotated WHERE track IS NOT NULL"""
    ),
)
def w09(spark, sf_dir):
    stats = reports.running_track_stats(annotated(spark, sf_dir))
    return stats.select(
        "camera_id", "hazard", "det_seq", "track", "hits", r6("peak_confidence").alias("peak_confidence"),
        r6("mean_confidence").alias("mean_confidence"),
    )


@query(
    "a10_alert_rows",
    cascade(
        """SELECT hazard, CAST(camera_id AS VARCHAR) AS camera_id, round_even(peak, 4) AS confidence, [x1, y1, x2, y2] AS box,
             first_frame AS first_seen_frame, frame_index AS confirmed_frame, hits AS supporting_detections, track AS track_id,
             printf('%d_%s_%06d.jpg', camera_id, hazard, frame_index) AS evidence
           FROM confirmed_rows JOIN (SELECT det_seq, x1, y1, x2, y2 FROM detections) USING (det_seq)""",
        extra=_EVENTS,
    ),
)
def a10(spark, sf_dir):
    """Written as JSON and read back, as a consumer would."""
    events = confirmed_events(annotated(spark, sf_dir))
    folder = fx.shared_folder(spark)
    alerts.write_alerts(events, folder)
    schema = (
        "hazard string, camera_id string, confidence double, box array<double>, first_seen_frame long, "
        "confirmed_frame long, supporting_detections long, track_id long, evidence string"
    )
    return spark.read.schema(schema).json(folder)
