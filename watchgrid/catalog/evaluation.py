"""Registered queries: evaluation jobs over event-relative sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6, rounded
from watchgrid.operators import metrics, reports
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.plans import experiments
from watchgrid.session import cut_lineage

KEYS = ["camera_id", "hazard"]
RATE_COLUMNS = ("false_alarm_rate", "detection_rate", "median_minutes_to_detect")


def sequence_sql(configs, body: str, extra: dict | None = None, raw_floor: float | None = None, by: str = "", source: str = "sequences") -> str:
    """CTEs up to ``alarms`` (config_id, [by], camera_id, hazard, offset, alerts), then ``body``."""
    lead = f"{by}, " if by else ""
    carry = ["offset", *([by] if by else [])]
    ctes = fx.cascade_sql(configs, source, [f'"{c}"' for c in carry])
    raw = f" UNION ALL SELECT 'raw', {lead}camera_id, hazard, frame_index, \"offset\", count(*) FROM {source} WHERE confidence >= {raw_floor} GROUP BY ALL" if raw_floor is not None else ""
    ctes["alarms"] = f'SELECT config_id, {lead}camera_id, hazard, frame_index, "offset", count(*) AS alerts FROM annotated WHERE rejected_by IS NULL GROUP BY ALL' + raw
    return fx.with_ctes(body, "detections", "sequences", extra={**(extra or {}), **ctes}, recursive=True)


def metrics_sql(detected: str = "any_after", by: str = "", source: str = "sequences", ids: str = "SELECT DISTINCT config_id FROM alarms") -> str:
    lead, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    keyed = f"USING (config_id, {by})" if by else "USING (config_id)"
    first = 'min("offset") FILTER ("offset" > 0)' if detected == "any_after" else 'CASE WHEN min("offset") > 0 THEN min("offset") END'
    return f"""
      SELECT config_id, {lead}frames, pre_frames, post_frames, CASE WHEN pre_frames > 0 THEN coalesce(ap, 0) / pre_frames END AS false_alarm_rate,
        CASE WHEN post_frames > 0 THEN coalesce(aq, 0) / post_frames END AS detection_rate, coalesce(det, 0)::BIGINT AS sequences_detected, total_sequences,
        coalesce(bp, 0)::BIGINT AS alerts_pre, coalesce(bq, 0)::BIGINT AS alerts_post, (coalesce(bp, 0) + coalesce(bq, 0))::BIGINT AS alerts, med AS median_minutes_to_detect
      FROM (SELECT {lead}count(*) AS frames, count(*) FILTER ("offset" < 0) AS pre_frames, count(*) FILTER ("offset" >= 0) AS post_frames, count(DISTINCT (camera_id, hazard)) AS total_sequences
            FROM {source} {'GROUP BY ' + by if by else ''})
      CROSS JOIN ({ids})
      LEFT JOIN (SELECT config_id, {lead}sum(ap) AS ap, sum(aq) AS aq, sum(bp) AS bp, sum(bq) AS bq, count(f) AS det,
              list_sort(list(f / 60) FILTER (f IS NOT NULL))[count(f) // 2 + 1] AS med
            FROM (SELECT config_id, {lead}camera_id, hazard, count(*) FILTER ("offset" < 0) AS ap, count(*) FILTER ("offset" >= 0) AS aq, sum(alerts) FILTER ("offset" < 0) AS bp,
                    sum(alerts) FILTER ("offset" >= 0) AS bq, {first} AS f FROM alarms GROUP BY ALL) GROUP BY {lead}config_id) {keyed}"""


def rounded_sql(inner: str, extra_columns: str = "") -> str:
    return f"""SELECT * REPLACE (round(false_alarm_rate, 6) AS false_alarm_rate, round(detection_rate, 6) AS detection_rate,
        round(median_minutes_to_detect, 6) AS median_minutes_to_detect){extra_columns} FROM ({inner})"""


def numbered(spark, sf_dir):
    """Sequences with their dense frame numbers, written once: every experiment reads them several times."""
    return cut_lineage(fx.sequences(spark, sf_dir))


BASE = [ValidatorConfig("cascade", min_confidence=0.20, min_frames=3, enable_cooldown=False)]


@query("g12_sequence_metrics_any_after", sequence_sql(BASE, rounded_sql(metrics_sql()), raw_floor=0.20))
def g12(spark, sf_dir):
    det = numbered(spark, sf_dir)
    alarms, _ = experiments.arms(det, det, BASE, KEYS)
    return rounded(metrics.sequence_metrics(det, alarms, sequence=KEYS), *RATE_COLUMNS)


@query("g12_sequence_metrics_first_ever", sequence_sql(BASE, rounded_sql(metrics_sql("first_ever")), raw_floor=0.20))
def g12_first(spark, sf_dir):
    det = numbered(spark, sf_dir)
    alarms, _ = experiments.arms(det, det, BASE, KEYS)
    return rounded(metrics.sequence_metrics(det, alarms, sequence=KEYS, detected="first_ever"), *RATE_COLUMNS)


@query(
    "w09_first_alerts",
    sequence_sql(
        BASE,
        """SELECT config_id, camera_id, hazard, round(min("offset"), 3) AS first_alert, round(min("offset") FILTER ("offset" > 0), 3) AS first_after_event FROM alarms GROUP BY ALL""",
    ),
)
def w09(spark, sf_dir):
    det = numbered(spark, sf_dir)
    alarms, _ = experiments.arms(det, det, BASE, KEYS, raw_floor=None)
    firsts = reports.first_alerts(alarms, ["config_id", *KEYS])
    return firsts.withColumns({c: F.round(c, 3) for c in ("first_alert", "first_after_event")})


_ABLATION = experiments.ablation_configs(0.20)


@query(
    "e01_ablation",
    sequence_sql(
        _ABLATION,
        "SELECT * FROM (WITH m AS ("
        + metrics_sql()
        + ") SELECT * REPLACE (round(false_alarm_rate, 6) AS false_alarm_rate, round(detection_rate, 6) AS detection_rate, round(median_minutes_to_detect, 6) AS median_minutes_to_detect), "
        "round(1 - false_alarm_rate / (SELECT false_alarm_rate FROM m WHERE config_id = 'raw'), 6) AS far_reduction FROM m)",
        raw_floor=0.20,
    ),
)
def e01(spark, sf_dir):
    det = numbered(spark, sf_dir)
    return rounded(experiments.ablation(det, det, KEYS), *RATE_COLUMNS, "far_reduction")


_SWEEP = [ValidatorConfig(f"persistence_{n}", min_confidence=0.20, min_frames=n, enable_cooldown=False, cooldown_seconds=600.0) for n in (2, 3, 4)]


@query("e02_sequence_evaluation", sequence_sql(_SWEEP, rounded_sql(metrics_sql("first_ever")), raw_floor=0.20))
def e02(spark, sf_dir):
    det = numbered(spark, sf_dir)
    table, _ = experiments.sequence_evaluation(det, det, KEYS)
    return rounded(table, *RATE_COLUMNS)


@query(
    "e02_sequence_levels",
    sequence_sql(
        _SWEEP,
        """SELECT config_id, level, seen, seen - rejected AS passed, rejected, CASE WHEN seen > 0 THEN round(rejected / seen, 6) ELSE 0.0 END AS rejection_rate FROM (
             SELECT config_id, unnest(['confidence', 'persistence', 'cooldown']) AS level, unnest([n, n - c, n - c - p]) AS seen, unnest([c, p, d]) AS rejected FROM (
               SELECT config_id, count(*) AS n, count(*) FILTER (rejected_by = 'confidence') AS c, count(*) FILTER (rejected_by = 'persistence') AS p,
                 count(*) FILTER (rejected_by = 'cooldown') AS d FROM annotated GROUP BY ALL))""",
    ),
)
def e02_levels(spark, sf_dir):
    det = numbered(spark, sf_dir)
    return rounded(experiments.sequence_evaluation(det, det, KEYS)[1], "rejection_rate")


_FLOORS = "SELECT (20 + i) / 100 AS floor FROM range(76) r(i)"
_FLOOR_CTES = {"floors": _FLOORS}


def sweep_ctes(by: str = "", source: str = "sequences") -> dict[str, str]:
    """CTEs ending in ``sweep``, written as a plain cross join of detections and floors."""
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"USING (floor, {by})" if by else "USING (floor)"
    return {
        "floors": _FLOORS,
        "per_frame": f'SELECT {lead}floor, camera_id, hazard, frame_index, "offset", count(*) AS n FROM {source}, floors WHERE confidence >= floor GROUP BY ALL',
        "per_seq": f"""SELECT {lead}floor, camera_id, hazard, count(*) FILTER ("offset" < 0) AS ap, count(*) FILTER ("offset" >= 0) AS aq, sum(n) AS al,
            min("offset") FILTER ("offset" > 0) AS f FROM per_frame GROUP BY ALL""",
        "summed": f"SELECT {lead}floor, sum(ap) AS ap, sum(aq) AS aq, sum(al) AS al, count(f) AS det, list_sort(list(f / 60) FILTER (f IS NOT NULL))[count(f) // 2 + 1] AS med FROM per_seq GROUP BY ALL",
        "sweep": f"""SELECT {lead}floor, coalesce(ap, 0) / pre AS false_alarm_rate, coalesce(aq, 0) / post AS detection_rate, coalesce(det, 0)::BIGINT AS sequences_detected,
            coalesce(al, 0)::BIGINT AS alerts, med AS median_minutes_to_detect
            FROM (SELECT {lead}count(*) FILTER ("offset" < 0) AS pre, count(*) FILTER ("offset" >= 0) AS post FROM {source} {group}) CROSS JOIN floors LEFT JOIN summed {on}""",
    }


@query(
    "e03_threshold_matched",
    sequence_sql(
        BASE,
        "SELECT * FROM (WITH m AS ("
        + metrics_sql()
        + """), t AS (SELECT round_even(false_alarm_rate, 4) AS target_far FROM m),
        hit AS (SELECT min(floor) AS f FROM sweep, t WHERE round_even(false_alarm_rate, 4) <= target_far)
        SELECT floor, round(false_alarm_rate, 6) AS false_alarm_rate, round(detection_rate, 6) AS detection_rate, sequences_detected, alerts,
          round(median_minutes_to_detect, 6) AS median_minutes_to_detect, target_far, coalesce(floor = f, false) AS is_matched FROM sweep, t, hit)""",
        extra=sweep_ctes(),
    ),
)
def e03(spark, sf_dir):
    det = numbered(spark, sf_dir)
    return rounded(experiments.threshold_matched(det, det, KEYS), *RATE_COLUMNS)


@query(
    "g26_far_recall_frontier",
    fx.with_ctes(
        """SELECT far AS false_alarm_rate, arg_max(floor, (recall, -floor)) AS floor, max(recall) AS recall
           FROM (SELECT floor, round(false_alarm_rate, 4) AS far, round(detection_rate, 4) AS recall FROM sweep) GROUP BY far""",
        "detections",
        "sequences",
        extra=sweep_ctes(),
    ),
)
def g26(spark, sf_dir):
    det = numbered(spark, sf_dir)
    sweep = experiments.floor_sweep(det, det, KEYS)
    return reports.far_recall_frontier(
        sweep.select("floor", F.round("false_alarm_rate", 4).alias("false_alarm_rate"), F.round("detection_rate", 4).alias("recall"))
    )


@query(
    "j12_match_operating_point",
    fx.with_ctes(
        """SELECT target_far, min(floor) FILTER (round_even(false_alarm_rate, 4) <= target_far) AS matched_floor
           FROM sweep, (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE)) AS t(target_far) GROUP BY ALL""",
        "detections",
        "sequences",
        extra=sweep_ctes(),
    ),
)
def j12(spark, sf_dir):
    det = numbered(spark, sf_dir)
    targets = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.3,), (0.6,)], "target_far double")
    return experiments.match_operating_point(experiments.floor_sweep(det, det, KEYS), targets)


_FOLDED = {
    "folds": "SELECT camera_id, CASE WHEN row_number() OVER (ORDER BY camera_id) % 2 = 1 THEN 'A' ELSE 'B' END AS fold FROM (SELECT DISTINCT camera_id FROM sequences)",
    "folded": "SELECT * FROM sequences JOIN folds USING (camera_id)",
    **sweep_ctes("fold", "folded"),
    "tuned": "SELECT fold, coalesce(min(floor) FILTER (round_even(false_alarm_rate, 4) <= 0.3), 0.95) AS floor FROM sweep GROUP BY fold",
}


@query(
    "e04_threshold_transfer",
    sequence_sql(
        BASE,
        "SELECT * FROM (WITH m AS ("
        + metrics_sql(by="fold", source="folded")
        + """) SELECT a.fold || '->' || b.fold AS direction, a.floor AS tuned_floor, round(s1.false_alarm_rate, 6) AS far_on_train, round(s2.false_alarm_rate, 6) AS transfer_far,
          round(s2.detection_rate, 6) AS transfer_recall, b.floor AS oracle_floor, round(s3.false_alarm_rate, 6) AS oracle_far, round(m.false_alarm_rate, 6) AS cascade_far,
          round(m.detection_rate, 6) AS cascade_recall, (SELECT count(*) FROM folds WHERE fold = b.fold) AS test_cameras
        FROM tuned a JOIN tuned b ON b.fold <> a.fold JOIN sweep s1 ON s1.fold = a.fold AND s1.floor = a.floor JOIN sweep s2 ON s2.fold = b.fold AND s2.floor = a.floor
        JOIN sweep s3 ON s3.fold = b.fold AND s3.floor = b.floor JOIN m ON m.fold = b.fold)""",
        extra=_FOLDED,
        by="fold",
        source="folded",
    ),
)
def e04(spark, sf_dir):
    det = numbered(spark, sf_dir)
    table = experiments.threshold_transfer(det, det, KEYS, target_far=0.3, chunk=fx.scans.chunk_of(F.col("camera_id"), 65_536))
    return rounded(table, "far_on_train", "transfer_far", "transfer_recall", "oracle_far", "cascade_far", "cascade_recall")


MULTI = [
    ValidatorConfig("multi", "fire", min_confidence=0.20, cooldown_seconds=600.0),
    ValidatorConfig("multi", "traffic", min_confidence=0.40, cooldown_seconds=10.0, track_iou=0.15),
    ValidatorConfig("multi", "flood", min_confidence=0.50, min_frames=2, cooldown_seconds=300_000.0),
    ValidatorConfig("multi", "drowning", min_confidence=0.30, max_misses=2, cooldown_seconds=90_000.0),
    ValidatorConfig("multi", "building_access", min_confidence=0.20, enable_persistence=False, cooldown_seconds=200_000.0),
]


@query(
    "e05_multi_hazard",
    sequence_sql(
        MULTI,
        """SELECT hazard, raw_detections, coalesce(n, 0) AS confirmed_events, round(1 - coalesce(n, 0) / raw_detections, 6) AS suppression
           FROM (SELECT hazard, count(*) AS raw_detections FROM detections WHERE confidence >= 0.25 GROUP BY ALL)
           LEFT JOIN (SELECT hazard, count(*) AS n FROM annotated WHERE rejected_by IS NULL GROUP BY ALL) USING (hazard)""",
    ),
)
def e05(spark, sf_dir):
    table, _ = experiments.multi_hazard(fx.stored_detections(spark, sf_dir), MULTI)
    return rounded(table, "suppression")


# Every arm is run as cameras of its own.
_CUTOFFS = (40, 60, 80, 100, 120)
_GREY = {
    "arms_of": "SELECT * FROM (VALUES ('colour off', 0, 0), " + ", ".join(f"('S<={c}', {c}, {n})" for n, c in enumerate(_CUTOFFS, 1)) + ") AS t(prior, cut, arm)",
    "sequence_arms": """SELECT s.* REPLACE (camera_id * 10 + arm AS camera_id, det_seq * 10 + arm AS det_seq), prior, cut, (s.det_seq * 7 % 100) AS saturation, (s.det_seq * 11 % 256) AS value
        FROM sequences s CROSS JOIN arms_of""",
    "grey_kept": "SELECT * FROM sequence_arms WHERE cut = 0 OR (saturation <= cut AND value >= 50)",
}


@query(
    "e07_colour_prior_sequences",
    sequence_sql(
        BASE,
        rounded_sql(metrics_sql(by="prior", source="sequence_arms", ids="SELECT 'cascade' AS config_id")),
        extra=_GREY,
        source="grey_kept",
        by="prior",
    ),
)
def e07(spark, sf_dir):
    """One run of pixels per box, wholly grey or not at all. Frames the prior empties still count."""
    det = numbered(spark, sf_dir).withColumn("frame_no", F.col("frame_index"))
    pixels = det.select(
        *KEYS, "frame_index", F.lit(10).alias("y"), F.col("x1").cast("long").alias("x0"), F.col("x2").cast("long").alias("x1"),
        (F.col("det_seq") * 7 % 100).alias("saturation"), (F.col("det_seq") * 11 % 256).alias("value"),
    )
    rows = experiments.colour_prior_sequences(det, pixels, det, cutoffs=_CUTOFFS, keys=tuple(KEYS))
    return rounded(rows, *RATE_COLUMNS)


_COUNTS = """SELECT o_orderpriority AS name, count(*) FILTER (o_orderkey % 3 = 0) AS tp, count(*) FILTER (o_orderkey % 5 = 1) AS fp, count(*) FILTER (o_orderkey % 7 = 2) AS fn,
    count(*) FILTER (o_orderkey % 2 = 1) AS tn FROM orders GROUP BY ALL"""


def proportions(spark, sf_dir):
    key = F.col("o_orderkey")
    counts = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.when(key % 3 == 0, 1)).alias("tp"), F.count(F.when(key % 5 == 1, 1)).alias("fp"),
        F.count(F.when(key % 7 == 2, 1)).alias("fn"), F.count(F.when(key % 2 == 1, 1)).alias("tn"),
    )
    return experiments.proportion_counts(counts)


_WILSON = """greatest(0, (k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)) AS lo,
    least(1, (k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)) AS hi"""


@query(
    "e09_interval_table",
    fx.with_ctes(
        f"""SELECT name, measure, k, n, round(k / n, 6) AS share, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi FROM (SELECT *, {_WILSON} FROM (
              SELECT name, 'precision' AS measure, tp AS k, tp + fp AS n FROM counts UNION ALL SELECT name, 'recall', tp, tp + fn FROM counts
              UNION ALL SELECT name, 'false_alarm_rate', fp, fp + tn FROM counts))""",
        extra={"counts": _COUNTS},
    ),
)
def e09(spark, sf_dir):
    return rounded(metrics.interval_table(proportions(spark, sf_dir)), "share", "lo", "hi")


@query(
    "g17_wilson",
    f"""SELECT customer, k, n, round(lo, 6)::DOUBLE AS lo, round(hi, 6)::DOUBLE AS hi FROM (SELECT *, {_WILSON} FROM (
          SELECT o_custkey AS customer, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY ALL))""",
)
def g17(spark, sf_dir):
    counts = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("k"), F.count("*").alias("n")
    )
    table = metrics.interval_table(counts)
    return table.select("customer", "k", "n", r6("lo").alias("lo"), r6("hi").alias("hi"))
