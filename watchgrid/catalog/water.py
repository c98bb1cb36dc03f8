"""Registered queries: water measured from masks, trends, onset of change, and pixel metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6, rounded
from watchgrid.operators import detect, flood, metrics, reports, scans
from watchgrid.sources import dims

MASKS = ("lines", "mask_runs", "mask_frames")
_MONTHS = fx.MONTH


@query(
    "f01_area_fraction",
    fx.with_ctes(
        """SELECT camera_id, frame_index, round(coalesce(w, 0) / 1304, 6) AS area_fraction FROM mask_frames
           LEFT JOIN (SELECT camera_id, frame_index, sum(x1 - x0) AS w FROM mask_runs GROUP BY ALL) USING (camera_id, frame_index)""",
        *MASKS,
    ),
)
def f01(spark, sf_dir):
    areas = flood.area_fraction(fx.mask_runs(spark, sf_dir), fx.mask_frames(spark, sf_dir))
    return areas.select("camera_id", "frame_index", r6("area_fraction").alias("area_fraction"))


# Sampled from the bottom row up; an index is kept while it lies within five of the kept one before.
_LEVELS = {
    "points": """SELECT camera_id, i::INTEGER AS idx, round_even(bottom_x + (top_x - bottom_x) * (i / 199), 0)::BIGINT AS px,
          round_even(bottom_y + (top_y - bottom_y) * (i / 199), 0)::BIGINT AS y FROM ref_lines, range(200) r(i)""",
    "wet": "SELECT DISTINCT frame_index, camera_id, idx FROM mask_runs JOIN points USING (camera_id, y) WHERE px >= x0 AND px < x1",
    "gaps": "SELECT *, idx - coalesce(lag(idx) OVER (PARTITION BY camera_id, frame_index ORDER BY idx), -1) > 5 AS broken FROM wet",
    "reach": """SELECT camera_id, frame_index, max(idx) AS last FROM (SELECT *, count(*) FILTER (broken) OVER (PARTITION BY camera_id, frame_index ORDER BY idx) AS b FROM gaps)
        WHERE b = 0 GROUP BY ALL""",
    "levels": """SELECT camera_id, frame_index, (coalesce(last, -1) + 1) / 200 AS level_fraction, metres FROM mask_frames JOIN ref_lines USING (camera_id)
        LEFT JOIN reach USING (camera_id, frame_index)""",
}


@query(
    "f02_level_along_line",
    fx.with_ctes(
        "SELECT camera_id, frame_index, round(level_fraction, 6) AS level_fraction, round(level_fraction * metres, 6) AS level_metres FROM levels",
        *MASKS,
        "ref_lines",
        extra=_LEVELS,
    ),
)
def f02(spark, sf_dir):
    frames = fx.mask_frames(spark, sf_dir).select("camera_id", "frame_index")
    levels = flood.level_along_line(fx.mask_runs(spark, sf_dir), fx.reference_lines(frames), frames)
    return rounded(levels.select("camera_id", "frame_index", "level_fraction", "level_metres"), "level_fraction", "level_metres")


# Components of a frame by recursion: every run repeats the smallest row it can reach.
_REGIONS = {
    "touching": """SELECT a.frame_index, a.y AS a, b.y AS b FROM mask_runs a JOIN mask_runs b USING (frame_index)
        WHERE a.y = b.y OR (abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1)""",
    "reachable": """SELECT frame_index, a, b FROM touching UNION SELECT r.frame_index, r.a, t.b FROM reachable r JOIN touching t ON t.frame_index = r.frame_index AND t.a = r.b""",
    "components": "SELECT frame_index, a AS y, min(b) AS component FROM reachable GROUP BY ALL",
    "regions": """SELECT camera_id, frame_index, min(x0)::DOUBLE AS x1, min(y)::DOUBLE AS y1, max(x1)::DOUBLE AS x2, (max(y) + 1)::DOUBLE AS y2, sum(x1 - x0)::BIGINT AS area
        FROM mask_runs JOIN components USING (frame_index, y) GROUP BY camera_id, frame_index, component HAVING sum(x1 - x0) >= 0.002 * 1304""",
}


@query(
    "f03_mask_regions",
    fx.with_ctes(
        "SELECT camera_id, frame_index, x1, y1, x2, y2, area, round(area / 1304, 6) AS area_fraction, round(least(1.0, area / ((x2 - x1) * (y2 - y1))), 6) AS confidence FROM regions",
        "lines",
        "mask_runs",
        extra=_REGIONS,
        recursive=True,
    ),
)
def f03(spark, sf_dir):
    regions = flood.mask_regions(fx.mask_runs(spark, sf_dir), fx.mask_frames(spark, sf_dir))
    return rounded(regions.drop("det_seq"), "area_fraction", "confidence")


@query(
    "g30_region_stability",
    fx.with_ctes(
        f"""SELECT count(*) AS masks, median(n)::DOUBLE AS median_regions, round(median(largest), 6) AS median_largest_share, round(median(iou), 6) AS median_step_iou FROM (
              SELECT a.n, a.largest, CASE WHEN b.frame_index IS NOT NULL THEN {fx.iou_sql('b', 'a')} END AS iou
              FROM best a LEFT JOIN best b ON b.camera_id = a.camera_id AND b.frame_index = a.frame_index - 1)""",
        "lines",
        "mask_runs",
        extra={
            **_REGIONS,
            "grouped": "SELECT frame_index // 50 AS camera_id, frame_index, x1, y1, x2, y2, area FROM regions",
            "best": """SELECT camera_id, frame_index, n, largest, x1, y1, x2, y2 FROM (SELECT *, count(*) OVER w AS n, max(area) OVER w / sum(area) OVER w AS largest,
                row_number() OVER (PARTITION BY camera_id, frame_index ORDER BY area DESC, y1, x1) AS r FROM grouped WINDOW w AS (PARTITION BY camera_id, frame_index)) WHERE r = 1""",
        },
        recursive=True,
    ),
)
def g30(spark, sf_dir):
    regions = flood.mask_regions(fx.mask_runs(spark, sf_dir), fx.mask_frames(spark, sf_dir))
    return rounded(reports.region_stability(regions.withColumn("camera_id", F.floor(F.col("frame_index") / 50))), "median_largest_share", "median_step_iou")


@query(
    "f04_level_readings",
    fx.with_ctes(
        """SELECT camera_id, frame_index, ts::DOUBLE AS ts, round(coalesce(w, 0) / 1304, 6) AS area_fraction, round(level_fraction, 6) AS level_fraction,
             round(level_fraction * metres, 6) AS level_metres
           FROM mask_frames LEFT JOIN (SELECT camera_id, frame_index, sum(x1 - x0) AS w FROM mask_runs GROUP BY ALL) USING (camera_id, frame_index)
           LEFT JOIN levels USING (camera_id, frame_index)""",
        *MASKS,
        "ref_lines",
        extra=_LEVELS,
    ),
)
def f04(spark, sf_dir):
    readings = level_readings(spark, sf_dir)
    return rounded(
        readings.select("camera_id", "frame_index", F.col("ts").cast("double").alias("ts"), "area_fraction", "level_fraction", "level_metres"),
        "area_fraction", "level_fraction", "level_metres",
    )


def level_readings(spark, sf_dir):
    frames = fx.mask_frames(spark, sf_dir)
    return flood.level_readings(fx.mask_runs(spark, sf_dir), frames, fx.reference_lines(frames))


# Onset of change over every camera's series.

_PH = """
    SELECT {keys}, seq, samples, drift - least(0, min(drift) OVER w) AS statistic FROM (
      SELECT *, sum(step) OVER w AS drift FROM (
        SELECT *, value - avg(value) OVER w - {delta} AS step, count(*) OVER w AS samples FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)
      ) WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)
    ) WINDOW w AS (PARTITION BY {keys} ORDER BY ts, seq)"""


@query(
    "w01_page_hinkley",
    fx.with_ctes(
        """SELECT camera_id, seq, samples, round(statistic, 6) AS statistic, over AND count(*) FILTER (over) OVER (PARTITION BY camera_id ORDER BY samples) = 1 AS alarm
           FROM (SELECT *, samples >= 5 AND statistic > 0.10 AS over FROM tested)""",
        "signal",
        extra={"tested": _PH.format(keys="camera_id", delta="0.005", source="signal")},
    ),
)
def w01(spark, sf_dir):
    tested = flood.page_hinkley(fx.signal(spark, sf_dir), ["camera_id"], scans.chunk_of(F.col("ts"), _MONTHS))
    return tested.select("camera_id", "seq", "samples", r6("statistic").alias("statistic"), "alarm")


_GRID = [(d, t) for d in (0.002, 0.005, 0.010) for t in (0.05, 0.10, 0.30)]


@query(
    "f06_page_hinkley_calibration",
    fx.with_ctes(
        """SELECT delta, threshold, count(*) AS series, count(alarm_at) AS alarmed, round(count(alarm_at) / count(*), 6) AS alarm_share, round(avg(alarm_at), 6) AS mean_samples_to_alarm
           FROM (SELECT delta, threshold, camera_id, min(CASE WHEN samples >= 5 AND statistic > threshold THEN samples END) AS alarm_at FROM tested GROUP BY ALL) GROUP BY ALL""",
        "signal",
        extra={
            "grid(delta, threshold)": "VALUES " + ", ".join(f"({d}::DOUBLE, {t}::DOUBLE)" for d, t in _GRID),
            "crossed": "SELECT * FROM signal, grid",
            "tested": _PH.format(keys="camera_id, delta, threshold", delta="delta", source="crossed"),
        },
    ),
)
def f06(spark, sf_dir):
    table = flood.ph_calibration(fx.signal(spark, sf_dir), _GRID, ["camera_id"], scans.chunk_of(F.col("ts"), _MONTHS))
    return rounded(table, "alarm_share", "mean_samples_to_alarm")


# Rate of rise: all earlier readings (every series here is shorter than the 512 kept) within the adaptive window.

_RISE = {
    "numbered": "SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY ts, seq) AS n, ts - lag(ts) OVER (PARTITION BY camera_id ORDER BY ts, seq) AS gap FROM signal",
    "widths": """SELECT a.camera_id, a.seq, a.n, a.ts, greatest(300, coalesce(CASE WHEN a.n >= 3 THEN list_sort(list(b.gap) FILTER (b.gap > 0))[(count(*) FILTER (b.gap > 0)) // 2 + 1] * 4 END, 0)) AS width
        FROM numbered a JOIN numbered b ON b.camera_id = a.camera_id AND b.n <= a.n AND b.n > a.n - 512 GROUP BY a.camera_id, a.seq, a.n, a.ts""",
    "fits": """SELECT w.camera_id, w.seq, w.n, count(*)::INTEGER AS samples, max(b.ts) - min(b.ts) AS window_seconds, regr_slope(b.area_fraction, b.ts - w.ts) AS slope,
          regr_r2(b.area_fraction, b.ts - w.ts) AS r2, max(b.area_fraction) - min(b.area_fraction) < 1e-9 AS flat
        FROM widths w JOIN numbered b ON b.camera_id = w.camera_id AND b.n <= w.n AND b.n > w.n - 512 AND w.ts - b.ts <= w.width GROUP BY w.camera_id, w.seq, w.n, w.ts""",
    "rises": """SELECT camera_id, seq, samples, CASE WHEN samples < 2 THEN 0 ELSE window_seconds END AS window_seconds, CASE WHEN samples < 2 OR flat THEN 0 ELSE slope * 60 END AS rate,
          CASE WHEN samples < 2 THEN 0 WHEN flat THEN 1 ELSE r2 END AS r_squared,
          CASE WHEN samples < 2 THEN 'unknown' WHEN flat OR abs(slope * 60) < 1e-5 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS trend FROM fits""",
}


def rises(spark, sf_dir):
    readings = fx.signal(spark, sf_dir).withColumnRenamed("seq", "frame_index")
    return flood.rise_estimate(readings, rising=1e-5, time_chunk_seconds=_MONTHS)


@query(
    "w02_rise_estimate",
    fx.with_ctes(
        """SELECT camera_id, seq AS frame_index, trend, samples, round(window_seconds, 3)::DOUBLE AS window_seconds, round(rate, 9)::DOUBLE AS area_rate_per_min,
             round(r_squared, 6)::DOUBLE AS r_squared FROM rises""",
        "signal",
        extra=_RISE,
    ),
)
def w02(spark, sf_dir):
    return rises(spark, sf_dir).select(
        "camera_id", "frame_index", "trend", "samples", F.round("window_seconds", 3).alias("window_seconds"),
        F.round("area_rate_per_min", 9).alias("area_rate_per_min"), r6("r_squared").alias("r_squared"),
    )


@query(
    "w03_adaptive_window",
    fx.with_ctes(
        "SELECT camera_id, samples, count(*) AS readings, round(max(window_seconds), 3)::DOUBLE AS widest FROM rises GROUP BY ALL", "signal", extra=_RISE
    ),
)
def w03(spark, sf_dir):
    return rises(spark, sf_dir).groupBy("camera_id", "samples").agg(
        F.count("*").alias("readings"), F.round(F.max("window_seconds"), 3).alias("widest")
    )


_CONFIDENT = "samples >= 4 AND window_seconds > 0 AND r_squared >= 0.5"


@query(
    "w04_trend_labels",
    fx.with_ctes(f"SELECT trend, {_CONFIDENT} AS confident, count(*) AS readings FROM rises GROUP BY ALL", "signal", extra=_RISE),
)
def w04(spark, sf_dir):
    rows = rises(spark, sf_dir)
    return rows.groupBy("trend", flood.is_confident().alias("confident")).agg(F.count("*").alias("readings"))


@query(
    "f05_rising_flag",
    fx.with_ctes(f"SELECT camera_id, count(*) FILTER (trend = 'rising' AND {_CONFIDENT}) AS rising FROM rises GROUP BY ALL", "signal", extra=_RISE),
)
def f05(spark, sf_dir):
    return rises(spark, sf_dir).groupBy("camera_id").agg(F.count(F.when(flood.is_rising(), 1)).alias("rising"))


@query(
    "w05_time_to_threshold",
    fx.with_ctes(
        f"""SELECT camera_id, seq AS frame_index, CASE WHEN trend = 'rising' AND {_CONFIDENT} AND rate > 0 THEN
              CASE WHEN area_fraction >= 0.9 THEN 0.0 ELSE round((0.9 - area_fraction) / rate * 60, 1) END END AS seconds_left
            FROM rises JOIN signal USING (camera_id, seq)""",
        "signal",
        extra=_RISE,
    ),
)
def w05(spark, sf_dir):
    """The level here is the area signal itself, read as a level."""
    readings = fx.signal(spark, sf_dir).withColumnRenamed("seq", "frame_index").withColumn("level_fraction", F.col("area_fraction"))
    rows = flood.rise_estimate(readings, rising=1e-5, time_chunk_seconds=_MONTHS)
    return rows.select("camera_id", "frame_index", F.round(flood.time_to_threshold(0.9), 1).alias("seconds_left"))


@query(
    "g24_trend_summary",
    fx.with_ctes(
        """SELECT camera_id, count(*) AS frames, round(max(ts - t0) / 60, 3) AS duration_minutes, round(arg_min(area_fraction, (ts, seq)), 6) AS coverage_start,
             round(arg_max(area_fraction, (ts, seq)), 6) AS coverage_end, round(arg_max(area_fraction, (ts, seq)) - arg_min(area_fraction, (ts, seq)), 6) AS coverage_change,
             count(*) FILTER (trend = 'rising') AS rising_frames, count(*) FILTER (trend = 'falling') AS falling_frames, count(*) FILTER (trend = 'stable') AS stable_frames,
             count(*) FILTER (trend = 'unknown') AS unknown_frames, round(min(ts - t0) FILTER (trend IN ('rising', 'falling')), 3) AS first_call_seconds,
             round(min(ts - t0) FILTER (samples2 >= 4 AND statistic > 0.02), 3) AS alarm_seconds
           FROM rises JOIN (SELECT *, min(ts) OVER (PARTITION BY camera_id) AS t0 FROM signal) USING (camera_id, seq)
           JOIN (SELECT camera_id, seq, samples AS samples2, statistic FROM tested) USING (camera_id, seq) GROUP BY camera_id""",
        "signal",
        extra={**_RISE, "areas": "SELECT camera_id, seq, ts, area_fraction AS value FROM signal", "tested": _PH.format(keys="camera_id", delta="0.002", source="areas")},
    ),
)
def g24(spark, sf_dir):
    series = fx.signal(spark, sf_dir)
    chunk = scans.chunk_of(F.col("ts"), _MONTHS)
    tested = flood.page_hinkley(series, ["camera_id"], chunk, value="area_fraction", delta=0.002, threshold=0.02, min_samples=4)
    alarms = tested.select("camera_id", F.col("seq").alias("frame_index"), "alarm")
    starts = series.groupBy("camera_id").agg(F.min("ts").alias("_t0"))
    rows = rises(spark, sf_dir).join(alarms, ["camera_id", "frame_index"]).join(starts, "camera_id").withColumn("ts", F.col("ts") - F.col("_t0"))
    summary = rounded(flood.trend_summary(rows), "coverage_start", "coverage_end", "coverage_change")
    return summary.withColumns({n: F.round(n, 3) for n in ("duration_minutes", "first_call_seconds", "alarm_seconds")})


@query(
    "p15_attach_water_context",
    fx.with_ctes(
        """SELECT k AS frame_index, k % 50 AS camera_id, n::BIGINT AS det_seq, round(coalesce(w, 0) / 1304, 6) AS coverage, round(level_fraction, 6) AS level_fraction,
             CASE WHEN k % 3 = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS rate_per_min
           FROM lines JOIN mask_frames f ON f.frame_index = k LEFT JOIN (SELECT frame_index, sum(x1 - x0) AS w FROM mask_runs GROUP BY ALL) m ON m.frame_index = k
           LEFT JOIN levels l ON l.frame_index = k""",
        *MASKS,
        "ref_lines",
        extra=_LEVELS,
    ),
)
def p15(spark, sf_dir):
    det = fx.lines(spark, sf_dir).select(F.col("k").alias("frame_index"), (F.col("k") % 50).alias("camera_id"), F.col("n").cast("long").alias("det_seq"))
    readings = level_readings(spark, sf_dir).withColumns(
        {
            "trend": F.lit("stable"),
            "level_rate_per_min": F.when(F.col("frame_index") % 3 == 0, F.lit(0.25)),
            "area_rate_per_min": F.lit(0.5),
        }
    )
    rows = detect.attach_water_context(det, readings)
    return rounded(rows.select("frame_index", "camera_id", "det_seq", "coverage", "level_fraction", "rate_per_min"), "coverage", "level_fraction")


# Pixel metrics per order as image.

_PIXELS = {
    "pixel_counts": """SELECT k AS image_id, rf = 'A' AS flooded, pk % 50 AS tp, sk % 20 AS fp, n::BIGINT AS fn, 200 - pk % 50 - sk % 20 - n::BIGINT AS tn FROM lines"""
}


def pixel_counts(spark, sf_dir):
    tp, fp, fn = F.col("pk") % 50, F.col("sk") % 20, F.col("n").cast("long")
    return fx.lines(spark, sf_dir).select(
        F.col("k").alias("image_id"), (F.col("rf") == "A").alias("flooded"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), (200 - tp - fp - fn).alias("tn")
    )


@query(
    "g14_segmentation_metrics",
    fx.with_ctes(
        """SELECT flooded, images, round(tp / (tp + fp + fn), 6) AS water_iou, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1,
             round((tp + tn) / (tp + fp + fn + tn), 6) AS pixel_accuracy FROM (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM (
               SELECT flooded, count(*) AS images, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM pixel_counts GROUP BY ALL))""",
        "lines",
        extra=_PIXELS,
    ),
)
def g14(spark, sf_dir):
    table = metrics.segmentation_metrics(pixel_counts(spark, sf_dir), ["flooded"])
    return rounded(table, "water_iou", "precision", "recall", "f1", "pixel_accuracy")


@query(
    "g15_stratified_iou",
    fx.with_ctes(
        """SELECT count(*) AS images, count(*) FILTER (flooded) AS flagged_images, round(sum(tp) / sum(tp + fp + fn), 6) AS pooled_iou,
             round(sum(tp) FILTER (flooded) / sum(tp + fp + fn) FILTER (flooded), 6) AS flagged_iou FROM pixel_counts""",
        "lines",
        extra=_PIXELS,
    ),
)
def g15(spark, sf_dir):
    return rounded(metrics.stratified_iou(pixel_counts(spark, sf_dir), "flooded"), "pooled_iou", "flagged_iou")


@query(
    "g16_accuracy_by_class",
    """SELECT o_orderpriority AS truth, count(*) AS total, count(*) FILTER (o_orderkey % 5 <> 0) AS correct, round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END), 6) AS accuracy
       FROM orders GROUP BY ROLLUP (o_orderpriority)""",
)
def g16(spark, sf_dir):
    pred = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("truth"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).otherwise("other").alias("predicted")
    )
    return rounded(metrics.accuracy_by_class(pred), "accuracy")


@query(
    "g18_mask_value_share",
    """SELECT value, pixels, round(pixels / sum(pixels) OVER (), 6) AS share, name, coalesce(value IN (3, 5, 8), false) AS is_water, name IS NOT NULL AS is_known
       FROM (SELECT (l_partkey % 12)::INTEGER AS value, sum(l_quantity)::BIGINT AS pixels FROM lineitem GROUP BY ALL)
       LEFT JOIN (VALUES (0, 'background'), (1, 'building-flooded'), (2, 'building-non-flooded'), (3, 'road-flooded'), (4, 'road-non-flooded'), (5, 'water'), (6, 'tree'),
         (7, 'vehicle'), (8, 'pool'), (9, 'grass')) AS t(value, name) USING (value)""",
)
def g18(spark, sf_dir):
    histogram = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 12).cast("int").alias("value"), F.col("l_quantity").cast("long").alias("pixels")
    )
    return rounded(metrics.mask_value_share(histogram, dims.mask_label_dim(spark)), "share")
