"""Registered queries: the camera registry, the gate, and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6
from watchgrid.operators import gate as gates
from watchgrid.operators import reports, sampling, series
from watchgrid.sources import detections as sources
from watchgrid.sources import dims, live, registry

# A registry with every kind of broken entry, spread over all cameras.
_ENTRIES_SQL = """
    SELECT CASE WHEN camera_id % 17 <> 3 THEN 'cam_' || (CASE WHEN camera_id % 19 = 5 THEN 1 ELSE camera_id END) END AS camera_id,
      CASE WHEN camera_id % 23 <> 4 THEN source END AS source,
      CASE WHEN camera_id % 29 = 6 THEN 'moon' ELSE context END AS context,
      CASE WHEN camera_id % 31 = 7 THEN 'sideways' ELSE viewpoint END AS viewpoint,
      CASE WHEN camera_id % 37 = 8 THEN ['fire', 'plague'] ELSE hazards END AS hazards,
      camera_id % 41 = 9 AS store_raw_video, CASE WHEN camera_id % 43 = 10 THEN -1.0 ELSE 10.0 END AS buffer
    FROM cameras"""


def entries(spark, sf_dir):
    c = fx.cameras(spark, sf_dir)
    n = F.col("camera_id")
    ident = F.when(n % 19 == 5, F.lit(1)).otherwise(n).cast("string")
    return c.select(
        F.when(n % 17 != 3, F.concat(F.lit("cam_"), ident)).alias("camera_id"),
        F.when(n % 23 != 4, F.col("source")).alias("source"),
        F.when(n % 29 == 6, F.lit("moon")).otherwise(F.col("context")).alias("context"),
        F.lit(None).cast("string").alias("name"),
        F.when(n % 37 == 8, F.array(F.lit("fire"), F.lit("plague"))).otherwise(F.col("hazards")).alias("hazards"),
        F.when(n % 31 == 7, F.lit("sideways")).otherwise(F.col("viewpoint")).alias("viewpoint"),
        "enabled",
        F.struct(
            F.when(n % 43 == 10, F.lit(-1.0)).alias("rolling_buffer_seconds"),
            F.lit(None).cast("boolean").alias("evidence_frame"),
            (n % 41 == 9).alias("store_raw_video"),
        ).alias("retention"),
        F.lit(None).cast("string").alias("notes"),
    )


@query(
    "a03_registry_violations",
    fx.with_ctes(
        """SELECT camera_id, violation, count(*) AS entries FROM (
             SELECT camera_id, 'missing_camera_id' AS violation FROM entries WHERE camera_id IS NULL
             UNION ALL SELECT camera_id, 'missing_source' FROM entries WHERE source IS NULL
             UNION ALL SELECT camera_id, 'unknown_context' FROM entries WHERE context NOT IN (SELECT context FROM contexts)
             UNION ALL SELECT camera_id, 'unknown_viewpoint' FROM entries WHERE viewpoint NOT IN ('ground', 'oblique', 'nadir_aerial')
             UNION ALL SELECT camera_id, 'unknown_hazard' FROM entries WHERE list_contains(hazards, 'plague')
             UNION ALL SELECT camera_id, 'raw_video_retention' FROM entries WHERE store_raw_video
             UNION ALL SELECT camera_id, 'negative_buffer' FROM entries WHERE buffer < 0
             UNION ALL SELECT camera_id, 'duplicate_camera_id' FROM entries WHERE camera_id IS NOT NULL GROUP BY camera_id HAVING count(*) > 1
           ) GROUP BY ALL""",
        "contexts",
        "cameras",
        extra={"entries": _ENTRIES_SQL},
    ),
)
def a03(spark, sf_dir):
    _, violations = registry.load_cameras(entries(spark, sf_dir))
    return violations.groupBy("camera_id", "violation").agg(F.count("*").alias("entries"))


@query("j01_gate", fx.with_ctes("SELECT camera_id, context, hazard, viewpoint FROM gate", *fx.GATE))
def j01(spark, sf_dir):
    return gates.gate(fx.cameras(spark, sf_dir))


@query(
    "j02_gated_detections",
    fx.with_ctes(
        """SELECT camera_id, hazard, count(*) AS detections FROM detections SEMI JOIN gate USING (camera_id, hazard) GROUP BY ALL""",
        "detections",
        *fx.GATE,
    ),
)
def j02(spark, sf_dir):
    kept = gates.gated(fx.raw_detections(spark, sf_dir), gates.gate(fx.cameras(spark, sf_dir)))
    return kept.groupBy("camera_id", "hazard").agg(F.count("*").alias("detections"))


@query(
    "j03_unknown_cameras",
    fx.with_ctes(
        "SELECT DISTINCT camera_id FROM detections WHERE camera_id NOT IN (SELECT camera_id FROM cameras WHERE enabled)",
        "detections",
        "cameras",
    ),
)
def j03(spark, sf_dir):
    registered = fx.cameras(spark, sf_dir).filter("enabled")
    return gates.unknown_cameras(fx.raw_detections(spark, sf_dir), registered)


@query(
    "j04_envelope_violations",
    fx.with_ctes(
        "SELECT camera_id, hazard, viewpoint FROM gate ANTI JOIN envelope USING (hazard, viewpoint)", *fx.GATE, "envelope"
    ),
)
def j04(spark, sf_dir):
    return gates.envelope_violations(gates.gate(fx.cameras(spark, sf_dir)), dims.envelope_dim(spark))


@query(
    "j05_required_models",
    fx.with_ctes("SELECT DISTINCT hazard, viewpoint, model FROM gate JOIN envelope USING (hazard, viewpoint)", *fx.GATE, "envelope"),
)
def j05(spark, sf_dir):
    return gates.required_models(gates.gate(fx.cameras(spark, sf_dir)), dims.envelope_dim(spark))


@query(
    "j13_missing_sources",
    fx.with_ctes(
        """SELECT camera_id, source FROM cameras WHERE NOT contains(source, '://') AND NOT regexp_full_match(source, '\\d+')
             AND regexp_extract(source, '([^/]*)$', 1) NOT IN (SELECT 'cam_' || o_custkey || '.mp4' FROM orders WHERE o_orderstatus = 'F')""",
        "cameras",
    ),
)
def j13(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    files = orders.select(F.concat(F.lit("cam_"), F.col("o_custkey").cast("string"), F.lit(".mp4")).alias("file"))
    return gates.missing_sources(fx.cameras(spark, sf_dir), files)


@query(
    "g08_gate_summary",
    fx.with_ctes(
        """SELECT n AS cameras, 5 AS hazards_available, n * 5 AS ungated_invocations, g AS gated_invocations,
             round_even(1 - g / (n * 5), 4) AS reduction, models_loaded
           FROM (SELECT count(*) AS n, sum(len(active_hazards))::BIGINT AS g FROM resolved WHERE enabled),
                (SELECT list_sort(list(DISTINCT hazard)) AS models_loaded FROM gate)""",
        *fx.GATE,
    ),
)
def g08(spark, sf_dir):
    return gates.gate_summary(fx.cameras(spark, sf_dir))


@query("g08_cameras_by_context", fx.with_ctes("SELECT context, count(*) AS cameras FROM cameras WHERE enabled GROUP BY ALL", "cameras"))
def g08_context(spark, sf_dir):
    return gates.cameras_by_context(fx.cameras(spark, sf_dir))


@query("g09_required_hazards", fx.with_ctes("SELECT DISTINCT hazard FROM gate", *fx.GATE))
def g09(spark, sf_dir):
    return gates.required_hazards(gates.gate(fx.cameras(spark, sf_dir)))


@query(
    "p20_camera_listing",
    fx.with_ctes(
        """SELECT camera_id, context, list_sort(active_hazards) AS hazards, hazards IS NOT NULL AS hazards_overridden,
             active_viewpoint AS viewpoint, enabled FROM resolved""",
        *fx.GATE[:3],
    ),
)
def p20(spark, sf_dir):
    return gates.camera_listing(fx.cameras(spark, sf_dir))


_KIND_SQL = """CASE WHEN source LIKE 'usgs://%' OR source LIKE 'hpwren://%' OR (source LIKE 'http%://%'
      AND regexp_matches(lower(regexp_replace(source, '\\?.*$', '')), '\\.(jpg|jpeg|png)$')) THEN 'polled_still'
    WHEN regexp_full_match(source, '\\d+') THEN 'webcam'
    WHEN contains(source, '://') AND source NOT LIKE 'file://%' THEN 'stream' ELSE 'file' END"""


@query(
    "a08_route_source",
    fx.with_ctes(f"SELECT camera_id, kind, kind <> 'file' AS is_live FROM (SELECT camera_id, {_KIND_SQL} AS kind FROM cameras)", "cameras"),
)
def a08(spark, sf_dir):
    routed = fx.cameras(spark, sf_dir).withColumn("_r", live.route_source(F.col("source")))
    return routed.select("camera_id", "_r.kind", "_r.is_live")


@query(
    "t04_camera_selector",
    fx.with_ctes(
        f"SELECT camera_id, kind, kind <> 'file' AS is_live FROM (SELECT camera_id, {_KIND_SQL} AS kind FROM cameras) ORDER BY NOT is_live, camera_id",
        "cameras",
    ),
)
def t04(spark, sf_dir):
    routed = fx.cameras(spark, sf_dir).withColumn("_r", live.route_source(F.col("source")))
    return gates.selector_listing(routed.select("camera_id", "_r.kind", "_r.is_live"))


# Stored stills: one key per event, stamped with the event's second.

_KEYS_SQL = """
    SELECT user_id AS camera_id, event_id, '720/cam_' || user_id || '/cam_' || user_id || '___' || strftime(ts, '%Y-%m-%dT%H-%M-%SZ')
      || CASE WHEN event_id % 5 = 0 THEN '.json' ELSE '.jpg' END AS key, floor(epoch_us(ts) / 1e6) AS captured_at FROM events"""


def still_keys(spark, sf_dir):
    camera = F.concat(F.lit("cam_"), F.col("user_id").cast("string"))
    suffix = F.when(F.col("event_id") % 5 == 0, ".json").otherwise(".jpg")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss'Z'")
    key = F.concat(F.lit("720/"), camera, F.lit("/"), camera, F.lit("___"), stamp, suffix)
    return fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), "event_id", key.alias("key"))


_AS_OF = 1_706_400_000  # 2024-01-28


@query(
    "a07_latest_key",
    fx.with_ctes(
        f"""SELECT camera_id, arg_max(key, (captured_at, key)) AS key, max(captured_at) AS captured_at FROM keys
            WHERE key LIKE '%.jpg' AND floor(captured_at / 86400) > {_AS_OF} // 86400 - 3 AND floor(captured_at / 86400) <= {_AS_OF} // 86400
            GROUP BY ALL""",
        extra={"keys": _KEYS_SQL},
    ),
)
def a07(spark, sf_dir):
    return live.latest_key(still_keys(spark, sf_dir).select("camera_id", "key"), F.lit(_AS_OF))


@query(
    "p13_daylight",
    fx.with_ctes(
        """SELECT camera_id, key FROM (SELECT camera_id, key, row_number() OVER (PARTITION BY camera_id ORDER BY captured_at DESC, key DESC) AS n
             FROM keys WHERE floor(captured_at % 86400 / 3600) BETWEEN 14 AND 23) WHERE n <= 10""",
        extra={"keys": _KEYS_SQL},
    ),
)
def p13(spark, sf_dir):
    return sampling.daylight(still_keys(spark, sf_dir), last=10).select("camera_id", "key")


_NAMES_SQL = """
    SELECT event_id, epoch_us(ts) // 1000000 || '_' || CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END || lpad(CAST(event_id % 5000 AS VARCHAR), 5, '0')
      || CASE WHEN event_id % 9 = 0 THEN '.png' ELSE '.jpg' END AS file,
      CASE WHEN event_id % 4 = 0 THEN 'other-' || user_id ELSE strftime(ts, '%Y%m%d') || '_FIRE_cam-' || user_id END AS sequence,
      CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%-m-%-d-%-H-%-M-%-S') WHEN 1 THEN strftime(ts, '%H_%M') ELSE 'nothing' END AS stem
    FROM events"""


def names(spark, sf_dir):
    n = F.col("event_id")
    sign = F.when(n % 2 == 0, "+").otherwise("-")
    seconds = F.floor(sources.epoch_seconds(F.col("ts"))).cast("long").cast("string")
    suffix = F.when(n % 9 == 0, ".png").otherwise(".jpg")
    user = F.col("user_id").cast("string")
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(seconds, F.lit("_"), sign, F.lpad((n % 5000).cast("string"), 5, "0"), suffix).alias("file"),
        F.when(n % 4 == 0, F.concat(F.lit("other-"), user))
        .otherwise(F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_FIRE_cam-"), user))
        .alias("sequence"),
        F.when(n % 3 == 0, F.date_format("ts", "yyyy-M-d-H-m-s"))
        .when(n % 3 == 1, F.date_format("ts", "HH_mm"))
        .otherwise("nothing")
        .alias("stem"),
    )


@query(
    "a06_parse_frame_names",
    fx.with_ctes(
        """SELECT event_id,
             CASE WHEN regexp_matches(file, '^\\d+_[+-]\\d+\\.jpg') THEN CAST(regexp_extract(file, '_([+-]\\d+)', 1) AS DOUBLE) END AS "offset",
             CASE WHEN sequence LIKE 'other%' THEN sequence ELSE regexp_extract(sequence, 'FIRE_(.+)', 1) END AS camera,
             CASE WHEN stem LIKE '%-%' THEN epoch_us(strptime(stem, '%Y-%m-%d-%H-%M-%S')) / 1e6
                  WHEN stem LIKE '%\\_%' ESCAPE '\\' THEN epoch_us(strptime('2020-04-23 ' || stem, '%Y-%m-%d %H_%M')) / 1e6 END AS creek_ts,
             CAST(regexp_extract(file, '(\\d+)', 1) AS BIGINT) AS first_number
           FROM names""",
        extra={"names": _NAMES_SQL},
    ),
)
def a06(spark, sf_dir):
    return names(spark, sf_dir).select(
        "event_id",
        sources.parse_frame_name(F.col("file"), "offset").alias("offset"),
        sources.parse_frame_name(F.col("sequence"), "sequence").alias("camera"),
        sources.parse_frame_name(F.col("stem"), "creek").alias("creek_ts"),
        sources.parse_frame_name(F.col("file"), "index").alias("first_number"),
    )


@query(
    "a06_capture_instant",
    fx.with_ctes("SELECT event_id, captured_at FROM keys", extra={"keys": _KEYS_SQL}),
)
def a06_capture(spark, sf_dir):
    keys = still_keys(spark, sf_dir)
    return keys.select("event_id", sources.parse_frame_name(F.col("key"), "capture").alias("captured_at"))


# Repeated stills: the signature is the event's kind, so neighbours often agree.

_STILLS_SQL = """
    SELECT user_id AS camera_id, event_id AS frame_index, epoch_us(ts) / 1e6 AS ts, event_type AS signature,
           coalesce(lag(event_type) OVER w = event_type, false) AS is_repeat
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def stills(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("camera_id"),
        F.col("event_id").alias("frame_index"),
        sources.epoch_seconds(F.col("ts")).alias("ts"),
        F.col("event_type").alias("signature"),
    )


@query("p07_drop_repeats", fx.with_ctes("SELECT camera_id, frame_index, signature FROM stills WHERE NOT is_repeat", extra={"stills": _STILLS_SQL}))
def p07(spark, sf_dir):
    frames = stills(spark, sf_dir)
    return sampling.drop_repeats(frames, fx.scans.chunk_of(F.col("ts"), fx.MONTH)).select("camera_id", "frame_index", "signature")


_LAST = 1_706_745_600  # 2024-02-01


@query(
    "g29_source_status",
    fx.with_ctes(
        f"""SELECT camera_id, count(*) FILTER (NOT is_repeat) AS images_seen, count(*) FILTER (is_repeat) AS repeats_skipped,
              max(ts) AS last_capture, CASE WHEN camera_id % 3 = 0 THEN 300.0::DOUBLE ELSE 60.0 END AS interval_seconds,
              round(({_LAST} - max(ts)) / CASE WHEN camera_id % 3 = 0 THEN 300 ELSE 60 END, 6) AS intervals_behind,
              {_LAST} - max(ts) > CASE WHEN camera_id % 3 = 0 THEN 300 ELSE 60 END AS stale
            FROM stills GROUP BY camera_id""",
        extra={"stills": _STILLS_SQL},
    ),
)
def g29(spark, sf_dir):
    frames = stills(spark, sf_dir)
    marked = sampling.mark_repeats(frames, fx.scans.chunk_of(F.col("ts"), fx.MONTH))
    interval = F.when(F.col("camera_id") % 3 == 0, F.lit(300))
    cameras = fx.cameras(spark, sf_dir).select("camera_id", interval.alias("interval_seconds"))
    return reports.source_status(marked, cameras, F.lit(float(_LAST))).withColumn("intervals_behind", r6("intervals_behind"))


@query(
    "w10_frame_gaps",
    fx.with_ctes(
        """SELECT camera_id, frame_index, round(ts - lag(ts) OVER (PARTITION BY camera_id ORDER BY ts, frame_index), 3) AS gap FROM stills""",
        extra={"stills": _STILLS_SQL},
    ),
)
def w10(spark, sf_dir):
    gaps = series.frame_gaps(stills(spark, sf_dir), ["camera_id"], fx.scans.chunk_of(F.col("ts"), fx.MONTH))
    return gaps.select("camera_id", "frame_index", F.round("gap", 3).alias("gap"))


@query(
    "w06_longest_run",
    """WITH ids AS (SELECT DISTINCT user_id, event_id // 20 AS id FROM events),
            runs AS (SELECT user_id, id - row_number() OVER (PARTITION BY user_id ORDER BY id) AS g, id FROM ids),
            sized AS (SELECT user_id, count(*) AS length, min(id) AS first_id FROM runs GROUP BY user_id, g)
       SELECT user_id AS camera_id, length, first_id FROM sized
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first_id) = 1""",
)
def w06(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), F.floor(F.col("event_id") / 20).alias("id"))
    return series.longest_run(ids, keys=["camera_id"])


@query(
    "w11_latency_profile",
    """SELECT detector, round(median(latency_ms), 6) AS median_latency_ms, count(*) AS inferences, round(1000 / median(latency_ms), 6) AS fps
       FROM (SELECT event_type AS detector, value AS latency_ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events)
       WHERE n <= 200 GROUP BY detector""",
)
def w11(spark, sf_dir):
    timings = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("detector"), F.col("event_id").alias("seq"), F.col("value").alias("latency_ms")
    )
    profile = series.latency_profile(timings)
    return profile.withColumns({"median_latency_ms": r6("median_latency_ms"), "fps": r6("fps")})


@query(
    "u03_coverage_gaps",
    """SELECT 'unredacted_label' AS gap, name FROM (SELECT DISTINCT event_type AS name FROM events UNION SELECT 'swimmer' UNION SELECT 'civilian')
         WHERE name NOT IN ('civilian', 'rescue_team', 'swimmer', 'person', 'people')
       UNION ALL SELECT 'context_without_hazard', o_orderpriority FROM (SELECT DISTINCT o_orderpriority FROM orders) WHERE o_orderpriority LIKE '4%'""",
)
def u03(spark, sf_dir):
    emitted = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("label"))
    people = spark.createDataFrame([("swimmer",), ("civilian",)], "label string")
    contexts = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("context")).distinct()
    hazards = F.when(F.col("context").startswith("4"), F.array().cast("array<string>")).otherwise(F.array(F.lit("fire")))
    return reports.coverage_gaps(emitted.unionByName(people), contexts.withColumn("context_hazards", hazards))
