"""Registered queries: frame sources, sampling, joins in time, splits, clips and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6, rounded
from watchgrid.catalog.validation import DEFAULTS, _EVENTS, cascade
from watchgrid.functions.stats import softmax
from watchgrid.operators import reports, sampling, scans, series
from watchgrid.operators.validator import confirmed_events, validate
from watchgrid.sources import detections as sources
from watchgrid.sources import dims, results

# Detection cache: one JSON row per frame. Weak detections are left out of the array, so empty frames occur.

_CACHE = {
    "cached": """SELECT camera_id || '_' || hazard AS sequence, frame_index::INTEGER AS frame_index, round(ts, 6) AS "offset",
        CASE WHEN confidence >= 0.3 THEN confidence END AS confidence, CASE WHEN confidence >= 0.3 THEN x1 END AS x1,
        CASE WHEN confidence >= 0.3 THEN x2 END AS x2, CASE WHEN confidence >= 0.3 THEN 'cell_' || cell END AS label, det_seq FROM detections"""
}


def cache_frames(spark, sf_dir):
    det = fx.detections(spark, sf_dir)
    found = F.struct(
        F.array("x1", "y1", "x2", "y2").alias("box"), F.col("confidence"), F.concat(F.lit("cell_"), F.col("cell").cast("string")).alias("label")
    )
    none = F.array().cast("array<struct<box:array<double>,confidence:double,label:string>>")
    return det.select(
        F.concat_ws("_", F.col("camera_id").cast("string"), "hazard").alias("sequence"),
        F.concat(F.col("det_seq").cast("string"), F.lit(".jpg")).alias("file"),
        F.col("frame_index").cast("int").alias("frame_index"),
        r6("ts").alias("offset"),
        F.lit(None).cast("int").alias("source_frame"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.when(F.col("confidence") >= 0.3, F.array(found)).otherwise(none).alias("detections"),
    )


def cache_on_disk(spark, sf_dir):
    folder = fx.shared_folder(spark)
    sources.write_detection_cache(cache_frames(spark, sf_dir), folder)
    return folder


@query(
    "a01_read_detection_cache",
    fx.with_ctes(
        'SELECT sequence, frame_index, "offset", 640 AS width, CASE WHEN confidence IS NULL THEN 0 ELSE 1 END AS detections FROM cached',
        "detections",
        extra=_CACHE,
    ),
)
def a01(spark, sf_dir):
    cache = sources.read_detection_cache(spark, cache_on_disk(spark, sf_dir))
    return cache.select("sequence", "frame_index", "offset", "width", F.size("detections").alias("detections"))


@query(
    "a02_explode_detections",
    fx.with_ctes(
        """SELECT sequence, frame_index, CASE WHEN label <> 'cell_2' THEN 0::BIGINT END AS det_seq, CASE WHEN label <> 'cell_2' THEN x1 END AS x1,
             CASE WHEN label <> 'cell_2' THEN round(confidence, 5) END AS confidence, CASE WHEN label <> 'cell_2' THEN label END AS label FROM cached""",
        "detections",
        extra=_CACHE,
    ),
)
def a02(spark, sf_dir):
    cache = sources.read_detection_cache(spark, cache_on_disk(spark, sf_dir))
    rows = sources.explode_detections(cache, labels=["cell_0", "cell_1", "cell_3"])
    return rows.select("sequence", "frame_index", "det_seq", "x1", F.round("confidence", 5).alias("confidence"), "label")


@query(
    "j09_with_empty_frames",
    fx.with_ctes(
        """SELECT f.camera_id, f.hazard, f.frame_index, d.det_seq FROM frames f
           LEFT JOIN (SELECT * FROM detections WHERE confidence >= 0.5) d USING (camera_id, hazard, frame_index)""",
        "detections",
        "frames",
    ),
)
def j09(spark, sf_dir):
    det = fx.detections(spark, sf_dir)
    strong = det.filter("confidence >= 0.5").select("camera_id", "hazard", "frame_index", "det_seq")
    return reports.with_empty_frames(fx.frames(det).drop("ts"), strong, ["camera_id", "hazard", "frame_index"])


# Sampling over clips. A clip is a customer's orders in key order.

_CLIP_FRAMES = {
    "clip_frames": "SELECT o_custkey AS clip, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders",
    "totals": "SELECT clip, count(*) AS total FROM clip_frames GROUP BY ALL",
}


def clip_frames(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), "o_orderkey")
    numbered = scans.ordinal(orders, ["clip"], scans.chunk_of(F.col("o_orderkey"), 1_000_000), [F.col("o_orderkey")], "_n")
    return numbered.withColumn("position", F.col("_n") - 1).drop("_n")


@query(
    "p08_stride_frames",
    fx.with_ctes(
        """SELECT clip, o_orderkey, position AS source_frame, position // s AS frame_index FROM clip_frames
           JOIN (SELECT clip, CASE WHEN total > 4 THEN greatest(1, total // 4) ELSE 1 END AS s FROM totals) USING (clip) WHERE position % s = 0""",
        extra=_CLIP_FRAMES,
    ),
)
def p08(spark, sf_dir):
    frames = clip_frames(spark, sf_dir)
    totals = frames.groupBy("clip").agg(F.count("*").alias("total"))
    strided = frames.withColumnRenamed("position", "source_frame").join(totals, "clip")
    kept = sampling.stride_frames(strided, sampling.stride_of(F.col("total"), 4))
    return kept.select("clip", "o_orderkey", "source_frame", "frame_index")


@query(
    "p09_even_picks",
    fx.with_ctes(
        """SELECT clip, pick::INTEGER AS pick, position, o_orderkey FROM (SELECT clip, pick, floor(total * (pick + 0.5) / 6)::BIGINT AS position FROM totals, range(6) r(pick))
           JOIN clip_frames USING (clip, position)""",
        extra=_CLIP_FRAMES,
    ),
)
def p09(spark, sf_dir):
    frames = clip_frames(spark, sf_dir)
    totals = frames.groupBy("clip").agg(F.count("*").alias("total"))
    return sampling.even_picks(frames, totals, 6).select("clip", "pick", "position", "o_orderkey")


@query(
    "p10_strided_limit",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 700) AS s FROM orders)
       WHERE i % s = 0 AND i // s < 700""",
)
def p10(spark, sf_dir):
    keys = fx.table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.strided_limit(keys, 700, F.col("o_orderkey"), scans.chunk_of(F.col("o_orderkey"), 65_536))


_WINDOWED = """SELECT camera_id, hazard, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, hazard, "offset" < 0, "offset" > 0
    ORDER BY CASE WHEN "offset" < 0 THEN {sign}"offset" ELSE "offset" END) AS n FROM sequences) WHERE {keep}"""


def ignition_frames(spark, sf_dir):
    rows = fx.sequences(spark, sf_dir)
    sequence = F.concat_ws("_", F.col("camera_id").cast("string"), "hazard")
    return rows.withColumn("sequence", sequence).withColumn("file", F.col("det_seq").cast("string"))


@query(
    "p11_ignition_window",
    fx.with_ctes(
        _WINDOWED.format(sign="-", keep='("offset" < 0 AND n <= 3) OR ("offset" > 0 AND n <= 2)'), "detections", "sequences"
    ),
)
def p11(spark, sf_dir):
    return sampling.ignition_window(ignition_frames(spark, sf_dir), 5).select("camera_id", "hazard", "frame_index")


@query("p11_negatives_only", fx.with_ctes(_WINDOWED.format(sign="", keep='"offset" < 0 AND n <= 4'), "detections", "sequences"))
def p11_negatives(spark, sf_dir):
    return sampling.ignition_window(ignition_frames(spark, sf_dir), 4, negatives_only=True).select("camera_id", "hazard", "frame_index")


@query(
    "p12_first_per_index",
    """SELECT o_orderkey // 4 AS capture_index, min('f_' || o_orderkey // 4 || '_' || o_custkey) AS path FROM orders
       WHERE o_orderkey // 4 BETWEEN 100 AND 2099 GROUP BY ALL""",
)
def p12(spark, sf_dir):
    index = F.floor(F.col("o_orderkey") / 4)
    frames = fx.table(spark, sf_dir, "orders").select(
        index.alias("capture_index"), F.concat(F.lit("f_"), index.cast("string"), F.lit("_"), F.col("o_custkey").cast("string")).alias("path")
    )
    return sampling.first_per_index(frames, 100, 2000)


# Joins in time.

_GAUGE = "SELECT user_id AS camera_id, epoch_us(ts) / 1e6 AS ts, value AS height FROM events WHERE event_type IN ('purchase', 'error', 'signup')"
_COVERAGE = "SELECT user_id AS camera_id, event_id, epoch_us(ts) / 1e6 AS ts, value / 600 AS area_fraction FROM events WHERE event_type IN ('view', 'click')"
_NEAREST = {
    "gauge": _GAUGE,
    "coverage": _COVERAGE,
    "nearest": """SELECT camera_id, event_id, ts, area_fraction, CASE WHEN least(coalesce(ts - b, 1e18), coalesce(a - ts, 1e18)) <= 43200
          THEN CASE WHEN coalesce(ts - b, 1e18) <= coalesce(a - ts, 1e18) THEN bh ELSE ah END END AS height
        FROM (SELECT c.*, x.ts AS b, x.height AS bh FROM coverage c ASOF LEFT JOIN gauge x ON x.camera_id = c.camera_id AND c.ts >= x.ts)
        JOIN (SELECT c.event_id, y.ts AS a, y.height AS ah FROM coverage c ASOF LEFT JOIN gauge y ON y.camera_id = c.camera_id AND c.ts <= y.ts) USING (event_id)""",
}


def gauge_tables(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    ts = sources.epoch_seconds(F.col("ts")).alias("ts")
    camera = F.col("user_id").alias("camera_id")
    gauge = events.filter("event_type IN ('purchase', 'error', 'signup')").select(camera, ts, F.col("value").alias("height"))
    seen = events.filter("event_type IN ('view', 'click')").select(camera, "event_id", ts, (F.col("value") / 600).alias("area_fraction"))
    return seen, gauge


@query("j08_nearest_join", fx.with_ctes("SELECT camera_id, event_id, height FROM nearest", extra=_NEAREST))
def j08(spark, sf_dir):
    joined = series.nearest_join(*gauge_tables(spark, sf_dir), 43_200, ["camera_id"], chunk_seconds=fx.MONTH)
    return joined.select("camera_id", "event_id", F.col("nearest.height").alias("height"))


@query(
    "g19_paired_corr",
    """SELECT user_id AS camera_id, count(*) AS pairs, CASE WHEN count(*) >= 4 THEN round(corr(value, event_id), 6) END AS correlation FROM events GROUP BY ALL""",
)
def g19(spark, sf_dir):
    pairs = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), "value", "event_id")
    return rounded(series.paired_corr(pairs, "value", "event_id", ["camera_id"]), "correlation")


@query(
    "e10_gauge_validation",
    fx.with_ctes(
        """SELECT camera_id, count(*) AS pairs, CASE WHEN count(*) >= 4 THEN round(corr(area_fraction, height), 6) END AS correlation
           FROM nearest WHERE height IS NOT NULL GROUP BY ALL""",
        extra=_NEAREST,
    ),
)
def e10(spark, sf_dir):
    from watchgrid.plans.experiments import gauge_validation

    seen, gauge = gauge_tables(spark, sf_dir)
    return rounded(gauge_validation(seen, gauge, ["camera_id"], 43_200, chunk_seconds=fx.MONTH), "correlation")


# Set operations and splits.


@query(
    "u01_union_of_results",
    fx.with_ctes(
        "SELECT hazard, camera_id, count(*) AS detections FROM detections GROUP BY ALL",
        "detections",
    ),
)
def u01(spark, sf_dir):
    """One result per hazard, put together."""
    det = fx.raw_detections(spark, sf_dir)
    parts = [
        det.filter(F.col("hazard") == h).groupBy("camera_id").agg(F.count("*").alias("detections")).withColumn("hazard", F.lit(h))
        for h in dims.HAZARDS
    ]
    return reduce(DataFrame.unionByName, parts)


_MANIFEST = """SELECT o_orderkey AS clip, CASE o_custkey % 6 WHEN 0 THEN 'fire' WHEN 1 THEN 'flood' WHEN 2 THEN 'traffic' WHEN 3 THEN 'drowning' ELSE 'building_access' END AS hazard,
    o_orderstatus = 'F' AND o_custkey % 6 NOT IN (2, 3) AS publishable, o_totalprice > 100000 AS temporal, o_orderpriority LIKE '1%' AS reference_only FROM orders"""


def manifest(spark, sf_dir):
    c = F.col("o_custkey") % 6
    hazard = F.when(c == 0, "fire").when(c == 1, "flood").when(c == 2, "traffic").when(c == 3, "drowning").otherwise("building_access")
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("clip"), hazard.alias("hazard"), ((F.col("o_orderstatus") == "F") & ~c.isin(2, 3)).alias("publishable"),
        (F.col("o_totalprice") > 100000).alias("temporal"), F.col("o_orderpriority").startswith("1").alias("reference_only"),
    )


@query(
    "p17_usable_clips",
    fx.with_ctes("SELECT clip, publishable AND temporal AND NOT reference_only AS demo_ready FROM manifest", extra={"manifest": _MANIFEST}),
)
def p17(spark, sf_dir):
    return reports.usable_clips(manifest(spark, sf_dir)).select("clip", "demo_ready")


@query(
    "u02_uncovered_hazards",
    fx.with_ctes(
        "SELECT hazard FROM manifest WHERE NOT reference_only EXCEPT SELECT hazard FROM manifest WHERE publishable", extra={"manifest": _MANIFEST}
    ),
)
def u02(spark, sf_dir):
    return reports.uncovered_hazards(manifest(spark, sf_dir))


@query(
    "u04_camera_folds",
    "SELECT camera_id, CASE WHEN row_number() OVER (ORDER BY camera_id) % 2 = 1 THEN 'A' ELSE 'B' END AS fold FROM (SELECT DISTINCT user_id AS camera_id FROM events)",
)
def u04(spark, sf_dir):
    cameras = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"))
    return sampling.camera_folds(cameras, scans.chunk_of(F.col("camera_id"), 65_536))


# The hash order is Spark's own, so SQL states the split by sizes alone.


@query(
    "u05_stratified_split",
    """SELECT lang, count(*) - greatest(1, floor(count(*) * 0.15)::BIGINT) AS training, greatest(1, floor(count(*) * 0.15)::BIGINT) AS validation
       FROM documents GROUP BY ALL""",
)
def u05(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    split = sampling.stratified_split(docs, "lang", 0.15, sampling.hash_order(7, "doc_id"))
    side = F.col("split")
    return split.groupBy("lang").agg(F.count(F.when(side == "training", 1)).alias("training"), F.count(F.when(side == "validation", 1)).alias("validation"))


@query(
    "u05_capped_split",
    """SELECT lang, least(100, floor(count(*) * 0.8)::BIGINT) AS training, least(40, count(*) - floor(count(*) * 0.8)::BIGINT) AS test FROM documents GROUP BY ALL""",
)
def u05_capped(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang")
    split = sampling.capped_split(
        docs, "lang", 100, F.col("doc_id"), sampling.hash_order(7, "doc_id"), scans.chunk_of(F.col("doc_id"), 65_536)
    )
    side = F.col("split")
    return split.groupBy("lang").agg(F.count(F.when(side == "training", 1)).alias("training"), F.count(F.when(side == "test", 1)).alias("test"))


@query("u06_distinct_sequences", "SELECT DISTINCT user_id || '_' || event_type AS sequence FROM events")
def u06(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return events.select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("sequence")).dropDuplicates()


@query(
    "g28_label_balance",
    """SELECT count(*) AS images, count(*) FILTER (p) AS positives, count(*) FILTER (NOT p) AS negatives, count(DISTINCT source) FILTER (p) AS positive_cameras,
         count(DISTINCT source) FILTER (NOT p) AS negative_cameras FROM (SELECT source, coalesce(toxic + quality > 0, false) AS p FROM documents LEFT JOIN labels USING (doc_id))""",
)
def g28(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "source").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    notes = F.when(F.col("toxic") + F.col("quality") > 0, F.lit("0 0.5 0.5 0.1 0.1")).when(F.col("quality").isNotNull(), F.lit(" "))
    return reports.label_balance(docs.select(F.col("doc_id").alias("image_id"), F.col("source").alias("camera_id"), notes.alias("annotations")))


# Result trees, histories and claims.


@query(
    "a09_flatten_results",
    """SELECT CAST(event_id AS VARCHAR) AS file, path, value FROM (
         SELECT event_id, 'event' AS path, event_type AS value FROM events
         UNION ALL SELECT event_id, 'conf_0.2|user', CAST(user_id AS VARCHAR) FROM events
         UNION ALL SELECT event_id, 'conf_0.2|k|0', CAST(json_extract(props, '$.k') AS VARCHAR) FROM events
         UNION ALL SELECT event_id, 'conf_0.2|k|1', 'x' FROM events)""",
)
def a09(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    tree = F.struct(
        F.col("event_type").alias("event"),
        F.struct(
            F.col("user_id").alias("user"),
            F.array(F.get_json_object("props", "$.k"), F.lit("x")).alias("k"),
        ).alias("conf_0.2"),
    )
    return results.flatten_results(events.select(F.col("event_id").cast("string").alias("file"), F.to_json(tree).alias("json")))


@query(
    "a09_dig",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id AS nested FROM events",
)
def a09_dig(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    tree = F.to_json(F.struct(F.struct(F.array(F.lit(0).cast("long"), F.col("user_id")).alias("conf_0.2")).alias("results")))
    return events.select(
        "event_id", results.dig(F.col("props"), "k").cast("long").alias("k"), results.dig(tree, "results|conf_0.2|1").cast("long").alias("nested")
    )


_HISTORY = "SELECT event_type AS run, user_id AS epoch, max(value) AS metric FROM events GROUP BY ALL"


def history(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("run"), F.col("user_id").alias("epoch")).agg(F.max("value").alias("metric"))


@query(
    "a12_history_best",
    fx.with_ctes(
        "SELECT run, max(metric) AS best_metric, arg_min(epoch, (-metric, epoch)) AS best_epoch, count(*) AS epochs FROM history GROUP BY ALL",
        extra={"history": _HISTORY},
    ),
)
def a12(spark, sf_dir):
    return results.history_summary(history(spark, sf_dir))[0]


@query(
    "a12_history_curve",
    fx.with_ctes(
        "SELECT run, epoch, metric, metric >= max(metric) OVER (PARTITION BY run) - 1e-9 AS is_best FROM history", extra={"history": _HISTORY}
    ),
)
def a12_curve(spark, sf_dir):
    return results.history_summary(history(spark, sf_dir))[1]


_CLAIMS = {
    "facts": "SELECT 'f' || user_id AS file, event_type AS path, avg(value) / 1000 AS value FROM events GROUP BY ALL",
    "claims": """SELECT 'model_' || user_id AS model, event_type AS figure,
          CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 17 = 0 THEN 'lost' || user_id ELSE 'f' || user_id END AS file,
          CASE WHEN user_id % 13 = 0 THEN 'nowhere' ELSE event_type END AS path,
          CASE WHEN user_id % 7 = 0 THEN NULL ELSE avg(value) / 1000 + (user_id % 5) * 0.0002 END AS claimed FROM events GROUP BY user_id, event_type""",
    "checked": """SELECT model, figure, coalesce(c.file, f.file) AS file, coalesce(c.path, f.path) AS path, claimed, value,
          CASE WHEN model IS NULL THEN 'unclaimed' WHEN c.file IS NULL THEN 'no_source_cited' WHEN claimed IS NULL THEN 'absent_from_registry'
          WHEN c.file NOT IN (SELECT file FROM facts) THEN 'file_absent' WHEN f.file IS NULL THEN 'path_absent'
          WHEN abs(claimed - value) > 5e-4 THEN 'mismatch' ELSE 'ok' END AS status
        FROM claims c FULL JOIN facts f ON f.file = c.file AND f.path = c.path""",
}


def claim_tables(spark, sf_dir):
    user = F.col("user_id")
    means = fx.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 1000).alias("mean"))
    file = F.concat(F.lit("f"), user.cast("string"))
    facts = means.select(file.alias("file"), F.col("event_type").alias("path"), F.col("mean").alias("value"))
    claims = means.select(
        F.concat(F.lit("model_"), user.cast("string")).alias("model"), F.col("event_type").alias("figure"), F.when(user % 11 == 0, None).when(user % 17 == 0, F.concat(F.lit("lost"), user.cast("string"))).otherwise(file).alias("file"),
        F.when(user % 13 == 0, "nowhere").otherwise(F.col("event_type")).alias("path"),
        F.when(user % 7 != 0, F.col("mean") + (user % 5) * 0.0002).alias("claimed"),
    )
    return claims, facts


@query(
    "j11_verify_claims",
    fx.with_ctes("SELECT model, figure, file, path, round(claimed, 6) AS claimed, round(value, 6) AS value, status FROM checked", extra=_CLAIMS),
)
def j11(spark, sf_dir):
    from watchgrid.plans.experiments import verify_claims

    return rounded(verify_claims(*claim_tables(spark, sf_dir)), "claimed", "value")


@query(
    "e08_audit_results",
    fx.with_ctes(
        """SELECT model, figure, file, path, status FROM checked WHERE status <> 'ok'
           UNION ALL SELECT model, NULL, NULL, NULL, 'cites_no_results_file' FROM models WHERE user_id % 3 > 0 AND user_id % 11 = 0
           UNION ALL SELECT model, NULL, NULL, NULL, 'names_no_harness' FROM models WHERE user_id % 3 > 0 AND user_id % 17 = 0""",
        extra={**_CLAIMS, "models": "SELECT DISTINCT user_id, 'model_' || user_id AS model FROM events"},
    ),
)
def e08(spark, sf_dir):
    from watchgrid.plans.experiments import audit_results

    user = F.col("user_id")
    models = fx.table(spark, sf_dir, "events").select("user_id").distinct().select(
        F.concat(F.lit("model_"), user.cast("string")).alias("model"),
        F.when(user % 3 == 1, "measured").when(user % 3 == 2, "validation_measured").otherwise("not_yet_measured").alias("status"),
        F.when(user % 11 != 0, "file").alias("results_file"),
        F.when(user % 17 != 0, "harness").alias("harness"),
    )
    return audit_results(*claim_tables(spark, sf_dir), models)


# Clips: per-frame class probabilities from vectors; fifty clips.

_PROBS = {
    "sums": """SELECT vec_id, list_transform(range(4), lambda c: list_sum(list_transform(range((len(embedding) - c + 3) // 4), lambda j: embedding[4 * j + c + 1]::DOUBLE))) AS s
        FROM embeddings""",
    "weights": "SELECT vec_id, vec_id % 50 AS clip, list_transform(s, lambda v: exp(v * 10)) AS w FROM sums",
    "probs": """SELECT clip, vec_id, unnest(['fire', 'flood', 'drowning', 'building_access']) AS class, unnest(list_transform(w, lambda v: v / list_sum(w))) AS probability FROM weights""",
}


def clip_probs(spark, sf_dir):
    def share(c: int):
        """Entries c, c + 4, c + 8, ... of the vector, added up."""
        mine = F.filter("embedding", lambda _, i: i % 4 == c)
        return F.aggregate(mine, F.lit(0.0), lambda total, v: total + v.cast("double")) * 10

    logits = F.array(*map(share, range(4)))
    probs = fx.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("clip"), softmax(logits).alias("p"))
    names = F.array(*[F.lit(c) for c in ("fire", "flood", "drowning", "building_access")])
    return probs.select("clip", F.inline(F.arrays_zip(names.alias("class"), F.col("p").alias("probability"))))


@query(
    "g22_route_clip",
    fx.with_ctes(
        """SELECT clip, class, certainty, rank, coalesce(rank = 1, false) AS suggested FROM (
             SELECT clip, class, round(avg(probability), 6) AS certainty, (row_number() OVER (PARTITION BY clip ORDER BY avg(probability) DESC, class))::INTEGER AS rank
             FROM probs GROUP BY clip, class
             UNION ALL SELECT DISTINCT clip, 'traffic', NULL, NULL FROM probs)""",
        extra=_PROBS,
    ),
)
def g22(spark, sf_dir):
    routed = reports.route_clip(clip_probs(spark, sf_dir))
    return rounded(routed.select("clip", "class", "certainty", "rank", "suggested"), "certainty")


@query(
    "g21_probe_scores",
    fx.with_ctes(
        """SELECT clip, hazard, frames_with_hits, hits, round(best, 9) AS best_confidence, round(m, 9) AS mean_confidence, round(frames_with_hits * m, 9) AS score,
             (row_number() OVER (PARTITION BY clip ORDER BY frames_with_hits * m DESC, hazard))::INTEGER AS rank FROM (
           SELECT clip, hazard, count(*) AS frames_with_hits, sum(n)::BIGINT AS hits, max(CASE WHEN hazard = 'flood' THEN cov / n ELSE mx END) AS best,
             CASE WHEN hazard = 'flood' THEN sum(cov / n) / count(*) ELSE sum(s) / sum(n) END AS m
           FROM (SELECT camera_id AS clip, hazard, frame_index // 3 AS f, count(*) AS n, sum(confidence) AS s, max(confidence) AS mx, max(ts % 100 / 250) AS cov FROM detections GROUP BY ALL)
           WHERE hazard <> 'flood' OR cov > 0.05 GROUP BY clip, hazard)""",
        "detections",
    ),
)
def g21(spark, sf_dir):
    det = fx.detections(spark, sf_dir)
    hits = det.select(
        F.col("camera_id").alias("clip"), "hazard", F.floor(F.col("frame_index") / 3).alias("frame_index"), "confidence", (F.col("ts") % 100 / 250).alias("coverage")
    )
    scores = reports.probe_scores(hits)
    return scores.withColumns({n: F.round(n, 9) for n in ("best_confidence", "mean_confidence", "score")})


@query(
    "g23_clip_reports",
    cascade(
        """SELECT camera_id, count(*) AS proposed, count(*) FILTER (rejected_by IN ('confidence', 'persistence')) AS filtered,
             count(*) FILTER (rejected_by = 'cooldown') AS deduplicated, count(*) FILTER (rejected_by IS NULL) AS confirmed, count(*) AS frames_examined
           FROM annotated GROUP BY ALL"""
    ),
)
def g23(spark, sf_dir):
    det = fx.stored_detections(spark, sf_dir)
    rows = validate(det, DEFAULTS)
    return reports.clip_report(fx.frames(det), rows, confirmed_events(rows))


@query(
    "g23_clip_findings",
    cascade(
        """SELECT camera_id, hazard, frame_index AS confirmed_frame, round(peak, 6) AS confidence, hits AS supporting, round(x1 / 640, 9) AS nx1, round(y2 / 480, 9) AS ny2
           FROM confirmed_rows JOIN (SELECT det_seq, x1, y2 FROM detections) USING (det_seq)""",
        extra=_EVENTS,
    ),
)
def g23_findings(spark, sf_dir):
    det = fx.stored_detections(spark, sf_dir)
    sizes = det.select("camera_id", "frame_index").distinct().withColumns({"width": F.lit(640), "height": F.lit(480)})
    found = reports.clip_findings(confirmed_events(validate(det, DEFAULTS)), sizes)
    return found.select(
        "camera_id", "hazard", "confirmed_frame", r6("confidence").alias("confidence"), "supporting", F.round("nx1", 9).alias("nx1"), F.round("ny2", 9).alias("ny2")
    )


def continuity(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 50).alias("sequence"), F.col("vec_id").alias("pos"), F.transform("embedding", lambda v: v.cast("double")).alias("hist"), "label"
    )
    return series.continuity(vectors.drop("label"), vectors.filter("label = 0").select("pos", "hist"), number=F.col("sequence"))


@query(
    "g20_continuity",
    """WITH h AS (SELECT vec_id % 50 AS sequence, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS n FROM embeddings),
            seen AS (SELECT * FROM h WHERE n <= 24),
            steps AS (SELECT b.sequence, b.n, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM seen a JOIN seen b ON b.sequence = a.sequence AND b.n = a.n + 1),
            adjacent AS (SELECT sequence, count(*) + 1 AS frames, median(r) AS adjacent FROM (SELECT sequence, n, corr(x, y) AS r FROM steps GROUP BY ALL) GROUP BY sequence),
            outside AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS o FROM embeddings WHERE label = 0 QUALIFY o <= 12),
            draws AS (SELECT sequence, d, (7 * sequence + 5 * d) % count(*) + 1 AS n, (3 * sequence + 11 * d) % 12 + 1 AS o FROM seen, range(1, 13) t(d) GROUP BY sequence, d),
            drawn AS (SELECT draws.sequence, d, unnest(seen.embedding)::DOUBLE AS x, unnest(outside.embedding)::DOUBLE AS y
                      FROM draws JOIN seen ON seen.sequence = draws.sequence AND seen.n = draws.n JOIN outside ON outside.o = draws.o),
            apart AS (SELECT sequence, median(r) AS unrelated FROM (SELECT sequence, d, corr(x, y) AS r FROM drawn GROUP BY ALL) GROUP BY sequence)
       SELECT sequence, frames, round(adjacent, 6) AS adjacent, round(unrelated, 6) AS unrelated, adjacent >= unrelated + 0.15 AS continuous
       FROM adjacent JOIN apart USING (sequence)""",
)
def g20(spark, sf_dir):
    return continuity(spark, sf_dir).select("sequence", "frames", r6("adjacent").alias("adjacent"), r6("unrelated").alias("unrelated"), "continuous")


@query(
    "g20_adjacent_similarity",
    """WITH h AS (SELECT vec_id % 50 AS sequence, vec_id, embedding, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS n FROM embeddings),
            steps AS (SELECT b.sequence, b.n, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y
                      FROM h a JOIN h b ON b.sequence = a.sequence AND b.n = a.n + 1 WHERE b.n <= 24)
       SELECT sequence, count(*) + 1 AS frames, round(median(r), 6) AS adjacent FROM (SELECT sequence, n, corr(x, y) AS r FROM steps GROUP BY ALL) GROUP BY sequence""",
)
def g20_adjacent(spark, sf_dir):
    return continuity(spark, sf_dir).select("sequence", "frames", r6("adjacent").alias("adjacent"))


@query(
    "st07_event_windows",
    cascade(
        """SELECT hazard, time_bucket(INTERVAL 1 DAY, make_timestamp((ts * 1000000)::BIGINT), TIMESTAMP '1970-01-01') AS window_start, count(*) AS events,
             round(max(peak), 6) AS peak FROM confirmed_rows GROUP BY ALL""",
        extra=_EVENTS,
    ),
)
def st07(spark, sf_dir):
    stamp = F.expr("TIMESTAMPADD(MICROSECOND, CAST(round(confirmed_time * 1000000) AS BIGINT), TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    events = confirmed_events(validate(fx.stored_detections(spark, sf_dir), DEFAULTS)).withColumn("event_time", stamp)
    return reports.event_windows(events, "1 day").select("hazard", "window_start", "events", r6("peak").alias("peak"))


@query(
    "st07_event_sessions",
    cascade(
        """SELECT hazard, make_timestamp((min(ts) * 1000000)::BIGINT) AS window_start, count(*) AS events FROM (
             SELECT *, sum(fresh) OVER (PARTITION BY hazard ORDER BY ts, det_seq) AS s FROM (
               SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY hazard ORDER BY ts, det_seq) <= 21600 THEN 0 ELSE 1 END AS fresh FROM confirmed_rows))
           GROUP BY hazard, s""",
        extra=_EVENTS,
    ),
)
def st07_sessions(spark, sf_dir):
    stamp = F.expr("TIMESTAMPADD(MICROSECOND, CAST(round(confirmed_time * 1000000) AS BIGINT), TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    events = confirmed_events(validate(fx.stored_detections(spark, sf_dir), DEFAULTS)).withColumn("event_time", stamp)
    return reports.event_sessions(events, "6 hours").select("hazard", "window_start", "events")
