"""Views over the given tables that play the part of camera data, in Spark and as the same expressions in SQL.

Every view covers its whole table. The SQL texts are CTE bodies for ``with_ctes``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from watchgrid.functions.geometry import make_box
from watchgrid.operators import scans
from watchgrid.operators.cascade import ValidatorConfig, default_configs
from watchgrid.session import cut_lineage, ensure_checkpoint_dir
from watchgrid.sources.detections import epoch_seconds

#: Events lie hours to days apart, so chunks are months and the cooldown is days.
MONTH = 30 * 86_400.0
COOLDOWN = 259_200.0

_HAZARD_OF = {
    "click": "traffic",
    "error": "fire",
    "purchase": "flood",
    "signup": "building_access",
    "view": "drowning",
}
_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{h}'" for e, h in _HAZARD_OF.items()) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder on the storage that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/watchgrid-{uuid.uuid4().hex}"


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` behind the named fixture CTEs (in dependency order) and any extra ones."""
    parts = [f"{n} AS ({SQL[n]})" for n in names]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


SQL: dict[str, str] = {}

# Detections: one per frame, on four disjoint cells.

SQL["detections"] = f"""
    SELECT user_id AS camera_id, {_CASE} AS hazard, event_id AS det_seq, epoch_us(ts) / 1e6 AS ts,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS frame_index,
           least(value / 100, 1.0) AS confidence, event_id % 4 AS cell,
           CAST(event_id % 4 * 100 AS DOUBLE) AS x1, 0.0::DOUBLE AS y1,
           CAST(event_id % 4 * 100 + 60 AS DOUBLE) AS x2, 60.0::DOUBLE AS y2
    FROM events"""


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without the frame number, which alone needs an order."""
    cell = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("camera_id"),
        F.expr(_CASE).alias("hazard"),
        F.col("event_id").alias("det_seq"),
        epoch_seconds(F.col("ts")).alias("ts"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        cell.alias("cell"),
        (cell * 100).cast("double").alias("x1"),
        F.lit(0.0).alias("y1"),
        (cell * 100 + 60).cast("double").alias("x2"),
        F.lit(60.0).alias("y2"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = scans.chunk_of(F.col("ts"), MONTH)
    order = [F.col("ts"), F.col("det_seq")]
    return scans.ordinal(raw_detections(spark, sf_dir), ["camera_id", "hazard"], chunk, order, "frame_index")


def stored_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered detections as a written table, which is what a deployment keeps; plans below read it twice."""
    return cut_lineage(detections(spark, sf_dir))


SQL["frames"] = "SELECT DISTINCT camera_id, hazard, frame_index, ts FROM detections"


def frames(det: DataFrame) -> DataFrame:
    """One detection per frame, so frames are the detections without their findings."""
    return det.select("camera_id", "hazard", "frame_index", "ts")


# Event-relative sequences: the middle frame is the event.

SQL["sequences"] = """
    SELECT d.*, d.ts - m.ts AS "offset" FROM detections d
    JOIN (SELECT camera_id, hazard, count(*) AS n FROM detections GROUP BY ALL) c USING (camera_id, hazard)
    JOIN detections m ON m.camera_id = d.camera_id AND m.hazard = d.hazard AND m.frame_index = c.n // 2 + 1"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = detections(spark, sf_dir)
    key = ["camera_id", "hazard"]
    middle = det.groupBy(*key).agg((F.floor(F.count("*") / 2) + 1).alias("frame_index"))
    at = det.join(middle, [*key, "frame_index"], "left_semi").select(*key, F.col("ts").alias("_event_ts"))
    return det.join(at, key).withColumn("offset", F.col("ts") - F.col("_event_ts")).drop("_event_ts")


def cascade_configs() -> list[ValidatorConfig]:
    """The per-hazard defaults with the fixture's cooldown."""
    return default_configs(cooldown_seconds=COOLDOWN)


def cascade_sql(configs: Sequence[ValidatorConfig], source: str = "detections", carry: Sequence[str] = ()) -> dict[str, str]:
    """CTEs ending in ``annotated``: the cascade on the disjoint cells as a recursion over each cell's detections.
    Boxes overlap fully or not at all, so each cell has at most one live track."""

    def value(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    fields = (
        "config_id", "hazard", "enable_confidence", "min_confidence", "enable_persistence", "min_frames", "max_misses",
        "low_confidence_association", "association_floor", "enable_cooldown", "cooldown_seconds",
    )
    rows = ", ".join("(" + ", ".join(value(getattr(c, f)) for f in fields) + ")" for c in configs)
    extra = "".join(f", d.{c}" for c in carry)
    return {
        f"configs({', '.join('c_hazard' if f == 'hazard' else f for f in fields)})": f"VALUES {rows}",
        "proposals": f"""
            SELECT c.*, d.camera_id, d.hazard, d.det_seq, d.frame_index, d.ts, d.confidence, d.cell{extra},
                   NOT enable_confidence OR d.confidence >= min_confidence AS strong
            FROM {source} d JOIN configs c ON c.c_hazard IS NULL OR c.c_hazard = d.hazard""",
        "seen": """
            SELECT *, row_number() OVER (PARTITION BY config_id, camera_id, hazard, cell ORDER BY frame_index) AS n
            FROM proposals WHERE strong OR (low_confidence_association AND confidence >= association_floor)""",
        "walk": """
            SELECT config_id, camera_id, hazard, cell, n, det_seq, strong,
                   CASE WHEN strong THEN frame_index END AS seen_at,
                   CASE WHEN strong THEN 1 ELSE 0 END AS hits,
                   CASE WHEN strong THEN confidence END AS peak,
                   CASE WHEN strong THEN frame_index END AS first_frame,
                   CASE WHEN strong THEN ts END AS first_ts,
                   strong AND (NOT enable_persistence OR min_frames <= 1) AS credible,
                   false AS cooling,
                   CASE WHEN strong AND (NOT enable_persistence OR min_frames <= 1) THEN ts END AS alarmed_ts
            FROM seen WHERE n = 1
            UNION ALL
            SELECT config_id, camera_id, hazard, cell, n, det_seq, strong, seen_at, hits, peak, first_frame, first_ts,
                   credible, cooling,
                   CASE WHEN credible AND NOT cooling THEN ts ELSE alarmed_before END
            FROM (
              SELECT *, strong AND (NOT enable_persistence OR hits >= min_frames) AS credible,
                     coalesce(enable_cooldown AND ts - alarmed_before <= cooldown_seconds, false) AS cooling
              FROM (
                SELECT s.*, w.alarmed_ts AS alarmed_before,
                  CASE WHEN s.strong THEN s.frame_index
                       WHEN s.frame_index - w.seen_at <= s.max_misses THEN s.frame_index ELSE w.seen_at END AS seen_at,
                  CASE WHEN NOT s.strong THEN w.hits
                       WHEN s.frame_index - w.seen_at <= s.max_misses + 1 THEN w.hits + 1 ELSE 1 END AS hits,
                  CASE WHEN NOT s.strong THEN w.peak
                       WHEN s.frame_index - w.seen_at <= s.max_misses + 1 THEN greatest(w.peak, s.confidence)
                       ELSE s.confidence END AS peak,
                  CASE WHEN NOT s.strong THEN w.first_frame
                       WHEN s.frame_index - w.seen_at <= s.max_misses + 1 THEN w.first_frame
                       ELSE s.frame_index END AS first_frame,
                  CASE WHEN NOT s.strong THEN w.first_ts
                       WHEN s.frame_index - w.seen_at <= s.max_misses + 1 THEN w.first_ts ELSE s.ts END AS first_ts
                FROM walk w JOIN seen s ON s.config_id = w.config_id AND s.camera_id = w.camera_id
                  AND s.hazard = w.hazard AND s.cell = w.cell AND s.n = w.n + 1))""",
        "tracked": """
            SELECT *, dense_rank() OVER (PARTITION BY config_id, camera_id, hazard ORDER BY first_frame) AS track
            FROM walk WHERE strong""",
        "annotated": f"""
            SELECT d.config_id, d.camera_id, d.hazard, d.det_seq, d.frame_index, d.ts, d.confidence, d.cell{extra},
                   CASE WHEN NOT d.strong THEN 'confidence' WHEN NOT credible THEN 'persistence'
                        WHEN cooling THEN 'cooldown' END AS rejected_by,
                   track, CASE WHEN d.strong THEN hits::BIGINT END AS hits, CASE WHEN d.strong THEN peak END AS peak,
                   CASE WHEN d.strong THEN first_frame END AS first_frame, CASE WHEN d.strong THEN first_ts END AS first_ts
            FROM proposals d LEFT JOIN tracked t ON t.config_id = d.config_id AND t.det_seq = d.det_seq""",
    }


# Cameras.

_CONTEXT_NAMES = [
    "forest", "wildland_interface", "street", "urban_block", "river", "coast", "motorway", "earthquake_zone", "uav_search",
]

SQL["contexts"] = """
    SELECT * FROM (VALUES ('forest', ['fire'], 'oblique'), ('wildland_interface', ['fire', 'traffic'], 'oblique'),
      ('street', ['flood', 'traffic', 'building_access'], 'oblique'), ('urban_block', ['flood', 'building_access'], 'oblique'),
      ('river', ['flood', 'drowning'], 'oblique'), ('coast', ['drowning'], 'oblique'), ('motorway', ['traffic'], 'oblique'),
      ('earthquake_zone', ['building_access'], 'nadir_aerial'), ('uav_search', ['building_access', 'drowning'], 'nadir_aerial')
    ) AS t(context, context_hazards, default_viewpoint)"""

SQL["envelope"] = """
    SELECT * FROM (VALUES ('fire', 'ground', 'fire'), ('fire', 'oblique', 'fire'), ('flood', 'ground', 'flood'),
      ('flood', 'oblique', 'flood'), ('flood', 'nadir_aerial', 'flood_aerial'), ('traffic', 'ground', 'traffic'),
      ('traffic', 'oblique', 'traffic'), ('drowning', 'oblique', 'person_in_water'),
      ('drowning', 'nadir_aerial', 'person_in_water'), ('building_access', 'oblique', 'building_access'),
      ('building_access', 'nadir_aerial', 'building_access')) AS t(hazard, viewpoint, model)"""

_CONTEXT_PICK = "[" + ", ".join(f"'{c}'" for c in _CONTEXT_NAMES) + "]"
SQL["cameras"] = f"""
    SELECT camera_id, CASE camera_id % 5 WHEN 0 THEN 'clips/cam_' || camera_id || '.mp4' WHEN 1 THEN 'rtsp://cam/' || camera_id
             WHEN 2 THEN CAST(camera_id AS VARCHAR) WHEN 3 THEN 'usgs://site_' || camera_id ELSE 'https://c.example/' || camera_id || '.JPG?x=1' END AS source,
           {_CONTEXT_PICK}[CAST(camera_id % 9 + 1 AS INT)] AS context,
           CASE WHEN camera_id % 11 = 0 THEN ['fire', 'drowning'] END AS hazards,
           CASE WHEN camera_id % 13 = 0 THEN 'nadir_aerial' END AS viewpoint,
           camera_id % 7 <> 0 AS enabled
    FROM (SELECT DISTINCT user_id AS camera_id FROM events)"""

SQL["resolved"] = """
    SELECT c.*, coalesce(hazards, context_hazards) AS active_hazards, coalesce(viewpoint, default_viewpoint) AS active_viewpoint
    FROM cameras c JOIN contexts USING (context)"""
SQL["gate"] = """
    SELECT camera_id, context, unnest(active_hazards) AS hazard, active_viewpoint AS viewpoint FROM resolved WHERE enabled"""
GATE = ("contexts", "cameras", "resolved", "gate")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id")).distinct()
    camera = F.col("camera_id")
    text = camera.cast("string")
    source = (
        F.when(camera % 5 == 0, F.concat(F.lit("clips/cam_"), text, F.lit(".mp4")))
        .when(camera % 5 == 1, F.concat(F.lit("rtsp://cam/"), text))
        .when(camera % 5 == 2, text)
        .when(camera % 5 == 3, F.concat(F.lit("usgs://site_"), text))
        .otherwise(F.concat(F.lit("https://c.example/"), text, F.lit(".JPG?x=1")))
    )
    contexts = F.array(*[F.lit(c) for c in _CONTEXT_NAMES])
    return ids.select(
        "camera_id",
        source.alias("source"),
        F.get(contexts, (camera % 9).cast("int")).alias("context"),
        F.when(camera % 11 == 0, F.array(F.lit("fire"), F.lit("drowning"))).alias("hazards"),
        F.when(camera % 13 == 0, F.lit("nadir_aerial")).alias("viewpoint"),
        (camera % 7 != 0).alias("enabled"),
    )


# Series. Divisors are primes, so that values do not end where rounding ties.

SQL["signal"] = """
    SELECT user_id AS camera_id, event_id AS seq, epoch_us(ts) / 1e6 AS ts, value / 1013 AS value,
           least(value / 607, 1.0) AS area_fraction FROM events"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("camera_id"),
        F.col("event_id").alias("seq"),
        epoch_seconds(F.col("ts")).alias("ts"),
        (F.col("value") / 1013).alias("value"),
        F.least(F.col("value") / 607, F.lit(1.0)).alias("area_fraction"),
    )


# Boxes and masks from order lines; (order, line number) is not unique, so lines are aggregated first.

SQL["lines"] = """
    SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS pk, min(l_suppkey) AS sk, max(l_quantity) AS q,
           max(l_extendedprice) AS pr, min(l_returnflag) AS rf FROM lineitem GROUP BY ALL"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
        .agg(
            F.min("l_partkey").alias("pk"),
            F.min("l_suppkey").alias("sk"),
            F.max("l_quantity").alias("q"),
            F.max("l_extendedprice").alias("pr"),
            F.min("l_returnflag").alias("rf"),
        )
    )


SQL["boxes"] = """
    SELECT k AS image_id, n::BIGINT AS det_seq, (pk % 80)::DOUBLE AS x1, (sk * 37 % 60)::DOUBLE AS y1,
           pk % 80 + 20 + q AS x2, (sk * 37 % 60 + 20 + n * 5)::DOUBLE AS y2,
           (floor(pr) % 1000) / 1000 AS confidence, rf AS class FROM lines"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowded images: up to seven boxes on an 80 by 60 spread, so that many overlap."""
    x1 = (F.col("pk") % 80).cast("double")
    y1 = (F.col("sk") * 37 % 60).cast("double")
    return lines(spark, sf_dir).select(
        F.col("k").alias("image_id"),
        F.col("n").cast("long").alias("det_seq"),
        make_box(x1, y1, x1 + 20 + F.col("q"), y1 + 20 + F.col("n") * 5).alias("box"),
        (F.floor("pr") % 1000 / 1000).cast("double").alias("confidence"),
        F.col("rf").alias("class"),
    )


# Every box is predicted: those of even number to the side of the truth, every third one as another class.
SQL["pred"] = """
    SELECT image_id, det_seq, x1 + (det_seq + 1) % 2 * 30 AS x1, y1, x2 + (det_seq + 1) % 2 * 30 AS x2, y2, confidence,
           CASE WHEN det_seq % 3 = 0 THEN translate(class, 'ANR', 'NRA') ELSE class END AS class FROM boxes"""
SQL["truth"] = """
    SELECT image_id, det_seq AS truth_seq, x1 + 2 AS x1, y1 + 2 AS y1, x2 + 2 AS x2, y2 + 2 AS y2, class FROM boxes"""
SQL["images"] = "SELECT o_orderkey AS image_id FROM orders"


def _by_class_sql(rows: str) -> str:
    return f"SELECT * REPLACE (image_id * 3 + strpos('ANR', class) - 1 AS image_id) FROM ({rows})"


#: The same tables with an image and a class as one key, so that keys without truth exist.
BY_CLASS = {
    "boxes": _by_class_sql(SQL["boxes"]),
    "pred": _by_class_sql(SQL["pred"].replace("FROM boxes", f"FROM ({SQL['boxes']})")),
    "truth": SQL["truth"],
    "images": "SELECT o_orderkey * 3 + c AS image_id FROM orders CROSS JOIN range(3) AS t(c)",
}


def by_class(rows: DataFrame) -> DataFrame:
    return rows.withColumn("image_id", F.col("image_id") * 3 + F.expr("instr('ANR', class)") - 1)


def each_class(rows: DataFrame) -> DataFrame:
    """Rows that know no class, once for each."""
    return rows.withColumn("_c", F.explode(F.array(*map(F.lit, range(3))))).withColumn("image_id", F.col("image_id") * 3 + F.col("_c")).drop("_c")


def predictions_of(rows: DataFrame) -> DataFrame:
    box, side = F.col("box"), (F.col("det_seq") + 1) % 2 * 30
    moved = make_box(box["x1"] + side, box["y1"], box["x2"] + side, box["y2"])
    taken = F.when(F.col("det_seq") % 3 == 0, F.translate("class", "ANR", "NRA")).otherwise(F.col("class"))
    return rows.withColumns({"box": moved, "class": taken})


def truth_of(rows: DataFrame) -> DataFrame:
    box = F.col("box")
    moved = make_box(box["x1"] + 2, box["y1"] + 2, box["x2"] + 2, box["y2"] + 2)
    return rows.select("image_id", F.col("det_seq").alias("truth_seq"), moved.alias("box"), "class")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_of(boxes(spark, sf_dir))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth_of(boxes(spark, sf_dir))


def stored_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, truth) over boxes written once, as an evaluation would find them."""
    rows = cut_lineage(boxes(spark, sf_dir))
    return predictions_of(rows), truth_of(rows)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))


#: IoU of boxes a and b held in flat columns, for SQL.
IOU_SQL = """(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))
 / nullif((({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)) + (({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))
  - (greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))), 0)"""


def iou_sql(a: str, b: str) -> str:
    return "coalesce(" + IOU_SQL.format(a=a, b=b) + ", 0)"


def nms_sql(source: str, limit: float, keep_equal: bool, key: str = "image_id") -> dict[str, str]:
    """CTEs ending in ``kept``: greedy suppression as a recursion over each image's ranks."""
    clash = f"{iou_sql('o', 'r')} {'>' if keep_equal else '>='} {limit}"
    return {
        "ranked": f"""
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, det_seq) AS rk FROM {source}""",
        "chosen": f"""
            SELECT {key}, 1::BIGINT AS rk, [{{'s': det_seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept
            FROM ranked WHERE rk = 1
            UNION ALL
            SELECT c.{key}, r.rk, CASE WHEN len(list_filter(c.kept, lambda o: {clash})) > 0 THEN c.kept
              ELSE list_append(c.kept, {{'s': r.det_seq, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END
            FROM chosen c JOIN ranked r ON r.{key} = c.{key} AND r.rk = c.rk + 1""",
        "kept": f"""
            SELECT {key}, unnest(list_transform(arg_max(kept, rk), lambda o: o.s)) AS det_seq FROM chosen GROUP BY {key}""",
    }


def match_sql(pred: str, truth_: str, limit: float, key: str = "image_id") -> dict[str, str]:
    """CTEs ending in ``matched``: greedy claims as a recursion over each image's ranked predictions."""
    return {
        "ranked_pred": f"""
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, det_seq) AS rk FROM {pred}""",
        "listed": f"""
            SELECT {key}, list({{'t': truth_seq, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY truth_seq) AS ts
            FROM {truth_} GROUP BY {key}""",
        "rated": f"""
            SELECT p.{key}, p.rk, p.det_seq, p.confidence,
              list_sort(list_filter(list_transform(coalesce(l.ts, []), lambda o: {{'v': -{iou_sql('p', 'o')}, 't': o.t}}),
                lambda m: -m.v > 0 AND -m.v >= {limit})) AS options
            FROM ranked_pred p LEFT JOIN listed l USING ({key})""",
        "claims": f"""
            SELECT {key}, rk, det_seq, confidence, options[1].t AS truth_seq, -options[1].v AS match_iou,
                   CASE WHEN len(options) > 0 THEN [options[1].t] ELSE [] END AS taken
            FROM rated WHERE rk = 1
            UNION ALL
            SELECT {key}, rk, det_seq, confidence, free[1].t, -free[1].v,
                   CASE WHEN len(free) > 0 THEN list_append(taken, free[1].t) ELSE taken END
            FROM (SELECT r.{key}, r.rk, r.det_seq, r.confidence, c.taken,
                         list_filter(r.options, lambda m: NOT list_contains(c.taken, m.t)) AS free
                  FROM claims c JOIN rated r ON r.{key} = c.{key} AND r.rk = c.rk + 1)""",
        "matched": f"SELECT {key}, det_seq, confidence, truth_seq, match_iou FROM claims",
    }


# Masks: one run per (frame, row) on a canvas of 163 by 8.

SQL["mask_runs"] = """
    SELECT k AS frame_index, k % 50 AS camera_id, n::BIGINT AS y, pk % 100 AS x0, pk % 100 + q::BIGINT AS x1 FROM lines"""
SQL["mask_frames"] = """
    SELECT o_orderkey AS frame_index, o_orderkey % 50 AS camera_id, o_orderkey * 60.0 AS ts, 163 AS width, 8 AS height FROM orders"""


def mask_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        F.col("k").alias("frame_index"),
        (F.col("k") % 50).alias("camera_id"),
        F.col("n").cast("long").alias("y"),
        (F.col("pk") % 100).alias("x0"),
        (F.col("pk") % 100 + F.col("q").cast("long")).alias("x1"),
    )


def mask_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("frame_index"),
        (key % 50).alias("camera_id"),
        (key * 60.0).alias("ts"),
        F.lit(163).alias("width"),
        F.lit(8).alias("height"),
    )


SQL["ref_lines"] = """
    SELECT camera_id, 20.0 + camera_id AS top_x, 0.0 AS top_y, 20.0 + camera_id AS bottom_x, 7.0 AS bottom_y,
           CASE WHEN camera_id % 2 = 0 THEN 3.0::DOUBLE END AS metres FROM (SELECT DISTINCT camera_id FROM mask_frames)"""


def reference_lines(frames_: DataFrame) -> DataFrame:
    camera = F.col("camera_id")
    return frames_.select("camera_id").distinct().select(
        "camera_id",
        (camera + 20.0).alias("top_x"),
        F.lit(0.0).alias("top_y"),
        (camera + 20.0).alias("bottom_x"),
        F.lit(7.0).alias("bottom_y"),
        F.when(camera % 2 == 0, F.lit(3.0)).alias("metres"),
    )
