"""Registered queries: scalar and SQL-callable functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6
from watchgrid.functions import stats
from watchgrid.functions.sqlfuncs import register_sql_functions


@query(
    "x01_softmax",
    """SELECT vec_id, round(list_max(p), 6) AS top, round(list_sum(p), 6) AS total FROM (SELECT vec_id, list_transform(e, lambda v: v / list_sum(e)) AS p
       FROM (SELECT vec_id, list_transform(embedding, lambda v: exp(v::DOUBLE)) AS e FROM embeddings))""",
)
def x01(spark, sf_dir):
    p = stats.softmax(F.transform("embedding", lambda v: v.cast("double")))
    rows = fx.table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("vec_id", r6(F.array_max("p")).alias("top"), r6(total).alias("total"))


@query("x02_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value / 100 - 1))), 6) AS score FROM events")
def x02(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select("event_id", r6(stats.sigmoid(F.col("value") / 100 - 1)).alias("score"))


@query(
    "x03_safe_ratio",
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE round(value / (event_id % 4), 6) END AS ratio FROM events",
)
def x03(spark, sf_dir):
    ratio = stats.safe_ratio(F.col("value"), F.col("event_id") % 4)
    return fx.table(spark, sf_dir, "events").select("event_id", r6(ratio).alias("ratio"))


@query(
    "x04_drift_false_alarm_floor",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE round(exp(-2 * 0.005 * 0.1 / (s * s)), 6) END AS floor FROM (SELECT event_id, (event_id % 10) / 200 AS s FROM events)",
)
def x04(spark, sf_dir):
    sigma = F.col("event_id") % 10 / 200
    return fx.table(spark, sf_dir, "events").select("event_id", r6(stats.drift_false_alarm_floor(0.005, 0.10, sigma)).alias("floor"))


@query(
    "x05_linspace",
    "SELECT event_id, list_transform(range(5), lambda i: round(value + (event_id - value) * (i / 4), 6)) AS points FROM events",
)
def x05(spark, sf_dir):
    points = stats.linspace(F.col("value"), F.col("event_id").cast("double"), 5)
    return fx.table(spark, sf_dir, "events").select("event_id", F.transform(points, lambda v: F.round(v, 6)).alias("points"))


@query("x06_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS best FROM embeddings")
def x06(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", stats.argmax(F.col("embedding")).alias("best"))


@query(
    "x07_array_corr",
    """SELECT a.vec_id, round(corr(x, y), 6) AS r FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a
       JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS i FROM embeddings) b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY ALL""",
)
def x07(spark, sf_dir):
    vectors = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return vectors.join(after, "vec_id").select("vec_id", r6(stats.array_corr(F.col("a"), F.col("b"))).alias("r"))


@query("x08_persistence_delay", "SELECT event_id, round((event_id % 6) / (1 + event_id % 30), 6) AS delay FROM events")
def x08(spark, sf_dir):
    n, fps = F.col("event_id") % 6 + 1, F.col("event_id") % 30 + 1
    return fx.table(spark, sf_dir, "events").select("event_id", r6(stats.persistence_delay(n, fps)).alias("delay"))


@query(
    "ux01_sql_functions",
    fx.with_ctes(
        f"""SELECT image_id, det_seq, round((x2 - x1) * (y2 - y1), 6) AS area, round({fx.iou_sql('b', 'm')}, 6) AS iou,
              round(5 * confidence * 0.5 / (4 * confidence + 0.5), 6) AS f2
            FROM boxes b, LATERAL (SELECT b.x1 + 2 AS x1, b.y1 + 2 AS y1, b.x2 + 2 AS x2, b.y2 + 2 AS y2) m""".replace(
            "SELECT image_id, det_seq, round((x2 - x1) * (y2 - y1), 6)", "SELECT b.image_id, b.det_seq, round((b.x2 - b.x1) * (b.y2 - b.y1), 6)"
        ),
        "lines",
        "boxes",
    ),
)
def ux01(spark, sf_dir):
    register_sql_functions(spark)
    return fx.boxes(spark, sf_dir).selectExpr(
        "image_id",
        "det_seq",
        "round(box_area(box), 6) AS area",
        "round(box_iou(box, named_struct('x1', box.x1 + 2, 'y1', box.y1 + 2, 'x2', box.x2 + 2, 'y2', box.y2 + 2)), 6) AS iou",
        "round(f_beta(confidence, 0.5D, 2D), 6) AS f2",
    )


@query(
    "ux02_sql_table_functions",
    "SELECT o_custkey AS clip, n AS total, unnest(list_transform(range(6), lambda i: floor(n * (i + 0.5) / 6)::BIGINT)) AS position FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)",
)
def ux02(spark, sf_dir):
    register_sql_functions(spark)
    totals = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("clip")).agg(F.count("*").alias("total"))
    picks = totals.selectExpr("clip", "total", "even_picks(total, 6) AS positions")
    return picks.select("clip", "total", F.explode("positions").alias("position"))


@query("ux04_scoring_hook", "SELECT user_id AS camera_id, event_id AS det_seq, round(least(value / 50, 1.0), 6) AS confidence FROM events")
def ux04(spark, sf_dir):
    """A user's detector as a function over Arrow batches of frame references."""
    import pyarrow.compute as pc
    import pyarrow as pa

    frames = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("camera_id"), F.col("event_id").alias("det_seq"), "value")

    def score(batches):
        for batch in batches:
            scores = pc.min_element_wise(pc.divide(batch.column("value"), 50.0), pa.scalar(1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("camera_id"), batch.column("det_seq"), pc.round(scores, 6)], names=["camera_id", "det_seq", "confidence"]
            )

    return frames.mapInArrow(score, "camera_id long, det_seq long, confidence double")
