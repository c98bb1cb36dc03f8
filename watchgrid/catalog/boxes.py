"""Registered queries: box algebra, decoding, suppression of overlaps, matching, and box-level metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.registry import query, r6, rounded
from watchgrid.functions import geometry as geo
from watchgrid.functions.stats import upper_median
from watchgrid.operators import detect, metrics, overlap, reports, sampling
from watchgrid.operators.medians import exact_medians
from watchgrid.plans import experiments
from watchgrid.session import cut_lineage
from watchgrid.sources import dims, truth as truths

BOXES = ("lines", "boxes")
PAIRS = ("lines", "boxes", "pred", "truth")
BOX_COLUMNS = ("x1", "y1", "x2", "y2")


def flat(column: str = "box"):
    return [r6(f"{column}.{c}").alias(c) for c in BOX_COLUMNS]


@query(
    "p01_box_algebra",
    fx.with_ctes(
        """SELECT image_id, det_seq, round(x2 - x1, 6) AS width, round(y2 - y1, 6) AS height, round((x2 - x1) * (y2 - y1), 6) AS area,
             round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM boxes""",
        *BOXES,
    ),
)
def p01(spark, sf_dir):
    box = F.col("box")
    return fx.boxes(spark, sf_dir).select(
        "image_id", "det_seq", r6(geo.box_width(box)).alias("width"), r6(geo.box_height(box)).alias("height"),
        r6(geo.box_area(box)).alias("area"), r6(geo.box_centre(box)["x"]).alias("cx"), r6(geo.box_centre(box)["y"]).alias("cy"),
    )


@query(
    "p02_iou",
    fx.with_ctes(
        f"SELECT p.image_id, p.det_seq, round({fx.iou_sql('p', 't')}, 6) AS iou FROM pred p JOIN truth t ON t.image_id = p.image_id AND t.truth_seq = p.det_seq",
        *PAIRS,
    ),
)
def p02(spark, sf_dir):
    truth = fx.truth(spark, sf_dir).select("image_id", F.col("truth_seq").alias("det_seq"), F.col("box").alias("t"))
    joined = fx.predictions(spark, sf_dir).join(truth, ["image_id", "det_seq"])
    return joined.select("image_id", "det_seq", r6(geo.iou(F.col("box"), F.col("t"))).alias("iou"))


@query(
    "p03_box_conversions",
    fx.with_ctes(
        """SELECT image_id, det_seq, round(least(greatest(((x1 - x2 / 2) - 4) / 0.5, 0), 64), 6) AS x1,
             round(least(greatest(((y1 - y2 / 2) - 8) / 0.5, 0), 48), 6) AS y1,
             round(least(greatest(((x1 + x2 / 2) - 4) / 0.5, 0), 64), 6) AS x2,
             round(least(greatest(((y1 + y2 / 2) - 8) / 0.5, 0), 48), 6) AS y2,
             round(x1 / 640 * 1280 + 3, 6) AS moved_x1, round((x1 + x2) / 640, 9) AS share_x2 FROM boxes""",
        *BOXES,
    ),
)
def p03(spark, sf_dir):
    b = F.col("box")
    centre = geo.from_centre_size(b["x1"], b["y1"], b["x2"], b["y2"])
    steps = (
        fx.boxes(spark, sf_dir)
        .withColumn("_c", centre)
        .withColumn("_u", geo.undo_padding(F.col("_c"), F.lit(0.5), 4, 8))
        .withColumn("clipped", geo.clip(F.col("_u"), 64, 48))
        .withColumn("_n", geo.normalise(b, 640, 480))
        .withColumn("_m", geo.offset(geo.denormalise(F.col("_n"), 1280, 960), 3, 0))
        .withColumn("_k", geo.normalise(geo.from_corner_size(b["x1"], b["y1"], b["x2"], b["y2"]), 640, 480))
    )
    return steps.select("image_id", "det_seq", *flat("clipped"), r6("_m.x1").alias("moved_x1"), F.round("_k.x2", 9).alias("share_x2"))


@query("p04_above_floor", fx.with_ctes("SELECT image_id, det_seq, confidence FROM boxes WHERE confidence >= 0.4", *BOXES))
def p04(spark, sf_dir):
    return detect.above_floor(fx.boxes(spark, sf_dir), 0.4).select("image_id", "det_seq", "confidence")


_MODEL_CLASS = "[" + ", ".join(f"'{c}'" for c in dims.BUILDING_MODEL_CLASSES) + "]"
_MERGE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{source}', '{target}')" for target, sources in dims.CLASS_MERGE.items() for source in sources
) + ") AS t(model_class, merged_class)"


def classed(spark, sf_dir):
    """Detections labelled with the building model's 28 classes."""
    return fx.lines(spark, sf_dir).select(
        F.col("k").alias("image_id"),
        F.col("n").cast("long").alias("det_seq"),
        detect.label_for(F.col("pk") % 30, dims.BUILDING_MODEL_CLASSES).alias("label"),
    )


_CLASSED = {
    "classed": f"""SELECT k AS image_id, n::BIGINT AS det_seq, CASE WHEN pk % 30 < 28 THEN {_MODEL_CLASS}[CAST(pk % 30 + 1 AS INT)]
        ELSE 'class_' || pk % 30 END AS label FROM lines""",
    "merge": _MERGE_SQL,
}


@query("p18_label_for", fx.with_ctes("SELECT label, count(*) AS detections FROM classed GROUP BY ALL", "lines", extra=_CLASSED))
def p18(spark, sf_dir):
    return classed(spark, sf_dir).groupBy("label").agg(F.count("*").alias("detections"))


@query(
    "p05_merge_classes",
    fx.with_ctes(
        """SELECT image_id, det_seq, coalesce(merged_class, label) AS label, label AS model_class,
             coalesce(merged_class, '') <> 'civilian' AS is_context FROM classed LEFT JOIN merge ON model_class = label""",
        "lines",
        extra=_CLASSED,
    ),
)
def p05(spark, sf_dir):
    return detect.merge_classes(classed(spark, sf_dir), dims.merge_dim(spark), include_context=True, keep_unmerged=True)


@query(
    "p05_merged_alarm_classes_only",
    fx.with_ctes(
        "SELECT image_id, det_seq, merged_class AS label, label AS model_class, false AS is_context FROM classed JOIN merge ON model_class = label WHERE merged_class = 'civilian'",
        "lines",
        extra=_CLASSED,
    ),
)
def p05_alarm(spark, sf_dir):
    return detect.merge_classes(classed(spark, sf_dir), dims.merge_dim(spark))


@query(
    "p06_tag_context",
    fx.with_ctes("SELECT image_id, det_seq, class AS label, class NOT IN ('A', 'N') AS is_context FROM boxes", *BOXES),
)
def p06(spark, sf_dir):
    det = fx.boxes(spark, sf_dir).select("image_id", "det_seq", F.col("class").alias("label"))
    return detect.tag_context(det, ["A", "N"], include_context=True)


_PEOPLE = {
    "people": """SELECT k AS frame_index, k % 50 AS camera_id, n::BIGINT AS det_seq, CASE pk % 3 WHEN 0 THEN 'swimmer' WHEN 1 THEN 'boat' ELSE 'civilian' END AS label,
        pk % 90 - 10 + q / 8 AS x1, sk % 70 - 5.5 AS y1, pk % 90 - 10 + q AS x2, sk % 70 - 5.5 + q AS y2 FROM lines"""
}


def people(spark, sf_dir):
    left, top = F.col("pk") % 90 - 10, F.col("sk") % 70 - F.lit(5.5)
    label = F.when(F.col("pk") % 3 == 0, "swimmer").when(F.col("pk") % 3 == 1, "boat").otherwise("civilian")
    return fx.lines(spark, sf_dir).select(
        F.col("k").alias("frame_index"), (F.col("k") % 50).alias("camera_id"), F.col("n").cast("long").alias("det_seq"),
        label.alias("label"), (left + F.col("q") / 8).alias("x1"), top.alias("y1"), (left + F.col("q")).alias("x2"), (top + F.col("q")).alias("y2"),
    )


@query(
    "p14_redaction_plan",
    fx.with_ctes(
        """SELECT camera_id, frame_index, det_seq, label, rx1, ry1, rx2, ry2, greatest(3, (least(ry2 - ry1, rx2 - rx1) // 6) | 1) AS kernel
           FROM (SELECT camera_id, frame_index, det_seq, label, greatest(0, round_even(x1, 0)::BIGINT) AS rx1, greatest(0, round_even(y1, 0)::BIGINT) AS ry1,
                   least(80, round_even(x2, 0)::BIGINT) AS rx2, least(60, round_even(y2, 0)::BIGINT) AS ry2
                 FROM people JOIN (SELECT o_orderkey AS frame_index FROM orders) USING (frame_index) WHERE label <> 'boat')
           WHERE rx2 > rx1 AND ry2 > ry1""",
        "lines",
        extra=_PEOPLE,
    ),
)
def p14(spark, sf_dir):
    frames = fx.mask_frames(spark, sf_dir).select("camera_id", "frame_index", F.lit(80).alias("width"), F.lit(60).alias("height"))
    return detect.redaction_plan(people(spark, sf_dir), frames)


_TILE_FRAMES = "SELECT o_orderkey AS image_id, CAST(400 + o_custkey % 1600 AS INT) AS width, CAST(300 + o_custkey % 900 AS INT) AS height FROM orders"


def tile_frames(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        (F.col("o_custkey") % 1600 + 400).cast("int").alias("width"),
        (F.col("o_custkey") % 900 + 300).cast("int").alias("height"),
    )


@query(
    "p16_tile_grid",
    fx.with_ctes(
        """SELECT image_id, width, height, tile_x1, tile_y1, least(tile_x1 + 512, width) AS tile_x2, least(tile_y1 + 512, height) AS tile_y2
           FROM (SELECT *, unnest(list_distinct(list_append(range(0, greatest(height - 512, 0) + 1, 409), greatest(height - 512, 0))))::INT AS tile_y1
                 FROM (SELECT *, unnest(list_distinct(list_append(range(0, greatest(width - 512, 0) + 1, 409), greatest(width - 512, 0))))::INT AS tile_x1
                       FROM sized))""",
        extra={"sized": _TILE_FRAMES},
    ),
)
def p16(spark, sf_dir):
    return sampling.tile_grid(tile_frames(spark, sf_dir))


_PIXELS = {
    "pixels": "SELECT k AS image_id, n::BIGINT * 4 AS y, pk % 100 AS x0, pk % 100 + q::BIGINT AS x1, sk % 100 AS saturation, (pk * 7 % 256) AS value FROM lines",
    "fitted": """SELECT image_id, det_seq, round_even(x1, 0)::BIGINT AS bx1, round_even(y1, 0)::BIGINT AS by1, round_even(x2, 0)::BIGINT AS bx2,
        round_even(y2, 0)::BIGINT AS by2 FROM pred""",
    "grey": """SELECT image_id, det_seq, sum(CASE WHEN saturation <= 40 AND value >= 50 THEN w ELSE 0 END) / sum(w) AS grey_fraction
        FROM (SELECT f.*, saturation, value, least(x1, bx2) - greatest(x0, bx1) AS w FROM fitted f JOIN pixels p USING (image_id) WHERE y >= by1 AND y < by2)
        WHERE w > 0 GROUP BY ALL""",
}


CUTOFFS = (40, 60, 80, 100, 120)
_GREYS = (
    "SELECT image_id, det_seq, "
    + ", ".join(f"sum(CASE WHEN saturation <= {c} AND value >= 50 THEN w ELSE 0 END) / sum(w) AS g{c}" for c in CUTOFFS)
    + """ FROM (SELECT f.*, saturation, value, least(x1, bx2) - greatest(x0, bx1) AS w FROM fitted f JOIN pixels p USING (image_id) WHERE y >= by1 AND y < by2)
        WHERE w > 0 GROUP BY ALL"""
)


def pixels(spark, sf_dir):
    return fx.lines(spark, sf_dir).select(
        F.col("k").alias("image_id"), (F.col("n").cast("long") * 4).alias("y"), (F.col("pk") % 100).alias("x0"),
        (F.col("pk") % 100 + F.col("q").cast("long")).alias("x1"), (F.col("sk") % 100).alias("saturation"), (F.col("pk") * 7 % 256).alias("value"),
    )


def with_sides(pred):
    return pred.select("*", *[F.col(f"box.{c}").alias(c) for c in BOX_COLUMNS])


def pairs_by_class(spark, sf_dir):
    """(predictions, truth) with an image and a class as one key."""
    pred, wanted = fx.stored_pairs(spark, sf_dir)
    return fx.by_class(pred), fx.by_class(wanted)


@query(
    "p19_grey_fraction",
    fx.with_ctes("SELECT image_id, det_seq, round(grey_fraction, 6) AS grey_fraction FROM grey", "lines", "boxes", "pred", extra=_PIXELS),
)
def p19(spark, sf_dir):
    shares = detect.grey_fraction(with_sides(fx.predictions(spark, sf_dir)), pixels(spark, sf_dir), 40, keys=("image_id",))
    return rounded(shares, "grey_fraction")


@query(
    "j07_iou_pairs",
    fx.with_ctes(
        f"""SELECT image_id, a_seq, b_seq, round(iou, 6) AS iou FROM (SELECT p.image_id, p.det_seq AS a_seq, t.truth_seq AS b_seq, {fx.iou_sql('p', 't')} AS iou
            FROM pred p JOIN truth t USING (image_id)) WHERE iou >= 0.3""",
        *PAIRS,
    ),
)
def j07(spark, sf_dir):
    pred, wanted = fx.stored_pairs(spark, sf_dir)
    return rounded(detect.iou_pairs(pred, wanted.withColumnRenamed("truth_seq", "det_seq"), 0.3, ["image_id"]), "iou")


# Suppression and matching.


@query(
    "t05_nms_decode_form",
    fx.with_ctes("SELECT image_id, det_seq FROM kept", *BOXES, extra=fx.nms_sql("boxes", 0.45, True), recursive=True),
)
def t05(spark, sf_dir):
    return overlap.nms(fx.boxes(spark, sf_dir), 0.45, ["image_id"]).select("image_id", "det_seq")


@query(
    "t05_nms_merge_form",
    fx.with_ctes("SELECT image_id, det_seq FROM kept", *BOXES, extra=fx.nms_sql("boxes", 0.5, False), recursive=True),
)
def t05_merge(spark, sf_dir):
    return overlap.nms(fx.boxes(spark, sf_dir), 0.5, ["image_id"], keep_equal=False).select("image_id", "det_seq")


@query(
    "t01_by_confidence",
    fx.with_ctes("SELECT image_id, det_seq, confidence FROM boxes ORDER BY image_id, confidence DESC, det_seq", *BOXES),
)
def t01(spark, sf_dir):
    return detect.by_confidence(fx.boxes(spark, sf_dir), ["image_id"]).select("image_id", "det_seq", "confidence")


@query(
    "t02_top_k",
    fx.with_ctes(
        "SELECT image_id, det_seq FROM boxes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_seq) <= 3", *BOXES
    ),
)
def t02(spark, sf_dir):
    return detect.top_k(fx.boxes(spark, sf_dir), 3, ["image_id"]).select("image_id", "det_seq")


@query(
    "t03_regions_by_area",
    fx.with_ctes("SELECT image_id, det_seq, round((x2 - x1) * (y2 - y1), 6) AS area FROM boxes ORDER BY image_id, 3 DESC, det_seq", *BOXES),
)
def t03(spark, sf_dir):
    rows = fx.boxes(spark, sf_dir).select("image_id", "det_seq", *[F.col(f"box.{c}").alias(c) for c in BOX_COLUMNS])
    ordered = detect.regions_by_area(rows, ["image_id"])
    return ordered.select("image_id", "det_seq", r6(geo.box_area(geo.box_of())).alias("area"))


@query(
    "t06_best_candidate",
    fx.with_ctes("SELECT class, max(confidence * 1000 + image_id % 1000 / 1000) AS score FROM boxes GROUP BY ALL", *BOXES),
)
def t06(spark, sf_dir):
    scored = fx.boxes(spark, sf_dir).select(
        "class", "image_id", "det_seq", (F.col("confidence") * 1000 + F.col("image_id") % 1000 / 1000).alias("score")
    )
    return detect.best_candidate(scored, ["class"]).select("class", "score")


GRID_CLASSES = ["smoke", "accident", "vehicle", "other"]
_GRID = {
    "anchors": """SELECT k AS image_id, n::BIGINT AS anchor_id, pk % 640 + 0.5 AS cx, sk * 3 % 640 + 0.25 AS cy, 40 + q * 4 AS w, 40.0 + n * 20 AS h,
        [(pk % 97) / 100, (sk % 89) / 100, (floor(pr) % 83) / 100, (k % 79) / 100, 9.0, 9.0] AS scores FROM lines""",
    "decoded": """SELECT image_id, anchor_id AS det_seq, confidence, label, least(greatest((cx - w / 2 - 0) / 0.5, 0), 1280) AS x1,
        least(greatest((cy - h / 2 - 140) / 0.5, 0), 720) AS y1, least(greatest((cx + w / 2 - 0) / 0.5, 0), 1280) AS x2,
        least(greatest((cy + h / 2 - 140) / 0.5, 0), 720) AS y2
        FROM (SELECT *, list_max(scores[1:4]) AS confidence, ['smoke', 'accident', 'vehicle', 'other'][list_position(scores[1:4], list_max(scores[1:4]))] AS label FROM anchors)
        WHERE confidence >= 0.3""",
}


def anchors(spark, sf_dir):
    def part(column, modulus):
        return (column % modulus / 100).cast("double")

    scores = F.array(
        part(F.col("pk"), 97), part(F.col("sk"), 89), part(F.floor("pr"), 83), part(F.col("k"), 79), F.lit(9.0), F.lit(9.0)
    )
    return fx.lines(spark, sf_dir).select(
        F.col("k").alias("image_id"), F.col("n").cast("long").alias("anchor_id"), (F.col("pk") % 640 + F.lit(0.5)).alias("cx"),
        (F.col("sk") * 3 % 640 + F.lit(0.25)).alias("cy"), (F.col("q") * 4 + 40).alias("w"), (F.col("n") * 20 + F.lit(40.0)).alias("h"), scores.alias("scores"),
    )


def model_images(spark, sf_dir):
    return fx.images(spark, sf_dir).select(
        "image_id", F.lit(1280).alias("width"), F.lit(720).alias("height"), F.lit(0.5).alias("scale"), F.lit(0.0).alias("pad_left"), F.lit(140.0).alias("pad_top")
    )


@query(
    "t07_decode_grid_predictions",
    fx.with_ctes(
        """SELECT image_id, det_seq, label, round(confidence, 6) AS confidence, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2
           FROM decoded SEMI JOIN kept USING (image_id, det_seq)""",
        "lines",
        extra={**_GRID, **fx.nms_sql("decoded", 0.01, True)},
        recursive=True,
    ),
)
def t07(spark, sf_dir):
    rows = overlap.decode_grid_predictions(
        anchors(spark, sf_dir), model_images(spark, sf_dir), class_names=GRID_CLASSES, floor=0.3, iou=0.01
    )
    return rows.select("image_id", "det_seq", "label", r6("confidence").alias("confidence"), *flat())


@query(
    "t08_decode_query_predictions",
    fx.with_ctes(
        """SELECT image_id, det_seq, label, round(confidence, 6) AS confidence, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM (
             SELECT image_id, det_seq, ['swimmer', 'boat', 'jetski', 'life_saving_appliances', 'buoy'][list_position(named, list_max(named))] AS label,
               1 / (1 + exp(-list_max(named))) AS confidence, least(greatest((cx - w / 2) * 1280, 0), 1280) AS x1, least(greatest((cy - h / 2) * 720, 0), 720) AS y1,
               least(greatest((cx + w / 2) * 1280, 0), 1280) AS x2, least(greatest((cy + h / 2) * 720, 0), 720) AS y2
             FROM (SELECT k AS image_id, n::BIGINT AS det_seq, (pk % 100) / 100 AS cx, (sk % 100) / 100 AS cy, q / 100 AS w, n / 20 AS h,
                     [(pk % 7) - 4.0, (sk % 7) - 4.5, (k % 7) - 4.25, -3.0, (floor(pr) % 7) - 4.75] AS named FROM lines))
           WHERE confidence >= 0.3 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_seq) <= 4""",
        "lines",
    ),
)
def t08(spark, sf_dir):
    logits = F.array(
        F.col("pk") % 7 - F.lit(4.0), F.col("sk") % 7 - F.lit(4.5), F.col("k") % 7 - F.lit(4.25), F.lit(-3.0), F.floor("pr") % 7 - F.lit(4.75), F.lit(9.0)
    )
    queries = fx.lines(spark, sf_dir).select(
        F.col("k").alias("image_id"), F.col("n").cast("long").alias("query_id"), (F.col("pk") % 100 / 100).alias("cx"), (F.col("sk") % 100 / 100).alias("cy"),
        (F.col("q") / 100).alias("w"), (F.col("n") / 20).alias("h"), logits.alias("logits"),
    )
    rows = overlap.decode_query_predictions(queries, model_images(spark, sf_dir), class_names=dims.WATER_MODEL_CLASSES, k=4)
    return rows.select("image_id", "det_seq", "label", r6("confidence").alias("confidence"), *flat())


_TILES = {
    "full_frame": "SELECT image_id, det_seq, confidence, x1, y1, x2, y2 FROM boxes WHERE det_seq % 3 = 0",
    "everything": """SELECT image_id, det_seq, confidence, x1, y1, x2, y2 FROM full_frame UNION ALL
        SELECT image_id, ((1000000 + ty) * 1000000 + tx) * 100000 + det_seq, confidence, x1 - 8 + tx, y1 - 4 + ty, x2 - 8 + tx, y2 - 4 + ty
        FROM (SELECT *, det_seq * 2 % 16 AS tx, det_seq * 3 % 8 AS ty FROM boxes WHERE det_seq % 3 <> 0)""",
}


def tiled(rows):
    full = rows.filter("det_seq % 3 = 0")
    tiles = rows.filter("det_seq % 3 <> 0").select(
        "image_id", "det_seq", "confidence", geo.offset(F.col("box"), -8, -4).alias("box"),
        (F.col("det_seq") * 2 % 16).alias("tile_x1"), (F.col("det_seq") * 3 % 8).alias("tile_y1"),
    )
    return full, tiles


@query(
    "t09_merge_tiles",
    fx.with_ctes(
        """SELECT e.image_id, round(confidence, 6) AS confidence, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2
           FROM everything e SEMI JOIN kept USING (image_id, det_seq)""",
        *BOXES,
        extra={**_TILES, **fx.nms_sql("everything", 0.5, False)},
        recursive=True,
    ),
)
def t09(spark, sf_dir):
    merged = overlap.merge_tiles(*tiled(fx.boxes(spark, sf_dir)))
    return merged.select("image_id", r6("confidence").alias("confidence"), *flat())


_MATCH = fx.match_sql("pred", "truth", 0.3)


@query(
    "j06_match_predictions",
    fx.with_ctes("SELECT image_id, det_seq, truth_seq, round(match_iou, 6) AS match_iou FROM matched", *PAIRS, extra=_MATCH, recursive=True),
)
def j06(spark, sf_dir):
    rows = overlap.match_predictions(*fx.stored_pairs(spark, sf_dir), 0.3, ["image_id"])
    return rounded(rows.select("image_id", "det_seq", "truth_seq", "match_iou"), "match_iou")


@query(
    "j06_match_boxes",
    fx.with_ctes(
        """SELECT image_id, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(n, 0) - coalesce(tp, 0) AS fn
           FROM (SELECT image_id, count(truth_seq) AS tp, count(*) AS p FROM matched GROUP BY ALL)
           FULL JOIN (SELECT image_id, count(*) AS n FROM truth GROUP BY ALL) USING (image_id)""",
        *PAIRS,
        extra=_MATCH,
        recursive=True,
    ),
)
def j06_counts(spark, sf_dir):
    return overlap.match_boxes(*fx.stored_pairs(spark, sf_dir), 0.3)


_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS false_alarm_rate"""
_BETAS = """round(precision, 6) AS precision, round(recall, 6) AS recall, round(false_alarm_rate, 6) AS false_alarm_rate,
    CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 6) ELSE 0.0 END AS f1,
    CASE WHEN 4 * precision + recall > 0 THEN round(5 * precision * recall / (4 * precision + recall), 6) ELSE 0.0 END AS f2"""
_METRICS = ("precision", "recall", "f1", "f2", "false_alarm_rate")


@query(
    "g01_confusion_metrics",
    f"""SELECT customer, tp, fp, fn, tn, {_BETAS} FROM (SELECT *, {_RATES} FROM (
          SELECT o_custkey AS customer, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 150000) AS tp, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 150000) AS fp,
            count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 150000) AS fn, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice <= 150000) AS tn
          FROM orders GROUP BY ALL))""",
)
def g01(spark, sf_dir):
    done, dear = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000
    counts = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count(F.when(done & dear, 1)).alias("tp"), F.count(F.when(done & ~dear, 1)).alias("fp"),
        F.count(F.when(~done & dear, 1)).alias("fn"), F.count(F.when(~done & ~dear, 1)).alias("tn"),
    )
    return rounded(metrics.confusion_metrics(counts), *_METRICS)


@query(
    "g02_aggregate_counts",
    """SELECT part, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn FROM (
         SELECT o_custkey % 7 AS part, o_orderkey % 11 AS tp, o_orderkey % 5 AS fp, o_orderkey % 3 AS fn, o_orderkey % 2 AS tn FROM orders) GROUP BY ALL""",
)
def g02(spark, sf_dir):
    key = F.col("o_orderkey")
    partial = fx.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 7).alias("part"), (key % 11).alias("tp"), (key % 5).alias("fp"), (key % 3).alias("fn"), (key % 2).alias("tn")
    )
    return metrics.aggregate_counts(partial, ["part"])


@query(
    "g03_image_confusion",
    fx.with_ctes(
        f"""SELECT tp, fp, fn, tn, {_BETAS} FROM (SELECT *, {_RATES} FROM (
              SELECT count(*) FILTER (a AND t) AS tp, count(*) FILTER (a AND NOT t) AS fp, count(*) FILTER (NOT a AND t) AS fn, count(*) FILTER (NOT a AND NOT t) AS tn
              FROM (SELECT image_id IN (SELECT image_id FROM pred WHERE confidence >= 0.6) AS a, image_id IN (SELECT image_id FROM truth) AS t FROM images)))""",
        "lines",
        extra=fx.BY_CLASS,
    ),
)
def g03(spark, sf_dir):
    pred, wanted = pairs_by_class(spark, sf_dir)
    strong = detect.above_floor(pred, 0.6)
    return rounded(metrics.image_confusion(strong, wanted, fx.each_class(fx.images(spark, sf_dir))), *_METRICS)


_BY_CLASS = {
    "pred_c": "SELECT *, image_id || class AS ic FROM pred",
    "truth_c": "SELECT *, image_id || class AS ic FROM truth",
    **fx.match_sql("pred_c", "truth_c", 0.3, "ic"),
}


@query(
    "g04_per_class_metrics",
    fx.with_ctes(
        f"""SELECT class, tp, fp, fn, tn, {_BETAS} FROM (SELECT *, {_RATES} FROM (
              SELECT class, tp, p - tp AS fp, n - tp AS fn, 0::BIGINT AS tn FROM (SELECT right(ic, 1) AS class, count(truth_seq) AS tp, count(*) AS p FROM matched GROUP BY ALL)
              JOIN (SELECT class, count(*) AS n FROM truth GROUP BY ALL) USING (class)))""",
        *PAIRS,
        extra=_BY_CLASS,
        recursive=True,
    ),
)
def g04(spark, sf_dir):
    return rounded(metrics.per_class_metrics(*fx.stored_pairs(spark, sf_dir)), *_METRICS)


def _sweep_sql(floors: str, preds: str, matched: str = "matched") -> str:
    return f"""
      SELECT floor, box_tp, box_fp, box_fn, round(bp, 6) AS box_precision, round(br, 6) AS box_recall,
        CASE WHEN bp + br > 0 THEN round(2 * bp * br / (bp + br), 6) ELSE 0.0 END AS box_f1, CASE WHEN 4 * bp + br > 0 THEN round(5 * bp * br / (4 * bp + br), 6) ELSE 0.0 END AS box_f2,
        img_tp, img_fp, img_fn, img_tn, round(ip, 6) AS img_precision, round(ir, 6) AS img_recall,
        CASE WHEN 4 * ip + ir > 0 THEN round(5 * ip * ir / (4 * ip + ir), 6) ELSE 0.0 END AS img_f2, CASE WHEN img_fp + img_tn > 0 THEN round(img_fp / (img_fp + img_tn), 6) ELSE 0.0 END AS img_false_alarm_rate
      FROM (SELECT *, CASE WHEN box_tp + box_fp > 0 THEN box_tp / (box_tp + box_fp) ELSE 0.0 END AS bp, CASE WHEN box_tp + box_fn > 0 THEN box_tp / (box_tp + box_fn) ELSE 0.0 END AS br,
              CASE WHEN img_tp + img_fp > 0 THEN img_tp / (img_tp + img_fp) ELSE 0.0 END AS ip, CASE WHEN img_tp + img_fn > 0 THEN img_tp / (img_tp + img_fn) ELSE 0.0 END AS ir
        FROM (SELECT floor, (SELECT count(truth_seq) FROM {matched} WHERE confidence >= floor) AS box_tp,
                (SELECT count(*) - count(truth_seq) FROM {matched} WHERE confidence >= floor) AS box_fp,
                (SELECT count(*) FROM truth) - (SELECT count(truth_seq) FROM {matched} WHERE confidence >= floor) AS box_fn,
                (SELECT count(DISTINCT image_id) FROM {preds} WHERE confidence >= floor AND image_id IN (SELECT image_id FROM truth)) AS img_tp,
                (SELECT count(DISTINCT image_id) FROM {preds} WHERE confidence >= floor AND image_id NOT IN (SELECT image_id FROM truth)) AS img_fp,
                (SELECT count(DISTINCT image_id) FROM truth) - (SELECT count(DISTINCT image_id) FROM {preds} WHERE confidence >= floor AND image_id IN (SELECT image_id FROM truth)) AS img_fn,
                (SELECT count(*) FROM images WHERE image_id NOT IN (SELECT image_id FROM truth)) - (SELECT count(DISTINCT image_id) FROM {preds} WHERE confidence >= floor AND image_id NOT IN (SELECT image_id FROM truth)) AS img_tn
              FROM (VALUES {floors}) AS f(floor)))"""


SWEEP_COLUMNS = tuple(f"box_{n}" for n in ("precision", "recall", "f1", "f2")) + tuple(
    f"img_{n}" for n in ("precision", "recall", "f2", "false_alarm_rate")
)
FLOORS = (0.05, 0.10, 0.15, 0.20, 0.30, 0.50)


@query(
    "g05_confidence_sweep",
    fx.with_ctes(
        _sweep_sql(", ".join(f"({f}::DOUBLE)" for f in FLOORS), "pred"),
        "lines", extra={**fx.BY_CLASS, **_MATCH}, recursive=True,
    ),
)
def g05(spark, sf_dir):
    pred, wanted = pairs_by_class(spark, sf_dir)
    rows = metrics.confidence_sweep(pred, wanted, fx.each_class(fx.images(spark, sf_dir)), FLOORS)
    return rounded(rows, *SWEEP_COLUMNS)


def _mode_sql(mode: str, preds: str, matched: str) -> str:
    return f"SELECT '{mode}' AS mode, * FROM (" + _sweep_sql("(0.3::DOUBLE), (0.5::DOUBLE)", preds, matched) + ")"


def _renamed(ctes: dict, suffix: str) -> dict:
    out = {}
    for name, text in ctes.items():
        for other in ctes:
            text = text.replace(f" {other} ", f" {other}{suffix} ").replace(f" {other}\n", f" {other}{suffix}\n")
            if text.endswith(f" {other}"):
                text += suffix
        out[name + suffix] = text
    return out


@query(
    "e06_sliced_vs_full",
    fx.with_ctes(
        _mode_sql("baseline", "full_frame", "matched_a") + " UNION ALL " + _mode_sql("sliced", "merged", "matched_b"),
        "lines",
        extra={
            **fx.BY_CLASS,
            **{name: text.replace("FROM boxes", "FROM pred") for name, text in _TILES.items()},
            **fx.nms_sql("everything", 0.5, False),
            "merged": "SELECT * FROM everything SEMI JOIN kept USING (image_id, det_seq)",
            **_renamed(fx.match_sql("full_frame", "truth", 0.3), "_a"),
            **_renamed(fx.match_sql("merged", "truth", 0.3), "_b"),
        },
        recursive=True,
    ),
)
def e06(spark, sf_dir):
    pred, wanted = pairs_by_class(spark, sf_dir)
    return rounded(experiments.sliced_vs_full(*tiled(pred), wanted, fx.each_class(fx.images(spark, sf_dir))), *SWEEP_COLUMNS)


@query(
    "e07_colour_prior_stills",
    fx.with_ctes(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS prior, tp, fp, fn, tn, {_BETAS} FROM (SELECT *, {_RATES} FROM (
              SELECT count(*) FILTER (a AND t) AS tp, count(*) FILTER (a AND NOT t) AS fp, count(*) FILTER (NOT a AND t) AS fn, count(*) FILTER (NOT a AND NOT t) AS tn
              FROM (SELECT image_id IN (SELECT image_id FROM {source}) AS a, image_id IN (SELECT image_id FROM truth) AS t FROM images)))"""
            for name, source in [("colour off", "pred"), *[(f"S<={c}", f"greys WHERE g{c} >= 0.1") for c in CUTOFFS]]
        ),
        "lines", extra={**fx.BY_CLASS, **_PIXELS, "pixels": _PIXELS["pixels"].replace("k AS image_id", "k * 3 + c AS image_id") + " CROSS JOIN range(3) AS t(c)", "greys": _GREYS},
    ),
)
def e07(spark, sf_dir):
    pred, wanted = pairs_by_class(spark, sf_dir)
    images, shown = fx.each_class(fx.images(spark, sf_dir)), fx.each_class(pixels(spark, sf_dir))
    rows = experiments.colour_prior_stills(with_sides(pred), shown, wanted, images, cutoffs=CUTOFFS)
    return rounded(rows, *_METRICS)


# Truth files.



@query(
    "a04_yolo_boxes",
    """SELECT l_orderkey AS image_id, l_linenumber::BIGINT AS truth_seq, CAST(l_partkey % 3 AS VARCHAR) AS class,
         round((l_partkey % 100 / 100 - 0.125) * 640, 6) AS x1, round((l_suppkey % 100 / 100 - 0.25) * 480, 6) AS y1,
         round((l_partkey % 100 / 100 + 0.125) * 640, 6) AS x2, round((l_suppkey % 100 / 100 + 0.25) * 480, 6) AS y2
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 10 <> 0 AND l_partkey % 3 < 2""",
)
def a04(spark, sf_dir):
    """Label lines are written as text and scanned back; every tenth line has only four fields."""
    item = fx.table(spark, sf_dir, "lineitem")
    number = F.format_string("%d %.2f  %.2f 0.25", F.col("l_partkey") % 3, F.col("l_partkey") % 100 / 100, F.col("l_suppkey") % 100 / 100)
    line = F.concat_ws("\t", "l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 10 == 0, number).otherwise(F.concat(number, F.lit(" 0.5"))))
    folder = fx.shared_folder(spark)
    item.select(line).write.text(folder)
    parts = F.split("value", "\t")
    lines = spark.read.text(folder).select(
        parts[0].cast("long").alias("image_id"), parts[1].cast("long").alias("line_no"), parts[2].alias("line")
    )
    sizes = fx.images(spark, sf_dir).select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return truths.yolo_boxes(lines, sizes, classes=["0", "1"]).select("image_id", "truth_seq", "class", *flat())


@query(
    "a05_coco_truth",
    fx.with_ctes(
        """SELECT k AS image_id, k || '.jpg' AS file_name, merged_class AS class, round(pk % 80, 6)::DOUBLE AS x1, round(sk % 60, 6)::DOUBLE AS y1,
             (pk % 80 + q % 9)::DOUBLE AS x2, (sk % 60 + n)::DOUBLE AS y2
           FROM lines JOIN classed ON image_id = k AND det_seq = n JOIN merge ON model_class = label WHERE q % 9 > 1 AND n > 1""",
        "lines",
        extra=_CLASSED,
    ),
)
def a05(spark, sf_dir):
    rows = fx.lines(spark, sf_dir)
    notes = rows.select(
        F.col("k").alias("image_id"), (F.col("pk") % 30).alias("category_id"), F.col("n").alias("truth_seq"),
        F.array((F.col("pk") % 80).cast("double"), (F.col("sk") % 60).cast("double"), F.col("q") % 9, F.col("n").cast("double")).alias("bbox"),
    )
    images = rows.select(F.col("k").alias("image_id"), F.concat(F.col("k").cast("string"), F.lit(".jpg")).alias("file_name")).distinct()
    categories = spark.createDataFrame(list(enumerate(dims.BUILDING_MODEL_CLASSES)), "category_id long, name string")
    found = truths.coco_rows(notes, images, categories, dims.merge_dim(spark))
    return found.select("image_id", "file_name", "class", *flat())


@query(
    "g13_medians",
    """SELECT l_returnflag AS grp, quantile_disc(l_extendedprice, 0.5) AS lower, round(median(l_extendedprice), 6) AS middle,
         list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper FROM lineitem GROUP BY ALL""",
)
def g13(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")
    return rounded(exact_medians(rows, ["grp"], "l_extendedprice").drop("n"), "middle")


@query(
    "g13_upper_median_of_array",
    "SELECT l_orderkey AS k, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper FROM lineitem GROUP BY ALL",
)
def g13_array(spark, sf_dir):
    listed = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_extendedprice").alias("v"))
    return listed.select("k", upper_median(F.col("v")).alias("upper"))


@query(
    "j10_pair_by_stem",
    """SELECT a.doc_id || '_s' || source AS stem, 'img/' || lang || '/' || a.doc_id || '_s' || source || '.jpg' AS image_path,
         'masks/' || b.quality || '/' || a.doc_id || '_s' || source || CASE WHEN a.doc_id % 3 = 0 THEN '_lab' WHEN a.doc_id % 3 = 1 THEN '_mask' ELSE '' END || '.png' AS mask_path
       FROM documents a JOIN labels b USING (doc_id)""",
)
def j10(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("_s"), F.col("source"))
    ending = F.when(F.col("doc_id") % 3 == 0, "_lab").when(F.col("doc_id") % 3 == 1, "_mask").otherwise("")
    pictures = docs.select(F.concat(F.lit("img/"), F.col("lang"), F.lit("/"), name, F.lit(".jpg")).alias("path"))
    labelled = docs.join(fx.table(spark, sf_dir, "labels"), "doc_id")
    masks = labelled.select(F.concat(F.lit("masks/"), F.col("quality").cast("string"), F.lit("/"), name, ending, F.lit(".png")).alias("path"))
    return reports.pair_by_stem(pictures, masks)
