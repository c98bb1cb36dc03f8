import random

import pytest
from pyspark.sql import functions as F

from tests.brute import iou
from watchgrid.operators import metrics, overlap
from watchgrid.operators.detect import iou_pairs

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def boxes(seed, images=12, most=9):
    rng = random.Random(seed)
    rows = []
    for image in range(images):
        for seq in range(rng.randrange(most)):
            x, y = rng.randrange(-20, 60, 10), rng.randrange(0, 60, 10)
            w, h = rng.choice([0, 20, 40, 300]), rng.choice([20, 40])
            rows.append((image, seq, rng.choice([0.1, 0.5, 0.5, 0.9]), (float(x), float(y), float(x + w), float(y + h))))
    return rows


def brute_nms(rows, limit, keep_equal):
    kept = set()
    for image in {r[0] for r in rows}:
        chosen = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[1])):
            if all(iou(k[3], r[3]) <= limit if keep_equal else iou(k[3], r[3]) < limit for k in chosen):
                chosen.append(r)
        kept |= {(image, r[1]) for r in chosen}
    return kept


@pytest.mark.parametrize("keep_equal", [True, False])
@pytest.mark.parametrize("array_boxes", [4096, 0])
def test_nms_on_arrays_and_by_rounds_keeps_the_greedy_choice(spark, keep_equal, array_boxes):
    rows = boxes(1) + [(99, s, 0.5, (0.0, 0.0, 10.0, 10.0)) for s in range(5)]
    df = spark.createDataFrame(rows, f"image_id long, det_seq long, confidence double, box {BOX}")
    for limit in (0.01, 1 / 3, 0.5):
        got = overlap.nms(df, limit, ["image_id"], keep_equal=keep_equal, array_boxes=array_boxes)
        assert {(r.image_id, r.det_seq) for r in got.collect()} == brute_nms(rows, limit, keep_equal)


def brute_match(pred, truth, limit):
    out = {}
    for image in {p[0] for p in pred}:
        mine, claimed = [t for t in truth if t[0] == image], set()
        for p in sorted((p for p in pred if p[0] == image), key=lambda p: (-p[2], p[1])):
            best, which = 0.0, None
            for t in sorted(mine, key=lambda t: t[1]):
                if t[1] not in claimed and iou(p[3], t[3]) > best:
                    best, which = iou(p[3], t[3]), t[1]
            ok = which is not None and best >= limit
            if ok:
                claimed.add(which)
            out[(image, p[1])] = which if ok else None
    return out


@pytest.mark.parametrize("array_boxes", [4096, 0])
def test_matching_on_arrays_and_by_rounds_claims_alike(spark, array_boxes):
    pred, truth = boxes(2, most=7), boxes(3, most=7)
    schema = f"image_id long, det_seq long, confidence double, box {BOX}"
    p = spark.createDataFrame(pred, schema)
    t = spark.createDataFrame(truth, schema).select("image_id", F.col("det_seq").alias("truth_seq"), "box")
    for limit in (0.0, 0.3, 1 / 3):
        got = overlap.match_predictions(p, t, limit, ["image_id"], array_boxes=array_boxes).collect()
        assert {(r.image_id, r.det_seq): r.truth_seq for r in got} == brute_match(pred, truth, limit)


def test_counts_cover_images_without_predictions_or_truth(spark):
    schema = f"image_id long, det_seq long, confidence double, box {BOX}"
    unit = (0.0, 0.0, 10.0, 10.0)
    p = spark.createDataFrame([(1, 0, 0.9, unit), (2, 0, 0.9, unit)], schema)
    t = spark.createDataFrame([(1, 0, unit), (3, 0, unit)], f"image_id long, truth_seq long, box {BOX}")
    got = {(r.image_id, r.tp, r.fp, r.fn) for r in overlap.match_boxes(p, t).collect()}
    assert got == {(1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)}


def test_one_matching_run_serves_every_floor(spark):
    pred, truth = boxes(4, images=20), boxes(5, images=20)
    schema = f"image_id long, det_seq long, confidence double, box {BOX}"
    p = spark.createDataFrame(pred, schema)
    t = spark.createDataFrame(truth, schema).select("image_id", F.col("det_seq").alias("truth_seq"), "box")
    floors = (0.05, 0.3, 0.5, 0.7, 0.95)
    rows = {r.floor: r for r in metrics.confidence_sweep(p, t, spark.range(22).withColumnRenamed("id", "image_id"), floors).collect()}
    for floor in floors:
        strong = [r for r in pred if r[2] >= floor]
        matched = brute_match(strong, truth, 0.3)
        tp = sum(v is not None for v in matched.values())
        r = rows[floor]
        assert (r.box_tp, r.box_fp, r.box_fn) == (tp, len(strong) - tp, len(truth) - tp)
        alarmed, wanted = {x[0] for x in strong}, {x[0] for x in truth}
        assert (r.img_tp, r.img_fp, r.img_fn) == (len(alarmed & wanted), len(alarmed - wanted), len(wanted - alarmed))
        assert r.img_tn == 22 - len(alarmed | wanted)


def test_pairs_are_found_once_whatever_the_cell_size(spark):
    a, b = boxes(6), boxes(7)
    schema = f"image_id long, det_seq long, confidence double, box {BOX}"
    left, right = (spark.createDataFrame(x, schema).select("image_id", "det_seq", "box") for x in (a, b))
    want = {(p[0], p[1], t[1]) for p in a for t in b if p[0] == t[0] and iou(p[3], t[3]) >= 0.1}
    for cell in (7.0, 64.0):
        got = [(r.image_id, r.a_seq, r.b_seq) for r in iou_pairs(left, right, 0.1, ["image_id"], cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_published_counts_give_the_published_rates(spark):
    # Box level 1114 of 1218 swimmers with 97 false boxes; interval of 12 of 12.
    row = metrics.confusion_metrics(spark.createDataFrame([(1114, 97, 104, 0)], "tp long, fp long, fn long, tn long")).first()
    assert round(row.precision, 4) == 0.9199 and round(row.recall, 4) == 0.9146 and row.false_alarm_rate == 1.0
    table = spark.createDataFrame([("full", 12, 12), ("none", 0, 0), ("zero", 0, 10)], "name string, k long, n long")
    got = {r.name: (round(r.lo, 4), round(r.hi, 4)) for r in metrics.interval_table(table).collect()}
    assert got["full"] == (0.7575, 1.0) and got["none"] == (0.0, 1.0) and got["zero"][0] == 0.0


@pytest.mark.parametrize("limit", [-0.1, 0.0, 0.5, 1.0, 1.1])
@pytest.mark.parametrize("keep_equal", [True, False])
def test_suppression_is_one_rule_at_every_size_and_limit(spark, limit, keep_equal):
    from watchgrid.functions.geometry import box_of

    rows = [(0, 1, 0.9, 0.0, 0.0, 0.4, 0.4), (0, 2, 0.8, 0.0, 0.0, 0.4, 0.4), (0, 3, 0.7, 0.5, 0.5, 0.9, 0.9), (0, 4, 0.7, 0.1, 0.0, 0.5, 0.4),
            (1, 5, 0.5, 0.0, 0.0, 100.0, 100.0), (1, 6, 0.6, 0.0, 0.0, 1e4, 1e4), (1, 7, 0.5, 0.0, 0.0, 100.0, 100.0), (1, 8, 0.1, 3.0, 3.0, 3.0, 9.0)]
    df = spark.createDataFrame(rows, "image_id long, det_seq long, confidence double, x1 double, y1 double, x2 double, y2 double")
    boxes = df.withColumn("box", box_of()).drop("x1", "y1", "x2", "y2")
    kept = [sorted(r.det_seq for r in overlap.nms(boxes, limit, ["image_id"], keep_equal=keep_equal, array_boxes=n).collect()) for n in (4096, 2)]
    assert kept[0] == kept[1]


def test_merged_tiles_have_unique_ids_for_table_wide_sequences(spark):
    schema = "image_id long, det_seq long, confidence double, box struct<x1: double, y1: double, x2: double, y2: double>"
    full = spark.createDataFrame([(1, 5_000_000_000, 0.5, (500.0, 500.0, 510.0, 510.0))], schema)
    tiles = spark.createDataFrame([(1, 100_001, 0.5, (0.0, 0.0, 5.0, 5.0), 0, 0), (1, 1, 0.5, (50.0, 0.0, 55.0, 5.0), 1, 0)], schema + ", tile_x1 int, tile_y1 int")
    got = overlap.merge_tiles(full, tiles).orderBy("det_seq").collect()
    assert [r.det_seq for r in got] == [1, 2, 3] and [r.box.x1 for r in got] == [500.0, 0.0, 51.0]
