"""Findings of the third round: each test failed before its change."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F


def events_of(spark, folder, rows):
    """(event_id, seconds, user_id, event_type, value) as the events table of a test folder."""
    made = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double")
    made = made.select("event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    made.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_clips_of_two_cameras_never_share_a_key(spark, tmp_path):
    """Clip 10 of camera 1 and clip 0 of camera 2 have tracks of their own."""
    from watchgrid.catalog.validation import v10

    rows = [(25_000 + 4 * n, 60.0 * n, 1, "error", 90.0) for n in range(2)]
    rows += [(4 * n, 60.0 * n + 300, 2, "error", 90.0) for n in range(2)]
    got = v10(spark, events_of(spark, tmp_path, rows)).collect()
    assert len({r.camera_id for r in got}) == 2
    assert {r.rejected_by for r in got} == {"persistence"}


class Store:
    """A state store of one key in memory that notes the calls made to it."""

    def __init__(self):
        self.value, self.entries, self.timers, self.calls = None, [], set(), []

    def getValueState(self, name, schema):  # noqa: N802
        return Part(self, "value")

    def getListState(self, name, schema):  # noqa: N802
        return Part(self, "list")

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Part:
    def __init__(self, store, kind):
        self.store, self.kind = store, kind

    def __getattr__(self, call):
        def made(*given):
            store = self.store
            store.calls.append((self.kind, call))
            if self.kind == "value":
                if call == "get":
                    return store.value
                if call == "exists":
                    return store.value is not None
                store.value = given[0] if call == "update" else None
            elif call == "exists":
                return bool(store.entries)
            elif call == "get":
                return iter(list(store.entries))
            else:
                store.entries = (store.entries if call == "appendList" else []) + list(given[0] if given else [])

        return made


def play(batches, idle=None):
    """Feed batches of (watermark in seconds, seconds of the frames) to a key; returns (frames stepped, the store)."""
    from datetime import datetime, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    from watchgrid.streaming.ordered import OrderedProcessor, one_by_one

    processor = OrderedProcessor(one_by_one(lambda memo, row: [(row["frame_index"],)]), ["camera_id"], ["camera_id", "frame_index"], "event_time", idle)
    store, out = Store(), []
    processor.init(store)
    for watermark, seconds in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: int(w * 1000))
        rows = [Row(camera_id=7, frame_index=s, event_time=datetime.fromtimestamp(s, timezone.utc)) for s in seconds]
        out += processor.handleInputRows((7,), iter(rows), clock)
    return [row.frame_index for row in out], store


def test_few_pending_frames_cost_one_read_and_one_write_of_state():
    out, store = play([(0, [3, 1, 2]), (2, [5, 4]), (9, [])], idle=100)
    assert out == [1, 2, 3, 4, 5]
    assert {call for kind, call in store.calls if kind == "list"} == set()
    assert store.calls.count(("value", "get")) == store.calls.count(("value", "update")) == 3
    assert len(store.calls) == 6


def test_many_pending_frames_are_read_once_they_are_due():
    frames = list(range(1, 1001))
    out, store = play([(0, frames[::-1]), (0, [1001]), (500, []), (990, [1002]), (2000, [])])
    assert out == [*frames, 1001, 1002]
    # Written in entries of several frames, read in the two batches in which some are due and the list is not empty.
    assert [call for kind, call in store.calls if kind == "list"].count("get") == 2
    assert not store.entries


def test_pending_frames_of_an_older_checkpoint_are_stepped():
    import json

    from watchgrid.streaming import ordered

    _, store = play([])
    processor = ordered.OrderedProcessor(ordered.one_by_one(lambda memo, row: [(row["frame_index"],)]), ["camera_id"], ["camera_id", "frame_index"], "event_time", None)
    processor.init(store)
    store.value = (json.dumps({"memo": {}, "timer": 2000, "last_ms": None, "arrivals": 2}),)
    store.entries = [(3000, 3, 1, json.dumps({"frame_index": 3})), (2000, 2, 2, json.dumps({"frame_index": 2}))]
    assert [row.frame_index for row in processor._release((7,), processor._load(), [], 5000)] == [2, 3]


def test_values_of_one_key_are_narrowed_where_they_lie(spark, monkeypatch):
    """No task gets all values of a key, and a key that is null has a median too."""
    from watchgrid.operators import medians

    seen, real = [], medians._narrowed

    def noted(*given):
        made = real(*given)
        seen.append(made[0].select(F.spark_partition_id().alias("p")).distinct().count())
        return made

    monkeypatch.setattr(medians, "MOST", 100)
    monkeypatch.setattr(medians, "_narrowed", noted)
    rows = spark.range(0, 20_001, 1, 8).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 20_001).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), ("s", 5.0)], "k string, v double"))
    got = {r.k: (r.n, r.lower, r.middle, r.upper) for r in medians.exact_medians(rows, ["k"], "v").collect()}
    assert got == {"k": (20_001, 10_000.0, 10_000.0, 10_000.0), None: (2, 1.0, 1.5, 2.0), "s": (1, 5.0, 5.0, 5.0)}
    assert seen and seen[0] > 1


def test_small_frames_are_compared_without_a_grid_and_lose_no_pair(spark, monkeypatch):
    import random

    from tests.brute import iou
    from watchgrid.operators import detect

    rng, grids, real = random.Random(5), [], detect._pairs_by_grid
    monkeypatch.setattr(detect, "_pairs_by_grid", lambda *given: grids.append(1) or real(*given))

    def rows(seed, sizes):
        return [
            (image, n, (x, y, x + rng.uniform(-1, 30), y + rng.uniform(1, 30)))
            for image, size in enumerate(sizes)
            for n, (x, y) in enumerate((rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(size))
        ]

    def pairs(a, b):
        kind = "image_id long, det_seq long, box struct<x1: double, y1: double, x2: double, y2: double>"
        made = detect.iou_pairs(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 0.2, ["image_id"])
        valid = [(p, q) for p in a for q in b if p[0] == q[0] and p[2][2] > p[2][0] and q[2][2] > q[2][0]]
        wanted = {(p[0], p[1], q[1]): iou(p[2], q[2]) for p, q in valid}
        wanted = {k: pytest.approx(v) for k, v in wanted.items() if v >= 0.2}
        got = [((r.image_id, r.a_seq, r.b_seq), r.iou) for r in made.collect()]
        assert len(got) == len(wanted) and dict(got) == wanted

    pairs(rows(1, [5, 3, 8]), rows(2, [4, 6, 0]))
    assert not grids
    pairs(rows(3, [5, 50, 8]), rows(4, [4, 50, 70]))
    assert len(grids) == 1


def test_colour_priors_judge_all_images_in_one_pass(spark):
    from watchgrid.plans import experiments

    kind = "image_id long, det_seq long, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame([(0, 1, 0.0, 0.0, 10.0, 10.0), (0, 2, 20.0, 0.0, 30.0, 10.0), (2, 1, 0.0, 0.0, 10.0, 10.0)], kind)
    pixels = spark.createDataFrame(
        [(0, 1, 0, 10, 50, 99), (0, 1, 20, 30, 90, 99), (2, 1, 0, 10, 10, 10)], "image_id long, y long, x0 long, x1 long, saturation long, value long"
    )
    truth = spark.createDataFrame([(0,), (1,)], "image_id long")
    made = experiments.colour_prior_stills(det, pixels, truth, spark.range(4).withColumnRenamed("id", "image_id"), cutoffs=(40, 60))
    assert {r.prior: (r.tp, r.fp, r.fn, r.tn) for r in made.collect()} == {"colour off": (1, 1, 1, 1), "S<=40": (0, 0, 2, 2), "S<=60": (1, 0, 1, 2)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_folds_of_very_many_cameras_are_numbered_in_chunks(spark):
    """The transfer takes chunks for its folds, with the same table; a sequence alarms once per floor."""
    from watchgrid.operators import scans
    from watchgrid.plans import experiments

    rows = [
        (camera, "fire", n, float(60 * n), camera * 100 + n, ((camera * 37 + n * 53) % 100) / 100, float(60 * (n - 10)), 0.0, 0.0, 9.0, 9.0)
        for camera in range(9)
        for n in range(1, 21)
    ]
    kind = "camera_id long, hazard string, frame_index long, ts double, det_seq long, confidence double, offset double, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame(rows, kind)
    keys = ["camera_id", "hazard"]
    chunk = scans.chunk_of(F.col("camera_id"), 2)
    plain, cut = (
        sorted(experiments.threshold_transfer(det, det, keys, target_far=0.3, **given).collect()) for given in ({}, {"chunk": chunk})
    )
    assert plain == cut and len(plain) == 2
    sweep = {r.floor: r for r in experiments.floor_sweep(det, det, keys).collect()}
    for floor, row in sweep.items():
        firsts = sorted(min(s) / 60 for c in range(9) if (s := [r[6] for r in rows if r[0] == c and r[5] >= floor and r[6] > 0]))
        assert row.sequences_detected == len(firsts)
        assert row.median_minutes_to_detect == (firsts[len(firsts) // 2] if firsts else None)


def test_hazards_are_compared_and_not_their_clips(spark):
    from watchgrid.operators.reports import uncovered_hazards

    rows = [("fire", False, True), ("fire", True, False), ("flood", False, None), ("flood", None, False), ("traffic", True, False), (None, False, False)]
    manifest = spark.createDataFrame(rows, "hazard string, reference_only boolean, publishable boolean")
    made = uncovered_hazards(manifest)
    assert {r.hazard for r in made.collect()} == {"flood", None}
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_sweep_reads_its_images_once(spark):
    from watchgrid.operators import metrics

    box = "box struct<x1: double, y1: double, x2: double, y2: double>"
    pred = spark.createDataFrame([(0, 1, 0.9, (0.0, 0.0, 9.0, 9.0)), (1, 1, 0.4, (0.0, 0.0, 9.0, 9.0))], f"image_id long, det_seq long, confidence double, {box}")
    truth = spark.createDataFrame([(0, 1, (0.0, 0.0, 9.0, 9.0)), (2, 1, (0.0, 0.0, 9.0, 9.0))], f"image_id long, truth_seq long, {box}")
    images = spark.range(4_321).withColumnRenamed("id", "image_id")
    made = metrics.confidence_sweep(pred, truth, images, (0.3, 0.5))
    assert {r.floor: (r.img_tp, r.img_fp, r.img_fn, r.img_tn) for r in made.collect()} == {0.3: (1, 1, 1, 4_318), 0.5: (1, 0, 1, 4_319)}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4321") == 0


def test_the_state_store_does_not_count_its_rows(spark):
    from watchgrid.streaming.operators import use_rocksdb

    use_rocksdb(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"
