import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.brute import cascade
from tests.test_validator import make
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.operators.flood import rise_estimate
from watchgrid.operators.validator import confirmed_events
from watchgrid.streaming import operators as st
from watchgrid.streaming.ordered import late_rows

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
FRAME = (
    "camera_id string, hazard string, frame_index long, ts double, event_time timestamp, "
    "detections array<struct<box: array<double>, confidence: double, det_seq: long>>"
)


def write_batches(folder, batches):
    folder.mkdir()
    for n, rows in enumerate(batches):
        path = folder / f"{n:03d}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows))
        # The file source reads in order of modification; files written at once may share a time stamp.
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def stamp(ts):
    return (EPOCH + timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def frame_row(camera, hazard, index, ts, dets):
    return dict(
        camera_id=camera, hazard=hazard, frame_index=index, ts=ts, event_time=stamp(ts),
        detections=[dict(box=list(d[2]), confidence=d[1], det_seq=d[0]) for d in dets],
    )


def run(stream, tmp_path, name):
    out, mark = str(tmp_path / f"{name}_out"), str(tmp_path / f"{name}_mark")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return out, query


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    st.use_rocksdb(spark)


def test_stream_equals_batch_although_frames_arrive_out_of_order(spark, tmp_path):
    frames = make(11, cameras=2, length=40)
    rows = sorted((frame_row(*f) for f in frames), key=lambda r: r["ts"])
    rng = random.Random(5)
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    for batch in batches:
        rng.shuffle(batch)
    # Far later frames of another camera move the watermark past everything.
    batches += [[frame_row("end", "fire", 1, 1e5 + n, [])] for n in range(2)]
    write_batches(tmp_path / "in", batches)
    configs = [
        ValidatorConfig("a", cooldown_seconds=12.0),
        ValidatorConfig("b", low_confidence_association=True, enable_cooldown=False),
    ]
    stream = st.validate_stream(source(spark, tmp_path / "in", FRAME), configs, delay="120 seconds")
    out, _ = run(stream, tmp_path, "cascade")
    got = spark.read.parquet(out).collect()
    for config in configs:
        want = {}
        for camera in ("cam0", "cam1"):
            want |= cascade([f[2:] for f in frames if f[0] == camera], config)
        mine = {r.det_seq: (r.rejected_by, r.track, r.hits, r.peak, r.first_frame) for r in got if r.config_id == config.config_id}
        assert mine == want

    # Alerts from the same rows, written twice under one batch number, are there once.
    from watchgrid.sources.alerts import alert_writer

    seen = []
    events = confirmed_events(spark.read.parquet(out).filter("config_id = 'a'"))
    sink = alert_writer(str(tmp_path / "alerts"), lambda df, n: seen.append((n, df.count())))
    sink(events, 7)
    sink(events, 7)
    assert spark.read.json(str(tmp_path / "alerts")).count() == events.count() == seen[0][1] == seen[1][1]

    counters = {r.camera_id: r for r in st.live_counters(spark.read.parquet(out)).collect()}
    for r in counters.values():
        assert r.proposed == r.confirmed + r.rejected_confidence + r.rejected_persistence + r.rejected_cooldown


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    seen = [frame_row("cam", "fire", i, float(i), [(i, 0.9, (0, 0, 60.0, 60.0))]) for i in range(5)]
    later = [frame_row("cam", "fire", 5, 5000.0, [])]
    late = [frame_row("cam", "fire", 6, 2.5, [(6, 0.9, (0, 0, 60.0, 60.0))])]
    write_batches(tmp_path / "in", [seen, later, [frame_row("cam", "fire", 7, 6000.0, [])], late])
    stream = st.validate_stream(source(spark, tmp_path / "in", FRAME), [ValidatorConfig("a")], delay="10 seconds")
    out, query = run(stream, tmp_path, "late")
    assert {r.det_seq for r in spark.read.parquet(out).collect()} == {0, 1, 2, 3, 4}
    assert late_rows(query) == 1


def test_late_frames_come_out_by_name_and_the_rest_as_before(spark, tmp_path):
    box = (0, 0, 60.0, 60.0)
    seen = [frame_row("cam", "fire", i, float(i + 1), [(i, 0.9, box)]) for i in range(5)]
    late = [frame_row("cam", "fire", 6, 2.5, [(6, 0.9, box)]), frame_row("new", "flood", 1, 5990.0, [(7, 0.9, box)]), frame_row("cam", "fire", 8, 5995.0, [(8, 0.9, box)])]
    batches = [seen, [frame_row("cam", "fire", 5, 5000.0, [])], [frame_row("cam", "fire", 7, 6000.0, [])], late, [frame_row("end", "fire", 1, 9000.0, [])], [frame_row("end", "fire", 2, 9001.0, [])]]
    write_batches(tmp_path / "in", batches)
    stream = st.validate_stream(source(spark, tmp_path / "in", FRAME), [ValidatorConfig("a")], delay="8 seconds", name_late=True)
    out, query = run(stream, tmp_path, "named")
    rows = spark.read.parquet(out).collect()
    named = {(r.camera_id, r.hazard, r.frame_index): (r.late_ms, r.ts, r.config_id, r.track_id) for r in rows if r.status == "late"}
    assert named == {("cam", "fire", 6): (5_990_000, 2.5, None, -1), ("new", "flood", 1): (2000, 5990.0, None, -1)}
    assert {r.det_seq for r in rows if r.status is None} == {0, 1, 2, 3, 4, 8}
    assert late_rows(query) == 0  # the engine had nothing to drop


def test_alerts_are_stored_once_by_event_id_whatever_is_repeated(spark, tmp_path):
    from watchgrid.sources.alerts import alert_writer

    def events(frames, track=1):
        rows = [("a", "cam", "fire", 0.9, 0.0, 0.0, 60.0, float(track), 1, f, 1.0, f * 40_000.0, 3, track, 1.0) for f in frames]
        return spark.createDataFrame(rows, "config_id string, camera_id string, hazard string, confidence double, x1 double, y1 double, x2 double, y2 double,"
            "first_seen_frame long, confirmed_frame long, first_seen_time double, confirmed_time double, supporting_detections long, track_id long, seconds_to_confirm double")  # fmt: skip

    path = str(tmp_path / "alerts")
    stored = lambda: sorted((r.track_id, r.confirmed_frame, str(r.day)) for r in spark.read.json(path).collect())
    sink = alert_writer(path)
    sink(events([]), 0)
    sink(events([1, 2, 3]), 1)
    sink(events([1, 2, 3]), 1)  # the batch is replayed
    first = stored()
    assert first == [(1, 1, "1970-01-01"), (1, 2, "1970-01-01"), (1, 3, "1970-01-02")]
    # A restart from nothing cuts its batches elsewhere; one event is new, one is twice in a batch.
    again = alert_writer(path)
    again(events([1]), 0)
    again(events([2, 3, 4, 4]), 1)
    again(events([2], track=2), 2)
    assert stored() == [*first, (1, 4, "1970-01-02"), (2, 2, "1970-01-01")]
    assert spark.read.json(path).select("event_id").distinct().count() == 5


def test_an_idle_camera_is_forgotten(spark, tmp_path):
    box = (0, 0, 60.0, 60.0)
    rows = [[frame_row("cam", "fire", i, float(i), [(i, 0.9, box)])] for i in range(2)]
    rows += [[frame_row("other", "fire", 1, 4000.0, [])], [frame_row("other", "fire", 2, 5000.0, [])]]
    rows += [[frame_row("cam", "fire", 2, 6000.0, [(2, 0.9, box)])], [frame_row("other", "fire", 3, 9000.0, [])]]
    rows += [[frame_row("other", "fire", 4, 9100.0, [])]]
    write_batches(tmp_path / "in", rows)
    config = [ValidatorConfig("a", enable_cooldown=False)]
    stream = st.validate_stream(source(spark, tmp_path / "in", FRAME), config, delay="1 second", idle_seconds=600.0)
    out, _ = run(stream, tmp_path, "idle")
    hits = {r.det_seq: r.hits for r in spark.read.parquet(out).filter("camera_id = 'cam'").collect()}
    assert hits == {0: 1, 1: 2, 2: 1}


SERIES = (
    "camera_id string, frame_index long, ts double, event_time timestamp, value double, area_fraction double, "
    "level_fraction double, metres double, signature string"
)


def test_change_rise_and_repeats_agree_with_the_batch_forms(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for camera in ("a", "b"):
        level = 0.2
        for i in range(40):
            level += 0.02 if i > 15 else rng.uniform(-0.004, 0.004)
            rows.append(
                dict(camera_id=camera, frame_index=i, ts=i * 30.0, event_time=stamp(i * 30.0), value=level, area_fraction=level,
                     level_fraction=level / 2 if camera == "a" else None, metres=3.0, signature=rng.choice("xy"))
            )
    end = [dict(camera_id="end", frame_index=0, ts=1e6 + n, event_time=stamp(1e6 + n), value=0.0, area_fraction=0.0, signature="z") for n in range(2)]
    rows.sort(key=lambda r: r["ts"])
    write_batches(tmp_path / "in", [rows[:30], rows[30:], *[[e] for e in end]])
    src = lambda: source(spark, tmp_path / "in", SERIES)

    out, _ = run(st.page_hinkley_stream(src(), delay="1 second"), tmp_path, "ph")
    got = {(r.camera_id, r.frame_index): (round(r.statistic, 9), r.alarm) for r in spark.read.parquet(out).filter("camera_id <> 'end'").collect()}
    from watchgrid.operators.flood import page_hinkley

    table = spark.read.schema(SERIES).json(str(tmp_path / "in")).filter("camera_id <> 'end'")
    batch = page_hinkley(table, ["camera_id"], F.floor(F.col("ts") / 200), ("ts", "frame_index"))
    assert got == {(r.camera_id, r.frame_index): (round(r.statistic, 9), r.alarm) for r in batch.collect()}
    assert sum(alarm for _, alarm in got.values()) == 2

    out, _ = run(st.rise_stream(src(), delay="1 second"), tmp_path, "rise")
    key = lambda r: (r.trend, round(r.area_rate_per_min, 9), r.level_rate_per_min and round(r.level_rate_per_min, 9), r.samples, round(r.r_squared, 9))
    got = {(r.camera_id, r.frame_index): key(r) for r in spark.read.parquet(out).filter("camera_id <> 'end'").collect()}
    assert got == {(r.camera_id, r.frame_index): key(r) for r in rise_estimate(table).collect()}

    out, _ = run(st.drop_repeats_stream(src(), delay="1 second"), tmp_path, "repeats")
    from watchgrid.operators.sampling import drop_repeats

    got = {(r.camera_id, r.frame_index) for r in spark.read.parquet(out).filter("camera_id <> 'end'").collect()}
    batch = drop_repeats(table, F.floor(F.col("ts") / 300))
    assert got == {(r.camera_id, r.frame_index) for r in batch.collect()}
