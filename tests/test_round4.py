"""Findings of the fourth round: each test failed before its change."""

from __future__ import annotations

import math
from datetime import datetime, timezone
from types import SimpleNamespace

from pyspark.sql import Row, types as T

from tests.test_round3 import Store, events_of
from watchgrid.streaming import operators as st
from watchgrid.streaming import ordered


class OneValue(Store):
    """As ``Store``, with the value alone."""

    def getListState(self, name, schema):  # noqa: N802
        raise AssertionError("a group keeps no list")


def test_keys_of_a_group_share_one_read_and_one_write_of_state():
    def visits(memo, row):
        memo["n"] = memo.get("n", 0) + 1
        return [(row["frame_index"], memo["n"])]

    names = ["camera_id", "frame_index", "visit_frame"]
    processor = ordered.GroupedProcessor(ordered.one_by_one(visits), ["camera_id"], names, T.StructType(), 100.0)
    store, out = OneValue(), []
    processor.init(store)
    # Camera 2 is quiet from second 1 to 300, camera 1 never for 100 seconds.
    batches = [(0, [(1, 5), (1, 3), (2, 1)]), (50, [(1, 90)]), (95, [(1, 180)]), (200, [(1, 260)]), (290, [(2, 300)]), (1000, [])]
    for watermark, frames in batches:
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w * 1000)
        rows = [Row(_group=0, _line=f'{s * 1_000_000}\t{{"camera_id":{c}}}\t{{"frame_index":{s}}}') for c, s in frames]
        out += [tuple(r) for r in processor.handleInputRows((0,), iter(rows), clock)]
        assert len(store.timers) <= 1
    assert sorted(out) == [(1, 3, 1), (1, 5, 2), (1, 90, 3), (1, 180, 4), (1, 260, 5), (2, 1, 1), (2, 300, 1)]
    assert [call for _, call in store.calls].count("get") == len(batches)
    assert len(store.calls) == 2 * len(batches)
    assert store.value is None and not store.timers


ODD = "camera_id string, hazard long, frame_index long, x double, boxes array<struct<v: double, s: string>>, event_time timestamp"


def test_shared_state_gives_what_a_state_for_each_key_gives(spark, tmp_path):
    """Odd texts as keys, missing and endless numbers, frames out of order, keys that go quiet; all in two groups."""
    st.use_rocksdb(spark)
    odd = [None, math.nan, math.inf, -math.inf, -0.0, 0.1, 1e300]
    frames = []
    for n in range(120):
        key = (['a\tb', 'line\nend', '"NaN"', "ü", None][n % 5], [None, 7][n % 2])
        x = odd[n % 7]
        boxes = None if n % 11 == 0 else [(x, "NaN"), (1.5, None)][: n % 3]
        frames.append((*key, None if n % 13 == 0 else n, x, boxes, 10 + (n * 37) % 50 + 200 * (n // 30)))
    frames += [("end", 0, 1, 0.0, [], 10_000), ("end", 0, 2, 0.0, [], 10_001)]
    for start in (*range(0, 120, 30), 120, 121):
        part = frames[start : start + (30 if start < 120 else 1)]
        made = [(*f[:5], datetime.fromtimestamp(f[5], timezone.utc)) for f in part]
        spark.createDataFrame(made, ODD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def step(memo, row):
        memo["n"] = memo.get("n", 0) + 1
        return [(row["frame_index"], row["x"], repr(row["boxes"]), memo["n"])]

    got = {}
    for groups in (None, 2):
        source = spark.readStream.schema(ODD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = ordered.step_in_order(source, ["camera_id", "hazard"], ordered.one_by_one(step), "frame_index long, x double, boxes string, n long",
            delay="1 second", idle_seconds=90.0, groups=groups)
        made = stream.writeStream.format("parquet").option("path", str(tmp_path / f"out{groups}")).option("checkpointLocation", str(tmp_path / f"mark{groups}"))
        made.trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(str(tmp_path / f"out{groups}")).filter("camera_id is null or camera_id <> 'end'").collect()
        got[groups] = sorted(repr(tuple(r)) for r in rows)
    assert len(got[None]) == 120 and got[2] == got[None]
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "_group" in plan


def test_other_types_keep_a_state_for_each_key(spark):
    rows = spark.readStream.format("rate").load().selectExpr("timestamp AS event_time", "CAST(timestamp AS date) AS day", "value AS frame_index")
    stream = ordered.step_in_order(rows, ["day"], ordered.one_by_one(lambda memo, row: []), "frame_index long")
    assert "_group" not in stream._jdf.queryExecution().analyzed().toString()


def test_a_wave_of_the_idle_replay_is_one_batch_of_several_files(spark, tmp_path, monkeypatch):
    """Waves of more and of fewer rows than there are files: each is one batch, and more than one task writes it."""
    from watchgrid.catalog import fixtures as fx, streams

    day, sizes = 86_400.0, (30, 3, 1, 1, 12)
    rows = [(100 * w + n, (3 * w + 3 + 0.05 * n) * day, n % 3, "error", 50.0) for w, size in enumerate(sizes) for n in range(size)]
    folders, seen, real, drain = [], [], fx.shared_folder, streams.drain

    def noted(spark_, stream):
        out, done = drain(spark_, stream)
        seen.extend(p.numInputRows for p in done.recentProgress)
        return out, done

    monkeypatch.setattr(fx, "shared_folder", lambda s: folders.append(real(s)) or folders[-1])
    monkeypatch.setattr(streams, "drain", noted)
    got = {(r.camera_id, r.frame_index): r.visit_frame for r in streams.st09(spark, events_of(spark, tmp_path, rows)).collect()}
    files = len(spark.read.json(folders[0]).inputFiles())
    assert files == streams.FILES * (len(sizes) + 2)
    real_rows = spark.read.json(folders[0]).filter("camera_id <> -1").count()
    assert real_rows == len(rows) == len(got)
    # Each batch holds its wave and what fills it up, never rows of the next wave.
    assert [min(n, size) for n, size in zip(seen, sizes)] == list(sizes) and all(n < size + streams.FILES for n, size in zip(seen, sizes))
    # A frame opens a new visit if the watermark of the batch before had passed the last one by two days.
    want, last, count, newest = {}, {}, {}, []
    for w, size in enumerate(sizes):
        mark = max(newest[: w - 1]) - 60.0 if w > 1 else None
        for n in range(size):
            camera, at = n % 3, (3 * w + 3 + 0.05 * n) * day
            if mark is not None and camera in last and last[camera][0] < w and mark >= last[camera][1] + 2 * day:
                count[camera] = 0
            count[camera] = count.get(camera, 0) + 1
            last[camera] = (w, at)
            want[camera, len([k for k in want if k[0] == camera]) + 1] = count[camera]
        newest.append((3 * w + 3 + 0.05 * (size - 1)) * day)
    assert got == want and 1 in [v for k, v in got.items() if k[1] > 11]


def test_the_cascade_can_keep_rejected_rows_to_itself(spark, tmp_path, monkeypatch):
    """The same confirmed rows, and the alert sink takes no others out of the operator."""
    from tests.test_validator import make
    from watchgrid.catalog import streams
    from watchgrid.operators.cascade import ValidatorConfig

    configs = [ValidatorConfig("a", cooldown_seconds=12.0), ValidatorConfig("b", enable_cooldown=False)]
    by_key: dict = {}
    for camera, hazard, index, ts, found in make(11, cameras=2, length=60):
        dets = [dict(confidence=c, box=box, det_seq=seq) for seq, c, box in found]
        by_key.setdefault((camera, hazard), []).append(dict(hazard=hazard, frame_index=index, ts=ts, detections=dets))
    confirmed, memos = 0, ({}, {})
    for key, frames in by_key.items():
        for start in range(0, len(frames), 20):  # the state goes on from call to call
            every, kept = (st.cascade_step(configs, only)(memo.setdefault(key, {}), frames[start : start + 20]) for only, memo in zip((False, True), memos))
            assert kept == [row for row in every if row[9] is None] and len(kept) < len(every)
            confirmed += len(kept)
    assert confirmed and memos[0] == memos[1]

    options, real = [], st.validate_stream
    monkeypatch.setattr(st, "validate_stream", lambda *a, **k: options.append(k) or real(*a, **k))
    rows = [(4 * n, 60.0 * n + 60, 2, "error", 90.0) for n in range(4)]
    got = streams.st04(spark, events_of(spark, tmp_path, rows)).collect()
    assert [(r.confirmed_frame, r.supporting_detections) for r in got] == [(3, 3)] and options == [{"confirmed_only": True}]
