import random

import pytest

from tests.brute import cascade
from watchgrid.operators import validator
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.operators.validator import confirmed_events, validate

CONFIGS = [
    ValidatorConfig("base", cooldown_seconds=12.0),
    ValidatorConfig("assoc", low_confidence_association=True, enable_cooldown=False),
    ValidatorConfig("no_conf", enable_confidence=False, min_frames=2, cooldown_seconds=4.0),
    ValidatorConfig("no_pers", enable_persistence=False, track_iou=0.5, cooldown_seconds=3.0),
    ValidatorConfig("tight", max_misses=0, min_frames=2, enable_cooldown=False),
]


def make(seed, cameras=4, length=60):
    rng = random.Random(seed)
    seq, frames, rows = 0, [], []
    for camera in range(cameras):
        spots = [(rng.randrange(0, 200, 20), rng.randrange(0, 200, 20)) for _ in range(4)]
        index = 0
        for _ in range(length):
            index += rng.choice([1, 1, 1, 2])
            ts = float(index)
            dets = []
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                x, y = rng.choice(spots)
                x += rng.choice([0, 0, 10, 30])
                box = (float(x), float(y), x + 60.0, y + rng.choice([0.0, 60.0, 60.0]))
                dets.append((seq, rng.choice([0.03, 0.1, 0.19, 0.2, 0.4, 0.4, 0.9]), box))
                seq += 1
            frames.append((f"cam{camera}", "fire", index, ts, dets))
    return frames


def as_tables(spark, frames):
    det = [
        (c, h, i, t, d[0], d[1], *d[2]) for c, h, i, t, dets in frames for d in dets
    ]
    det = spark.createDataFrame(
        det, "camera_id string, hazard string, frame_index long, ts double, det_seq long, confidence double,"
        "x1 double, y1 double, x2 double, y2 double"
    )
    frame = spark.createDataFrame(
        [(c, h, i, t) for c, h, i, t, _ in frames], "camera_id string, hazard string, frame_index long, ts double"
    )
    return frame, det


def expected(frames, cfg):
    out = {}
    for camera in {f[0] for f in frames}:
        out |= cascade([f[2:] for f in frames if f[0] == camera], cfg)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 1000), (2, 7), (3, 3), (4, 16), (5, 25)])
def test_every_level_matches_a_sequential_run_with_any_chunk_length(spark, seed, chunk):
    frames = make(seed)
    frame, det = as_tables(spark, frames)
    got = validate(det, CONFIGS, frame, chunk_frames=chunk).collect()
    for cfg in CONFIGS:
        want = expected(frames, cfg)
        mine = {
            r.det_seq: (r.rejected_by, r.track, r.hits, r.peak, r.first_frame)
            for r in got
            if r.config_id == cfg.config_id
        }
        assert mine == want, cfg.config_id


def test_one_long_track_over_many_chunks_keeps_its_identity(spark):
    frames = [("cam", "fire", i, float(i), [(i, 0.5 + i / 1000, (0.0, 0.0, 60.0, 60.0))]) for i in range(1, 100)]
    frame, det = as_tables(spark, frames)
    cfg = ValidatorConfig("c", cooldown_seconds=10.0)
    rows = validate(det, [cfg], frame, chunk_frames=9).collect()
    want = expected(frames, cfg)
    assert {r.det_seq: (r.rejected_by, r.track, r.hits, r.peak, r.first_frame) for r in rows} == want
    assert {r.track for r in rows} == {1}


def test_event_carries_the_peak_and_track_ids_only_when_confirmed(spark):
    frames = [("cam", "fire", i, float(i), [(i, c, (0.0, 0.0, 60.0, 60.0))]) for i, c in enumerate([0.9, 0.3, 0.4, 0.5])]
    _, det = as_tables(spark, frames)
    annotated = validate(det, [ValidatorConfig("c")])
    events = confirmed_events(annotated).collect()
    assert [(e.confidence, e.confirmed_frame, e.supporting_detections) for e in events] == [(0.9, 2, 3)]
    ids = {r.det_seq: r.track_id for r in annotated.collect()}
    assert ids == {0: -1, 1: -1, 2: 1, 3: -1}


@pytest.mark.parametrize("cooldown", [60.0, 300.0])
def test_a_steady_object_costs_few_passes_over_many_chunks(spark, monkeypatch, cooldown):
    frames = [("cam0", "fire", i, float(i), [(i, 0.9, (0.0, 0.0, 50.0, 50.0))]) for i in range(1, 1601)]
    frames += [("cam1", "fire", i, float(i), [(10_000 + i, 0.9, (0.0, 0.0, 50.0, 50.0))] if i % 90 < 50 else []) for i in range(1, 1601)]
    frame, det = as_tables(spark, frames)
    passes, ran = [], validator._run
    monkeypatch.setattr(validator, "_run", lambda *a, **b: passes.append(1) or ran(*a, **b))
    config = ValidatorConfig("steady", cooldown_seconds=cooldown)
    got = {r.det_seq: (r.rejected_by, r.track_id) for r in validate(det, [config], frame, chunk_frames=40).collect()}
    want = expected(frames, config)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len(passes) <= 4
