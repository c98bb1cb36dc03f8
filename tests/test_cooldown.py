import random

import pytest
from pyspark.sql import functions as F

from tests.brute import cascade, iou
from watchgrid.operators import cooldown, validator
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.operators.validator import validate

SCHEMA = "camera_id string, config_id string, place long, ts double, cool double, iou double, x1 double, y1 double, x2 double, y2 double"
KEYS = ["camera_id", "config_id"]


def brute(rows):
    passed, recent = set(), {}
    for camera, config, place, ts, cool, least, *box in sorted(rows, key=lambda r: r[:3]):
        seen = recent.setdefault((camera, config), [])
        if not any(ts - t <= cool and iou(box, b) >= least for b, t in seen):
            seen.append((box, ts))
            passed.add((camera, config, place))
    return passed


def make(seed, n, cool, least, kinds):
    """``kinds``: a steady thing that jitters, one that drifts, one that comes and goes, chance boxes, boxes without extent."""
    rng, rows, ts = random.Random(seed), [], 0.0
    for place in range(n):
        ts += rng.choice([0.0, 0.5, 1.0, 1.0]) if rng.random() < 0.98 else 3 * cool
        kind = rng.choice(kinds)
        x, y, w = {
            "steady": (100 + rng.uniform(-4, 4), 100 + rng.uniform(-4, 4), 60),
            "other": (300 + rng.uniform(-2, 2), 100, 50),
            "drift": (500 + ts / 3, 100 + ts / 5, 60),
            "guest": (130 + rng.uniform(-30, 30), 110, 60),
            "chance": (rng.uniform(0, 900), rng.uniform(0, 400), rng.uniform(5, 90)),
            "flat": (100, 100, 0),
        }[kind]
        x, y, w = float(x), float(y), float(w)
        rows.append(("cam", "a", place, ts, cool, least, x, y, x + w, y + w))
        if place % 3 == 0:
            rows.append(("cam", "b", place, ts, cool * 2, least / 2, x, y, x + w, y + w))
    return rows


@pytest.mark.parametrize("seed,cool,least,kinds,block", [
    (1, 12.0, 0.3, ["steady", "other"], 4),
    (2, 9.0, 0.3, ["steady", "other", "drift"], 32),
    (3, 10.0, 0.3, ["steady", "guest", "other", "drift", "flat"], 4),
    (4, 7.0, 0.2, ["chance", "steady"], 8),
    (5, 0.0, 0.5, ["steady", "other"], 4),
    (6, 6.0, 0.0, ["steady", "other"], 4),
])
def test_equal_to_an_ordered_run(spark, monkeypatch, seed, cool, least, kinds, block):
    monkeypatch.setattr(cooldown, "BLOCK_SLICES", block)
    rows = make(seed, 600, cool, least, kinds)
    got = cooldown.let_through(spark.createDataFrame(rows, SCHEMA).repartition(3), KEYS)
    assert {(r.camera_id, r.config_id, r.place) for r in got.collect()} == brute(rows)


def test_no_candidates(spark):
    assert cooldown.let_through(spark.createDataFrame([], SCHEMA), KEYS).count() == 0


def largest_groups(monkeypatch):
    """The most rows that any ordered pass brings together in one group."""
    sizes = []
    ordered, run = cooldown._ordered, validator._run

    def counted(df, group):
        sizes.append(df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0)
        return ordered(df, group)

    def counted_run(rows, states, keys, function, schema, together=None):
        group = together or [*keys, "_chunk"]
        sizes.append(rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0)
        return run(rows, states, keys, function, schema, together)

    monkeypatch.setattr(cooldown, "_ordered", counted)
    monkeypatch.setattr(validator, "_run", counted_run)
    return sizes


def test_one_camera_with_steady_things_never_meets_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(cooldown, "BLOCK_SLICES", 8)
    rng = random.Random(9)
    frames, seq = [], 0
    for i in range(1, 2401):
        dets = []
        for x in (0.0, 200.0, 400.0):
            dets.append((seq, 0.9, (x + rng.uniform(-3, 3), 0.0, x + 60.0, 60.0)))
            seq += 1
        frames.append((i, float(i), dets))
    rows = [("cam", "fire", i, t, d[0], d[1], *d[2]) for i, t, dets in frames for d in dets]
    schema = "camera_id string, hazard string, frame_index long, ts double, det_seq long, confidence double, x1 double, y1 double, x2 double, y2 double"
    det = spark.createDataFrame(rows, schema)
    frame = spark.createDataFrame([("cam", "fire", i, t) for i, t, _ in frames], "camera_id string, hazard string, frame_index long, ts double")
    config = ValidatorConfig("steady", cooldown_seconds=13.0)
    sizes = largest_groups(monkeypatch)
    got = {r.det_seq: r.rejected_by for r in validate(det, [config], frame, chunk_frames=100).collect()}
    assert got == {k: v[0] for k, v in cascade(frames, config).items()}
    assert sizes and max(sizes) <= 3 * 100 < len(rows) / 20
