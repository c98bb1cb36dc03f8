import random

import pytest
from pyspark.sql import functions as F

from tests.brute import cascade
from watchgrid.operators.cascade import ValidatorConfig
from watchgrid.plans import experiments

KEYS = ["camera_id", "hazard"]
SCHEMA = (
    "camera_id string, hazard string, role string, frame_index long, ts double, offset double, det_seq long, "
    "confidence double, x1 double, y1 double, x2 double, y2 double"
)


def sequences(seed):
    """Positive and negative sequences with empty frames; offsets in steps of a minute."""
    rng = random.Random(seed)
    frames, seq = [], 0
    for n in range(10):
        role = "positive" if n % 2 else "negative"
        for i in range(20):
            offset = (i - (10 if role == "positive" else 20)) * 60.0
            dets = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                x = rng.choice([0.0, 100.0, 110.0])
                confidence = rng.choice([0.1, 0.2, 0.3, 0.6, 0.9]) if offset >= 0 else rng.choice([0.1, 0.2, 0.25, 0.5])
                dets.append((seq, confidence, (x, 0.0, x + 60, 60.0)))
                seq += 1
            frames.append((f"{n:02d}", "fire", role, i + 1, offset, dets))
    return frames


def tables(spark, frames):
    det = [(c, h, role, i, o, o, d[0], d[1], *d[2]) for c, h, role, i, o, dets in frames for d in dets]
    every = [(c, h, role, i, o) for c, h, role, i, o, _ in frames]
    return (
        spark.createDataFrame(det, SCHEMA),
        spark.createDataFrame(every, "camera_id string, hazard string, role string, frame_index long, offset double"),
    )


def brute(frames, cfg, raw_floor=None, cameras=None):
    pre = post = apre = apost = alerts = 0
    first = {}
    for name in sorted({f[0] for f in frames}):
        if cameras is not None and name not in cameras:
            continue
        mine = [f for f in frames if f[0] == name]
        role = mine[0][2]
        out = cascade([(i, o, d) for _, _, _, i, o, d in mine], cfg) if cfg else None
        for _, _, _, _, offset, dets in mine:
            if cfg:
                n = sum(out[d[0]][0] is None for d in dets)
            else:
                n = sum(d[1] >= raw_floor for d in dets)
            alerts += n
            if offset < 0 and role == "negative":
                pre, apre = pre + 1, apre + bool(n)
            if offset >= 0 and role == "positive":
                post, apost = post + 1, apost + bool(n)
                if n and offset > 0:
                    first.setdefault(name, offset / 60)
    v = sorted(first.values())
    return (
        apre / pre if pre else None, apost / post if post else None, len(first), v[len(v) // 2] if v else None, alerts
    )


def test_ablation_matches_a_sequential_replay(spark):
    frames = sequences(1)
    det, every = tables(spark, frames)
    got = {r.config_id: r for r in experiments.ablation(det, every, KEYS).collect()}
    want = {"raw": brute(frames, None, 0.20)} | {c.config_id: brute(frames, c) for c in experiments.ablation_configs()}
    assert set(got) == set(want)
    for name, (far, recall, found, minutes, _) in want.items():
        r = got[name]
        assert r.false_alarm_rate == pytest.approx(far) and r.detection_rate == pytest.approx(recall)
        assert (r.sequences_detected, r.median_minutes_to_detect, r.total_sequences) == (found, minutes, 5)


def test_floor_sweep_equals_one_replay_per_floor(spark):
    frames = sequences(2)
    det, every = tables(spark, frames)
    floors = (0.2, 0.25, 0.5, 0.55, 0.95)
    got = {r.floor: r for r in experiments.floor_sweep(det, every, KEYS, floors).collect()}
    for floor in floors:
        far, recall, found, minutes, alerts = brute(frames, None, floor)
        r = got[floor]
        assert r.false_alarm_rate == pytest.approx(far) and r.detection_rate == pytest.approx(recall)
        assert (r.sequences_detected, r.median_minutes_to_detect, r.alerts) == (found, minutes, alerts)


def test_transferred_floor_is_tuned_on_the_other_cameras(spark):
    frames = sequences(3)
    det, every = tables(spark, frames)
    rows = {r.direction: r for r in experiments.threshold_transfer(det, every, KEYS, target_far=0.2).collect()}
    names = sorted({f[0] for f in frames})
    folds = {"A": set(names[0::2]), "B": set(names[1::2])}

    def tune(fold):
        for step in range(20, 96):
            far = brute(frames, None, step / 100, folds[fold])[0]
            if far is not None and round(far, 4) <= 0.2:
                return step / 100
        return 0.95

    cfg = ValidatorConfig("cascade", enable_cooldown=False)
    for train, test in ("AB", "BA"):
        r = rows[f"{train}->{test}"]
        floor = tune(train)
        far, recall = brute(frames, None, floor, folds[test])[:2]
        assert r.tuned_floor == floor and r.oracle_floor == tune(test)
        assert r.transfer_far == (far and pytest.approx(far)) and r.transfer_recall == (recall and pytest.approx(recall))
        far, recall = brute(frames, cfg, cameras=folds[test])[:2]
        assert r.cascade_far == (far and pytest.approx(far)) and r.cascade_recall == (recall and pytest.approx(recall))
    verdict = experiments.transfer_verdict(spark.createDataFrame([(0.03, 0.01)], "transfer_far double, cascade_far double")).first()
    assert verdict.cascade_holds_better


def test_a_configuration_without_any_alarm_is_reported(spark):
    frames = sequences(4)
    det, every = tables(spark, frames)
    strict = ValidatorConfig("strict", min_confidence=0.99, enable_cooldown=False)
    alarms, _ = experiments.arms(det, every, [strict], KEYS, raw_floor=None)
    from watchgrid.operators.metrics import sequence_metrics

    row = sequence_metrics(every, alarms, sequence=KEYS, config_ids=["strict"]).first()
    assert (row.false_alarm_rate, row.detection_rate, row.sequences_detected, row.median_minutes_to_detect) == (0.0, 0.0, 0, None)


def test_registry_rules(spark):
    from watchgrid.operators import gate
    from watchgrid.sources import dims, registry

    schema = registry.REGISTRY_SCHEMA
    good = ("cam", "clip.mp4", "river", None, None, None, None, None, None)
    bad = ("cam2", "clip.mp4", "moon", None, ["fire", "plague"], "sideways", None, (-1.0, None, True), None)
    cameras, violations = registry.load_cameras(spark.createDataFrame([good, bad, good], schema))
    assert {(r.camera_id, r.violation) for r in violations.collect()} == {
        ("cam", "duplicate_camera_id"), ("cam2", "unknown_context"), ("cam2", "unknown_hazard"),
        ("cam2", "unknown_viewpoint"), ("cam2", "raw_video_retention"), ("cam2", "negative_buffer"),
    }
    strict, _ = registry.load_cameras(spark.createDataFrame([good, bad], schema), strict=True)
    with pytest.raises(Exception, match="invalid camera registry"):
        strict.collect()
    fine, _ = registry.load_cameras(spark.createDataFrame([good], schema), strict=True)
    row = fine.first()
    assert row.enabled and row.retention.rolling_buffer_seconds == 10.0 and not row.retention.store_raw_video

    known = spark.createDataFrame(
        [("a", "x.mp4", "uav_search", None, None, None, True), ("b", "7", "forest", None, ["traffic"], "nadir_aerial", True),
         ("c", "rtsp://c", "forest", None, None, None, False), ("d", "y.mp4", "moon", None, None, None, True)],
        "camera_id string, source string, context string, name string, hazards array<string>, viewpoint string, enabled boolean",
    )
    gates = gate.gate(known)
    assert {(r.camera_id, r.hazard) for r in gates.collect()} == {("a", "building_access"), ("a", "drowning"), ("b", "traffic")}
    assert [r.camera_id for r in gate.envelope_violations(gates, dims.envelope_dim(spark)).collect()] == ["b"]
    files = spark.createDataFrame([("x.mp4",)], "file string")
    missing = gate.missing_sources(known, files)
    assert [r.camera_id for r in missing.collect()] == ["d"]
    assert {r.camera_id: r.enabled for r in gate.disable_missing(known, missing).collect()} == {"a": True, "b": True, "c": False, "d": False}
    det = spark.createDataFrame([("a",), ("zz",)], "camera_id string")
    with pytest.raises(Exception, match="not registered: zz"):
        gate.require_known(det, known).collect()
    assert [r.camera_id for r in gate.unknown_cameras(det, known).collect()] == ["zz"]


def test_claims_within_tolerance(spark):
    claims = spark.createDataFrame([("m", "f", "r.json", "a|b", 0.9568), ("m", "g", "r.json", "a|c", 0.5)], "model string, figure string, file string, path string, claimed double")
    facts = spark.createDataFrame([("r.json", "a|b", "0.9572"), ("r.json", "a|c", "0.501")], "file string, path string, value string")
    assert {r.figure: r.status for r in experiments.verify_claims(claims, facts).collect()} == {"f": "ok", "g": "mismatch"}


def test_claims_and_facts_are_whole_on_both_sides(spark):
    claims = [("m", "ok", "r", "a", 0.5), ("m", "path", "r", "gone", 0.5), ("m", "file", "lost", "a", 0.5), ("m", "none", None, "a", 0.5), ("m", "null", "r", "n", 0.5), ("m", "registry", "r", "a", None), ("m", "text", "r", "t", 1.0)]
    facts = [("r", "a", "0.5"), ("r", "n", None), ("r", "t", "words"), ("r", "spare", "0.1"), ("alone", "a", "1")]
    c = spark.createDataFrame(claims, "model string, figure string, file string, path string, claimed double")
    f = spark.createDataFrame(facts, "file string, path string, value string")
    got = sorted((r.figure or "", r.file or "", r.path, r.status) for r in experiments.verify_claims(c, f).collect())
    assert got == sorted([
        ("ok", "r", "a", "ok"), ("path", "r", "gone", "path_absent"), ("file", "lost", "a", "file_absent"), ("none", "", "a", "no_source_cited"),
        ("null", "r", "n", "absent_from_results"), ("registry", "r", "a", "absent_from_registry"), ("text", "r", "t", "absent_from_results"),
        ("", "r", "spare", "unclaimed"), ("", "alone", "a", "unclaimed"),
    ])
    models = spark.createDataFrame([], "model string, status string, results_file string, harness string")
    failed = experiments.audit_results(c, f, models).collect()
    assert len(failed) == len(got) - 1 and {r.path for r in failed if r.status == "unclaimed"} == {"spare", "a"}
    assert experiments.verify_claims(c.limit(0), f.limit(0)).count() == 0


def test_readers(spark, tmp_path):
    from watchgrid.sources import detections, registry, results, truth
    from watchgrid.sources.dims import merge_dim

    (tmp_path / "cache.jsonl").write_text(
        '{"sequence": "s", "file": "10_-5.jpg", "frame_index": 0, "offset": -5.0, "width": 9, "height": 9, "detections": []}\n'
        '{"sequence": "s", "file": "10_+5.jpg", "frame_index": 1, "offset": 5.0, "width": 9, "height": 9, '
        '"detections": [{"box": [1, 2, 3, 4], "confidence": 0.5}]}\n'
    )
    frames = detections.read_detection_cache(spark, str(tmp_path / "cache.jsonl"))
    rows = {(r.frame_index, r.det_seq, r.x1, r.confidence) for r in detections.explode_detections(frames).collect()}
    assert rows == {(0, None, None, None), (1, 0, 1.0, 0.5)}
    named = frames.select(detections.parse_frame_name(F.col("file"), "offset").alias("o")).collect()
    assert sorted(r.o for r in named) == [-5.0, 5.0]

    (tmp_path / "cams.json").write_text('{"cameras": [{"camera_id": "a", "source": "0", "context": "coast", "hazards": ["fire"]}]}')
    assert registry.read_registry(spark, str(tmp_path / "cams.json")).first().hazards == ["fire"]

    (tmp_path / "coco.json").write_text(
        '{"images": [{"id": 1, "file_name": "a.jpg"}, {"id": 2, "file_name": "b.jpg"}],'
        '"categories": [{"id": 5, "name": "civilian_visible"}, {"id": 6, "name": "truck"}],'
        '"annotations": [{"image_id": 1, "category_id": 5, "bbox": [1, 2, 10, 10]}, {"image_id": 2, "category_id": 5, "bbox": [1, 2, 1, 10]},'
        '{"image_id": 2, "category_id": 6, "bbox": [1, 2, 9, 10]}]}'
    )
    document = spark.read.schema(truth.COCO_SCHEMA).json(str(tmp_path / "coco.json"), multiLine=True)
    found = truth.coco_truth(document, merge_dim(spark)).collect()
    assert [(r.file_name, r["class"], tuple(r.box)) for r in found] == [("a.jpg", "civilian", (1.0, 2.0, 11.0, 12.0))]

    tree = spark.createDataFrame([("f", '{"a": {"conf_0.2": [1, {"x": null}, true]}, "b": "t"}')], "file string, json string")
    facts = {(r.path, r.value) for r in results.flatten_results(tree).collect()}
    assert {("a|conf_0.2|0", "1"), ("a|conf_0.2|2", "true"), ("b", "t")} <= facts
    assert tree.select(results.dig(F.col("json"), "a|conf_0.2|0").alias("v"), results.dig(F.col("json"), "a|q").alias("w")).first() == ("1", None)
