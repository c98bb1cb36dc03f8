"""The temporal cascade over tables: detections in, annotated detections and confirmed events out.

One shuffle by (camera, hazard, chunk) brings the detections that can matter into order; one ordered Arrow pass runs
every configuration side by side. A chunk holds a bounded number of frames, so a camera that owns a large share of
all rows is spread over many tasks. What one chunk hands to the next is settled first, for keys of several chunks only.

Tracks do not depend on the cooldown. Every chunk follows them from a guessed start, and chunks whose guess turns out
wrong follow them once more, which settles nearly all, since tracks are soon forgotten or the same from any start; keys
whose tracks are still open then are walked through once in order, skipping every chunk that begins as it was assumed to.
The cooldown keeps its phase for ever, so it is not guessed: chunks reduce to their confirmation candidates, and
``cooldown.let_through`` decides on those by jump pointers. Identities and totals are chained over the chunks at last. The
result equals one sequential pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from watchgrid.operators import scans
from watchgrid.operators.cascade import CONFIDENCE, Cascade, ValidatorConfig, dump
from watchgrid.operators.cooldown import let_through, slice_of
from watchgrid.session import cut_lineage

KEYS = ("camera_id", "hazard")
CHUNK_FRAMES = 65_536
_BOX = ("x1", "y1", "x2", "y2")
_RESULT = "rejected_by string, track long, hits long, peak double, mean double, first_frame long, first_ts double"


class ConfigSet:
    """Configurations by id; per hazard the exact entry, else the entry for any hazard, else the defaults."""

    def __init__(self, configs: Sequence[ValidatorConfig]):
        if not configs:
            raise ValueError("at least one configuration is needed")
        self._by_id: dict[str, dict] = {}
        for config in configs:
            entries = self._by_id.setdefault(config.config_id, {})
            if config.hazard in entries:
                raise ValueError(f"two configurations {config.config_id!r} for hazard {config.hazard!r}")
            entries[config.hazard] = config

    @property
    def ids(self) -> list[str]:
        return list(self._by_id)

    @property
    def hazards(self) -> set[str]:
        return {h for entries in self._by_id.values() for h in entries if h is not None}

    def resolve(self, config_id: str, hazard: str | None) -> ValidatorConfig:
        entries = self._by_id[config_id]
        return entries.get(hazard) or entries.get(None) or ValidatorConfig(config_id)

    def for_hazard(self, hazard: str | None) -> list[ValidatorConfig]:
        return [self.resolve(i, hazard) for i in self.ids]

    def without_cooldown(self) -> "ConfigSet":
        return ConfigSet([c.with_(enable_cooldown=False) for entries in self._by_id.values() for c in entries.values()])

    @property
    def cools(self) -> bool:
        return any(c.enable_cooldown and c.cooldown_seconds >= 0 for name in (None, *self.hazards) for c in self.for_hazard(name))

    def must_pass(self, hazard: Column, confidence: Column) -> Column:
        """True for rows that some configuration has to see in order; the rest fail on confidence everywhere."""

        def test(name: str | None) -> Column:
            floors = [c.floor_needed() for c in self.for_hazard(name)]
            if None in floors:
                return F.lit(True)
            return confidence >= F.lit(min(floors))

        decision = None
        for name in sorted(self.hazards):
            decision = (decision.when if decision is not None else F.when)(hazard == name, test(name))
        return test(None) if decision is None else decision.otherwise(test(None))

    def weakest_floor(self) -> float | None:
        """A bound under which no row matters to any hazard; simple enough for the scan to skip row groups by."""
        floors = [c.floor_needed() for name in (None, *self.hazards) for c in self.for_hazard(name)]
        return None if None in floors else min(floors)


def confidence_level(det: DataFrame, config: ValidatorConfig) -> DataFrame:
    """Annotate the stateless level: ``rejected_by`` and whether the row is in the band that may refresh tracks."""
    below = F.col("confidence") < config.min_confidence if config.enable_confidence else F.lit(False)
    return det.withColumn("rejected_by", F.when(below, F.lit(CONFIDENCE))).withColumn(
        "may_refresh", below & (F.col("confidence") >= config.association_floor)
    )


def number_frames(frames: DataFrame, keys: Sequence[str], chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Dense 1-based ``frame_no`` per key over all processed frames, empty ones included."""
    chunk = scans.chunk_of(F.col("frame_index"), chunk_frames)
    return scans.ordinal(frames, keys, chunk, [F.col("frame_index")], "frame_no")


def validate(
    det: DataFrame,
    configs: Sequence[ValidatorConfig],
    frames: DataFrame | None = None,
    *,
    keys: Sequence[str] = KEYS,
    carry: Sequence[str] = (),
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Annotate every detection under every configuration.

    ``det``: keys, frame_index, ts, det_seq, confidence, x1..y2 and any ``carry`` columns. ``frames``: all processed
    frames (keys or a part of them, frame_index), so that empty frames age tracks; without it ``frame_index`` itself,
    or ``frame_no`` where present, must count the processed frames densely. ``ts`` must not fall within a key.
    Adds config_id, rejected_by, track, hits, peak, mean, first_frame, first_ts and track_id (-1 unless confirmed).
    """
    keys, carry = list(keys), list(carry)
    config_set = ConfigSet(configs)
    if frames is not None:
        frame_keys = [k for k in keys if k in frames.columns]
        numbered = number_frames(frames.select(*frame_keys, "frame_index"), frame_keys, chunk_frames)
        det = det.drop("frame_no").join(numbered, [*frame_keys, "frame_index"])
    number = F.col("frame_no") if "frame_no" in det.columns else F.col("frame_index")

    base = det.select(
        *keys,
        number.cast("long").alias("frame_no"),
        F.col("frame_index").cast("long"),
        F.col("ts").cast("double"),
        F.col("det_seq").cast("long"),
        F.col("confidence").cast("double"),
        *[F.col(c).cast("double") for c in _BOX],
        *carry,
    )
    hazard = F.col("hazard") if "hazard" in keys else F.lit(None).cast("string")
    needed = config_set.must_pass(hazard, F.col("confidence"))
    weakest = config_set.weakest_floor()
    eligible = base if weakest is None else base.filter(F.col("confidence") >= weakest)
    ordered = _ordered(eligible.filter(needed), config_set, keys, carry, chunk_frames)
    settled = base.filter(~needed).select(
        *keys,
        F.explode(F.array(*[F.lit(i) for i in config_set.ids])).alias("config_id"),
        *[c for c in base.columns if c not in keys],
        F.lit(CONFIDENCE).alias("rejected_by"),
        F.lit(None).cast("long").alias("track"),
        F.lit(None).cast("long").alias("hits"),
        F.lit(None).cast("double").alias("peak"),
        F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("long").alias("first_frame"),
        F.lit(None).cast("double").alias("first_ts"),
    )
    return ordered.unionByName(settled).withColumn(
        "track_id", F.when(F.col("rejected_by").isNull(), F.col("track")).otherwise(F.lit(-1).cast("long"))
    )


def confirmed_events(annotated: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per confirmed event; its confidence is the peak over the track's sightings so far."""
    return annotated.filter(F.col("rejected_by").isNull()).select(
        "config_id",
        *keys,
        F.col("peak").alias("confidence"),
        *_BOX,
        F.col("first_frame").alias("first_seen_frame"),
        F.col("frame_index").alias("confirmed_frame"),
        F.col("first_ts").alias("first_seen_time"),
        F.col("ts").alias("confirmed_time"),
        F.col("hits").alias("supporting_detections"),
        "track_id",
        (F.col("frame_index") - F.col("first_frame") + 1).alias("frames_to_confirm"),
        (F.col("ts") - F.col("first_ts")).alias("seconds_to_confirm"),
        "det_seq",
    )


# The ordered pass.


def _ordered(
    rows: DataFrame, config_set: ConfigSet, keys: list[str], carry: list[str], chunk_frames: int
) -> DataFrame:
    rows = rows.withColumn(scans.CHUNK, scans.chunk_of(F.col("frame_no"), chunk_frames))
    schema = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField("config_id", T.StringType())]
        + [f for f in rows.schema.fields if f.name not in (*keys, scans.CHUNK)]
        + T.StructType.fromDDL(_RESULT).fields
    )
    states = None
    if (rows.agg(F.max(scans.CHUNK)).first()[0] or 0) > 0:
        rows = cut_lineage(rows)
        states = _starting_states(rows, config_set, keys)
    return _run(rows, states, keys, _emit(config_set, keys, carry, schema), schema)


def _run(
    rows: DataFrame, states: DataFrame | None, keys: list[str], function, schema: T.StructType, together: list[str] | None = None
) -> DataFrame:
    """Bring each chunk's rows into order, its hand-over row first, and stream them through ``function``. Rows that
    agree in ``together`` (a chunk's own, by default) go to one task."""
    feed = rows.withColumn("_state", F.lit(None).cast("string"))
    if states is not None:
        known = {*keys, scans.CHUNK, "_state"}
        head = states.select(*known).withColumn("frame_no", F.lit(-1).cast("long"))
        absent = [f for f in feed.schema.fields if f.name not in (*known, "frame_no")]
        feed = feed.unionByName(head.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in absent]))
    # By a hash of the keys, so that both parts are dealt out anew and together, however each lies already.
    feed = feed.repartition(F.xxhash64(*(together or [*keys, scans.CHUNK])))
    feed = feed.sortWithinPartitions(*keys, scans.CHUNK, "frame_no", "det_seq")
    return feed.mapInArrow(function, schema)


class _Reader:
    """Cuts a sorted stream of Arrow batches into (group start) and (frame) steps, across batch borders."""

    def __init__(self, keys: list[str]):
        self.keys = [*keys, scans.CHUNK]

    def frames(self, batches: Iterator[pa.RecordBatch]):
        group, number, pending = None, None, []
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            rest = [c for n, c in columns.items() if n not in (*self.keys, "_state")]
            places = zip(*[columns[k] for k in self.keys])
            for here, at, given, record in zip(places, columns["frame_no"], columns["_state"], zip(*rest)):
                if at != number or here != group:
                    if pending:
                        yield group, pending, None
                        pending = []
                    group, number = here, at
                if at < 0:
                    yield group, [], given
                else:
                    pending.append(record)
            yield None, [], None
        if pending:
            yield group, pending, None
        yield None, [], None


#: Positions inside a record of the ordered feed.
_NUMBER, _INDEX, _TS, _SEQ, _CONF, _X1 = 0, 1, 2, 3, 4, 5


def _hazard_of(group: tuple, keys: list[str]) -> str | None:
    return group[keys.index("hazard")] if "hazard" in keys else None


def _detections(frame: list[tuple]) -> list[tuple]:
    return [(r[_CONF], r[_X1 : _X1 + 4]) for r in frame]


def _emit(config_set: ConfigSet, keys: list[str], carry: list[str], schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cascades, out = None, [], []
        for here, frame, state in _Reader(keys).frames(batches):
            if here is None:
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                    )
                    out = []
                continue
            if here != group:
                group = here
                cascades = [Cascade(c) for c in config_set.for_hazard(_hazard_of(here, keys))]
            if state is not None:
                saved = json.loads(state)
                for cascade, config_id in zip(cascades, config_set.ids):
                    cascade.load(saved[config_id])
            if not frame:
                continue
            number, index, ts = frame[0][_NUMBER], frame[0][_INDEX], frame[0][_TS]
            detections = _detections(frame)
            for cascade, config_id in zip(cascades, config_set.ids):
                head = (*here[:-1], config_id)
                for record, result in zip(frame, cascade.frame(number, index, ts, detections)):
                    out.append((*head, *record, *result))

    return run


# Handing state from chunk to chunk.

_HANDOVER = "assumed string, shape string, ledger string"


def _starting_states(rows: DataFrame, config_set: ConfigSet, keys: list[str]) -> DataFrame:
    """The exact state in which every chunk begins, as (keys, chunk, _state), for keys of several chunks."""
    by_chunk, chunk_keys = Window.partitionBy(*keys).orderBy(scans.CHUNK), [*keys, scans.CHUNK]
    chunks = rows.groupBy(*chunk_keys).agg(F.min("frame_no").alias("first_no"), F.min("ts").alias("first_ts"))
    chunks = chunks.select("*", F.lead("first_no").over(by_chunk).alias("next_no"), F.lag("first_no").over(by_chunk).alias("_before"))
    chunks = cut_lineage(chunks.filter("next_no IS NOT NULL OR _before IS NOT NULL").drop("_before"))
    rows = rows.join(chunks.filter("next_no IS NULL").select(*keys), keys, "left_semi")
    tried = _settled_tracks(rows, chunks, config_set.without_cooldown(), keys)
    if config_set.cools:
        tried = tried.join(_recent_boxes(rows, chunks, tried, config_set, keys), chunk_keys, "left")
    else:
        tried = tried.withColumn("recent", F.lit(None).cast("string"))
    return _chain(tried, config_set, keys)


def _settled_tracks(rows: DataFrame, chunks: DataFrame, config_set: ConfigSet, keys: list[str]) -> DataFrame:
    """Per chunk the tracks it begins with (``assumed``) and leaves (``shape``), and its ``ledger``."""
    by_chunk, chunk_keys = Window.partitionBy(*keys).orderBy(scans.CHUNK), [*keys, scans.CHUNK]
    schema = T.StructType([chunks.schema[k] for k in chunk_keys] + T.StructType.fromDDL(_HANDOVER).fields)
    survey = _survey(config_set, keys, schema)

    def try_from(part: DataFrame, guesses: DataFrame) -> DataFrame:
        packed = F.to_json(F.struct("next_no", "assumed"))
        return _run(part, guesses.withColumn("_state", packed), keys, survey, schema)

    def unsettled(tried: DataFrame) -> DataFrame:
        due = tried.select("*", F.lag("shape").over(by_chunk).alias("due"))
        return due.filter(~F.col("assumed").eqNullSafe(F.col("due")))

    tried = cut_lineage(try_from(rows, chunks.withColumn("assumed", F.lit(None).cast("string"))))
    wrong = cut_lineage(unsettled(tried).select(*chunk_keys, F.col("due").alias("assumed")).join(chunks, chunk_keys))
    if wrong.isEmpty():
        return tried
    again = try_from(rows.join(wrong.select(*chunk_keys), chunk_keys, "left_semi"), wrong)
    tried = cut_lineage(tried.join(wrong, chunk_keys, "left_anti").unionByName(again))

    first = unsettled(tried).groupBy(*keys).agg(F.min_by(F.struct(scans.CHUNK, "due"), scans.CHUNK).alias("_from"))
    first = cut_lineage(first)
    if first.isEmpty():
        return tried
    behind = F.col(scans.CHUNK) >= F.col(f"_from.{scans.CHUNK}")
    open_rows = rows.join(first, keys).filter(behind).drop("_from")
    known = tried.join(first, keys).filter(behind).join(chunks, chunk_keys)
    packed = F.to_json(F.struct("next_no", "assumed", "shape", "ledger", F.col("_from.due").alias("due")))
    walked = _run(open_rows, known.withColumn("_state", packed), keys, _walk(config_set, keys, schema), schema, keys)
    walked = cut_lineage(walked)
    return tried.join(walked, chunk_keys, "left_anti").unionByName(walked)


#: A confirmation candidate's place in its key: the frame's number, then its turn within the frame.
_TURN_BITS = 20
_CANDIDATE = "config_id string, place long, ts double, cool double, iou double, x1 double, y1 double, x2 double, y2 double"


def _recent_boxes(rows: DataFrame, chunks: DataFrame, tried: DataFrame, config_set: ConfigSet, keys: list[str]) -> DataFrame:
    """Per chunk the boxes confirmed shortly before it, as JSON by configuration (``recent``)."""
    schema = T.StructType([rows.schema[k] for k in keys] + T.StructType.fromDDL(_CANDIDATE).fields)
    starts = tried.withColumn("_state", F.to_json(F.struct("assumed")))
    candidates = _run(rows, starts, keys, _candidates(config_set, keys, schema), schema)
    passed = let_through(candidates, [*keys, "config_id"])
    # A box is recent to a chunk that begins in its slice or in the next one.
    passed = passed.withColumn("at", F.explode(F.array(F.col("slice"), F.col("slice") + 1))).drop("slice")
    kinds = passed.select(*keys, "config_id", "cool").distinct()
    begins = chunks.join(kinds, keys).withColumn("at", slice_of(F.col("first_ts"), F.col("cool"))).drop("cool", "next_no")
    still = (F.shiftright("place", _TURN_BITS) < F.col("first_no")) & (F.col("first_ts") - F.col("ts") <= F.col("cool"))
    met = begins.join(passed, [*keys, "config_id", "at"]).filter(still)
    boxes = met.groupBy(*keys, scans.CHUNK, "config_id").agg(F.collect_list(F.array(*_BOX, "ts")).alias("boxes"))
    by_config = F.map_from_entries(F.collect_list(F.struct("config_id", "boxes")))
    return boxes.groupBy(*keys, scans.CHUNK).agg(F.to_json(by_config).alias("recent"))


def _candidates(config_set: ConfigSet, keys: list[str], schema: T.StructType):
    """Run chunks from their settled tracks and keep what the cooldown has to decide on."""
    arrow = to_arrow_schema(schema)
    followed = config_set.without_cooldown()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cascades, out = None, [], []
        for here, frame, state in _Reader(keys).frames(batches):
            if here is None:
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                    )
                    out = []
                continue
            if here != group:
                group, hazard = here, _hazard_of(here, keys)
                cascades = _opened(followed, hazard, json.loads(state or "{}").get("assumed"))
                cools = [(c.cooldown_seconds, c.cooldown_iou) if c.enable_cooldown else (-1.0, 0.0) for c in config_set.for_hazard(hazard)]
            if not frame:
                continue
            number, ts, detections = frame[0][_NUMBER], frame[0][_TS], _detections(frame)
            turns = sorted(range(len(frame)), key=lambda i: -detections[i][0]) if len(frame) > 1 else [0]
            for cascade, config_id, (cool, least) in zip(cascades, config_set.ids, cools):
                results = cascade.frame(number, frame[0][_INDEX], ts, detections)
                if cool < 0:
                    continue
                for turn, i in enumerate(turns):
                    if results[i][0] is None:
                        place = (number << _TURN_BITS) + turn
                        out.append((*here[:-1], config_id, place, ts, cool, least, *detections[i][1]))

    return run


def _closing(config_set: ConfigSet, group: tuple, cascades: list[Cascade], start: dict) -> tuple:
    """A chunk's hand-over row: what it assumed, what it leaves, and its own identities and totals."""
    shapes, ledgers = {}, {}
    for cascade, config_id in zip(cascades, config_set.ids):
        shapes[config_id] = cascade.shape(start["next_no"])
        ledgers[config_id] = cascade.ledger(start["next_no"])
    empty = not any(s["tracks"] for s in shapes.values())
    return (*group, start.get("assumed"), None if empty else dump(shapes), dump(ledgers))


def _opened(config_set: ConfigSet, hazard: str | None, assumed: str | None) -> list[Cascade]:
    cascades = [Cascade(c) for c in config_set.for_hazard(hazard)]
    if assumed:
        shapes = json.loads(assumed)
        for cascade, config_id in zip(cascades, config_set.ids):
            cascade.load_shape(shapes[config_id])
    return cascades


def _walk(config_set: ConfigSet, keys: list[str], schema: T.StructType):
    """Go through the chunks of a key in order, each from what the one before leaves; run those that assumed otherwise."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cascades, start, kept, left = None, None, None, None, None
        out: list[tuple] = []

        def finish() -> str | None:
            out.append(kept if cascades is None else _closing(config_set, group, cascades, start))
            return out[-1][-2]

        for here, frame, state in _Reader(keys).frames(batches):
            if here is None:
                continue
            if here != group:
                if group is not None:
                    left = finish()
                same_key = group is not None and group[:-1] == here[:-1]
                saved = {"next_no": None, "assumed": None, "shape": None, "ledger": None, "due": None}
                saved |= json.loads(state)
                begins = left if same_key else saved["due"]
                group, start = here, {"next_no": saved["next_no"], "assumed": begins}
                kept = (*here, saved["assumed"], saved["shape"], saved["ledger"])
                cascades = None if saved["assumed"] == begins else _opened(config_set, _hazard_of(here, keys), begins)
            if frame and cascades is not None:
                detections = _detections(frame)
                for cascade in cascades:
                    cascade.frame(frame[0][_NUMBER], frame[0][_INDEX], frame[0][_TS], detections)
        if group is not None:
            finish()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
            )

    return run


def _survey(config_set: ConfigSet, keys: list[str], schema: T.StructType):
    """Run chunks for their final state only."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, cascades, start, out = None, [], None, []
        for here, frame, state in _Reader(keys).frames(batches):
            if here is None:
                continue
            if here != group:
                if group is not None:
                    out.append(_closing(config_set, group, cascades, start))
                group, start = here, {"next_no": None, **json.loads(state)}
                cascades = _opened(config_set, _hazard_of(here, keys), start.get("assumed"))
            if frame:
                detections = _detections(frame)
                for cascade in cascades:
                    cascade.frame(frame[0][_NUMBER], frame[0][_INDEX], frame[0][_TS], detections)
        if group is not None:
            out.append(_closing(config_set, group, cascades, start))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
            )

    return run


def _chain(tried: DataFrame, config_set: ConfigSet, keys: list[str]) -> DataFrame:
    """Chain identities and totals over the chunks of each key: one small row per chunk, streamed in order. Adds to each
    chunk's tracks the boxes that are cooling when it begins."""
    schema = T.StructType(
        [tried.schema[k] for k in (*keys, scans.CHUNK)] + [T.StructField("_state", T.StringType())]
    )
    arrow = to_arrow_schema(schema)
    ids = config_set.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried, opened = None, {}, {}
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out = []
            for position in range(batch.num_rows):
                here = tuple(columns[k][position] for k in keys)
                if here != group:
                    group, carried, opened = here, {i: [] for i in ids}, {i: 0 for i in ids}
                shapes = json.loads(columns["assumed"][position] or "null") or {}
                ledgers = json.loads(columns["ledger"][position])
                recent = json.loads(columns["recent"][position] or "{}")
                state = {}
                for i in ids:
                    shape = shapes.get(i, {"tracks": []})
                    known = carried[i]
                    state[i] = {
                        "tracks": [[*t[:5], *known[k]] for k, t in enumerate(shape["tracks"])],
                        "recent": recent.get(i, []),
                        "opened": opened[i],
                    }
                    carried[i] = [_extend(entry, known, opened[i]) for entry in ledgers[i]["tracks"]]
                    opened[i] += ledgers[i]["opened"]
                out.append((*here, columns[scans.CHUNK][position], dump(state)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                )

    def _extend(entry, known, offset):
        label, hits, peak, total, first_frame, first_ts = entry
        if label > 0:
            return [hits, peak, total, first_frame, first_ts, offset + label]
        past = known[-label - 1]
        return [past[0] + hits, past[1] if peak is None else max(past[1], peak), past[2] + total, *past[3:]]

    ordered = tried.repartition(*keys).sortWithinPartitions(*keys, scans.CHUNK)
    return cut_lineage(ordered.mapInArrow(run, schema))
