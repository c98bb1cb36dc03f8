"""Stateful operators over streams of frames: the batch semantics, applied in frame order once the watermark has passed.

Every operator buffers a key's frames until no earlier one can arrive, then steps its state through them in (event time,
frame index) order. Keys are dealt into groups, each with one state value of text lines: a call to the state store, a timer
and an Arrow batch cost as much as hundreds of frames. Keys or frames of other types than text, whole numbers, doubles and
truth values keep a state for each key: one JSON value, which holds a few pending frames itself; more of them lie in a list
beside it, several to an entry. Late frames are dropped by the engine and counted, or, with ``name_late``, come out as rows
of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

#: Steps the frames that are due: (state, frames as dicts, in order) -> rows to emit. ``state`` is a JSON-ready dict that
#: the step may change; it is read and written once per key and batch.
Step = Callable[[dict, list[dict]], list[tuple]]

LATE = "late"
#: How late a row may be and still be named, where late rows are asked for.
GRACE = "36500 days"
_CLOCK = "_clock"
#: Groups that the keys of a stream are dealt into. A checkpoint is good for one number only.
GROUPS = 2048
_GROUP, _LINE = "_group", "_line"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: So many pending frames of a key lie in its state value, which saves every call for the list beside it.
INLINE = 128
#: Frames of one entry of that list.
ENTRY = 64


def one_by_one(step: Callable[[dict, dict], list[tuple]]) -> Step:
    """A step over single frames as a step over all that are due."""

    def run(memo: dict, frames: list[dict]) -> list[tuple]:
        return [row for frame in frames for row in step(memo, frame)]

    return run


class OrderedProcessor(StatefulProcessor):
    def __init__(
        self,
        step: Step,
        keys: Sequence[str],
        names: Sequence[str],
        time: str,
        idle_seconds: float | None,
        forget: Callable[[dict], dict | None] | None = None,
        name_late: bool = False,
    ):
        self._name_late = name_late
        self._step, self._columns, self._names = step, list(keys), list(names)
        self._time, self._idle, self._forget = time, idle_seconds, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "payload string")
        self._pending = handle.getListState("pending", "at_ms long, frame_index long, seq long, payload string")

    def _load(self) -> dict:
        stored = self._state.get()
        if stored is not None:
            return json.loads(stored[0])
        return {"memo": {}, "timer": None, "last_ms": None, "arrivals": 0, "held": [], "listed": False}

    def _listed(self) -> list[list]:
        """The frames of the list; an entry holds several, or one as it was written before there were several."""
        found = []
        for at_ms, frame_index, seq, payload in self._pending.get() if self._pending.exists() else ():
            frames = json.loads(payload)
            found += frames if isinstance(frames, list) else [[at_ms, frame_index, seq, frames]]
        return found

    @staticmethod
    def _entries(frames: list[list]) -> list[tuple]:
        parts = [frames[n : n + ENTRY] for n in range(0, len(frames), ENTRY)]
        return [(*part[0][:3], json.dumps(part)) for part in parts]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, fresh, watermark = self._load(), [], timerValues.getCurrentWatermarkInMs()
        for row in rows:
            frame = row.asDict(recursive=True)
            at = frame.pop(self._time)
            at_ms = int(at.timestamp() * 1000)
            if self._name_late:
                frame.pop(_CLOCK)
                if 0 < watermark and at_ms <= watermark:
                    known = [frame.get(name) for name in self._names[len(self._columns) : -3]]
                    yield Row(*self._names)(*key, *known, LATE, at, watermark - at_ms)
                    continue
            state["arrivals"] += 1
            fresh.append([at_ms, int(frame.get("frame_index") or 0), state["arrivals"], frame])
        yield from self._release(key, state, fresh, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self._load()
        state["timer"] = None
        yield from self._release(key, state, [], timerValues.getCurrentWatermarkInMs())

    def _release(self, key, state: dict, fresh: list[list], watermark: int) -> Iterator[Row]:
        # Every call to the state store costs as much as many frames: the list is left alone unless a frame of it is due.
        listed, first = state.get("listed", True), state.get("first")
        if listed and first is not None and min([first, *[entry[0] for entry in fresh]]) > watermark:
            ready, wake = [], min([first, *[entry[0] for entry in fresh]])
            if fresh:
                self._pending.appendList(self._entries(fresh))
            state["first"] = wake
        else:
            held = self._listed() if listed else state["held"]
            waiting = sorted(held + fresh)
            due = sum(entry[0] <= watermark for entry in waiting)
            ready, left = waiting[:due], waiting[due:]
            state["listed"] = len(left) > INLINE
            if state["listed"]:
                self._pending.put(self._entries(left))
            elif listed:
                self._pending.clear()
            state["held"] = [] if state["listed"] else left
            wake = state["first"] = left[0][0] if left else None
        emitted, record = [], Row(*self._names)
        if ready:
            state["last_ms"] = ready[-1][0]
            named = dict(zip(self._columns, key))
            frames = [{**frame, **named} for *_, frame in ready]
            rest = (None, None, None) if self._name_late else ()
            emitted = [record(*key, *values, *rest) for values in self._step(state["memo"], frames)]
        if wake is None and self._idle is not None and state["last_ms"] is not None:
            wake = state["last_ms"] + int(self._idle * 1000)
            if wake <= watermark:
                # The key has gone quiet: drop what would have aged out; counters stay, so that ids never repeat.
                kept = self._forget(state["memo"]) if self._forget else None
                if kept is None:
                    self._state.clear()
                    yield from emitted
                    return
                state["memo"], state["last_ms"], wake = kept, None, None
        if wake is not None and wake != state["timer"]:
            if state["timer"] is not None:
                self._handle.deleteTimer(state["timer"])
            self._handle.registerTimer(wake)
            state["timer"] = wake
        self._state.update((json.dumps(state),))
        yield from emitted

    def close(self) -> None:
        pass


def _numbers(value, kind: T.DataType):
    """NaN and the infinities, which ``to_json`` writes as text, as numbers again."""
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.ArrayType):
        return [_numbers(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _numbers(value[f.name], f.dataType) for f in kind.fields}
    return value


class GroupedProcessor(StatefulProcessor):
    """What ``OrderedProcessor`` does for one key, for all keys of a group. The state value holds a line for each key (key,
    time of its last frame, memo) and one for each pending frame (time, key, frame) in order of arrival; of these texts only
    those of due frames and their keys are parsed. Rows bring such a line as one column, as Spark unpacks each value of a row
    by itself."""

    def __init__(
        self,
        step: Step,
        keys: Sequence[str],
        names: Sequence[str],
        frame: T.StructType,
        idle_seconds: float | None,
        forget: Callable[[dict], dict | None] | None = None,
        name_late: bool = False,
    ):
        self._step, self._columns, self._names, self._frame = step, list(keys), list(names), frame
        self._idle, self._forget, self._name_late = idle_seconds, forget, name_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("state", "known string, held string, timer long")

    def _load(self) -> tuple[dict[str, tuple[int | None, str]], list[str], int | None]:
        stored = self._state.get()
        if stored is None:
            return {}, [], None
        known = {}
        for line in stored[0].split("\n") if stored[0] else ():
            key, last, memo = line.split("\t", 2)
            known[key] = (int(last) if last else None, memo)
        return known, stored[1].split("\n") if stored[1] else [], stored[2]

    def _read(self, frames: list[str]) -> list[dict]:
        text = f"[{','.join(frames)}]"
        found = json.loads(text)
        return _numbers(found, T.ArrayType(self._frame)) if 'NaN"' in text or 'Infinity"' in text else found

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, held, timer = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            line = row[_LINE]
            if self._name_late and 0 < watermark:
                at, name, frame = line.split("\t", 2)
                late = watermark - int(at) // 1000
                if late >= 0:
                    given = self._read([frame])[0]
                    values = [given.get(column) for column in self._names[len(self._columns) : -3]]
                    when = _EPOCH + timedelta(microseconds=int(at))
                    yield Row(*self._names)(*json.loads(name).values(), *values, LATE, when, late)
                    continue
            held.append(line)
        yield from self._release(known, held, timer, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, held, _ = self._load()
        yield from self._release(known, held, None, timerValues.getCurrentWatermarkInMs())

    def _release(self, known: dict, held: list, timer: int | None, watermark: int) -> Iterator[Row]:
        times, frames, left, waiting, wake = [], [], [], set(), None
        for line in held:
            at, key, frame = line.split("\t", 2)
            at_ms = int(at) // 1000
            if at_ms <= watermark:
                times.append((at_ms, key))
                frames.append(frame)
            else:
                left.append(line)
                waiting.add(key)
                wake = at_ms if wake is None or at_ms < wake else wake
        due = {}
        for place, ((at_ms, key), frame) in enumerate(zip(times, self._read(frames))):
            due.setdefault(key, []).append((at_ms, int(frame.get("frame_index") or 0), place, frame))
        emitted, record = [], Row(*self._names)
        rest = (None, None, None) if self._name_late else ()
        for key, ready in due.items():
            ready.sort()
            named = json.loads(key)
            memo = json.loads(known[key][1]) if key in known else {}
            rows = self._step(memo, [{**frame, **named} for *_, frame in ready])
            emitted += [record(*named.values(), *values, *rest) for values in rows]
            known[key] = (ready[-1][0], json.dumps(memo))
        if self._idle is not None:
            for key, (last, memo) in list(known.items()):
                if last is None or key in waiting:
                    continue
                quiet = last + int(self._idle * 1000)
                if quiet > watermark:
                    wake = quiet if wake is None else min(wake, quiet)
                    continue
                # The key has gone quiet: drop what would have aged out; counters stay, so that ids never repeat.
                kept = self._forget(json.loads(memo)) if self._forget else None
                if kept is None:
                    del known[key]
                else:
                    known[key] = (None, json.dumps(kept))
        if wake != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if wake is not None:
                self._handle.registerTimer(wake)
        if known or left:
            lines = [f"{key}\t{'' if last is None else last}\t{memo}" for key, (last, memo) in known.items()]
            self._state.update(("\n".join(lines), "\n".join(left), wake))
        else:
            self._state.clear()
        yield from emitted

    def close(self) -> None:
        pass


#: Types that come back from JSON text as they were; as keys, equal values have equal text.
_AS_KEY = (T.StringType(), T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType(), T.BooleanType())


def _as_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _as_text(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_as_text(f.dataType) for f in kind.fields)
    return kind in _AS_KEY or kind == T.DoubleType()


def _text(names: Sequence[str]) -> Column:
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def step_in_order(
    stream: DataFrame,
    keys: Sequence[str],
    step: Step,
    output: str,
    *,
    time: str = "event_time",
    delay: str = "1 minute",
    idle_seconds: float | None = None,
    forget: Callable[[dict], dict | None] | None = None,
    name_late: bool = False,
    groups: int | None = GROUPS,
) -> DataFrame:
    """Run ``step`` over each key's rows in event-time order. ``output`` names the columns after the keys. A key that is
    quiet for ``idle_seconds`` keeps of its state only what ``forget`` returns. Keys share the state of one of ``groups``;
    None gives each its own, as checkpoints from before there were groups have it.

    With ``name_late`` every row behind the watermark with which its batch began comes out too: ``status`` is 'late',
    ``late_event_time`` and ``late_ms`` (how far behind it was) are set, and of ``output`` the columns that the row itself
    has. For that the watermark runs on the event time moved ahead by ``GRACE``, with a delay longer by as much: it stands
    where it would, but the engine finds no row old enough to drop, and the operator sees all of them."""
    keys = list(keys)
    extra = "status string, late_event_time timestamp, late_ms long"
    schema = T.StructType([stream.schema[k] for k in keys] + T.StructType.fromDDL(output + (f", {extra}" if name_late else "")).fields)
    if name_late:
        clock = F.col(time) + F.expr(f"INTERVAL {GRACE}")
        marked = stream.withColumn(_CLOCK, clock).withWatermark(_CLOCK, f"{delay} {GRACE}")
    else:
        marked = stream.withWatermark(time, delay)
    frame = T.StructType([f for f in stream.schema if f.name not in (*keys, time)])
    if groups and _as_text(frame) and all(stream.schema[k].dataType in _AS_KEY for k in keys):
        at = F.unix_micros(F.col(time).cast("timestamp")).cast("string")
        line = F.concat_ws("\t", at, _text(keys), _text(frame.names) if frame.names else F.lit("{}"))
        packed = marked.select(
            _CLOCK if name_late else time,
            F.pmod(F.xxhash64(*keys), F.lit(groups)).alias(_GROUP),
            F.when(at.isNotNull(), line).alias(_LINE),
        )
        return packed.groupBy(_GROUP).transformWithState(
            statefulProcessor=GroupedProcessor(step, keys, schema.names, frame, idle_seconds, forget, name_late),
            outputStructType=schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    return marked.groupBy(*keys).transformWithState(
        statefulProcessor=OrderedProcessor(step, keys, schema.names, time, idle_seconds, forget, name_late),
        outputStructType=schema,
        outputMode="Append",
        timeMode="EventTime",
    )


class LateRows(StreamingQueryListener):
    """Counts the frames that came after the watermark, of every query and batch, for as long as it is registered."""

    def __init__(self) -> None:
        self.dropped: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.note(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def note(self, progress) -> None:
        report = progress if isinstance(progress, dict) else json.loads(progress.json)
        late = sum(operator.get("numRowsDroppedByWatermark", 0) for operator in report.get("stateOperators", []))
        self.dropped[str(report["id"]), int(report["batchId"])] = late


def late_rows(query: StreamingQuery, listener: LateRows | None = None) -> int:
    """Frames that came after the watermark: dropped, and never hidden. A query keeps reports of its last batches only
    (``spark.sql.streaming.numRecentProgressUpdates``); over longer runs pass a listener that was registered before the
    query started."""
    counted = listener or LateRows()
    for progress in query.recentProgress:
        counted.note(progress)
    return sum(n for (name, _), n in counted.dropped.items() if name == str(query.id))
