"""The stream forms of the batch operators. Each shares its step with the batch code."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from watchgrid.operators.cascade import Cascade, ValidatorConfig
from watchgrid.operators.flood import MAX_READINGS, RISE_TYPE, rise_rows
from watchgrid.operators.validator import ConfigSet
from watchgrid.sources.alerts import alert_writer
from watchgrid.streaming.ordered import one_by_one, step_in_order

STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)

#: Counting the rows of a store costs a read for each write of one.
STATE_ROWS = ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")

ANNOTATED = (
    "config_id string, frame_index long, ts double, det_seq long, confidence double, x1 double, y1 double, x2 double, "
    "y2 double, rejected_by string, track long, hits long, peak double, mean double, first_frame long, first_ts double"
)


def use_rocksdb(spark) -> None:
    """State of many cameras outgrows the heap; keep it in the embedded store on each executor. Progress reports then do not
    say how many rows it holds."""
    spark.conf.set(*STATE_STORE)
    spark.conf.set(*STATE_ROWS)


def cascade_step(configs: Sequence[ValidatorConfig], confirmed_only: bool = False):
    config_set = ConfigSet(configs)

    def step(memo: dict, frames: list[dict]) -> list[tuple]:
        running = [Cascade(c) for c in config_set.for_hazard(frames[0].get("hazard"))]
        for cascade in running:
            if cascade.config.config_id in memo:
                cascade.load(memo[cascade.config.config_id])
        number, out = memo.get("number", 0), []
        for frame in frames:
            number += 1
            given = frame["detections"] or []
            detections = [(d["confidence"], tuple(d["box"])) for d in given]
            index, ts = frame["frame_index"], frame["ts"]
            for cascade in running:
                results = cascade.frame(number, index, ts, detections)
                for place, ((confidence, box), result) in enumerate(zip(detections, results)):
                    if confirmed_only and result[0] is not None:
                        continue
                    sequence = given[place].get("det_seq")
                    named = place if sequence is None else sequence
                    out.append((cascade.config.config_id, index, ts, named, confidence, *box, *result))
        memo["number"] = number
        for cascade in running:
            # Tracks and confirmations that can no longer matter are left out of the state.
            cascade.tracks, cascade.recent = cascade.live(number + 1), cascade.cooling(frames[-1]["ts"])
            memo[cascade.config.config_id] = cascade.save()
        return out

    return step


def quiet_cascade(memo: dict) -> dict:
    """What an idle camera keeps: how many frames it had and how many tracks it opened, so that ids go on."""
    return {
        name: value if name == "number" else {"tracks": [], "recent": [], "opened": value["opened"]}
        for name, value in memo.items()
    }


def validate_stream(
    frames: DataFrame,
    configs: Sequence[ValidatorConfig],
    *,
    keys: Sequence[str] = ("camera_id", "hazard"),
    time: str = "event_time",
    delay: str = "1 minute",
    idle_seconds: float | None = None,
    name_late: bool = False,
    confirmed_only: bool = False,
) -> DataFrame:
    """The cascade over a stream of whole frames: keys, event_time, frame_index, ts, detections (array of box,
    confidence and optionally det_seq; empty arrays age tracks). Emits what ``validate`` emits, or with ``confirmed_only``
    those of its rows that nothing rejected, which spares the way out of the operator for all others, and with ``name_late``
    the frames that came too late (see ``step_in_order``). A camera that is quiet for
    ``idle_seconds`` loses its tracks; that may not be shorter than a cooldown, which would be forgotten with them."""
    longest = max((c.cooldown_seconds for c in configs if c.enable_cooldown), default=0.0)
    if idle_seconds is not None and idle_seconds < longest:
        raise ValueError(f"idle_seconds {idle_seconds} is shorter than a cooldown of {longest}")
    annotated = step_in_order(
        frames,
        keys,
        cascade_step(configs, confirmed_only),
        ANNOTATED,
        time=time,
        delay=delay,
        idle_seconds=idle_seconds,
        forget=quiet_cascade,
        name_late=name_late,
    )
    confirmed = F.when(F.col("rejected_by").isNull(), F.coalesce("track", F.lit(-1))).otherwise(F.lit(-1)).cast("long")
    return annotated.withColumn("track_id", confirmed)


def page_hinkley_stream(
    series: DataFrame,
    *,
    keys: Sequence[str] = ("camera_id",),
    value: str = "value",
    delta: float = 0.005,
    threshold: float = 0.10,
    min_samples: int = 5,
    **options,
) -> DataFrame:
    """Onset of change per key: samples, statistic, and the single alarm."""

    def step(memo: dict, row: dict) -> list[tuple]:
        x = row[value]
        n = memo.get("n", 0) + 1
        total = memo.get("total", 0.0) + x
        drift = memo.get("drift", 0.0) + x - total / n - delta
        low = min(memo.get("low", 0.0), drift)
        alarm = not memo.get("alarmed", False) and n >= min_samples and drift - low > threshold
        memo.update(n=n, total=total, drift=drift, low=low, alarmed=memo.get("alarmed", False) or alarm)
        return [(row["frame_index"], n, drift - low, alarm)]

    return step_in_order(
        series, keys, one_by_one(step), "frame_index long, samples long, statistic double, alarm boolean", **options
    )


def rise_stream(
    readings: DataFrame,
    *,
    keys: Sequence[str] = ("camera_id",),
    window_seconds: float = 300.0,
    rising: float = 0.005,
    max_readings: int = MAX_READINGS,
    **options,
) -> DataFrame:
    """Rate of rise per key over its newest readings (frame_index, ts, area_fraction, level_fraction, metres)."""
    names = ("ts", "area_fraction", "level_fraction")

    def step(memo: dict, rows: list[dict]) -> list[tuple]:
        held = memo.get("readings", [])
        readings = held + [[row.get(c) for c in names] for row in rows]
        columns = np.array(readings, dtype=float).T
        metres = np.array([None] * len(held) + [row.get("metres") for row in rows], dtype=float)
        found = rise_rows(*columns, metres, window_seconds, rising, max_readings)
        memo["readings"] = readings[-max_readings:]
        made = [found[name][len(held) :].tolist() for name in found]
        plain = [[None if v != v else v for v in values] for values in made]
        return [(row["frame_index"], row["ts"], *values) for row, values in zip(rows, zip(*plain))]

    return step_in_order(readings, keys, step, f"frame_index long, ts double, {RISE_TYPE}", **options)


def drop_repeats_stream(frames: DataFrame, *, keys: Sequence[str] = ("camera_id",), **options) -> DataFrame:
    """Pass a frame only if its signature differs from the camera's previous one. Not a plain deduplication: a scene
    may come back later."""

    def step(memo: dict, row: dict) -> list[tuple]:
        repeat = "last" in memo and memo["last"] == row["signature"]
        memo["last"] = row["signature"]
        return [] if repeat else [(row["frame_index"], row["ts"], row["signature"])]

    return step_in_order(frames, keys, one_by_one(step), "frame_index long, ts double, signature string", **options)


def visits_stream(frames: DataFrame, *, idle_seconds: float, keys: Sequence[str] = ("camera_id", "hazard"), **options) -> DataFrame:
    """Numbers a key's frames within a visit; a key that was quiet for ``idle_seconds`` is forgotten, and its next frame
    opens a new visit. A key is found quiet by a timer in event time, once the watermark has passed it."""

    def step(memo: dict, row: dict) -> list[tuple]:
        memo["frames"] = memo.get("frames", 0) + 1
        return [(row["frame_index"], row["ts"], memo["frames"])]

    output = "frame_index long, ts double, visit_frame long"
    return step_in_order(frames, keys, one_by_one(step), output, idle_seconds=idle_seconds, **options)


def live_counters(annotated: DataFrame, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """Running totals per camera over annotated detections, table or stream (update or complete mode)."""
    reason = F.col("rejected_by")
    return annotated.groupBy(*keys).agg(
        F.count("*").alias("proposed"),
        F.count(F.when(reason.isNull(), 1)).alias("confirmed"),
        *[F.count(F.when(reason == level, 1)).alias(f"rejected_{level}") for level in ("confidence", "persistence", "cooldown")],
    )


def start_alert_sink(
    events: DataFrame, path: str, checkpoint: str, on_alert: Callable[[DataFrame, int], None] | None = None, **trigger
):
    """Write confirmed events as alert files, each event once: after a failure, after a replay, and after a restart with a
    checkpoint that knows nothing of the alerts already stored."""
    writer = events.writeStream.foreachBatch(alert_writer(path, on_alert)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def observe_frames(annotated: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """A user's hook on every batch of annotated output."""
    writer = annotated.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
