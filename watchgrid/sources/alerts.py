"""Alert egress: one JSON row per confirmed event, written once however often a batch or a whole stream is repeated."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.session import cut_lineage


def evidence_name(camera: Column, hazard: Column, frame: Column) -> Column:
    return F.format_string("%s_%s_%06d.jpg", camera.cast("string"), hazard, frame)


def alert_rows(events: DataFrame, *more: str) -> DataFrame:
    """Events as published: confidence at 4, box at 1, seconds at 2 decimals; no video or clip field exists. ``more``
    names columns to carry along."""
    return events.select(
        "hazard",
        F.col("camera_id").cast("string").alias("camera_id"),
        F.bround("confidence", 4).alias("confidence"),
        F.array(*[F.bround(F.col(c), 1) for c in ("x1", "y1", "x2", "y2")]).alias("box"),
        "first_seen_frame",
        "confirmed_frame",
        F.bround("seconds_to_confirm", 2).alias("seconds_to_confirm"),
        "supporting_detections",
        "track_id",
        evidence_name(F.col("camera_id"), F.col("hazard"), F.col("confirmed_frame")).alias("evidence"),
        *more,
    )


def write_alerts(events: DataFrame, path: str, mode: str = "append") -> None:
    alert_rows(events).write.mode(mode).json(path)


def event_id(events: DataFrame) -> Column:
    """What makes an event the same event again: configuration, camera, hazard, frame, track and box; no batch, no clock."""
    names = ("config_id", "camera_id", "hazard", "confirmed_frame", "track_id", "x1", "y1", "x2", "y2")
    known = F.to_json(F.struct(*[n for n in names if n in events.columns]))
    return F.sha2(known, 256)


def event_day(events: DataFrame) -> Column:
    """The UTC day of confirmation (seconds since 1970); ``none`` without a time."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("confirmed_time") / 86_400).cast("int"))
    return F.coalesce(day.cast("string"), F.lit("none"))


def alert_writer(path: str, on_alert: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that knows events by id. Alerts lie in folders of their event's day. A batch is held against
    the ids of the days it touches, and only what is missing is appended, so a replayed batch, a batch that was cut short
    while its files appeared, and a stream restarted from nothing all leave every event once. One writer per path.
    ``on_alert`` observes all rows of a batch, repeated ones too."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = cut_lineage(batch.select("*", event_id(batch).alias("event_id"), event_day(batch).alias("day")))
        span = alerts.agg(F.min("day"), F.max("day")).first()
        if span[0] is not None:
            rows = alert_rows(alerts, "event_id", "day").dropDuplicates(["event_id"])
            # Makes the folder before a first batch reads it; appends nothing.
            rows.limit(0).write.mode("append").partitionBy("day").json(path)
            stored = spark.read.schema("event_id string, day string").option("basePath", path).json(path)
            stored = stored.filter(F.col("day").between(*span)).select("event_id")
            rows.join(stored, "event_id", "left_anti").write.mode("append").partitionBy("day").json(path)
        if on_alert is not None:
            on_alert(alert_rows(alerts), batch_id)

    return write


def counts_by_hazard(events: DataFrame, keys: Sequence[str] = ("hazard",)) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("alerts"))
