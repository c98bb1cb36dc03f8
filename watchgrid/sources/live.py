"""Live sources: what kind each is, and which stored still is its newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.sources.detections import capture_instant


def route_source(source: Column) -> Column:
    """How a source is read: webcam, polled still, stream or file; and whether it is live."""
    web = source.startswith("http://") | source.startswith("https://")
    still = source.startswith("usgs://") | source.startswith("hpwren://") | (
        web & F.lower(F.regexp_replace(source, r"\?[^?]*$", "")).rlike(r"\.(jpg|jpeg|png)$")
    )
    kind = (
        F.when(still, "polled_still")
        .when(source.rlike(r"^\d+$"), "webcam")
        .when(source.contains("://") & ~source.startswith("file://"), "stream")
        .otherwise("file")
    )
    return F.struct(kind.alias("kind"), (kind != "file").alias("is_live"))


def latest_key(keys: DataFrame, as_of: Column, days_back: int = 3) -> DataFrame:
    """The newest ``.jpg`` key per camera on ``as_of``'s UTC day or the ``days_back - 1`` days before it.
    Null-free input: (camera_id, key); cameras without a recent key are absent."""
    captured = capture_instant(F.col("key"))
    day = F.floor(F.col("captured_at") / 86400)
    today = F.floor(as_of / 86400)
    return (
        keys.filter(F.col("key").endswith(".jpg"))
        .withColumn("captured_at", captured)
        .filter((day > today - days_back) & (day <= today))
        .groupBy("camera_id")
        .agg(F.max_by("key", F.struct("captured_at", "key")).alias("key"), F.max("captured_at").alias("captured_at"))
    )
