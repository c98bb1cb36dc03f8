"""Cached detections: one JSON row per frame, with the frame's detections as an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CACHE_SCHEMA = (
    "sequence string, file string, frame_index int, offset double, source_frame int, width int, height int, "
    "detections array<struct<box: array<double>, confidence: double, label: string>>"
)


def read_detection_cache(spark: SparkSession, path: str) -> DataFrame:
    """Scan a cache with a fixed schema. Rows carry their own order (sequence, offset); none is imposed here."""
    return spark.read.schema(CACHE_SCHEMA).json(path)


def stream_detections(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The same rows as an unbounded stream of files, taken in at a bounded rate and never dropped."""
    return (
        spark.readStream.schema(CACHE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("latestFirst", False)
        .json(path)
    )


def write_detection_cache(frames: DataFrame, path: str) -> None:
    """Write frames with coordinates at two and confidence at five decimals; empty frames keep an empty array."""
    rounded = F.transform(
        "detections",
        lambda d: F.struct(
            F.transform(d["box"], lambda v: F.round(v, 2)).alias("box"),
            F.round(d["confidence"], 5).alias("confidence"),
            d["label"].alias("label"),
        ),
    )
    frames.withColumn("detections", rounded).write.mode("errorifexists").json(path)


def explode_detections(frames: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per detection, and one with nulls per frame left without any: empty frames must still age tracks.
    ``labels`` keeps only those classes, inside the array, so that the frame row survives."""
    found = F.col("detections")
    if labels is not None:
        found = F.filter(found, lambda d: F.coalesce(d["label"], F.lit("")).isin(list(labels)))
    rest = [c for c in frames.columns if c != "detections"]
    exploded = frames.select(*rest, F.posexplode_outer(found).alias("det_seq", "_d"))
    box = F.col("_d.box")
    return exploded.select(
        *rest,
        F.col("det_seq").cast("long").alias("det_seq"),
        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.col("_d.confidence").alias("confidence"),
        F.col("_d.label").alias("label"),
    )


# Metadata kept in file names.


def offset_from_name(name: Column) -> Column:
    """``{epoch}_{offset}.jpg`` -> offset seconds; null for any other name."""
    return F.try_to_number(
        F.nullif(F.regexp_extract(name, r"^\d+_[+]?(-?\d+)\.jpg", 1), F.lit("")), F.lit("S999999999")
    ).cast("double")


def sequence_camera(sequence: Column) -> Column:
    """``{date}_FIRE_{camera}`` -> camera; other names stand for themselves."""
    camera = F.regexp_extract(sequence, r"^\d+_FIRE_(.+)", 1)
    return F.when(camera != "", camera).otherwise(sequence)


def capture_instant(key: Column) -> Column:
    """``...___2024-08-08T14-20-05Z...`` -> UTC epoch seconds."""
    pattern = r"___(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})Z"
    text = F.concat(
        F.regexp_extract(key, pattern, 1),
        F.lit(" "),
        F.concat_ws(":", *[F.regexp_extract(key, pattern, i) for i in (2, 3, 4)]),
    )
    return epoch_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def creek_instant(stem: Column) -> Column:
    """Two stamp formats: ``Y-M-D-h-m-s``, and a bare ``hh_mm`` on the recording's known day."""
    full = r"^(\d{4})-(\d{1,2})-(\d{1,2})-(\d{1,2})-(\d{1,2})-(\d{1,2})$"
    clock = r"^(\d{2})_(\d{2})$"

    def part(pattern: str, i: int) -> Column:
        return F.lpad(F.regexp_extract(stem, pattern, i), 2, "0")

    from_full = F.concat(
        F.regexp_extract(stem, full, 1), F.lit("-"), part(full, 2), F.lit("-"), part(full, 3), F.lit(" "),
        part(full, 4), F.lit(":"), part(full, 5), F.lit(":"), part(full, 6),
    )
    from_clock = F.concat(F.lit("2020-04-23 "), part(clock, 1), F.lit(":"), part(clock, 2), F.lit(":00"))
    text = F.when(stem.rlike(full), from_full).when(stem.rlike(clock), from_clock)
    return epoch_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def index_from_name(name: Column, pattern: str = r"(\d+)") -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("long")


def epoch_seconds(stamp: Column) -> Column:
    """Seconds since 1970 of a wall-clock timestamp, whatever the session time zone."""
    origin = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", origin, stamp) / F.lit(1e6)


def parse_frame_name(name: Column, kind: str) -> Column:
    """Dispatch by naming scheme: offset, sequence, capture, creek or index."""
    readers = {
        "offset": offset_from_name,
        "sequence": sequence_camera,
        "capture": capture_instant,
        "creek": creek_instant,
        "index": index_from_name,
    }
    return readers[kind](name)
