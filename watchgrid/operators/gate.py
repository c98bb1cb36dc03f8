"""The gate: which hazards each camera runs, and every way a pairing can be refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.session import small_or_shuffled
from watchgrid.sources import dims


def resolve_cameras(cameras: DataFrame) -> DataFrame:
    """Add active hazards and viewpoint: the camera's own setting, else its context's."""
    contexts = dims.context_dim(cameras.sparkSession)
    return cameras.join(F.broadcast(contexts), "context", "left").select(
        *cameras.columns,
        F.coalesce("hazards", "context_hazards", F.array().cast("array<string>")).alias("active_hazards"),
        F.coalesce("viewpoint", "default_viewpoint", F.lit("oblique")).alias("active_viewpoint"),
        F.col("hazards").isNotNull().alias("hazards_overridden"),
    )


def gate(cameras: DataFrame) -> DataFrame:
    """(camera_id, hazard, viewpoint) actually run; a disabled camera runs nothing."""
    return (
        resolve_cameras(cameras)
        .filter("enabled")
        .select(
            "camera_id",
            "context",
            F.explode(F.array_distinct("active_hazards")).alias("hazard"),
            F.col("active_viewpoint").alias("viewpoint"),
        )
    )


def gated(det: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """Detections of hazards their camera runs. The gate is broadcast only where a count shows it small."""
    pairs = gate_rows.select("camera_id", "hazard").distinct()
    return det.join(small_or_shuffled(pairs), ["camera_id", "hazard"], "left_semi")


def unknown_cameras(det: DataFrame, cameras: DataFrame, strict: bool = False) -> DataFrame:
    """Camera ids that detect but are not registered: an error, never an empty gate."""
    unknown = det.select("camera_id").distinct().join(cameras.select("camera_id"), "camera_id", "left_anti")
    if strict:
        message = F.concat(F.lit("camera is not registered: "), F.col("camera_id").cast("string"))
        return unknown.select(F.raise_error(message).cast("string").alias("camera_id"))
    return unknown


def require_known(det: DataFrame, cameras: DataFrame) -> DataFrame:
    """Pass detections through; any row of an unregistered camera fails the job."""
    known = cameras.select("camera_id", F.lit(True).alias("_known")).distinct()
    message = F.concat(F.lit("camera is not registered: "), F.col("camera_id").cast("string"))
    checked = F.when(F.col("_known").isNull(), F.raise_error(message)).otherwise(F.lit(True))
    return det.join(known, "camera_id", "left").filter(checked.cast("boolean")).drop("_known")


def envelope_violations(gate_rows: DataFrame, envelope: DataFrame) -> DataFrame:
    """(camera, hazard, viewpoint) outside what the hazard's detector was made for."""
    return gate_rows.join(F.broadcast(envelope.select("hazard", "viewpoint")), ["hazard", "viewpoint"], "left_anti").select(
        "camera_id", "hazard", "viewpoint"
    )


def required_models(gate_rows: DataFrame, envelope: DataFrame) -> DataFrame:
    """The models a deployment shares between cameras: one per (hazard, viewpoint) in use."""
    used = gate_rows.select("hazard", "viewpoint").distinct()
    return used.join(F.broadcast(envelope), ["hazard", "viewpoint"])


def required_hazards(gate_rows: DataFrame) -> DataFrame:
    return gate_rows.select("hazard").distinct()


def _needs_file(source: Column) -> Column:
    return ~source.contains("://") & ~source.rlike(r"^\d+$")


def missing_sources(cameras: DataFrame, files: DataFrame) -> DataFrame:
    """Cameras whose clip is not among ``files`` (file); streams and webcam numbers need none."""
    wanted = cameras.filter(_needs_file(F.col("source"))).withColumn(
        "file", F.regexp_extract("source", r"([^/]*)$", 1)
    )
    return wanted.join(files.select("file").distinct(), "file", "left_anti").select("camera_id", "source")


def disable_missing(cameras: DataFrame, missing: DataFrame) -> DataFrame:
    """Turn cameras without a source off for this run, so that they are reported instead of failing midway."""
    gone = missing.select("camera_id", F.lit(True).alias("_gone")).distinct()
    return cameras.join(gone, "camera_id", "left").select(
        *[
            (F.col("enabled") & F.col("_gone").isNull()).alias("enabled") if c == "enabled" else F.col(c)
            for c in cameras.columns
        ]
    )


def camera_listing(cameras: DataFrame) -> DataFrame:
    """Every camera with its resolved hazards, viewpoint and override flag."""
    return resolve_cameras(cameras).select(
        "camera_id",
        "context",
        F.array_sort(F.array_distinct("active_hazards")).alias("hazards"),
        "hazards_overridden",
        F.col("active_viewpoint").alias("viewpoint"),
        "enabled",
    )


def selector_listing(cameras: DataFrame) -> DataFrame:
    """Display order of a camera selector: live cameras first, then by id."""
    return cameras.orderBy(~F.col("is_live"), "camera_id")


def gate_summary(cameras: DataFrame) -> DataFrame:
    """What the gate saves, in detector invocations per frame, in one row."""
    active = resolve_cameras(cameras).filter("enabled").withColumn("_n", F.size(F.array_distinct("active_hazards")))
    total = len(dims.HAZARDS)
    counts = active.agg(
        F.count("*").alias("cameras"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("gated"),
        # A set of hazards has at most as many members as there are hazards.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("active_hazards")))).alias("models_loaded"),
    )
    return counts.select(
        "cameras",
        F.lit(total).alias("hazards_available"),
        (F.col("cameras") * total).alias("ungated_invocations"),
        F.col("gated").alias("gated_invocations"),
        F.when(F.col("cameras") > 0, F.bround(1 - F.col("gated") / (F.col("cameras") * total), 4))
        .otherwise(F.lit(0.0))
        .alias("reduction"),
        "models_loaded",
    )


def cameras_by_context(cameras: DataFrame) -> DataFrame:
    return cameras.filter("enabled").groupBy("context").agg(F.count("*").alias("cameras"))
