"""The camera registry: a declarative table, loaded with loud validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from watchgrid.sources import dims

REGISTRY_SCHEMA = (
    "camera_id string, source string, context string, name string, hazards array<string>, viewpoint string, "
    "enabled boolean, retention struct<rolling_buffer_seconds: double, evidence_frame: boolean, "
    "store_raw_video: boolean>, notes string"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries from a document ``{"cameras": [...]}``: JSON, or YAML where a YAML reader is installed."""
    entry = T.StructType.fromDDL(REGISTRY_SCHEMA)
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = spark.read.text(path, wholetext=True).first()[0]
        entries = (yaml.safe_load(text) or {}).get("cameras") or []
        return spark.createDataFrame([{n: e.get(n) for n in entry.names} for e in entries], entry)
    schema = T.StructType([T.StructField("cameras", T.ArrayType(entry))])
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("cameras"))


def with_defaults(rows: DataFrame) -> DataFrame:
    return rows.select(
        "camera_id",
        "source",
        "context",
        F.coalesce("name", F.lit("")).alias("name"),
        "hazards",
        "viewpoint",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.struct(
            F.coalesce("retention.rolling_buffer_seconds", F.lit(10.0)).alias("rolling_buffer_seconds"),
            F.coalesce("retention.evidence_frame", F.lit(True)).alias("evidence_frame"),
            F.coalesce("retention.store_raw_video", F.lit(False)).alias("store_raw_video"),
        ).alias("retention"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def registry_violations(rows: DataFrame) -> DataFrame:
    """Every rule an entry breaks, as (camera_id, violation)."""
    hazards = F.array(*[F.lit(h) for h in dims.HAZARDS])
    row_rules = F.array_compact(
        F.array(
            F.when(F.col("camera_id").isNull(), "missing_camera_id"),
            F.when(F.col("source").isNull(), "missing_source"),
            F.when(~F.coalesce(F.col("context").isin(list(dims.CONTEXTS)), F.lit(False)), "unknown_context"),
            F.when(~F.col("viewpoint").isin(dims.VIEWPOINTS), "unknown_viewpoint"),
            F.when(F.size(F.array_except("hazards", hazards)) > 0, "unknown_hazard"),
            F.when(F.col("retention.store_raw_video"), "raw_video_retention"),
            F.when(F.col("retention.rolling_buffer_seconds") < 0, "negative_buffer"),
        )
    )
    by_row = rows.select("camera_id", F.explode(row_rules).alias("violation"))
    repeated = (
        rows.filter(F.col("camera_id").isNotNull())
        .groupBy("camera_id")
        .count()
        .filter("count > 1")
        .select("camera_id", F.lit("duplicate_camera_id").alias("violation"))
    )
    return by_row.unionByName(repeated)


def load_cameras(rows: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cameras with defaults, violations). ``strict`` makes any violation fail the job that reads the cameras."""
    cameras = with_defaults(rows)
    violations = registry_violations(cameras)
    if not strict:
        return cameras, violations
    worst = violations.agg(F.max(F.concat_ws(": ", "camera_id", "violation"))).scalar()
    message = F.concat(F.lit("invalid camera registry, e.g. "), worst)
    checked = F.when(worst.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col("camera_id"))
    return cameras.withColumn("camera_id", checked), violations
