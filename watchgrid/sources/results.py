"""Result documents flattened to (file, path, value) facts, and training histories summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchgrid.session import cut_lineage


def flatten_results(documents: DataFrame) -> DataFrame:
    """(file, json) to one row per scalar leaf: (file, path, value). Path parts are joined by ``|`` because keys may
    hold dots; list items appear under their index. Documents are opened level by level until none holds another."""
    level = documents.select("file", F.lit("").alias("path"), F.parse_json("json").alias("node"))
    leaves = None
    kind = F.schema_of_variant("node")
    while True:
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        here = level.filter(~nested).select("file", "path", F.col("node").cast("string").alias("value"))
        leaves = here if leaves is None else leaves.unionByName(here)
        if level.filter(nested).isEmpty():
            return leaves
        step = level.filter(nested).lateralJoin(
            documents.sparkSession.tvf.variant_explode(F.col("node").outer())
        )
        part = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        level = step.select(
            "file",
            F.when(F.col("path") == "", part).otherwise(F.concat_ws("|", "path", part)).alias("path"),
            F.col("value").alias("node"),
        )
        level = cut_lineage(level)


def dig(document: Column, path: str) -> Column:
    """The value at a ``|``-separated path of a JSON text; null where the path breaks off."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("|"))
    return F.get_json_object(document, f"${steps}")


def history_summary(history: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(run, epoch, metric) to each run's best epoch, and to its curve with every best epoch flagged."""
    best = history.groupBy("run").agg(
        F.max("metric").alias("best_metric"),
        F.min_by("epoch", F.struct(-F.col("metric"), F.col("epoch"))).alias("best_epoch"),
        F.count("*").alias("epochs"),
    )
    curve = history.join(best.select("run", "best_metric"), "run").select(
        "run", "epoch", "metric", (F.col("metric") >= F.col("best_metric") - tolerance).alias("is_best")
    )
    return best, curve
