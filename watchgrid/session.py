"""Session helpers: reliable checkpoints and a size test before a broadcast."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest table, in rows, that is shipped whole to every executor.
BROADCAST_ROWS = 200_000


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("watchgrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-checkpoint-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a session on one machine may leave it unset.

    Set ``spark.cleaner.referenceTracking.cleanCheckpoints`` to have the files of finished steps removed."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not on_one_machine(context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def on_one_machine(master: str) -> bool:
    """``local`` and ``local[...]`` run in one process; ``local-cluster`` does not."""
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage, so an iterative job survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_finished(spark: SparkSession) -> None:
    """Have the driver notice which shuffles and checkpoints nothing refers to any more, so that Spark's cleaner removes their
    files now and not at the next full collection of a driver that hardly fills its heap. Files still in use stay."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a bounded count proves the table small; otherwise leave the join to shuffle."""
    if df.limit(limit + 1).count() <= limit:
        return F.broadcast(df)
    return df
