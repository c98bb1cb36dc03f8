"""Helpers the text operators share: stable numbering and column bookkeeping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

PART = "__part"
BEFORE = "__before"
#: Most bytes of a table that is sent whole to every executor.
BROADCAST_BYTES = 48_000_000
SLOT = "__slot"
#: About how many bytes of a batch are turned into Python objects, and sent back, at a time.
SLICE_BYTES = 2_000_000


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``most_bytes``, one row at least, so that what a task makes of them stays small."""
    for batch in batches:
        step = max(1, most_bytes * batch.num_rows // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def with_row(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``row`` (the carried columns), and ``text`` unless the row holds it already: a text travels to Python once."""
    row = F.struct(*carry).alias("row")
    return docs.select(row) if "text" in {c.strip("`") for c in carry} else docs.select(row, "text")


def texts_of(batch: pa.RecordBatch) -> list[str | None]:
    """The texts of a batch of ``with_row``."""
    return (batch.column(1) if batch.schema.names[1:2] == ["text"] else batch.column(0).field("text")).to_pylist()


def running_number(codes: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """0, 1, 2, ... within each code, carrying on from the counts in ``seen`` (updated in place)."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.array([], dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(ranked)])
    within = np.arange(len(ranked)) - np.repeat(starts, sizes)
    base = [seen.get(int(ranked[s]), 0) for s in starts]
    out = np.empty(len(ranked), dtype=np.int64)
    out[order] = within + np.repeat(np.asarray(base, dtype=np.int64), sizes)
    for s, size, b in zip(starts, sizes, base):
        seen[int(ranked[s])] = b + int(size)
    return out


def number_within(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: a gapless number from 0 within each value of the integer column ``key`` (null: -1), in no set order.

    ``df`` must read materialised rows (a checkpoint and narrow steps over it), so that its partitions are the same
    whenever they are read. Rows are numbered where they lie; only one small row per (partition, key) is shuffled to find
    where each partition starts, so a key with most of the rows costs no more than many small ones.
    """
    placed = df.withColumn(PART, F.spark_partition_id())
    schema = StructType([*placed.schema.fields, StructField(SLOT, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index(key)).fill_null(-1).to_numpy(zero_copy_only=False)
            slots = pa.array(running_number(codes.astype(np.int64), seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, slots], names=[*batch.schema.names, SLOT])

    counts = placed.groupBy(PART, F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("__key")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__key").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(PART).alias("__at"), "__key", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias(BEFORE)
    )
    numbered = placed.mapInArrow(run, schema)
    joined = numbered.join(
        starts, (F.col(PART) == F.col("__at")) & (F.coalesce(F.col(key).cast("long"), F.lit(-1)) == F.col("__key"))
    )
    return joined.select(*df.columns, (F.col(SLOT) + F.col(BEFORE)).alias(name))


def sent_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised table if its measured size allows it; otherwise the join shuffles, same result."""
    sizes = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in df.columns]
    measured = df.agg(F.sum(sum(sizes, F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(df) if measured <= limit else df
