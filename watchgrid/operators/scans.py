"""Ordered per-key operators that stay parallel when one key holds a large share of all rows.

A window partitioned by key alone sorts and scans a hot key in one task. Here every key is cut into ordered chunks of
bounded size first. Rows are scanned inside (key, chunk); one small row per chunk carries running totals from chunk to
chunk; both parts meet in an equi-join on (key, chunk). Sums, counts, minima, maxima and "last row" are associative, so
the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"


def chunk_of(order: Column, width: float) -> Column:
    """Chunk number of a numeric order column; every chunk spans ``width`` units of it."""
    return F.floor(order / F.lit(float(width))).cast("long")


def _within(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _carry(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence,
    *,
    sums: dict[str, Column] | None = None,
    counts: dict[str, Column] | None = None,
    minima: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running aggregates of ``df`` per key in ``order``; nulls are skipped as in plain aggregates."""
    sums, counts, minima, maxima = (part or {} for part in (sums, counts, minima, maxima))
    base = df.withColumn(CHUNK, chunk)
    totals = base.groupBy(*keys, CHUNK).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.count(c).alias(f"_t_{n}") for n, c in counts.items()],
        *[F.min(c).alias(f"_t_{n}") for n, c in minima.items()],
        *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()],
    )
    before = _carry(keys)
    carried = totals.select(
        *keys,
        CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in (*sums, *counts)],
        *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in minima],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxima],
    )
    inside = _within(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = base.join(carried, [*keys, CHUNK])
    out = {n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_c_{n}") for n, c in sums.items()}
    out |= {n: F.count(c).over(inside) + F.col(f"_c_{n}") for n, c in counts.items()}
    out |= {n: F.least(F.min(c).over(inside), F.col(f"_c_{n}")) for n, c in minima.items()}
    out |= {n: F.greatest(F.max(c).over(inside), F.col(f"_c_{n}")) for n, c in maxima.items()}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def ordinal(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence, name: str) -> DataFrame:
    """Add a 1-based dense row number per key."""
    return running(df, keys, chunk, order, counts={name: F.lit(1)})


def previous(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], columns: dict[str, Column]
) -> DataFrame:
    """Add columns of the preceding row per key (null on the first row). ``order`` names ascending columns."""
    base = df.withColumn(CHUNK, chunk).withColumn("_row", F.struct(*[c.alias(n) for n, c in columns.items()]))
    lasts = base.groupBy(*keys, CHUNK).agg(F.max_by("_row", F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = lasts.select(*keys, CHUNK, F.lag("_last").over(before).alias("_before"))
    joined = base.join(carried, [*keys, CHUNK])
    inside = _within(keys, [F.col(c) for c in order])
    joined = joined.withColumn("_prev", F.coalesce(F.lag("_row").over(inside), F.col("_before")))
    return joined.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in columns])


def with_halo(df: DataFrame, keys: Sequence[str], position: str, rows: int, width: int) -> DataFrame:
    """Assign rows to chunks of ``width`` by their dense 1-based ``position`` and copy the ``rows`` rows that precede
    a chunk into it, flagged ``_halo``. Windows of up to ``rows`` preceding rows then never leave a chunk."""
    if width < rows:
        raise ValueError("a chunk must be at least as long as its halo")
    own = F.floor((F.col(position) - 1) / width).cast("long")
    tail = (F.col(position) - 1) % width >= width - rows
    copies = F.when(
        tail,
        F.array(
            F.struct(own.alias("chunk"), F.lit(False).alias("halo")),
            F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")),
        ),
    ).otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))
    return df.withColumn("_copy", F.explode(copies)).select(
        *df.columns, F.col("_copy.chunk").alias(CHUNK), F.col("_copy.halo").alias("_halo")
    )
