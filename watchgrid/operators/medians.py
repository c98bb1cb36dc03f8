"""Exact medians of any number of values, without gathering a group.

Distributed selection: a key with many values is narrowed round by round. A mergeable sketch of what is left gives cut
points of equal rank; the range of cut points that holds the middle is kept, what lies below it is counted, and the rest
is dropped. Each round keeps a few thousandths, so a handful of rounds serve any size. At most ``MOST`` values of a key, equal
ones merged, are put in order at last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from watchgrid.session import cut_lineage

#: Rank error of the sketch (one part in so many), and cut points of a round. A cut point's error must stay below a step.
ACCURACY = 100_000
STEPS = 500
#: So many values of one key may be put in order in one task.
MOST = 100_000


def exact_medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, lower (element (n-1) // 2 of the order), middle (mean of both) and upper (element n // 2). Nulls count
    as no value; nan is the largest."""
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    large = sizes.filter((F.col("n") > MOST) & (F.col("_lo") < F.col("_hi")))
    # One large key takes ``MOST`` rows, so there are few of them: they are sent to the values, and never the values of one
    # key to one task.
    left = cut_lineage(large.select(*keys, "n", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_left")))
    if left.isEmpty():
        return _ranked(_counted(rows, left.select(*keys, "n", "_below"), keys), keys)
    kept, places = rows.join(F.broadcast(left.select(*keys)), keys, "left_anti"), []
    held = rows.join(F.broadcast(left.select(*keys)), keys, "left_semi")
    while not left.isEmpty():
        narrowed, again = _narrowed(held, left, keys)
        # Ties that no cut point divides are merged below; so is what is small enough.
        more = (F.col("_left") > MOST) & (F.col("_lo") < F.col("_hi")) & (F.col("_left") < F.col("_before"))
        done = again.filter(~more).select(*keys, "n", "_below")
        kept = kept.unionByName(narrowed.join(F.broadcast(done.select(*keys)), keys, "left_semi"))
        places.append(done)
        left = again.filter(more).select(*keys, "n", "_below", "_left")
        held = narrowed.join(F.broadcast(left.select(*keys)), keys, "left_semi")
    return _ranked(_counted(kept, reduce(DataFrame.unionByName, places), keys), keys)


def _counted(kept: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """Equal values merged before the shuffle, with n and ``_below`` from ``places`` where a key was narrowed, else null."""
    return kept.groupBy(*keys, "_v").agg(F.count("*").alias("_count")).join(F.broadcast(places), keys, "left")


def _narrowed(held: DataFrame, left: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The values of each key around the two middle ranks, and per key what lies below them and how many are left."""
    cuts = F.percentile_approx("_v", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
    found = held.groupBy(*keys).agg(cuts.alias("_cuts")).join(F.broadcast(left), keys)

    def step(rank: Column) -> Column:
        return (rank - F.col("_below")) * STEPS / F.col("_left")

    first = F.greatest(F.floor(step(F.floor((F.col("n") - 1) / 2))) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil(step(F.floor(F.col("n") / 2) + 1)) + 1, F.lit(STEPS)).cast("int")
    # The outermost cut points are open, so that no rounding of a sketch loses an end.
    low, high = F.when(first > 0, F.col("_cuts")[first]), F.when(last < STEPS, F.col("_cuts")[last])
    bounds = cut_lineage(found.select(*keys, low.alias("_low"), high.alias("_high")))
    placed = held.join(F.broadcast(bounds), keys)
    under = F.coalesce(F.col("_v") < F.col("_low"), F.lit(False))
    over = F.coalesce(F.col("_v") > F.col("_high"), F.lit(False))
    inside = F.when(~under & ~over, F.col("_v"))
    counted = placed.groupBy(*keys).agg(
        F.count(F.when(under, 1)).alias("_passed"), F.count(inside).alias("_left"), F.min(inside).alias("_lo"), F.max(inside).alias("_hi")
    )
    before = left.select(*keys, "n", F.col("_below").alias("_had"), F.col("_left").alias("_before"))
    again = counted.join(F.broadcast(before), keys).withColumn("_below", F.col("_had") + F.col("_passed"))
    return cut_lineage(placed.filter(~under & ~over).select(*keys, "_v")), cut_lineage(again)


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Medians from the distinct values that are left, each with its count."""
    whole = Window.partitionBy(*keys)
    order = whole.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumns(
        {"_at": F.sum("_count").over(order) + F.coalesce("_below", F.lit(0)), "n": F.coalesce("n", F.sum("_count").over(whole))}
    )

    def element(rank: Column) -> Column:
        return F.min(F.when(F.col("_at") > rank, F.col("_v")))

    low, high = element(F.floor((F.col("n") - 1) / 2)), element(F.floor(F.col("n") / 2))
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), low.alias("lower"), high.alias("upper")).select(
        *keys, "n", "lower", ((F.col("lower") + F.col("upper")) / 2).alias("middle"), "upper"
    )
