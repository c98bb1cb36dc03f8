"""Connected components of many small or few large graphs at once, by hooking and pointer jumping over equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from watchgrid.session import cut_lineage


def components(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``node``, ``of`` (the smallest node reachable) for every node of ``links`` (keys, a, b; any direction).

    Each round a node learns the smallest label among its neighbours and tells it to its own label's node too, then
    labels are replaced by their labels, so long chains take a logarithm of their length. No row ever holds a node's
    neighbours, and lineage is cut every round."""
    keys = list(keys)
    pair = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))
    ends = cut_lineage(links.select(*keys, F.explode(pair).alias("e")).select(*keys, "e.*").distinct())
    state = ends.groupBy(*keys, "node").agg(F.least(F.first("node"), F.min("near")).alias("of"))
    state = cut_lineage(state)
    moving = not state.isEmpty()
    while moving:
        labels = state.select(*keys, F.col("node").alias("near"), F.col("of").alias("there"))
        heard = ends.join(labels, [*keys, "near"]).groupBy(*keys, "node").agg(F.min("there").alias("there"))
        told = heard.join(state, [*keys, "node"]).filter("there < of")
        told = told.select(*keys, F.explode(F.array("node", "of")).alias("node"), "there").groupBy(*keys, "node").agg(F.min("there").alias("there"))
        hooked = state.join(told, [*keys, "node"], "left").select(*keys, "node", F.col("of").alias("old"), F.least("of", "there").alias("new"))
        hooked = cut_lineage(hooked)
        hop = hooked.select(*keys, F.col("node").alias("new"), F.col("new").alias("of"))
        moved = cut_lineage(hooked.join(hop, [*keys, "new"]).select(*keys, "node", "old", "of"))
        state, moving = moved.drop("old"), not moved.filter("old != of").isEmpty()
    return state
