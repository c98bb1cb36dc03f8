"""Cooldown over the confirmation candidates of a key, whatever share of all rows the key holds.

A candidate is let through unless one let through before it, at most ``cool`` seconds ago, overlaps it by ``iou``. That is a
chain of decisions as long as the key's history, so it is shortened before anything is walked:

* Time is cut into slices a little wider than ``cool``. Only candidates of one slice or of neighbouring slices can meet.
* Inside a slice, candidates form spots whose common core is so large a part of their hull that any two of them overlap
  enough. Core and hull of two spots tell, without looking at their members, that all pairs overlap enough (a bond of the
  same thing), that none does, or neither. Spots are few, and everything is decided on them.
* Bonded spots that follow each other one by one are a path: a steady thing. On a path "the next one let through after
  this one" is a function of the candidate alone. Blocks of slices are reduced to where their first candidates lead to in
  the next block, and those pointers are doubled by equi-joins until every block knows where it is entered.
* What is not a path, spots that may or may not overlap, is walked in order, one group of bonded spots at a time, by
  candidates only.

All boxes that are let through come back; they are few, one per thing and cooldown.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from watchgrid.operators.cascade import box_iou
from watchgrid.operators.components import components
from watchgrid.session import cut_lineage

#: Slices of a path that one task reduces to pointers.
BLOCK_SLICES = 32
#: What bounds on overlaps must clear their limit by, and what slices are wider than the cooldown by.
MARGIN = 1e-9
_BOX = ("x1", "y1", "x2", "y2")
_OWN = ("place", "ts", "cool", "iou", *_BOX)


def slice_of(ts: Column, cool: Column) -> Column:
    """Candidates at most ``cool`` apart are in the same slice or in neighbouring ones, rounding included."""
    return F.floor(ts / (cool * F.lit(1.0 + 1e-6) + F.lit(1e-3))).cast("long")


def let_through(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidates that are let through. ``candidates``: keys, place (order within the key, unique), ts (not falling),
    cool and iou (one value each per key), x1..y2. Adds ``slice``."""
    keys = list(keys)
    sliced = candidates.select(*keys, *_OWN, slice_of(F.col("ts"), F.col("cool")).alias("slice"))
    spotted = cut_lineage(_with_spots(sliced, keys))
    nodes, bonds = _nodes_and_bonds(spotted, keys)
    groups = _groups(nodes, bonds, keys)
    known = cut_lineage(spotted.join(groups, [*keys, "slice", "spot"]).drop("spot"))
    whole = [*keys, "of", "block"]
    paths = known.filter("NOT tangled").withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES).cast("long"))
    entered = _entries(paths, whole)
    ready = paths.join(entered, whole).select(*whole, *_OWN, "slice", "entry")
    tangles = known.filter("tangled").select(
        *keys, "of", F.lit(0).cast("long").alias("block"), *_OWN, "slice", F.lit(None).cast("long").alias("entry")
    )
    return _walked(ready.unionByName(tangles), whole).drop("of", "block", "entry")


# Spots, and how they relate.


def _area(x1, y1, x2, y2):
    return max(0.0, x2 - x1) * max(0.0, y2 - y1)


class _Spots:
    """Groups boxes so that core over hull stays at ``least``; a box without extent is a spot by itself."""

    def __init__(self, least: float):
        self.least, self.spots = least + MARGIN, []

    def put(self, x1, y1, x2, y2) -> int:
        for n, (core, hull) in enumerate(self.spots):
            new_core = (max(core[0], x1), max(core[1], y1), min(core[2], x2), min(core[3], y2))
            new_hull = (min(hull[0], x1), min(hull[1], y1), max(hull[2], x2), max(hull[3], y2))
            if _area(*new_core) >= self.least * _area(*new_hull) > 0:
                self.spots[n] = (new_core, new_hull)
                return n
        self.spots.append(((x1, y1, x2, y2), (x1, y1, x2, y2)))
        return len(self.spots) - 1


def _ordered(df: DataFrame, group: list[str]) -> DataFrame:
    """Each group in one task, in order."""
    return df.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, "place")


def _with_spots(sliced: DataFrame, keys: list[str]) -> DataFrame:
    schema = T.StructType([*sliced.schema.fields, T.StructField("spot", T.IntegerType())])
    group = [*keys, "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, spots = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*group, "iou", *_BOX)]
            out = []
            for *at, least, x1, y1, x2, y2 in zip(*columns):
                if at != here:
                    here, spots = at, _Spots(least)
                out.append(spots.put(x1, y1, x2, y2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=schema.names)

    return _ordered(sliced, group).mapInArrow(run, schema)


def _size(box: Sequence[Column]) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def _sides(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in _BOX]


def _meet(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]


def _hull(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])]


def _nodes_and_bonds(spotted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Spots with their core, hull and smallest member, and the pairs of spots of which some members may overlap enough."""
    nodes = spotted.groupBy(*keys, "slice", "spot").agg(
        *[(F.max if c in ("x1", "y1") else F.min)(c).alias(f"core_{c}") for c in _BOX],
        *[(F.min if c in ("x1", "y1") else F.max)(c).alias(f"hull_{c}") for c in _BOX],
        F.min(_size([F.col(c) for c in _BOX])).alias("least_size"),
        F.first("iou").alias("iou"),
    )
    nodes = cut_lineage(nodes)
    parts = [c for c in nodes.columns if c not in (*keys, "slice", "iou")]
    left = nodes.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("ahead"))
    left = left.withColumn("to_slice", F.col("slice") + F.col("ahead"))
    right = nodes.select(*keys, F.col("slice").alias("to_slice"), *[F.col(c).alias(f"to_{c}") for c in parts])
    pairs = left.join(right, [*keys, "to_slice"]).filter("ahead = 1 OR spot < to_spot")
    core, hull = _meet(_sides("core_"), _sides("to_core_")), _hull(_sides("hull_"), _sides("to_hull_"))
    surely = (_size(core) >= (F.col("iou") + MARGIN) * _size(hull)) & (_size(hull) > 0)
    at_most = _size(_meet(_sides("hull_"), _sides("to_hull_")))
    never = at_most < (F.col("iou") - MARGIN) * F.greatest("least_size", "to_least_size")
    bonds = pairs.filter(~F.coalesce(never, F.lit(False))).select(
        *keys, "slice", "spot", "to_slice", "to_spot", ((F.col("ahead") == 1) & F.coalesce(surely, F.lit(False))).alias("same")
    )
    whole = (_size(_sides("core_")) >= (F.col("iou") + MARGIN) * _size(_sides("hull_"))) & (_size(_sides("hull_")) > 0)
    return nodes.select(*keys, "slice", "spot", F.coalesce(whole, F.lit(False)).alias("whole")), cut_lineage(bonds)


def _groups(nodes: DataFrame, bonds: DataFrame, keys: list[str]) -> DataFrame:
    """Per spot ``of`` (the earliest spot it is bonded with, over any number of bonds) and ``tangled``."""
    here, there = F.struct("slice", "spot"), F.struct(F.col("to_slice").alias("slice"), F.col("to_spot").alias("spot"))
    sides = bonds.select(*keys, "same", here.alias("a"), there.alias("b"))
    forward = sides.select(*keys, F.col("a").alias("node"), "same", F.lit(1).alias("ahead"), F.lit(0).alias("behind"))
    backward = sides.select(*keys, F.col("b").alias("node"), "same", F.lit(0).alias("ahead"), F.lit(1).alias("behind"))
    counted = forward.unionByName(backward).groupBy(*keys, "node").agg(
        F.sum("ahead").alias("ahead"), F.sum("behind").alias("behind"), F.min("same").alias("same")
    )
    known = nodes.select(*keys, here.alias("node"), "whole").join(counted, [*keys, "node"], "left")
    known = known.join(components(sides, keys), [*keys, "node"], "left")
    plain = F.coalesce(F.col("same") & (F.col("ahead") <= 1) & (F.col("behind") <= 1), F.lit(True))
    known = known.select(*keys, "node", (~(F.col("whole") & plain)).alias("odd"), F.coalesce("of", "node").alias("of"))
    known = cut_lineage(known)
    tangled = known.groupBy(*keys, "of").agg(F.max("odd").alias("tangled"))
    return known.join(tangled, [*keys, "of"]).select(*keys, "node.slice", "node.spot", "of", "tangled")


# Paths: pointers between blocks.


def _entries(paths: DataFrame, whole: list[str]) -> DataFrame:
    """Per block of a path that lets anything through, the place of the first that is (``entry``)."""
    early = F.pmod("slice", F.lit(BLOCK_SLICES)) < 2
    copies = F.when(early, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    feed = paths.select(*whole[:-1], "block", "place", "ts", "cool", early.alias("early"), F.explode(copies).alias("back"))
    feed = feed.select(*whole[:-1], (F.col("block") - F.col("back")).alias("block"), "place", "ts", "cool", "early", (F.col("back") == 1).alias("beyond"))
    schema = T.StructType([paths.schema[k] for k in whole] + T.StructType.fromDDL("place long, to_place long").fields)
    arrow = to_arrow_schema(schema)

    def leads(rows: list[tuple]) -> list[tuple[int, int]]:
        """(place, place beyond the block that it leads to) of the candidates a block may be entered at."""
        target: list[int | None] = [None] * len(rows)
        j = len(rows)
        for i in range(len(rows) - 1, -1, -1):
            place, ts, cool, _, beyond = rows[i]
            if beyond:
                continue
            while j - 1 > i and not rows[j - 1][1] - ts <= cool:
                j -= 1
            if j < len(rows):
                target[i] = rows[j][0] if rows[j][4] else target[j]
        return [(r[0], t) for n, (r, t) in enumerate(zip(rows, target)) if t is not None and not r[4] and (r[3] or n == 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for batch in batches:
            out = []
            names = (*whole, "place", "ts", "cool", "early", "beyond")
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
            for record in zip(*columns):
                at, rest = record[: len(whole)], record[len(whole) :]
                if at != here:
                    out += [(*here, *lead) for lead in leads(rows)] if rows else []
                    here, rows = at, []
                rows.append(rest)
            if out:
                yield _packed(out, arrow)
        out = [(*here, *lead) for lead in leads(rows)] if rows else []
        if out:
            yield _packed(out, arrow)

    path = whole[:-1]
    level = cut_lineage(_ordered(feed, whole).mapInArrow(run, schema).drop("block"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        onward = level.select(*path, F.col("place").alias("to_place"), F.col("to_place").alias("beyond"))
        doubled = level.join(onward, [*path, "to_place"]).select(*path, "place", F.col("beyond").alias("to_place"))
        level = cut_lineage(doubled)
    reached = paths.groupBy(*path).agg(F.min("place").alias("place"))
    for level in reversed(levels):
        reached = cut_lineage(reached.unionByName(reached.join(level, [*path, "place"]).select(*path, F.col("to_place").alias("place"))))
    entered = paths.select(*whole, "place").join(reached, [*path, "place"])
    return entered.groupBy(*whole).agg(F.min("place").alias("entry"))


def _packed(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _walked(rows: DataFrame, whole: list[str]) -> DataFrame:
    """What is let through of each group in order; nothing before ``entry``, where one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, recent = None, []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*whole, "entry", *_OWN)]
            passed = []
            for record in zip(*columns):
                at, (entry, place, ts, cool, least, *box) = record[: len(whole)], record[len(whole) :]
                if at != here:
                    here, recent = at, []
                recent = [r for r in recent if ts - r[1] <= cool]
                free = (entry is None or place >= entry) and not any(box_iou(box, r[0]) >= least for r in recent)
                if free:
                    recent.append((box, ts))
                passed.append(free)
            yield batch.filter(pa.array(passed, pa.bool_()))

    return _ordered(rows, whole).mapInArrow(run, rows.schema)
