"""Ordered and time-based helpers over camera streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from watchgrid.functions.stats import array_corr
from watchgrid.operators import scans
from watchgrid.session import cut_lineage


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    tolerance: float,
    keys: Sequence[str],
    *,
    time: str = "ts",
    chunk_seconds: float = 86_400.0,
) -> DataFrame:
    """Each left row with the nearest right row in time, as struct ``nearest`` (null beyond ``tolerance`` seconds); of
    two equally near the earlier. No pairs are formed: both sides are put in one order, and the last right row before
    and the first one after are running maxima and minima over it."""
    keys = list(keys)
    payload = F.struct(F.col(time).alias("_rt"), *[c for c in right.columns if c not in (*keys, time)])
    rows = F.struct(*[c for c in left.columns if c not in (*keys, time)])
    marks = right.select(*keys, F.col(time), payload.alias("_r"))
    wanted = left.select(*keys, F.col(time), rows.alias("_left"))
    chunk = scans.chunk_of(F.col(time), chunk_seconds)
    both = (
        marks.unionByName(wanted, allowMissingColumns=True)
        .withColumn("_side", F.col("_left").isNotNull().cast("int"))
        .withColumn(scans.CHUNK, chunk)
    )
    place = [*keys, scans.CHUNK]
    over_chunks = Window.partitionBy(*keys).orderBy(scans.CHUNK)
    # Only the right rows have a mark, so the chunk table reads nothing else; chunks with left rows alone need no row.
    ends = marks.withColumn(scans.CHUNK, chunk).groupBy(*place).agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    present = ends.unionByName(wanted.select(*keys, chunk.alias(scans.CHUNK)).distinct(), allowMissingColumns=True)
    carried = present.groupBy(*place).agg(F.max("_last").alias("_last"), F.min("_first").alias("_first")).select(
        *place,
        F.max("_last").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_b0"),
        F.min("_first").over(over_chunks.rowsBetween(1, Window.unboundedFollowing)).alias("_a0"),
    )
    inside = Window.partitionBy(*place)
    forward = inside.orderBy(F.col(time), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    backward = inside.orderBy(F.desc(time), F.col("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both_ways = (
        both.join(carried, place)
        .withColumn("_before", F.coalesce(F.max("_r").over(forward), F.col("_b0")))
        .withColumn("_after", F.coalesce(F.min("_r").over(backward), F.col("_a0")))
    )
    to_before = F.col(time) - F.col("_before._rt")
    to_after = F.col("_after._rt") - F.col(time)
    earlier = F.col("_after").isNull() | (to_before <= to_after)
    nearest = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    near_enough = F.abs(F.col("_near._rt") - F.col(time)) <= tolerance
    matched = both_ways.filter("_side = 1").withColumn("_near", nearest)
    return matched.select(
        *keys, F.col(time), "_left.*", F.when(near_enough, F.col("_near").withField(time, F.col("_near._rt")).dropFields("_rt")).alias("nearest")
    ).select(*left.columns, "nearest")


def longest_run(ids: DataFrame, chunk_width: int = 65_536, keys: Sequence[str] = ()) -> DataFrame:
    """Length and first id of the longest run of consecutive ids per key; the earliest of equal runs wins."""
    keys = list(keys)
    distinct = ids.select(*keys, "id").distinct().withColumn("_all", F.lit(0))
    chunk = scans.chunk_of(F.col("id"), chunk_width)
    numbered = scans.ordinal(distinct, [*keys, "_all"], chunk, [F.col("id")], "_n")
    runs = numbered.groupBy(*keys, (F.col("id") - F.col("_n")).alias("_island")).agg(
        F.count("*").alias("length"), F.min("id").alias("first_id")
    )
    best = F.max_by(F.struct("length", "first_id"), F.struct(F.col("length"), -F.col("first_id")))
    return runs.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def recent(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest n rows per key (``order`` newest first), with their rank; partial limits run before the shuffle."""
    ranked = df.withColumn("recency", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("recency") <= n)


def frame_gaps(frames: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str] = ("ts", "frame_index")) -> DataFrame:
    """Seconds since the previous frame of the key."""
    before = scans.previous(frames, keys, chunk, list(order), {"_prev_ts": F.col("ts")})
    return before.withColumn("gap", F.col("ts") - F.col("_prev_ts")).drop("_prev_ts")


_POINT = "struct<x: int, y: int>"


def _centres(batch: pa.RecordBatch, group: Sequence[str]) -> Iterator[tuple[tuple, int, dict]]:
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*group, "frame_no", "x1", "y1", "x2", "y2")]
    for *here, number, x1, y1, x2, y2 in zip(*columns):
        yield tuple(here), number, {"x": int((x1 + x2) / 2), "y": int((y1 + y2) / 2)}


def track_trails(
    confirmed: DataFrame, length: int = 24, keys: Sequence[str] = ("camera_id", "hazard"), chunk_frames: int = 65_536
) -> DataFrame:
    """The trail of centres at every sighting of a confirmed track: at most ``length`` points, one dropped per frame in
    which the track was not seen, so it is gone at ``fades_at`` unless seen before.

    ``confirmed``: keys, track_id, frame_no, x1..y2. A track is cut into chunks of ``chunk_frames`` frames. How many points
    a trail has behind a chunk is a bounded shift of how many it had before it, and such shifts compose; the points are
    always the newest sightings. So a chunk first reports its shift and its newest ``length`` centres, these small rows are
    chained per track, and every chunk then begins with the exact trail. A fixed number of frames in front of a chunk
    would not do: a track seen every other frame keeps its trail's length for ever."""
    group_keys = [*keys, "track_id"]
    by_chunk = [*group_keys, scans.CHUNK]
    sightings = confirmed.select(*group_keys, "frame_no", "x1", "y1", "x2", "y2", scans.chunk_of(F.col("frame_no"), chunk_frames).alias(scans.CHUNK))
    sightings = cut_lineage(sightings)
    spans = sightings.groupBy(*group_keys).agg(F.min(scans.CHUNK).alias("_a"), F.max(scans.CHUNK).alias("_b")).filter("_a < _b")
    state = f"trail array<{_POINT}>, last long"
    long = sightings.join(spans.select(*group_keys), group_keys, "left_semi")
    starts = _trails_between(long, length, group_keys, by_chunk, state)
    feed = sightings.withColumns({"trail": F.lit(None).cast(f"array<{_POINT}>"), "last": F.lit(None).cast("long")})
    blank = [F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in ("x1", "y1", "x2", "y2")]
    feed = feed.unionByName(starts.select(*by_chunk, F.lit(-1).cast(feed.schema["frame_no"].dataType).alias("frame_no"), *blank, "trail", "last"))
    schema = T.StructType(
        [confirmed.schema[k] for k in (*group_keys, "frame_no")]
        + T.StructType.fromDDL(f"trail array<{_POINT}>, trail_length int, fades_at long").fields
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trail, last = None, [], None
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(n)).to_pylist() for n in (*by_chunk, "frame_no", "x1", "y1", "x2", "y2", "trail", "last")]
            out = []
            for *here, number, x1, y1, x2, y2, given, given_last in zip(*columns):
                if here != group:
                    group, trail, last = here, [], None
                if x1 is None:
                    trail, last = given, given_last
                    continue
                trail = trail[max(0, number - last - 1) :] if last is not None else []
                trail = [*trail, {"x": int((x1 + x2) / 2), "y": int((y1 + y2) / 2)}][-length:]
                last = number
                out.append((*here[:-1], number, trail, len(trail), number + len(trail)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow
                )

    ordered = feed.repartition(*by_chunk).sortWithinPartitions(*by_chunk, "frame_no")
    return ordered.mapInArrow(run, schema)


def _trails_between(sightings: DataFrame, length: int, group_keys: list[str], by_chunk: list[str], state: str) -> DataFrame:
    """The trail, and the frame it was last added to, with which every chunk but a track's first begins."""
    kept = [sightings.schema[k] for k in by_chunk]
    report = T.StructType(kept + T.StructType.fromDDL(f"first long, last long, shift long, least int, most int, newest array<{_POINT}>").fields)
    chained = T.StructType(kept + T.StructType.fromDDL(state).fields)
    report_arrow, chained_arrow = to_arrow_schema(report), to_arrow_schema(chained)

    def packed(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Behind its first sighting a chunk turns a trail of x points into one of min(most, max(least, x + shift))."""
        group, row, out = None, None, []
        for batch in batches:
            for here, number, centre in _centres(batch, by_chunk):
                if here != group:
                    if group is not None:
                        out.append((*group, *row))
                    group, row = here, [number, number, 0, 0, length, [centre]]
                    continue
                by = 1 - max(0, number - row[1] - 1)
                row[2] += by
                row[3], row[4] = (min(length, max(1, bound + by)) for bound in row[3:5])
                row[1], row[5] = number, [*row[5], centre][-length:]
            if out:
                yield packed(out, report_arrow)
                out = []
        if group is not None:
            yield packed([(*group, *row)], report_arrow)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trail, last = None, [], None
        for batch in batches:
            names, out = batch.schema.names, []
            columns = [batch.column(names.index(n)).to_pylist() for n in report.names]
            for *here, first, until, shift, least, most, newest in zip(*columns):
                if here[:-1] != group:
                    group, trail, last = here[:-1], [], None
                if last is not None:
                    out.append((*here, trail, last))
                points = min(length, max(1, len(trail) + 1 - (first - last - 1))) if last is not None else 1
                points = min(most, max(least, points + shift))
                trail, last = [*trail, *newest][-points:], until
            if out:
                yield packed(out, chained_arrow)

    reported = sightings.repartition(*by_chunk).sortWithinPartitions(*by_chunk, "frame_no").mapInArrow(summarise, report)
    return reported.repartition(*group_keys).sortWithinPartitions(*by_chunk).mapInArrow(chain, chained)


def latency_profile(timings: DataFrame, n: int = 200, key: str = "detector") -> DataFrame:
    """Median over each detector's last n inferences, and the rate it implies."""
    last = recent(timings, n, [key], [F.desc("seq")])
    median = last.groupBy(key).agg(F.percentile("latency_ms", 0.5).alias("median_latency_ms"), F.count("*").alias("inferences"))
    return median.withColumn("fps", F.when(F.col("median_latency_ms") > 0, 1000.0 / F.col("median_latency_ms")).otherwise(F.lit(0.0)))


def paired_corr(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = (), least: int = 4) -> DataFrame:
    """Correlation of two signals; null under ``least`` pairs."""
    grouped = pairs.groupBy(*keys).agg(F.count("*").alias("pairs"), F.corr(a, b).alias("_r"))
    return grouped.select(*keys, "pairs", F.when(F.col("pairs") >= least, F.col("_r")).alias("correlation"))


def continuity(
    hists: DataFrame,
    baseline: DataFrame,
    *,
    head: int = 24,
    others: int = 12,
    pairs: int = 12,
    seed: int = 0,
    margin: float = 0.15,
    number: Column | None = None,
) -> DataFrame:
    """Does a sequence look like itself? Median correlation of adjacent frames against that of frames paired with
    footage from outside; passes when it is higher by ``margin``. ``hists``: sequence, pos, hist; ``baseline``: pos,
    hist. The first ``head`` frames and ``others`` outside frames are what the check looks at. Which of them are paired
    follows by arithmetic from the seed and a sequence's ``number`` (a checksum of its name, if not given)."""
    number = F.crc32(F.col("sequence").cast("string").cast("binary")) if number is None else number.cast("long")
    order = Window.partitionBy("sequence").orderBy("pos")
    first = hists.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= head)
    adjacent = (
        first.withColumn("_prev", F.lag("hist").over(order))
        .filter(F.col("_prev").isNotNull())
        .groupBy("sequence")
        .agg(F.percentile(array_corr(F.col("_prev"), F.col("hist")), 0.5).alias("adjacent"), (F.count("*") + 1).alias("frames"))
    )
    outside = baseline.orderBy("pos").limit(others).select(F.row_number().over(Window.orderBy("pos")).alias("_o"), F.col("hist").alias("_other"))
    sizes = first.groupBy("sequence").agg(F.count("*").alias("_size"))
    draws = (
        sizes.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(pairs))))
        .withColumn("_n", (F.pmod(7 * number + 5 * F.col("_draw") + seed, F.col("_size")) + 1).cast("int"))
        .withColumn("_o", (F.pmod(3 * number + 11 * F.col("_draw") + seed, F.lit(others)) + 1).cast("int"))
    )
    unrelated = (
        draws.join(first.select("sequence", "_n", "hist"), ["sequence", "_n"])
        .join(outside, "_o")
        .groupBy("sequence")
        .agg(F.percentile(array_corr(F.col("hist"), F.col("_other")), 0.5).alias("unrelated"))
    )
    return adjacent.join(unrelated, "sequence").withColumn("continuous", F.col("adjacent") >= F.col("unrelated") + margin)
