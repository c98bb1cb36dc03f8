"""Registered queries: the tables replayed as streams of files, drained to the end, compared with the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchgrid.catalog import fixtures as fx
from watchgrid.catalog.cameras import _STILLS_SQL, stills
from watchgrid.catalog.frames import cache_frames
from watchgrid.catalog.registry import query, r6
from watchgrid.catalog.validation import DEFAULTS, _EVENTS, cascade
from watchgrid.catalog.water import _PH, _RISE
from watchgrid.operators.validator import confirmed_events
from watchgrid.sources.detections import stream_detections
from watchgrid.streaming import operators as streams
from watchgrid.streaming.ordered import late_rows

FILES = 8
#: Sent last, twice, by a camera of its own: it moves the watermark past every real frame.
_END = 4_102_444_800.0
_END_KEY = -1


def replay(spark, rows, *, ending=True, late=None):
    """Write rows (with ``ts``) as one wave of files and, later, the waves that move the watermark; stream them."""
    folder = fx.shared_folder(spark)
    stamp = F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))
    rows = rows.withColumn("event_time", stamp)
    rows.repartition(FILES).write.mode("append").json(folder)
    if ending:
        for wave in (0, 1):
            last = spark.range(FILES, numPartitions=FILES).withColumn("ts", F.lit(_END + wave)).drop("id")
            for field in rows.schema.fields:
                if field.name not in ("ts", "event_time"):
                    value = F.lit(_END_KEY) if field.name == "camera_id" else F.lit("fire") if field.name == "hazard" else F.lit(None)
                    last = last.withColumn(field.name, value.cast(field.dataType))
            filled = last.withColumn("event_time", stamp).select(*rows.columns)
            filled = filled.withColumn("frame_index", F.lit(wave).cast("long"))
            filled.write.mode("append").json(folder)
    if late is not None:
        late.withColumn("event_time", stamp).repartition(FILES).write.mode("append").json(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).json(folder)


def drain(spark, stream):
    """Run a stream to its end; returns (its output as a table, the finished query)."""
    folder = fx.shared_folder(spark)
    query_ = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/mark")
        .trigger(availableNow=True)
        .start()
    )
    query_.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return out, query_


def whole_frames(det):
    """One row per frame with its detections as an array."""
    found = F.struct(F.array("x1", "y1", "x2", "y2").alias("box"), "confidence", "det_seq")
    return det.select("camera_id", "hazard", "frame_index", "ts", F.array(found).alias("detections"))


def validated(spark, sf_dir, **options):
    streams.use_rocksdb(spark)
    frames = replay(spark, whole_frames(fx.detections(spark, sf_dir)))
    return streams.validate_stream(frames, DEFAULTS, **options)


@query(
    "a11_stream_detections",
    fx.with_ctes("SELECT camera_id || '_' || hazard AS sequence, count(*) AS frames, max(frame_index)::INTEGER AS last_frame FROM detections GROUP BY ALL", "detections"),
)
def a11(spark, sf_dir):
    folder = fx.shared_folder(spark)
    cache_frames(spark, sf_dir).repartition(FILES).write.json(folder)
    out, _ = drain(spark, stream_detections(spark, folder, files_per_trigger=4).select("sequence", "frame_index"))
    return out.groupBy("sequence").agg(F.count("*").alias("frames"), F.max("frame_index").alias("last_frame"))


@query("st01_validate_stream", cascade("SELECT camera_id, hazard, det_seq, rejected_by, track, hits, round(peak, 6) AS peak FROM annotated"))
def st01(spark, sf_dir):
    out, _ = drain(spark, validated(spark, sf_dir))
    return out.select("camera_id", "hazard", "det_seq", "rejected_by", "track", "hits", r6("peak").alias("peak"))


def signal_stream(spark, sf_dir):
    streams.use_rocksdb(spark)
    return replay(spark, fx.signal(spark, sf_dir).withColumnRenamed("seq", "frame_index"))


@query(
    "st02_page_hinkley_stream",
    fx.with_ctes(
        """SELECT camera_id, seq AS frame_index, samples, round(statistic, 6) AS statistic, over AND count(*) FILTER (over) OVER (PARTITION BY camera_id ORDER BY samples) = 1 AS alarm
           FROM (SELECT *, samples >= 5 AND statistic > 0.10 AS over FROM tested)""",
        "signal",
        extra={"tested": _PH.format(keys="camera_id", delta="0.005", source="signal")},
    ),
)
def st02(spark, sf_dir):
    out, _ = drain(spark, streams.page_hinkley_stream(signal_stream(spark, sf_dir).fillna(0.0, ["value"])))
    kept = out.filter(F.col("camera_id") != _END_KEY)
    return kept.select("camera_id", "frame_index", "samples", r6("statistic").alias("statistic"), "alarm")


@query(
    "st03_rise_stream",
    fx.with_ctes(
        """SELECT camera_id, seq AS frame_index, trend, samples, round(rate, 9)::DOUBLE AS area_rate_per_min, round(r_squared, 6)::DOUBLE AS r_squared FROM rises""",
        "signal",
        extra=_RISE,
    ),
)
def st03(spark, sf_dir):
    out, _ = drain(spark, streams.rise_stream(signal_stream(spark, sf_dir).fillna(0.0, ["area_fraction"]), rising=1e-5))
    kept = out.filter(F.col("camera_id") != _END_KEY)
    return kept.select("camera_id", "frame_index", "trend", "samples", F.round("area_rate_per_min", 9).alias("area_rate_per_min"), r6("r_squared").alias("r_squared"))


@query(
    "st04_alert_sink",
    cascade(
        """SELECT hazard, CAST(camera_id AS VARCHAR) AS camera_id, first_frame AS first_seen_frame, frame_index AS confirmed_frame, hits AS supporting_detections, track AS track_id,
             printf('%d_%s_%06d.jpg', camera_id, hazard, frame_index) AS evidence FROM confirmed_rows""",
        extra=_EVENTS,
    ),
)
def st04(spark, sf_dir):
    folder = fx.shared_folder(spark)
    events = confirmed_events(validated(spark, sf_dir, confirmed_only=True))
    # Once, and once more as after a restart that lost its checkpoint: every event is stored once.
    for mark in ("mark", "restarted"):
        streams.start_alert_sink(events, f"{folder}/alerts", f"{folder}/{mark}").awaitTermination()
    schema = (
        "hazard string, camera_id string, first_seen_frame long, confirmed_frame long, supporting_detections long, "
        "track_id long, evidence string"
    )
    return spark.read.schema(schema).json(f"{folder}/alerts").drop("day")


@query(
    "st05_drop_repeats_stream",
    fx.with_ctes("SELECT camera_id, frame_index, signature FROM stills WHERE NOT is_repeat", extra={"stills": _STILLS_SQL}),
)
def st05(spark, sf_dir):
    streams.use_rocksdb(spark)
    out, _ = drain(spark, streams.drop_repeats_stream(replay(spark, stills(spark, sf_dir))))
    return out.filter(F.col("camera_id") != _END_KEY).select("camera_id", "frame_index", "signature")


@query(
    "st06_live_counters",
    cascade(
        """SELECT camera_id, count(*) AS proposed, count(*) FILTER (rejected_by IS NULL) AS confirmed, count(*) FILTER (rejected_by = 'confidence') AS rejected_confidence,
             count(*) FILTER (rejected_by = 'persistence') AS rejected_persistence, count(*) FILTER (rejected_by = 'cooldown') AS rejected_cooldown FROM annotated GROUP BY ALL"""
    ),
)
def st06(spark, sf_dir):
    """Annotated detections, as the cascade stream leaves them, counted by a second stream in complete mode."""
    from watchgrid.operators.validator import validate

    folder = fx.shared_folder(spark)
    validate(fx.stored_detections(spark, sf_dir), DEFAULTS).write.parquet(f"{folder}/annotated")
    schema = spark.read.parquet(f"{folder}/annotated").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/annotated")

    def publish(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/counters")

    writer = streams.live_counters(source).writeStream.outputMode("complete").foreachBatch(publish)
    writer.option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counters")


@query("st08_late_frames", "SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS late FROM events")
def st08(spark, sf_dir):
    """Fire frames are sent after the watermark has passed them: dropped, and counted by the engine."""
    streams.use_rocksdb(spark)
    frames = whole_frames(fx.detections(spark, sf_dir))
    late = F.col("hazard") == "fire"
    stream = streams.validate_stream(replay(spark, frames.filter(~late), late=frames.filter(late)), DEFAULTS)
    out, done = drain(spark, stream)
    return out.agg(F.count("*").alias("processed")).withColumn("late", F.lit(late_rows(done)).cast("long"))


@query(
    "st08_late_rows",
    fx.with_ctes(
        "SELECT camera_id, hazard, frame_index, round(ts, 3) AS ts, 'late' AS status FROM detections WHERE hazard = 'fire'", "detections"
    ),
)
def st08_rows(spark, sf_dir):
    """The same late frames by name: one row each, from the stream that drops them."""
    streams.use_rocksdb(spark)
    frames = whole_frames(fx.detections(spark, sf_dir))
    late = F.col("hazard") == "fire"
    stream = streams.validate_stream(replay(spark, frames.filter(~late), late=frames.filter(late)), DEFAULTS, name_late=True)
    out, _ = drain(spark, stream)
    return out.filter("status = 'late'").select("camera_id", "hazard", "frame_index", F.round("ts", 3).alias("ts"), "status")


#: A wave of the idle replay is one batch of ``FILES`` files, so timers fire at known points.
_WAVE, _IDLE = 3 * 86_400, 2 * 86_400


def end_frames(spark, rows, count, number, ts):
    """So many rows of the camera that is no real one, each a file of its own."""
    last = spark.range(count, numPartitions=count).select(
        F.lit(_END_KEY).cast(rows.schema["camera_id"].dataType).alias("camera_id"),
        F.lit("fire").alias("hazard"),
        F.lit(number).cast("long").alias("frame_index"),
        F.lit(ts).alias("ts"),
    )
    return last.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


@query(
    "st09_idle_expiry",
    fx.with_ctes(
        f"""SELECT camera_id, hazard, frame_index, row_number() OVER (PARTITION BY camera_id, hazard, visit ORDER BY frame_index) AS visit_frame
            FROM (SELECT *, sum(fresh) OVER (PARTITION BY camera_id, hazard ORDER BY frame_index) AS visit FROM (
              SELECT *, CASE WHEN mark >= last_ms + {_IDLE} * 1000 THEN 1 ELSE 0 END AS fresh FROM (
                SELECT d.camera_id, d.hazard, d.frame_index, m.mark,
                       floor(lag(d.ts) OVER (PARTITION BY d.camera_id, d.hazard ORDER BY d.frame_index) * 1000) AS last_ms
                FROM detections d JOIN marks m ON m.wave = floor(d.ts / {_WAVE}))))""",
        "detections",
        extra={
            "waves": f"SELECT floor(ts / {_WAVE}) AS wave, max(ts) AS newest FROM detections GROUP BY ALL",
            # A frame cancels the timer of its key when it comes in, so the watermark of the batch before decides.
            "marks": "SELECT wave, floor(max(newest) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) * 1000) - 60000 AS mark FROM waves",
        },
    ),
)
def st09(spark, sf_dir):
    """Frames in waves of three days; a camera that is quiet for two days is forgotten as soon as the stream has got so far."""
    streams.use_rocksdb(spark)
    folder = fx.shared_folder(spark)
    rows = whole_frames(fx.stored_detections(spark, sf_dir)).select("camera_id", "hazard", "frame_index", "ts")
    rows = rows.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))
    # Each wave is read by itself, so that more waves do not mean more passes over all rows.
    rows.withColumn("wave", F.floor(F.col("ts") / _WAVE)).write.partitionBy("wave").parquet(f"{folder}-waves")
    waves = spark.read.parquet(f"{folder}-waves")
    numbers = sorted(r.wave for r in waves.select("wave").distinct().collect())  # a span of days: a few numbers
    for place, number in enumerate(numbers, start=1):
        waves.filter(F.col("wave") == number).select(*rows.columns).repartition(FILES).write.mode("append").json(folder)
        # A wave of few rows may fill fewer files, and the batch would reach into the next one.
        missing = FILES * place - len(spark.read.schema(rows.schema).json(folder).inputFiles())
        if missing > 0:
            end_frames(spark, rows, missing, 0, float(number * _WAVE)).write.mode("append").json(folder)
    for n in (0, 1):
        end_frames(spark, rows, FILES, n, _END + n).write.mode("append").json(folder)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).json(folder)
    out, _ = drain(spark, streams.visits_stream(source, idle_seconds=_IDLE))
    return out.filter(F.col("camera_id") != _END_KEY).select("camera_id", "hazard", "frame_index", "visit_frame")


@query("ux03_frame_hook", cascade("SELECT hazard, count(*) AS rows_seen FROM annotated GROUP BY ALL"))
def ux03(spark, sf_dir):
    """A user's hook sees every annotated batch."""
    folder = fx.shared_folder(spark)

    def hook(batch, batch_id):
        batch.select("hazard", "det_seq").write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")

    streams.observe_frames(validated(spark, sf_dir), hook, f"{folder}/mark").awaitTermination()
    return spark.read.parquet(f"{folder}/seen").groupBy("hazard").agg(F.count("*").alias("rows_seen"))
