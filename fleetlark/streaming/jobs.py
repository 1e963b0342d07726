"""Structured Streaming jobs: ingest, alert detection, windowed statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from fleetlark import schemas as S
from fleetlark.functions import values as V
from fleetlark.functions.geo import haversine_km
from fleetlark.operators import detect, reports
from fleetlark.operators.zones import chosen_zone, with_zones
from fleetlark.sources import gps
from fleetlark.sources.store import writer_of
from fleetlark.streaming import sinks
from fleetlark.streaming.processors import EARLY, FOUND, LATE, LEGS, AlertProcessor, LegProcessor

# Fixed value: how often results are committed.
COMMIT_INTERVAL = "1 second"
# How much a micro-batch of files may hold.
BYTES_PER_BATCH = "256m"
# A reading dated further ahead of its micro-batch's clock than this is set apart.
CLOCK_TOLERANCE = "10 minutes"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare_state(spark: SparkSession) -> None:
    """The keyed operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _limited(source: DataStreamReader, files_per_batch: int | None) -> DataStreamReader:
    """A micro-batch is bounded in bytes, or where given in files: the keyed operators hold
    one vehicle's rows of a micro-batch, and one vehicle may send most of them."""
    if files_per_batch is None:
        return source.option("maxBytesPerTrigger", BYTES_PER_BATCH)
    return source.option("maxFilesPerTrigger", files_per_batch)


def read_readings(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Readings arriving as parquet files."""
    return _limited(spark.readStream.schema(S.READING), files_per_batch).parquet(path)


def read_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """GPS messages arriving as JSON-lines files of (key, value, topic, partition, offset)."""
    source = spark.readStream.schema("key string, value string, topic string, partition int, offset long")
    return _limited(source, files_per_batch).json(path)


def read_kafka(spark: SparkSession, servers: str, topic: str = "vehicle-gps", offsets_per_batch: int = 5_000_000) -> DataFrame:
    """GPS messages from Kafka, in the same columns; needs Spark's Kafka connector."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", offsets_per_batch).load()
            .selectExpr("CAST(key AS string) AS key", "CAST(value AS string) AS value", "topic", "partition", "offset"))


def _started(writer, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": COMMIT_INTERVAL}
    return writer.trigger(**trigger).start()


def ingest(messages: DataFrame, readings_path: str, status_path: str, dead_letter_path: str, checkpoint: str,
           available_now: bool = False) -> StreamingQuery:
    """Parses and checks messages; stores readings and statuses, and refused messages as
    dead letters."""
    routed, writer = gps.route_events(gps.parse_gps(messages)), writer_of(messages.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            readings = gps.to_readings(batch)
            sinks.write_readings(readings, readings_path, batch_id, writer)
            sinks.upsert_status(readings, status_path, batch_id, writer)
            letters = gps.to_dlq(batch, F.current_timestamp())
            sinks.write_dead_letters(letters, dead_letter_path, batch_id, writer)
        finally:
            batch.unpersist()

    return _started(routed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store), available_now)


def _early(ahead: str) -> Column:
    """Dated in the future. The clock is the micro-batch's, the same when it is repeated."""
    return F.col("event_timestamp") > F.current_timestamp() + F.expr(f"INTERVAL {ahead}")


def detect_stateful(readings: DataFrame, fences: DataFrame, *, idle_threshold: str = S.IDLE_THRESHOLD,
                    idle_speed: float = S.IDLE_SPEED_KPH, buffer_m: float = S.ZONE_BUFFER_M,
                    priority: str = "area", speed_limit: float | None = None, ahead: str = CLOCK_TOLERANCE) -> DataFrame:
    """Idle and geofence alerts of a stream, with a limit also speeding alerts, with readings that came too late as
    LATE rows and those dated over ``ahead`` in the future as EARLY rows, which change no state.

    Zones are looked up per reading in a broadcast index; one shuffle by vehicle feeds one
    stateful operator for both kinds of alert.
    """
    prepare_state(readings.sparkSession)
    narrow = readings.select("id", "vehicle_id", F.unix_micros("event_timestamp").alias("at"), "lat", "lng", "speed_kph",
                             _early(ahead).alias("early"))
    placed = with_zones(narrow, fences, buffer_m).select(
        *narrow.columns, chosen_zone(priority).alias("raw_zone"), "near",
        F.expr("CASE WHEN size(zones) > 1 THEN sort_array(transform(zones, z -> z.name)) END").alias("overlapping_zones"))
    found = placed.groupBy("vehicle_id").transformWithState(
        AlertProcessor(V.micros_of(idle_threshold), idle_speed, speed_limit), FOUND, "Append", "None")
    typed = found.withColumns({
        "detected_at": F.timestamp_micros("at"), "first_idle_at": F.timestamp_micros("first_idle_us"),
        "threshold": F.lit(speed_limit).cast("double"), "excess": F.col("speed_kph") - F.lit(speed_limit).cast("double"),
        "zone_count": F.expr("CASE WHEN overlapping_zones IS NOT NULL THEN size(overlapping_zones) END")})
    details = (F.when(F.col("alert_type") == S.IDLE, detect.idle_details())
               .when(F.col("alert_type") == S.SPEEDING, detect.speeding_details())
               .when(~F.col("alert_type").isin(LATE, EARLY), detect.zone_details()))
    return detect.alert_rows(typed, details)


def detect_stream(readings: DataFrame, fences: DataFrame, *, speed_limit: float = S.SPEED_LIMIT_KPH,
                  **options) -> DataFrame:
    """All alerts of a stream in one, and the LATE and EARLY rows; the source is read once for all."""
    return detect_stateful(readings, fences, speed_limit=speed_limit, **options)


def detect_messages(messages: DataFrame, fences: DataFrame, **options) -> DataFrame:
    """GPS messages in, alerts out, parsed once; refused messages are left to ``ingest``."""
    return detect_stream(gps.to_readings(gps.route_events(gps.parse_gps(messages))), fences, **options)


def run_detection(alerts: DataFrame, alerts_path: str, late_path: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Stores detected alerts, and apart from them the readings that came too late or are dated in the future."""
    writer = writer_of(alerts.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            late = F.col("alert_type").isin(LATE, EARLY)
            sinks.write_alerts(batch.where(~late), alerts_path, batch_id, writer)
            sinks.write_alerts(batch.where(late), late_path, batch_id, writer)
        finally:
            batch.unpersist()

    return _started(alerts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store), available_now)


def consume_alerts(messages: DataFrame, alerts_path: str, dead_letter_path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Stores the alerts of alert messages; refused messages become dead letters."""
    routed, writer = gps.route_alerts(gps.parse_alerts(messages)), writer_of(messages.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            sinks.write_alerts(gps.to_alerts(batch), alerts_path, batch_id, writer)
            sinks.write_dead_letters(gps.to_dlq(batch, F.current_timestamp()), dead_letter_path, batch_id, writer)
        finally:
            batch.unpersist()

    return _started(routed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store), available_now)


def stats_stream(readings: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes", ahead: str = CLOCK_TOLERANCE) -> DataFrame:
    """Speed, distance and count per vehicle and window, each once the watermark has passed
    it. Legs come from keyed state, so a window is summed up from partial sums and no list
    of its readings is ever held. Readings dated over ``ahead`` in the future are left out: one would
    push the watermark past all others (``detect_stateful`` tells them as EARLY rows)."""
    prepare_state(readings.sparkSession)
    narrow = (readings.where(~_early(ahead))
              .select("id", "vehicle_id", "event_timestamp", F.unix_micros("event_timestamp").alias("at"),
                      "lat", "lng", "speed_kph", F.lit(False).alias("early"))
              .withWatermark("event_timestamp", lateness))
    legs = narrow.groupBy("vehicle_id").transformWithState(
        LegProcessor(V.micros_of(window)), LEGS, "Append", "EventTime", eventTimeColumnName="event_timestamp")
    leg_km = F.coalesce(F.expr(haversine_km("lat0", "lng0", "lat", "lng")), F.lit(0.0))
    return reports.window_figures(legs.withColumn("leg_km", leg_km), F.window("event_timestamp", window))


def run_stats(stats: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = writer_of(stats.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the range partitioning of the write reads it twice
        try:
            sinks.write_partitioned(batch, path, "window_start", batch_id, writer, unique=["vehicle_id"])
        finally:
            batch.unpersist()

    return _started(stats.writeStream.option("checkpointLocation", checkpoint)
                    .outputMode("append").foreachBatch(store), available_now)


def run_ageing(spark: SparkSession, status_path: str, checkpoint: str, every: str = "1 minute", available_now: bool = False) -> StreamingQuery:
    """Reclassifies the stored statuses at the time of every tick, so that vehicles without readings turn idle and offline."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def age(batch: DataFrame, batch_id: int) -> None:
        sinks.age_statuses(spark, status_path, F.current_timestamp())

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(age).trigger(**trigger).start()


def publish(rows: DataFrame, checkpoint: str, *, path: str | None = None, servers: str | None = None,
            topic: str = "vehicle-alerts", available_now: bool = False) -> StreamingQuery:
    """Sends rows as keyed JSON to a Kafka topic, or to files that Spark commits once."""
    keyed = gps.to_keyed_json(rows, rename=gps.EVENT_NAMES).writeStream.option("checkpointLocation", checkpoint)
    if servers is not None:
        sink = keyed.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    else:
        sink = keyed.format("json").option("path", path)
    return _started(sink, available_now)
