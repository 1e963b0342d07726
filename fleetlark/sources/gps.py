"""GPS messages: parsing, validation, dead letters, keyed output, table upkeep."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlark import schemas as S
from fleetlark.functions.values import alert_type, moment

# Error classes and header names of the dead-letter stream.
INVALID_PAYLOAD, PROCESSING_ERROR = "InvalidPayload", "ProcessingError"
HEADER_TOPIC = "dlq-original-topic"
HEADER_PARTITION = "dlq-original-partition"
HEADER_OFFSET = "dlq-original-offset"
HEADER_TYPE = "dlq-error-type"
HEADER_MESSAGE = "dlq-error-message"
HEADER_FAILED_AT = "dlq-failed-at"
HEADER_LENGTH = "dlq-original-payload-length"
DEAD_LETTER_TOPIC = "vehicle-gps-dlq"

_PARSED = T.StructType(S.GPS_EVENT.fields + [T.StructField("_malformed", T.StringType())])
_PARSED_ALERT = T.StructType(S.ALERT_EVENT.fields + [T.StructField("_malformed", T.StringType())])


def _parse(messages: DataFrame, value_col: str, names: list[str], kind: T.StructType) -> DataFrame:
    document = F.from_json(F.col(value_col).cast("string"), kind,
                           {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    # A generator keeps the text from being parsed again for every field and filter.
    parsed = messages.select("*", F.explode(F.array(document)).alias("_document"))
    bad = F.col("_document").isNull() | F.col("_document._malformed").isNotNull()
    fields = [F.when(~bad, F.col(f"_document.{name}")).alias(name) for name in names]
    return parsed.select(*messages.columns, bad.alias("malformed"), *fields)


def parse_gps(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds one typed column per GPS field and ``malformed``; a text that is not a JSON
    object of the expected types leaves every field null. Works on streams too."""
    return _parse(messages, value_col, S.GPS_EVENT.names, _PARSED)


def parse_alerts(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """The same of alert messages; ``details`` is JSON text, whether it was sent as text or as an object."""
    return _parse(messages, value_col, S.ALERT_EVENT.names, _PARSED_ALERT)


def _route(parsed: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    kind = message = F.lit(None).cast("string")
    for condition, error, text in reversed(rules):
        kind = F.when(condition, error).otherwise(kind)
        message = F.when(condition, text).otherwise(message)
    return parsed.withColumns({"error_type": kind, "error_message": message})


def _common_rules(missing: Column, names: str) -> list[tuple[Column, str, str]]:
    return [
        (F.col("malformed"), PROCESSING_ERROR, "Malformed JSON"),
        (missing, INVALID_PAYLOAD, f"Missing required fields: {names}"),
        (F.col("timestamp").isNull(), PROCESSING_ERROR, "Missing timestamp"),
        (F.length("vehicleId") > S.VEHICLE_ID_LENGTH, PROCESSING_ERROR,
         f"vehicleId longer than {S.VEHICLE_ID_LENGTH} characters"),
    ]


def route_alerts(parsed: DataFrame) -> DataFrame:
    """Adds ``error_type`` and ``error_message`` to alert messages, both null for a valid one."""
    missing = F.col("vehicleId").isNull() | F.col("alertType").isNull()
    return _route(parsed, _common_rules(missing, "vehicleId or alertType"))


def to_alerts(routed: DataFrame) -> DataFrame:
    """Valid alert messages as rows of the alert table. A message without id takes partition and offset, as readings do."""
    return routed.where(F.col("error_type").isNull()).select(
        F.coalesce("id", _place()).alias("id"), F.col("vehicleId").alias("vehicle_id"), F.col("alertType").alias("alert_type"),
        "details", F.col("timestamp").alias("detected_at"), "lat", "lng")


def route_events(parsed: DataFrame) -> DataFrame:
    """Adds ``error_type`` and ``error_message``, both null for a valid event."""
    missing = F.col("vehicleId").isNull() | F.col("lat").isNull() | F.col("lng").isNull()
    return _route(parsed, _common_rules(missing, "vehicleId, lat, or lng"))


def _place() -> Column:
    return F.shiftleft(F.col("partition").cast("long"), 48) + F.col("offset")


def to_readings(routed: DataFrame, id_col: Column | None = None) -> DataFrame:
    """Valid events as readings with their location point. The id defaults to partition and
    offset in one number: unique within a topic, and the same in a replay."""
    key = id_col if id_col is not None else _place()
    return routed.where(F.col("error_type").isNull()).select(
        key.alias("id"), F.col("vehicleId").alias("vehicle_id"), "lat", "lng",
        F.struct("lng", "lat").alias("location"), F.col("speedKph").alias("speed_kph"), "heading",
        F.col("timestamp").alias("event_timestamp"), F.col("timestamp").alias("created_at"))


def to_dlq(routed: DataFrame, failed_at: str | datetime | Column) -> DataFrame:
    """Dead-letter records (key, payload, headers) of the events that were refused."""
    headers = {
        HEADER_TOPIC: F.col("topic"),
        HEADER_PARTITION: F.col("partition").cast("string"),
        HEADER_OFFSET: F.col("offset").cast("string"),
        HEADER_TYPE: F.col("error_type"),
        HEADER_MESSAGE: F.col("error_message"),
        HEADER_FAILED_AT: F.unix_millis(moment(failed_at)).cast("string"),
        HEADER_LENGTH: F.length("value").cast("string"),
    }
    pairs = [column for name, value in headers.items() for column in (F.lit(name), value)]
    return routed.where(F.col("error_type").isNotNull()).select(
        "key", F.col("value").alias("payload"), F.create_map(*pairs).alias("headers"))


def dlq_headers(letters: DataFrame) -> DataFrame:
    """Dead letters with each header in a typed column."""
    header = lambda name: F.col("headers")[name]
    return letters.select(
        "key", "payload", header(HEADER_TOPIC).alias("original_topic"),
        header(HEADER_PARTITION).cast("int").alias("original_partition"),
        header(HEADER_OFFSET).cast("long").alias("original_offset"),
        header(HEADER_TYPE).alias("error_type"), header(HEADER_MESSAGE).alias("error_message"),
        F.timestamp_millis(header(HEADER_FAILED_AT).cast("long")).alias("failed_at"),
        header(HEADER_LENGTH).cast("long").alias("payload_length"))


def dlq_report(letters: DataFrame) -> DataFrame:
    """Failures by topic, error type and message."""
    return (dlq_headers(letters).groupBy("original_topic", "error_type", "error_message")
            .agg(F.count(F.lit(1)).alias("failures"), F.sum("payload_length").alias("payload_chars"),
                 F.max("original_offset").alias("last_offset")))


def latest_stats(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Newest statistics message per vehicle: what a compacted topic keeps. Unparsable
    texts are skipped; the newest message is the one with the greatest (offset, partition)."""
    stats = messages.select(F.from_json(value_col, S.VEHICLE_STATS).alias("s"),
                            F.struct("offset", "partition").alias("position")).where("s.vehicleId is not null")
    newest = stats.groupBy(F.col("s.vehicleId").alias("vehicle_id")).agg(F.max_by("s", "position").alias("s"))
    return newest.select("vehicle_id", *[
        F.col(f"s.{name}").alias(alias) for name, alias in
        (("avgSpeed", "avg_speed"), ("maxSpeed", "max_speed"), ("totalDistance", "total_distance"),
         ("readingCount", "reading_count"), ("windowStart", "window_start"), ("windowEnd", "window_end"))])


def to_keyed_json(frame: DataFrame, key_col: str = "vehicle_id", rename: dict[str, str] | None = None) -> DataFrame:
    """Key and JSON value per row, ready for a keyed message sink."""
    names = rename or {}
    body = [F.col(c).alias(names.get(c, c)) for c in frame.columns]
    return frame.select(F.col(key_col).alias("key"),
                        F.to_json(F.struct(*body), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))


# Message field names of a reading or alert row.
EVENT_NAMES = {"vehicle_id": "vehicleId", "speed_kph": "speedKph", "event_timestamp": "timestamp",
               "alert_type": "alertType", "detected_at": "timestamp"}


_POINT = "CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN named_struct('lng', lng, 'lat', lat) END"


def located(readings: DataFrame) -> DataFrame:
    """Readings as they are stored: with the location point wherever position is known."""
    return readings.withColumn("location", F.coalesce("location", F.expr(_POINT)) if "location" in readings.columns else F.expr(_POINT))


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts as they are stored: with a location point, and details as JSON text."""
    if dict(alerts.dtypes)["details"] != "string":
        alerts = alerts.withColumn("details", F.to_json("details"))
    return alerts.withColumn("location", F.expr(_POINT))


def backfill_location(readings: DataFrame) -> DataFrame:
    """Fills the missing location points; ``location_filled`` marks the rows that changed."""
    fill = F.col("location").isNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return readings.withColumns({
        "location": F.when(fill, F.struct("lng", "lat")).otherwise(F.col("location")),
        "location_filled": fill})


def normalize_alerts(alerts: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    """Alerts with their defaults: type SPEEDING, position 0.0, time ``as_of``."""
    return alerts.withColumns({
        "alert_type": alert_type(F.col("alert_type")),
        "lat": F.coalesce("lat", F.lit(0.0)), "lng": F.coalesce("lng", F.lit(0.0)),
        "detected_at": F.coalesce("detected_at", moment(as_of))})
