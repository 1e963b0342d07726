"""Stored tables of the engine: readings, alerts, dead letters, windowed figures, statuses.

Every write names its writer and batch (see ``fleetlark.sources.store``): a batch that is repeated after a failure, on another
day too, leaves one copy, and writers do not touch each other's rows. Event tables lie in files by date, sorted so that
file statistics serve vehicle lookups; the status table lies in hash buckets of vehicles, of which a write replaces those it touches.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlark import schemas as S
from fleetlark.functions import values as V
from fleetlark.operators import detect
from fleetlark.sources import gps
from fleetlark.sources.store import Store

# Hash buckets of the status table; fixed for a table's life.
STATUS_BUCKETS = 64
# Writer of a batch that names none.
BATCH_WRITER = "batch"


def write_partitioned(rows: DataFrame, path: str, time: str, batch_id: int, writer: str = BATCH_WRITER, key: str = "vehicle_id",
                      unique: list[str] | None = None, same_time: bool = True) -> int:
    """Stores the rows of a writer's batch by the date of ``time``; returns how many were new."""
    dated = rows.withColumn("event_date", F.to_date(time))
    return Store(rows.sparkSession, path).append(dated, time, key, writer, batch_id, unique, same_time)


def write_readings(readings: DataFrame, path: str, batch_id: int, writer: str = BATCH_WRITER) -> int:
    """Stores a batch of readings, filling the location point where position is known."""
    return write_partitioned(gps.located(readings), path, "event_timestamp", batch_id, writer, unique=["id", "vehicle_id"])


def write_alerts(alerts: DataFrame, path: str, batch_id: int, writer: str = BATCH_WRITER) -> int:
    """Stores a batch of alerts, with a location point; ``details`` that are not yet text become JSON."""
    return write_partitioned(gps.alert_records(alerts), path, "detected_at", batch_id, writer, unique=["id", "vehicle_id", "alert_type"])


def write_dead_letters(letters: DataFrame, path: str, batch_id: int, writer: str = BATCH_WRITER) -> int:
    """Stores a batch of dead letters by the day of their failure. A message is known by topic, partition and offset, as its
    time of failure is another one when it is read again."""
    header = lambda name: F.col("headers")[name]
    origin = F.concat_ws("/", header(gps.HEADER_TOPIC), header(gps.HEADER_PARTITION), header(gps.HEADER_OFFSET))
    whole = header(gps.HEADER_TOPIC).isNotNull() & header(gps.HEADER_PARTITION).isNotNull() & header(gps.HEADER_OFFSET).isNotNull()
    dated = letters.withColumns({"failed_at": F.timestamp_millis(header(gps.HEADER_FAILED_AT).cast("long")), "origin": F.when(whole, origin)})
    return write_partitioned(dated, path, "failed_at", batch_id, writer, key="key", unique=["origin"], same_time=False)


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, vehicle: str | None = None) -> DataFrame:
    """A stored table, with its layout columns ``commit`` and ``event_date``; bounds on its time and vehicle leave out files."""
    return Store(spark, path).read(start, end, vehicle)


def between_days(table: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows with start <= time <= end, reading only the partitions of those days."""
    days = F.col("event_date").between(F.to_date(V.moment(start)), F.to_date(V.moment(end)))
    return table.where(days & F.col(time).between(V.moment(start), V.moment(end)))


_STATUS_ROWS = T.StructType([*S.STATUS.fields, T.StructField("bucket", T.IntegerType())])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("vehicle_id"), F.lit(STATUS_BUCKETS)).cast("int")


def _statuses(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, part="bucket")


def upsert_status(batch: DataFrame, path: str, batch_id: int, writer: str = BATCH_WRITER) -> int:
    """Merges a batch of readings into the status table: the newest reading per vehicle wins. Only the buckets of the
    batch's vehicles are rewritten; returns their rows."""
    table = _statuses(batch.sparkSession, path)
    newest = detect.newest_readings(batch).withColumn("bucket", _bucket())
    return table.replace_parts(
        lambda known: detect.merge_status(known.select(*S.STATUS.names), newest).withColumn("bucket", _bucket()),
        lambda: [str(r["bucket"]) for r in newest.select("bucket").distinct().collect()],  # STATUS_BUCKETS at most
        _STATUS_ROWS, "last_seen", "vehicle_id", writer, batch_id)


def age_statuses(spark: SparkSession, path: str, as_of: str | datetime | Column, **thresholds: float) -> int:
    """Reclassifies the stored statuses at an instant, so that a vehicle without readings turns idle and offline. Only
    buckets with a changed status are rewritten; returns their rows."""
    table = _statuses(spark, path)
    if table.current().schema is None:
        return 0
    changed = lambda: detect.status_changes(read_status(spark, path), as_of, **thresholds).select(_bucket().alias("bucket")).distinct()
    return table.replace_parts(
        lambda known: detect.apply_changes(known.select(*S.STATUS.names), as_of, **thresholds).withColumn("bucket", _bucket()),
        lambda: [str(r["bucket"]) for r in changed().collect()], _STATUS_ROWS, "last_seen", "vehicle_id")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The current status table, empty before the first batch. What it reads stays whole while newer versions are written."""
    table = _statuses(spark, path)
    if table.current().schema is None:
        return spark.createDataFrame([], S.STATUS)
    return table.read().select(*S.STATUS.names)
