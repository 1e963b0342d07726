"""Deletes and retention, over frames and over stored tables (``fleetlark.sources.store``), whose manifest
tells which files a delete, retention or compaction must touch.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlark.functions.values import before, moment
from fleetlark.operators.lookups import alert_filter
from fleetlark.sources.store import SMALL_FILE_ROWS, Store

Instant = str | datetime | Column

# How long each kind of row is kept.
KEEP = {"readings": "24 hours", "alerts": "7 days", "dead_letters": "7 days"}


@dataclass(frozen=True)
class Deletion:
    """What a delete leaves and what it takes."""
    remaining: DataFrame
    deleted: DataFrame

    def deleted_count(self) -> int:
        return self.deleted.count()

    def counts(self) -> DataFrame:
        """One row: rows deleted."""
        return self.deleted.agg(F.count(F.lit(1)).alias("deleted_count"))


def delete_where(table: DataFrame, condition: Column) -> Deletion:
    """Splits a table by a condition; rows for which it is unknown remain."""
    hit = F.coalesce(condition, F.lit(False))
    return Deletion(table.where(~hit), table.where(hit))


def matching(vehicle: str | None = None, type: str | None = None, start: Instant | None = None,
             end: Instant | None = None, compat: bool = False) -> Column:
    """Condition of a filtered delete. All filters apply, as in listings; with ``compat`` a
    vehicle makes the type ineffective."""
    condition = alert_filter(vehicle, None if compat and vehicle else type)
    if start is not None:
        condition &= F.col("detected_at") >= moment(start)
    if end is not None:
        condition &= F.col("detected_at") <= moment(end)
    return condition


def delete_id(alerts: DataFrame, alert_id: int) -> Deletion:
    """Deletes one alert; ``counts`` is zero when there is none."""
    return delete_where(alerts, F.col("id") == alert_id)


def delete_ids(alerts: DataFrame, ids: DataFrame | list[int]) -> Deletion:
    """Deletes the alerts with the given ids: a short list, or a frame of any size with an
    ``id`` column."""
    if not isinstance(ids, DataFrame):
        return delete_where(alerts, F.col("id").isin(*ids))
    wanted = ids.select("id").distinct()
    return Deletion(alerts.join(wanted, "id", "left_anti"), alerts.join(wanted, "id", "left_semi"))


def delete_filtered(alerts: DataFrame, vehicle: str | None = None, type: str | None = None,
                    start: Instant | None = None, end: Instant | None = None, compat: bool = False) -> Deletion:
    """Deletes by any combination of vehicle, type and range. Without a filter nothing is
    deleted: emptying a table is ``delete_all``."""
    named = [vehicle, None if type == "all" else type]
    if not any(named) and start is None and end is None:
        raise ValueError("a filtered delete needs a filter")
    return delete_where(alerts, matching(vehicle, type.upper() if type and type != "all" else type, start, end, compat))


def delete_all(alerts: DataFrame, confirm: bool = False) -> Deletion:
    """Deletes everything; refused unless confirmed."""
    if not confirm:
        raise ValueError("set confirm=True to delete all alerts")
    return delete_where(alerts, F.lit(True))


def delete_newest(alerts: DataFrame, n: int) -> Deletion:
    """Deletes the newest alerts of a view."""
    newest = alerts.orderBy(F.desc("detected_at"), F.desc("id")).limit(n).select("id")
    return delete_ids(alerts, newest)


def delete_geofence(fences: DataFrame, fence_id: int) -> Deletion:
    return delete_where(fences, F.col("id") == fence_id)


def retain(table: DataFrame, time: str, as_of: Instant, keep: str) -> Deletion:
    """Deletes the rows older than the retention."""
    return delete_where(table, F.col(time) < before(as_of, keep))


def delete_from_table(spark: SparkSession, path: str, condition: Column, start: str | None = None, end: str | None = None,
                      vehicle: str | None = None) -> int:
    """Deletes rows of a stored table and returns how many; only files with such a row are written anew. Bounds on the
    table's time and vehicle spare files by the manifest."""
    return Store(spark, path).delete(condition, start, end, vehicle)


def delete_filtered_from_table(spark: SparkSession, path: str, vehicle: str | None = None, type: str | None = None,
                               start: str | None = None, end: str | None = None, compat: bool = False) -> int:
    """``delete_filtered`` on stored alerts."""
    kind = None if type == "all" else type
    if not any([vehicle, kind]) and start is None and end is None:
        raise ValueError("a filtered delete needs a filter")
    return delete_from_table(spark, path, matching(vehicle, kind and kind.upper(), start, end, compat), start, end, vehicle)


def truncate_table(spark: SparkSession, path: str, confirm: bool = False) -> int:
    """Empties a stored table and returns how many rows it had; refused unless confirmed."""
    if not confirm:
        raise ValueError("set confirm=True to delete all rows")
    return Store(spark, path).truncate()


def drop_before(spark: SparkSession, path: str, time: str, cutoff: str) -> int:
    """Retention of a stored table by its time: files that end before the cutoff go unread, those around it are
    rewritten. Returns the number of rows deleted."""
    store = Store(spark, path)
    if store.time() != time:
        raise ValueError(f"the table is kept by {store.time()}, not by {time}")
    return store.drop_before(cutoff)


def compact_table(spark: SparkSession, path: str, small_rows: int = SMALL_FILE_ROWS) -> int:
    """Merges small files, as a stream leaves them; returns how many went."""
    return Store(spark, path).compact(small_rows)


def vacuum_table(spark: SparkSession, path: str, older_than_ms: int = 86_400_000) -> int:
    """Removes files that no version of the last while needs."""
    return Store(spark, path).vacuum(older_than_ms)
