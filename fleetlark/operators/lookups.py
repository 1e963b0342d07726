"""Lookups over readings, alerts, statuses and vehicles: filters, orders, newest-first pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlark.functions.values import alert_group, before, moment

Instant = str | datetime | Column

# Preset ranges of the history view.
PRESETS = {"1h": "1 hour", "6h": "6 hours", "24h": "1 day", "7d": "7 days", "30d": "30 days"}


def preset_range(preset: str, as_of: Instant) -> tuple[Column, Column]:
    """Start and end of a preset range ending at ``as_of``, both cut to the minute."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset!r}")
    return F.date_trunc("minute", before(as_of, PRESETS[preset])), F.date_trunc("minute", moment(as_of))


def in_range(df: DataFrame, time: str, start: Instant | None = None, end: Instant | None = None,
             preset: str | None = None, as_of: Instant | None = None) -> DataFrame:
    """Rows with start <= time <= end; either end may be open, a preset sets both."""
    if preset is not None:
        if as_of is None:
            raise ValueError("a preset range needs as_of")
        start, end = preset_range(preset, as_of)
    if start is not None:
        df = df.where(F.col(time) >= moment(start))
    if end is not None:
        df = df.where(F.col(time) <= moment(end))
    return df


def latest_readings(readings: DataFrame, vehicle: str | None = None) -> DataFrame:
    """The newest reading of each vehicle, or of one; ties go to the greater id."""
    if vehicle is not None:
        return (readings.where(F.col("vehicle_id") == vehicle)
                .orderBy(F.desc("event_timestamp"), F.desc("id")).limit(1))
    rest = [c for c in readings.columns if c != "vehicle_id"]
    newest = readings.groupBy("vehicle_id").agg(
        F.max_by(F.struct(*rest), F.struct("event_timestamp", "id")).alias("r"))
    return newest.select("vehicle_id", "r.*").select(*readings.columns)


def vehicle_history(readings: DataFrame, vehicle: str, limit: int = 50) -> DataFrame:
    """The newest readings of a vehicle."""
    return (readings.where(F.col("vehicle_id") == vehicle)
            .orderBy(F.desc("event_timestamp"), F.desc("id")).limit(limit))


def readings_between(readings: DataFrame, start: Instant | None = None, end: Instant | None = None,
                     vehicle: str | None = None, *, preset: str | None = None,
                     as_of: Instant | None = None) -> DataFrame:
    """Readings in a range, both ends included, newest first."""
    rows = in_range(readings, "event_timestamp", start, end, preset, as_of)
    if vehicle is not None:
        rows = rows.where(F.col("vehicle_id") == vehicle)
    return rows.orderBy(F.desc("event_timestamp"), F.desc("id"))


def speeding_readings(readings: DataFrame, threshold: float, since: Instant) -> DataFrame:
    """Readings above a speed since an instant, oldest first."""
    return (readings.where((F.col("speed_kph") > threshold) & (F.col("event_timestamp") >= moment(since)))
            .orderBy("event_timestamp", "id"))


def silent_vehicles(readings: DataFrame, since: Instant) -> DataFrame:
    """Vehicles whose newest reading is older than an instant."""
    return (readings.groupBy("vehicle_id").agg(F.max("event_timestamp").alias("last_seen"))
            .where(F.col("last_seen") < moment(since)))


def missing_location(readings: DataFrame) -> DataFrame:
    return readings.where(F.col("location").isNull())


def alert_filter(vehicle: str | None = None, type: str | None = None, group: str | None = None) -> Column:
    """Condition on alerts; an absent or empty argument, or the type 'all', admits any."""
    condition = F.lit(True)
    if vehicle:
        condition &= F.col("vehicle_id") == vehicle
    if type and type != "all":
        condition &= F.col("alert_type") == type
    if group and group != "all":
        condition &= alert_group(F.col("alert_type")) == group
    return condition


def alerts(table: DataFrame, vehicle: str | None = None, type: str | None = None, group: str | None = None,
           since: Instant | None = None, start: Instant | None = None, end: Instant | None = None, *,
           preset: str | None = None, as_of: Instant | None = None) -> DataFrame:
    """Alerts by vehicle, type, feed group and time, newest first."""
    rows = in_range(table, "detected_at", since if since is not None else start, end, preset, as_of)
    return (rows.where(alert_filter(vehicle, type, group))
            .orderBy(F.desc("detected_at"), F.desc("id")))


def recent_alerts(table: DataFrame, n: int = 20) -> DataFrame:
    return feed_tail(table, n, "detected_at")


def feed_tail(df: DataFrame, n: int = 1000, time: str = "event_timestamp") -> DataFrame:
    """The newest rows of a feed: what a client sees when it connects."""
    return df.orderBy(F.desc(time), F.desc("id")).limit(n)


def statuses(table: DataFrame, vehicle: str | None = None, status: str | None = None) -> DataFrame:
    """Vehicle statuses, last seen first."""
    if vehicle is not None:
        table = table.where(F.col("vehicle_id") == vehicle)
    if status is not None:
        table = table.where(F.col("status") == status)
    return table.orderBy(F.desc("last_seen"), "vehicle_id")


def search_vehicles(vehicles: DataFrame, text: str = "", region: str = "all") -> DataFrame:
    """Vehicles whose id contains a text, ignoring case, in a region or in all."""
    found = vehicles.where(F.lower("vehicle_id").contains(text.lower()))
    return found if region == "all" else found.where(F.col("region") == region)
