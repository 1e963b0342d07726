"""Counts, reports and statistics."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlark.functions import values as V
from fleetlark.functions.geo import haversine_km
from fleetlark.operators import ordered
from fleetlark.operators.lookups import alert_filter, in_range

Instant = str | datetime | Column


def count_by_type(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def count_by_vehicle(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("alerts"))


def top_offenders(alerts: DataFrame, n: int = 5) -> DataFrame:
    """The vehicles with most alerts; ties by vehicle id."""
    return count_by_vehicle(alerts).orderBy(F.desc("alerts"), "vehicle_id").limit(n)


def _matching(alerts: DataFrame, start: Instant, end: Instant, type: str | None, vehicle: str | None) -> DataFrame:
    return in_range(alerts, "detected_at", start, end).where(alert_filter(vehicle, type))


def alert_history_page(alerts: DataFrame, start: Instant, end: Instant, type: str | None = None,
                       vehicle: str | None = None, limit: int = 100) -> DataFrame:
    """The newest alerts of a range, at most one page."""
    return (_matching(alerts, start, end, type, vehicle)
            .orderBy(F.desc("detected_at"), F.desc("id")).limit(limit))


def alert_history_totals(alerts: DataFrame, start: Instant, end: Instant, type: str | None = None,
                         vehicle: str | None = None, limit: int = 100) -> DataFrame:
    """Counts behind the page as rows (scope, name, alerts): the total before the page
    limit, the number on the page, and one row per type and per vehicle."""
    counts = _scoped_counts(_matching(alerts, start, end, type, vehicle))
    return counts.selectExpr(f"""inline(CASE WHEN scope = 'total' THEN array(struct(scope, name, alerts),
        struct('returned' AS scope, name, least(alerts, {int(limit)}) AS alerts))
        ELSE array(struct(scope, name, alerts)) END)""")


def _scoped_counts(matching: DataFrame) -> DataFrame:
    """Total, per type and per vehicle in one pass: partial counts by (type, vehicle) shrink
    the data before they are grouped three ways. The total is there for no rows as well."""
    partial = matching.groupBy("alert_type", "vehicle_id").agg(F.count(F.lit(1)).alias("_n"))
    named = partial.selectExpr(
        """inline(array(struct('total' AS scope, 'all' AS name), struct('type' AS scope, alert_type AS name),
        struct('vehicle' AS scope, vehicle_id AS name)))""", "_n")
    nothing = matching.sparkSession.range(1).selectExpr("'total' AS scope", "'all' AS name", "0L AS _n")
    return named.unionByName(nothing).groupBy("scope", "name").agg(F.sum("_n").alias("alerts"))


def alert_summary(alerts: DataFrame, start: Instant, end: Instant, n: int = 5) -> DataFrame:
    """Rows (scope, name, alerts): total, per type, per vehicle, and the top offenders."""
    matching = in_range(alerts, "detected_at", start, end)
    top = top_offenders(matching, n).select(F.lit("top").alias("scope"), F.col("vehicle_id").alias("name"), "alerts")
    return _scoped_counts(matching).unionByName(top)


def reading_report(readings: DataFrame, vehicle: str, start: Instant, end: Instant, limit: int = 500) -> DataFrame:
    """One row: average and maximum speed of a vehicle in a range, zero when there is none,
    with the number of readings before and after the page limit."""
    rows = in_range(readings, "event_timestamp", start, end).where(F.col("vehicle_id") == vehicle)
    speed = lambda agg: V.round2(F.coalesce(agg("speed_kph"), F.lit(0.0)))
    return rows.agg(
        F.lit(vehicle).alias("vehicle_id"), speed(F.avg).alias("average_speed"), speed(F.max).alias("max_speed"),
        F.count(F.lit(1)).alias("total_count"),
        F.least(F.count(F.lit(1)), F.lit(limit).cast("long")).alias("returned_count"))


def reading_report_page(readings: DataFrame, vehicle: str, start: Instant, end: Instant, limit: int = 500) -> DataFrame:
    """The newest readings behind a reading report, at most one page."""
    return (in_range(readings, "event_timestamp", start, end).where(F.col("vehicle_id") == vehicle)
            .orderBy(F.desc("event_timestamp"), F.desc("id")).limit(limit))


def fleet_stats(status: DataFrame, alerts: DataFrame, as_of: Instant) -> DataFrame:
    """One row of fleet figures: vehicles, those seen within the last minute, mean last
    speed, and alerts of the last hour."""
    now = V.moment(as_of)
    online = F.coalesce((F.col("last_seen") > V.before(now, "1 minute")).cast("long"), F.lit(0))
    fleet = status.agg(F.count(F.lit(1)).alias("vehicles"), F.sum(online).alias("online"),
                       F.sum("last_speed").alias("speed"), F.count("last_speed").alias("speeds"),
                       F.lit(0).cast("long").alias("recent"))
    recent = count_alerts_since(alerts, V.before(now, "1 hour")).select(
        *[F.lit(0).cast(t).alias(n) for n, t in (("vehicles", "long"), ("online", "long"), ("speed", "double"), ("speeds", "long"))],
        F.col("alerts").alias("recent"))
    both = fleet.unionByName(recent)
    return both.agg(
        F.sum("vehicles").alias("total_vehicles"), F.coalesce(F.sum("online"), F.lit(0)).alias("online_vehicles"),
        V.round2(F.coalesce(F.try_divide(F.sum("speed"), F.sum("speeds")), F.lit(0.0))).alias("average_speed"),
        F.sum("recent").alias("alerts_last_hour"))


def count_alerts_since(alerts: DataFrame, since: Instant) -> DataFrame:
    return alerts.where(F.col("detected_at") >= V.moment(since)).agg(F.count(F.lit(1)).alias("alerts"))


def dashboard_stats(status: DataFrame, alerts: DataFrame, as_of: Instant) -> DataFrame:
    """One row of dashboard figures: vehicles online, idle and offline by the dashboard
    rule, alerts strictly within the last hour, and the mean speed as a whole number."""
    now = V.moment(as_of)
    state = V.vehicle_status(F.col("last_seen"), F.col("last_speed"), now, "dashboard")
    count = lambda name: F.count_if(state == name)
    zero = F.lit(0).cast("long")
    fleet = status.agg(
        count("ONLINE").alias("online"), count("IDLE").alias("idle"), count("OFFLINE").alias("offline"),
        F.coalesce(F.sum("last_speed"), F.lit(0.0)).alias("speed"), F.count(F.lit(1)).alias("vehicles"), zero.alias("recent"))
    recent = (alerts.where(F.col("detected_at") > V.before(now, "1 hour"))
              .agg(zero.alias("online"), zero.alias("idle"), zero.alias("offline"), F.lit(0.0).alias("speed"),
                   zero.alias("vehicles"), F.count(F.lit(1)).alias("recent")))
    mean = F.coalesce(F.floor(F.try_divide(F.sum("speed"), F.sum("vehicles")) + 0.5), F.lit(0))
    return fleet.unionByName(recent).agg(
        F.sum("online").alias("online_count"), F.sum("idle").alias("idle_count"), F.sum("offline").alias("offline_count"),
        F.sum("recent").alias("alerts_last_hour"), mean.cast("long").alias("average_speed"))


_LEG_KM = haversine_km("_prev.lat", "_prev.lng", "lat", "lng")


def _narrow(readings: DataFrame) -> DataFrame:
    return readings.selectExpr("id", "vehicle_id", "event_timestamp", "lat", "lng", "coalesce(speed_kph, 0D) AS speed")


def with_legs(readings: DataFrame, large_rows: int | None = None) -> ordered.History:
    """Readings with ``speed`` (zero when unknown) and ``leg_km`` from the previous point;
    zero at the first one."""
    slices = ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    rows = ordered.history(_narrow(readings), slices).with_previous("_prev", F.struct("event_timestamp", "lat", "lng"))
    return rows.via(rows.df.withColumn("leg_km", F.expr(f"coalesce({_LEG_KM}, 0D)")).drop("_prev"))


def legs_within(readings: DataFrame, window: str, large_rows: int | None = None) -> DataFrame:
    """Readings with ``speed`` and ``leg_km``, zero at the first point of each tumbling window. Legs
    do not cross windows, so a key is a vehicle's window: the aggregate by it needs no further
    shuffle. Windows in which one vehicle has very many rows are cut into time slices."""
    rows = _narrow(readings).withColumn("window", F.window("event_timestamp", window))
    large = ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    if large.frame is not None:  # only a large vehicle can have a large window
        rows = rows.withColumn("_window", F.unix_micros("window.start"))
        theirs = rows.join(F.broadcast(large.frame.select("vehicle_id")), "vehicle_id", "left_semi")
        large = ordered.find_slices(theirs, replace(large.order, keys=("_window", "vehicle_id")))
    if large.frame is not None:
        rows = ordered.history(rows, large).with_previous("_prev", F.struct("lat", "lng")).rows()
    else:
        in_window = Window.partitionBy("window", "vehicle_id").orderBy("event_timestamp", "id")
        rows = rows.withColumn("_prev", F.lag(F.struct("lat", "lng")).over(in_window))
    return rows.withColumn("leg_km", F.expr(f"coalesce({_LEG_KM}, 0D)")).drop("_prev", "_window")


def window_figures(legs: DataFrame, window: Column) -> DataFrame:
    """Speed, distance and count per vehicle and window of readings with legs."""
    return (legs.groupBy(window.alias("window"), "vehicle_id")
            .agg(F.avg("speed").alias("avg_speed"), F.greatest(F.max("speed"), F.lit(0.0)).alias("max_speed"),
                 F.sum("leg_km").alias("total_distance"), F.count(F.lit(1)).alias("reading_count"))
            .select("vehicle_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "avg_speed", "max_speed", "total_distance", "reading_count"))


def vehicle_stats(readings: DataFrame, window: str = "5 minutes", large_rows: int | None = None) -> DataFrame:
    """Average and maximum speed, distance and count per vehicle and tumbling window."""
    return window_figures(legs_within(readings, window, large_rows), F.col("window"))


def running_stats(readings: DataFrame, large_rows: int | None = None) -> DataFrame:
    """The same figures at each reading, over the vehicle's history up to it."""
    rows = with_legs(readings, large_rows=large_rows).with_running(
        sums={"_total": F.col("speed"), "total_distance": F.col("leg_km"), "reading_count": F.lit(1).cast("long")},
        maxima={"max_speed": F.greatest("speed", F.lit(0.0))}).rows()
    return rows.select("id", "vehicle_id", "event_timestamp", (F.col("_total") / F.col("reading_count")).alias("avg_speed"),
                       "max_speed", "total_distance", "reading_count")


def count_by_group(alerts: DataFrame) -> DataFrame:
    """One row: alerts per feed group."""
    group = V.alert_group(F.col("alert_type"))
    return alerts.agg(*[F.count_if(group == name).alias(name.lower()) for name in ("SPEEDING", "GEOFENCE", "IDLE")])
