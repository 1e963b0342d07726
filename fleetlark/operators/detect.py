"""Alert detection and vehicle status over whole histories."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.functions import values as V
from fleetlark.operators import ordered
from fleetlark.operators.zones import chosen_zone, fence_index, with_zones

Instant = str | datetime | Column
Span = str | timedelta | int

_ALERT_KEY = ["id", "vehicle_id"]


def speeding_alerts(readings: DataFrame, threshold: float = S.SPEED_LIMIT_KPH) -> DataFrame:
    """One alert per reading above the limit. Stateless, so it serves streams as it is."""
    return (readings.where(F.col("speed_kph") > threshold)
            .select(*_ALERT_KEY, F.lit(S.SPEEDING).alias("alert_type"),
                    F.col("event_timestamp").alias("detected_at"), "lat", "lng",
                    F.col("speed_kph"), F.lit(float(threshold)).alias("threshold"),
                    (F.col("speed_kph") - threshold).alias("excess")))


def idle_alerts(readings: DataFrame, threshold: Span = S.IDLE_THRESHOLD, idle_speed: float = S.IDLE_SPEED_KPH,
                minutes: str = "threshold", large_rows: int | None = None,
                slices: ordered.Slices | None = None) -> DataFrame:
    """One alert per idle spell: at its first reading that lies at least ``threshold`` after
    the spell began. A faster reading ends the spell; readings without speed are ignored.

    ``idle_minutes`` is the threshold, or with ``minutes="elapsed"`` the whole minutes idle.
    """
    if minutes not in ("threshold", "elapsed"):
        raise ValueError(f"unknown idle minutes: {minutes!r}")
    slices = slices or ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    rows = ordered.history(readings.where(F.col("speed_kph").isNotNull()), slices)
    due = _with_idle(rows, threshold, idle_speed, gaps=False).rows().where("_due")
    counted = "_idle_us div 60000000" if minutes == "elapsed" else str(V.micros_of(threshold) // 60_000_000)
    return (due.select(*_ALERT_KEY, F.lit(S.IDLE).alias("alert_type"),
                       F.col("event_timestamp").alias("detected_at"), "lat", "lng",
                       F.expr("timestamp_micros(_at - _idle_us)").alias("first_idle_at"), F.col("speed_kph"),
                       F.expr(f"CAST({counted} AS bigint)").alias("idle_minutes")))


def _with_idle(rows: ordered.History, threshold: Span, idle_speed: float, gaps: bool = True) -> ordered.History:
    """Adds ``_idle_us``, how long the idle spell of a reading has lasted, and ``_due``, true
    at the one reading of a spell that raises the alert. With ``gaps`` there may be readings
    without speed, which are passed over."""
    limit = V.micros_of(threshold)
    marked = rows.via(rows.df.withColumns({"_at": F.unix_micros("event_timestamp"),
                                           "_idle": F.col("speed_kph") <= idle_speed}))
    marked = marked.with_previous("_last", F.struct(F.col("_idle").alias("idle"), F.col("_at").alias("at")),
                                  where=F.col("_idle").isNotNull() if gaps else None)
    begins = "(_idle AND NOT coalesce(_last.idle, false))"
    spells = marked.with_previous("_spell", F.struct(F.col("_at").alias("start")), where=F.expr(begins))
    lasted = spells.df.withColumn("_idle_us", F.expr(f"CASE WHEN {begins} THEN 0L WHEN _idle THEN _at - _spell.start END"))
    first = f"({begins} OR _last.at - _spell.start < {limit})"
    return spells.via(lasted.withColumn("_due", F.expr(f"coalesce(_idle_us >= {limit} AND {first}, false)"))
                      .drop("_idle", "_last", "_spell"))


def zone_steps(readings: DataFrame, fences: DataFrame, buffer_m: float = S.ZONE_BUFFER_M, priority: str = "area",
               large_rows: int | None = None, slices: ordered.Slices | None = None) -> DataFrame:
    """Readings with position, with the vehicle's zone before (``prev_zone``) and at
    (``zone``) each of them, and the ``overlapping_zones`` where there is more than one."""
    slices = slices or ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    placed = readings.where("lat IS NOT NULL AND lng IS NOT NULL")
    return _with_zone(ordered.history(placed, slices), fences, buffer_m, priority).rows()


def _with_zone(rows: ordered.History, fences: DataFrame, buffer_m: float, priority: str) -> ordered.History:
    """Adds ``prev_zone``, ``zone`` and ``overlapping_zones``. A reading without position
    keeps the zone.

    Outside all fences a vehicle keeps its zone while it stays within the buffer of it.
    Whether that holds is remembered as a mark: the zone entered, or an empty struct once
    the vehicle has left; the nearest mark before a reading tells its state.
    """
    index = fence_index(fences, buffer_m)
    if index.joins_without_shuffle:
        # Zones are looked up after the shuffle the windows need anyway: it then moves bare
        # positions, and the geometry runs in evenly filled tasks.
        rows = rows.shuffled()
    rows = rows.via(with_zones(rows.df, fences, buffer_m, index=index).withColumn("_raw", chosen_zone(priority)))
    raw = F.struct(F.col("_raw").alias("zone"))
    rows = rows.with_previous("_last_raw", raw, where=F.expr("_raw IS NOT NULL"))
    left = ("(lat IS NOT NULL AND lng IS NOT NULL AND _raw IS NULL"
            " AND NOT coalesce(array_contains(near, _last_raw.zone), false))")
    rows = rows.with_previous("_mark", raw, where=F.expr(f"_raw IS NOT NULL OR {left}"))
    return rows.via(rows.df.withColumns({
        "prev_zone": F.col("_mark.zone"),
        "zone": F.expr(f"CASE WHEN _raw IS NOT NULL THEN _raw WHEN NOT {left} THEN _mark.zone END"),
        "overlapping_zones": F.expr("CASE WHEN size(zones) > 1 THEN sort_array(transform(zones, z -> z.name)) END"),
    }).drop("_raw", "_last_raw", "_mark", "zones", "near"))


_ENTERS = "(zone IS NOT NULL AND NOT zone <=> prev_zone)"
_EXITS = "(zone IS NULL AND prev_zone IS NOT NULL)"


def _zone_alert_columns() -> dict[str, Column]:
    """What a step that enters or leaves a zone tells."""
    return {"alert_type": F.expr(f"IF({_ENTERS}, '{S.GEOFENCE_ENTER}', '{S.GEOFENCE_EXIT}')"),
            "zone": F.expr("coalesce(zone, prev_zone)"),
            "action": F.expr(f"IF({_ENTERS}, 'entered', 'exited')"),
            "overlapping_zones": F.col("overlapping_zones"),
            "zone_count": F.expr("CASE WHEN overlapping_zones IS NOT NULL THEN size(overlapping_zones) END")}


def geofence_alerts(readings: DataFrame, fences: DataFrame, buffer_m: float = S.ZONE_BUFFER_M,
                    priority: str = "area", large_rows: int | None = None) -> DataFrame:
    """Alerts on entering and leaving zones. Going straight from one zone into another is
    an entry only."""
    steps = zone_steps(readings.select(*_ALERT_KEY, "lat", "lng", "event_timestamp"),
                       fences, buffer_m, priority, large_rows)
    told = _zone_alert_columns()
    return (steps.where(f"{_ENTERS} OR {_EXITS}")
            .select(*_ALERT_KEY, told.pop("alert_type").alias("alert_type"),
                    F.col("event_timestamp").alias("detected_at"), "lat", "lng",
                    *[column.alias(name) for name, column in told.items()]))


def speeding_details() -> Column:
    """JSON details of a speeding alert, from the columns of ``speeding_alerts``."""
    return F.expr("to_json(named_struct('speedKph', speed_kph, 'threshold', threshold, 'excess', excess))")


def idle_details() -> Column:
    return F.expr("""to_json(named_struct('idleMinutes', idle_minutes,
        'firstIdleTime', date_format(first_idle_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), 'currentSpeed', speed_kph,
        'location', format_string('%f,%f', lat, lng), 'durationMinutes', idle_minutes,
        'reason', format_string('Vehicle has been stationary for %d minutes', idle_minutes)))""")


def zone_details() -> Column:
    return F.expr("to_json(named_struct('geofence', zone, 'zone', zone, 'lat', lat, 'lng', lng, 'action', action, "
                  "'overlapping_zones', overlapping_zones, 'zone_count', zone_count))")


def alert_rows(found: DataFrame, details: Column) -> DataFrame:
    """Detected alerts as rows of the alert table."""
    return found.select(*_ALERT_KEY, "alert_type", details.alias("details"), "detected_at", "lat", "lng")


def detect_alerts(readings: DataFrame, fences: DataFrame, *, speed_limit: float = S.SPEED_LIMIT_KPH,
                  idle_threshold: Span = S.IDLE_THRESHOLD, idle_speed: float = S.IDLE_SPEED_KPH,
                  buffer_m: float = S.ZONE_BUFFER_M, priority: str = "area",
                  large_rows: int | None = None) -> DataFrame:
    """All alerts of a history as rows of the alert table; ``id`` is the reading's.

    One pass: the history is read and shuffled once, and a reading gives up to three alerts.
    """
    narrow = readings.select(*_ALERT_KEY, "event_timestamp", "lat", "lng", "speed_kph")
    slices = ordered.find_slices(readings, ordered.by_vehicle(large_rows))
    rows = _with_zone(ordered.history(narrow, slices), fences, buffer_m, priority)
    rows = _with_idle(rows, idle_threshold, idle_speed).rows()
    limit = f"{float(speed_limit)!r}D"
    interesting = rows.where(f"speed_kph > {limit} OR _due OR {_ENTERS} OR {_EXITS}")
    told = _zone_alert_columns()
    zone_type = told.pop("alert_type")
    named = (interesting
             .withColumns({"_speeds": F.expr(f"speed_kph > {limit}"), "_moves": F.expr(f"{_ENTERS} OR {_EXITS}"),
                           "_zone_type": zone_type, **told})
             .withColumns({"threshold": F.expr(limit), "excess": F.expr(f"speed_kph - {limit}"),
                           "first_idle_at": F.expr("timestamp_micros(_at - _idle_us)"),
                           "idle_minutes": F.expr(f"{V.micros_of(idle_threshold) // 60_000_000}L")}))
    alert = lambda when, kind, details: F.when(F.expr(when), F.struct(kind.alias("alert_type"), details.alias("details")))
    found = F.filter(F.array(
        alert("_speeds", F.lit(S.SPEEDING), speeding_details()), alert("_due", F.lit(S.IDLE), idle_details()),
        alert("_moves", F.col("_zone_type"), zone_details())), lambda a: a.isNotNull())
    return (named.select(*_ALERT_KEY, F.col("event_timestamp").alias("detected_at"), "lat", "lng", F.inline(found))
            .select(*_ALERT_KEY, "alert_type", "details", "detected_at", "lat", "lng"))


def classify(status: DataFrame, as_of: Instant, rule: str = "service", *, idle_minutes: float = 10,
             offline_minutes: float = 30) -> DataFrame:
    """Statuses recomputed by a rule. The backfill rule only fills the empty ones."""
    fresh = V.vehicle_status(F.col("last_seen"), F.col("last_speed"), V.moment(as_of), rule,
                             idle_minutes=idle_minutes, offline_minutes=offline_minutes)
    current = F.coalesce("status", fresh) if rule == "backfill" else fresh
    return status.withColumn("status", current)


def status_changes(status: DataFrame, as_of: Instant, **thresholds: float) -> DataFrame:
    """Vehicles whose stored status no longer holds, with the old and the new one."""
    fresh = V.vehicle_status(F.col("last_seen"), F.col("last_speed"), V.moment(as_of), **thresholds)
    return (status.select("vehicle_id", F.col("status").alias("old_status"), fresh.alias("new_status"))
            .where(~F.col("old_status").eqNullSafe(F.col("new_status"))))


def apply_changes(status: DataFrame, as_of: Instant, **thresholds: float) -> DataFrame:
    """Statuses reclassified at an instant; those that change carry it as the time of their update."""
    fresh = V.vehicle_status(F.col("last_seen"), F.col("last_speed"), V.moment(as_of), **thresholds)
    updated = F.when(F.col("status").eqNullSafe(fresh), F.col("status_updated_at")).otherwise(V.moment(as_of))
    return status.withColumns({"status": fresh, "status_updated_at": updated})


def newest_readings(readings: DataFrame) -> DataFrame:
    """The newest reading of each vehicle: its position, speed and time."""
    return (readings.groupBy("vehicle_id")
            .agg(F.max_by(F.struct(F.col("lat").alias("last_lat"), F.col("lng").alias("last_lng"), F.col("speed_kph").alias("last_speed"),
                                   F.col("event_timestamp").alias("last_seen")), F.struct("event_timestamp", "id")).alias("r"))
            .select("vehicle_id", "r.*"))


def merge_status(known: DataFrame, newest: DataFrame) -> DataFrame:
    """Statuses after newer readings (of ``newest_readings``): a vehicle with a reading at least as new as its status takes its
    values and the status at its time; the others stay as they are."""
    seen = F.col("last_seen")
    fresh = newest.select("vehicle_id", "last_lat", "last_lng", "last_speed", "last_seen", F.lit(1).alias("_new"),
                          V.vehicle_status(seen, F.col("last_speed"), seen).alias("status"), seen.alias("status_updated_at"))
    both = known.withColumn("_new", F.lit(0)).unionByName(fresh)
    values = F.struct("last_lat", "last_lng", "last_speed", "last_seen", "status", "status_updated_at")
    return both.groupBy("vehicle_id").agg(F.max_by(values, F.struct("last_seen", "_new")).alias("s")).select("vehicle_id", "s.*")


def normalize_type(alerts: DataFrame) -> DataFrame:
    """Adds ``normal_type`` and ``alert_group``."""
    kind = F.col("alert_type")
    return alerts.withColumns({"normal_type": V.alert_type(kind), "alert_group": V.alert_group(kind)})


def build_status(readings: DataFrame, as_of: Instant, rule: str = "service", **thresholds: float) -> DataFrame:
    """Status table from a history: last position, speed and time per vehicle up to ``as_of``."""
    newest = (readings.where(F.col("event_timestamp") <= V.moment(as_of))
              .groupBy("vehicle_id").agg(F.max_by(
                  F.struct("lat", "lng", "speed_kph", "event_timestamp"),
                  F.struct("event_timestamp", "id")).alias("r")))
    seen, speed = F.col("r.event_timestamp"), F.col("r.speed_kph")
    return newest.select(
        "vehicle_id", F.col("r.lat").alias("last_lat"), F.col("r.lng").alias("last_lng"),
        speed.alias("last_speed"), seen.alias("last_seen"),
        V.vehicle_status(seen, speed, V.moment(as_of), rule, **thresholds).alias("status"),
        V.moment(as_of).alias("status_updated_at"))


def status_view(status: DataFrame, as_of: Instant) -> DataFrame:
    """Statuses with colour, label and age in words."""
    shown = F.coalesce("status", V.vehicle_status(F.col("last_seen"), F.col("last_speed"), V.moment(as_of)))
    return (status.select("vehicle_id", "last_lat", "last_lng", "last_speed", "last_seen", shown.alias("status"))
            .withColumns({
                "status_color": V.lookup(F.col("status"), S.STATUS_COLORS, "gray"),
                "status_text": V.lookup(F.col("status"), S.STATUS_LABELS, "Unknown"),
                "time_since_last_update": V.age_text(F.col("last_seen"), V.moment(as_of))}))


def enrich_events(events: DataFrame, status: DataFrame) -> DataFrame:
    """Events with their vehicle's status and its colour; works for a stream of events.

    No broadcast is forced: the status table has a row per vehicle. Spark broadcasts it
    while it is small, and beyond that splits a large vehicle's events in the join."""
    current = status.select("vehicle_id", "status")
    return (events.join(current, "vehicle_id", "left")
            .withColumn("status_color", V.lookup(F.col("status"), S.STATUS_COLORS, "gray")))


def alert_details(alerts: DataFrame) -> DataFrame:
    """Alerts with their JSON details as columns, and what the alert lists show:
    ``message`` as a sentence and ``detail`` in short."""
    d = lambda name: F.col(f"_details.{name}")
    group = V.alert_group(F.col("alert_type"))
    number = lambda value: F.format_string("%.2f", V.round2(value))
    # An excess of zero counts as not given.
    excess = F.coalesce(F.nullif(d("excess"), F.lit(0.0)), F.floor(d("speedKph") - d("threshold") + 0.5).cast("double"))
    zone = F.coalesce(F.nullif(d("geofence"), F.lit("")), F.nullif(d("zone"), F.lit("")), F.lit("Unknown"))
    minutes = d("idleMinutes").cast("string")
    message = (F.when(group == "SPEEDING", F.concat(F.lit("Exceeded speed limit by "), number(excess), F.lit(" kph")))
               .when(group == "GEOFENCE", F.concat(
                   F.when(d("action") == "entered", "Entered ").otherwise("Exited "), zone))
               .otherwise(F.concat(F.lit("Idle for "), minutes, F.lit(" minutes"))))
    detail = (F.when(group == "SPEEDING", F.concat(number(d("speedKph")), F.lit(" km/h")))
              .when(group == "GEOFENCE", zone)
              .otherwise(F.concat(minutes, F.lit(" min"))))
    return (alerts.withColumn("_details", F.from_json("details", S.ALERT_DETAILS))
            .select(*alerts.columns, group.alias("alert_group"),
                    d("speedKph").alias("speed_kph"), d("threshold").alias("threshold"), excess.alias("excess"),
                    F.when(group == "GEOFENCE", zone).alias("zone"), d("action").alias("action"),
                    d("overlapping_zones").alias("overlapping_zones"), d("zone_count").alias("zone_count"),
                    d("idleMinutes").alias("idle_minutes"), message.alias("message"), detail.alias("detail")))
