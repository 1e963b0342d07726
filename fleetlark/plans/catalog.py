"""The registered queries: one per operator, with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.operators import detect, lookups, maintain, reports, spatial
from fleetlark.plans import oracle as O
from fleetlark.plans.oracle import ALERTS, AS_OF, NOW, READINGS, select
from fleetlark.sources import geofences, gps, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VEHICLE = "VH-0008"
FROM, TO = "2024-01-05 00:00:00", "2024-01-25 00:00:00"
SINCE = "2024-01-15 12:00:00"
LATER = "2024-01-31 05:00:00"
_RANGE = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
_READING = ["id", "vehicle_id", "lat", "lng", "speed_kph", "heading", "event_timestamp"]
_ALERT = ["id", "vehicle_id", "alert_type", "detected_at", "lat", "lng"]
_R, _A = ", ".join(_READING), ", ".join(_ALERT)
_KEPT = ["id", "vehicle_id", "alert_type", "detected_at"]
_K = ", ".join(_KEPT)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def on_readings(name: str, make: Callable[[DataFrame], DataFrame], sql: str, *ctes: str) -> None:
    query(name, select(sql, READINGS, *ctes))(lambda spark, sf: make(tables.readings(spark, sf)))


def on_alerts(name: str, make: Callable[[DataFrame], DataFrame], sql: str, *ctes: str) -> None:
    query(name, select(sql, ALERTS, *ctes))(lambda spark, sf: make(tables.alerts(spark, sf)))


def on_sites(name: str, make: Callable[[DataFrame, DataFrame], DataFrame], sql: str, *ctes: str) -> None:
    """Readings together with the site geofences."""
    query(name, select(sql, READINGS, *ctes))(
        lambda spark, sf: make(tables.readings(spark, sf), tables.site_fences(spark)))


def on_status(name: str, make: Callable[[DataFrame], DataFrame], sql: str, *ctes: str) -> None:
    query(name, select(sql, READINGS, O.STATUS, *ctes))(
        lambda spark, sf: make(detect.build_status(tables.readings(spark, sf), NOW)))


# --- messages, dead letters, loading -------------------------------------------------

def _routed(spark: SparkSession, sf: str) -> DataFrame:
    return gps.route_events(gps.parse_gps(tables.gps_json(spark, sf)))


def _message_columns() -> list:
    return ["key", F.col("partition").cast("long").alias("message_partition"),
            F.col("offset").alias("message_offset"), "malformed", F.col("vehicleId").alias("sent_id"), "lat", "lng",
            F.col("speedKph").alias("speed_kph"), "heading", F.col("timestamp").alias("sent_at")]


_MESSAGE_SQL = ("vehicle_id AS key, id % 3 AS message_partition, id // 3 AS message_offset, malformed, "
                + ", ".join(f"CASE WHEN NOT malformed THEN {source} END AS {name}" for source, name in (
                    ("sent_id", "sent_id"), ("sent_lat", "lat"), ("lng", "lng"), ("speed_kph", "speed_kph"),
                    ("heading", "heading"), ("sent_at", "sent_at"))))


@query("a1_parse_gps", select(f"SELECT {_MESSAGE_SQL} FROM messages", READINGS, O.MESSAGES))
def a1(spark, sf):
    return gps.parse_gps(tables.gps_json(spark, sf)).select(*_message_columns())


@query("a2_route_events", select(f"SELECT {_MESSAGE_SQL}, error_type, error_message FROM routed", READINGS, O.MESSAGES))
def a2(spark, sf):
    return _routed(spark, sf).select(*_message_columns(), "error_type", "error_message")


@query("a3_dlq_envelope", select(
    f"""SELECT vehicle_id AS key, payload, 'vehicle-gps' AS original_topic, (id % 3)::VARCHAR AS original_partition,
    (id // 3)::VARCHAR AS original_offset, error_type, error_message, epoch_ms({AS_OF})::VARCHAR AS failed_at,
    length(payload)::VARCHAR AS payload_length FROM routed WHERE error_type IS NOT NULL""", READINGS, O.MESSAGES))
def a3(spark, sf):
    letters = gps.to_dlq(_routed(spark, sf), NOW)
    named = {gps.HEADER_TOPIC: "original_topic", gps.HEADER_PARTITION: "original_partition",
             gps.HEADER_OFFSET: "original_offset", gps.HEADER_TYPE: "error_type", gps.HEADER_MESSAGE: "error_message",
             gps.HEADER_FAILED_AT: "failed_at", gps.HEADER_LENGTH: "payload_length"}
    return letters.select("key", "payload", *[F.col("headers")[h].alias(n) for h, n in named.items()])


@query("a4_dlq_report", select(
    """SELECT 'vehicle-gps' AS original_topic, error_type, error_message, count(*) AS failures,
    sum(length(payload))::BIGINT AS payload_chars, max(id // 3) AS last_offset FROM routed
    WHERE error_type IS NOT NULL GROUP BY error_type, error_message""", READINGS, O.MESSAGES))
def a4(spark, sf):
    return gps.dlq_report(gps.to_dlq(_routed(spark, sf), NOW))


def _alert_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts as messages, every 97th cut short and every 89th without type."""
    alerts = tables.alerts(spark, sf).select(*_ALERT, "details").withColumn("alert_type", F.expr("IF(id % 89 <> 0, alert_type, NULL)"))
    return gps.to_keyed_json(alerts, rename=gps.EVENT_NAMES).select(
        "key", F.expr("IF(get_json_object(value, '$.id') % 97 = 0, left(value, 30), value) AS value"), F.lit("vehicle-alerts").alias("topic"),
        F.lit(0).alias("partition"), F.lit(1).cast("long").alias("offset"))


@query("a6_alert_messages", select(
    f"SELECT {_A}, details FROM alerts WHERE id % 97 <> 0 AND id % 89 <> 0", ALERTS))
def a6_messages(spark, sf):
    return gps.to_alerts(gps.route_alerts(gps.parse_alerts(_alert_messages(spark, sf))))


@query("a6_refused_messages", select(
    f"""SELECT CASE WHEN id % 97 = 0 THEN 'Malformed JSON' ELSE 'Missing required fields: vehicleId or alertType' END AS error_message,
    count(*) AS failures FROM alerts WHERE id % 97 = 0 OR id % 89 = 0 GROUP BY 1""", ALERTS))
def a6_refused(spark, sf):
    routed = gps.route_alerts(gps.parse_alerts(_alert_messages(spark, sf)))
    return gps.dlq_report(gps.to_dlq(routed, NOW)).groupBy("error_message").agg(F.sum("failures").alias("failures"))


def _depots(spark: SparkSession, sf: str) -> DataFrame:
    return geofences.load_geofences(tables.depot_geojson(spark, sf))


@query("a8_load_geofences", select("SELECT id, name, seq, lng, lat FROM corners", O.DEPOTS))
def a8(spark, sf):
    loaded = geofences.require_unique_names(_depots(spark, sf))
    return loaded.selectExpr("id", "name", "posexplode(ring) AS (seq, p)").select(
        "id", "name", "seq", "p.lng", "p.lat")


def _yards(spark: SparkSession, sf: str) -> DataFrame:
    return geofences.load_geofences(tables.yard_geojson(spark, sf))


@query("a8_polygon_forms", select(
    """SELECT id, name, part, ring, seq, (CASE WHEN dx = 0 THEN x0 ELSE x1 END)::DOUBLE / 100000::DOUBLE AS lng,
    (CASE WHEN dy = 0 THEN y0 ELSE y1 END)::DOUBLE / 10000::DOUBLE AS lat
    FROM rectangles, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy)""", O.YARDS))
def a8_forms(spark, sf):
    rings = (_yards(spark, sf).selectExpr("id", "name", "posexplode(polygons) AS (part, polygon)")
             .selectExpr("id", "name", "part", "posexplode(polygon) AS (ring, corners)"))
    return rings.selectExpr("id", "name", "part", "ring", "posexplode(corners) AS (seq, p)").select(
        "id", "name", "part", "ring", "seq", "p.lng", "p.lat")


@query("a8_refused", select(
    f"""SELECT id, name, CASE fault WHEN 0 THEN '{geofences.NO_POLYGON}' WHEN 1 THEN '{geofences.FEW_CORNERS}'
    WHEN 2 THEN '{geofences.NO_POSITION}' ELSE '{geofences.NOT_JSON}' END AS reason FROM yards WHERE form = 4""", O.YARDS))
def a8_refused(spark, sf):
    return geofences.refused_geofences(tables.yard_geojson(spark, sf))


@query("a9_latest_stats", select(
    """SELECT vehicle_id, avg_speed, max_speed, total_distance, reading_count, window_start, window_end FROM stats
    QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY window_start DESC) = 1""", READINGS, O.windowed(86400)))
def a9(spark, sf):
    stats = _rounded_stats(reports.vehicle_stats(tables.readings(spark, sf), "1 day"))
    body = F.struct(F.col("vehicle_id").alias("vehicleId"), F.col("avg_speed").alias("avgSpeed"),
                    F.col("max_speed").alias("maxSpeed"), F.col("total_distance").alias("totalDistance"),
                    F.col("reading_count").alias("readingCount"), F.col("window_start").alias("windowStart"),
                    F.col("window_end").alias("windowEnd"))
    messages = stats.select(F.to_json(body).alias("value"), F.unix_seconds("window_start").alias("offset"),
                            F.lit(0).alias("partition"))
    return gps.latest_stats(messages).withColumn("reading_count", F.col("reading_count").cast("long"))


on_readings("a10_keyed_json", lambda r: gps.to_keyed_json(
    r.select("id", "vehicle_id", "lat", "lng", "speed_kph", "event_timestamp"), rename=gps.EVENT_NAMES),
    """SELECT vehicle_id AS key, '{"id":' || id || ',"vehicleId":"' || vehicle_id || '","lat":' || lat || ',"lng":' || lng
    || ',"speedKph":' || speed_kph || ',"timestamp":"' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS value
    FROM readings""")

on_readings("a12_backfill", lambda r: gps.backfill_location(r).select(
    "id", F.col("location.lng").alias("lng"), F.col("location.lat").alias("lat"), "location_filled"),
    "SELECT id, lng, lat, NOT located AS location_filled FROM readings")


on_readings("a5_located_readings", lambda r: gps.located(r.withColumn("lat", F.when(F.col("id") % 89 != 0, F.col("lat")))).select(
    *_READING, F.col("location.lng").alias("point_lng"), F.col("location.lat").alias("point_lat")),
    """SELECT id, vehicle_id, CASE WHEN id % 89 <> 0 THEN lat END AS lat, lng, speed_kph, heading, event_timestamp,
    CASE WHEN located OR id % 89 <> 0 THEN lng END AS point_lng, CASE WHEN located OR id % 89 <> 0 THEN lat END AS point_lat FROM readings""")
on_alerts("a6_alert_rows", lambda a: gps.alert_records(a.withColumns({
    "details": F.struct(F.col("alert_type").alias("kind"), "id"), "lng": F.when(F.col("id") % 89 != 0, F.col("lng"))})).select(
    *_ALERT, "details", F.col("location.lng").alias("point_lng"), F.col("location.lat").alias("point_lat")),
    """SELECT id, vehicle_id, alert_type, detected_at, lat, CASE WHEN id % 89 <> 0 THEN lng END AS lng, '{"kind":"' || alert_type || '","id":' || id || '}' AS details,
    CASE WHEN id % 89 <> 0 THEN lng END AS point_lng, CASE WHEN id % 89 <> 0 THEN lat END AS point_lat FROM alerts""")


@query("a7_merge_status", select(
    """SELECT vehicle_id, lat AS last_lat, lng AS last_lng, speed_kph AS last_speed, event_timestamp AS last_seen,
    CASE WHEN speed_kph <= 1 THEN 'IDLE' ELSE 'ONLINE' END AS status, event_timestamp AS status_updated_at FROM readings
    QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, id % 2 DESC, id DESC) = 1""", READINGS))
def a7(spark, sf):
    halves = [detect.newest_readings(tables.readings(spark, sf).where(F.col("id") % 2 == half)) for half in (0, 1)]
    return detect.merge_status(detect.merge_status(spark.createDataFrame([], S.STATUS), halves[0]), halves[1])


@query("a13_normalize_alerts", select(
    f"""SELECT id, vehicle_id, CASE WHEN alert_type = 'UNKNOWN' THEN 'SPEEDING' ELSE alert_type END AS alert_type,
    CASE WHEN id % 83 = 0 THEN {AS_OF} ELSE detected_at END AS detected_at,
    CASE WHEN id % 89 = 0 THEN 0 ELSE lat END AS lat, lng FROM alerts""", ALERTS))
def a13(spark, sf):
    holed = tables.alerts(spark, sf).withColumns({
        "detected_at": F.when(F.col("id") % 83 != 0, F.col("detected_at")),
        "lat": F.when(F.col("id") % 89 != 0, F.col("lat"))})
    return gps.normalize_alerts(holed, NOW).select(*_ALERT)


# --- lookups ---------------------------------------------------------------------------

on_readings("b1_latest_reading", lambda r: lookups.latest_readings(r).select(*_READING),
            f"""SELECT {_R} FROM readings QUALIFY row_number() OVER
            (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, id DESC) = 1""")
on_readings("b1_latest_of_vehicle", lambda r: lookups.latest_readings(r, VEHICLE).select(*_READING),
            f"""SELECT {_R} FROM readings WHERE vehicle_id = '{VEHICLE}' ORDER BY event_timestamp DESC, id DESC LIMIT 1""")
on_readings("b2_vehicle_history", lambda r: lookups.vehicle_history(r, VEHICLE).select(*_READING),
            f"SELECT {_R} FROM readings WHERE vehicle_id = '{VEHICLE}' ORDER BY event_timestamp DESC, id DESC LIMIT 50")
on_readings("b3_readings_between", lambda r: lookups.readings_between(r, FROM, TO, VEHICLE).select(*_READING),
            f"SELECT {_R} FROM readings WHERE event_timestamp {_RANGE} AND vehicle_id = '{VEHICLE}'")
on_readings("b4_readings_between_all", lambda r: lookups.readings_between(r, FROM, TO).select(*_READING),
            f"SELECT {_R} FROM readings WHERE event_timestamp {_RANGE}")
on_readings("b5_speeding_readings", lambda r: lookups.speeding_readings(r, 80, SINCE).select(*_READING),
            f"SELECT {_R} FROM readings WHERE speed_kph > 80 AND event_timestamp >= TIMESTAMP '{SINCE}'")
on_readings("b6_silent_vehicles", lambda r: lookups.silent_vehicles(r, "2024-01-30 12:00:00"),
            """SELECT vehicle_id, max(event_timestamp) AS last_seen FROM readings GROUP BY vehicle_id
            HAVING max(event_timestamp) < TIMESTAMP '2024-01-30 12:00:00'""")
on_readings("b7_missing_location", lambda r: lookups.missing_location(r).select(*_READING),
            f"SELECT {_R} FROM readings WHERE NOT located")
on_alerts("b8_alerts_vehicle", lambda a: lookups.alerts(a, vehicle=VEHICLE).select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE vehicle_id = '{VEHICLE}'")
on_alerts("b9_recent_alerts", lambda a: lookups.recent_alerts(a).select(*_ALERT),
          f"SELECT {_A} FROM alerts ORDER BY detected_at DESC, id DESC LIMIT 20")
on_alerts("b10_alerts_since", lambda a: lookups.alerts(a, since=SINCE).select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE detected_at >= TIMESTAMP '{SINCE}'")
on_alerts("b11_alerts_type", lambda a: lookups.alerts(a, type="IDLE").select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE alert_type = 'IDLE'")
on_alerts("b12_alerts_between", lambda a: lookups.alerts(a, start=FROM, end=TO).select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE detected_at {_RANGE}")
on_alerts("b13_alerts_vehicle_between", lambda a: lookups.alerts(a, VEHICLE, start=FROM, end=TO).select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE detected_at {_RANGE} AND vehicle_id = '{VEHICLE}'")
_STATUS = ["vehicle_id", "last_lat", "last_lng", "last_speed", "last_seen", "status"]
_STATUS_SQL = f"SELECT vehicle_id, last_lat, last_lng, last_speed, last_seen, {O.service_status()} AS status FROM aged"
on_status("b14_statuses", lambda s: lookups.statuses(s).select(*_STATUS), _STATUS_SQL)
on_status("b15_status_vehicle", lambda s: lookups.statuses(s, VEHICLE).select(*_STATUS),
          f"{_STATUS_SQL} WHERE vehicle_id = '{VEHICLE}'")
on_status("b16_status_filter", lambda s: lookups.statuses(s, status="IDLE").select(*_STATUS),
          f"SELECT * FROM ({_STATUS_SQL}) WHERE status = 'IDLE'")


@query("b17_geofence_rings", select("SELECT id, name, seq, lng, lat FROM corners", O.DEPOTS))
def b17(spark, sf):
    nested = geofences.geofence_rings(_depots(spark, sf))
    return nested.selectExpr("id", "name", "posexplode(coordinates[0]) AS (seq, p)").selectExpr(
        "id", "name", "seq", "p[0] AS lng", "p[1] AS lat")


def _vehicles(r: DataFrame, g: DataFrame) -> DataFrame:
    latest = lookups.latest_readings(r).select("id", "vehicle_id", "lat", "lng")
    return spatial.with_region(latest, g)


_VEHICLES_SQL = ("latest AS (SELECT * FROM readings QUALIFY row_number() OVER "
                 "(PARTITION BY vehicle_id ORDER BY event_timestamp DESC, id DESC) = 1)")
on_sites("b18_search", lambda r, g: lookups.search_vehicles(_vehicles(r, g), "vh-00", "Port District")
         .select("vehicle_id", "region", "lat", "lng"),
         """SELECT vehicle_id, zone AS region, lat, lng FROM latest JOIN zone USING (id)
         WHERE contains(lower(vehicle_id), 'vh-00') AND zone = 'Port District'""",
         _VEHICLES_SQL, *O.sited("latest"), O.zone())
on_readings("b19_feed_tail", lambda r: lookups.feed_tail(r).select(*_READING),
            f"SELECT {_R} FROM readings ORDER BY event_timestamp DESC, id DESC LIMIT 1000")
on_alerts("b20_feed_by_group", lambda a: lookups.alerts(a, group="GEOFENCE").select(*_ALERT),
          f"SELECT {_A} FROM alerts WHERE contains(upper(alert_type), 'GEOFENCE')")
on_alerts("b21_preset_range", lambda a: lookups.alerts(a, preset="7d", as_of="2024-01-30 22:59:30").select(*_ALERT),
          f"""SELECT {_A} FROM alerts WHERE detected_at BETWEEN TIMESTAMP '2024-01-23 22:59:00'
          AND TIMESTAMP '2024-01-30 22:59:00'""")

# --- spatial ---------------------------------------------------------------------------

on_sites("c1_covers_join", lambda r, g: spatial.covers_join(r, g).select("id", "fence_id", "fence_name"),
         "SELECT id, fence_id::BIGINT AS fence_id, fence_name FROM covering", *O.sited())


@query("c1_covers_depots", select(
    """SELECT r.id, d.id AS fence_id, d.name AS fence_name FROM readings r JOIN
    (SELECT id, name, min(lng) AS w, max(lng) AS e, min(lat) AS s, max(lat) AS n FROM corners GROUP BY id, name) d
    ON r.lng BETWEEN d.w AND d.e AND r.lat BETWEEN d.s AND d.n""", READINGS, O.DEPOTS))
def c1_depots(spark, sf):
    return spatial.covers_join(tables.readings(spark, sf), _depots(spark, sf)).select("id", "fence_id", "fence_name")


_YARD_HITS = """hits AS (SELECT DISTINCT r.id, o.id AS fence_id, o.name AS fence_name FROM readings r JOIN rectangles o
    ON o.ring = 0 AND r.lng * 100000 BETWEEN o.x0 - 0.01 AND o.x1 + 0.01 AND r.lat * 10000 BETWEEN o.y0 - 0.01 AND o.y1 + 0.01
    WHERE NOT EXISTS (SELECT 1 FROM rectangles h WHERE h.id = o.id AND h.part = o.part AND h.ring > 0
      AND r.lng * 100000 > h.x0 + 0.01 AND r.lng * 100000 < h.x1 - 0.01 AND r.lat * 10000 > h.y0 + 0.01 AND r.lat * 10000 < h.y1 - 0.01))"""


@query("c1_covers_forms", select("SELECT id, fence_id, fence_name FROM hits", READINGS, O.YARDS, _YARD_HITS))
def c1_forms(spark, sf):
    return spatial.covers_join(tables.readings(spark, sf), _yards(spark, sf)).select("id", "fence_id", "fence_name")


@query("c6_zone_forms", select(
    """SELECT r.id, z.zone FROM readings r LEFT JOIN (SELECT h.id, fence_name AS zone FROM hits h JOIN
    (SELECT id AS fence_id, sum(CASE WHEN ring = 0 THEN 1 ELSE -1 END * (x1 - x0) * (y1 - y0)) AS area FROM rectangles GROUP BY id) a USING (fence_id)
    QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY area, fence_id) = 1) z USING (id)""", READINGS, O.YARDS, _YARD_HITS))
def c6_forms(spark, sf):
    return spatial.assign_zone(tables.readings(spark, sf), _yards(spark, sf)).select("id", "zone")


on_sites("c2_within_distance", lambda r, g: spatial.within_distance_join(r, g, 250).select(
    "id", "fence_id", F.round("distance_m", 4).alias("distance_m")),
    """SELECT id, fence_id::BIGINT AS fence_id, round(CASE WHEN inside OR on_edge THEN 0 ELSE edge_m END, 4) AS distance_m
    FROM tested WHERE inside OR on_edge OR edge_m <= 250""", *O.sited())
on_sites("c3_first_zone", lambda r, g: spatial.first_zone(r, g).select("id", "zone"),
         "SELECT r.id, zone FROM readings r LEFT JOIN zone z USING (id)", *O.sited(), O.zone("id"))
_C4 = O.haversine_km("24.9::DOUBLE", "67.02::DOUBLE", "lat", "lng") + " * 1000"
on_alerts("c4_alerts_radius", lambda a: spatial.alerts_within_radius(a, 24.9, 67.02, 1500, SINCE).select(
    *_ALERT, F.round("distance_m", 4).alias("distance_m")),
    f"""SELECT {_A}, round({_C4}, 4) AS distance_m FROM alerts
    WHERE detected_at >= TIMESTAMP '{SINCE}' AND {_C4} <= 1500""")


@query("c5_alerts_in_geofence", select(
    f"""SELECT {_A} FROM alerts JOIN tested USING (id) JOIN fences USING (fence_id) WHERE fence_name = 'Triangle Yard'
    AND inside AND NOT on_edge AND detected_at >= TIMESTAMP '{SINCE}'""", ALERTS, *O.sited("alerts")))
def c5(spark, sf):
    return spatial.alerts_within_geofence(
        tables.alerts(spark, sf), tables.site_fences(spark), "Triangle Yard", SINCE).select(*_ALERT)


on_sites("c6_assign_zone", lambda r, g: spatial.assign_zone(r, g).select("id", "zone"),
         "SELECT r.id, zone FROM readings r LEFT JOIN zone z USING (id)", *O.sited(), O.zone())
on_sites("c7_overlaps", lambda r, g: spatial.overlapping_zones(r, g).select(
    "id", F.array_join("overlapping_zones", ", ").alias("overlapping_zones"), F.col("zone_count").cast("long").alias("zone_count")),
    """SELECT id, string_agg(fence_name, ', ' ORDER BY fence_name) AS overlapping_zones, count(*) AS zone_count
    FROM covering GROUP BY id HAVING count(*) > 1""", *O.sited())
on_readings("c8_leg_distance", lambda r: spatial.leg_distance(r).select(
    "id", "vehicle_id", F.round("leg_km", 6).alias("leg_km")),
    f"SELECT id, vehicle_id, round({O.haversine_km('lat0', 'lng0', 'lat', 'lng')}, 6) AS leg_km FROM lags", O.LAGS)
on_sites("c9_regions", lambda r, g: spatial.regions(_vehicles(r, g)),
         "SELECT DISTINCT coalesce(zone, 'Unknown') AS region FROM latest LEFT JOIN zone USING (id)",
         _VEHICLES_SQL, *O.sited("latest"), O.zone())
on_sites("c9_with_region", lambda r, g: spatial.with_region(r, g).select("id", "vehicle_id", "region"),
         "SELECT r.id, vehicle_id, coalesce(zone, 'Unknown') AS region FROM readings r LEFT JOIN zone z USING (id)",
         *O.sited(), O.zone())
on_readings("c10_center", lambda r: spatial.fleet_center(lookups.latest_readings(r)).select(
    F.round("center_lat", 6).alias("center_lat"), F.round("center_lng", 6).alias("center_lng")),
    "SELECT round(avg(lat), 6) AS center_lat, round(avg(lng), 6) AS center_lng FROM latest", _VEHICLES_SQL)

# --- detection and status --------------------------------------------------------------

on_readings("d1_speeding", lambda r: detect.speeding_alerts(r).withColumn("excess", F.round("excess", 6)),
            """SELECT id, vehicle_id, 'SPEEDING' AS alert_type, event_timestamp AS detected_at, lat, lng, speed_kph,
            80::DOUBLE AS threshold, round(speed_kph - 80, 6) AS excess FROM readings WHERE speed_kph > 80""")


def _idle_sql(minutes: str) -> str:
    return (f"SELECT id, vehicle_id, 'IDLE' AS alert_type, event_timestamp AS detected_at, lat, lng, first_idle_at, "
            f"speed_kph, {minutes}::BIGINT AS idle_minutes FROM idles")


_ELAPSED = "((epoch_us(event_timestamp) - epoch_us(first_idle_at)) // 60000000)"
on_readings("d2_idle", lambda r: detect.idle_alerts(r, idle_speed=10), _idle_sql("2"), O.idle("2 minutes", 10))
on_readings("d2_idle_default", detect.idle_alerts, _idle_sql("2"), O.idle("2 minutes", 1))
on_readings("d14_idle_elapsed", lambda r: detect.idle_alerts(r, "10 minutes", 10, minutes="elapsed"),
            _idle_sql(_ELAPSED), O.idle("10 minutes", 10))


def _zone_columns(found: DataFrame) -> DataFrame:
    return found.withColumns({"overlapping_zones": F.array_join("overlapping_zones", ", "),
                              "zone_count": F.col("zone_count").cast("long")})


_ZONE_SQL = ("SELECT id, vehicle_id, alert_type, detected_at, lat, lng, zone, action, all_zones AS overlapping_zones, "
             "zone_count FROM zone_alerts")
on_sites("d3_geofence", lambda r, g: _zone_columns(detect.geofence_alerts(r, g)), _ZONE_SQL, *O.steps(10))
on_sites("d3_geofence_buffer", lambda r, g: _zone_columns(detect.geofence_alerts(r, g, 250)), _ZONE_SQL, *O.steps(250))
on_sites("d3_geofence_by_id", lambda r, g: _zone_columns(detect.geofence_alerts(r, g, priority="id")),
         _ZONE_SQL, *O.steps(10, "id"))


def _detected(r: DataFrame, g: DataFrame) -> DataFrame:
    return detect.detect_alerts(r, g, idle_speed=10, buffer_m=250)


_ALL_ALERTS = [*O.steps(250), O.idle("2 minutes", 10), """everything AS (
  SELECT id, vehicle_id, 'SPEEDING' AS alert_type, event_timestamp AS detected_at, lat, lng, speed_kph,
    80::DOUBLE AS threshold, speed_kph - 80 AS excess, NULL::VARCHAR AS zone, NULL::VARCHAR AS action,
    NULL::VARCHAR AS overlapping_zones, NULL::BIGINT AS zone_count, NULL::BIGINT AS idle_minutes
    FROM readings WHERE speed_kph > 80
  UNION ALL SELECT id, vehicle_id, 'IDLE', event_timestamp, lat, lng, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 2 FROM idles
  UNION ALL SELECT id, vehicle_id, alert_type, detected_at, lat, lng, NULL, NULL, NULL, zone, action, all_zones,
    zone_count, NULL FROM zone_alerts)"""]


def _from_details(name: str, kind: str = "string"):
    return F.get_json_object("details", f"$.{name}").cast(kind)


on_sites("d4_all_alerts", lambda r, g: _detected(r, g).select(
    *_ALERT, _from_details("speedKph", "double").alias("speed_kph"), _from_details("geofence").alias("geofence"),
    _from_details("action").alias("action"), _from_details("zone_count", "long").alias("zone_count"),
    _from_details("idleMinutes", "long").alias("idle_minutes"), _from_details("reason").alias("reason")),
    f"""SELECT {_A}, speed_kph, zone AS geofence, action, zone_count, idle_minutes,
    'Vehicle has been stationary for ' || idle_minutes || ' minutes' AS reason FROM everything""", *_ALL_ALERTS)

on_status("d5_status_service", lambda s: detect.classify(s, NOW).select("vehicle_id", "last_seen", "status"),
          f"SELECT vehicle_id, last_seen, {O.service_status()} AS status FROM aged")
on_status("d5_status_hours", lambda s: detect.classify(s, NOW, idle_minutes=240, offline_minutes=720)
          .select("vehicle_id", "last_seen", "status"),
          f"SELECT vehicle_id, last_seen, {O.service_status(240, 720)} AS status FROM aged")
on_status("d6_status_dashboard", lambda s: detect.classify(s, NOW, "dashboard").select("vehicle_id", "last_seen", "status"),
          f"SELECT vehicle_id, last_seen, {O.DASHBOARD_STATUS} AS status FROM aged")
on_status("d7_status_backfill", lambda s: detect.classify(
    s.withColumn("status", F.when(F.col("last_speed") <= 40, F.col("status"))), NOW, "backfill")
    .select("vehicle_id", "last_seen", "status"),
    f"""SELECT vehicle_id, last_seen, CASE WHEN last_speed <= 40 THEN {O.service_status()}
    ELSE {O.BACKFILL_STATUS} END AS status FROM aged""")


@query("d8_status_changes", select(
    f"""SELECT * FROM (SELECT vehicle_id, {O.DASHBOARD_STATUS} AS old_status, {O.service_status(240, 720)} AS new_status FROM aged)
    WHERE old_status <> new_status""", READINGS, O.STATUS))
def d8(spark, sf):
    stored = detect.build_status(tables.readings(spark, sf), NOW, "dashboard")
    return detect.status_changes(stored, NOW, idle_minutes=240, offline_minutes=720)


@query("d8_apply_changes", select(
    f"""SELECT vehicle_id, last_seen, new_status AS status, CASE WHEN old_status = new_status THEN {AS_OF} ELSE {AS_OF} + INTERVAL 6 HOUR END AS status_updated_at
    FROM (SELECT vehicle_id, last_seen, {O.DASHBOARD_STATUS} AS old_status, {O.service_status(240, 720).replace('age', '(age + 360)')} AS new_status FROM aged)""",
    READINGS, O.STATUS))
def d8_apply(spark, sf):
    stored = detect.build_status(tables.readings(spark, sf), NOW, "dashboard")
    return detect.apply_changes(stored, LATER, idle_minutes=240, offline_minutes=720).select("vehicle_id", "last_seen", "status", "status_updated_at")


_NORMAL = "CASE WHEN alert_type = 'UNKNOWN' THEN 'SPEEDING' ELSE alert_type END"
_GROUP = ("CASE WHEN contains(alert_type, 'GEOFENCE') THEN 'GEOFENCE' WHEN alert_type = 'IDLE' THEN 'IDLE' "
          "ELSE 'SPEEDING' END")
on_alerts("d9_normalize_type", lambda a: detect.normalize_type(a.withColumn("alert_type", F.lower("alert_type")))
          .select("id", "normal_type", "alert_group"),
          f"SELECT id, {_NORMAL} AS normal_type, {_GROUP} AS alert_group FROM alerts")
on_status("d10_build_status", lambda s: s.select(*_STATUS, "status_updated_at"),
          _STATUS_SQL.replace(" FROM aged", f", {AS_OF} AS status_updated_at FROM aged"))
on_status("d11_status_view", lambda s: detect.status_view(s, NOW),
          """SELECT *, CASE status WHEN 'ONLINE' THEN 'green' WHEN 'IDLE' THEN 'orange' ELSE 'red' END AS status_color,
          CASE status WHEN 'ONLINE' THEN 'Online' WHEN 'IDLE' THEN 'Idle' ELSE 'Offline' END AS status_text,
          CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 1440 THEN m // 60 || ' hr ago'
            ELSE m // 1440 || ' days ago' END AS time_since_last_update
          """.replace("*", ", ".join(_STATUS), 1)
          + f"FROM (SELECT *, {O.service_status()} AS status, trunc(age)::BIGINT AS m FROM aged)")


@query("d12_enrich", select(
    f"""SELECT r.id, r.vehicle_id, status, CASE status WHEN 'ONLINE' THEN 'green' WHEN 'IDLE' THEN 'orange'
    WHEN 'OFFLINE' THEN 'red' ELSE 'gray' END AS status_color FROM readings r
    LEFT JOIN (SELECT vehicle_id, {O.service_status(240, 720)} AS status FROM aged) s USING (vehicle_id)""", READINGS, O.STATUS))
def d12(spark, sf):
    readings = tables.readings(spark, sf)
    status = detect.build_status(readings, NOW, idle_minutes=240, offline_minutes=720)
    return detect.enrich_events(readings, status).select("id", "vehicle_id", "status", "status_color")


_KPH = "printf('%.2f', floor({} * 100 + 0.5) / 100)"
on_sites("d13_alert_details", lambda r, g: detect.alert_details(_detected(r, g)).drop("details").withColumns({
    "overlapping_zones": F.array_join("overlapping_zones", ", "), "zone_count": F.col("zone_count").cast("long"),
    "excess": F.round("excess", 6)}),
    f"""SELECT {_A}, {_GROUP} AS alert_group, speed_kph, threshold, round(excess, 6) AS excess, zone, action,
    overlapping_zones, zone_count, idle_minutes,
    CASE WHEN alert_type = 'SPEEDING' THEN 'Exceeded speed limit by ' || {_KPH.format('excess')} || ' kph'
      WHEN action = 'entered' THEN 'Entered ' || zone WHEN action = 'exited' THEN 'Exited ' || zone
      ELSE 'Idle for ' || idle_minutes || ' minutes' END AS message,
    CASE WHEN alert_type = 'SPEEDING' THEN {_KPH.format('speed_kph')} || ' km/h'
      WHEN zone IS NOT NULL THEN zone ELSE idle_minutes || ' min' END AS detail FROM everything""", *_ALL_ALERTS)

# --- counts and reports ----------------------------------------------------------------

on_alerts("e1_by_type", reports.count_by_type, "SELECT alert_type, count(*) AS alerts FROM alerts GROUP BY alert_type")
on_alerts("e2_by_vehicle", reports.count_by_vehicle, "SELECT vehicle_id, count(*) AS alerts FROM alerts GROUP BY vehicle_id")
on_alerts("e3_top_offenders", reports.top_offenders,
          "SELECT vehicle_id, count(*) AS alerts FROM alerts GROUP BY vehicle_id ORDER BY alerts DESC, vehicle_id LIMIT 5")
_PICKED = f"picked AS (SELECT * FROM alerts WHERE detected_at {_RANGE} AND alert_type = 'IDLE')"
on_alerts("e4_history_page", lambda a: reports.alert_history_page(a, FROM, TO, type="IDLE").select(*_ALERT),
          f"SELECT {_A} FROM picked ORDER BY detected_at DESC, id DESC LIMIT 100", _PICKED)


def _scoped(table: str) -> str:
    return f"""SELECT 'total' AS scope, 'all' AS name, count(*) AS alerts FROM {table}
    UNION ALL SELECT 'type', alert_type, count(*) FROM {table} GROUP BY alert_type
    UNION ALL SELECT 'vehicle', vehicle_id, count(*) FROM {table} GROUP BY vehicle_id"""


on_alerts("e4_history_totals", lambda a: reports.alert_history_totals(a, FROM, TO, type="IDLE"),
          f"{_scoped('picked')} UNION ALL SELECT 'returned', 'all', least(count(*), 100) FROM picked", _PICKED)
on_readings("e5_reading_report", lambda r: reports.reading_report(r, VEHICLE, FROM, TO, limit=20),
            f"""SELECT '{VEHICLE}' AS vehicle_id, floor(coalesce(avg(speed_kph), 0) * 100 + 0.5) / 100 AS average_speed,
            floor(coalesce(max(speed_kph), 0) * 100 + 0.5) / 100 AS max_speed, count(*) AS total_count,
            least(count(*), 20) AS returned_count FROM readings
            WHERE vehicle_id = '{VEHICLE}' AND event_timestamp {_RANGE}""")
on_readings("e5_reading_page", lambda r: reports.reading_report_page(r, VEHICLE, FROM, TO, limit=20).select(*_READING),
            f"""SELECT {_R} FROM readings WHERE vehicle_id = '{VEHICLE}' AND event_timestamp {_RANGE}
            ORDER BY event_timestamp DESC, id DESC LIMIT 20""")
on_alerts("e6_summary", lambda a: reports.alert_summary(a, FROM, TO),
          f"""{_scoped('ranged')} UNION ALL SELECT * FROM (SELECT 'top', vehicle_id, count(*) AS alerts FROM ranged
          GROUP BY vehicle_id ORDER BY alerts DESC, vehicle_id LIMIT 5)""",
          f"ranged AS (SELECT * FROM alerts WHERE detected_at {_RANGE})")


@query("e7_fleet_stats", select(
    f"""SELECT count(*) AS total_vehicles, count_if(age < 1)::BIGINT AS online_vehicles,
    floor(coalesce(avg(last_speed), 0) * 100 + 0.5) / 100 AS average_speed,
    (SELECT count(*) FROM alerts WHERE detected_at >= {AS_OF} - INTERVAL 1 HOUR) AS alerts_last_hour FROM aged""",
    READINGS, ALERTS, O.STATUS))
def e7(spark, sf):
    return reports.fleet_stats(detect.build_status(tables.readings(spark, sf), NOW), tables.alerts(spark, sf), NOW)


on_alerts("e8_alerts_since_count", lambda a: reports.count_alerts_since(a, SINCE),
          f"SELECT count(*) AS alerts FROM alerts WHERE detected_at >= TIMESTAMP '{SINCE}'")


@query("e9_dashboard", select(
    f"""SELECT count_if(s = 'ONLINE')::BIGINT AS online_count, count_if(s = 'IDLE')::BIGINT AS idle_count,
    count_if(s = 'OFFLINE')::BIGINT AS offline_count,
    (SELECT count(*) FROM alerts WHERE detected_at > {AS_OF} - INTERVAL 1 HOUR) AS alerts_last_hour,
    floor(coalesce(avg(last_speed), 0) + 0.5)::BIGINT AS average_speed
    FROM (SELECT *, {O.DASHBOARD_STATUS} AS s FROM aged)""", READINGS, ALERTS, O.STATUS))
def e9(spark, sf):
    return reports.dashboard_stats(detect.build_status(tables.readings(spark, sf), NOW), tables.alerts(spark, sf), NOW)


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"avg_speed": F.round("avg_speed", 9), "total_distance": F.round("total_distance", 6)})


on_readings("e10_stats_5m", lambda r: _rounded_stats(reports.vehicle_stats(r)), "SELECT * FROM stats", O.windowed(300))
on_readings("e10_stats_1d", lambda r: _rounded_stats(reports.vehicle_stats(r, "1 day")), "SELECT * FROM stats", O.windowed(86400))
on_readings("e11_running", lambda r: _rounded_stats(reports.running_stats(r)),
            f"""SELECT id, vehicle_id, event_timestamp, round(avg(coalesce(speed_kph, 0)) OVER w, 9) AS avg_speed,
            max(coalesce(speed_kph, 0)) OVER w AS max_speed,
            round(sum(coalesce({O.haversine_km('lat0', 'lng0', 'lat', 'lng')}, 0)) OVER w, 6) AS total_distance,
            count(*) OVER w AS reading_count FROM lags
            WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_timestamp, id ROWS UNBOUNDED PRECEDING)""", O.LAGS)
on_alerts("e12_by_group", reports.count_by_group,
          f"""SELECT count_if(g = 'SPEEDING')::BIGINT AS speeding, count_if(g = 'GEOFENCE')::BIGINT AS geofence, count_if(g = 'IDLE')::BIGINT AS idle
          FROM (SELECT {_GROUP} AS g FROM alerts)""")

# --- deletes ---------------------------------------------------------------------------


def _deletes(name: str, make: Callable[[DataFrame], maintain.Deletion], condition: str) -> None:
    on_alerts(name, lambda a: make(a).remaining.select(*_KEPT), f"SELECT {_K} FROM alerts WHERE NOT ({condition})")


_deletes("f1_delete_id", lambda a: maintain.delete_id(a, 7), "id = 7")
_deletes("f3_delete_vehicle", lambda a: maintain.delete_filtered(a, vehicle=VEHICLE), f"vehicle_id = '{VEHICLE}'")
_deletes("f4_delete_type", lambda a: maintain.delete_filtered(a, type="idle"), "alert_type = 'IDLE'")
_deletes("f5_delete_range", lambda a: maintain.delete_filtered(a, start=FROM, end=TO), f"detected_at {_RANGE}")
_deletes("f6_delete_vehicle_range", lambda a: maintain.delete_filtered(a, VEHICLE, start=FROM, end=TO),
         f"vehicle_id = '{VEHICLE}' AND detected_at {_RANGE}")
_deletes("f7_delete_type_range", lambda a: maintain.delete_filtered(a, type="SPEEDING", start=FROM, end=TO),
         f"alert_type = 'SPEEDING' AND detected_at {_RANGE}")
_deletes("f8_delete_filtered", lambda a: maintain.delete_filtered(a, VEHICLE, "IDLE", FROM, TO),
         f"vehicle_id = '{VEHICLE}' AND alert_type = 'IDLE' AND detected_at {_RANGE}")
_deletes("f8_delete_filtered_compat", lambda a: maintain.delete_filtered(a, VEHICLE, "IDLE", FROM, TO, compat=True),
         f"vehicle_id = '{VEHICLE}' AND detected_at {_RANGE}")
_deletes("f12_retention", lambda a: maintain.retain(a, "detected_at", NOW, maintain.KEEP["alerts"]),
         f"detected_at < {AS_OF} - INTERVAL 7 DAY")


@query("f2_delete_ids", select(
    f"SELECT {_K} FROM alerts WHERE id NOT IN (SELECT id FROM readings WHERE speed_kph > 100)", READINGS, ALERTS))
def f2(spark, sf):
    ids = tables.readings(spark, sf).where("speed_kph > 100").select("id")
    return maintain.delete_ids(tables.alerts(spark, sf), ids).remaining.select(*_KEPT)


on_alerts("f9_delete_all", lambda a: maintain.delete_all(a, confirm=True).counts(), "SELECT count(*) AS deleted_count FROM alerts")
on_alerts("f10_delete_newest", lambda a: maintain.delete_newest(a.where("alert_type = 'IDLE'"), 40).remaining.select(*_KEPT),
          f"""SELECT {_K} FROM alerts WHERE alert_type = 'IDLE'
          QUALIFY row_number() OVER (ORDER BY detected_at DESC, id DESC) > 40""")


@query("f11_delete_geofence", select("SELECT id, name, count(*) AS corners FROM corners WHERE id <> 3 GROUP BY id, name", O.DEPOTS))
def f11(spark, sf):
    return maintain.delete_geofence(_depots(spark, sf), 3).remaining.select(
        "id", "name", F.size("ring").cast("long").alias("corners"))
