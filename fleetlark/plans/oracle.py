"""DuckDB formulations of the registered queries, for checking results.

Each is written another way than the engine: points are compared with all edges, zone
state and idle spells come from plain windows over whole vehicles.
"""

from __future__ import annotations

from fleetlark import schemas as S
from fleetlark.sources.tables import SITE_FENCES

NOW = "2024-01-30 23:00:00"
AS_OF = f"TIMESTAMP '{NOW}'"


def _edges() -> str:
    rows = []
    for fid, (_, corners) in SITE_FENCES.items():
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            rows.append(f"({fid}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"edges(fence_id, x1, y1, x2, y2) AS (VALUES {', '.join(rows)})"


def _fences() -> str:
    rows = []
    for fid, (name, corners) in SITE_FENCES.items():
        (x0, y0), area = corners[0], 0.0
        for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
            area += (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        rows.append(f"({fid}, '{name}', {round(abs(area) / 2, 12):.12f}::DOUBLE)")
    return f"fences(fence_id, fence_name, area) AS (VALUES {', '.join(rows)})"


VEHICLE = ("'VH-' || lpad(CAST(user_id AS VARCHAR), greatest(4, length(CAST(user_id AS VARCHAR)))::INTEGER, '0')")
LAT = "(248800 + (event_id*7919 + user_id*104729) % 600)::DOUBLE / 10000::DOUBLE"
LNG = "(6700000 + (event_id*6101 + user_id*15485863) % 6000)::DOUBLE / 100000::DOUBLE"

READINGS = f"""readings AS (SELECT event_id AS id, {VEHICLE} AS vehicle_id, {LAT} AS lat, {LNG} AS lng,
    event_id % 71 <> 0 AS located, value AS speed_kph, (event_id * 37 % 360)::DOUBLE AS heading,
    ts AS event_timestamp FROM events)"""

ALERTS = f"""alerts AS (SELECT event_id AS id, {VEHICLE} AS vehicle_id, CASE event_type WHEN 'click' THEN 'SPEEDING'
    WHEN 'view' THEN 'GEOFENCE_ENTER' WHEN 'signup' THEN 'GEOFENCE_EXIT' WHEN 'purchase' THEN 'IDLE'
    ELSE 'UNKNOWN' END AS alert_type, props AS details, ts AS detected_at, {LAT} AS lat, {LNG} AS lng FROM events)"""

MESSAGES = """messages AS (SELECT *, id % 97 = 0 AS malformed,
    CASE WHEN id % 101 = 0 THEN rpad(vehicle_id, 60, 'X') ELSE vehicle_id END AS sent_id,
    CASE WHEN id % 89 <> 0 THEN lat END AS sent_lat,
    CASE WHEN id % 83 <> 0 THEN event_timestamp END AS sent_at FROM readings),
  texts AS (SELECT *, '{"vehicleId":"' || sent_id || '"' || coalesce(',"lat":' || sent_lat, '') || ',"lng":' || lng
    || ',"speedKph":' || speed_kph || ',"heading":' || heading
    || coalesce(',"timestamp":"' || strftime(sent_at, '%Y-%m-%dT%H:%M:%S.%f') || '"', '') || '}' AS full_text FROM messages),
  routed AS (SELECT *, CASE WHEN malformed THEN left(full_text, 40) ELSE full_text END AS payload,
    CASE WHEN malformed THEN 'ProcessingError' WHEN sent_lat IS NULL THEN 'InvalidPayload'
      WHEN sent_at IS NULL OR length(sent_id) > 50 THEN 'ProcessingError' END AS error_type,
    CASE WHEN malformed THEN 'Malformed JSON'
      WHEN sent_lat IS NULL THEN 'Missing required fields: vehicleId, lat, or lng'
      WHEN sent_at IS NULL THEN 'Missing timestamp'
      WHEN length(sent_id) > 50 THEN 'vehicleId longer than 50 characters' END AS error_message FROM texts)"""

DEPOTS = """depots AS (SELECT s_suppkey::BIGINT AS id, 'Depot ' || s_suppkey AS name,
    6700000 + s_suppkey*613 % 6000 AS x, 248800 + s_suppkey*389 % 600 AS y,
    40 + s_suppkey % 7 * 30 AS w, 3 + s_suppkey % 5 * 2 AS h FROM supplier),
  corners AS (SELECT id, name, seq, (x + dx*w)::DOUBLE / 100000::DOUBLE AS lng, (y + dy*h)::DOUBLE / 10000::DOUBLE AS lat
    FROM depots, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy))"""

# Rectangles of the yards: which polygon and ring of it, and integer sides (in 1/100000 and 1/10000 degree).
YARDS = """yards AS (SELECT s_suppkey::BIGINT AS id, 'Yard ' || s_suppkey AS name, s_suppkey % 5 AS form,
    6700000 + s_suppkey*613 % 6000 AS x, 248800 + s_suppkey*389 % 600 AS y,
    40 + s_suppkey % 7 * 30 AS w, 4 + s_suppkey % 5 * 2 AS h, s_suppkey % 4 AS fault FROM supplier),
  rectangles AS (SELECT id, name, 0 AS part, 0 AS ring, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM yards WHERE form < 4
    UNION ALL SELECT id, name, 0, 1, x + 10, y + 1, x + w - 10, y + h - 1 FROM yards WHERE form IN (0, 3)
    UNION ALL SELECT id, name, 1, 0, x + w + 50, y, x + 2*w + 50, y + h FROM yards WHERE form = 1
    UNION ALL SELECT id, name, 1, 1, x + w + 60, y + 1, x + 2*w + 40, y + h - 1 FROM yards WHERE form = 1
    UNION ALL SELECT id, name, 1, 0, x + 20, y + 2, x + 20 + w, y + 2 + h FROM yards WHERE form = 2)"""

_ON_EDGE = """p.lng BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.lat BETWEEN least(y1, y2) AND greatest(y1, y2)
    AND (x2 - x1) * (p.lat - y1) - (y2 - y1) * (p.lng - x1) = 0"""
_CROSSES = "(y1 > p.lat) <> (y2 > p.lat) AND p.lng < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1"
_SX, _SY = f"(cos(radians(p.lat)) * {S.METRES_PER_DEGREE_LNG})", f"{S.METRES_PER_DEGREE_LAT}"


def sited(points: str = "readings") -> list[str]:
    """CTEs: ``tested`` (point, fence, inside, on_edge, edge_m), ``covering`` and ``zone``."""
    return [_edges(), _fences(), f"""legs AS (SELECT p.id, fence_id, {_CROSSES} AS crosses, {_ON_EDGE} AS touches,
      (x1 - p.lng) * {_SX} AS ax, (y1 - p.lat) * {_SY} AS ay, (x2 - x1) * {_SX} AS dx, (y2 - y1) * {_SY} AS dy
      FROM {points} p CROSS JOIN edges WHERE p.lat IS NOT NULL AND p.lng IS NOT NULL),
  feet AS (SELECT *, least(1, greatest(0, -(ax*dx + ay*dy) / (dx*dx + dy*dy))) AS t FROM legs),
  tested AS (SELECT id, fence_id, sum(crosses::INT) % 2 = 1 AS inside, bool_or(touches) AS on_edge,
      min(sqrt((ax + t*dx) * (ax + t*dx) + (ay + t*dy) * (ay + t*dy))) AS edge_m FROM feet GROUP BY 1, 2),
  covering AS (SELECT id, fence_id, fence_name, area FROM tested JOIN fences USING (fence_id) WHERE inside OR on_edge)"""]


def zone(priority: str = "area") -> str:
    rank = "area, fence_id" if priority == "area" else "fence_id"
    return f"""zone AS (SELECT id, fence_name AS zone FROM (SELECT *, row_number() OVER
      (PARTITION BY id ORDER BY {rank}) AS rank FROM covering) WHERE rank = 1)"""


def steps(buffer_m: float, priority: str = "area") -> list[str]:
    """CTEs ending in ``moves``: each reading with zone before and after, by hysteresis."""
    upto = "PARTITION BY vehicle_id ORDER BY event_timestamp, id ROWS UNBOUNDED PRECEDING"
    return [*sited(), zone(priority), f"""near AS (SELECT id, fence_name FROM tested JOIN fences USING (fence_id)
      WHERE edge_m <= {buffer_m} AND NOT inside AND NOT on_edge),
  raws AS (SELECT r.*, z.zone AS raw FROM readings r LEFT JOIN zone z USING (id)),
  lasts AS (SELECT *, last_value(raw IGNORE NULLS) OVER ({upto}) AS last_raw, count(raw) OVER ({upto}) AS seg FROM raws),
  marks AS (SELECT l.*, (raw IS NULL AND n.id IS NULL)::INT AS away FROM lasts l
      LEFT JOIN near n ON n.id = l.id AND n.fence_name = l.last_raw),
  brokes AS (SELECT *, max(away) OVER (PARTITION BY vehicle_id, seg ORDER BY event_timestamp, id
      ROWS UNBOUNDED PRECEDING) AS broke FROM marks),
  currents AS (SELECT *, CASE WHEN raw IS NOT NULL THEN raw WHEN broke = 0 THEN last_raw END AS zone_now FROM brokes),
  moves AS (SELECT *, lag(zone_now) OVER (PARTITION BY vehicle_id ORDER BY event_timestamp, id) AS zone_before FROM currents),
  zone_names AS (SELECT id, string_agg(fence_name, ', ' ORDER BY fence_name) AS all_zones, count(*) AS zone_count
      FROM covering GROUP BY id HAVING count(*) > 1),
  zone_alerts AS (SELECT m.id, vehicle_id, CASE WHEN zone_now IS NULL THEN 'GEOFENCE_EXIT' ELSE 'GEOFENCE_ENTER' END AS alert_type,
      event_timestamp AS detected_at, lat, lng, coalesce(zone_now, zone_before) AS zone,
      CASE WHEN zone_now IS NULL THEN 'exited' ELSE 'entered' END AS action, all_zones, zone_count
      FROM moves m LEFT JOIN zone_names n ON n.id = m.id
      WHERE (zone_now IS NOT NULL AND zone_now IS DISTINCT FROM zone_before) OR (zone_now IS NULL AND zone_before IS NOT NULL))"""]


def idle(threshold: str, idle_speed: float) -> str:
    """CTEs ending in ``idles``: one alert per idle spell."""
    return f"""spells AS (SELECT *, sum((speed_kph > {idle_speed})::INT) OVER (PARTITION BY vehicle_id
      ORDER BY event_timestamp, id ROWS UNBOUNDED PRECEDING) AS spell FROM readings WHERE speed_kph IS NOT NULL),
  stays AS (SELECT *, min(event_timestamp) OVER (PARTITION BY vehicle_id, spell) AS first_idle_at FROM spells
      WHERE speed_kph <= {idle_speed}),
  idles AS (SELECT * FROM stays WHERE event_timestamp - first_idle_at >= INTERVAL '{threshold}'
      QUALIFY row_number() OVER (PARTITION BY vehicle_id, spell ORDER BY event_timestamp, id) = 1)"""


STATUS = f"""newest AS (SELECT * FROM readings WHERE event_timestamp <= {AS_OF}
      QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_timestamp DESC, id DESC) = 1),
  aged AS (SELECT vehicle_id, lat AS last_lat, lng AS last_lng, speed_kph AS last_speed, event_timestamp AS last_seen,
      (epoch_us({AS_OF}) - epoch_us(event_timestamp)) / 60000000.0::DOUBLE AS age FROM newest)"""


def service_status(idle_minutes: float = 10, offline_minutes: float = 30) -> str:
    return (f"CASE WHEN trunc(age) > {offline_minutes} THEN 'OFFLINE' WHEN last_speed <= 1 OR trunc(age) > {idle_minutes} "
            "THEN 'IDLE' ELSE 'ONLINE' END")


DASHBOARD_STATUS = "CASE WHEN age > 30 THEN 'OFFLINE' WHEN age > 10 OR last_speed < 5 THEN 'IDLE' ELSE 'ONLINE' END"
BACKFILL_STATUS = "CASE WHEN age <= 1 THEN 'ONLINE' WHEN age <= 5 THEN 'IDLE' ELSE 'OFFLINE' END"

_HALF = "pow(sin(radians({b} - {a}) / 2), 2)"


def haversine_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"({_HALF.format(a=lat1, b=lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {_HALF.format(a=lng1, b=lng2)})")
    return f"(12742 * atan2(sqrt({a}), sqrt(1 - {a})))"


LAGS = """lags AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(event_timestamp) OVER w AS at0
      FROM readings WINDOW w AS (PARTITION BY vehicle_id ORDER BY event_timestamp, id))"""


def windowed(seconds: int) -> str:
    """CTEs ending in ``stats``: figures per vehicle and tumbling window."""
    slot = lambda t: f"epoch_us({t}) // {seconds * 1_000_000}"
    leg = haversine_km("lat0", "lng0", "lat", "lng")
    return f"""{LAGS}, slots AS (SELECT *, {slot('event_timestamp')} AS slot,
      CASE WHEN {slot('at0')} = {slot('event_timestamp')} THEN {leg} ELSE 0 END AS leg FROM lags),
  stats AS (SELECT vehicle_id, make_timestamp(slot * {seconds * 1_000_000}) AS window_start,
      make_timestamp((slot + 1) * {seconds * 1_000_000}) AS window_end,
      round(avg(coalesce(speed_kph, 0)), 9) AS avg_speed, max(coalesce(speed_kph, 0)) AS max_speed,
      round(sum(leg), 6) AS total_distance, count(*) AS reading_count FROM slots GROUP BY vehicle_id, slot)"""


def select(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
