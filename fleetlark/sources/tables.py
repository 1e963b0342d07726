"""

``events`` becomes readings, alerts and the raw GPS messages; ``supplier`` becomes a
large set of depot geofences. Every row of the input is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.functions.geo import closed
from fleetlark.session import prepare

# Read as TIMESTAMP, not TIMESTAMP_NTZ, so that time filters reach the parquet scan.
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

# The site geofences, as name and (lng, lat) corners in ring order.
SITE_FENCES = {
    1: ("Warehouse A", [(67.01, 24.89), (67.02, 24.89), (67.02, 24.90), (67.01, 24.90)]),
    2: ("Delivery Zone", [(67.03, 24.91), (67.04, 24.91), (67.04, 24.92), (67.03, 24.92)]),
    3: ("Port District", [(67.0, 24.88), (67.03, 24.88), (67.03, 24.90), (67.015, 24.90),
                          (67.015, 24.93), (67.0, 24.93)]),
    4: ("Triangle Yard", [(67.03, 24.93), (67.05, 24.93), (67.04, 24.90)]),
    5: ("Dock 7", [(67.002, 24.881), (67.006, 24.881), (67.006, 24.886), (67.002, 24.886)]),
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


_NUMBER = "CAST(user_id AS string)"
_VEHICLE = f"concat('VH-', lpad({_NUMBER}, greatest(4, length({_NUMBER})), '0'))"
_LAT = "(248800 + (event_id * 7919 + user_id * 104729) % 600) / 10000D"
_LNG = "(6700000 + (event_id * 6101 + user_id * 15485863) % 6000) / 100000D"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings table; every 71st row still lacks its location point."""
    return events(spark, sf_dir).selectExpr(
        "event_id AS id", f"{_VEHICLE} AS vehicle_id", f"{_LAT} AS lat", f"{_LNG} AS lng",
        f"CASE WHEN event_id % 71 != 0 THEN struct({_LNG} AS lng, {_LAT} AS lat) END AS location",
        "value AS speed_kph", "CAST(event_id * 37 % 360 AS double) AS heading",
        "ts AS event_timestamp", "ts AS created_at")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": S.SPEEDING, "view": S.GEOFENCE_ENTER, "signup": S.GEOFENCE_EXIT, "purchase": S.IDLE}
    cases = " ".join(f"WHEN '{kind}' THEN '{alert}'" for kind, alert in kinds.items())
    return events(spark, sf_dir).selectExpr(
        "event_id AS id", f"{_VEHICLE} AS vehicle_id", f"CASE event_type {cases} ELSE 'UNKNOWN' END AS alert_type",
        "props AS details", "ts AS detected_at", f"{_LAT} AS lat", f"{_LNG} AS lng")


def gps_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages, some of them broken: cut off, without latitude, without time,
    or with an identifier that is too long."""
    body = """named_struct(
        'vehicleId', IF(id % 101 = 0, rpad(vehicle_id, 60, 'X'), vehicle_id), 'lat', IF(id % 89 != 0, lat, NULL),
        'lng', lng, 'speedKph', speed_kph, 'heading', heading,
        'timestamp', IF(id % 83 != 0, date_format(event_timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), NULL))"""
    return (readings(spark, sf_dir).selectExpr("id", "event_timestamp", "vehicle_id", f"to_json({body}) AS text")
            .selectExpr("vehicle_id AS key", "IF(id % 97 = 0, left(text, 40), text) AS value",
                        "'vehicle-gps' AS topic", "CAST(id % 3 AS int) AS partition",
                        "floor(id / 3) AS offset", "event_timestamp AS received_at"))


def site_fences(spark: SparkSession) -> DataFrame:
    """The five site geofences with closed rings."""
    rows = [(fid, name, [{"lng": x, "lat": y} for x, y in corners])
            for fid, (name, corners) in SITE_FENCES.items()]
    frame = prepare(spark).createDataFrame(rows, "id long, name string, ring array<struct<lng:double,lat:double>>")
    return frame.withColumn("ring", F.expr(closed("ring")))


def depot_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON text per supplier, in turn a Feature, a bare Polygon and a
    FeatureCollection; the rings of some are open."""
    key = F.col("s_suppkey")
    x, y = 6700000 + key * 613 % 6000, 248800 + key * 389 % 600
    width, height = 40 + key % 7 * 30, 3 + key % 5 * 2
    corner = lambda cx, cy: F.concat(
        F.lit("["), (cx / F.lit(100000.0)).cast("string"), F.lit(","), (cy / F.lit(10000.0)).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", corner(x, y), corner(x + width, y), corner(x + width, y + height), corner(x, y + height),
                       F.when(key % 2 == 0, corner(x, y)))
    polygon = F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), polygon, F.lit("}"))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    return prepare(spark).read.parquet(f"{sf_dir}/supplier.parquet").select(
        key.cast("long").alias("id"),
        F.concat(F.lit("Depot "), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, feature).when(key % 3 == 1, polygon).otherwise(collection).alias("polygon_geojson"))


def yard_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON text per supplier, in turn: a Feature with a hole, a MultiPolygon of which one has a hole, a
    FeatureCollection of two overlapping features and a point, a GeometryCollection with a line, and texts to be refused."""
    key = F.col("s_suppkey")
    x, y = 6700000 + key * 613 % 6000, 248800 + key * 389 % 600
    width, height = 40 + key % 7 * 30, 4 + key % 5 * 2
    number = lambda v, by: (v / F.lit(by)).cast("string")

    def ring(x, y, width, height):
        corners = ((x, y), (x + width, y), (x + width, y + height), (x, y + height))
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), number(cx, 100000.0), F.lit(","), number(cy, 10000.0), F.lit("]"))
                                                       for cx, cy in corners]), F.lit("]"))

    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    main, hole = ring(x, y, width, height), ring(x + 10, y + 1, width - 20, height - 2)
    apart, over = ring(x + width + 50, y, width, height), ring(x + 20, y + 2, width, height)
    polygon = lambda *rings: text('{"type":"Polygon","coordinates":[', F.concat_ws(",", *rings), "]}")
    feature = lambda shape: text('{"type":"Feature","properties":{"a":[1]},"geometry":', shape, "}")
    point, line = F.lit('{"type":"Point","coordinates":[67.0,24.9]}'), F.lit('{"type":"LineString","coordinates":[[67.0,24.9],[67.1,24.9]]}')
    forms = [
        feature(polygon(main, hole)),
        text('{"type":"MultiPolygon","coordinates":[[', main, "],[", apart, ",", ring(x + width + 60, y + 1, width - 20, height - 2), "]]}"),
        text('{"type":"FeatureCollection","features":[', feature(polygon(main)), ",", feature(point), ",", feature(polygon(over)), "]}"),
        feature(text('{"type":"GeometryCollection","geometries":[', line, ",", polygon(main, hole), "]}")),
        F.when(key % 4 == 0, feature(point)).when(key % 4 == 1, F.lit('{"type":"Polygon","coordinates":[[[67.0,24.9],[67.1,24.9]]]}'))
        .when(key % 4 == 2, F.lit('{"type":"Polygon","coordinates":[[[67.0,24.9],[67.1],[67.1,25.0]]]}')).otherwise(F.lit('{"type":"Polygon",')),
    ]
    chosen = F.element_at(F.array(*forms), (key % len(forms) + 1).cast("int"))
    return prepare(spark).read.parquet(f"{sf_dir}/supplier.parquet").select(
        key.cast("long").alias("id"), F.concat(F.lit("Yard "), key.cast("string")).alias("name"), chosen.alias("polygon_geojson"))
