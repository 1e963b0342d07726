"""Hand-written cases with expected rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.functions import geo
from fleetlark.functions import values as V
from fleetlark.operators import detect, lookups, maintain, reports, spatial, zones
from fleetlark.sources import geofences, gps

START = datetime(2024, 3, 1, 12)
INSIDE_1, INSIDE_2, FAR = (24.895, 67.015), (24.915, 67.035), (24.86, 67.08)
JUST_OUTSIDE_1 = (24.90 + 5 / S.METRES_PER_DEGREE_LAT, 67.018)
NOW = "2024-03-01 12:00:00"


def history(spark, steps, vehicle="V1"):
    """Readings from (minutes, speed, position) steps."""
    rows = []
    for n, (minutes, speed, position) in enumerate(steps):
        lat, lng = position or (None, None)
        rows.append((n, vehicle, lat, lng, None, speed, 0.0, START + timedelta(minutes=minutes), START))
    return spark.createDataFrame(rows, S.READING)


def minutes_of(found):
    return [(r.detected_at - START).total_seconds() / 60 for r in found.orderBy("detected_at").collect()]


def test_speeding_is_strict_and_ignores_null(spark):
    found = detect.speeding_alerts(history(spark, [(0, 80.0, FAR), (1, 80.01, FAR), (2, None, FAR)])).collect()
    assert [r.id for r in found] == [1]
    assert found[0].excess == pytest.approx(0.01)


@pytest.mark.parametrize("large_rows", [None, 2])
@pytest.mark.parametrize("steps, expected", [
    ([(0, 0.0), (119 / 60, 1.0), (2, 0.0), (125 / 60, 0.0)], [2]),
    ([(0, 0.0), (1, None), (2, 0.0)], [2]),
    ([(0, 0.0), (1, 1.01), (1.5, 0.0), (3, 0.0), (3.5, 0.0)], [3.5]),
    ([(0, 0.0), (3, 0.0), (4, 50.0), (5, 0.0), (8, 0.0), (9, 0.0)], [3, 8]),
    ([(0, 0.0), (30, 1.0)], [30]),
])
def test_idle_spells(spark, steps, expected, large_rows):
    readings = history(spark, [(m, speed, FAR) for m, speed in steps])
    assert minutes_of(detect.idle_alerts(readings, large_rows=large_rows)) == pytest.approx(expected)


def test_idle_minutes_threshold_and_elapsed(spark):
    readings = history(spark, [(0, 0.0, FAR), (7.5, 0.0, FAR)])
    assert detect.idle_alerts(readings).first().idle_minutes == 2
    assert detect.idle_alerts(readings, minutes="elapsed").first().idle_minutes == 7


ENTER1, EXIT1, ENTER2 = ("GEOFENCE_ENTER", "Warehouse A"), ("GEOFENCE_EXIT", "Warehouse A"), ("GEOFENCE_ENTER", "Delivery Zone")


@pytest.mark.parametrize("large_rows", [None, 2])
@pytest.mark.parametrize("route, expected", [
    ([FAR, INSIDE_1, INSIDE_1, FAR], [ENTER1, EXIT1]),
    ([INSIDE_1, JUST_OUTSIDE_1, INSIDE_1], [ENTER1]),
    ([INSIDE_1, JUST_OUTSIDE_1, FAR, JUST_OUTSIDE_1], [ENTER1, EXIT1]),
    ([INSIDE_1, INSIDE_2], [ENTER1, ENTER2]),
    ([INSIDE_1, None, INSIDE_1], [ENTER1]),
    ([JUST_OUTSIDE_1, FAR], []),
])
def test_zone_changes(spark, fences, route, expected, large_rows):
    readings = history(spark, [(n, 30.0, position) for n, position in enumerate(route)])
    found = detect.geofence_alerts(readings, fences.where("id < 3"), large_rows=large_rows)
    assert [(r.alert_type, r.zone) for r in found.orderBy("id").collect()] == expected


def test_overlap_prefers_the_smaller_zone_and_lists_both(spark, fences):
    readings = history(spark, [(0, 30.0, (24.895, 67.015))])
    found = detect.geofence_alerts(readings, fences).first()
    assert (found.zone, found.overlapping_zones, found.zone_count) == ("Warehouse A", ["Port District", "Warehouse A"], 2)
    by_id = spatial.first_zone(history(spark, [(0, 1.0, (24.883, 67.004))]), fences).first()
    by_area = spatial.assign_zone(history(spark, [(0, 1.0, (24.883, 67.004))]), fences).first()
    assert (by_id.zone, by_area.zone) == ("Port District", "Dock 7")


def test_boundary_vertex_inside_and_notch(spark, fences):
    places = {"edge": (24.89, 67.0), "vertex": (24.88, 67.0), "inside": (24.885, 67.02), "notch": (24.915, 67.02)}
    points = spark.createDataFrame([(n, lat, lng) for n, (lat, lng) in places.items()], "id string, lat double, lng double")
    port = fences.where("id = 3").select("name", F.expr(geo.ring_edges("ring")).alias("edges"))
    tested = points.join(port).select("id", F.expr(geo.covers("edges", "lng", "lat")).alias("covers"),
                                      F.expr(geo.strictly_within("edges", "lng", "lat")).alias("within"))
    assert {r.id: (r.covers, r.within) for r in tested.collect()} == {
        "edge": (True, False), "vertex": (True, False), "inside": (True, True), "notch": (False, False)}


def test_distance_to_a_fence(spark, fences):
    points = history(spark, [(0, 1.0, JUST_OUTSIDE_1), (1, 1.0, INSIDE_1)])
    rows = spatial.within_distance_join(points, fences.where("id = 1"), 6).orderBy("id").collect()
    assert [r.distance_m for r in rows] == pytest.approx([5.0, 0.0], abs=1e-6)
    assert spatial.within_distance_join(points, fences.where("id = 1"), 4.9).count() == 1


@pytest.mark.parametrize("rule, minutes, speed, expected", [
    ("service", 30, 50.0, "IDLE"), ("service", 31, 50.0, "OFFLINE"), ("service", 30.9, 50.0, "IDLE"),
    ("service", 0, 1.0, "IDLE"), ("service", 10, 50.0, "ONLINE"), ("service", 11, 50.0, "IDLE"),
    ("service", None, 50.0, "OFFLINE"), ("service", 0, None, "ONLINE"),
    ("dashboard", 30.5, 50.0, "OFFLINE"), ("dashboard", 10.5, 50.0, "IDLE"), ("dashboard", 0, 4.9, "IDLE"),
    ("dashboard", 0, 5.0, "ONLINE"),
    ("backfill", 1, 50.0, "ONLINE"), ("backfill", 5, 50.0, "IDLE"), ("backfill", 6, 50.0, "OFFLINE"),
])
def test_status_rules(spark, rule, minutes, speed, expected):
    seen = None if minutes is None else START - timedelta(minutes=minutes)
    table = spark.createDataFrame([("V1", 1.0, 1.0, speed, seen, None, None)], S.STATUS)
    assert detect.classify(table, NOW, rule).first().status == expected


def test_backfill_leaves_known_statuses(spark):
    table = spark.createDataFrame([("V1", 1.0, 1.0, 1.0, START, "OFFLINE", None)], S.STATUS)
    assert detect.classify(table, NOW, "backfill").first().status == "OFFLINE"
    assert [(r.old_status, r.new_status) for r in detect.status_changes(table, NOW).collect()] == [("OFFLINE", "IDLE")]


def test_type_normalisation(spark):
    table = spark.createDataFrame([("speeding",), (None,), ("foo",), ("GEOFENCE_EXIT",), ("idle",)], "alert_type string")
    rows = detect.normalize_type(table).collect()
    assert [(r.normal_type, r.alert_group) for r in rows] == [
        ("SPEEDING", "SPEEDING"), ("SPEEDING", "SPEEDING"), ("SPEEDING", "SPEEDING"), ("GEOFENCE_EXIT", "GEOFENCE"), ("IDLE", "IDLE")]


def test_age_texts_and_labels(spark):
    ages = [0.5, 5, 60, 1440, None]
    rows = [(f"V{n}", 1.0, 1.0, 50.0, None if a is None else START - timedelta(minutes=a), status, None)
            for n, (a, status) in enumerate(zip(ages, ["ONLINE", "IDLE", "OFFLINE", "PARKED", None]))]
    shown = detect.status_view(spark.createDataFrame(rows, S.STATUS), NOW).orderBy("vehicle_id").collect()
    assert [r.time_since_last_update for r in shown] == ["Just now", "5 min ago", "1 hr ago", "1 days ago", "Never"]
    assert [(r.status_color, r.status_text) for r in shown] == [
        ("green", "Online"), ("orange", "Idle"), ("red", "Offline"), ("gray", "Unknown"), ("red", "Offline")]


def test_routing_and_dead_letters(spark):
    good = '{"vehicleId":"TRK-04","lat":24.8899,"lng":67.0282,"speedKph":55.4,"heading":120,"timestamp":"2025-12-29T10:30:00"}'
    texts = [good, '{"vehicleId":', '{"vehicleId":"A","lng":1.0,"timestamp":"2025-12-29T10:30:00"}',
             '{"vehicleId":"A","lat":1.0,"lng":1.0}', good.replace("TRK-04", "X" * 51), None, "[]", good.replace("24.8899", '"north"')]
    frame = spark.createDataFrame([("k", t, "vehicle-gps", 1, n) for n, t in enumerate(texts)],
                                  "key string, value string, topic string, partition int, offset long")
    routed = gps.route_events(gps.parse_gps(frame)).orderBy("offset")
    assert [r.error_type for r in routed.collect()] == [
        None, "ProcessingError", "InvalidPayload", "ProcessingError", "ProcessingError", "ProcessingError",
        "ProcessingError", "ProcessingError"]
    stored = gps.to_readings(routed).collect()
    assert len(stored) == 1 and stored[0].location.lng == 67.0282 and stored[0].event_timestamp == datetime(2025, 12, 29, 10, 30)
    letter = gps.to_dlq(routed, "2024-01-01 00:00:00").where("payload like '%lng%' and payload not like '%lat%'").first()
    assert letter.headers == {
        "dlq-original-topic": "vehicle-gps", "dlq-original-partition": "1", "dlq-original-offset": "2",
        "dlq-error-type": "InvalidPayload", "dlq-error-message": "Missing required fields: vehicleId, lat, or lng",
        "dlq-failed-at": "1704067200000", "dlq-original-payload-length": str(len(letter.payload))}


def test_event_time_with_zone(spark):
    text = '{"vehicleId":"A","lat":1,"lng":2,"timestamp":"2025-12-29T10:30:00Z"}'
    row = gps.parse_gps(spark.createDataFrame([(text,)], "value string")).first()
    assert (row.timestamp, row.lat, row.malformed) == (datetime(2025, 12, 29, 10, 30), 1.0, False)


def test_geojson_kinds(spark):
    ring = "[67.01,24.89],[67.02,24.89],[67.02,24.90],[67.01,24.90]"
    polygon = '{"type":"Polygon","coordinates":[[%s]]}'
    texts = ['{"type":"Feature","geometry":' + polygon % ring + "}", polygon % (ring + ",[67.01,24.89]"),
             '{"type":"FeatureCollection","features":[{"geometry":' + polygon % ring + "}]}", "{}", "not json", None]
    frame = spark.createDataFrame([(n, f"F{n}", t) for n, t in enumerate(texts)], "id long, name string, polygon_geojson string")
    rings = [r.ring for r in geofences.load_geofences(frame).orderBy("id").collect()]
    assert len(rings[0]) == 5 and rings[0][0] == rings[0][-1]
    assert rings[0] == rings[1] == rings[2] and rings[3:] == [None, None, None]


def _square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]


def _loaded(spark, documents):
    texts = [(n, f"F{n}", d if d is None or isinstance(d, str) else json.dumps(d)) for n, d in enumerate(documents)]
    return spark.createDataFrame(texts, "id long, name string, polygon_geojson string")


def test_holes_and_several_polygons(spark):
    holed = {"type": "Polygon", "coordinates": [_square(0, 0, 10), _square(4, 4, 2)]}
    island = {"type": "MultiPolygon", "coordinates": [holed["coordinates"], [_square(4.5, 4.5, 1)]]}
    overlapping = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [_square(x, 0, 6)]}}
                                                             for x in (0, 3)]}
    fences = geofences.load_geofences(_loaded(spark, [holed, island, overlapping]))
    spots = {"middle": (5.0, 5.0), "hole": (4.2, 4.2), "hole's edge": (4.0, 5.0), "solid": (1.0, 1.0), "both": (4.0, 1.0), "outside": (11.0, 1.0)}
    points = spark.createDataFrame([(k, *v) for k, v in spots.items()], "id string, lng double, lat double")
    expected = {"middle": ["F1", "F2"], "hole": ["F2"], "hole's edge": ["F0", "F1", "F2"], "solid": ["F0", "F1", "F2"], "both": ["F0", "F1", "F2"],
                "outside": []}
    found = {r.id: r for r in zones.with_zones(points, fences).collect()}
    assert {k: sorted(z.name for z in r.zones) for k, r in found.items()} == expected
    assert {z.name: z.area for z in found["solid"].zones} == {"F0": 96.0, "F1": 97.0, "F2": 72.0}
    pairs = sorted((r.id, r.fence_name) for r in spatial.covers_join(points, fences).collect())
    assert pairs == sorted((k, f) for k, names in expected.items() for f in names)
    near = {(r.id, r.fence_name): r.distance_m for r in spatial.within_distance_join(points, fences, 30_000).collect()}
    assert near["hole", "F0"] == pytest.approx(0.2 * 110574, rel=0.02) and near["hole's edge", "F0"] == 0
    assert ("middle", "F0") not in near and near["middle", "F1"] == 0


def test_a_crowd_of_holed_fences_has_the_same_zones(spark):
    fences = geofences.load_geofences(_loaded(spark, [{"type": "Polygon", "coordinates": [_square(0, 0, 0.01), _square(0.004, 0.004, 0.002)]}]
                                              * (zones.ARRAY_FENCES + 6)))
    points = spark.createDataFrame([(1, 0.005, 0.005), (2, 0.001, 0.001)], "id long, lng double, lat double")
    assert {r.id: len(r.zones) for r in zones.with_zones(points, fences).collect()} == {1: 0, 2: zones.ARRAY_FENCES + 6}


def test_refused_geofences(spark):
    polygon = lambda *rings: {"type": "Polygon", "coordinates": list(rings)}
    texts = [None, "not json", "[1]", "{}", {"type": "Point", "coordinates": [1, 2]}, polygon([[0, 0], [1, 1]]), polygon([[0, 0], [1, 1], [0, 0]]),
             polygon(_square(0, 0, 3), [[1, 1], [2, 2]]), polygon([[0, 0], [1], [1, 1], [0, 1]]), polygon(), {"type": "Polygon", "coordinates": "x"},
             {"type": "MultiPolygon", "coordinates": [[_square(0, 0, 1)], [[]]]}, {"type": "FeatureCollection", "features": []},
             {"type": "Feature", "geometry": None}, polygon([[0, 0], ["a", 1], [1, 1], [0, 1]])]
    frame = _loaded(spark, texts)
    refused = {r.id: r.reason for r in geofences.refused_geofences(frame).collect()}
    g = geofences
    assert refused == dict(enumerate([g.NOT_JSON, g.NOT_JSON, g.NOT_JSON, g.NO_POLYGON, g.NO_POLYGON, g.FEW_CORNERS, g.FEW_CORNERS, g.FEW_CORNERS,
                                      g.NO_POSITION, g.UNREADABLE, g.UNREADABLE, g.FEW_CORNERS, g.NO_POLYGON, g.NO_POLYGON, g.UNREADABLE]))
    assert all(r.ring is None and r.polygons is None for r in geofences.load_geofences(frame).collect())


def test_duplicate_geofence_names_are_refused(spark, fences):
    twice = fences.unionByName(fences.withColumn("id", F.col("id") + 100))
    with pytest.raises(Exception, match="geofence name is not unique"):
        geofences.require_unique_names(twice).collect()


def test_reading_report(spark):
    readings = history(spark, [(0, 10.0, FAR), (1, None, FAR), (2, 20.005, FAR)])
    full = reports.reading_report(readings, "V1", START, START + timedelta(hours=1), limit=2).first()
    assert (full.average_speed, full.max_speed, full.total_count, full.returned_count) == (15.0, 20.01, 3, 2)
    none = reports.reading_report(readings, "V2", START, START + timedelta(hours=1)).first()
    assert (none.average_speed, none.max_speed, none.total_count) == (0.0, 0.0, 0)


def test_windowed_stats(spark):
    steps = [(0, 10.0, (24.90, 67.00)), (1, None, (24.91, 67.00)), (2, 20.0, (24.92, 67.00)), (6, 5.0, (24.90, 67.00))]
    rows = reports.vehicle_stats(history(spark, steps)).orderBy("window_start").collect()
    assert [(r.reading_count, r.avg_speed, r.max_speed) for r in rows] == [(3, 10.0, 20.0), (1, 5.0, 5.0)]
    leg = 6371 * 0.01 * 3.141592653589793 / 180
    assert [r.total_distance for r in rows] == pytest.approx([2 * leg, 0.0])


def test_messages_are_parsed_once(spark):
    routed = gps.route_events(gps.parse_gps(spark.createDataFrame([("k", "{}", "t", 0, 1)], "key string, value string, topic string, partition int, offset long")))
    for frame in (gps.to_dlq(routed, NOW), gps.to_readings(routed)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_fences_of_one_name_or_none(spark, readings):
    square = "{'type':'Polygon','coordinates':[[[%s,0],[%s,0],[%s,1],[%s,1]]]}"
    texts = [(1, "a", (square % (0, 1, 1, 0)).replace("'", '"')), (2, "a", (square % (0, 2, 2, 0)).replace("'", '"')),
             (3, None, (square % (4, 5, 5, 4)).replace("'", '"'))]
    fences = geofences.load_geofences(spark.createDataFrame(texts, "id long, name string, polygon_geojson string"))
    assert sorted(r.id for r in geofences.require_unique_names(fences.where("id <> 2")).collect()) == [1, 3]
    with pytest.raises(Exception, match="not unique"):
        geofences.require_unique_names(fences).collect()
    alerts = spark.createDataFrame([(n, lng, 0.5, NOW) for n, lng in ((7, 0.5), (7, 0.5), (8, 1.5), (9, 3.0))],
                                   "id long, lng double, lat double, detected_at string").withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    assert [r.id for r in spatial.alerts_within_geofence(alerts, fences, "a", NOW).collect()] == [8, 7, 7]


def test_empty_tables(spark):
    alerts, status = spark.createDataFrame([], S.ALERT), spark.createDataFrame([], S.STATUS)
    stats = reports.fleet_stats(status, alerts, NOW).first()
    assert tuple(stats) == (0, 0, 0.0, 0)
    assert tuple(reports.dashboard_stats(status, alerts, NOW).first()) == (0, 0, 0, 0, 0)
    assert [tuple(r) for r in reports.alert_history_totals(alerts, START, START).orderBy("scope").collect()] == [
        ("returned", "all", 0), ("total", "all", 0)]


def alert_table(spark):
    rows = [(n, vehicle, kind, "{}", START + timedelta(minutes=n), 1.0, 1.0)
            for n, (vehicle, kind) in enumerate([("A", "IDLE"), ("A", "SPEEDING"), ("B", "IDLE"), ("B", None), ("C", "IDLE")])]
    return spark.createDataFrame(rows, S.ALERT)


def test_deletes(spark):
    alerts = alert_table(spark)
    left = lambda deletion: sorted(r.id for r in deletion.remaining.collect())
    assert left(maintain.delete_filtered(alerts, "A", "IDLE")) == [1, 2, 3, 4]
    assert left(maintain.delete_filtered(alerts, "A", "IDLE", compat=True)) == [2, 3, 4]
    assert left(maintain.delete_filtered(alerts, type="idle")) == [1, 3]
    assert left(maintain.delete_ids(alerts, [0, 99])) == [1, 2, 3, 4]
    assert maintain.delete_ids(alerts, [0, 99]).deleted_count() == 1
    assert maintain.delete_id(alerts, 99).counts().first().deleted_count == 0
    assert left(maintain.delete_newest(alerts, 2)) == [0, 1, 2]
    assert left(maintain.delete_all(alerts, confirm=True)) == []
    with pytest.raises(ValueError):
        maintain.delete_all(alerts)
    with pytest.raises(ValueError):
        maintain.delete_filtered(alerts, type="all")


def test_alert_texts(spark):
    rows = [(1, "A", "SPEEDING", '{"speedKph":95.6,"threshold":80.0}', START, 1.0, 1.0),
            (2, "A", "GEOFENCE_EXIT", '{"zone":"Yard","action":"exited"}', START, 1.0, 1.0),
            (3, "A", "IDLE", '{"idleMinutes":4}', START, 1.0, 1.0),
            (4, "A", "GEOFENCE_ENTER", "broken", START, 1.0, 1.0)]
    shown = detect.alert_details(spark.createDataFrame(rows, S.ALERT)).orderBy("id").collect()
    assert [r.message for r in shown] == ["Exceeded speed limit by 16.00 kph", "Exited Yard", "Idle for 4 minutes", "Exited Unknown"]
    assert [r.detail for r in shown] == ["95.60 km/h", "Yard", "4 min", "Unknown"]


def test_radius_box_near_the_pole_gives_way():
    assert geo.radius_box(89.9999, 0.0, 1000) is None
    assert geo.radius_box(0.0, 179.9999, 1000) is None


def test_presets(spark):
    bounds = spark.range(1).select(*lookups.preset_range("6h", "2024-03-01 12:34:56")).first()
    assert tuple(bounds) == (datetime(2024, 3, 1, 6, 34), datetime(2024, 3, 1, 12, 34))
    with pytest.raises(ValueError):
        lookups.preset_range("2h", NOW)


def test_spans():
    assert V.seconds_of("2 minutes") == 120 and V.micros_of("1 day") == 86_400_000_000
    with pytest.raises(ValueError):
        V.seconds_of("soon")
