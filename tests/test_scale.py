"""Paths that small data does not take by itself, and the shape of plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.operators import detect, reports, spatial, zones
from fleetlark.plans import catalog
from fleetlark.sources import geofences, tables


@pytest.fixture(scope="module")
def skewed(spark):
    """One vehicle holds most rows, with ties in time, gaps, nulls and idle stretches."""
    rng = random.Random(5)
    rows, at = [], datetime(2024, 1, 1)
    for n in range(900):
        at += timedelta(seconds=rng.choice([0, 20, 45, 4000]))
        known = rng.random() > 0.1
        # Near the edge of Warehouse A, so that the buffer matters.
        lat, lng = 24.895 + rng.uniform(-0.0056, 0.0056), 67.015 + rng.uniform(-0.0056, 0.0056)
        rows.append((n, "HOT" if rng.random() < 0.8 else f"V{n % 7}", lat if known else None, lng if known else None, None,
                     rng.choice([None, 0.0, 0.5, 1.0, 1.0, 40.0]), 0.0, at, at))
    return spark.createDataFrame(rows, S.READING).repartition(3).cache()


def same(left, right):
    columns = left.columns
    assert left.count() == right.count()
    assert left.exceptAll(right.select(*columns)).count() == 0


@pytest.mark.parametrize("large_rows", [3, 40, 300])
def test_slicing_changes_nothing(skewed, fences, large_rows):
    same(detect.idle_alerts(skewed), detect.idle_alerts(skewed, large_rows=large_rows))
    same(detect.geofence_alerts(skewed, fences, 80), detect.geofence_alerts(skewed, fences, 80, large_rows=large_rows))
    same(detect.detect_alerts(skewed, fences, buffer_m=80), detect.detect_alerts(skewed, fences, buffer_m=80, large_rows=large_rows))
    rounded = lambda df: df.withColumns({c: F.round(c, 7) for c, t in df.dtypes if t == "double"})
    same(rounded(spatial.leg_distance(skewed).drop("location")), rounded(spatial.leg_distance(skewed, large_rows).drop("location")))
    same(rounded(reports.running_stats(skewed)), rounded(reports.running_stats(skewed, large_rows)))


def test_windowed_figures_are_shuffled_once_by_window_and_vehicle(skewed):
    text = reports.vehicle_stats(skewed, "1 hour")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(") == 1
    assert text.split("Exchange hashpartitioning(")[1].startswith("window#")


@pytest.mark.parametrize("window, large_rows", [("1 day", 3), ("1 day", 40), ("1 hour", 3), ("5 minutes", 300)])
def test_slicing_windowed_figures_changes_nothing(skewed, window, large_rows):
    rounded = lambda df: df.withColumns({c: F.round(c, 7) for c, t in df.dtypes if t == "double"})
    same(rounded(reports.vehicle_stats(skewed, window)), rounded(reports.vehicle_stats(skewed, window, large_rows)))


def test_a_vehicle_of_one_day_is_cut_into_slices(skewed):
    day = skewed.withColumn("event_timestamp", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id % 800 * 100)"))
    cut = reports.legs_within(day, "1 day", 100)
    text = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_window#" in text and "_slice#" in text.split("Exchange hashpartitioning(_window#")[1].split(")")[0]
    same(cut.withColumn("leg_km", F.round("leg_km", 7)), reports.legs_within(day, "1 day").withColumn("leg_km", F.round("leg_km", 7)))
    text = reports.legs_within(day, "1 day", 2000)._jdf.queryExecution().executedPlan().toString()
    assert "_slice#" not in text


def in_order(skewed):
    return sorted(skewed.collect(), key=lambda r: (r.vehicle_id, r.event_timestamp, r.id))


def test_idle_by_brute_force(skewed):
    expected, state = [], {}
    for r in in_order(skewed):
        if r.speed_kph is None:
            continue
        start, told = state.get(r.vehicle_id, (None, False))
        if r.speed_kph > 1.0:
            start, told = None, False
        else:
            start = start or r.event_timestamp
            if not told and r.event_timestamp - start >= timedelta(minutes=2):
                told = True
                expected.append(r.id)
        state[r.vehicle_id] = (start, told)
    found = [r.id for r in detect.idle_alerts(skewed, large_rows=50).collect()]
    assert sorted(found) == sorted(expected) and expected


def test_one_pass_finds_what_the_detectors_find(skewed, fences):
    together = detect.detect_alerts(skewed, fences, buffer_m=80)
    idle, zone = detect.idle_alerts(skewed), detect.geofence_alerts(skewed, fences, 80)
    apart = (detect.alert_rows(detect.speeding_alerts(skewed), detect.speeding_details())
             .unionByName(detect.alert_rows(idle, detect.idle_details()))
             .unionByName(detect.alert_rows(zone, detect.zone_details())))
    same(together, apart)


def test_zone_changes_by_brute_force(skewed, fences):
    looked = {r.id: r for r in zones.with_zones(skewed, fences, 80.0).collect()}
    expected, state = [], {}
    for r in in_order(skewed):
        if r.lat is None:
            continue
        point, before = looked[r.id], state.get(r.vehicle_id)
        now = point.zones[0].name if point.zones else (before if before in point.near else None)
        if now != before:
            expected.append((r.id, "GEOFENCE_ENTER" if now else "GEOFENCE_EXIT", now or before))
        state[r.vehicle_id] = now
    found = [(r.id, r.alert_type, r.zone) for r in detect.geofence_alerts(skewed, fences, 80.0, large_rows=50).collect()]
    assert sorted(found) == sorted(expected) and expected


@pytest.fixture(scope="module")
def depots(spark):
    return geofences.load_geofences(tables.depot_geojson(spark, "/root/testdata/sf0.01")).cache()


def test_all_ways_of_joining_fences_agree(readings, depots, monkeypatch):
    wanted = [c for c in readings.columns if c != "location"] + ["zones", "near"]
    usual = zones.with_zones(readings, depots, 60.0).select(*wanted)
    pairs = spatial.covers_join(readings, depots).select("id", "fence_id")
    monkeypatch.setattr(zones, "BROADCAST_BYTES", 0)
    same(usual, zones.with_zones(readings, depots, 60.0).select(*wanted))
    same(pairs, spatial.covers_join(readings, depots).select("id", "fence_id"))
    monkeypatch.setattr(zones, "ARRAY_FENCES", 0)
    regrouped = zones.with_zones(readings, depots, 60.0)
    sort = lambda df: df.select(*wanted).withColumn("near", F.sort_array("near"))
    same(sort(usual), sort(regrouped))


@pytest.mark.parametrize("dense", [64, 65])
def test_points_that_share_an_id_keep_their_own_zones(spark, dense):
    """Whatever the number of fences in a cell."""
    ring = [(10.0, 50.0), (10.001, 50.0), (10.001, 50.001), (10.0, 50.001), (10.0, 50.0)]
    fences = spark.createDataFrame([(n, f"f{n}", ring) for n in range(dense)], "id long, name string, ring array<struct<lng:double,lat:double>>")
    points = spark.createDataFrame([(1, 10.0005, 50.0005), (1, 80.0, 10.0), (1, None, 50.0), (None, 10.0005, 50.0005)],
                                   "id long, lng double, lat double")
    found = sorted((r.lng or 0.0, len(r.zones)) for r in zones.with_zones(points, fences).collect())
    assert found == [(0.0, 0), (10.0005, dense), (10.0005, dense), (80.0, 0)]


def test_fences_of_all_sizes(spark):
    """A tiny, a city-sized and a continent-sized fence, each on its own grid level."""
    squares = [(1, "dot", 10.0, 50.0, 0.004), (2, "city", 9.9, 49.9, 0.6), (3, "land", 0.0, 40.0, 30.0)]
    fences = spark.createDataFrame(
        [(n, name, [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]) for n, name, x, y, d in squares], "id long, name string, ring array<struct<lng:double,lat:double>>")
    assert zones.fence_index(fences).levels == (0, 2, 5)
    points = spark.createDataFrame([(1, 10.002, 50.002), (2, 10.3, 50.3), (3, 25.0, 60.0), (4, -5.0, 50.0), (5, None, None)],
                                   "id long, lng double, lat double")
    found = {r.id: [z.name for z in r.zones] for r in zones.with_zones(points, fences).collect()}
    assert found == {1: ["dot", "city", "land"], 2: ["city", "land"], 3: ["land"], 4: [], 5: []}
    assert spatial.covers_join(points, fences).count() == 6


def test_no_fences(spark, readings, fences):
    none = fences.where("id < 0")
    assert spatial.covers_join(readings, none).count() == 0
    assert spatial.assign_zone(readings, none).where("zone is not null").count() == 0
    assert detect.geofence_alerts(readings, none).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_joins(spark, sf, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


def test_time_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(catalog.QUERIES["e8_alerts_since_count"](spark, sf))
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp>" in plan


def test_geofence_history_is_shuffled_once(spark, readings, fences):
    detect_plan = detect.geofence_alerts(tables.readings(spark, "/root/testdata/sf0.001"), fences)
    detect_plan.collect()
    final = detect_plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("hashpartitioning(vehicle_id") <= 3


def test_crowded_fences_get_smaller_cells(spark):
    """40 small frames (squares with a hole) of 0.0002 degrees beside each other, twice: they shared one cell."""
    square = lambda x, y, side: "[" + ",".join(f"[{a},{b}]" for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y))) + "]"
    places = [(67.0001 + k % 8 * 0.0003, 24.0001 + k // 8 % 5 * 0.0003) for k in range(80)]
    texts = [(k, f"F{k}", '{"type":"MultiPolygon","coordinates":[[' + square(x, y, 0.0002) + "," + square(x + 0.00005, y + 0.00005, 0.0001) + "],["
              + square(x + 0.003, y, 0.0002) + "]]}") for k, (x, y) in enumerate(places)]
    fences = geofences.load_geofences(spark.createDataFrame(texts, "id long, name string, polygon_geojson string"))
    index = zones.fence_index(fences)
    assert index.sides[1:] == zones.CELL_SIDES and index.densest < 80
    index.release()
    spots = [(k, 67.0 + k % 61 * 0.0001 + 0.00002, 24.0 + k // 61 * 0.00005 + 0.00002) for k in range(61 * 40)]
    points = spark.createDataFrame(spots, "id long, lng double, lat double")
    within = lambda a, low, side: low < a < low + side
    want = {(k, n) for k, a, b in spots for n, (x, y) in enumerate(places) if within(b, y, 0.0002) and (
        within(a, x + 0.003, 0.0002) or within(a, x, 0.0002) and not (within(a, x + 0.00005, 0.0001) and within(b, y + 0.00005, 0.0001)))}
    found = [(r.id, r.fence_id) for r in spatial.covers_join(points, fences).collect()]
    assert len(found) == len(want) > 500 and set(found) == want


def test_fences_of_one_file_are_dealt_to_all_cores(spark):
    """The index was built where the fences' texts lay: in one task, for a table of one small file."""
    fences = spark.range(1).coalesce(1).selectExpr("explode(sequence(0, 99)) AS k").selectExpr(
        "CAST(k AS long) AS id", "'F' AS name", "transform(array(0D, 1D, 2D, 0D), a -> struct(67 + k / 10D + a AS lng, 24 + a * a AS lat)) AS ring")
    index = zones.fence_index(fences)
    assert index.cells.select(F.spark_partition_id()).distinct().count() > 1
    index.release()
