"""Streams against batch results: ordered files, restarts, late rows, ingest."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.operators import detect, reports
from fleetlark.sources import gps, tables
from fleetlark.streaming import jobs, sinks

ROWS = ["id", "vehicle_id", "alert_type", "details", "detected_at", "lat", "lng"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def same(left, right, columns):
    left, right = left.select(*columns), right.select(*columns)
    assert left.count() == right.count()
    assert left.exceptAll(right).count() == 0


def arrive(df, path):
    """One more file in the folder of a stream."""
    df.coalesce(1).write.mode("append").parquet(path)


def test_alerts_match_batch_over_a_restart(spark, readings, fences, folder):
    table = readings.select(*S.READING.names)
    options = dict(idle_speed=10, buffer_m=250)

    def run():
        stream = jobs.detect_stream(jobs.read_readings(spark, f"{folder}/in", 1), fences, **options)
        jobs.run_detection(stream, f"{folder}/alerts", f"{folder}/late", f"{folder}/checkpoint", True).awaitTermination()

    arrive(table.where("id < 300"), f"{folder}/in")
    run()
    arrive(table.where("id between 300 and 599"), f"{folder}/in")
    run()
    arrive(table.where("id >= 600"), f"{folder}/in")
    run()
    same(sinks.read_table(spark, f"{folder}/alerts"), detect.detect_alerts(readings, fences, **options), ROWS)


def reading(n, minute, speed, position):
    at = datetime(2024, 3, 1, 12) + timedelta(minutes=minute)
    return (n, "A", position[0], position[1], None, speed, 0.0, at, at)


def test_disorder_within_a_batch_is_sorted_and_later_rows_are_told(spark, fences, folder):
    inside, far = (24.895, 67.015), (24.86, 67.08)
    first = [reading(3, 6, 0.0, far), reading(1, 0, 0.0, inside), reading(2, 3, 0.0, inside)]
    second = [reading(4, 4, 50.0, inside), reading(5, 9, 50.0, far)]
    for rows in (first, second):
        arrive(spark.createDataFrame(rows, S.READING), f"{folder}/in")
        stream = jobs.detect_stateful(jobs.read_readings(spark, f"{folder}/in", 1), fences.where("id = 1"))
        jobs.run_detection(stream, f"{folder}/alerts", f"{folder}/late", f"{folder}/checkpoint", True).awaitTermination()
    stored = sinks.read_table(spark, f"{folder}/alerts").orderBy("detected_at", "alert_type").collect()
    assert [(r.id, r.alert_type) for r in stored] == [(1, "GEOFENCE_ENTER"), (2, "IDLE"), (3, "GEOFENCE_EXIT")]
    assert [r.id for r in sinks.read_table(spark, f"{folder}/late").collect()] == [4]


def test_windows_match_batch_once_closed(spark, readings, folder):
    table = readings.select(*S.READING.names)
    for low in (0, 500):
        arrive(table.where(f"id >= {low} and id < {low + 500}"), f"{folder}/in")
        stream = jobs.stats_stream(jobs.read_readings(spark, f"{folder}/in", 1), "1 day")
        jobs.run_stats(stream, f"{folder}/stats", f"{folder}/checkpoint", True).awaitTermination()
    rounded = lambda df: df.select("vehicle_id", "window_start", "window_end", F.round("avg_speed", 8).alias("avg_speed"),
                                   "max_speed", F.round("total_distance", 8).alias("total_distance"), "reading_count")
    last = readings.agg(F.max("event_timestamp")).first()[0] - timedelta(minutes=10)
    batch = reports.vehicle_stats(readings, "1 day").where(F.col("window_end") <= F.lit(last))
    stored = rounded(sinks.read_table(spark, f"{folder}/stats"))
    same(stored, rounded(batch), stored.columns)


def test_ingest_stores_readings_statuses_and_dead_letters(spark, sf, folder):
    messages = tables.gps_json(spark, sf).drop("received_at")
    messages.repartition(3).write.json(f"{folder}/in")

    def run():
        jobs.ingest(jobs.read_messages(spark, f"{folder}/in", 1), f"{folder}/readings", f"{folder}/status",
                    f"{folder}/dead", f"{folder}/checkpoint", True).awaitTermination()

    run()
    run()
    routed = gps.route_events(gps.parse_gps(messages))
    valid = gps.to_readings(routed)
    same(sinks.read_table(spark, f"{folder}/readings"), valid, ["id", "vehicle_id", "lat", "lng", "speed_kph", "event_timestamp"])
    report = gps.dlq_report(sinks.read_table(spark, f"{folder}/dead"))
    same(report, gps.dlq_report(gps.to_dlq(routed, "2024-01-01")), report.columns)
    whole = detect.build_status(valid, "2025-01-01")
    same(sinks.read_status(spark, f"{folder}/status"), whole, ["vehicle_id", "last_lat", "last_lng", "last_speed", "last_seen"])


def test_events_enriched_and_published_on_the_way(spark, readings, folder):
    status = detect.build_status(readings, "2024-01-30 23:00:00", idle_minutes=240, offline_minutes=720)
    status.write.parquet(f"{folder}/status")
    known = spark.read.parquet(f"{folder}/status")
    arrive(readings.select(*S.READING.names), f"{folder}/in")
    stream = detect.enrich_events(jobs.read_readings(spark, f"{folder}/in", 1), known).select(
        "id", "vehicle_id", "speed_kph", "event_timestamp", "status", "status_color")
    jobs.publish(stream, f"{folder}/checkpoint", path=f"{folder}/out", available_now=True).awaitTermination()
    sent = spark.read.schema("key string, value string").json(f"{folder}/out").select(
        "key", F.from_json("value", "id long, vehicleId string, status string, status_color string").alias("v"))
    assert sent.where("key = v.vehicleId").count() == readings.count()
    same(sent.select("v.id", "v.status", "v.status_color"), detect.enrich_events(readings, known), ["id", "status", "status_color"])


def test_messages_to_alerts_in_one_job(spark, sf, fences, folder):
    messages = tables.gps_json(spark, sf).drop("received_at")
    options = dict(idle_speed=10, buffer_m=250)
    read = 0
    for low in (0, 400):  # two files, two runs: state and offsets are kept
        messages.where(f"offset * 3 >= {low} and offset * 3 < {low + 400 if low == 0 else 10**9}").coalesce(1).write.mode("append").json(f"{folder}/in")
        stream = jobs.detect_messages(jobs.read_messages(spark, f"{folder}/in", 1), fences, **options)
        query = jobs.run_detection(stream, f"{folder}/alerts", f"{folder}/late", f"{folder}/checkpoint", True)
        query.awaitTermination()
        read += sum(p.numInputRows for p in query.recentProgress)
    assert read == messages.count()  # the source is read once in a micro-batch
    valid = gps.to_readings(gps.route_events(gps.parse_gps(messages)))
    assert sinks.read_table(spark, f"{folder}/late").count() == 0
    same(sinks.read_table(spark, f"{folder}/alerts"), detect.detect_alerts(valid, fences, **options), ROWS)


def test_a_reading_dated_in_the_future_silences_nobody(spark, fences, folder):
    inside, far = (24.895, 67.015), (24.86, 67.08)
    ahead = datetime.now().replace(microsecond=0) + timedelta(days=3650)
    future = (9, "A", *far, None, 200.0, 0.0, ahead, ahead)
    for rows in ([reading(1, 0, 0.0, inside), future], [reading(2, 3, 0.0, inside), reading(3, 6, 0.0, far)]):
        arrive(spark.createDataFrame(rows, S.READING), f"{folder}/in")
        stream = jobs.detect_stream(jobs.read_readings(spark, f"{folder}/in", 1), fences.where("id = 1"))
        jobs.run_detection(stream, f"{folder}/alerts", f"{folder}/late", f"{folder}/checkpoint", True).awaitTermination()
    stored = sinks.read_table(spark, f"{folder}/alerts").orderBy("detected_at", "alert_type").collect()
    assert [(r.id, r.alert_type) for r in stored] == [(1, "GEOFENCE_ENTER"), (2, "IDLE"), (3, "GEOFENCE_EXIT")]
    assert [(r.id, r.alert_type) for r in sinks.read_table(spark, f"{folder}/late").collect()] == [(9, "EARLY")]


def test_a_reading_dated_in_the_future_closes_no_window(spark, folder):
    ahead = datetime.now().replace(microsecond=0) + timedelta(days=3650)
    for rows in ([reading(1, 0, 10.0, (24.9, 67.0)), (9, "B", 24.9, 67.0, None, 1.0, 0.0, ahead, ahead)],
                 [reading(2, 1, 20.0, (24.9, 67.0))], [reading(3, 60, 5.0, (24.9, 67.0))], [reading(4, 61, 5.0, (24.9, 67.0))]):
        arrive(spark.createDataFrame(rows, S.READING), f"{folder}/in")
        stream = jobs.stats_stream(jobs.read_readings(spark, f"{folder}/in", 1))
        jobs.run_stats(stream, f"{folder}/stats", f"{folder}/checkpoint", True).awaitTermination()
    assert [(r.vehicle_id, r.reading_count) for r in sinks.read_table(spark, f"{folder}/stats").collect()] == [("A", 2)]


def test_published_alerts_are_read_back(spark, readings, fences, folder):
    alerts = detect.detect_alerts(readings, fences)
    keyed = gps.to_keyed_json(alerts, rename=gps.EVENT_NAMES).selectExpr(
        "*", "'vehicle-alerts' AS topic", "0 AS partition", "monotonically_increasing_id() AS offset")
    broken = spark.createDataFrame([("k", "{", "vehicle-alerts", 1, 0), ("k", '{"alertType":"IDLE"}', "vehicle-alerts", 1, 1)], keyed.schema)
    plain = spark.createDataFrame([("V", '{"vehicleId":"V","alertType":"IDLE","timestamp":"2024-03-01T12:00:00","details":{"a":1}}',
                                    "vehicle-alerts", 1, 2)], keyed.schema)
    for part in (keyed, broken.unionByName(plain)):
        part.coalesce(1).write.mode("append").json(f"{folder}/in")
    jobs.consume_alerts(jobs.read_messages(spark, f"{folder}/in", 1), f"{folder}/alerts", f"{folder}/dead", f"{folder}/checkpoint",
                        True).awaitTermination()
    stored = sinks.read_table(spark, f"{folder}/alerts")
    same(stored.where("vehicle_id <> 'V'"), alerts, ROWS)
    one = stored.where("vehicle_id = 'V'").first()
    assert (one.id, one.details, one.lat, one.location) == ((1 << 48) + 2, '{"a":1}', None, None)
    assert sinks.read_table(spark, f"{folder}/dead").count() == 2
