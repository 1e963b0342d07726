"""Stored tables: repeated batches, deletes, retention, status versions."""

import threading
import time
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from fleetlark import schemas as S
from fleetlark.operators import detect, maintain
from fleetlark.sources import gps, tables
from fleetlark.sources import store as st
from fleetlark.sources.store import Store
from fleetlark.streaming import jobs, sinks


def test_a_repeated_batch_leaves_one_copy(spark, readings, folder):
    path = f"{folder}/readings"
    half = readings.where("id < 500")
    sinks.write_readings(half, path, 1)
    sinks.write_readings(readings.where("id >= 500"), path, 2)
    sinks.write_readings(half, path, 1)
    stored = sinks.read_table(spark, path)
    assert stored.count() == readings.count() == stored.select("id").distinct().count()
    assert stored.where("location is null").count() == 0
    plan = sinks.between_days(stored, "event_timestamp", "2024-01-05", "2024-01-06 12:00:00")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text and "GreaterThanOrEqual(event_timestamp" in text


def test_dead_letters_repeated_after_midnight_leave_one_copy(spark, folder):
    for failed_at in ("2024-01-05 23:59:59", "2024-01-06 00:00:01"):
        routed = gps.route_events(gps.parse_gps(spark.createDataFrame([("k", "{}", "t", 0, 1), ("k", "x", "t", 0, 2)], "key string, value string, topic string, partition int, offset long")))
        sinks.write_dead_letters(gps.to_dlq(routed, failed_at), f"{folder}/dead", 5)
    assert sinks.read_table(spark, f"{folder}/dead").count() == 2


def test_vehicle_filter_reaches_a_stored_table(spark, readings, folder):
    sinks.write_readings(readings, f"{folder}/r", 1)
    plan = sinks.read_table(spark, f"{folder}/r").where("vehicle_id = 'VH-0008'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(vehicle_id,VH-0008)" in plan


def test_delete_from_a_stored_table(spark, sf, folder):
    path, alerts = f"{folder}/alerts", tables.alerts(spark, sf)
    sinks.write_alerts(alerts, path, 1)
    gone = (F.col("vehicle_id") == "VH-0008") | (F.to_date("detected_at") == F.lit("2024-01-10").cast("date"))
    wanted = maintain.delete_where(alerts, gone)
    assert maintain.delete_from_table(spark, path, gone) == wanted.deleted_count()
    stored = sinks.read_table(spark, path)
    assert stored.select("id").exceptAll(wanted.remaining.select("id")).count() == 0
    assert stored.count() == wanted.remaining.count()
    assert stored.where("event_date = date'2024-01-10'").count() == 0
    assert maintain.delete_from_table(spark, path, gone) == 0


def test_retention_of_a_stored_table(spark, sf, folder):
    path, alerts = f"{folder}/alerts", tables.alerts(spark, sf)
    sinks.write_alerts(alerts, path, 1)
    maintain.drop_before(spark, path, "detected_at", "2024-01-20 06:00:00")
    left = sinks.read_table(spark, path)
    assert left.count() == alerts.where("detected_at >= timestamp'2024-01-20 06:00:00'").count()
    maintain.drop_before(spark, path, "detected_at", "2025-01-01 00:00:00")


def status_rows(spark, path):
    return {r.vehicle_id: (r.last_speed, r.last_seen.hour, r.status) for r in sinks.read_status(spark, path).collect()}


def test_status_upsert(spark, folder):
    def batch(*rows):
        return spark.createDataFrame([(n, v, 1.0, 2.0, None, speed, 0.0, datetime(2024, 1, 1, hour), None)
                                      for n, (v, speed, hour) in enumerate(rows)], S.READING)
    path = f"{folder}/status"
    assert sinks.read_status(spark, path).count() == 0
    sinks.upsert_status(batch(("A", 50.0, 3), ("B", 0.0, 3), ("A", 60.0, 5)), path, 0)
    assert status_rows(spark, path) == {"A": (60.0, 5, "ONLINE"), "B": (0.0, 3, "IDLE")}
    late_and_new = batch(("A", 10.0, 4), ("C", 9.0, 1))
    sinks.upsert_status(late_and_new, path, 1)
    sinks.upsert_status(late_and_new, path, 1)
    assert status_rows(spark, path) == {"A": (60.0, 5, "ONLINE"), "B": (0.0, 3, "IDLE"), "C": (9.0, 1, "ONLINE")}
    for n in range(2, 7):
        sinks.upsert_status(batch(("C", float(n), n)), path, n)
    assert status_rows(spark, path)["C"] == (6.0, 6, "ONLINE")
    table = Store(spark, path, "bucket")
    assert table.files().agg(F.max("n_rows"), F.sum("n_rows")).first()[:] == (1, 3) and table.current().version == 6


def test_upserts_add_up_to_the_batch_status(spark, readings, folder):
    path = f"{folder}/status"
    for n in range(4):
        sinks.upsert_status(readings.where(f"id % 4 = {n}"), path, n)
    whole = detect.build_status(readings, "2024-12-31").select("vehicle_id", "last_lat", "last_lng", "last_speed", "last_seen")
    stored = sinks.read_status(spark, path).select(*whole.columns)
    assert stored.exceptAll(whole).count() == 0 and stored.count() == whole.count()


MESSAGE = "key string, value string, topic string, partition int, offset long"


def letters(spark, offsets, failed_at, key="k"):
    rows = [(f"{key}{n}", "{}" if n % 2 else "x", "t", 0, n) for n in offsets]
    return gps.to_dlq(gps.route_events(gps.parse_gps(spark.createDataFrame(rows, MESSAGE))), failed_at)


def test_retention_and_deletes_of_stored_dead_letters(spark, folder):
    path = f"{folder}/dead"
    sinks.write_dead_letters(letters(spark, range(5), "2024-01-02 10:00:00"), path, 0)
    sinks.write_dead_letters(letters(spark, range(5, 12), "2024-01-20 10:00:00"), path, 1)
    assert maintain.drop_before(spark, path, "failed_at", "2024-01-10 00:00:00") == 5
    assert maintain.delete_from_table(spark, path, F.col("key") == "k7") == 1
    left = sinks.read_table(spark, path)
    assert sorted(r["key"] for r in left.collect()) == sorted(f"k{n}" for n in range(5, 12) if n != 7)
    assert gps.dlq_report(left).agg(F.sum("failures")).first()[0] == 6
    assert maintain.truncate_table(spark, path, confirm=True) == 6 and sinks.read_table(spark, path).count() == 0
    sinks.write_dead_letters(letters(spark, [40], "2024-01-21 10:00:00"), path, 2)
    assert sinks.read_table(spark, path).count() == 1


def test_writers_do_not_touch_each_other(spark, readings, folder):
    path = f"{folder}/r"
    sinks.write_readings(readings.where("id < 300"), path, 0, "north")
    sinks.write_readings(readings.where("id >= 300 AND id < 700"), path, 0, "south")
    assert sinks.write_readings(readings.where("id < 300"), path, 0, "north") == 0
    # a new checkpoint reads the source of north from its start, in other batches
    assert sinks.write_readings(readings.where("id < 200"), path, 0, "north again") == 0
    assert sinks.write_readings(readings.where("id >= 200 AND id < 300 OR id >= 700"), path, 1, "north again") == readings.where("id >= 700").count()
    stored = sinks.read_table(spark, path)
    assert stored.count() == readings.count() == stored.select("id").distinct().count()


def test_dead_letters_of_a_new_checkpoint_leave_one_copy(spark, folder):
    path = f"{folder}/dead"
    sinks.write_dead_letters(letters(spark, range(6), "2024-01-05 23:59:59"), path, 0, "a")
    assert sinks.write_dead_letters(letters(spark, range(8), "2024-01-06 00:00:01"), path, 0, "b") == 2
    # without an origin nothing is taken for known
    bare = letters(spark, [0], "2024-01-06 00:00:01").withColumn("headers", F.map_filter("headers", lambda k, v: k != "dlq-original-offset"))
    assert sinks.write_dead_letters(bare, path, 0, "c") == sinks.write_dead_letters(bare, path, 0, "d") == 1
    assert sinks.read_table(spark, path).count() == 10


def test_a_writer_is_kept_with_its_checkpoint(spark, folder):
    first = st.writer_of(spark, f"{folder}/one")
    assert st.writer_of(spark, f"{folder}/one/") == first != st.writer_of(spark, f"{folder}/two")


def test_the_manifest_chooses_files(spark, readings, folder, monkeypatch):
    """A thousand files: bounds reach the listing of files, a delete rewrites what it must, counts are true."""
    path, day = f"{folder}/a", datetime(2021, 1, 1)
    rows = [(n, f"V{n % 10}", "IDLE", "{}", day + timedelta(days=n // 2, hours=n % 2), 1.0, 2.0) for n in range(2000)]
    sinks.write_alerts(spark.createDataFrame(rows, S.ALERT), path, 0)
    table = Store(spark, path)
    before = {r["file"]: r for r in table.files().collect()}
    assert len(before) >= 1000 and sum(r["n_rows"] for r in before.values()) == 2000
    few = sinks.read_table(spark, path, "2021-03-01 00:00:00", "2021-03-03 12:00:00", vehicle="V8")
    assert len(few.inputFiles()) <= 6 and {r["vehicle_id"] for r in few.collect()} <= {"V8"}
    assert maintain.delete_filtered_from_table(spark, path, vehicle="V8", start="2021-03-01", end="2021-04-01") == sum(
        r[1] == "V8" and datetime(2021, 3, 1) <= r[4] <= datetime(2021, 4, 1) for r in rows)
    after = {r["file"] for r in table.files().collect()}
    assert len(set(before) - after) <= 7
    cutoff = "2022-01-01 00:30:00"
    old = [r for r in rows if r[4] < datetime(2022, 1, 1, 0, 30)]
    gone = maintain.drop_before(spark, path, "detected_at", cutoff)
    assert gone == len(old) - sum(r[1] == "V8" and datetime(2021, 3, 1) <= r[4] <= datetime(2021, 4, 1) for r in rows)
    assert sinks.read_table(spark, path).agg(F.min("detected_at"), F.count("*")).first()[:] == (datetime(2022, 1, 1, 1), 2000 - len(old))
    with pytest.raises(ValueError):
        maintain.drop_before(spark, path, "failed_at", cutoff)
    with pytest.raises(ValueError):
        maintain.delete_filtered_from_table(spark, path)


def test_many_batches_snapshots_compaction_and_a_slow_reader(spark, folder, monkeypatch):
    monkeypatch.setattr(st, "SNAPSHOT_EVERY", 4)
    path, day = f"{folder}/r", datetime(2024, 1, 1)
    for n in range(14):
        rows = [(n * 3 + k, f"V{k}", 1.0, 2.0, None, 5.0, 0.0, day + timedelta(hours=n * 3 + k), None) for k in range(3)]
        assert sinks.write_readings(spark.createDataFrame(rows, S.READING), path, n, "w") == 3
    table = Store(spark, path)
    assert len(table.current().manifests) <= 4 and table.current().epochs == {"w": 13}
    slow = sinks.read_table(spark, path)
    merged = maintain.compact_table(spark, path)
    assert merged >= 14 and table.files().count() <= 4 and {r["writer"] for r in table.files().collect()} == {"w"}
    assert maintain.compact_table(spark, path) == 0
    assert maintain.delete_from_table(spark, path, F.col("id") >= 30, start="2024-01-02 06:00:00") == 12
    assert slow.count() == 42 and sinks.read_table(spark, path).count() == 30
    assert sinks.write_readings(slow.drop("event_date", "commit"), path, 13, "w") == 0
    assert maintain.vacuum_table(spark, path, 3_600_000) == 0 and slow.count() == 42
    time.sleep(0.01)
    assert maintain.vacuum_table(spark, path, -3_600_000) > 10
    assert sorted(r["id"] for r in sinks.read_table(spark, path).collect()) == list(range(30))
    assert sinks.write_readings(spark.createDataFrame([], S.READING), path, 14, "w") == 0 and table.current().epochs == {"w": 14}


def test_two_writers_at_once_lose_nothing(spark, readings, folder):
    path, failures = f"{folder}/r", []

    def write(writer, part):
        try:
            for n in range(3):
                sinks.write_readings(readings.where(f"id % 6 = {part * 3 + n}"), path, n, writer)
        except Exception as error:  # reported by the test's thread
            failures.append(error)
    threads = [threading.Thread(target=write, args=(f"w{part}", part)) for part in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    stored = sinks.read_table(spark, path)
    assert not failures and stored.count() == readings.count() == stored.select("id").distinct().count()
    assert Store(spark, path).current().version == 5


def test_statuses_age_without_readings(spark, folder):
    path = f"{folder}/status"
    rows = [(n, f"V{n}", 1.0, 2.0, None, 50.0, 0.0, datetime(2024, 1, 1, 12, n), None) for n in range(40)]
    sinks.upsert_status(spark.createDataFrame(rows, S.READING), path, 0)
    slow = sinks.read_status(spark, path)
    assert {r["status"] for r in slow.collect()} == {"ONLINE"}
    before = {r["file"] for r in Store(spark, path, "bucket").files().collect()}
    sinks.age_statuses(spark, path, "2024-01-01 12:45:00")
    now = {r["vehicle_id"]: (r["status"], r["status_updated_at"].minute) for r in sinks.read_status(spark, path).collect()}
    assert now == {f"V{n}": ("OFFLINE", 45) if n < 15 else ("IDLE", 45) if n < 35 else ("ONLINE", n) for n in range(40)}
    kept = before & {r["file"] for r in Store(spark, path, "bucket").files().collect()}
    assert kept and {r["status"] for r in slow.collect()} == {"ONLINE"}
    assert sinks.age_statuses(spark, path, "2024-01-01 12:45:00") == 0
    assert sinks.age_statuses(spark, f"{folder}/none", "2024-01-01") == 0
    # a new checkpoint: batch 0 of another writer
    sinks.upsert_status(spark.createDataFrame([(1, "V0", 3.0, 4.0, None, 0.0, 0.0, datetime(2024, 1, 2), None)], S.READING), path, 0, "other")
    assert sinks.read_status(spark, path).where("vehicle_id = 'V0'").first()["status"] == "IDLE" and sinks.read_status(spark, path).count() == 40


def test_the_timer_turns_silent_vehicles_offline(spark, folder):
    path = f"{folder}/status"
    sinks.upsert_status(spark.createDataFrame([(1, "A", 1.0, 2.0, None, 50.0, 0.0, datetime(2024, 1, 1), None)], S.READING), path, 0)
    query = jobs.run_ageing(spark, path, f"{folder}/checkpoint", "1 second")
    try:
        for _ in range(120):
            if sinks.read_status(spark, path).first()["status"] == "OFFLINE":
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert sinks.read_status(spark, path).first()["status"] == "OFFLINE"
