"""Arrivals and entry triggers on real streams against a fold of their own."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waymark.streaming import arrivals, triggers

READINGS = "user_id long, role_id long, ts timestamp, seq long, inside boolean"


def brute(rows):
    """First reading that ends three in a row inside, by user and role."""
    out, run = {}, {}
    for user, role, ts, _, inside in sorted(rows, key=lambda r: (r[2], r[3])):
        run[user, role] = run.get((user, role), 0) + 1 if inside else 0
        if run[user, role] == 3 and (user, role) not in out:
            out[user, role] = ts
    return out


@pytest.fixture(scope="module")
def readings():
    rng = random.Random(4)
    start = datetime(2024, 5, 1)
    return [(u, r, start + timedelta(seconds=5 * (k // 2)), k, rng.random() < 0.55) for u in range(4) for r in range(3) for k in range(40)]


def stream_of(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return q


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_arrivals_of_a_table(spark, readings):
    got = {(r.user_id, r.role_id): r.ts for r in arrivals.arrivals(spark.createDataFrame(readings, READINGS)).collect()}
    assert got == brute(readings) and len(got) > 8


def test_arrivals_of_a_stream(spark, readings, tmp_path, rocks):
    """Micro-batches in order, one of them twice; a role fires once for good."""
    order = sorted(readings, key=lambda r: r[3])
    cuts = [order[a:b] for a, b in ((0, 90), (90, 200), (200, 201), (201, 480))]
    df = arrivals.arrivals(stream_of(spark, tmp_path, [cuts[0], cuts[1], cuts[1], cuts[2], cuts[3]], READINGS))
    run(df, tmp_path, "arrived")
    rows = spark.table("arrived").collect()
    assert len(rows) == len({(r.user_id, r.role_id) for r in rows})
    assert {(r.user_id, r.role_id): r.ts for r in rows} == brute(readings)


def test_entry_triggers_of_a_stream(spark, tmp_path):
    rng = random.Random(12)
    start = datetime(2024, 5, 1)
    rows = [(u, start + timedelta(seconds=k), k, rng.random() < 0.5) for k in range(120) for u in range(3)]
    df = triggers.entry_events(stream_of(spark, tmp_path, [rows[:100], rows[100:110], rows[110:]], "user_id long, ts timestamp, event_id long, inside boolean"))
    run(df, tmp_path, "entered")
    want = []
    for u in range(3):
        now, against = False, 0
        for _, ts, _, reading in [r for r in rows if r[0] == u]:
            against = against + 1 if reading is not now else 0
            if against == 3:
                now, against = reading, 0
                want.append((u, ts, "enter" if reading else "exit"))
    assert sorted((r.user_id, r.ts, r.event) for r in spark.table("entered").collect()) == sorted(want) and len(want) > 6


def test_roles_are_near_or_within_their_area(spark):
    start = datetime(2024, 5, 1)
    path = [(1, 5, start + timedelta(seconds=k), k, -82.6 + k * 0.0002, 35.6) for k in range(20)]
    positions = spark.createDataFrame(path, "user_id long, trip_id long, ts timestamp, seq long, lon double, lat double")
    roles = spark.createDataFrame([(1, 5, -82.598, 35.6, None, True), (2, 5, -82.598, 35.6, 100.0, True), (3, 5, -82.6, 35.6, 1e6, False), (4, 6, -82.6, 35.6, 1e6, True), (5, 5, -82.6, 35.6, 1e6, True)], "role_id long, trip_id long, lon double, lat double, radius_m double, on_arrival boolean")
    areas = spark.createDataFrame([(5, k, x, y) for k, (x, y) in enumerate([(-82.5975, 35.5), (-82.5965, 35.5), (-82.5965, 35.7), (-82.5975, 35.7)])], "role_id long, k int, lon double, lat double")
    got = arrivals.near_roles(positions, roles, areas)
    inside = {(r.role_id, r.seq) for r in got.filter("inside").collect()}
    metre = 6371000 * math.radians(1) * math.cos(math.radians(35.6))
    want = {(role, k) for role, most in ((1, 40.0), (2, 100.0)) for k in range(20) if abs(k * 0.0002 - 0.002) * metre <= most}
    assert inside == want | {(5, k) for k in range(20) if 0.0025 < k * 0.0002 < 0.0035}
    assert {r.role_id for r in arrivals.arrivals(got).collect()} == {1, 2, 5}
    assert got.filter(F.col("role_id").isin(3, 4)).count() == 0
