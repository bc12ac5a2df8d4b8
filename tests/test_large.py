"""Joins by distance, clipped lines and costs where tables are dense or values lie on an edge."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.operators import clusters, joins, matching, scoring
from waymark.plans import catalog

POINT = "id long, lon double, lat double"
#: Degrees of latitude in a metre.
METRE = 180 / 3.141592653589793 / 6371000


def some_points(seed, n, wide=0.004):
    rng = random.Random(seed)
    points = [(i, -82.6 + rng.randrange(60) * wide / 60, 35.6 + rng.randrange(60) * wide / 60) for i in range(n)]
    return points + [(n, None, 35.6), (n + 1, -82.6, None), (n + 2, *points[0][1:]), (n + 3, *points[0][1:])]


def gap(p, q):
    from math import cos, floor, pi, radians, sqrt

    x, y = (q[1] - p[1]) * (pi / 180) * 6371000.0 * cos(radians(35.6)), (q[2] - p[2]) * (pi / 180) * 6371000.0
    return floor(sqrt(x * x + y * y) * 100 + 0.5) / 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_made_once_and_without_broadcasts(spark):
    points = some_points(1, 300)
    df = spark.createDataFrame(points, POINT)
    out = joins.pairs_within(df, 60.0, 35.6, 2)
    placed = [p for p in points if None not in p]
    want = sorted((p[0], q[0], gap(p, q)) for p in placed for q in placed if p[0] < q[0] and gap(p, q) <= 60)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 500
    assert "Broadcast" not in plan_of(out) and "Broadcast" not in plan_of(joins.within_distance(df, df, 60.0, 35.6))


def test_rounded_distances_are_compared(spark):
    left, right = spark.createDataFrame([(1, 0.0, 0.0)], POINT), spark.createDataFrame([(2, 0.0, 100.004 * METRE), (3, 0.0, 100.006 * METRE)], POINT)
    assert [tuple(r) for r in joins.within_distance(left, right, 100.0, 35.6, 2).collect()] == [(1, 2, 100.0)]
    assert not joins.within_distance(left, right, 100.0, 35.6).collect()


def test_nearest_widens_and_ties_go_to_the_smaller_id(spark):
    left, right = some_points(2, 200) + [(900, -82.59, 35.7)], [(i + 1000, x, y) for i, x, y in some_points(3, 150)]
    right += [(i - 500, x, y) for i, x, y in right[:20]]
    far = {i: (d, r) for i, x, y in left for d, r in [min([(gap((i, x, y), q), q[0]) for q in right if None not in q] if None not in (x, y) else [(1e9, None)])]}
    for radius in (300.0, 7.0):
        out = joins.nearest(spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT), radius, 35.6, 2)
        assert {r.left_id: (r.distance_m, r.right_id) for r in out.collect()} == {i: b if b[0] <= radius else (None, None) for i, b in far.items()}
        assert "Broadcast" not in plan_of(out)
    # Nearer by less than half of the last digit doesn't count.
    a, b = spark.createDataFrame([(1, 0.0, 0.0)], POINT), spark.createDataFrame([(8, 0.0, 10.001 * METRE), (7, 0.0, 10.002 * METRE)], POINT)
    assert [tuple(r) for r in joins.nearest(a, b, 300.0, 35.6, 2).collect()] == [(1, 7, 10.0)]
    assert [tuple(r) for r in joins.nearest(a, spark.createDataFrame([], POINT), 300.0, 35.6).collect()] == [(1, None, None)]


def test_a_crowd_isnt_compared_with_all_of_its_radius(spark, monkeypatch):
    """Of 900 features with as many nodes within the radius, each meets few."""
    made, plain = [], joins._plane_pairs
    monkeypatch.setattr(joins, "_plane_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    points = spark.createDataFrame([(i, -82.6 + (i % 30) * 1e-4, 35.6 + (i // 30) * 1e-4) for i in range(900)], POINT)
    other = points.select("id", (F.col("lon") + 2e-5).alias("lon"), "lat")
    assert joins.nearest(points, other, 300.0, 35.6, 2).filter("left_id = right_id").count() == 900
    assert sum(d.count() for d in made) < 20_000


def same_as_sql(spark, folder, name, **tables):
    """A query's rows are its SQL's over these tables, each given by a SELECT."""
    con = duckdb.connect()
    for t, text in tables.items():
        con.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, cur = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want and want


@pytest.mark.parametrize("name", ["geo_clip_legs", "win_line_pieces", "geo_midpoints"])
def test_legs_along_a_side_of_the_box(spark, tmp_path, name):
    """Events whose ids differ by 10007 have one longitude, those by 10009 one latitude: also beyond the box the SQL keeps them."""
    ids = "(VALUES (1), (10008), (20000), (30009), (30010), (40019), (50028), (9000), (19009), (29016)) AS v(i)"
    events = f"SELECT (i + 137 * u)::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'a' AS event_type, 1e0 AS value, '' AS props FROM {ids} CROSS JOIN range(60) AS w(u)"
    same_as_sql(spark, tmp_path, name, events=events)


def test_costs_near_a_half_are_summed_as_in_the_sql(spark):
    profile = {"quiet": 0.9, "scenic": 0.9, "peaks": -0.7, "interest": 0.5, "directness": 0.2}
    rows = [(1375.0, 0.02, 0.0, 1930), (1218.75, 0.02, 0.05, 1696), (10625.0, 0.06, 0.08, 15903)]
    df = spark.createDataFrame(rows, "length double, grade double, salience double, want long")
    cost = scoring.edge_cost(F.col("length"), F.lit(0.55), F.lit(True), F.lit(0.4), F.col("grade"), F.col("salience"), profile)
    assert [(r.got, r.want) for r in df.select(F.round(cost).cast("long").alias("got"), "want").collect()] == [(w, w) for *_, w in rows]


def test_counts_within_a_radius_are_of_rounded_distances(spark, tmp_path):
    """The node of part 74 and the feature of part 19614 lie 250.0018 m apart, which the SQL rounds to 250."""
    part = "SELECT i::BIGINT AS p_partkey, 'a' AS p_name, 'b' AS p_brand, 'c' AS p_type, 5 AS p_size, 10e0 AS p_retailprice FROM (VALUES (74), (19614)) AS t(i)"
    same_as_sql(spark, tmp_path, "join_radius_counts", part=part)


def test_biased_nearest(spark, monkeypatch):
    """Against all pairs; in a crowd each place meets few of the others."""
    made, plain = [], joins._plane_pairs
    monkeypatch.setattr(joins, "_plane_pairs", lambda *a: made.append(plain(*a)) or made[-1])
    left, right = some_points(4, 120) + [(900, -82.59, 35.7)], [(i + 1000, x, y, float(i * 37 % 90)) for i, x, y in some_points(5, 900)]
    want = set()
    for p in left:
        near = [(gap(p, q), q[3], q[0]) for q in right if None not in p and None not in q and gap(p, q) <= 300]
        low, high = min((e for _, e, _ in near), default=0), max((e for _, e, _ in near), default=0)
        lift = lambda e: 0.8 * (e - low) / (high - low) if high > low else 0.0  # noqa: B023, E731
        want |= {(p[0], -b[1]) for b in [max(((round(lift(e) - 0.5 * d / 300, 6), -i) for d, e, i in near), default=None)] if b}
    out = joins.biased_nearest(spark.createDataFrame(left, POINT), spark.createDataFrame(right, POINT + ", e double"), "e", 300.0, 35.6, 0.8, 0.5, 2)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 100 and "Broadcast" not in plan_of(out)
    assert sum(d.count() for d in made[2:]) < 60_000


def test_greatest_within(spark):
    left, right = [(i, x, y, float(i * 7 % 50)) for i, x, y in some_points(6, 200)], some_points(7, 200)
    out = joins.greatest_within(spark.createDataFrame(left, POINT + ", s double"), spark.createDataFrame(right, POINT), "s", 40.0, 35.6)
    near = {q[0]: [p[3] for p in left if None not in p and gap(p, q) <= 40.0] for q in right if None not in q}
    assert {tuple(r) for r in out.collect()} == {(i, max(s)) for i, s in near.items() if s} and "Broadcast" not in plan_of(out)


def test_linked_points_are_the_components_of_all_pairs(spark):
    rng = random.Random(8)
    middles = [(rng.uniform(0, 0.05), rng.uniform(0, 0.05)) for _ in range(40)]
    points = [(i, -82.6 + m[0] + rng.gauss(0, 0.0004), 35.6 + m[1] + rng.gauss(0, 0.0004)) for i in range(500) for m in [middles[rng.randrange(40)]]] + [(500, -82.7, 35.6)]
    parent = {p[0]: p[0] for p in points}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = {i for p in points for q in points if p[0] < q[0] and gap(p, q) <= 160 for i in (p[0], q[0], *([parent.update({max(root(p[0]), root(q[0])): min(root(p[0]), root(q[0]))})] and []))}
    got = {r.id: r.component for r in clusters.linked_points(spark.createDataFrame(points, POINT), 35.6, 160.0).collect()}
    assert got == {i: root(i) for i in near} and 5 < len(set(got.values())) < 60 and 500 not in near


def test_far_legs_are_left_out_before_lines_are_grouped(spark):
    """Grouping pairs that don't match shuffled them all."""
    leg = lambda key, y: spark.createDataFrame([(i, 0, 10.0 * i, y, 10.0 * i + 300.0, y + 5.0) for i in range(20)], f"{key} long, k long, x double, y double, x2 double, y2 double")
    out = matching.close_lines(leg("event_id", 0.0), leg("edge_id", 31.0), "event_id", "edge_id", 30.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = next(x for x in plan.splitlines() if "Filter" in x)
    assert "distance_m" in first and plan.index("Aggregate") < plan.index(first), plan
    rows = out.collect()
    assert rows and all(26 < r.distance_m <= 30 for r in rows)
