"""Graph loops and folds against brute force, with nulls, repeats, cycles and empty tables."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from waymark.operators import cues, graphs
from waymark.streaming import triggers

EDGES = "u long, v long, length_m double"
LINKS = [(1, 2, 5.0), (2, 3, 1.0), (1, 3, 9.0), (1, 2, 7.0), (5, 4, 2.0), (6, 6, 1.0), (None, 3, 1.0), (8, 9, 1.0), (9, 8, 1.0), (3, 10, 4.0)]


def as_dict(df):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r[-1] for r in df.collect()}


def test_components_of_a_path_a_loop_and_a_lone_node(spark):
    nodes = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, None]], "id long")
    got = as_dict(graphs.components(nodes, spark.createDataFrame(LINKS, EDGES)))
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}
    path = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("length_m"))
    assert set(as_dict(graphs.components(spark.range(61), path)).values()) == {0}
    empty = spark.createDataFrame([], EDGES)
    assert as_dict(graphs.components(spark.range(2), empty)) == {0: 0, 1: 1}


def test_path_costs_take_the_shortest_way(spark):
    edges = spark.createDataFrame(LINKS + [(3, 1, None), (10, 2, -1.0)], EDGES)
    got = as_dict(graphs.path_costs(edges, spark.createDataFrame([(1,), (8,), (77,)], "id long")))
    assert got == {(1, 1): 0, (1, 2): 5, (1, 3): 6, (1, 10): 10, (8, 8): 0, (8, 9): 1, (77, 77): 0}


def test_longest_downstream_marks_cycles(spark):
    edges = spark.createDataFrame(LINKS + [(7, 8, 3.0)], EDGES)
    got = as_dict(graphs.longest_downstream(edges))
    assert {k for k, v in got.items() if math.isnan(v)} == {6, 7, 8, 9}
    assert {k: v for k, v in got.items() if not math.isnan(v)} == {1: 13, 2: 5, 3: 4, 10: 0, 5: 2, 4: 0}


def test_gaps_fill_by_hops(spark):
    nodes = {1: 10.0, 2: None, 3: None, 10: 40.0, 4: None, 5: None, 6: None, 8: 3.0, 9: None}
    edges = [e for e in LINKS if e[0] is not None]
    near = defaultdict(set)
    for u, v, _ in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    want = dict(nodes)
    while True:
        step = {n: [want[m] for m in near[n] if want[m] is not None] for n, x in want.items() if x is None}
        step = {n: sum(xs) / len(xs) for n, xs in step.items() if xs}
        if not step:
            break
        want |= step
    got = as_dict(graphs.fill_gaps(spark.createDataFrame(list(nodes.items()), "id long, value double"), spark.createDataFrame(edges, EDGES)))
    assert got == {n: x or 0.0 for n, x in want.items()}


def test_cues_merge_in_order(spark):
    kinds = ["turn", "node", "surface", "hazard", "provision", "event", None, "turn"]
    rows = [(i, i % 3, kinds[(i * 5) % 8], float((i * 37) % 400)) for i in range(120)] + [(900, None, "turn", 1.0), (901, 1, "turn", None)]
    got = defaultdict(list)
    for r in cues.merge_cues(spark.createDataFrame(rows, "cue_id long, route_id long, kind string, along_m double")).orderBy("route_id", "sequence").collect():
        got[r.route_id].append((r.along_m, r.kind, r.cue_id, r.merged))
    for route in range(3):
        want = []
        order = sorted((at, cues.PRIORITY.get(k, cues.OTHER), i, k or "") for i, r, k, at in rows if r == route and at is not None)
        for at, rank, i, kind in order:
            if want:
                last = want[-1]
                both_turns = last[3] == "turn" == kind
                if at - last[0] <= 25 and kind not in cues.APART and last[3] not in cues.APART and not both_turns:
                    keep = last if last[1] <= rank else (at, rank, i, kind)
                    want[-1] = (last[0], keep[1], keep[2], keep[3], last[4] + 1)
                    continue
            want.append((at, rank, i, kind, 1))
        assert got[route] == [(a, k, i, n) for a, _, i, k, n in want]


def test_cue_windows_of_routes_without_length(spark):
    routes = spark.createDataFrame([(1, 2500.0), (2, 0.0), (3, None)], "route_id long, route_m double")
    c = spark.createDataFrame([(1, 100.0), (1, 9000.0), (2, 5.0)], "route_id long, along_m double")
    assert as_dict(cues.cues_per_window(c, routes)) == {(1, 0): 1, (1, 1): 0, (1, 2): 1}


def test_entry_triggers_of_a_hot_user_are_spread_over_tasks(spark):
    rng = random.Random(4)
    rows = [(1 if k % 3 else 2 + k % 50, k // 4, k, rng.random() < 0.5 + 0.4 * (k // 300 % 2)) for k in range(6000)]
    rows += [(None, k, 10_000 + k, k % 8 < 5) for k in range(40)] + [(99, None, 20_000 + k, True) for k in range(3)] + [(98, 0, 30_000, None)]
    want = []
    for user in {r[0] for r in rows}:
        inside, streak = False, 0
        for _, sec, _, reading in sorted((r for r in rows if r[0] == user), key=lambda r: (r[1] is None, r[1], r[2])):
            inside, streak, event = triggers.step(inside, streak, bool(reading))
            want += [(user, sec, event)] if event else []
    df = spark.createDataFrame(rows, "user_id long, sec long, event_id long, inside boolean").repartition(7)
    df = df.select("user_id", F.timestamp_seconds("sec").alias("ts"), "event_id", "inside")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = triggers.entry_events(df)
        rows_got = [tuple(r) for r in got.select("user_id", F.unix_seconds("ts"), "event").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(rows_got, key=str) == sorted(want, key=str) and (99, None, "enter") in want
    assert triggers.entry_events(df.filter("false")).count() == 0


def test_longest_downstream_goes_on_until_no_node_is_ready(spark, monkeypatch):
    monkeypatch.setattr(graphs, "range", lambda n: iter((0, 1, 2)), raising=False)  # rounds that are counted end early
    got = as_dict(graphs.longest_downstream(spark.createDataFrame([(i, i + 1, 1.0) for i in range(12)], EDGES)))
    assert got == {i: 12.0 - i for i in range(13)}
