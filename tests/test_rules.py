"""Rule tables, document diffs, closures and requests on graphs against brute force."""

import heapq
import json
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators import documents, graphs, rules

SF = "/root/testdata/sf0.001"


def told(left, right, path=""):
    """Differences of two decoded documents, value by value."""
    name = lambda x: "null" if x is None else {bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(x)]
    if name(left) != name(right):
        return [(path, "retyped" if {name(left), name(right)} == {"integer", "number"} else "type_changed")]
    if isinstance(left, (dict, list)):
        keys = sorted(set(left) | set(right)) if isinstance(left, dict) else range(max(len(left), len(right)))
        has = (lambda d, k: k in d) if isinstance(left, dict) else (lambda d, k: k < len(d))
        out = []
        for k in keys:
            if not has(right, k):
                out.append((f"{path}/{k}", "removed"))
            elif not has(left, k):
                out.append((f"{path}/{k}", "added"))
            else:
                out += told(left[k], right[k], f"{path}/{k}")
        return out
    return [] if left == right else [(path, "changed")]


def some_document(rng, depth=0):
    if depth == 3 or rng.random() < 0.25:
        return rng.choice([1, 2, 1.5, 2.25, "a", "é", "", True, False, None, [], {}])
    if rng.random() < 0.5:
        return [some_document(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abcde"): some_document(rng, depth + 1) for _ in range(rng.randrange(5))}


def altered(rng, x):
    if rng.random() < 0.2:
        return some_document(rng, 2)
    if isinstance(x, list):
        return [altered(rng, y) for y in x][: rng.choice([None, None, 1])]
    if isinstance(x, dict):
        return {k: altered(rng, y) for k, y in x.items() if rng.random() < 0.9} | ({"z": 1} if rng.random() < 0.2 else {})
    return x


def test_documents_differ_as_a_walk_of_both_says(spark):
    rng = random.Random(1)
    left = {i: some_document(rng) for i in range(150)}
    right = {i: altered(rng, x) for i, x in left.items()}
    del left[7], right[9]
    frame = lambda docs: spark.createDataFrame([(i, json.dumps(x)) for i, x in docs.items()] + [(999, "{no json"), (998, None)], "id long, doc string")
    got = sorted((r.id, r.path, r.change) for r in documents.document_diff(frame(left), frame(right)).collect())
    want = [(i, p, c) for i in left.keys() & right.keys() for p, c in told(left[i], right[i])] + [(9, "", "removed"), (7, "", "added")]
    assert got == sorted(want) and {c for _, _, c in got} == {"added", "removed", "changed", "retyped", "type_changed"}


def test_a_filter_without_clauses_fails(spark):
    with pytest.raises(Exception, match="no clauses"):
        rules.clauses(spark.createDataFrame([("x", "highway")], "network string, filter string")).collect()


def test_ways_without_tags_and_repeated_tags(spark):
    tags = spark.createDataFrame([(1, None, None), (2, "access", "private"), (3, "access", "yes"), (3, "access", "yes"), (4, "Access", "private"), (5, "foot", "motor_no")], "way_id long, key string, value string")
    filters = spark.createDataFrame([("open", '["access"!="private"]["foot"!~"no"]'), ("told", '["access"]')], "network string, filter string")
    got = {(r.way_id, r.network) for r in rules.ways_passing(tags, rules.clauses(filters)).collect()}
    assert got == {(1, "open"), (3, "open"), (4, "open"), (2, "told"), (3, "told")}


def brute_circuit(arcs, stops, relief):
    """Dijkstra leg by leg with a used set; None if a needed anchor can't be reached."""
    used, out, at = set(), [], stops[0][0]
    for k, (to, optional) in enumerate(stops[1:], start=1):
        if to == at:
            continue
        best, heap, prev = {}, [(0.0, 0, at, None)], {}
        while heap:
            c, hops, n, p = heapq.heappop(heap)
            if n in best:
                continue
            best[n], prev[n] = c, p
            for v, w in arcs[n].items():
                f = (1.25 if n in relief and v in relief else 8.0) if frozenset((n, v)) in used else 1.0
                heapq.heappush(heap, (c + w * f, hops + 1, v, n))
        if to not in best:
            if optional and k < len(stops) - 1:
                continue
            return None
        leg, n = [], to
        while n != at:
            leg.append((prev[n], n))
            n = prev[n]
        out += [(k, i, u, v) for i, (u, v) in enumerate(reversed(leg), start=1)]
        used |= {frozenset(e) for e in leg}
        at = to
    return out


def test_circuits_are_those_of_a_search_of_ones_own(spark):
    rng = random.Random(3)
    arcs = defaultdict(dict)
    for x in range(6):
        for y in range(5):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 6 and y + dy < 5:
                    a, b, w = x * 10 + y, (x + dx) * 10 + y + dy, rng.randrange(100, 999) / 7
                    arcs[a][b] = w
                    if rng.random() < 0.8:
                        arcs[b][a] = w * 1.01
    arcs[99][0] = 5.0  # a node that leads in only
    nodes = [n for n in arcs if n != 99]
    requests = {r: [(rng.choice(nodes), False) for _ in range(4)] for r in range(12)}
    requests[12] = [(0, False), (99, True), (34, False), (0, False)]
    requests[13] = [(0, False), (99, False), (34, False)]
    requests[14] = [(0, False), (34, False), (99, True)]
    requests[15] = [(0, False), (0, False), (11, False)]
    relief = {r: {s[0][0], *arcs[s[0][0]]} for r, s in requests.items() if r % 2}
    edges = spark.createDataFrame([(u, v, w) for u, t in arcs.items() for v, w in t.items()] + [(0, 1, 9e9), (None, 1, 1.0), (3, 3, 1.0)], "u long, v long, cost double")
    anchors = spark.createDataFrame([(r, k, n, o) for r, s in requests.items() for k, (n, o) in enumerate(s)], "request long, k int, node long, optional boolean")
    got = defaultdict(list)
    for r in graphs.circuits(edges, anchors, spark.createDataFrame([(r, n) for r, s in relief.items() for n in s], "request long, node long")).collect():
        got[r.request].append((r.leg, r.place, r.u, r.v))
        assert r.cost == arcs[r.u][r.v]
    for r, stops in requests.items():
        assert sorted(got[r]) == (brute_circuit(arcs, stops, relief.get(r, set())) or []), r
    assert not got[13] and not got[14] and got[12] and got[15]


def test_longest_runs_of_trees_are_their_diameters(spark):
    rng = random.Random(7)
    edges = [(k, rng.randrange(max(0, k - 4), k), rng.randrange(1, 90) / 8) for k in range(1, 60)] + [(100 + k, 99 + k, 1.5) for k in range(1, 12)] + [(300, 300, 2.0)]
    arcs = defaultdict(list)
    for u, v, w in edges:
        arcs[u].append((v, w))
        arcs[v].append((u, w))

    def costs(a):
        best, todo = {a: 0.0}, [a]
        while todo:
            n = todo.pop()
            for v, w in arcs[n]:
                if best[n] + w < best.get(v, 1e18):
                    best[v] = best[n] + w
                    todo.append(v)
        return best

    got = {r.component: r for r in graphs.longest_runs(spark.createDataFrame(edges, "u long, v long, length_m double")).collect()}
    assert set(got) == {0, 100, 300} or set(got) == {0, 99 + 1, 300}
    for c, r in got.items():
        part = costs(c)
        assert abs(r.length_m - max(max(costs(n).values()) for n in part)) < 1e-9 and abs(costs(r.a)[r.b] - r.length_m) < 1e-9


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "u long, v long, length_m double")
    assert graphs.longest_runs(none).count() == 0
    assert graphs.circuits(none.withColumnRenamed("length_m", "cost"), spark.createDataFrame([], "request long, k int, node long, optional boolean")).count() == 0
    assert rules.weights_at(spark.createDataFrame([(1, 2, 3.0)], "route_id long, seq long, at double"), spark.createDataFrame([], "route_id long, ord int, start double, end double, profile string"), 10.0).first().profile is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_document_diff_of_the_small_table(spark):
    from waymark.plans import rules as plans

    rows = plans.set_document_diff(spark, SF).groupBy("change").count().collect()
    assert {r.change for r in rows} >= {"added", "removed", "changed"}
    one = plans.set_document_diff(spark, SF).filter(F.col("id").isin(11, 13)).collect()
    assert sorted((r.id, r.path, r.change) for r in one) == [(11, "", "added"), (13, "", "removed")]
