"""Graph and cluster operators against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import boxes
from waymark.operators import clusters, graphs, joins


def closure(n, edges):
    reach = np.eye(n, dtype=bool)
    for u, v in edges:
        reach[u, v] = True
    for k in range(n):
        reach |= np.outer(reach[:, k], reach[k])
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_and_weak_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (55, 2))] + [(30, 31), (31, 32), (32, 30)]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    used = sorted({x for e in edges for x in e})
    reach = closure(40, edges)
    strong = {i: min(j for j in used if reach[i, j] and reach[j, i]) for i in used}
    assert {r.id: r.component for r in graphs.strong_components(df).collect() if r.id in strong} == strong
    both = closure(40, edges + [(v, u) for u, v in edges])
    nodes = spark.createDataFrame([(i,) for i in used], "id long")
    assert {r.id: r.component for r in graphs.components(nodes, df).collect()} == {i: min(j for j in used if both[i, j]) for i in used}


def test_truncation_keeps_the_largest_strong_part(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 4), (4, 2), (4, 5), (5, 9), (9, 5)], "u long, v long")
    assert sorted((r.u, r.v) for r in graphs.truncated(nodes, edges, -1, -1, 6, 1).collect()) == [(2, 3), (3, 4), (4, 2)]


def brute_clusters(points, most):
    """Every pair of clusters is compared anew each time."""
    parts = [[i] for i in range(len(points))]
    far = lambda a, b: max(np.hypot(points[i][0] - points[j][0], points[i][1] - points[j][1]) for i in a for j in b)
    while True:
        best = min(((far(a, b), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(parts), 2)), default=(np.inf, 0, 0))
        if best[0] > most:
            return {tuple(sorted(p)) for p in parts}
        _, i, j = best
        parts[i] += parts.pop(j)


def test_complete_linkage():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 30):
        p = rng.uniform(0, 400, (n, 2))
        label = clusters.complete_link(p[:, 0], p[:, 1], 160.0)
        assert {tuple(np.flatnonzero(label == k)) for k in np.unique(label)} == brute_clusters(p.tolist(), 160.0)


def test_proposals(spark):
    rng = np.random.default_rng(4)
    rows = [(i, -82.6 + float(rng.uniform(0, 0.02)), 35.6 + float(rng.uniform(0, 0.02)), float(rng.uniform(0, 1)), ("narrative", "provision", "station")[i % 3], f"t{i}" if i % 4 else None) for i in range(150)]
    rows += [(200, None, 35.6, 0.5, "narrative", "x")]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, salience double, role string, title string")
    xy = {r.id: (r.x, r.y) for r in joins.with_cells(df.filter("lon is not null"), 160.0, 35.6).collect()}
    ids = sorted(xy)
    want = {tuple(ids[i] for i in c) for c in brute_clusters([xy[i] for i in ids], 160.0) if len(c) > 1}
    by = {r[0]: r for r in rows}
    got = {tuple(sorted(map(int, r.members))): r for r in clusters.proposals(df, 35.6).collect()}
    for c in want:
        pts = np.array([xy[i] for i in c])
        d = np.hypot(*(pts - pts.mean(0)).T)
        sal = 1 - np.prod([1 - by[i][3] for i in c])
        score = sal * (0.72 + 0.28 / (1 + np.sqrt((d * d).mean()) / 90))
        if score < 0.12:
            assert c not in got
            continue
        assert abs(got[c].score - score) < 1e-5 and abs(got[c].extent_m - d.max()) < 0.06
        titles = [by[i][5] for i in sorted(c, key=lambda i: -by[i][3]) if by[i][5]]
        assert got[c].name == (titles[0] if titles else None) and got[c].roles == sorted({by[i][4] for i in c})
    assert set(got) <= want
    no = spark.createDataFrame([([str(i) for i in c],) for c in list(got)[:3]] + [([],)], "members array<string>")
    assert len(clusters.proposals(df, 35.6, no).collect()) == len(got) - 3


def test_large_components_are_split(spark):
    rows = [(i, -82.6 + (i % 30) * 1e-5, 35.6 + (i // 30) * 1e-5) for i in range(900)]
    got = clusters.clustered(spark.createDataFrame(rows, "id long, lon double, lat double"), 35.6)
    assert got.count() == 900 and got.groupBy("group").count().agg(F.max("count")).first()[0] <= 400


def test_padding_stops_at_the_largest_area(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.25, 0.25), (0.0, 0.0, 0.3, 0.3)], "west double, south double, east double, north double")
    small, large = df.select(*[c.alias(n) for c, n in zip(boxes.padded(boxes.box()), ("w", "s", "e", "n"), strict=True)]).collect()
    km2 = lambda r: (r.e - r.w) * 111.32 * np.cos(np.radians((r.s + r.n) / 2)) * (r.n - r.s) * 111.32
    assert km2(small) > 0.25**2 * 111.32**2 and abs(km2(small) - 900) < 1 and (large.w, large.e) == (0.0, 0.3)
