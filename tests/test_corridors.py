"""Corridor tiles and the rolling ledger against plain folds."""

import math
import random

import pytest

from waymark.functions.boxes import EARTH_KM
from waymark.operators import corridors, sequences


def area(b):
    return math.radians(b[2] - b[0]) * (math.sin(math.radians(b[3])) - math.sin(math.radians(b[1]))) * EARTH_KM**2


def about(lon, lat, km):
    r = km / EARTH_KM
    x = math.degrees(math.asin(min(1.0, math.sin(r) / math.cos(math.radians(lat)))))
    return lon - x, lat - math.degrees(r), lon + x, lat + math.degrees(r)


def both(a, b):
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def halves(b, most):
    if area(b) <= most:
        return [b]
    w, s, e, n = b
    if math.radians(e - w) * math.cos(math.radians((s + n) / 2)) >= math.radians(n - s):
        return halves((w, s, (w + e) / 2, n), most) + halves(((w + e) / 2, s, e, n), most)
    return halves((w, s, e, (s + n) / 2), most) + halves((w, (s + n) / 2, e, n), most)


def fold(line, km, most):
    legs = [both(about(*p, km), about(*q, km)) for p, q in zip(line, line[1:])]
    out, i = [], 0
    while i < len(legs):
        j, b = i + 1, legs[i]
        while j < len(legs) and area(both(b, legs[j])) <= most:
            b, j = both(b, legs[j]), j + 1
        out += [(i + 1, j + 1, *p) for p in sorted(halves(b, most), key=lambda p: (p[1], p[0]))]
        i = j
    return [(k + 1, *t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_tiles_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    lines = {}
    for key in range(12):
        p = [rng.uniform(-100, 100), rng.uniform(-60, 60)]
        lines[key] = []
        for _ in range(rng.choice([1, 2, 3, 40, 300])):
            lines[key].append(tuple(p))
            step = rng.choice([0.0, 0.002, 0.02, 0.02, 0.3 if rng.random() < 0.1 else 0.01])
            p = [p[0] + rng.uniform(-1, 2) * step, p[1] + rng.uniform(-1, 1) * step]
    rows = [(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)] + [(3, 10_000, None, 1.0), (None, 1, 1.0, 1.0), (99, 1, 2.0, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "route long, at int, lon double, lat double")
    got = {}
    for r in sorted(corridors.tiles(df, ["route"], ["at"], 2.0, 60.0).collect(), key=lambda r: (r.route, r.tile)):
        got.setdefault(r.route, []).append((r.tile, r.first, r.last, r.west, r.south, r.east, r.north))
    want = {k: t for k, line in lines.items() if (t := fold(line, 2.0, 60.0))}
    assert got.keys() == want.keys()
    assert sum(len(t) for t in want.values()) > 60 and any(a[1:3] == b[1:3] for t in want.values() for a, b in zip(t, t[1:]))
    for k in want:
        assert [t[:3] for t in got[k]] == [t[:3] for t in want[k]]
        assert all(x == pytest.approx(y, abs=1e-9) for a, b in zip(got[k], want[k]) for x, y in zip(a[3:], b[3:]))


def test_no_points_have_no_tiles(spark):
    assert corridors.tiles(spark.createDataFrame([], "route long, at int, lon double, lat double"), ["route"], ["at"], 2.0, 60.0).count() == 0


@pytest.mark.parametrize("ceiling", [1, 3, 7])
def test_ledger_equals_a_fold(spark, ceiling):
    rng = random.Random(ceiling)
    rows = [(i, None if i % 50 == 0 else rng.choice(["a", "a", "b", "c"]), None if i % 70 == 1 else rng.randrange(-500, 900)) for i in range(600)] + [(600 + i, "d", 100 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, caller string, at long").repartition(5)
    got = {r.id: (r.spent, r.remaining, r.free_at) for r in sequences.rolling_ledger(df, ["caller"], "at", 100, ceiling).collect()}
    want = {}
    for i, caller, at in rows:
        if caller is not None and at is not None:
            held = sorted(t for _, c, t in rows if c == caller and t is not None and at - 100 < t <= at)
            want[i] = (len(held), max(0, ceiling - len(held)), held[-ceiling] + 100 if len(held) >= ceiling else None)
    assert got == want and all(got[600 + i][0] == 1 for i in range(9))


def test_ledger_refuses_no_width(spark):
    with pytest.raises(ValueError):
        sequences.rolling_ledger(spark.range(1).withColumnRenamed("id", "at"), [], "at", 0, 1)
