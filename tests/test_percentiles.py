"""Percentiles by narrowing counts against sorted lists."""

import random

from waymark.operators import rollups


def test_percentiles_are_those_of_sorted_values(spark):
    rng = random.Random(21)
    rows = [("even", float(k)) for k in range(997)] + [("one", 4.5)] * 30 + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randrange(-9, 9)) for _ in range(90)] + [(None, 1.0), (None, 2.0), ("none", None)]
    rows += [("close", 1.0 + k * 2.0**-52) for k in range(50)] + [("two", float(k % 2)) for k in range(9)]
    rows += [("inf", v) for v in (float("-inf"), -1e308, 1e308, 3.0, 4.0, 5.0, float("inf"), float("inf"))]
    got = {r.k: r for r in rollups.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    assert set(got) == {k for k, v in rows if v is not None}
    for key, r in got.items():
        values = sorted(v for k, v in rows if k == key and v is not None)
        pick = lambda share: values[min(len(values) - 1, int(share * len(values)))]  # noqa: B023, E731
        assert (r.n, r.a, r.b, r.c, r.d) == (len(values), pick(0.0), pick(0.5), pick(0.95), pick(1.0)), key


def test_percentiles_of_nothing(spark):
    assert rollups.percentiles(spark.createDataFrame([("x", None)], "k string, v double"), ["k"], "v", {"a": 0.5}).count() == 0
