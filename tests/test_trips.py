"""Trips put together from days, against a plain walk over them."""

import random

from waymark.operators import trips

DAY = "trip_id long, day_id long, index long, kind string"
LEG = "day_id long, leg_id long, seq long, mode string, distance long, climb long, start_lon double, start_lat double, end_lon double, end_lat double"
NODE = "day_id long, leg_id long, k long, along_m double, stage string"
BAND = "mode string, low long, high long"


def some_trips(seed):
    rng = random.Random(seed)
    days = [(rng.randrange(6), d, rng.randrange(4), rng.choice(["rest", "route", "route"])) for d in range(40)]
    legs, nodes = [], []
    for d in range(34):
        for s in range(rng.randrange(5)):
            leg = 100 * d + s
            legs.append((d, leg, s, rng.choice(["walk", "ride", "row"]), rng.choice([None, 5, 20, 60]), rng.randrange(9), 0.0, 0.0, rng.choice([None, 0.0, 0.01]), 0.0))
            nodes += [(d, leg, k, rng.choice([None, 1.0, 2.0]), rng.choice(["resolution", "rising", None])) for k in range(rng.randrange(4))]
    trip_bands = [(t, m, 15, 70) for t in range(5) for m in ("walk", "ride")]
    day_bands = [(d, "walk", None if d % 2 else 50, 55) for d in range(0, 40, 3)]
    return days, legs, nodes, trip_bands, day_bands


def walked(days, legs, nodes, trip_bands, day_bands):
    own, band = {(d, m): (lo, hi) for d, m, lo, hi in day_bands}, {(t, m): (lo, hi) for t, m, lo, hi in trip_bands}
    totals, breaches = {}, []
    for trip in {d[0] for d in days}:
        place, ordered = 0, sorted((d for d in days if d[0] == trip), key=lambda d: (d[2], d[1]))
        for no, (_, day, _, _) in enumerate(ordered, 1):
            mine = sorted(x for x in legs if x[0] == day)
            modes = {}
            for x in mine:
                if x[4] is not None:
                    modes[x[3]] = modes.get(x[3], 0) + x[4]
                    for key in ((trip, no, x[3]), (trip, no, None), (trip, None, x[3]), (trip, None, None)):
                        a, b = totals.get(key) or (0, 0)
                        totals[key] = a + x[4], b + x[5]
            totals.setdefault((trip, no, None), (None, None))
            ends = sorted((n for n in nodes if mine and n[1] == mine[-1][1]), key=lambda n: (n[3] is None, n[3] or 0.0))
            closes = bool(ends) and ends[-1][4] == "resolution"
            for m, length in modes.items():
                lo, hi = own.get((day, m)) or band.get((trip, m)) or (None, None)
                if lo is not None and length < lo and not closes:
                    breaches.append((trip, place := place + 1, no, m, "min", lo, length))
                if hi is not None and length > hi:
                    breaches.append((trip, place := place + 1, no, m, "max", hi, length))
        totals[trip, None, None] = (*totals.get((trip, None, None), (None, None)), len(ordered))
    return totals, breaches


def frames(spark, data):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(data, (DAY, LEG, NODE, f"trip_id long, {BAND}", f"day_id long, {BAND}"), strict=True)]


def test_trips_equal_a_walk(spark):
    for seed in (1, 2):
        data = some_trips(seed)
        totals, breaches = trips.composed(*frames(spark, data))
        want, listed = walked(*data)
        got = {(r.trip_id, r.day_no, r.mode): (r.distance, r.climb, *([r.day_count] if r.day_count else [])) for r in totals.collect()}
        assert got == want and len(want) > 60
        assert sorted(tuple(r) for r in breaches.collect()) == sorted(listed) and {"min", "max"} == {b[4] for b in listed}


def test_no_legs(spark):
    days = [(1, 1, 1, "rest"), (1, 2, 1, "route")]
    totals, breaches = trips.composed(*frames(spark, (days, [], [], [], [])))
    assert sorted((r.day_no or 0, r.distance, r.day_count) for r in totals.collect()) == [(0, None, 2), (1, None, None), (2, None, None)]
    assert breaches.count() == 0
    totals, breaches = trips.composed(*frames(spark, ([], [], [], [], [])))
    assert totals.count() == breaches.count() == 0


def test_links_are_checked(spark):
    legs = [(1, 10, 0, "walk", 5, 0, 0.0, 0.0, 0.0, 0.0), (1, 11, 1, "ride", 5, 0, 0.0, 0.01, None, 0.0), (1, 12, 2, "row", 5, 0, 0.0, 0.0, 0.0, 0.0), (2, 20, 0, "row", 5, 0, 0.0, 0.0, 0.0, 0.0)]
    links = [(1, 1, 10, 11, None, "bus"), (1, 2, 11, 12, None, None), (1, 3, 10, 12, None, None), (1, 4, 12, 11, "x", None), (1, 5, 10, 20, None, None), (2, 6, 20, None, None, None), (3, 7, 10, 11, None, None)]
    days = [(1, 1, 1, "route"), (1, 2, 2, "rest"), (1, 3, 3, "rest"), (None, 4, 1, None)]
    link = spark.createDataFrame(links, "day_id long, link_id long, from_leg long, to_leg long, from_mode string, to_mode string")
    got = {r.link_id: r for r in trips.checked_links(spark.createDataFrame(days, DAY), spark.createDataFrame(legs, LEG), link).collect()}
    assert {k: r.fault for k, r in got.items()} == {1: None, 2: None, 3: "not adjacent", 4: "not adjacent", 5: "unknown leg", 6: "unknown leg", 7: "unknown leg", None: "rest day with legs"}
    assert (got[1].from_mode, got[1].to_mode, round(got[1].gap_m), got[1].gap_warning) == ("walk", "bus", 1112, True)
    assert (got[2].from_mode, got[2].gap_m, got[2].gap_warning, got[4].from_mode, got[3].to_mode, got[None].day_id) == ("ride", None, None, "x", None, 2)
