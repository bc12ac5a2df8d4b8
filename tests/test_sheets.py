"""Map matching, chain contraction and cue sheets against brute force that walks row by row."""

import math
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from waymark.operators import cues, graphs, matching, scoring, sequences, sheets
from waymark.plans import sheets as plans

SF = "/root/testdata/sf0.001"
LAT0 = 35.6
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def brute_simplified(edges, kept):
    """Chains followed edge by edge from every end."""
    out, ins = defaultdict(list), defaultdict(list)
    for u, v, w in edges:
        out[u].append((v, w))
        ins[v].append(u)

    def passed(n):
        a, b = [v for v, _ in out[n]], ins[n]
        near = set(a) | set(b)
        return n not in kept and len(near) == 2 and n not in near and len(a) == len(b) == len(set(a)) == len(set(b)) and set(a) | set(b) == near and (len(a) == 2 or set(a) != set(b))

    found = []
    for u in {n for e in edges for n in e[:2]}:
        if passed(u):
            continue
        for v, w in list(out[u]):
            chain, total, before, at = 1, w, u, v
            while passed(at):
                (nxt, more), = [(x, y) for x, y in out[at] if x != before]
                before, at, total, chain = at, nxt, total + more, chain + 1
            found.append((u, at, round(total, 6), chain))
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_chains_are_those_of_a_walk(spark, seed):
    rng = random.Random(seed)
    edges, n = [], 40
    for _ in range(12):  # long chains between few ends, both ways or one
        a, b = rng.randrange(10), rng.randrange(10)
        way = [a, *range(n, n + rng.choice([0, 1, 3, 17])), b]
        n += len(way)
        pairs = list(zip(way, way[1:], strict=False))
        edges += [(u, v, rng.randrange(1, 99) / 4) for u, v in pairs]
        edges += [(v, u, rng.randrange(1, 99) / 4) for u, v in pairs] if rng.random() < 0.6 else []
    edges += [(500 + k, 500 + (k + 1) % 5, 1.0) for k in range(5)]  # a ring without an end
    edges += [(600, 601, 1.0), (600, 601, 2.0), (601, 602, 1.0), (7, 7, 3.0), (700, 701, 1.0)]
    kept = {n - 5, 44}
    df = spark.createDataFrame([*edges, (None, 3, 1.0), (3, None, 1.0)], "u long, v long, length_m double").withColumn("kind", (F.col("u") % 3).cast("string"))
    whole, members = graphs.simplified(df, spark.createDataFrame([(k,) for k in kept], "id long"), ("kind",))
    got = whole.collect()
    assert sorted((r.u, r.v, round(r.length_m, 6), r.n) for r in got) == brute_simplified(edges, kept)
    by = defaultdict(list)
    for r in members.collect():
        by[r.chain].append((r.place, r.u, r.v))
    for r in got:
        steps = sorted(by[r.chain])
        assert [s[0] for s in steps] == list(range(r.n)) and steps[0][1] == r.u and steps[-1][2] == r.v
        assert all(a[2] == b[1] for a, b in zip(steps, steps[1:], strict=False)) and r.kind == sorted({str(s[1] % 3) for s in steps})


def test_chains_of_an_empty_graph(spark):
    whole, members = graphs.simplified(spark.createDataFrame([], "u long, v long, length_m double"))
    assert whole.count() == members.count() == 0


def test_groups_begin_where_the_last_one_ended(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for key in range(5):
        nxt = {i: min(i + rng.randrange(1, 6), 61) for i in range(1, 61)}
        rows += [(key, i, j if j <= 60 else None) for i, j in nxt.items()]
        at = 1
        while at <= 60:
            want.update({(key, i): at for i in range(at, nxt[at])})
            at = nxt[at]
    got = sequences.chained(spark.createDataFrame(rows, "k long, i long, j long"), ["k"], "i", "j")
    assert {(r.k, r.i): r.chain for r in got.collect()} == want


def test_legs_are_listed_under_all_cells_that_they_come_near(spark):
    rng = random.Random(6)
    legs = [(i, *(rng.uniform(-400, 400) for _ in range(4))) for i in range(60)] + [(60, 5.0, 5.0, 5.0, 5.0), (61, 0.0, -90.0, 0.0, 90.0), (62, -90.0, 10.0, 90.0, 10.0)]
    df = spark.createDataFrame([(i, 0, *xy) for i, *xy in legs], "id long, k int, x double, y double, x2 double, y2 double")
    got = defaultdict(set)
    for r in matching.with_crossed_cells(df, 50.0, 8.0).collect():
        assert (r.cx, r.cy) not in got[r.id]
        got[r.id].add((r.cx, r.cy))
    for i, x, y, x2, y2 in legs:
        for s in range(301):
            px, py = x + (x2 - x) * s / 300, y + (y2 - y) * s / 300
            assert {(math.floor((px + dx) / 50), math.floor((py + dy) / 50)) for dx in (-8, 0, 8) for dy in (-8, 0, 8)} <= got[i]
        assert len(got[i]) <= 3 * (2 + (abs(x2 - x) + abs(y2 - y)) / 50)


def foot(px, py, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = 0.0 if dx == dy == 0 else max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - ax - t * dx, py - ay - t * dy), t


def test_nearest_legs_of_ones_own_line_however_far(spark):
    rng = random.Random(9)
    legs = [(k % 4, k, *(rng.uniform(-3000, 3000) for _ in range(4))) for k in range(80)]
    points = [(i, i % 5, rng.uniform(-20000, 20000), rng.uniform(-3000, 3000)) for i in range(60)]
    found = matching.nearest_legs(spark.createDataFrame([*points, (99, 0, None, 1.0)], "id long, line long, x double, y double"), spark.createDataFrame(legs, "line long, k long, x double, y double, x2 double, y2 double"), "line", "k", 20.0)
    got = {r.id: (r.k, round(r.distance_m, 4), round(r.t, 6)) for r in found.collect()}
    want = {}
    for i, line, px, py in points:
        best = min(((round(foot(px, py, *leg[2:])[0], 6), leg[1], foot(px, py, *leg[2:])[1]) for leg in legs if leg[0] == line), default=None)
        if best:
            want[i] = (best[1], round(best[0], 4), round(best[2], 6))
    assert got == want


@data
def test_match_rates(spark):
    edges, events = plans.load(spark, SF, "v_street"), plans.load(spark, SF, "v_road_event")
    pairs = {(r.event_id, r.edge_id) for r in matching.match_events(edges, events, LAT0).collect()}
    kinds, names = {r.event_id: (r.kind, r.name) for r in events.collect()}, {r.edge_id: r.name for r in edges.collect()}
    words = lambda n: set("".join(" " if c in "-/.," else c for c in (n or "").lower()).split()) - set(matching.DIRECTIONS)
    want = defaultdict(Counter)
    for e, (kind, _) in kinds.items():
        want[kind].update(events=1, matched=int(any(p[0] == e for p in pairs)))
    for e, g in pairs:
        a, b = words(kinds[e][1]), words(names[g])
        want[kinds[e][0]].update(edges=1, named=int(bool(a and b)), agree=int(bool(a & b)))
    got = {r.kind: r.asDict() for r in plans.agg_match_rates(spark, SF).collect()}
    assert {k: {c: v for c, v in r.items() if c != "kind"} for k, r in got.items()} == {k: {c: v[c] for c in ("events", "matched", "edges", "named", "agree")} for k, v in want.items()}


def bearing(a, b):
    (x, y), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    return math.degrees(math.atan2(math.sin(x2 - x) * math.cos(y2), math.cos(y) * math.sin(y2) - math.sin(y) * math.cos(y2) * math.cos(x2 - x))) % 360


def metres(a, b):
    (x, y), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y) / 2) ** 2 + math.cos(y) * math.cos(y2) * math.sin((x2 - x) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def plane(p):
    return math.radians(p[0]) * 6371000.0 * math.cos(math.radians(LAT0)), math.radians(p[1]) * 6371000.0


def brute_sheet(walk, spots, degree, places, hazards, portages, alternates):
    """The cue sheet of one walk, edge by edge and cue by cue."""
    walk = sorted(walk, key=lambda r: r.seq)
    line, at, edges, seen = [tuple(round(c, 7) for c in spots[walk[0].u])], [0.0], [], Counter()
    for r in walk:
        first = len(line) - 1
        p = tuple(round(c, 7) for c in spots[r.v])
        if p != line[-1]:
            at.append(at[-1] + metres(line[-1], p))
            line.append(p)
        key = frozenset((r.u, r.v))
        edges.append((r, at[first], at[-1], first, len(line) - 1, seen[key]))
        seen[key] += 1

    def along(p, most=math.inf):
        best = None
        for k in range(len(line) - 1):
            d, t = foot(*plane(p), *plane(line[k]), *plane(line[k + 1]))
            if best is None or round(d, 6) < best[0]:
                best = round(d, 6), at[k] + t * (at[k + 1] - at[k])
        return best[1] if best and best[0] <= most else None

    raw = []  # turns before they are joined
    for (r, _, end, _, i, _), (s, *_, again) in zip(edges, edges[1:], strict=False):
        back = max([k for k in range(i) if at[k] <= at[i] - 25], default=0)
        on = min([k for k in range(i + 1, len(line)) if at[k] >= at[i] + 25], default=len(line) - 1)
        if back == i or on == i:
            continue
        g1, g2 = bearing(line[back], line[i]), bearing(line[i], line[on])
        d = (g2 - g1 + 180) % 360 - 180
        size, side = abs(d), "left" if d < 0 else "right"
        same = r.name == s.name if r.name and s.name else bool(set(r.ways) & set(s.ways))
        if size < 30 or (size < 160 and degree[r.v] < 3) or (size < 120 and same):
            continue
        kind = "uturn" if size >= 160 else f"sharp_{side}" if size >= 120 else f"slight_{side}" if size < 45 else side
        onto = s.name or sheets.UNNAMED.get(s.highway, "the unnamed road")
        text = f"{cues.TURN_TEXT[kind]} at the end" if kind == "uturn" and degree[r.v] == 1 else f"{cues.TURN_TEXT[kind]} onto {onto}"
        raw.append([end, kind, onto, text, round(g2, 1), again > 0])
    side_of = lambda m: -1 if m in ("left", "slight_left", "sharp_left") else 1 if m in ("right", "slight_right", "sharp_right") else 0
    joined = []
    for t in raw:
        if joined and t[0] - joined[-1][0] <= 40 and (joined[-1][1] == "uturn") == (t[1] == "uturn"):
            last = joined[-1]
            if t[1] != "uturn":
                a, b = side_of(last[1]), side_of(t[1])
                if a and b and a != b:
                    one, two = ("left", "right") if a < 0 else ("right", "left")
                    last[1], last[3] = f"jog_{one}_{two}", f"Jog {one} then {two} onto {t[2]}"
                else:
                    last[3] = f"{cues.TURN_TEXT.get(last[1], 'Turn')} onto {t[2]}"
                last[4] = t[4]
            last[5] = last[5] or t[5]
            continue
        joined.append(list(t))
    sheet = [[0.0, "start", "Start", None, None, None, False]] + [[a, "turn", x, m, g, None, f] for a, m, _, x, g, f in joined]
    runs = []
    for r, start, end, *_ in edges:
        c = "paved" if (r.surface or "").lower() in scoring.PAVED else "gravel" if (r.surface or "").lower() in scoring.UNPAVED else None
        if c and runs and runs[-1][0] == c:
            runs[-1][2] = end
        elif c:
            runs.append([c, start, end])
    for a, b in zip(runs, runs[1:], strict=False):
        if a[2] - a[1] >= 150 and b[2] - b[1] >= 150:
            sheet.append([b[1], "surface", f"Surface changes to {sheets.SURFACES[b[0]]}", None, None, None, False])
    for p in sorted(places, key=lambda p: f"{p.id:020d}"):
        where = p.along_m if p.along_m is not None else along((p.lon, p.lat), 150)
        if where is None:
            continue
        prefix = sheets.PLACES.get(p.kind, "Point")
        title = p.title or prefix
        text = title if title.lower().startswith(prefix.lower()) else f"{prefix}: {title}"
        text += " — " + p.instructions.split("\n")[0] if p.kind == "transition" and p.instructions else ""
        has = [a for a in sheets.AMENITIES if a in (p.amenities or [])]
        text += " — " + ", ".join(has) if has else ""
        sheet.append([where, p.kind if p.kind in ("transition", "event") else "provision" if has else "node", text, None, None, str(p.id), False])
    for h in sorted(hazards, key=lambda h: f"{h.id:020d}"):
        where = h.along_m if h.along_m is not None else along((h.lon, h.lat)) if h.lon is not None else 0.0
        text = f"{sheets.LEADS.get(h.severity, 'Caution')}: {h.title or 'Hazard'}" + (" — " + h.safety_note.split("\n")[0] if h.safety_note else "")
        sheet.append([where, "hazard", text, None, None, str(h.id), False])
    sheet += sorted(([start, "constraint", ", ".join(r.flags), None, None, None, False] for r, start, *_ in edges if r.flags), key=lambda c: c[2])
    for p in sorted(portages, key=lambda p: f"{p.id:020d}"):
        parts = ["MANDATORY portage" if p.mandatory else "Portage"] + ([f"take out {sheets.BANKS[p.exit_bank]}"] if p.exit_bank else []) + ([f"{round(p.distance_m)} m carry"] if p.distance_m else [])
        sheet.append([along((p.lon, p.lat)), "portage", " — ".join(parts), None, None, str(p.id), False])
    for p in sorted(alternates, key=lambda p: f"{p.id:020d}"):
        where = p.diverges_at_m if p.diverges_at_m is not None else along((p.lon, p.lat), 20)
        if where is not None:
            kind = sheets.WAYS_ROUND.get(p.kind, "Alternate")
            sheet.append([where, "alternate", f"Branch — {p.label or kind}" if p.intent == "branch" else f"{kind} available: {p.label or kind}", None, None, str(p.id), False])
    sheet.append([at[-1], "finish", "Finish", None, None, None, False])
    rank = lambda c: cues.PRIORITY.get(c[1], cues.OTHER)
    out = []
    for c in sorted(sheet, key=lambda c: (c[0], rank(c))):  # sorted keeps the order of cues of one place and rank
        last = out[-1] if out else None
        if last and c[0] - last[0] <= 25 and not {c[1], last[1]} & set(cues.APART) and not c[1] == last[1] == "turn":
            keep, other = (last, c) if rank(last) <= rank(c) else (c, last)
            out[-1] = [last[0], keep[1], f"{keep[2]} ({other[2]})", keep[3], keep[4], keep[5], last[6] or c[6], last[7] + 1]
        else:
            out.append([*c, 1])
    for c in out:
        c[6] = c[6] or c[1] not in ("start", "finish") and any(again and start - 1 <= c[0] <= end + 1 for _, start, end, _, _, again in edges)
    return [(round(c[0], 1), *c[1:]) for c in out]


@data
def test_cue_sheets_of_all_walks(spark):
    walk, nodes, degrees = (t.collect() for t in plans._walk(spark, SF))
    spots, degree = {r.id: (r.lon, r.lat) for r in nodes}, {r.id: r.degree for r in degrees}
    parts = [f(spark, SF).collect() for f in (plans._places, plans._hazards, plans._portages, plans._alternates)]
    got = defaultdict(list)
    for r in plans.sheet_of(spark, SF).orderBy("route_id", "sequence").collect():
        assert r.sequence == len(got[r.route_id])
        got[r.route_id].append((r.along_m, r.kind, r.instruction, r.modifier, r.bearing_deg, r.ref_id, r.retrace, r.merged))
    routes = defaultdict(list)
    for r in walk:
        routes[r.route_id].append(r)
    kinds = Counter()
    for route, rows in routes.items():
        want = brute_sheet(rows, spots, degree, *([p for p in part if p.route_id == route] for part in parts))
        mine = got[route]
        assert len(mine) == len(want)
        for a, b in zip(mine, want, strict=True):
            assert a[1:4] == b[1:4] and a[5:] == b[5:] and abs(a[0] - b[0]) <= 0.1 and (a[4] == b[4] or abs(a[4] - b[4]) <= 0.1), (route, a, b)
            kinds[a[1]] += 1
    assert {"start", "turn", "node", "provision", "event", "hazard", "constraint", "portage", "finish"} <= set(kinds)
    assert any("available: " in r[2] or "Branch — " in r[2] for rows in got.values() for r in rows)


def test_cue_sheet_of_edges_with_a_shape(spark):
    """Points between the ends, drawn in either direction, an edge without length, and no author's places."""
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.01, 0.0), (3, 0.01, 0.01)], "id long, lon double, lat double")
    rows = [(7, 0, 1, 2, "A", ["a"], [(0.01, 0.0), (0.005, 0.001), (0.0, 0.0)]), (7, 1, 2, 2, "A", ["a"], None), (7, 2, 2, 3, "B", ["b"], None)]
    walk = spark.createDataFrame([(*r[:5], None, "path", r[5], [], r[6]) for r in rows], "route_id long, seq long, u long, v long, name string, surface string, highway string, ways array<string>, flags array<string>, points array<struct<lon:double,lat:double>>")
    edges, vertices = sheets.laid_out(walk, nodes)
    v = vertices.orderBy("seq").collect()
    assert [(r.lon, r.lat) for r in v] == [(0.0, 0.0), (0.005, 0.001), (0.01, 0.0), (0.01, 0.01)]
    e = edges.orderBy("seq").collect()
    assert e[0].end_m == e[1].start_m == e[1].end_m == e[2].start_m == v[2].at_m and [r.at for r in e] == [3, 3, 4]
    got = sheets.cue_sheet(walk, nodes, spark.createDataFrame([(2, 3)], "id long, degree long"), 0.0).orderBy("sequence").collect()
    assert [r.kind for r in got] == ["start", "turn", "turn", "finish"] or [r.kind for r in got] == ["start", "turn", "finish"]
    assert sheets.cue_sheet(walk.filter("false"), nodes, spark.createDataFrame([(2, 3)], "id long, degree long"), 0.0).count() == 0


def test_windows_open_at_the_first_row_that_none_holds(spark):
    rng = random.Random(13)
    rows = [(k, i, float(rng.randrange(400)) / 4) for k in range(4) for i in range(70)] + [(None, 1, 1.0), (2, 999, None)]
    got = sequences.opened_windows(spark.createDataFrame(rows, "k long, i long, t double"), ["k"], ["i"], "t", 7.5, 3)
    want = set()
    for k in range(4):
        opened, n = None, 0
        for t, i in sorted((t, i) for key, i, t in rows if key == k and t is not None):
            if opened is None or t - opened >= 7.5:
                opened, n = t, 0
            n += 1
            want.add((k, i, opened, n, n <= 3))
    assert {(r.k, r.i, r.opened, r.place, r.allowed) for r in got.collect()} == want
