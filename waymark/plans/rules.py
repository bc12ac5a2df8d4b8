"""Queries on rule tables, fitted speeds, documents, element closures and requests on graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.operators import corridors, documents, graphs, rules, sequences
from waymark.streaming import arrivals

from .catalog import R, query
from .views import load

NETWORKS = {
    "walk": '["highway"]["highway"!~"primary|service"]["access"!="private"]["foot"!~"no"]',
    "ride": '["highway"~"way|path|res|tert"]["bicycle"!="no"]["surface"!~"sand|mud"]',
    "gravel": '["surface"~"grav|dirt|earth"]["access"!~"no|private"]',
    "named": '["name"]["barrier"="gate"]',
    "any": '["access"!="private"]',
}
_TAGS = ("highway", "access", "bicycle", "foot", "surface", "name", "barrier")


def _clause_sql() -> str:
    """Each network's clauses in SQL's own words."""
    import re

    out = []
    for network, text in NETWORKS.items():
        ok = []
        for key, op, value in re.findall(rules.CLAUSE, text):
            hit = f"regexp_matches({key}, '{value}')" if "~" in op else f"{key} = '{value}'"
            ok.append(f"coalesce(NOT {hit}, true)" if op.startswith("!") else f"coalesce({hit}, false)" if op else f"{key} IS NOT NULL")
        out.append(f"SELECT seq AS way_id, '{network}' AS network FROM v_way WHERE {' AND '.join(ok)}")
    return " UNION ALL ".join(out)


@query(f"SELECT network, count(*) AS n, CAST(sum(way_id % 1000003) AS BIGINT) AS check_sum FROM ({_clause_sql()}) GROUP BY network", "v_way")
def flt_network_ways(spark, sf_dir):
    """SRC-10, FLT-02: ways that pass each network's filter, read from its text into a table of clauses and joined on keys."""
    ways = load(spark, sf_dir, "v_way").select(F.concat_ws("/", "route_id", "seq").alias("way_id"), "seq", *_TAGS)
    tags = ways.select("way_id", "seq", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in _TAGS])).alias("t"))
    tags = tags.select("way_id", F.when(F.col("t.value").isNotNull(), F.col("t.key")).alias("key"), "t.value")
    found = rules.ways_passing(tags, rules.clauses(spark.createDataFrame(list(NETWORKS.items()), "network string, filter string")))
    n = F.split_part("way_id", F.lit("/"), F.lit(2)).cast("long")
    return found.groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.sum(n % 1000003).alias("check_sum"))


#: By key of a feature: keys of which one must be there, values of keys, least area.
GATES = [("historic", ["name", "wikidata"], {"heritage": ["1", "2"]}, None), ("tourism", [], {"value": ["viewpoint", "museum"]}, None), ("natural", None, None, 400.0), ("amenity", [], {}, None)]


@query(
    """SELECT key, qualified, count(*) AS n FROM (SELECT key, CASE key WHEN 'historic' THEN coalesce(name <> '', false) OR coalesce(heritage IN ('1', '2'), false) WHEN 'tourism' THEN value IN ('viewpoint', 'museum') WHEN 'natural' THEN coalesce(area >= 400e0, false) ELSE true END AS qualified FROM
    (SELECT key, value, CASE id % 4 WHEN 0 THEN 'x' WHEN 1 THEN '' END AS name, CASE id % 5 WHEN 0 THEN '2' WHEN 1 THEN '9' END AS heritage, CASE WHEN id % 6 > 0 THEN CAST((id * 37) % 900 AS DOUBLE) END AS area FROM v_feature)) GROUP BY key, qualified""",
    "v_feature",
)
def flt_gates(spark, sf_dir):
    """FLT-05: features that their type's gate lets through, from a table of gates."""
    k = F.col("id")
    name, heritage = F.when(k % 4 == 0, "x").when(k % 4 == 1, ""), F.when(k % 5 == 0, "2").when(k % 5 == 1, "9")
    tags = F.map_filter(F.create_map(F.lit("value"), F.col("value"), F.lit("name"), name, F.lit("heritage"), heritage), lambda _, v: v.isNotNull())
    rows = load(spark, sf_dir, "v_feature").select("id", F.col("key").alias("rule"), tags.alias("tags"), F.when(k % 6 > 0, ((k * 37) % 900).cast("double")).alias("area_m2"))
    gates = spark.createDataFrame(GATES, "rule string, requires_any array<string>, requires_value map<string, array<string>>, min_area_m2 double")
    return rules.qualified(rows, gates).groupBy(F.col("rule").alias("key"), "qualified").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT t.route_id, t.seq, min_by(s.profile, s.ord) AS profile FROM (SELECT route_id, seq, CAST(30 * seq AS DOUBLE) AS at FROM v_walk) t LEFT JOIN (SELECT id AS ord, route_id, CAST((id * 37) % 1500 AS DOUBLE) AS a, CAST((id * 37) % 1500 + (id * 13) % 700 AS DOUBLE) AS b, kind AS profile FROM v_place) s
    ON s.route_id = t.route_id AND t.at >= s.a AND t.at < s.b GROUP BY t.route_id, t.seq""",
    "v_walk", "v_place",
)
def flt_position_weights(spark, sf_dir):
    """FLT-29: the profile that holds at each place of a walk: that of the first scope that has it; null: the default."""
    places = load(spark, sf_dir, "v_place")
    start = ((F.col("id") * 37) % 1500).cast("double")
    scopes = places.select("route_id", F.col("id").alias("ord"), start.alias("start"), (start + (F.col("id") * 13) % 700).alias("end"), F.col("kind").alias("profile"))
    rows = load(spark, sf_dir, "v_walk").select("route_id", "seq", (30.0 * F.col("seq")).alias("at"))
    return rules.weights_at(rows, scopes, 400.0).select("route_id", "seq", "profile")


OLD_NAMES = {"mountain_biking": "cycling", "packrafting": "paddling"}


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'hiking,cycling' WHEN 1 THEN 'cycling,transit' WHEN 2 THEN '' WHEN 3 THEN 'paddling,hiking' WHEN 4 THEN 'transit,cycling,hiking' ELSE 'cycling' END AS modes FROM part"""
)
def set_mode_fold(spark, sf_dir):
    """SET-07: lists of modes with old names replaced and repeats dropped, in the order in which they came."""
    texts = ("hiking, mountain_biking,hiking,cycling", "cycling,transit,mountain_biking", " , ,", "packrafting,hiking,paddling", "transit,,cycling,hiking,transit", "cycling")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % 6 + 1).cast("int")).alias("modes"))
    return rules.folded_modes(rows, "modes", OLD_NAMES)


#: Trips with the seconds that they took and the seconds a metre that they had; terrain by climb.
_TRIPS = """SELECT trip_id, mode, CASE WHEN sum(climb_m) < 900 THEN 'flat' ELSE 'hilly' END AS terrain, CAST(sum(distance_cm) AS BIGINT) AS cm, CAST(sum(distance_cm // (20 + climb_m // 10)) AS BIGINT) AS s FROM v_segment WHERE trip_id % 50 < 20 GROUP BY trip_id, mode"""


def _trips(spark, sf_dir):
    c = F.expr("distance_cm DIV (20 + climb_m DIV 10)")
    rows = load(spark, sf_dir, "v_segment").filter("trip_id % 50 < 20").groupBy("trip_id", "mode").agg(F.when(F.sum("climb_m") < 900, "flat").otherwise("hilly").alias("terrain"), F.sum("distance_cm").cast("long").alias("cm"), F.sum(c).cast("long").alias("s"))
    return rows


@query(
    f"""WITH a AS ({_TRIPS}), g AS (SELECT mode, terrain, CAST(sum(cm) AS DOUBLE) / sum(s) AS v FROM a GROUP BY GROUPING SETS ((mode, terrain), (mode))) SELECT mode, terrain, round(v, 6) AS cm_s FROM g""", "v_segment"
)
def agg_fitted_speeds(spark, sf_dir):
    """AGG-30: speeds by mode and terrain as summed distance by summed time, with the mode's own to fall back on."""
    fine = _trips(spark, sf_dir).groupBy("mode", "terrain").agg(F.sum("cm").alias("cm"), F.sum("s").alias("s"))
    whole = fine.groupBy("mode").agg(F.lit(None).cast("string").alias("terrain"), F.sum("cm").alias("cm"), F.sum("s").alias("s"))
    return fine.unionByName(whole).select("mode", "terrain", F.round(F.col("cm").cast("double") / F.col("s"), 6).alias("cm_s"))


@query(
    f"""WITH a AS ({_TRIPS}), p AS (SELECT a.*, (SELECT count(*) FROM a b WHERE b.mode = a.mode) - 1 AS others, sum(cm) OVER m - cm AS mcm, sum(s) OVER m - s AS ms, sum(cm) OVER t - cm AS tcm, sum(s) OVER t - s AS ts, count(*) OVER t - 1 AS alike FROM a WINDOW m AS (PARTITION BY mode), t AS (PARTITION BY mode, terrain)),
    e AS (SELECT mode, alike > 0 AS alike, round(abs(cm / (CASE WHEN alike > 0 THEN CAST(tcm AS DOUBLE) / ts ELSE CAST(mcm AS DOUBLE) / ms END) - s) / s * 100e0, 1) AS ape FROM p WHERE others > 0 AND s > 0 AND (CASE WHEN alike > 0 THEN ts ELSE ms END) > 0)
    SELECT mode, count(*) FILTER (WHERE alike) AS n, round(avg(ape) FILTER (WHERE alike), 2) AS mape, count(*) FILTER (WHERE NOT alike) AS n_extrapolated, round(avg(ape) FILTER (WHERE NOT alike), 2) AS extrapolated_mape, count(*) FILTER (WHERE ape <= 10) AS within_10, count(*) FILTER (WHERE ape <= 20) AS within_20, max(ape) AS worst FROM e GROUP BY mode""",
    "v_segment",
)
def agg_held_out_error(spark, sf_dir):
    """AGG-31: each trip's time as the speeds of all others of its mode and terrain give it (of its mode where none is
    alike), its error in percent, and by mode the mean, the worst and the shares within 10 and 20 %."""
    rows = _trips(spark, sf_dir)
    sums = lambda *k: rows.groupBy(*k).agg(F.sum("cm").alias(f"cm{len(k)}"), F.sum("s").alias(f"s{len(k)}"), F.count(F.lit(1)).alias(f"n{len(k)}"))
    p = rows.join(sums("mode"), "mode").join(sums("mode", "terrain"), ["mode", "terrain"])
    alike = F.col("n2") > 1
    cm, s = F.when(alike, F.col("cm2")).otherwise(F.col("cm1")) - F.col("cm"), F.when(alike, F.col("s2")).otherwise(F.col("s1")) - F.col("s")
    p = p.select("mode", "s", alike.alias("alike"), (F.col("cm") / (cm.cast("double") / F.nullif(s, F.lit(0)))).alias("guess"), s.alias("rest"), "n1").filter("n1 > 1 AND s > 0 AND rest > 0")
    e = p.select("mode", "alike", F.round(F.abs(F.col("guess") - F.col("s")) / F.col("s") * 100, 1).alias("ape"))
    yes, no = F.when(F.col("alike"), F.col("ape")), F.when(~F.col("alike"), F.col("ape"))
    return e.groupBy("mode").agg(F.count(yes).alias("n"), F.round(F.avg(yes), 2).alias("mape"), F.count(no).alias("n_extrapolated"), F.round(F.avg(no), 2).alias("extrapolated_mape"), F.count_if(F.col("ape") <= 10).alias("within_10"), F.count_if(F.col("ape") <= 20).alias("within_20"), F.max("ape").alias("worst"))


@query("SELECT area_key, east <= west OR north <= south OR (north - south) * 111320e0 < 200e0 OR (east - west) * 111320e0 * cos(radians((north + south) / 2e0)) < 200e0 AS degenerate FROM (SELECT area_key, west, south, west + (east - west) * (area_key % 3) / 60e0 AS east, north FROM v_area)", "v_area")
def flt_small_boxes(spark, sf_dir):
    """FLT-11: boxes of no extent, or of less than 200 m a side."""
    from waymark.functions import geo

    rows = load(spark, sf_dir, "v_area").withColumn("east", F.col("west") + (F.col("east") - F.col("west")) * (F.col("area_key") % 3) / 60.0)
    w, s, e, n = (F.col(c) for c in ("west", "south", "east", "north"))
    return rows.select("area_key", ((e <= w) | (n <= s) | ((n - s) * geo.DEGREE_M < 200) | ((e - w) * geo.DEGREE_M * F.cos(F.radians((n + s) / 2)) < 200)).alias("degenerate"))


@query()
def set_document_diff(spark, sf_dir):
    """SET-10: two versions of nested documents compared path by path; a brute-force test covers it."""
    f, k = load(spark, sf_dir, "v_feature"), F.col("id")
    doc = lambda new: F.to_json(F.struct(
        "id", "key", F.when(k % (7 if new else 5) > 0, F.col("value")).alias("value"), F.array_repeat(F.struct("layer_no", "key"), (k % (3 + new)).cast("int")).alias("parts"),
        F.struct(F.round("lon", 4 - new).alias("lon"), F.when(k % 9 > 0, F.struct("lat", "salience")).alias("more")).alias("at"),
    ))
    return documents.document_diff(f.filter("id % 11 > 0").select("id", doc(0).alias("doc")), f.filter("id % 13 > 0").select("id", doc(1).alias("doc")))


@query(
    """WITH n AS (SELECT id, lon, lat FROM v_node), w AS (SELECT DISTINCT edge_id AS way_id, 1 + (edge_id * 7 + k * 31) % (SELECT count(*) FROM v_node) AS node_id FROM v_street), m AS (SELECT edge_id AS relation_id, 'way' AS type, 1 + (edge_id * 3) % (SELECT count(*) FROM v_node) AS ref FROM v_street WHERE edge_id % 5 = 0 UNION ALL SELECT edge_id, 'node', edge_id FROM v_street WHERE edge_id % 15 = 0),
    i AS (SELECT id FROM n WHERE lon BETWEEN -82.58e0 AND -82.55e0 AND lat BETWEEN 35.58e0 AND 35.6e0), h AS (SELECT DISTINCT way_id FROM w WHERE node_id IN (SELECT id FROM i))
    SELECT 'node' AS type, id FROM (SELECT id FROM i UNION SELECT node_id FROM w WHERE way_id IN (SELECT way_id FROM h)) UNION ALL SELECT 'way', way_id FROM h UNION ALL SELECT DISTINCT 'relation', relation_id FROM m WHERE (type = 'way' AND ref IN (SELECT way_id FROM h)) OR (type = 'node' AND ref IN (SELECT id FROM i))""",
    "v_node", "v_street",
)
def join_complete_ways(spark, sf_dir):
    """JOIN-19: what a cut to a box keeps, with its ways whole and the relations that touch it."""
    nodes, street = load(spark, sf_dir, "v_node"), load(spark, sf_dir, "v_street")
    n = nodes.count()
    e = F.col("edge_id")
    ways = street.select(e.alias("way_id"), (1 + (e * 7 + F.col("k") * 31) % n).alias("node_id")).distinct()
    members = street.filter("edge_id % 5 = 0").select(e.alias("relation_id"), F.lit("way").alias("type"), (1 + (e * 3) % n).alias("ref")).unionByName(street.filter("edge_id % 15 = 0").select(e.alias("relation_id"), F.lit("node").alias("type"), e.alias("ref")))
    return graphs.complete_ways(nodes, ways, members, -82.58, 35.58, -82.55, 35.6)


@query()
def gra_longest_runs(spark, sf_dir):
    """GRA-15: the longest shortest path of each component, by two sweeps; a brute-force test covers it."""
    return graphs.longest_runs(load(spark, sf_dir, "v_chain")).select("component", "a", "b", F.round("length_m", 2).alias("length_m"))


@query()
def gra_circuits(spark, sf_dir):
    """GRA-03: requests of several anchors solved together on the simplified roads, with prices for what was ridden; a
    brute-force test with a search of its own covers it."""
    whole, _ = graphs.simplified(load(spark, sf_dir, "v_road"))
    anchors = load(spark, sf_dir, "v_anchor")
    relief = anchors.filter("k < 2").select("request", "node")
    return graphs.circuits(whole.select("u", "v", F.col("length_m").alias("cost")), anchors, relief).select("request", "leg", "place", "u", "v", F.round("cost", 2).alias("cost"))


@query(
    f"""WITH r AS (SELECT w.route_id AS user_id, p.id AS role_id, w.seq, 2e0 * {R} * asin(least(1e0, sqrt(power(sin((radians(p.lat) - radians(w.lat)) / 2e0), 2) + cos(radians(w.lat)) * cos(radians(p.lat)) * power(sin(radians(p.lon - w.lon) / 2e0), 2)))) <= 120e0 AS inside FROM v_walk w JOIN v_place p ON p.route_id = w.route_id WHERE p.id % 3 <> 1),
    s AS (SELECT *, CASE WHEN inside AND lag(inside, 1, false) OVER o AND lag(inside, 2, false) OVER o THEN seq END AS hit FROM r WINDOW o AS (PARTITION BY user_id, role_id ORDER BY seq)) SELECT user_id, role_id, min(hit) AS seq FROM s GROUP BY user_id, role_id HAVING min(hit) IS NOT NULL""",
    "v_walk", "v_place",
)
def str_arrivals(spark, sf_dir):
    """STR-02, STR-03: the reading at which each place of a walk is reached, once for good; a test runs it as a stream."""
    walk = load(spark, sf_dir, "v_walk").select(F.col("route_id").alias("user_id"), F.col("route_id").alias("trip_id"), F.timestamp_seconds(F.col("seq")).alias("ts"), F.col("seq").cast("long").alias("seq"), "lon", "lat")
    roles = load(spark, sf_dir, "v_place").select(F.col("id").alias("role_id"), F.col("route_id").alias("trip_id"), "lon", "lat", F.lit(120.0).alias("radius_m"), (F.col("id") % 3 != 1).alias("on_arrival"))
    return arrivals.arrivals(arrivals.near_roles(walk, roles)).select("user_id", "role_id", F.unix_seconds("ts").alias("seq"))


@query(
    """WITH s AS (SELECT user_id, event_id, CAST((event_id * 37) % 5000 AS DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 37) % 5000, event_id) AS i FROM events), f AS (WITH RECURSIVE f AS (SELECT user_id, event_id, t, i, t AS opened, 1 AS place FROM s WHERE i = 1
    UNION ALL SELECT s.user_id, s.event_id, s.t, s.i, CASE WHEN s.t - f.opened < 600e0 THEN f.opened ELSE s.t END, CASE WHEN s.t - f.opened < 600e0 THEN f.place + 1 ELSE 1 END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT * FROM f) SELECT user_id, event_id, opened, place, place <= 8 AS allowed FROM f"""
)
def str_opened_windows(spark, sf_dir):
    """STR-06: requests of a caller counted in windows that the first one opens, and those above the ceiling."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", ((F.col("event_id") * 37) % 5000).cast("double").alias("at"))
    return sequences.opened_windows(rows, ["user_id"], ["event_id"], "at", 600.0, 8).select("user_id", "event_id", "opened", "place", "allowed")


_KM = 6371.0088
_AREA = f"radians(east - west) * (sin(radians(north)) - sin(radians(south))) * {_KM * _KM}e0"
_WIDE = "radians(east - west) * cos(radians((south + north) / 2e0)) >= radians(north - south)"


@query(
    f"""WITH b AS (WITH RECURSIVE b AS (SELECT area_key, 0 AS depth, west, south, west + (east - west) * (1 + area_key % 40) AS east, south + (north - south) * (1 + area_key % 7) AS north FROM v_area UNION ALL SELECT area_key, depth + 1, CASE WHEN wide AND h = 1 THEN (west + east) / 2e0 ELSE west END, CASE WHEN NOT wide AND h = 1 THEN (south + north) / 2e0 ELSE south END,
    CASE WHEN wide AND h = 0 THEN (west + east) / 2e0 ELSE east END, CASE WHEN NOT wide AND h = 0 THEN (south + north) / 2e0 ELSE north END FROM (SELECT *, {_WIDE} AS wide FROM b WHERE {_AREA} > 150e0) CROSS JOIN (VALUES (0), (1)) AS t(h)) SELECT * FROM b)
    SELECT area_key, depth, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM b WHERE {_AREA} <= 150e0""",
    "v_area",
)
def geo_capped_boxes(spark, sf_dir):
    """GEO-23: boxes halved along their longer side until each is at most 150 square kilometres."""
    from waymark.functions import boxes

    a = load(spark, sf_dir, "v_area")
    k = F.col("area_key")
    rows = a.select("area_key", "west", "south", (F.col("west") + (F.col("east") - F.col("west")) * (1 + k % 40)).alias("east"), (F.col("south") + (F.col("north") - F.col("south")) * (1 + k % 7)).alias("north"))
    out = boxes.split_to_cap(rows, 150.0)
    return out.select("area_key", "depth", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


_LEG = "radians(greatest(f.east, l.east) - least(f.west, l.west)) * (sin(radians(greatest(f.north, l.north))) - sin(radians(least(f.south, l.south))))"


@query(
    f"""WITH p AS (SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY seq) AS i, lon, lat, degrees(asin({math.sin(0.2 / _KM)!r} / cos(radians(lat)))) AS x, {math.degrees(0.2 / _KM)!r} AS y FROM v_walk),
    l AS (SELECT a.route_id, a.i, least(a.lon - a.x, b.lon - b.x) AS west, least(a.lat - a.y, b.lat - b.y) AS south, greatest(a.lon + a.x, b.lon + b.x) AS east, greatest(a.lat + a.y, b.lat + b.y) AS north FROM p a JOIN p b ON b.route_id = a.route_id AND b.i = a.i + 1),
    f AS (WITH RECURSIVE f AS (SELECT route_id, i, i AS first, west, south, east, north FROM l WHERE i = 1 UNION ALL SELECT route_id, i, CASE WHEN fits THEN first ELSE i END, CASE WHEN fits THEN least(fw, west) ELSE west END, CASE WHEN fits THEN least(fs, south) ELSE south END, CASE WHEN fits THEN greatest(fe, east) ELSE east END, CASE WHEN fits THEN greatest(fn, north) ELSE north END FROM
    (SELECT l.*, f.first, f.west AS fw, f.south AS fs, f.east AS fe, f.north AS fn, {_LEG} * {_KM * _KM}e0 <= 0.45e0 AS fits FROM f JOIN l ON l.route_id = f.route_id AND l.i = f.i + 1)) SELECT * FROM f)
    SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY first) AS tile, first, max(i) + 1 AS last, round(min(west), 6) AS west, round(min(south), 6) AS south, round(max(east), 6) AS east, round(max(north), 6) AS north FROM f GROUP BY route_id, first""",
    "v_walk",
)
def geo_corridor_tiles(spark, sf_dir):
    """GEO-23: walks covered with 200 m around them by boxes of at most 0.45 square kilometres, as many legs to a box as fit;
    the SQL folds leg by leg."""
    rows = load(spark, sf_dir, "v_walk").select("route_id", "seq", "lon", "lat")
    out = corridors.tiles(rows, ["route_id"], ["seq"], 0.2, 0.45)
    return out.select("route_id", "tile", "first", "last", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query(
    """SELECT user_id, event_id, count(*) AS spent, greatest(3 - count(*), 0) AS remaining, CASE WHEN count(*) >= 3 THEN list_extract(list(c ORDER BY c DESC), 3) + 86400000000 END AS free_at FROM
    (SELECT a.user_id, a.event_id, epoch_us(b.ts) AS c FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOUR) GROUP BY user_id, event_id"""
)
def str_call_ledger(spark, sf_dir):
    """STR-08: calls of each caller in the 24 hours up to each call, what is left of a ceiling of 3, and when one more may be
    made; the SQL compares all pairs."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sequences.rolling_ledger(rows, ["user_id"], "at", 86_400_000_000, 3).select("user_id", "event_id", "spent", "remaining", "free_at")
