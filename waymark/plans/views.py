"""Inputs derived from the supplied tables. Each is one SELECT over them that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


def pick(number: str, values: list[str | None]) -> str:
    """A CASE that goes round a list of texts; None is NULL."""
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v is not None)
    return f"CASE ({number}) % {len(values)} {arms} END"


HIGHWAYS = ["cycleway", "path", "track", "residential", "tertiary", "secondary", "primary", "footway", "service", None]
SURFACES = ["asphalt", "gravel", None, "dirt", "concrete", "sand", "compacted"]
MODES = ["cycling", "hiking", "paddling", "transit"]
KEYS = ["historic", "tourism", "amenity", "natural", "leisure"]
VALUES = ["castle", "viewpoint", "cafe", "peak", "park", "ruins", "museum"]
SEVERITIES = ["caution", "high", "mandatory_reroute", "caution", "caution", "high", "caution"]
STATUSES = ["denied", "required", "applied", "confirmed", "confirmed"]
CUES = ["turn", "surface", "node", "hazard", "event", "turn", "provision"]

VIEWS = {
    "v_feature": f"""SELECT p_partkey AS id, -82.6e0 + CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 AS lon,
        35.55e0 + CAST((p_partkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 AS lat, {pick("p_partkey", KEYS)} AS key,
        {pick("p_partkey * 3 + p_size", VALUES)} AS value, CAST(p_size AS DOUBLE) / 64e0 AS salience, p_partkey % 3 AS layer_no FROM part""",
    "v_node": """SELECT p_partkey AS id, -82.6e0 + CAST((p_partkey * 6151) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 AS lon,
        35.55e0 + CAST((p_partkey * 3079) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 AS lat FROM part""",
    "v_bbox": """SELECT n_nationkey AS request_id, -82.6e0 + CAST(n_nationkey % 5 AS DOUBLE) * 0.02e0 AS west, 35.55e0 + CAST(n_nationkey % 7 AS DOUBLE) * 0.012e0 AS south,
        -82.6e0 + CAST(n_nationkey % 5 AS DOUBLE) * 0.02e0 + 0.015e0 AS east, 35.55e0 + CAST(n_nationkey % 7 AS DOUBLE) * 0.012e0 + 0.01e0 AS north FROM nation""",
    "v_area": """SELECT s_suppkey AS area_key, -82.62e0 + CAST(s_suppkey % 11 AS DOUBLE) * 0.01e0 AS west, 35.53e0 + CAST(s_suppkey % 13 AS DOUBLE) * 0.008e0 AS south,
        -82.62e0 + CAST(s_suppkey % 11 AS DOUBLE) * 0.01e0 + 0.03e0 + CAST(s_suppkey % 4 AS DOUBLE) * 0.01e0 AS east,
        35.53e0 + CAST(s_suppkey % 13 AS DOUBLE) * 0.008e0 + 0.03e0 + CAST(s_suppkey % 3 AS DOUBLE) * 0.01e0 AS north,
        (s_suppkey * 17) % 90 AS age_days, 1000 + (s_suppkey * 7919) % 5000 AS bytes, s_suppkey % 6 = 0 AS pinned, s_suppkey % 4 AS store FROM supplier""",
    "v_edge": f"""SELECT l_orderkey AS route_id, l_partkey AS u, l_suppkey AS v, l_linenumber AS seq, l_extendedprice AS length_m, l_quantity AS climb_m,
        {pick("l_partkey + l_suppkey", HIGHWAYS)} AS highway, {pick("l_partkey", SURFACES)} AS surface,
        {pick("l_suppkey", ["no", None, "yes", None, "private", None, None])} AS access, {pick("l_partkey * 7", [None, "no", None, "destination", "yes"])} AS bicycle,
        {pick("l_partkey", [None, None, None, "yes", None, None, None, None])} AS ford, l_discount AS grade,
        CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount * 10e0 END AS traffic, l_tax AS salience, l_shipdate, l_returnflag, l_linestatus FROM lineitem""",
    "v_segment": f"""SELECT o_custkey AS trip_id, l_orderkey AS day_id, {pick("l_partkey", MODES)} AS mode, CAST(round(l_extendedprice * 100e0) AS BIGINT) AS distance_cm,
        CAST(l_quantity AS BIGINT) * 10 AS climb_m, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_discount * 10e0 END AS traffic
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_sample": """SELECT user_id, ts, event_id, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 37) % 900 AS DOUBLE) END AS alt_m,
        CAST(event_id AS DOUBLE) AS dist_m, event_type, value < 5e0 AS inside FROM events""",
    "v_hazard": f"""SELECT event_id AS hazard_id, user_id AS trip_id, event_id % 5 AS day_id, {pick("event_id * 3", SEVERITIES)} AS severity,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id * 37) % 9000 AS DOUBLE) END AS along_m FROM events""",
    "v_permit": f"""SELECT o_orderkey AS permit_id, o_custkey AS trip_id, {pick("o_orderkey * 3 + o_custkey", STATUSES)} AS status, o_orderpriority AS title FROM orders""",
    "v_cue": f"""SELECT event_id AS cue_id, user_id AS route_id, {pick("event_id * 5", CUES)} AS kind, CAST((event_id * 37) % 20011 AS DOUBLE) AS along_m FROM events""",
    "v_chain": """SELECT p_partkey AS u, CAST(floor(p_partkey / 2e0) AS BIGINT) AS v, p_retailprice AS length_m FROM part WHERE p_partkey > 1
        UNION ALL SELECT p_partkey AS u, 1 AS v, p_retailprice * 4e0 AS length_m FROM part WHERE p_partkey > 1""",
    "v_way": f"""SELECT l_orderkey AS route_id, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS seq, l_partkey AS u, l_suppkey AS v, l_extendedprice AS length_m, {pick("l_partkey + l_suppkey", HIGHWAYS)} AS highway,
        {pick("l_partkey * 3 + l_linenumber", ["asphalt", "sett", None, "mud", "Gravel", "tartan", "wood", "earth"])} AS surface, {pick("l_partkey", [None, "50", "35 mph", "walk", "30", None, "20 mph"])} AS maxspeed,
        {pick("l_suppkey", ["2", None, "4", " 5.0", "wide"])} AS lanes, {pick("l_partkey * 5 + l_suppkey", ["Mill Creek Trail", "Main Street", None, "Park Avenue", None, "Pathfinder Way"])} AS name,
        l_discount - 0.04e0 AS grade, {pick("l_suppkey", ["no", None, "yes", None, "private", None, None])} AS access, {pick("l_partkey * 7", [None, "no", None, "destination", "yes", "dismount", "private"])} AS bicycle,
        {pick("l_partkey", [None, None, "yes", "no", None])} AS foot, {pick("l_partkey + 1", [None, None, None, "permit", "yes"])} AS canoe, {pick("l_suppkey + 2", [None, "private", "yes", None])} AS motor_vehicle,
        {pick("l_partkey + l_linenumber", [None, "gate", None, "bollard", None, "cycle_barrier"])} AS barrier, {pick("l_partkey", [None, None, None, "yes", None, None, None, "stepping_stones"])} AS ford,
        {pick("l_suppkey", [None, "weir", None, None, "river", None])} AS waterway, {pick("l_partkey + l_suppkey * 3", [None, None, None, "no"])} AS contraflow, l_tax AS salience FROM lineitem""",
    "v_ring": """SELECT p_partkey AS shape_id, k, cx + r * cos(radians(turn * 60e0 * k)) AS lon, cy + r * 0.8e0 * sin(radians(turn * 60e0 * k)) AS lat FROM
        (SELECT p_partkey, k, -82.6e0 + CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 AS cx, 35.55e0 + CAST((p_partkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 AS cy,
        0.0004e0 * (2 + p_partkey % 5) * (2 + (p_partkey * k) % 3) / 4e0 AS r, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS turn
        FROM part CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS t(k))""",
    "v_track": """SELECT user_id AS route_id, event_id AS seq, -82.6e0 + CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 AS lon,
        35.55e0 + CAST((event_id * 6151) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 AS lat, event_type FROM events""",
    "v_street": f"""SELECT p_partkey AS edge_id, k, -82.6e0 + CAST((p_partkey * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 + CAST(k * ((p_partkey * 31) % 61 - 30) AS DOUBLE) * 0.00006e0 AS lon,
        35.55e0 + CAST((p_partkey * 104729) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 + CAST(k * ((p_partkey * 17) % 61 - 30) + (k % 2) * (p_partkey % 5) AS DOUBLE) * 0.00005e0 AS lat,
        {pick("p_partkey * 3", ["State Highway 142", "CTH-B", None, "Mill Creek Rd", "Main St."])} AS name FROM part CROSS JOIN (VALUES (0), (1), (2)) AS t(k) WHERE p_partkey % 6 > 0 OR k > 0""",
    "v_road_event": f"""SELECT c_custkey AS event_id, k, {pick("c_custkey", ["line", "point", "line", "polygon"])} AS kind, {pick("c_custkey * 7", ["WIS 142 WB", "Main", None, "County B NB"])} AS name,
        -82.6e0 + CAST((c_custkey * 6151) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 + CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN k IN (1, 2) THEN 0.002e0 ELSE 0e0 END ELSE CAST(k * ((c_custkey * 13) % 41 - 20) AS DOUBLE) * 0.00007e0 END AS lon,
        35.55e0 + CAST((c_custkey * 3079) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 + CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN k = 2 THEN 0.0015e0 ELSE 0e0 END ELSE CAST(k * ((c_custkey * 29) % 41 - 20) AS DOUBLE) * 0.00006e0 END AS lat
        FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(k) WHERE c_custkey % 4 = 3 OR (c_custkey % 4 = 1 AND k = 0) OR (c_custkey % 4 IN (0, 2) AND k < 2 + c_custkey % 3)""",
    "v_road": """SELECT p_partkey AS u, p_partkey + 1 AS v, p_retailprice AS length_m, p_size % 4 AS class FROM part UNION ALL SELECT p_partkey + 1 AS u, p_partkey AS v, p_retailprice AS length_m, p_size % 4 AS class FROM part WHERE CAST(floor(p_partkey / 64e0) AS BIGINT) % 3 <> 0
        UNION ALL SELECT p_partkey AS u, CAST(floor(p_partkey / 2e0) AS BIGINT) AS v, p_retailprice AS length_m, 7 AS class FROM part WHERE p_partkey % 64 = 0 UNION ALL SELECT CAST(floor(p_partkey / 2e0) AS BIGINT) AS u, p_partkey AS v, p_retailprice AS length_m, 7 AS class FROM part WHERE p_partkey % 64 = 0""",
    "v_walk": f"""SELECT route_id, seq, u, v, gx, gy, lon, lat, CASE WHEN h % 2 = 0 THEN {pick("gy + 5000", ["Mill Street", None, "Oak Avenue", None, "River Path"])} ELSE {pick("gx + 5000", ["First Road", "Second Road", None])} END AS name, CASE WHEN h % 2 = 0 THEN 100000 + gy ELSE 200000 + gx END AS way_id,
        {pick("gx + gy * 3 + 5000", ["residential", "path", "cycleway", "tertiary", None, "service"])} AS highway, {pick("CAST(floor(seq / 11e0) AS BIGINT) * 5 + seq % 3", ["asphalt", None, "gravel", "Concrete", "dirt", None, "tartan"])} AS surface, {pick("seq * 7 + route_id", [None] * 6 + ["ford=yes"] + [None] * 4 + ["barrier=gate"])} AS flag FROM
        (SELECT route_id, seq, h, gx, gy, (gx + 5000) * 100000 + gy + 5000 AS v, lag((gx + 5000) * 100000 + gy + 5000) OVER (PARTITION BY route_id ORDER BY seq) AS u, -82.6e0 + CAST(gx AS DOUBLE) * 0.0003e0 AS lon, 35.6e0 + CAST(gy AS DOUBLE) * 0.00025e0 AS lat FROM
        (SELECT route_id, seq, h, CAST(sum(CASE h % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gx, CAST(sum(CASE h % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS gy FROM
        (SELECT route_id, seq, CAST(sum(CASE m WHEN 7 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN 1 WHEN 10 THEN 3 WHEN 11 THEN 3 WHEN 12 THEN 2 ELSE 0 END) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS h FROM
        (SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, (event_id * 7919 + user_id * 31) % 13 AS m FROM events )))) WHERE u IS NOT NULL""",
    "v_place": f"""SELECT c_custkey AS id, CAST(1 + c_custkey % 40 AS BIGINT) AS route_id, {pick("c_custkey", ["poi", "rest_stop", "transition", "event", "via", "odd"])} AS kind, {pick("c_custkey * 3", ["Overlook Camp", None, "rest stop at the mill", "Point of interest", "Ferry"])} AS title,
        CASE WHEN c_custkey % 9 = 0 THEN CAST((c_custkey * 37) % 900 AS DOUBLE) END AS along_m, -82.6e0 + CAST((c_custkey * 37) % 61 - 30 AS DOUBLE) * 0.0003e0 AS lon, 35.6e0 + CAST((c_custkey * 53) % 47 - 23 AS DOUBLE) * 0.0003e0 AS lat FROM customer""",
    "v_anchor": """SELECT n_nationkey AS request, k, 32 * (1 + (n_nationkey * 7 + k * k * 13 + k) % j) AS node, k = 2 AS optional FROM nation CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(k) CROSS JOIN (SELECT CAST(floor(max(p_partkey) / 32e0) AS BIGINT) AS j FROM part ) AS m""",
    "v_stop": """SELECT c_custkey AS id, c_custkey % 50 AS route_id, -82.6e0 + CAST((c_custkey * 3079) % 10007 AS DOUBLE) / 10007e0 * 0.1e0 AS lon,
        35.55e0 + CAST((c_custkey * 7919) % 10009 AS DOUBLE) / 10009e0 * 0.1e0 AS lat, CAST((c_custkey * 37) % 90000 AS DOUBLE) AS at_m FROM customer""",
    "v_leg": f"""SELECT l_orderkey AS day_id, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS leg_id, l_linenumber AS seq, {pick("l_partkey", MODES)} AS mode,
        CASE WHEN l_partkey % 17 > 0 THEN CAST(round(l_extendedprice * 100e0) AS BIGINT) END AS distance, CAST(l_quantity AS BIGINT) * 10 AS climb,
        -82.6e0 + CAST((l_suppkey * 7919) % 1009 AS DOUBLE) / 1009e0 * 0.02e0 AS start_lon, 35.55e0 + CAST((l_suppkey * 131) % 997 AS DOUBLE) / 997e0 * 0.02e0 AS start_lat,
        CASE WHEN l_partkey % 19 > 0 THEN -82.6e0 + CAST((l_partkey * 6151) % 1009 AS DOUBLE) / 1009e0 * 0.02e0 END AS end_lon, 35.55e0 + CAST((l_partkey * 173) % 997 AS DOUBLE) / 997e0 * 0.02e0 AS end_lat FROM lineitem""",
    "v_link": f"""SELECT day_id, leg_id AS link_id, leg_id AS from_leg, CASE WHEN leg_id % 11 = 0 THEN leg_id WHEN leg_id % 13 = 0 THEN 0 ELSE next_leg END AS to_leg, {pick("leg_id", ["cycling", None, None])} AS from_mode, CAST(NULL AS STRING) AS to_mode FROM
        (SELECT l_orderkey AS day_id, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS leg_id, lead(CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey) AS next_leg FROM lineitem ) WHERE next_leg IS NOT NULL""",
    "v_leg_node": f"""SELECT l_orderkey AS day_id, CAST(l_linenumber AS BIGINT) * 10000000000 + CAST(l_partkey AS BIGINT) * 10000 + l_suppkey AS leg_id, k, CASE WHEN (l_suppkey + k) % 4 > 0 THEN CAST((l_partkey * (k + 3)) % 97 AS DOUBLE) END AS along_m, {pick("l_partkey + k * k", ["rising", "resolution", None])} AS stage
        FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) AS t(k) WHERE (l_partkey + k) % 3 > 0""",
    "v_day": """SELECT o_custkey AS trip_id, o_orderkey AS day_id, (o_orderkey * 7) % 31 AS index, CASE WHEN o_orderkey % 9 = 0 THEN 'rest' ELSE 'route' END AS kind FROM orders""",
    "v_trip_band": """SELECT c_custkey AS trip_id, mode, low, CASE WHEN c_custkey % 7 > 0 THEN high END AS high FROM customer CROSS JOIN (VALUES ('hiking', 3000000, 6000000), ('cycling', 4000000, 8000000), ('paddling', 2000000, 5000000)) AS t(mode, low, high) WHERE c_custkey % 3 > 0""",
    "v_day_band": """SELECT o_orderkey AS day_id, 'cycling' AS mode, 1000000 AS low, CAST(NULL AS INT) AS high FROM orders WHERE o_orderkey % 4 = 0""",
}


def load(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A derived view as a DataFrame; only the tables that it names are read."""
    text = VIEWS[view]
    names = [t for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ")]
    return spark.sql(text, **{}) if not names else spark.sql(_bound(text, names), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def _bound(text: str, names: list[str]) -> str:
    for t in names:
        text = f"{text} ".replace(f" {t} ", f" {{{t}}} ").rstrip()
    return text


def oracle(body: str, *views: str) -> str:
    """SQL over derived views, which stand in front of it as common table expressions."""
    own = body.startswith("WITH ")
    return ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + (", " if own else " ") + (body[5:] if own else body)) if views else body
