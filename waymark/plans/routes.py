"""Queries on edges, walks and metrics. Ids at the head of a docstring are the survey's operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import clusters, graphs, joins, scoring, shapes, walks
from waymark.sources.scratch import settle

from .catalog import BUCKET, CELL_JOIN, LAT0, _case, listed, query
from .geometry import LEGS
from .views import load

SPEED = f"""CASE WHEN lower(trim(maxspeed)) LIKE '%mph' THEN TRY_CAST(replace(lower(trim(maxspeed)), 'mph', '') AS DOUBLE) * 1.60934e0 ELSE TRY_CAST(trim(maxspeed) AS DOUBLE) END"""
LANES = "CAST(trunc(TRY_CAST(trim(lanes) AS DOUBLE)) AS INTEGER)"
STRESS = f"CASE WHEN highway IN ({listed(scoring.CALM)}) OR coalesce({SPEED} >= 50e0, false) OR coalesce({LANES} >= 4, false) THEN {_case(scoring.TRAFFIC, 'highway', 0.5)} ELSE 0e0 END"
SCENIC = "(coalesce(highway IN ('cycleway', 'path'), false) OR regexp_matches(lower(coalesce(name, '')), 'trail|creek|park|greenway|path'))"
#: v_way with its features; a missing class counts as unclassified.
WAY = f"(SELECT *, {STRESS} AS stress, {_case(scoring.SURFACE_QUALITY, 'surface', 0.6)} AS quality, {SCENIC} AS scenic, abs(grade) AS steep, {BUCKET} AS bucket FROM (SELECT * REPLACE (coalesce(highway, 'unclassified') AS highway) FROM v_way))"
#: CELL_JOIN with distances as they are.
CELL_RAW = CELL_JOIN.replace("round(sqrt", "(sqrt").replace(", 2) AS distance_m", ") AS distance_m")
#: Heights of nodes; every ninth is unknown.
HEIGHT = "(SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST((id * 37) % 900 AS DOUBLE) END AS elevation FROM v_node)"


def _ways(spark, sf_dir):
    f = scoring.edge_features(*[F.col(c) for c in ("length_m", "highway", "surface", "maxspeed", "lanes", "name", "grade")])
    return load(spark, sf_dir, "v_way").withColumn("f", f)


def _heights(spark, sf_dir):
    return load(spark, sf_dir, "v_node").select("id", F.when(F.col("id") % 9 != 0, ((F.col("id") * 37) % 900).cast("double")).alias("elevation"))


@query(f"SELECT maxspeed, lanes, round({SPEED}, 4) AS kmh, {LANES} AS n_lanes, count(*) AS n FROM v_way GROUP BY ALL", "v_way")
def scl_speed_lanes(spark, sf_dir):
    """SCL-04: speed limits and lanes out of their tags."""
    rows = load(spark, sf_dir, "v_way").groupBy("maxspeed", "lanes").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("maxspeed", "lanes", F.round(scoring.speed_kmh(F.col("maxspeed")), 4).alias("kmh"), scoring.lane_count(F.col("lanes")).alias("n_lanes"), "n")


@query(f"SELECT highway, stress, quality, scenic, bucket, count(*) AS n, round(max(steep), 4) AS steepest FROM {WAY} GROUP BY highway, stress, quality, scenic, bucket", "v_way")
def scl_edge_features(spark, sf_dir):
    """SCL-02, SCL-03, FLT-23: what an edge is scored by."""
    rows = _ways(spark, sf_dir).select(F.coalesce("highway", F.lit("unclassified")).alias("highway"), "f.stress", "f.quality", "f.scenic", "f.bucket", "f.grade")
    return rows.groupBy("highway", "stress", "quality", "scenic", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("grade"), 4).alias("steepest"))


#: Weights for each class of surface, one of them an aversion.
DIAL = {"paved": 0.4, "gravel": -0.5, "singletrack": 1.0}


@query(
    f"""SELECT highway, bucket, count(*) AS n, CAST(sum(CAST(round(length_m * greatest(1e0 + (0.9e0 * stress * 2e0 - CASE WHEN scenic THEN 0.9e0 * 0.35e0 ELSE 0e0 END - CASE bucket WHEN 'paved' THEN 0.4e0 WHEN 'gravel' THEN -0.5e0 WHEN 'singletrack' THEN 1e0 ELSE 0e0 END * 0.6e0
    + 0.7e0 * (least(steep, 0.12e0) / 0.12e0) * 0.6e0 - 0.5e0 * salience * 0.6e0) * 0.8e0, 0.05e0)) AS BIGINT)) AS BIGINT) AS cost FROM {WAY} GROUP BY highway, bucket""",
    "v_way",
)
def scl_edge_cost_full(spark, sf_dir):
    """SCL-01: edge costs for a profile that shuns gravel and climbs, with stress behind its gate."""
    profile = {"quiet": 0.9, "scenic": 0.9, "peaks": -0.7, "interest": 0.5, "directness": 0.2}
    cost = scoring.edge_cost(F.col("f.length"), F.col("f.stress"), F.col("f.scenic"), scoring.lookup(DIAL, F.col("f.bucket")), F.col("f.grade"), F.col("salience"), profile)
    rows = _ways(spark, sf_dir).select(F.coalesce("highway", F.lit("unclassified")).alias("highway"), "f.bucket", F.round(cost).cast("long").alias("cost"))
    return rows.groupBy("highway", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query(f"SELECT surface, CASE WHEN lower(surface) IN ({listed(scoring.PAVED)}) THEN 'paved' WHEN lower(surface) IN ({listed(scoring.UNPAVED)}) THEN 'gravel' END AS kind, count(*) AS n FROM v_way GROUP BY ALL", "v_way")
def flt_surface_class(spark, sf_dir):
    """FLT-24: the two classes that a cue speaks of."""
    return load(spark, sf_dir, "v_way").groupBy("surface", scoring.surface_class(F.col("surface")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT route_id, round(total, 2) AS distance_m, climb_m, descent_m, round(s / total, 6) AS traffic, round(up / total, 6) AS unpaved_frac, round(sc / total, 6) AS scenic_frac, round(sal / total, 6) AS salience, round(steepest, 4) AS max_grade, edge_count,
    round(again / total, 6) AS overlap_frac, round(near / total, 6) AS overlap_near_frac, round((again - near) / total, 6) AS overlap_far_frac FROM (SELECT route_id, sum(length_m) AS total, sum(greatest(coalesce(rise, 0e0), 0e0)) AS climb_m,
    sum(greatest(coalesce(-rise, 0e0), 0e0)) AS descent_m, sum(stress * length_m) AS s, sum(CASE WHEN quality < 0.6e0 THEN length_m ELSE 0e0 END) AS up, sum(CASE WHEN scenic THEN length_m ELSE 0e0 END) AS sc, sum(salience * length_m) AS sal,
    max(steep) AS steepest, count(*) AS edge_count, sum(CASE WHEN k > 1 THEN length_m ELSE 0e0 END) AS again, sum(CASE WHEN k > 1 AND near THEN length_m ELSE 0e0 END) AS near FROM
    (SELECT w.*, b.elevation - a.elevation AS rise, row_number() OVER (PARTITION BY route_id, least(u, v), greatest(u, v) ORDER BY seq) AS k, coalesce(u % 2 = 0 AND v % 2 = 0 AND a.id IS NOT NULL AND b.id IS NOT NULL, false) AS near
    FROM (SELECT * REPLACE (u % 3 AS u, v % 5 AS v) FROM {WAY}) w LEFT JOIN {HEIGHT} a ON a.id = w.u LEFT JOIN {HEIGHT} b ON b.id = w.v) GROUP BY route_id)""",
    "v_way", "v_node",
)
def agg_route_metrics(spark, sf_dir):
    """AGG-01: the metrics of walks. Ends are folded so that edges come again."""
    heights = _heights(spark, sf_dir)
    walk = _ways(spark, sf_dir).withColumn("u", F.col("u") % 3).withColumn("v", F.col("v") % 5)
    out = walks.route_metrics(walk, "route_id", "seq", heights, heights.filter("id % 2 = 0"))
    digits = {"distance_m": 2, "max_grade": 4} | dict.fromkeys(("traffic", "unpaved_frac", "scenic_frac", "salience", "overlap_frac", "overlap_near_frac", "overlap_far_frac"), 6)
    return out.select([F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


MERGE = """round(CASE WHEN count(traffic) = 0 THEN NULL ELSE sum(traffic * distance_cm) / sum(CASE WHEN traffic IS NOT NULL THEN distance_cm END) END, 6) AS traffic, max(grade) AS max_grade"""
LEGS_SQL = "(SELECT o_custkey AS trip_id, l_orderkey AS day_id, CASE l_partkey % 4 WHEN 0 THEN 'cycling' WHEN 1 THEN 'hiking' WHEN 2 THEN 'paddling' ELSE 'transit' END AS mode, CAST(round(l_extendedprice * 100e0) AS BIGINT) AS distance_cm, CAST(l_quantity AS BIGINT) AS climb_m, CASE WHEN l_partkey % 3 > 0 THEN NULL ELSE l_discount END AS traffic, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_tax END AS grade FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    f"""SELECT trip_id, day_id, mode, CAST(sum(distance_cm) AS BIGINT) AS distance_cm, CAST(sum(climb_m) AS BIGINT) AS climb_m, {MERGE} FROM {LEGS_SQL} GROUP BY GROUPING SETS ((trip_id, day_id, mode), (trip_id, day_id), (trip_id, mode), (trip_id))"""
)
def agg_rollup_sets(spark, sf_dir):
    """AGG-02, AGG-03, AGG-04: metrics of days and trips, whole and by mode, unknown shares kept apart from zero. Each level
    is put together from the finest one, which holds the known lengths."""
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    modes = F.element_at(F.array(*[F.lit(m) for m in ("cycling", "hiking", "paddling", "transit")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    legs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("trip_id"), F.col("l_orderkey").alias("day_id"), modes.alias("mode"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("distance_cm"), F.col("l_quantity").cast("long").alias("climb_m"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_discount")).alias("traffic"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_tax")).alias("grade"),
    )
    known = F.when(F.col("traffic").isNotNull(), F.col("distance_cm"))
    fine = legs.groupBy("trip_id", "day_id", "mode").agg(F.sum("distance_cm").alias("distance_cm"), F.sum("climb_m").alias("climb_m"), F.sum(F.col("traffic") * F.col("distance_cm")).alias("t"), F.sum(known).alias("k"), F.max("grade").alias("max_grade"))
    levels = fine.groupingSets([["trip_id", "day_id", "mode"], ["trip_id", "day_id"], ["trip_id", "mode"], ["trip_id"]], "trip_id", "day_id", "mode")
    out = levels.agg(F.sum("distance_cm").alias("distance_cm"), F.sum("climb_m").alias("climb_m"), F.sum("t").alias("t"), F.sum("k").alias("k"), F.max("max_grade").alias("max_grade"))
    return out.select("trip_id", "day_id", "mode", "distance_cm", "climb_m", F.round(F.col("t") / F.nullif(F.col("k"), F.lit(0)), 6).alias("traffic"), "max_grade")


@query(
    """SELECT trip_id, day_id, mode, bound, limit_cm, CAST(distance_cm AS BIGINT) AS distance_cm FROM (SELECT *, CASE WHEN distance_cm > high THEN 'max' WHEN distance_cm < low AND NOT closes THEN 'min' END AS bound, CASE WHEN distance_cm > high THEN high ELSE low END AS limit_cm FROM
    (SELECT trip_id, day_id, mode, sum(distance_cm) AS distance_cm, CASE WHEN day_id % 4 = 0 THEN 1000000 ELSE 3000000 END AS low, CASE WHEN day_id % 4 = 0 THEN NULL WHEN mode = 'cycling' THEN 8000000 ELSE 6000000 END AS high, day_id % 3 = 0 AS closes FROM v_segment
    WHERE mode <> 'transit' GROUP BY trip_id, day_id, mode)) WHERE bound IS NOT NULL""",
    "v_segment",
)
def agg_day_breaches(spark, sf_dir):
    """AGG-05: days beyond their mode's band. A day's own band stands in for the trip's as a whole, and a day that closes on
    purpose may be short."""
    band = lambda low, high: F.struct(F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))
    trip = F.create_map(*[x for m, b in {"cycling": (3_000_000, 8_000_000), "hiking": (3_000_000, 6_000_000), "paddling": (3_000_000, 6_000_000)}.items() for x in (F.lit(m), band(*b))])
    day = F.when(F.col("day_id") % 4 == 0, F.create_map(*[x for m in ("cycling", "hiking", "paddling") for x in (F.lit(m), band(1_000_000, None))]))
    sums = load(spark, sf_dir, "v_segment").groupBy("trip_id", "day_id", "mode").agg(F.sum("distance_cm").alias("distance_cm"))
    rows = sums.withColumn("b", F.coalesce(F.element_at(day, F.col("mode")), F.element_at(trip, F.col("mode")))).withColumn("closes", F.col("day_id") % 3 == 0)
    bound = F.when(F.col("distance_cm") > F.col("b.high"), "max").when((F.col("distance_cm") < F.col("b.low")) & ~F.col("closes"), "min")
    rows = rows.withColumn("bound", bound).filter("bound is not null")
    return rows.select("trip_id", "day_id", "mode", "bound", F.when(F.col("bound") == "max", F.col("b.high")).otherwise(F.col("b.low")).alias("limit_cm"), "distance_cm")


@query(
    """SELECT route_id, seq, flags, round(upto - length_m) AS along_m FROM (SELECT route_id, seq, length_m, sum(length_m) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS upto,
    concat_ws(',', CASE WHEN coalesce(foot, access) IS NULL AND barrier = 'gate' THEN 'barrier=gate' END, CASE WHEN ford IN ('yes', 'stepping_stones') THEN 'ford=' || ford END) AS flags, CASE WHEN foot IS NULL THEN access IN ('no', 'private') ELSE foot = 'no' OR (foot = 'private' AND barrier IS NOT NULL) END AS shut FROM v_way)
    WHERE flags <> '' AND NOT coalesce(shut, false)""",
    "v_way",
)
def win_flags_along(spark, sf_dir):
    """WIN-17: what to mention along a walk on foot, and where the hop begins."""
    rows = load(spark, sf_dir, "v_way")
    tags = {k: F.when(F.col(k).isNotNull(), F.array(k)) for k in ("access", "foot", "barrier", "ford")}
    rows = scoring.with_legality(rows, tags, ["hiking"]).withColumn("flags", F.col("hiking.flags"))
    return walks.flagged_hops(rows, "route_id", "seq", "length_m", "flags").select("route_id", "seq", F.array_join("flags", ",").alias("flags"), F.round("along_m").alias("along_m"))


@query(
    """SELECT u, v, false AS added, count(*) AS n FROM v_way GROUP BY u, v UNION ALL SELECT v, u, true, count(*) FROM v_way a WHERE contraflow = 'no' AND NOT EXISTS (SELECT 1 FROM v_way b WHERE b.u = a.v AND b.v = a.u) GROUP BY v, u""", "v_way"
)
def flt_contraflow(spark, sf_dir):
    """FLT-09: edges against a one-way street that cycles may use, where there is none yet."""
    rows = load(spark, sf_dir, "v_way").select("u", "v", F.coalesce(F.col("contraflow") == "no", F.lit(False)).alias("contraflow"))
    return walks.contraflow(rows).groupBy("u", "v", "added").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT u, v, seq, route_id, CASE WHEN b.elevation - a.elevation IS NOT NULL THEN greatest(b.elevation - a.elevation, 0e0) END AS gain_m, round((b.elevation - a.elevation) / length_m, 3) AS grade FROM v_way w
    LEFT JOIN {HEIGHT} a ON a.id = w.u LEFT JOIN {HEIGHT} b ON b.id = w.v""",
    "v_way", "v_node",
)
def gra_elevation_grades(spark, sf_dir):
    """GRA-11: gain and grade of edges from the heights of their ends."""
    rows = load(spark, sf_dir, "v_way").select("route_id", "seq", "u", "v", "length_m")
    return walks.with_grades(rows, _heights(spark, sf_dir)).select("u", "v", "seq", "route_id", "gain_m", "grade")


@query(
    """SELECT w.u, w.v, concat_ws(',', w.barrier, CASE WHEN a.b IS DISTINCT FROM w.barrier THEN a.b END, CASE WHEN c.b IS DISTINCT FROM w.barrier AND c.b IS DISTINCT FROM a.b THEN c.b END) AS barriers, count(*) AS n FROM v_way w
    LEFT JOIN (SELECT id, CASE id % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'stile' END AS b FROM v_node) a ON a.id = w.u LEFT JOIN (SELECT id, CASE id % 3 WHEN 0 THEN 'gate' WHEN 1 THEN 'stile' END AS b FROM v_node) c ON c.id = w.v GROUP BY ALL""",
    "v_way", "v_node",
)
def join_barrier_fold(spark, sf_dir):
    """JOIN-10: barriers on nodes handed to the edges that meet there."""
    nodes = load(spark, sf_dir, "v_node").select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("gate"))).when(F.col("id") % 3 == 1, F.array(F.lit("stile"))).alias("barrier"))
    edges = load(spark, sf_dir, "v_way").select("u", "v", F.when(F.col("barrier").isNotNull(), F.array("barrier")).alias("barrier"))
    out = walks.fold_node_tags(edges, nodes)
    return out.select("u", "v", F.array_join("barrier", ",").alias("barriers")).groupBy("u", "v", "barriers").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT u, v, max(greatest(coalesce(a.s, 0e0), coalesce(b.s, 0e0))) AS salience FROM v_way w LEFT JOIN (SELECT n.id, max(x.s) AS s FROM (SELECT * FROM (SELECT f.salience AS s, n.id AS snap, row_number() OVER (PARTITION BY f.id ORDER BY n.d, n.id) AS k FROM v_feature f JOIN
    (SELECT left_id, right_id AS id, distance_m AS d FROM ({CELL_RAW} FROM v_feature a JOIN v_node b ON abs(a.lat - b.lat) < 0.004e0) WHERE distance_m <= 150e0) n ON n.left_id = f.id) WHERE k = 1) x JOIN
    (SELECT left_id AS snap, right_id AS id FROM ({CELL_RAW} FROM v_node a JOIN v_node b ON abs(a.lat - b.lat) < 0.004e0) WHERE distance_m <= 150e0) n ON n.snap = x.snap GROUP BY n.id) a ON a.id = w.u
    LEFT JOIN (SELECT n.id, max(x.s) AS s FROM (SELECT * FROM (SELECT f.salience AS s, n.id AS snap, row_number() OVER (PARTITION BY f.id ORDER BY n.d, n.id) AS k FROM v_feature f JOIN
    (SELECT left_id, right_id AS id, distance_m AS d FROM ({CELL_RAW} FROM v_feature a JOIN v_node b ON abs(a.lat - b.lat) < 0.004e0) WHERE distance_m <= 150e0) n ON n.left_id = f.id) WHERE k = 1) x JOIN
    (SELECT left_id AS snap, right_id AS id FROM ({CELL_RAW} FROM v_node a JOIN v_node b ON abs(a.lat - b.lat) < 0.004e0) WHERE distance_m <= 150e0) n ON n.snap = x.snap GROUP BY n.id) b ON b.id = w.v
    GROUP BY u, v HAVING max(greatest(coalesce(a.s, 0e0), coalesce(b.s, 0e0))) > 0""",
    "v_way", "v_feature", "v_node",
)
def join_interest(spark, sf_dir):
    """JOIN-04: an edge takes the greatest salience among features near a node that is near its ends; none stays unset."""
    nodes, f = load(spark, sf_dir, "v_node"), load(spark, sf_dir, "v_feature")
    snap = joins.nearest(f, nodes, 150.0, LAT0).filter("right_id is not null").join(f.select(F.col("id").alias("left_id"), "salience").hint("merge"), "left_id")
    best = snap.groupBy(F.col("right_id").alias("left_id")).agg(F.max("salience").alias("s"))  # few features share a node, so this is small before the spread
    valued = settle(nodes.join(best.hint("merge"), F.col("id") == F.col("left_id")).select("id", "lon", "lat", "s"), "valued")
    near = joins.greatest_within(valued, nodes, "s", 150.0, LAT0)
    rows = load(spark, sf_dir, "v_way").select("u", "v").distinct()
    for side in ("u", "v"):
        rows = rows.join(near.select(F.col("right_id").alias(side), F.col("s").alias(f"s_{side}")).hint("merge"), side, "left")
    return rows.select("u", "v", F.greatest("s_u", "s_v").alias("salience")).filter("salience > 0")


@query(
    f"""SELECT left_id, right_id FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY round(CASE WHEN spread > 0 THEN 0.8e0 * (e - low) / spread ELSE 0e0 END - 0.5e0 * distance_m / 400e0, 6) DESC, right_id) AS k FROM (SELECT *, min(e) OVER (PARTITION BY left_id) AS low,
    max(e) OVER (PARTITION BY left_id) - min(e) OVER (PARTITION BY left_id) AS spread FROM (SELECT c.*, CAST((right_id * 37) % 900 AS DOUBLE) AS e FROM ({CELL_JOIN} FROM v_feature a JOIN v_node b ON abs(a.lat - b.lat) < 0.006e0) c WHERE distance_m <= 400e0))) WHERE k = 1""",
    "v_feature", "v_node",
)
def join_biased_node(spark, sf_dir):
    """JOIN-03: the node that trades nearness for height within a radius; a search that widens, no window over a hot point."""
    nodes = load(spark, sf_dir, "v_node").withColumn("e", ((F.col("id") * 37) % 900).cast("double"))
    return joins.biased_nearest(load(spark, sf_dir, "v_feature"), nodes, "e", 400.0, LAT0, 0.8, 0.5, 2)


@query(
    """SELECT id, CASE WHEN c IS NULL THEN 0e0 ELSE round((c - 2.5e0) / 2.5e0, 6) END AS peaks, CASE WHEN t IS NULL THEN 0.5e0 ELSE round((5e0 - t) / 5e0, 6) END AS quiet, CASE WHEN i IS NULL THEN 0e0 ELSE round(i / 5e0, 6) END AS interest, round((c2 - 2.5e0) / 2.5e0, 6) AS surface_gravel FROM
    (SELECT id, CASE id % 4 WHEN 0 THEN own ELSE day END AS c, CASE id % 4 WHEN 0 THEN NULL ELSE day + 1 END AS t, CASE id % 4 WHEN 0 THEN own ELSE NULL END AS i, CASE id % 4 WHEN 0 THEN 4e0 ELSE 1e0 END AS c2 FROM (SELECT id, CAST(id % 6 AS DOUBLE) AS own, CAST(id % 5 AS DOUBLE) AS day FROM v_feature))""",
    "v_feature",
)
def flt_author_weights(spark, sf_dir):
    """FLT-27, FLT-28, SCL-24: the most specific profile as a whole, then the solver's weights from the author's dials."""
    f = load(spark, sf_dir, "v_feature")
    dials = lambda c, t, i, g: F.struct(c.alias("climbing"), t.alias("traffic"), i.alias("interest"), F.create_map(F.lit("gravel"), F.lit(g)).alias("surface"))
    own, day, none = (F.col("id") % 6).cast("double"), (F.col("id") % 5).cast("double"), F.lit(None).cast("double")
    chosen = F.coalesce(F.when(F.col("id") % 4 == 0, dials(own, none, own, 4.0)), dials(day, day + 1, none, 1.0))
    rows = f.select("id", chosen.alias("a")).select("id", scoring.author_to_solver(F.col("a.climbing"), F.col("a.traffic"), F.col("a.interest"), F.col("a.surface")).alias("w"))
    return rows.select("id", *[F.round(f"w.{c}", 6).alias(c) for c in ("peaks", "quiet", "interest", "surface_gravel")])


@query(
    """SELECT id, metric, CASE WHEN metric = 'distance_m' THEN format('{:,.0f} m', value) WHEN metric = 'climb_m' THEN format('{:,.0f} m', value) ELSE format('{:.0f}%', value * 100e0) END AS said, round(shortfall, 6) AS shortfall, round(abs(shortfall) / notch, 6) AS notches,
    least(low, value) AS low, greatest(high, value) AS high FROM (SELECT *, CASE WHEN value < low THEN value - low WHEN value > high THEN value - high ELSE 0e0 END AS shortfall FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'distance_m' WHEN 1 THEN 'climb_m' ELSE 'traffic' END AS metric,
    CASE id % 3 WHEN 0 THEN id * 37e0 + 0.25e0 WHEN 1 THEN id % 900 + 0.25e0 ELSE round(id % 97 / 97e0, 4) END AS value, CASE id % 3 WHEN 0 THEN 20000e0 WHEN 1 THEN 100e0 ELSE 0.2e0 END AS low, CASE id % 3 WHEN 0 THEN 50000e0 WHEN 1 THEN 600e0 ELSE 0.6e0 END AS high,
    CASE id % 3 WHEN 0 THEN 1000e0 WHEN 1 THEN 100e0 ELSE 0.1e0 END AS notch FROM v_feature)) WHERE abs(value * 100e0 - floor(value * 100e0) - 0.5e0) > 1e-6""",
    "v_feature",
)
def scl_bands(spark, sf_dir):
    """SCL-06, SCL-07, SCL-35: how far values miss their bands, in notches, as text, and the band that would hold them."""
    i = F.col("id")
    pick = lambda a, b, c: F.when(i % 3 == 0, a).when(i % 3 == 1, b).otherwise(c)
    rows = load(spark, sf_dir, "v_feature").select(
        "id", pick(F.lit("distance_m"), F.lit("climb_m"), F.lit("traffic")).alias("metric"), pick(i * 37.0 + 0.25, i % 900 + 0.25, F.round(i % 97 / 97.0, 4)).alias("value"),
        pick(F.lit(20000.0), F.lit(100.0), F.lit(0.2)).alias("low"), pick(F.lit(50000.0), F.lit(600.0), F.lit(0.6)).alias("high"),
    )
    v, m = F.col("value"), F.col("metric")
    miss = scoring.band_shortfall(v, F.col("low"), F.col("high"))
    low, high = scoring.widened(F.col("low"), F.col("high"), v)
    out = rows.filter(F.abs(v * 100 - F.floor(v * 100) - 0.5) > 1e-6)
    return out.select("id", "metric", scoring.metric_text(m, v).alias("said"), F.round(miss, 6).alias("shortfall"), F.round(F.abs(miss) / scoring.lookup(scoring.METRIC_NOTCH, m), 6).alias("notches"), low.alias("low"), high.alias("high"))


@query(
    """SELECT id, CASE WHEN target IS NOT NULL AND vias < 3 THEN target - greatest(target * 0.1e0, 50e0) END AS low, CASE WHEN target IS NOT NULL AND vias < 3 THEN target + greatest(target * 0.1e0, 50e0) END AS high, target IS NOT NULL AND vias >= 3 AS advisory FROM
    (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id * 10 % 9000 AS DOUBLE) END AS target, id % 5 AS vias FROM v_feature)""",
    "v_feature",
)
def scl_distance_band(spark, sf_dir):
    """SCL-08: the default band about a target distance, unless fixed places set the distance."""
    rows = load(spark, sf_dir, "v_feature").select("id", F.when(F.col("id") % 7 != 0, (F.col("id") * 10 % 9000).cast("double")).alias("target"), (F.col("id") % 5).alias("vias"))
    low, high = scoring.distance_band(F.col("target"), F.col("vias"))
    return rows.select("id", low.alias("low"), high.alias("high"), (F.col("target").isNotNull() & (F.col("vias") >= 3)).alias("advisory"))


@query(
    """SELECT key, CASE WHEN thin AND lo < 0 THEN 0e0 ELSE floor(round(lo / 25e0, 9)) * 25e0 END AS low, CASE WHEN thin AND lo < 0 THEN ceil(round((hi - lo) / 25e0, 9)) * 25e0 ELSE ceil(round(hi / 25e0, 9)) * 25e0 END AS high FROM (SELECT key, b - a < 25e0 AS thin,
    CASE WHEN b - a < 25e0 THEN (a + b) / 2e0 - 12.5e0 ELSE a END AS lo, CASE WHEN b - a < 25e0 THEN (a + b) / 2e0 + 12.5e0 ELSE b END AS hi FROM (SELECT id % 400 AS key, min(salience * 30e0) AS a, max(salience * 30e0) AS b FROM v_feature GROUP BY 1))""",
    "v_feature",
)
def agg_envelope(spark, sf_dir):
    """AGG-15: the range of a metric that was seen, no narrower than what can be promised."""
    x = F.col("salience") * 30
    rows = load(spark, sf_dir, "v_feature").groupBy((F.col("id") % 400).alias("key")).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    low, high = scoring.envelope(F.lit("climb_m"), F.col("a"), F.col("b"))
    return rows.select("key", low.alias("low"), high.alias("high"))


@query(
    f"""SELECT route_id, seq, CASE WHEN abs(d) >= 160 THEN 'uturn' WHEN abs(d) >= 120 THEN 'sharp_' || side WHEN abs(d) < 45 THEN 'slight_' || side ELSE side END AS modifier FROM (SELECT *, CASE WHEN d < 0 THEN 'left' ELSE 'right' END AS side FROM
    (SELECT route_id, seq, (g2 - g1 + 540e0) - 360e0 * floor((g2 - g1 + 540e0) / 360e0) - 180e0 AS d FROM (SELECT route_id, seq, g AS g2, lag(g) OVER (PARTITION BY route_id ORDER BY seq) AS g1 FROM (SELECT *,
    degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) AS g FROM {LEGS})) WHERE g1 IS NOT NULL))
    WHERE abs(abs(d) - 45e0) > 1e-6 AND abs(abs(d) - 120e0) > 1e-6 AND abs(abs(d) - 160e0) > 1e-6""",
    "v_track",
)
def win_turns(spark, sf_dir):
    """SCL-13, WIN-07: the turn at each vertex of a route and its name; legs here are longer than the smoothing window."""
    from waymark.functions import geo

    rows = shapes.measured(load(spark, sf_dir, "v_track"), ["route_id"], ["seq"]).select("route_id", "seq", "lon", "lat", F.col("from_m").alias("at_m"), "lon2", "lat2")
    g = geo.bearing_deg(*[F.col(c) for c in ("lon", "lat", "lon2", "lat2")])
    rows = rows.withColumn("g", g).withColumn("before", F.lag("g").over(Window.partitionBy("route_id").orderBy("seq"))).filter("before is not null")
    return rows.select("route_id", "seq", walks.turn_modifier(geo.turn_deg(F.col("before"), F.col("g"))).alias("modifier"))


@query(
    """SELECT user_id, run, event_type, run_length FROM (SELECT *, lag(run_length) OVER (PARTITION BY user_id ORDER BY run) AS before FROM (SELECT user_id, run, event_type, sum(m) AS run_length FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run FROM
    (SELECT user_id, ts, event_id, event_type, event_id % 200 AS m, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS n FROM v_sample)) GROUP BY user_id, run, event_type)) WHERE before >= 150 AND run_length >= 150""",
    "v_sample",
)
def win_lasting_runs(spark, sf_dir):
    """WIN-09: changes that last on both sides."""
    from waymark.operators import sequences

    runs = sequences.runs(load(spark, sf_dir, "v_sample").withColumn("m", F.col("event_id") % 200), ["user_id"], ["ts", "event_id"], "event_type", "m")
    return walks.lasting_changes(runs, "user_id", "run", "run_length").select("user_id", "run", "event_type", "run_length")


@query()
def gra_colocation(spark, sf_dir):
    """GRA-08, GRA-09, AGG-06, AGG-07, AGG-08, SCL-18, SET-05: proposals of places that belong together, without those that
    were rejected. Greedy clustering is beyond SQL; a brute-force test covers it."""
    f = load(spark, sf_dir, "v_feature")
    role = F.element_at(F.array(*[F.lit(x) for x in ("narrative", "provision", "station")]), (F.col("layer_no") + 1).cast("int"))
    rows = f.select("id", "lon", "lat", "salience", role.alias("role"), F.concat_ws(" ", "key", "value").alias("title"))
    rejected = f.select(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("members"))
    return clusters.proposals(rows, LAT0, rejected).select("id", "name", "kind", F.array_join("members", ",").alias("members"), "extent_m", "tightness", "salience", "score")


ARCS = "(SELECT u, v FROM v_chain UNION SELECT 1 AS u, u AS v FROM v_chain WHERE u % 2 = 0)"


@query(
    f"""SELECT id, CASE WHEN id IN (SELECT x FROM (WITH RECURSIVE f(x) AS (SELECT 1 UNION SELECT e.v FROM f JOIN {ARCS} e ON e.u = f.x) SELECT x FROM f)) AND id IN (SELECT x FROM (WITH RECURSIVE b(x) AS (SELECT 1 UNION SELECT e.u FROM b JOIN {ARCS} e ON e.v = b.x) SELECT x FROM b))
    THEN 1 ELSE id END AS component FROM (SELECT u AS id FROM {ARCS} UNION SELECT v FROM {ARCS})""",
    "v_chain",
)
def gra_strong_components(spark, sf_dir):
    """GRA-02: strongly connected components of a graph with a hub that also leads back to every other node. The SQL knows
    that only the hub's part has cycles; a test has graphs of any kind."""
    e = load(spark, sf_dir, "v_chain").select("u", "v")
    return graphs.strong_components(e.unionByName(e.filter("u % 2 = 0").select(F.lit(1).cast("long").alias("u"), F.col("u").alias("v"))))
