"""Queries on graphs, trip documents, cue sheets, samples and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import cues, graphs
from waymark.sources import files
from waymark.sources.scratch import new_path

from .catalog import query
from .views import load


def _ends(edges):
    return edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()


@query(
    """SELECT id, min(x) AS component FROM (WITH RECURSIVE r(id, x) AS (SELECT u, v FROM v_chain UNION SELECT r.id, e.v FROM r JOIN v_chain e ON r.x = e.u) SELECT id, x FROM r UNION ALL SELECT v, v FROM v_chain) GROUP BY id""",
    "v_chain",
)
def gra_components(spark, sf_dir):
    """GRA-02: one component of all nodes with a hub. The SQL relies on a rule of this view, that a component's smallest
    node can be reached downwards from all of it; a test has graphs without such a rule."""
    edges = load(spark, sf_dir, "v_chain")
    return graphs.components(_ends(edges), edges)


@query(
    """SELECT source, id, round(min(cost), 2) AS cost FROM (WITH RECURSIVE r(source, id, cost) AS (SELECT DISTINCT u, u, 0e0 FROM v_chain WHERE u % 20 = 0 UNION SELECT r.source, e.v, r.cost + e.length_m FROM r JOIN v_chain e ON r.id = e.u) SELECT * FROM r) GROUP BY source, id""",
    "v_chain",
)
def gra_path_costs(spark, sf_dir):
    edges = load(spark, sf_dir, "v_chain")
    sources = edges.filter("u % 20 = 0").select(F.col("u").alias("id"))
    return graphs.path_costs(edges, sources).select("source", "id", F.round("cost", 2).alias("cost"))


@query(
    """SELECT id, round(max(m), 2) AS length_m FROM (WITH RECURSIVE r(id, x, m) AS (SELECT u, u, 0e0 FROM v_chain UNION ALL SELECT r.id, e.v, r.m + e.length_m FROM r JOIN v_chain e ON r.x = e.u)
    SELECT id, m FROM r UNION ALL SELECT v, 0e0 FROM v_chain) GROUP BY id""",
    "v_chain",
)
def gra_longest_downstream(spark, sf_dir):
    return graphs.longest_downstream(load(spark, sf_dir, "v_chain")).select("id", F.round("length_m", 2).alias("length_m"))


@query()
def gra_fill_gaps(spark, sf_dir):
    """Means of the round before are beyond SQL; a brute-force test covers it."""
    edges = load(spark, sf_dir, "v_chain")
    nodes = _ends(edges).withColumn("value", F.when(F.col("id") % 6 == 0, F.col("id").cast("double")))
    return graphs.fill_gaps(nodes, edges).select("id", F.round("value", 6).alias("value"))


@query(
    """SELECT trip_id, count(*) AS hazards, count(*) FILTER (WHERE severity IN ('high', 'mandatory_reroute')) AS alerts, count(*) FILTER (WHERE severity IN ('high', 'mandatory_reroute')) > 0 AS has_alerts,
    coalesce(string_agg(CAST(hazard_id AS VARCHAR), ',' ORDER BY CASE severity WHEN 'mandatory_reroute' THEN 0 ELSE 1 END, day_id, hazard_id) FILTER (WHERE severity IN ('high', 'mandatory_reroute')), '') AS worst_first FROM v_hazard GROUP BY trip_id""",
    "v_hazard",
)
def agg_hazards(spark, sf_dir):
    """A trip's hazards: how many, and those that interrupt, worst first, then by day."""
    high = F.col("severity").isin("high", "mandatory_reroute")
    key = F.struct(F.when(F.col("severity") == "mandatory_reroute", 0).otherwise(1), "day_id", "hazard_id")
    listed = F.transform(F.array_sort(F.collect_list(F.when(high, key))), lambda x: x["hazard_id"].cast("string"))
    n = F.count_if(high)
    return load(spark, sf_dir, "v_hazard").groupBy("trip_id").agg(F.count(F.lit(1)).alias("hazards"), n.alias("alerts"), (n > 0).alias("has_alerts"), F.array_join(listed, ",").alias("worst_first"))


RANKS = "CASE status WHEN 'denied' THEN 0 WHEN 'required' THEN 1 WHEN 'applied' THEN 2 ELSE 3 END"


@query(
    f"""SELECT trip_id, count(*) FILTER (WHERE status <> 'confirmed') AS needs_attention, count(*) FILTER (WHERE status <> 'confirmed') = 0 AS is_clear,
    string_agg(CAST(permit_id AS VARCHAR), ',' ORDER BY {RANKS}, lower(title), permit_id) AS checklist FROM v_permit GROUP BY trip_id""",
    "v_permit",
)
def agg_permits(spark, sf_dir):
    """A trip's permits, those that block it first, and how many aren't confirmed."""
    key = F.struct(F.expr(RANKS), F.lower("title"), "permit_id")
    listed = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["permit_id"].cast("string"))
    n = F.count_if(F.col("status") != "confirmed")
    return load(spark, sf_dir, "v_permit").groupBy("trip_id").agg(n.alias("needs_attention"), (n == 0).alias("is_clear"), F.array_join(listed, ",").alias("checklist"))


#: Microseconds a centimetre takes; a mode that isn't listed has no known pace.
PACE = "CASE mode WHEN 'cycling' THEN 2000 WHEN 'hiking' THEN 8000 WHEN 'paddling' THEN 7200 END"


@query(
    f"""SELECT trip_id, mode, CASE WHEN bool_or(pace IS NULL) THEN NULL ELSE CAST(sum(distance_cm * pace) AS BIGINT) END AS moving_us, CAST(sum(distance_cm) AS BIGINT) AS distance_cm
    FROM (SELECT trip_id, mode, distance_cm, {PACE} AS pace FROM v_segment) GROUP BY GROUPING SETS ((trip_id, mode), (trip_id))""",
    "v_segment",
)
def agg_moving_us(spark, sf_dir):
    """Moving time of a trip and of each of its modes; a mode without a pace leaves its own and the whole unknown."""
    rows = load(spark, sf_dir, "v_segment").withColumn("pace", F.expr(PACE))
    sums = rows.groupBy("trip_id", "mode").agg(F.bool_or(F.col("pace").isNull()).alias("open"), F.sum(F.col("distance_cm") * F.col("pace")).alias("us"), F.sum("distance_cm").alias("cm"))
    both = sums.unionByName(sums.groupBy("trip_id").agg(F.lit(None).cast("string").alias("mode"), F.bool_or("open").alias("open"), F.sum("us").alias("us"), F.sum("cm").alias("cm")))
    return both.select("trip_id", "mode", F.when(~F.col("open"), F.col("us")).alias("moving_us"), F.col("cm").alias("distance_cm"))


@query(
    """SELECT w.route_id, w.bucket, count(c.cue_id) AS n FROM (SELECT route_id, unnest(range(0, last + 1)) AS bucket, last FROM (SELECT route_id, CAST(floor(max(along_m) * 0.9e0 / 1000e0) AS BIGINT) AS last FROM v_cue GROUP BY route_id HAVING max(along_m) > 0)) w
    LEFT JOIN v_cue c ON c.route_id = w.route_id AND least(w.last, CAST(floor(c.along_m / 1000e0) AS BIGINT)) = w.bucket GROUP BY ALL""",
    "v_cue",
)
def agg_cue_windows(spark, sf_dir):
    c = load(spark, sf_dir, "v_cue")
    return cues.cues_per_window(c, c.groupBy("route_id").agg((F.max("along_m") * 0.9).alias("route_m")))


_RANK = f"CASE kind {' '.join(f"WHEN '{k}' THEN {r}" for k, r in cues.PRIORITY.items())} ELSE {cues.OTHER} END"
_APART = ", ".join(f"'{k}'" for k in cues.APART)
_JOINS = f"(s.along_m - f.along_m <= 25e0 AND s.kind NOT IN ({_APART}) AND f.kind NOT IN ({_APART}) AND NOT (s.kind = 'turn' AND f.kind = 'turn'))"


def _stays(column: str) -> str:
    return f"CASE WHEN {_JOINS} AND f.rank <= s.rank THEN f.{column} ELSE s.{column} END"


@query(
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY along_m, rank, cue_id) AS i FROM (SELECT route_id, cue_id, kind, along_m, {_RANK} AS rank FROM v_cue)), f AS (WITH RECURSIVE f AS (SELECT route_id, i, 0 AS sequence, along_m, kind, cue_id, rank, 1 AS merged FROM s WHERE i = 1
    UNION ALL SELECT s.route_id, s.i, CASE WHEN {_JOINS} THEN f.sequence ELSE f.sequence + 1 END, CASE WHEN {_JOINS} THEN f.along_m ELSE s.along_m END, {_stays("kind")}, {_stays("cue_id")}, {_stays("rank")}, CASE WHEN {_JOINS} THEN f.merged + 1 ELSE 1 END FROM f JOIN s ON s.route_id = f.route_id AND s.i = f.i + 1) SELECT * FROM f)
    SELECT route_id, sequence, along_m, kind, cue_id, merged, '' AS instruction FROM (SELECT *, row_number() OVER (PARTITION BY route_id, sequence ORDER BY i DESC) AS k FROM f) WHERE k = 1""",
    "v_cue",
)
def win_cue_merge(spark, sf_dir):
    """WIN-11: a fold in which each merge changes what the next cue meets; the SQL folds row by row."""
    return cues.merge_cues(load(spark, sf_dir, "v_cue"))


@query(
    """SELECT CAST(floor(grade * 100e0) AS BIGINT) AS bin, count(*) AS n, round(sum(length_m), 2) AS length_m, round(sum(climb_m * length_m) / sum(length_m), 4) AS mean_climb,
    min(climb_m) FILTER (WHERE upto > total // 2) AS upper_median, CASE WHEN count(*) < 10 OR avg(climb_m) = 0 THEN 0e0 ELSE round(stddev_pop(climb_m) / avg(climb_m), 6) END AS variation
    FROM (SELECT *, row_number() OVER (PARTITION BY floor(grade * 100e0) ORDER BY climb_m) AS upto, count(*) OVER (PARTITION BY floor(grade * 100e0)) AS total FROM v_edge) GROUP BY 1""",
    "v_edge",
)
def agg_grade_bins(spark, sf_dir):
    """Bins of grade: rows, length, weighted mean, upper median and coefficient of variation (0 below 10 rows).

    Values are counted before they are put in order, so a frequent bin costs its different values only."""
    bin_ = F.floor(F.col("grade") * 100).alias("bin")
    s = load(spark, sf_dir, "v_edge").groupBy(bin_, "climb_m").agg(F.count(F.lit(1)).alias("n"), F.sum("length_m").alias("length_m"))
    s = s.withColumn("upto", F.sum("n").over(Window.partitionBy("bin").orderBy("climb_m"))).withColumn("total", F.sum("n").over(Window.partitionBy("bin")))
    mean = F.sum(F.col("climb_m") * F.col("n")) / F.sum("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("climb_m") * F.col("climb_m") * F.col("n")) / F.sum("n") - mean * mean))
    return s.groupBy("bin").agg(
        F.sum("n").alias("n"), F.round(F.sum("length_m"), 2).alias("length_m"), F.round(F.sum(F.col("climb_m") * F.col("length_m")) / F.sum("length_m"), 4).alias("mean_climb"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("climb_m"))).alias("upper_median"), F.when((F.sum("n") < 10) | (mean == 0), 0.0).otherwise(F.round(spread / mean, 6)).alias("variation"),
    )


@query(
    """SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_m) AS length_m, count(*) AS n FROM v_edge GROUP BY 1, 2""", "v_edge"
)
def set_ways(spark, sf_dir):
    """Edges of both directions as ways: the shortest of each pair of ends."""
    return load(spark, sf_dir, "v_edge").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length_m").alias("length_m"), F.count(F.lit(1)).alias("n"))


@query("SELECT u, v, length_m FROM v_chain", "v_chain")
def src_graph_xml(spark, sf_dir):
    """Edges written as XML elements with attributes and read back."""
    path = new_path(spark, "graph-xml")
    rows = load(spark, sf_dir, "v_chain").select(F.col("u").alias("_source"), F.col("v").alias("_target"), "length_m")
    files.write_xml(rows, path, "graph", "edge")
    back = files.read_xml(spark, path, "edge", "_source long, _target long, length_m double")
    return back.select(F.col("_source").alias("u"), F.col("_target").alias("v"), "length_m")


@query("SELECT id, lon, lat, key, salience FROM v_feature", "v_feature")
def src_geojson(spark, sf_dir):
    """Features written as GeoJSON lines and read back."""
    path = new_path(spark, "geojson")
    feature = files.point_feature(*[F.col(c) for c in ("id", "lon", "lat")], key=F.col("key"), salience=F.col("salience"))
    files.write_features(load(spark, sf_dir, "v_feature").select(feature), path)
    return files.read_features(spark, path, "key string, salience double")
