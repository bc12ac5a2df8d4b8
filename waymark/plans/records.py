"""Queries on records of all kinds: parsing, ranking, sets, freshness. Ids at the head of a docstring are the survey's operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import joins
from waymark.sources.scratch import settle

from .catalog import query
from .views import load


@query(
    """SELECT id, CAST(round(lon * 2147483648e0 / 180e0) AS BIGINT) AS lon_raw, CAST(round(lat * 2147483648e0 / 180e0) AS BIGINT) AS lat_raw, CAST(round((salience * 100e0 + 500e0) * 5e0) AS BIGINT) AS altitude_raw, CAST(round(salience * 1000e0 * 100e0) AS BIGINT) AS distance_raw,
    round(lon, 7) AS lon, round(lat, 7) AS lat FROM v_feature""",
    "v_feature",
)
def scl_fixed_point(spark, sf_dir):
    """SCL-16, SCL-25: coordinates as semicircles, heights in fifths of a metre from -500, distances in centimetres; coordinates at 7 decimals."""
    raw = lambda c: F.round(c).cast("long")
    circle = lambda c: raw(F.col(c) * 2147483648.0 / 180)
    return load(spark, sf_dir, "v_feature").select(
        "id", circle("lon").alias("lon_raw"), circle("lat").alias("lat_raw"), raw((F.col("salience") * 100 + 500) * 5).alias("altitude_raw"), raw(F.col("salience") * 1000 * 100).alias("distance_raw"),
        F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"),
    )


@query(
    """SELECT area_key, age_days > CASE store WHEN 0 THEN 30 WHEN 1 THEN 30 WHEN 2 THEN 365 ELSE 90 END AS stale, CAST(least(5e0 * power(2e0, store * 3 - 1), 300e0) * CASE WHEN store = 0 THEN 0 ELSE 1 END AS BIGINT) AS backoff_s FROM v_area""", "v_area"
)
def scl_freshness(spark, sf_dir):
    """SCL-23, SCL-36: whether a held area is beyond its payload's days, and how long to wait after failures (none before the first)."""
    ttl = F.element_at(F.array(*[F.lit(x) for x in (30, 30, 365, 90)]), (F.col("store") + 1).cast("int"))
    tries = F.col("store") * 3
    wait = F.when(tries <= 0, 0.0).otherwise(F.least(5 * F.pow(F.lit(2.0), tries - 1), F.lit(300.0)))
    return load(spark, sf_dir, "v_area").select("area_key", (F.col("age_days") > ttl).alias("stale"), wait.cast("long").alias("backoff_s"))


@query(
    """SELECT store, count(*) FILTER (WHERE age_days > 60) > 0 AS any_stale, count(*) FILTER (WHERE pinned) > 0 AS ready, max(age_days) AS oldest, CAST(sum(bytes) AS BIGINT) AS bytes FROM v_area GROUP BY store""", "v_area"
)
def agg_mirror_state(spark, sf_dir):
    """AGG-41, AGG-42: what holds for any area of a store."""
    rows = load(spark, sf_dir, "v_area").groupBy("store")
    return rows.agg(F.bool_or(F.col("age_days") > 60).alias("any_stale"), F.bool_or("pinned").alias("ready"), F.max("age_days").alias("oldest"), F.sum("bytes").alias("bytes"))


@query(
    """SELECT a.area_key FROM v_area a WHERE NOT EXISTS (SELECT 1 FROM v_area b WHERE b.area_key <> a.area_key AND b.west <= a.west AND b.south <= a.south AND b.east >= a.east AND b.north >= a.north AND (b.west < a.west OR b.south < a.south OR b.east > a.east OR b.north > a.north OR b.area_key < a.area_key))""",
    "v_area",
)
def join_dominated(spark, sf_dir):
    """JOIN-14: areas that no other one holds; of equal boxes the smallest key stays. Boxes are listed under the grid cells
    that they touch, and one that holds another is listed under that one's south-west cell."""
    a = load(spark, sf_dir, "v_area").select("area_key", "west", "south", "east", "north")
    b = settle(joins.box_cells(a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns]), 0.02, "b_west", "b_south", "b_east", "b_north"), "boxes")
    own = joins.point_cells(a, "west", "south", 0.02, joins.levels_of(b))
    holds = "b_west <= west AND b_south <= south AND b_east >= east AND b_north >= north AND b_area_key <> area_key"
    more = "(b_west < west OR b_south < south OR b_east > east OR b_north > north OR b_area_key < area_key)"
    gone = own.join(b, joins.CELL).filter(f"{holds} AND {more}").select("area_key").distinct()
    return a.join(gone, "area_key", "left_anti").select("area_key")


@query(
    """SELECT r.request_id, a.area_key FROM v_bbox r LEFT JOIN (SELECT request_id, area_key FROM (SELECT r.request_id, a.area_key, row_number() OVER (PARTITION BY r.request_id ORDER BY round(greatest(0e0, least(r.east, a.east) - greatest(r.west, a.west)) * greatest(0e0, least(r.north, a.north) - greatest(r.south, a.south)) * 1e9) DESC, a.bytes, a.area_key) AS k
    FROM v_bbox r JOIN v_area a ON r.west < a.east AND a.west < r.east AND r.south < a.north AND a.south < r.north) WHERE k = 1) a ON a.request_id = r.request_id""",
    "v_bbox", "v_area",
)
def join_best_overlap(spark, sf_dir):
    """JOIN-12: the area that shares most with a request, then the smaller one. Each side's boxes are listed under their own
    cells and the coarser ones of the other side's levels, so boxes of all sizes meet."""
    from waymark.functions import boxes

    r = load(spark, sf_dir, "v_bbox")
    a = load(spark, sf_dir, "v_area").select("area_key", "bytes", *[F.col(c).alias(f"a_{c}") for c in ("west", "south", "east", "north")])
    pairs = joins.box_pairs(r, a, 0.02, "a_").filter(boxes.intersects(boxes.box(), boxes.box("a_")))
    shared = F.round(boxes.common_area(boxes.box(), boxes.box("a_")) * 1e9).alias("shared")
    best = pairs.groupBy("request_id").agg(F.max(F.struct(shared, (-F.col("bytes")).alias("b"), (-F.col("area_key")).alias("k"))).alias("best"))
    return r.select("request_id").join(best, "request_id", "left").select("request_id", (-F.col("best.k")).alias("area_key"))


@query(
    """SELECT CASE WHEN b.id IS NOT NULL THEN 'linked' WHEN down IS NULL THEN 'terminal' ELSE 'dangling' END AS state, count(*) AS n FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN -p_partkey ELSE p_partkey - 1 END AS down FROM part) a
    LEFT JOIN (SELECT p_partkey AS id FROM part) b ON b.id = a.down GROUP BY 1"""
)
def join_downstream(spark, sf_dir):
    """JOIN-15: reaches by whether the one that they name below them exists."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, -k).otherwise(k - 1).alias("down"))
    out = rows.join(rows.select(F.col("id").alias("to")), F.col("down") == F.col("to"), "left")
    state = F.when(F.col("to").isNotNull(), "linked").when(F.col("down").isNull(), "terminal").otherwise("dangling")
    return out.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT hazard_id, trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY CASE severity WHEN 'mandatory_reroute' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, day_id, along_m IS NULL, along_m, hazard_id) AS k FROM v_hazard""", "v_hazard"
)
def srt_alerts(spark, sf_dir):
    """SRT-05, WIN-12: hazards of a trip in order: worst first, by day, unplaced ones last, by distance."""
    rank = F.when(F.col("severity") == "mandatory_reroute", 0).when(F.col("severity") == "high", 1).otherwise(2)
    w = Window.partitionBy("trip_id").orderBy(rank, "day_id", F.asc_nulls_last("along_m"), "hazard_id")
    return load(spark, sf_dir, "v_hazard").select("hazard_id", "trip_id", F.row_number().over(w).alias("k"))


@query(
    """SELECT key, id, k FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY layer_no = 2, CASE WHEN d < 250 THEN 0 WHEN d < 1000 THEN 1 WHEN d < 3000 THEN 2 ELSE 3 END, salience DESC, id) AS k FROM (SELECT *, CASE WHEN id % 9 = 0 THEN NULL ELSE (id * 37) % 5000 END AS d FROM v_feature)) WHERE k <= 40""", "v_feature"
)
def srt_distance_bands(spark, sf_dir):
    """SRT-04, SRT-07, SRT-11: the 40 best of each kind (the feature): put off ones last, by band of distance, then by salience."""
    d = F.when(F.col("id") % 9 != 0, (F.col("id") * 37) % 5000)
    band = F.when(d < 250, 0).when(d < 1000, 1).when(d < 3000, 2).otherwise(3)
    w = Window.partitionBy("key").orderBy(F.col("layer_no") == 2, band, F.desc("salience"), "id")
    return load(spark, sf_dir, "v_feature").select("key", "id", F.row_number().over(w).alias("k")).filter("k <= 40")


@query("SELECT trip_id, string_agg(DISTINCT mode, ',' ORDER BY mode) AS modes, count(DISTINCT mode) AS n FROM v_segment GROUP BY trip_id", "v_segment")
def set_modes(spark, sf_dir):
    """SET-07, SET-08: the modes of a trip, each once, in order."""
    return load(spark, sf_dir, "v_segment").groupBy("trip_id").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.count_distinct("mode").alias("n"))


@query(
    """SELECT CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' WHEN a.x IS DISTINCT FROM b.x THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM (SELECT event_id AS id, event_type AS x FROM events WHERE event_id % 5 <> 0) a
    FULL JOIN (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'moved' ELSE event_type END AS x FROM events WHERE event_id % 6 <> 0) b ON a.id = b.id GROUP BY 1"""
)
def set_feed_diff(spark, sf_dir):
    """WIN-22, SET-10: two polls of a feed: added, removed, changed and equal records, from one grouping over both."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("x"))
    old = e.filter("id % 5 <> 0").withColumn("poll", F.lit(1))
    new = e.filter("id % 6 <> 0").withColumn("x", F.when(F.col("id") % 7 == 0, "moved").otherwise(F.col("x"))).withColumn("poll", F.lit(2))
    one = lambda p: F.max(F.when(F.col("poll") == p, F.col("x")))
    both = old.unionByName(new).groupBy("id").agg(F.bit_or("poll").alias("polls"), one(1).alias("a"), one(2).alias("b"))
    state = F.when(F.col("polls") == 1, "removed").when(F.col("polls") == 2, "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT user_id, sum(CASE WHEN moving THEN dt ELSE 0 END) AS moving_s, sum(CASE WHEN moving THEN 0 ELSE dt END) AS stopped_s, count(*) FILTER (WHERE NOT moving AND coalesce(was, true)) AS stops FROM (SELECT *, lag(moving) OVER (PARTITION BY user_id ORDER BY n) AS was FROM
    (SELECT user_id, n, dt, dd > dt * 2 AS moving FROM (SELECT user_id, row_number() OVER w AS n, 10 + event_id % 60 AS dt, event_id % 200 AS dd FROM v_sample WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE dt <= 60)) GROUP BY user_id""",
    "v_sample",
)
def win_stops(spark, sf_dir):
    """WIN-16: moving and stopped time, and how often a stop begins; steps that are too long are left out first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, sf_dir, "v_sample").select("user_id", "ts", "event_id", (10 + F.col("event_id") % 60).alias("dt"), (F.col("event_id") % 200).alias("dd")).filter("dt <= 60")
    rows = rows.withColumn("moving", F.col("dd") > F.col("dt") * 2).withColumn("was", F.lag("moving").over(w))
    time = lambda on: F.sum(F.when(F.col("moving") == on, F.col("dt")).otherwise(0))
    return rows.groupBy("user_id").agg(time(True).alias("moving_s"), time(False).alias("stopped_s"), F.count_if(~F.col("moving") & F.coalesce("was", F.lit(True))).alias("stops"))


@query(
    """SELECT mode, bin, CAST(sum(d) AS BIGINT) AS d, count(*) AS n FROM (SELECT mode, CASE WHEN climb_m < 150 THEN 'flat' WHEN climb_m < 350 THEN 'up' ELSE 'steep' END AS bin, distance_cm AS d FROM v_segment) GROUP BY GROUPING SETS ((mode, bin), (mode))""", "v_segment"
)
def agg_speed_tables(spark, sf_dir):
    """AGG-30: tables by mode and bin, with the mode as a whole to fall back on, put together from the bins."""
    c = F.col("climb_m")
    fine = load(spark, sf_dir, "v_segment").groupBy("mode", F.when(c < 150, "flat").when(c < 350, "up").otherwise("steep").alias("bin")).agg(F.sum("distance_cm").alias("d"), F.count(F.lit(1)).alias("n"))
    return fine.unionByName(fine.groupBy("mode").agg(F.lit(None).cast("string").alias("bin"), F.sum("d").alias("d"), F.sum("n").alias("n")))


@query(
    """SELECT a.user_id, round(abs(a.mean - (t.s - a.s) / (t.n - a.n)) / a.mean, 6) AS miss FROM (SELECT user_id, sum(value) AS s, count(value) AS n, avg(value) AS mean FROM v_sample GROUP BY user_id) a CROSS JOIN (SELECT sum(value) AS s, count(value) AS n FROM v_sample) t""", "v_sample"
)
def agg_leave_one_out(spark, sf_dir):
    """AGG-31: how far each member is from what the others predict: totals less its own part, and no self-join."""
    own = load(spark, sf_dir, "v_sample").groupBy("user_id").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    total = own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    mean = F.col("s") / F.col("n")
    return own.join(F.broadcast(total)).select("user_id", F.round(F.abs(mean - rest) / mean, 6).alias("miss"))


@query(
    """SELECT store, m, count(*) FILTER (WHERE age_days * 24 * 60 + m <= 86400) AS fresh, count(*) AS n FROM v_area CROSS JOIN (VALUES (5), (60), (360), (1440)) AS t(m) GROUP BY store, m""", "v_area"
)
def agg_freshness(spark, sf_dir):
    """AGG-38: how many records are still fresh some minutes on."""
    rows = load(spark, sf_dir, "v_area").withColumn("m", F.explode(F.array(*[F.lit(x) for x in (5, 60, 360, 1440)])))
    return rows.groupBy("store", "m").agg(F.count_if(F.col("age_days") * 24 * 60 + F.col("m") <= 86400).alias("fresh"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT cx, cy, n, CASE WHEN n = 1 THEN one END AS single FROM (SELECT CAST(floor(lon * 200e0) AS BIGINT) AS cx, CAST(floor(lat * 200e0) AS BIGINT) AS cy, count(*) AS n, min(id) AS one FROM v_feature GROUP BY 1, 2)""", "v_feature"
)
def agg_display_cells(spark, sf_dir):
    """AGG-35: places by screen cell: single ones by id, several as a count."""
    cell = lambda c: F.floor(F.col(c) * 200).alias("cx" if c == "lon" else "cy")
    rows = load(spark, sf_dir, "v_feature").groupBy(cell("lon"), cell("lat")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    return rows.select("cx", "cy", "n", F.when(F.col("n") == 1, F.col("one")).alias("single"))


@query(
    """SELECT day_id, n, s[1 + CAST(greatest(ceil(0.5e0 * n), 1) AS BIGINT) - 1] AS p50, s[1 + CAST(greatest(ceil(0.95e0 * n), 1) AS BIGINT) - 1] AS p95 FROM (SELECT day_id, count(along_m) AS n, list(along_m ORDER BY along_m) FILTER (WHERE along_m IS NOT NULL) AS s FROM v_hazard GROUP BY day_id)""", "v_hazard"
)
def agg_nearest_rank(spark, sf_dir):
    """AGG-21: nearest-rank percentiles. Values are counted before they are put in order."""
    c = load(spark, sf_dir, "v_hazard").filter("along_m is not null").groupBy("day_id", "along_m").agg(F.count(F.lit(1)).alias("c"))
    c = c.withColumn("upto", F.sum("c").over(Window.partitionBy("day_id").orderBy("along_m"))).withColumn("n", F.sum("c").over(Window.partitionBy("day_id")))
    at = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("n") * p), F.lit(1)), F.col("along_m")))
    return c.groupBy("day_id").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(
    """SELECT key, value, n FROM (SELECT key, value, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, value) AS k FROM v_feature WHERE NOT (key = 'historic' AND value = 'castle') GROUP BY key, value) WHERE k <= 3""", "v_feature"
)
def agg_top_values(spark, sf_dir):
    """AGG-24, AGG-27: the three most frequent values of each key (the feature)."""
    n = load(spark, sf_dir, "v_feature").filter("NOT (key = 'historic' AND value = 'castle')").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))).filter("k <= 3").drop("k")


@query(
    """SELECT e.route_id, e.seq, CASE WHEN w.who IS NOT NULL THEN w.who ELSE 'default' END AS weights FROM (SELECT route_id, seq, (seq * 37) % 1000 / 1000e0 AS at FROM v_track) e LEFT JOIN (VALUES (0, 0.1e0, 0.4e0, 'quiet'), (1, 0.3e0, 0.6e0, 'scenic')) AS w(ord, a, b, who)
    ON e.at >= w.a AND e.at < w.b AND NOT (w.ord = 1 AND e.at >= 0.1e0 AND e.at < 0.4e0)""",
    "v_track",
)
def flt_scoped_weights(spark, sf_dir):
    """FLT-29: the weights that hold at a position: the first of the scopes [start, end) that has it, else the default."""
    at = (F.col("seq") * 37) % 1000 / 1000.0
    who = F.lit("default")
    for a, b, name in reversed([(0.1, 0.4, "quiet"), (0.3, 0.6, "scenic")]):
        who = F.when((at >= a) & (at < b), name).otherwise(who)
    return load(spark, sf_dir, "v_track").select("route_id", "seq", who.alias("weights"))


@query(
    """SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme, regexp_matches(url, 'en/') AND NOT regexp_matches(url, 'html$') AS passes FROM pages"""
)
def flt_clauses(spark, sf_dir):
    """FLT-02: a text passes if each clause holds: patterns are looked for anywhere, and a missing value passes a negative one."""
    u = F.col("url")
    ok = F.coalesce(u.rlike("en/"), F.lit(False)) & (u.isNull() | ~u.rlike("html$"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.lower(F.regexp_extract(u, "^([a-z]+)://", 1)).alias("scheme"), ok.alias("passes"))
