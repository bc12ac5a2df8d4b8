"""Queries on days and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import trips

from .catalog import HAVERSINE, query
from .views import load

GAP = HAVERSINE.replace("a.lon", "x.end_lon").replace("a.lat", "x.end_lat").replace("b.lon", "y.start_lon").replace("b.lat", "y.start_lat")


@query(
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY day_id ORDER BY seq, leg_id) AS place FROM v_leg), j AS (SELECT k.day_id, k.link_id, CASE WHEN x.place IS NULL OR y.place IS NULL THEN 'unknown leg' WHEN y.place <> x.place + 1 THEN 'not adjacent' END AS fault, k.from_mode, k.to_mode, x.mode AS xm, y.mode AS ym, {GAP} AS far, x.end_lon IS NOT NULL AS known
    FROM v_link k LEFT JOIN p x ON x.day_id = k.day_id AND x.leg_id = k.from_leg LEFT JOIN p y ON y.day_id = k.day_id AND y.leg_id = k.to_leg)
    SELECT day_id, link_id, fault, coalesce(from_mode, CASE WHEN fault IS NULL THEN xm END) AS from_mode, coalesce(to_mode, CASE WHEN fault IS NULL THEN ym END) AS to_mode, round(gap, 1) AS gap_m, gap > 500e0 AS gap_warning FROM (SELECT *, CASE WHEN fault IS NULL AND known THEN far END AS gap FROM j)
    UNION ALL SELECT day_id, NULL, 'rest day with legs', NULL, NULL, NULL, NULL FROM v_day WHERE kind = 'rest' AND day_id IN (SELECT day_id FROM v_leg)""",
    "v_leg", "v_link", "v_day",
)
def join_transitions(spark, sf_dir):
    """JOIN-24: transitions between legs checked, with their modes and gaps."""
    out = trips.checked_links(*[load(spark, sf_dir, v) for v in ("v_day", "v_leg", "v_link")])
    return out.withColumn("gap_m", F.round("gap_m", 1))


def _composed(spark, sf_dir):
    return trips.composed(*[load(spark, sf_dir, v) for v in ("v_day", "v_leg", "v_leg_node", "v_trip_band", "v_day_band")])


NUMBERED = "n AS (SELECT trip_id, day_id, row_number() OVER (PARTITION BY trip_id ORDER BY index, day_id) AS day_no FROM v_day)"
MODES = "m AS (SELECT day_id, mode, CAST(sum(distance) AS BIGINT) AS distance, CAST(sum(climb) AS BIGINT) AS climb, min(seq) AS first FROM v_leg WHERE distance IS NOT NULL GROUP BY day_id, mode)"


@query(
    f"""WITH {NUMBERED}, {MODES}, b AS (SELECT * FROM n LEFT JOIN m USING (day_id)) SELECT trip_id, day_no, mode, distance, climb, CAST(NULL AS BIGINT) AS day_count FROM b WHERE mode IS NOT NULL
    UNION ALL SELECT trip_id, day_no, NULL, CAST(sum(distance) AS BIGINT), CAST(sum(climb) AS BIGINT), NULL FROM b GROUP BY trip_id, day_no
    UNION ALL SELECT trip_id, NULL, mode, CAST(sum(distance) AS BIGINT), CAST(sum(climb) AS BIGINT), NULL FROM b WHERE mode IS NOT NULL GROUP BY trip_id, mode
    UNION ALL SELECT trip_id, NULL, NULL, CAST(sum(distance) AS BIGINT), CAST(sum(climb) AS BIGINT), count(DISTINCT day_no) FROM b GROUP BY trip_id""",
    "v_day", "v_leg",
)
def agg_trip_totals(spark, sf_dir):
    """GRA-18: trips put together from days, with totals of each day, each mode and the whole."""
    return _composed(spark, sf_dir)[0]


@query(
    f"""WITH {NUMBERED}, {MODES}, e AS (SELECT day_id, stage FROM (SELECT g.day_id, g.stage, row_number() OVER (PARTITION BY g.day_id ORDER BY g.along_m IS NULL DESC, g.along_m DESC, g.k DESC) AS r FROM v_leg_node g JOIN (SELECT day_id, leg_id, row_number() OVER (PARTITION BY day_id ORDER BY seq DESC, leg_id DESC) AS r FROM v_leg) l ON l.day_id = g.day_id AND l.leg_id = g.leg_id AND l.r = 1) WHERE r = 1),
    b AS (SELECT n.trip_id, n.day_no, m.mode, m.first, m.distance, CASE WHEN o.day_id IS NULL THEN t.low ELSE o.low END AS low, CASE WHEN o.day_id IS NULL THEN t.high ELSE o.high END AS high, coalesce(e.stage = 'resolution', false) AS closes FROM n JOIN m ON m.day_id = n.day_id LEFT JOIN e ON e.day_id = n.day_id
    LEFT JOIN v_day_band o ON o.day_id = n.day_id AND o.mode = m.mode LEFT JOIN v_trip_band t ON t.trip_id = n.trip_id AND t.mode = m.mode)
    SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY day_no, first, mode, bound DESC) AS place, day_no, mode, bound, "limit", distance FROM (SELECT trip_id, day_no, mode, first, distance, 'min' AS bound, low AS "limit" FROM b WHERE distance < low AND NOT closes UNION ALL SELECT trip_id, day_no, mode, first, distance, 'max', high FROM b WHERE distance > high)""",
    "v_day", "v_leg", "v_leg_node", "v_trip_band", "v_day_band",
)
def agg_trip_breaches(spark, sf_dir):
    """GRA-18, AGG-04, AGG-05: the days of each trip beyond their bands, one list a trip, in order."""
    return _composed(spark, sf_dir)[1]
