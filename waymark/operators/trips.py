"""Days and trips put together from legs: checks of what joins them, totals by level, and days beyond their bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import haversine_m
from waymark.sources.scratch import settle

#: Fixed value: a gap between two legs of more metres than this is worth a warning.
GAP_WARN_M = 500.0


def checked_links(days: DataFrame, legs: DataFrame, links: DataFrame, warn_m: float = GAP_WARN_M) -> DataFrame:
    """day_id, link_id, fault, from_mode, to_mode, gap_m, gap_warning for each of links (day_id, link_id, from_leg, to_leg,
    from_mode, to_mode), which join two legs (day_id, leg_id, seq, mode, start_lon, start_lat, end_lon, end_lat).

    fault: 'unknown leg' where an end is no leg of the day, 'not adjacent' where the second one isn't the next after the
    first by seq, else null. Without a fault, modes that a link lacks are its legs', gap_m leads from the end of one to the
    start of the other (null if a place is) and warns beyond warn_m. Each day (day_id, kind) of kind 'rest' that has legs is
    one more row, without a link, of fault 'rest day with legs'.
    """
    place = F.row_number().over(Window.partitionBy("day_id").orderBy("seq", "leg_id"))
    placed = legs.select("day_id", "leg_id", "mode", "start_lon", "start_lat", "end_lon", "end_lat", place.alias("place"))
    tail = placed.select("day_id", F.col("leg_id").alias("from_leg"), F.col("mode").alias("a_mode"), "end_lon", "end_lat", F.col("place").alias("a"))
    head = placed.select("day_id", F.col("leg_id").alias("to_leg"), F.col("mode").alias("b_mode"), "start_lon", "start_lat", F.col("place").alias("b"))
    both = links.join(tail, ["day_id", "from_leg"], "left").join(head, ["day_id", "to_leg"], "left")
    fault = F.when(F.col("a").isNull() | F.col("b").isNull(), "unknown leg").when(F.col("b") != F.col("a") + 1, "not adjacent")
    fine = lambda c: F.when(F.col("fault").isNull(), c)
    both = both.withColumn("fault", fault).withColumn("gap_m", fine(haversine_m(*[F.col(c) for c in ("end_lon", "end_lat", "start_lon", "start_lat")])))
    modes = [F.coalesce(mode, fine(F.col(own))).alias(mode) for mode, own in (("from_mode", "a_mode"), ("to_mode", "b_mode"))]
    out = both.select("day_id", "link_id", "fault", *modes, "gap_m", (F.col("gap_m") > warn_m).alias("gap_warning"))
    rest = days.filter("kind = 'rest'").select("day_id").distinct().join(legs, "day_id", "left_semi").withColumn("fault", F.lit("rest day with legs"))
    return out.unionByName(rest, allowMissingColumns=True)


def numbered_days(days: DataFrame) -> DataFrame:
    """day_no: the days (trip_id, day_id, index) of each trip from 1, by index; days of one index by their id."""
    return days.withColumn("day_no", F.row_number().over(Window.partitionBy("trip_id").orderBy("index", "day_id")))


def composed(days: DataFrame, legs: DataFrame, nodes: DataFrame, trip_bands: DataFrame, day_bands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals and breaches of trips of days (trip_id, day_id, index) of legs (day_id, leg_id, seq, mode, distance, climb).

    Totals: trip_id, day_no, mode, distance, climb, day_count; a day_no or mode of null is all of them, and day_count stands
    with whole trips. Legs without a distance have no metrics; a day or trip without any has null ones.

    Breaches: trip_id, place, day_no, mode, bound, limit, distance, in the order of days, then of the modes' first legs, the
    lower bound first. The band (low, high; null is none) of a mode on a day is the one in day_bands (day_id, mode), which
    stands in for that in trip_bands (trip_id, mode) as a whole. A day whose last leg ends at a node (day_id, leg_id, k,
    along_m, stage) of stage 'resolution' may be short; a leg ends at its farthest node, and one without a place is beyond all.
    """
    numbered = numbered_days(days).select("trip_id", "day_id", "day_no")
    fine = legs.filter("distance IS NOT NULL").groupBy("day_id", "mode").agg(F.sum("distance").alias("distance"), F.sum("climb").alias("climb"), F.min("seq").alias("first"))
    fine = settle(fine, "modes-of-days")

    levels = [["trip_id", "day_no", "mode"], ["trip_id", "day_no"], ["trip_id", "mode"], ["trip_id"]]
    sums = numbered.join(fine, "day_id", "left").groupingSets(levels, "trip_id", "day_no", "mode")
    sums = sums.agg(F.sum("distance").alias("distance"), F.sum("climb").alias("climb"), F.grouping("mode").alias("_all"), F.grouping("day_no").alias("_trip"))
    count = numbered.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    totals = sums.filter("_all = 1 OR mode IS NOT NULL").join(count, "trip_id")
    totals = totals.select("trip_id", "day_no", "mode", "distance", "climb", F.when((F.col("_all") == 1) & (F.col("_trip") == 1), F.col("n")).alias("day_count"))

    last = legs.groupBy("day_id").agg(F.max_by("leg_id", F.struct("seq", "leg_id")).alias("leg_id"))
    ends = nodes.join(last, ["day_id", "leg_id"], "left_semi").groupBy("day_id")
    ends = ends.agg(F.max_by("stage", F.struct(F.col("along_m").isNull().alias("a"), F.coalesce("along_m", F.lit(0.0)).alias("b"), "k")).alias("stage"))
    own = day_bands.select("day_id", "mode", F.struct("low", "high").alias("own"))
    band = trip_bands.select("trip_id", "mode", F.struct("low", "high").alias("band"))
    rows = numbered.join(fine, "day_id").join(ends.filter("stage = 'resolution'"), "day_id", "left").join(own, ["day_id", "mode"], "left").join(band, ["trip_id", "mode"], "left")
    rows = rows.withColumn("band", F.coalesce("own", "band"))
    low = F.when((F.col("distance") < F.col("band.low")) & F.col("stage").isNull(), F.struct(F.lit("min").alias("bound"), F.col("band.low").alias("limit")))
    high = F.when(F.col("distance") > F.col("band.high"), F.struct(F.lit("max").alias("bound"), F.col("band.high").alias("limit")))
    rows = rows.select("trip_id", "day_no", "mode", "first", "distance", F.explode(F.array_compact(F.array(low, high))).alias("b")).select("*", "b.*")
    place = F.row_number().over(Window.partitionBy("trip_id").orderBy("day_no", "first", "mode", F.desc("bound")))
    return totals, rows.select("trip_id", place.alias("place"), "day_no", "mode", "bound", "limit", "distance")
