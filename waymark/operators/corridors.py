"""Corridors along lines: buffered boxes of windows of legs, each as long as an area allows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.boxes import EARTH_KM, Box, area_km2, box, split_to_cap
from waymark.sources.scratch import settle

from .sequences import chained

_SIDES = ("west", "south", "east", "north")


def around(lon: Column, lat: Column, km: float) -> Box:
    """The box of all points within km of a point, on the sphere. About a pole it has all longitudes."""
    r = km / EARTH_KM
    x = F.degrees(F.asin(F.least(F.lit(math.sin(r)) / F.cos(F.radians(lat)), F.lit(1.0))))
    return lon - x, lat - math.degrees(r), lon + x, lat + math.degrees(r)


def _joined(a: str, b: str) -> list[Column]:
    """The sides of a box around two; null if either is."""
    least = lambda x, y: F.when(F.col(x) <= F.col(y), F.col(x)).otherwise(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.col(y)))
    most = lambda x, y: F.when(F.col(x) >= F.col(y), F.col(x)).otherwise(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.col(y)))
    return [(least if s in ("west", "south") else most)(f"{a}{s}", f"{b}{s}").alias(s) for s in _SIDES]


def reach(legs: DataFrame, keys: list[str], index: str, most_km2: float) -> DataFrame:
    """legs (keys, index without gaps, west, south, east, north) with until: the first leg after this one whose box no longer
    fits, together with all from this one to it, into the area. A leg that is too large by itself reaches to the next one.

    Boxes over 1, 2, 4, ... legs are joined from two of half as many, as long as any fits; from the widest down, each leg then
    takes what still fits. So a window of n legs takes about 2 log(n) joins on (keys, index), and no task holds a line.
    """
    fits = area_km2(box()) <= most_km2
    tables = [settle(legs.filter(fits).select(*keys, index, *_SIDES), "spans")]
    while not tables[-1].isEmpty():
        width = 2 ** (len(tables) - 1)
        half = tables[-1].select(*keys, (F.col(index) - width).alias(index), *[F.col(s).alias(f"b_{s}") for s in _SIDES])
        both = tables[-1].join(half, [*keys, index]).select(*keys, index, *_joined("", "b_"))
        tables.append(settle(both.filter(fits), "spans"))
    at = legs.filter(fits).select(*keys, index, F.col(index).alias("until"), *[F.lit(None).cast("double").alias(s) for s in _SIDES])
    for k in range(len(tables) - 2, -1, -1):
        span = tables[k].select(*keys, F.col(index).alias("until"), *[F.col(s).alias(f"b_{s}") for s in _SIDES])
        # Where nothing is taken yet, the span itself is the box.
        sides = [F.when(F.col("west").isNull(), F.col(f"b_{s}")).otherwise(c).alias(f"n_{s}") for s, c in zip(_SIDES, _joined("", "b_"), strict=True)]
        tried = at.join(span, [*keys, "until"], "left").select(*keys, index, "until", *_SIDES, *sides)
        take = F.coalesce(area_km2(tuple(F.col(f"n_{s}") for s in _SIDES)) <= most_km2, F.lit(False))
        at = tried.select(*keys, index, F.when(take, F.col("until") + 2**k).otherwise(F.col("until")).alias("until"), *[F.when(take, F.col(f"n_{s}")).otherwise(F.col(s)).alias(s) for s in _SIDES])
        at = settle(at, "reach")
    until = at.select(*keys, index, "until")
    return legs.join(until, [*keys, index], "left").withColumn("until", F.coalesce("until", F.col(index) + 1))


def tiles(points: DataFrame, keys: list[str], order: list[str], km: float, most_km2: float) -> DataFrame:
    """keys, tile (from 1 along the line), first and last (places of vertices, from 1), west, south, east, north: the boxes
    that cover each line of points (keys, order, lon, lat) with km around it.

    From its first vertex on, a window takes legs as long as its box stays within the area; the next one begins at the vertex
    at which it ends, so there is no gap between them. A single leg that is too large is halved until its pieces aren't;
    they come south-west first. Points without a key or a place are left out; a line of one vertex has no tile.
    """
    some = points.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "lon", "lat"]))
    along = Window.partitionBy(*keys).orderBy(*order)
    own = around(F.col("lon"), F.col("lat"), km)
    some = some.select(*keys, F.row_number().over(along).alias("_i"), *[c.alias(f"a_{s}") for s, c in zip(_SIDES, own, strict=True)], *order)
    some = some.withColumns({f"b_{s}": F.lead(f"a_{s}").over(along) for s in _SIDES})
    legs = settle(some.filter("b_west IS NOT NULL").select(*keys, "_i", *_joined("a_", "b_")), "legs")
    held = chained(reach(legs, keys, "_i", most_km2), keys, "_i", "until")
    sides = [(F.min if s in ("west", "south") else F.max)(s).alias(s) for s in _SIDES]
    windows = held.groupBy(*keys, F.col("chain").alias("first")).agg((F.max("_i") + 1).alias("last"), *sides)
    pieces = split_to_cap(windows, most_km2)
    return pieces.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("first", "south", "west")).alias("tile"), "first", "last", *_SIDES)
