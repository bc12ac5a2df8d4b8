"""Boxes (west, south, east, north in degrees) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.scratch import settle

from .geo import DEGREE_M

Box = tuple[Column, Column, Column, Column]

#: Slack of a containment test in degrees; padding of a fetched area: share of a side, least and most metres,
#: and the largest area in square kilometres.
SLACK = 1e-7
PAD_SHARE, PAD_LEAST_M, PAD_MOST_M, PAD_AREA_KM2 = 0.10, 500.0, 2000.0, 900.0
#: Pixels of a map tile.
TILE_PX = 256


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("west", "south", "east", "north"))  # type: ignore[return-value]


def overlaps(a: Box, b: Box) -> Column:
    """The boxes share a point; touching edges count."""
    return ~((a[2] < b[0]) | (a[0] > b[2]) | (a[3] < b[1]) | (a[1] > b[3]))


def intersects(a: Box, b: Box) -> Column:
    """The boxes share an area; touching edges don't count."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: Box, inner: Box, slack: float = 0.0) -> Column:
    """inner lies in outer; equal boxes count."""
    return (outer[0] <= inner[0] + slack) & (outer[1] <= inner[1] + slack) & (outer[2] >= inner[2] - slack) & (outer[3] >= inner[3] - slack)


def shrinks(before: Box, after: Box) -> Column:
    """after lies in before and isn't the same box."""
    same = (before[0] == after[0]) & (before[1] == after[1]) & (before[2] == after[2]) & (before[3] == after[3])
    return contains(before, after) & ~same


def area(b: Box) -> Column:
    """Square degrees; a box out of order has none."""
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def common_area(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def scaled(b: Box, factor: float) -> Box:
    """The box grown or shrunk about its middle."""
    x, y, w, h = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / 2 * factor, (b[3] - b[1]) / 2 * factor
    return x - w, y - h, x + w, y + h


def moved(b: Box, east: float, north: float) -> Box:
    """The box moved by shares of its own sides."""
    dx, dy = (b[2] - b[0]) * east, (b[3] - b[1]) * north
    return b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy


def padded(b: Box) -> Box:
    """The box to fetch for one that isn't held: a tenth of each side more on either side, within bounds, up to a largest
    area, rounded outward to 5 decimals. A box that is as large already stays as it is."""
    wide = F.greatest(F.cos(F.radians((b[1] + b[3]) / 2)), F.lit(1e-6)) * DEGREE_M
    w, h = (b[2] - b[0]) * wide, (b[3] - b[1]) * DEGREE_M
    side = lambda x: F.least(F.greatest(x * PAD_SHARE, F.lit(PAD_LEAST_M)), F.lit(PAD_MOST_M))
    mx, my = side(w), side(h)
    # Scaled down where the area would be too large: the root of (w + 2 mx k)(h + 2 my k) = area.
    p, q, r = 4 * mx * my, 2 * (w * my + h * mx), w * h - PAD_AREA_KM2 * 1e6
    k = F.when((w + 2 * mx) * (h + 2 * my) > PAD_AREA_KM2 * 1e6, (-q + F.sqrt(q * q - 4 * p * r)) / (2 * p)).otherwise(1.0)
    dx, dy = mx * k / wide, my * k / DEGREE_M
    down, up = (lambda x: F.floor(x * 1e5) / 1e5), (lambda x: F.ceil(x * 1e5) / 1e5)
    grown = (F.greatest(F.lit(-180.0), down(b[0] - dx)), F.greatest(F.lit(-90.0), down(b[1] - dy)), F.least(F.lit(180.0), up(b[2] + dx)), F.least(F.lit(90.0), up(b[3] + dy)))
    large = w * h / 1e6 >= PAD_AREA_KM2
    return tuple(F.when(large, old).otherwise(new) for old, new in zip(b, grown, strict=True))  # type: ignore[return-value]


def key(b: Box, network: Column, version: int) -> Column:
    """A key of a region: 16 hexadecimal digits over its box at 7 decimals, its network and the version of the rules."""
    sides = F.concat_ws(", ", *[F.round(c, 7).cast("string") for c in b])
    text = F.concat(F.lit('{"bbox": ['), sides, F.lit('], "network_type": "'), network, F.lit(f'", "ruleset_version": {version}}}'))
    return F.substring(F.sha2(text, 256), 1, 16)


def cell_name(i: Column, j: Column, degrees: int) -> Column:
    """The name of a grid square by its south-west corner."""
    west, south = i * degrees, j * degrees
    side = lambda x, neg, pos, width: F.concat(F.when(x < 0, neg).otherwise(pos), F.lpad(F.abs(x).cast("string"), width, "0"))
    return F.concat(F.lit(f"cell-{degrees}d-"), side(west, "w", "e", 3), F.lit("-"), side(south, "s", "n", 2))


def cells(b: Box, degrees: int) -> Column:
    """The grid squares in which a box has area, as an array of (name, west, south, east, north): its pieces."""
    span = lambda lo, hi: F.sequence(F.floor(lo / degrees), F.ceil(hi / degrees) - 1)

    def piece(i: Column, j: Column) -> Column:
        sides = (F.greatest(b[0], (i * degrees).cast("double")), F.greatest(b[1], (j * degrees).cast("double")), F.least(b[2], ((i + 1) * degrees).cast("double")), F.least(b[3], ((j + 1) * degrees).cast("double")))
        return F.struct(cell_name(i, j, degrees).alias("name"), *[c.alias(n) for c, n in zip(sides, ("west", "south", "east", "north"), strict=True)])

    found = F.flatten(F.transform(span(b[0], b[2]), lambda i: F.transform(span(b[1], b[3]), lambda j: piece(i, j))))
    return F.when((b[2] > b[0]) & (b[3] > b[1]), F.filter(found, lambda c: (c["west"] < c["east"]) & (c["south"] < c["north"])))


def difference(outer: Box, inner: Box, least_km2: float = 0.01) -> Column:
    """What outer has beyond an inner box, as an array of up to four strips (side, west, south, east, north): north and
    south over the whole width, then west and east of what is between. Slivers are left out."""
    strips = (
        ("n", outer[0], inner[3], outer[2], outer[3]), ("s", outer[0], outer[1], outer[2], inner[1]),
        ("w", outer[0], inner[1], inner[0], inner[3]), ("e", inner[2], inner[1], outer[2], inner[3]),
    )
    made = F.array(*[F.struct(F.lit(s).alias("side"), *[c.alias(n) for c, n in zip(b, ("west", "south", "east", "north"), strict=True)]) for s, *b in strips])

    def size(s: Column) -> Column:
        wide = F.cos(F.radians((s["south"] + s["north"]) / 2)) * DEGREE_M
        return (s["east"] - s["west"]) * wide * (s["north"] - s["south"]) * DEGREE_M / 1e6

    return F.filter(made, lambda s: (s["east"] > s["west"]) & (s["north"] > s["south"]) & (size(s) > least_km2))


def world_px(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator pixels from the north-west corner of the world."""
    scale = float(TILE_PX * 2**zoom)
    y = F.radians(lat)
    return (lon + 180) / 360 * scale, (1 - F.log(F.tan(y) + 1 / F.cos(y)) / F.pi()) / 2 * scale


def screen_px(lon: Column, lat: Column, centre: tuple[Column, Column], zoom: int, width: int, height: int) -> tuple[Column, Column]:
    """Pixels from the top left corner of a window about a centre."""
    x, y = world_px(lon, lat, zoom)
    cx, cy = world_px(*centre, zoom)
    return x - cx + width / 2, y - cy + height / 2


def tile_box(x: Column, y: Column, zoom: int) -> Box:
    """The box of a map tile."""
    n = float(2**zoom)
    lat = lambda t: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * t / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


#: Mean radius of the earth in kilometres.
EARTH_KM = 6371.0088


def area_km2(b: Box) -> Column:
    """Area of a box on the sphere."""
    west, south, east, north = b
    return F.radians(east - west) * (F.sin(F.radians(north)) - F.sin(F.radians(south))) * (EARTH_KM * EARTH_KM)


def split_to_cap(rows: DataFrame, most_km2: float) -> DataFrame:
    """rows (west, south, east, north and others) once for each piece of their box, with depth: boxes above the cap are halved
    along their longer side, in kilometres at their middle, until none is. A box of no area is one piece; a null side leaves
    its row as it is. Each round halves all boxes at once, so there are as many rounds as the largest box needs halvings."""
    wide = F.radians(F.col("east") - F.col("west")) * F.cos(F.radians((F.col("south") + F.col("north")) / 2)) >= F.radians(F.col("north") - F.col("south"))
    open_, done = rows.withColumn("depth", F.lit(0)), None
    while True:
        open_ = settle(open_.withColumn("_large", F.coalesce(area_km2(box()) > most_km2, F.lit(False))), "boxes")
        small = open_.filter("NOT _large").drop("_large")
        done = small if done is None else done.unionByName(small)
        large = open_.filter("_large").drop("_large")
        if large.isEmpty():
            return done
        x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
        halves = large.withColumn("_wide", wide).withColumn("_h", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_x": x, "_y": y})
        pick = lambda side, cut, on, h: F.when(on & (F.col("_h") == h), F.col(cut)).otherwise(F.col(side)).alias(side)
        on = F.col("_wide")
        names = [c for c in rows.columns if c not in ("west", "south", "east", "north")]
        open_ = halves.select(*names, (F.col("depth") + 1).alias("depth"), pick("west", "_x", on, 1), pick("south", "_y", ~on, 1), pick("east", "_x", on, 0), pick("north", "_y", ~on, 0))
