"""Edge and walk scoring: rule tables as CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality by surface, traffic ceiling by road class.
SURFACE_QUALITY = {
    "asphalt": 1.0, "paved": 1.0, "concrete": 0.9, "paving_stones": 0.7, "compacted": 0.7, "fine_gravel": 0.65, "gravel": 0.5,
    "unpaved": 0.45, "ground": 0.35, "dirt": 0.35, "grass": 0.2, "sand": 0.1,
}
SURFACE_DEFAULT = 0.6
TRAFFIC = {
    "cycleway": 0.0, "path": 0.05, "track": 0.1, "footway": 0.15, "living_street": 0.2, "residential": 0.3, "unclassified": 0.4,
    "tertiary": 0.55, "secondary": 0.75, "primary": 0.9, "trunk": 1.0,
}
TRAFFIC_DEFAULT = 0.5
#: Surfaces that are paved and those that aren't, and road classes that are trails.
PAVED = ("asphalt", "paved", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "sett", "cobblestone", "chipseal", "metal", "wood", "bricks", "brick")
UNPAVED = ("gravel", "fine_gravel", "compacted", "unpaved", "dirt", "ground", "earth", "grass", "sand", "mud", "pebblestone", "rock", "woodchips")
TRAILS = ("path", "bridleway")
#: Classes that are what they are without a sign of traffic; the speed and lanes that are such a sign.
CALM = ("cycleway", "path", "track", "footway", "living_street", "residential")
FAST_KMH, WIDE_LANES, MILE_KM = 50.0, 4, 1.60934
#: Words in a name, and classes, that stand for scenery.
SCENIC_WORDS, SCENIC_CLASSES = ("trail", "creek", "park", "greenway", "path"), ("cycleway", "path")
#: By mode its own access tag, values of it that close an edge, values that are only mentioned, whether fords
#: matter and can be passed, and whether obstacles in water close an edge.
MODE_RULES = {
    "cycling": ("bicycle", ("no", "use_sidepath", "destination"), ("dismount",), True, False, False),
    "hiking": ("foot", ("no",), (), True, True, False),
    "paddling": ("canoe", ("no", "private", "permit"), (), False, True, True),
    "driving": ("motor_vehicle", ("no", "private", "destination", "permit"), (), True, False, False),
}
GENERIC_ACCESS = ("no", "private")
FORDS, OBSTACLES = ("yes", "stepping_stones"), ("weir", "lock_gate", "waterfall", "hazard")
#: Barriers that a mode mentions where no access tag speaks.
BARRIERS = {"cycling": ("cycle_barrier", "gate"), "hiking": ("gate",), "paddling": (), "driving": ("cycle_barrier", "bollard", "gate")}
#: By metric one notch that an author notices, its name, the narrowest range that is promised.
METRIC_NOTCH = {"distance_m": 1000.0, "climb_m": 100.0, "traffic": 0.1, "unpaved_frac": 0.1, "scenic_frac": 0.1, "salience": 0.1}
METRIC_NAME = {"distance_m": "distance", "climb_m": "climbing", "traffic": "traffic exposure", "unpaved_frac": "unpaved share", "scenic_frac": "scenic share", "salience": "realized salience"}
METRIC_GRAIN = {"distance_m": 100.0, "climb_m": 25.0, "traffic": 0.05, "unpaved_frac": 0.05, "scenic_frac": 0.05, "salience": 0.05}
#: Speeds in km/h by mode; transit has none.
SPEED_KMH = {"cycling": 15.0, "hiking": 5.0, "paddling": 4.0, "cross_country_skiing": 8.0, "driving": 60.0}


def lookup(table: dict, key: Column, default: float | None = None) -> Column:
    """A value from a fixed table; the default for other and null keys."""
    found = F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def edge_cost(length: Column, stress: Column, scenic_hit: Column, bucket_weight: Column, grade: Column, salience: Column, profile: dict[str, float]) -> Column:
    """Cost of an edge for a profile (quiet, scenic, peaks, interest, directness): its length times a factor of 0.05 at
    least. Null bucket weights and saliences leave their term out."""
    g = F.least(F.coalesce(grade, F.lit(0.0)), F.lit(0.12)) / 0.12
    # The terms are summed before 1 comes in: 1 + (p - 1) would lose their last digits, and costs on a half would be rounded otherwise.
    terms = (
        profile["quiet"] * stress * 2.0 - F.when(scenic_hit, F.lit(profile["scenic"] * 0.35)).otherwise(0.0)
        - F.coalesce(bucket_weight, F.lit(0.0)) * 0.6 - profile["peaks"] * g * 0.6 - profile["interest"] * F.coalesce(salience, F.lit(0.0)) * 0.6
    )
    p = 1 + terms * (1 - profile["directness"])
    return length * F.greatest(p, F.lit(0.05))


def speed_kmh(text: Column) -> Column:
    """A speed limit in km/h; miles an hour are converted, words are no limit."""
    t = F.lower(F.trim(text))
    return F.when(t.endswith("mph"), F.regexp_replace(t, "mph$", "").try_cast("double") * MILE_KM).otherwise(t.try_cast("double"))


def lane_count(text: Column) -> Column:
    """Whole lanes; what isn't a number is null."""
    return F.trim(text).try_cast("double").cast("int")


def stress(highway: Column, maxspeed: Column, lanes: Column) -> Column:
    """The traffic that a road class stands for; classes that may be busy or not have none without a sign of it."""
    sign = F.coalesce(speed_kmh(maxspeed) >= FAST_KMH, F.lit(False)) | F.coalesce(lane_count(lanes) >= WIDE_LANES, F.lit(False))
    return F.when(F.coalesce(highway.isin(*CALM), F.lit(False)) | sign, lookup(TRAFFIC, highway, TRAFFIC_DEFAULT)).otherwise(0.0)


def surface_class(surface: Column) -> Column:
    """paved, gravel or null, from the surface alone."""
    t = F.lower(surface)
    return F.when(t.isin(*PAVED), "paved").when(t.isin(*UNPAVED), "gravel")


def surface_bucket(highway: Column, surface: Column) -> Column:
    """paved, gravel, singletrack or null: a trail that isn't paved is a singletrack, and so is one without a surface;
    other surfaces that aren't known stay unknown."""
    kind, trail = surface_class(surface), F.coalesce(highway.isin(*TRAILS), F.lit(False))
    return F.when(kind == "paved", kind).when((kind == "gravel") & trail, "singletrack").when(kind == "gravel", kind).when(surface.isNull() & trail, "singletrack")


def scenic(highway: Column, name: Column) -> Column:
    words = F.lower(F.coalesce(name, F.lit("")))
    hit = F.coalesce(highway.isin(*SCENIC_CLASSES), F.lit(False))
    for w in SCENIC_WORDS:
        hit = hit | words.contains(w)
    return hit


def edge_features(length: Column, highway: Column, surface: Column, maxspeed: Column, lanes: Column, name: Column, grade: Column) -> Column:
    """length (1 where it is missing or 0), stress, quality, scenic, grade and bucket of an edge as a struct."""
    known = F.coalesce(highway, F.lit("unclassified"))
    return F.struct(
        F.when(length.isNull() | (length == 0), 1.0).otherwise(length).alias("length"), stress(known, maxspeed, lanes).alias("stress"), lookup(SURFACE_QUALITY, surface, SURFACE_DEFAULT).alias("quality"),
        scenic(known, name).alias("scenic"), F.abs(F.coalesce(grade, F.lit(0.0))).alias("grade"), surface_bucket(known, surface).alias("bucket"),
    )


def with_legality(rows: DataFrame, tags: dict[str, Column], modes: Iterable[str] = MODE_RULES) -> DataFrame:
    """rows with a column for each mode: struct (passable, reason, flags) of an edge for it. tags are arrays of values by key;
    access, the mode's own key, barrier, ford and waterway are looked at. The mode's own tag beats the generic one outright;
    what it allows also opens barriers; barriers without a word on access are only mentioned; the first rule that closes
    an edge names itself.

    Tags are lower-cased once, and each mode's tag in force, reason and flags are columns of their own: as one expression they
    would be expanded wherever they are named.
    """
    none = F.array().cast("array<string>")
    modes, names = list(modes), rows.columns
    keys = sorted({"access", "barrier", "ford", "waterway"} | {MODE_RULES[m][0] for m in modes})
    low = {k: F.transform(F.array_compact(tags[k]), F.lower) if k in tags else F.lit(None).cast("array<string>") for k in keys}
    rows = rows.select("*", *[F.when(F.size(c) > 0, c).otherwise(none).alias(f"_{k}") for k, c in low.items()])
    among = lambda k, listed: F.array_intersect(f"_{k}", F.array(*[F.lit(v) for v in listed])) if listed else none
    first = lambda k, listed: F.get(among(k, listed), F.lit(0))
    said = lambda k, value: F.concat(F.lit(f"{k}="), value)
    marked = lambda k, values: F.transform(values, lambda v: said(k, v))
    for m in modes:
        key, closed, _, fords, wade, water = MODE_RULES[m]
        speaks = F.size(f"_{key}") > 0
        opened = F.when(speaks, F.col(f"_{key}")).otherwise(F.col("_access"))
        rows = rows.select("*", F.size(opened).alias("_used"), F.arrays_overlap(opened, F.array(*[F.lit(v) for v in sorted({*closed, *GENERIC_ACCESS})])).alias("_barred"))
        rules = [F.when(speaks, said(key, first(key, closed))).otherwise(said("access", first("access", GENERIC_ACCESS))), F.when(F.col("_barred"), said("barrier", F.get("_barrier", F.lit(0))))]
        rules += [said("ford", first("ford", FORDS))] if fords and not wade else []
        rules += [said("waterway", first("waterway", OBSTACLES))] if water else []
        rows = rows.select("*", F.coalesce(*rules).alias("_reason"))
        told = [(key, among(key, MODE_RULES[m][2]), F.lit(True)), ("barrier", among("barrier", BARRIERS[m]), F.col("_used") == 0)] + ([("ford", among("ford", FORDS), F.lit(True))] if fords and wade else [])
        marks = [F.when(cond & (F.size(values) > 0), marked(k, values)).otherwise(none) for k, values, cond in told if values is not none]
        flags = F.array_sort(F.array_distinct(F.concat(*marks))) if marks else none
        verdict = F.struct(F.col("_reason").isNull().alias("passable"), F.col("_reason").alias("reason"), F.when(F.col("_reason").isNull(), flags).otherwise(none).alias("flags"))
        rows = rows.select("*", verdict.alias(m)).drop("_used", "_barred", "_reason")
    return rows.select(*names, *modes)


def author_to_solver(climbing: Column, traffic: Column, interest: Column, surface: Column) -> Column:
    """An author's dials (0 to 5, null where unset; surface a map by class) as the solver's weights: climbing and surfaces
    about an indifferent 2.5, traffic turned round, interest as a share. Unset dials keep the solver's defaults; a dial out
    of range fails the query."""
    dial = lambda c, n: F.when(c.isNull() | c.between(0, 5), c).otherwise(F.raise_error(F.concat(F.lit(f"{n} outside 0..5: "), c.cast("string"))).cast("double"))
    both = lambda c, n: F.coalesce((dial(c, n) - 2.5) / 2.5, F.lit(0.0))
    return F.struct(
        both(climbing, "climbing").alias("peaks"), F.coalesce((5 - dial(traffic, "traffic")) / 5, F.lit(0.5)).alias("quiet"), F.coalesce(dial(interest, "interest") / 5, F.lit(0.0)).alias("interest"),
        *[both(F.element_at(surface, k), k).alias(f"surface_{k}") for k in ("paved", "gravel", "singletrack")],
    )


def metric_text(metric: Column, value: Column) -> Column:
    """A value of a metric as text: shares in percent, metres with thousands, else the plain number."""
    share = metric.endswith("_frac") | metric.isin("traffic", "salience")
    return F.when(share, F.concat(F.format_string("%.0f", value * 100), F.lit("%"))).when(metric.endswith("_m"), F.concat(F.format_number(value, 0), F.lit(" m"))).otherwise(value.cast("string"))


def widened(low: Column, high: Column, value: Column) -> tuple[Column, Column]:
    """The narrowest band around this one that holds a value; an open side stays open."""
    return F.when(value < low, value).otherwise(low), F.when(value > high, value).otherwise(high)


def distance_band(target: Column, vias: Column, share: float = 0.10, many: int = 3) -> tuple[Column, Column]:
    """The band about a target distance, at least as wide as the metric's grain; none without a target, or with so many
    fixed places that they set the distance."""
    half = F.greatest(target * share, F.lit(METRIC_GRAIN["distance_m"] / 2))
    free = target.isNotNull() & (vias < many)
    return F.when(free, target - half), F.when(free, target + half)


def envelope(metric: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """A range of a metric widened to its grain, slid back into what the metric can be, and rounded outward to grains."""
    grain = lookup(METRIC_GRAIN, metric)
    most = F.when(metric.isin("distance_m", "climb_m"), F.lit(float("inf"))).otherwise(1.0)
    thin = high - low < grain
    a, b = F.when(thin, (low + high) / 2 - grain / 2).otherwise(low), F.when(thin, (low + high) / 2 + grain / 2).otherwise(high)
    a, b = F.when(thin & (a < 0), 0.0).otherwise(a), F.when(thin & (a < 0), b - a).otherwise(b)
    a, b = F.when(thin & (b > most), a - (b - most)).otherwise(a), F.when(thin & (b > most), most).otherwise(b)
    return F.floor(F.round(F.greatest(a, F.lit(0.0)) / grain, 9)) * grain, F.ceil(F.round(b / grain, 9)) * grain


def band_shortfall(value: Column, low: Column, high: Column) -> Column:
    """How far a value lies outside a band, signed; null without a value, open without a bound."""
    return F.when(value.isNull(), F.lit(None).cast("double")).when(value < low, value - low).when(value > high, value - high).otherwise(0.0)
