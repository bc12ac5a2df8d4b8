"""Roll-ups: length-weighted, null-aware and rule-based aggregates, all with map-side partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import settle


def known_weighted(value: Column, weight: Column) -> Column:
    """Mean of value weighted by weight over rows where value is known; null if none is or the weights sum to 0."""
    known = F.sum(F.when(value.isNotNull(), weight))
    return F.sum(value * weight) / F.nullif(known, F.lit(0.0))


def noisy_or(score: Column) -> Column:
    """1 - product of (1 - score), scores clamped to [0, 1]; a score of 1 gives 1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    logs = F.sum(F.when(s < 1, F.log1p(-s)))
    return F.when(F.max(s) >= 1, F.lit(1.0)).otherwise(1 - F.exp(F.coalesce(logs, F.lit(0.0))))


#: Buckets into which a key's values are counted in each round.
BUCKETS = 1024


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-index percentiles: the element at min(n - 1, int(share * n)) of the ascending values of each key, with n. Keys
    without a known value have no row; null keys are one key.

    Values aren't put in order: each round counts those between a percentile's bounds in BUCKETS equal steps, with partial
    sums in the tasks that read them, and goes on with the smallest and largest value of the step that holds it, until
    they are the same. So a frequent key is spread over all tasks, and only its counts meet.
    """
    some = settle(rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), "values")
    ends = some.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    rank = lambda share: F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")).cast("long"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(share).alias("rank")) for name, share in shares.items()]))
    open_ = settle(ends.select(*keys, "n", "lo", "hi", wanted.alias("w")).select(*keys, "n", "lo", "hi", "w.name", "w.rank"), "ranks")
    done = open_.filter("lo = hi")
    open_ = open_.filter("lo != hi")
    while not open_.isEmpty():
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
        on = same[0]
        for c in same[1:]:
            on = on & c
        near = some.alias("r").join(open_.alias("o"), on).filter("_v BETWEEN lo AND hi").select(*[f"o.{k}" for k in keys], "n", "name", "rank", "lo", "hi", "_v")
        inner = F.least(F.lit(BUCKETS - 1), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))
        # The bounds are steps of their own, so that each round leaves values out, infinite ones and NaN too.
        step = F.when(F.col("_v") == F.col("lo"), -1).when(F.col("_v") == F.col("hi"), BUCKETS).otherwise(inner).alias("_b")
        counts = near.groupBy(*keys, "name", "n", "rank", step).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "name").orderBy("_b"))
        held = counts.withColumn("_upto", upto).filter("_upto > rank AND _upto - _n <= rank")
        found = settle(held.select(*keys, "n", "lo", "hi", "name", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank")), "ranks")
        done, open_ = done.unionByName(found.filter("lo = hi")), found.filter("lo != hi")
    return done.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in shares])


def coverage(rows: DataFrame, tags: list[str], length: str) -> DataFrame:
    """For each tag: rows and length that carry it, and their percentages of all, from one pass over the rows."""
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    sums = rows.agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(length).alias("_length"),
        *[F.sum(one(c)).alias(f"n_{c}") for c in tags], *[F.sum(F.when(F.col(c).isNotNull(), F.col(length)).otherwise(0)).alias(f"l_{c}") for c in tags],
    )
    table = F.explode(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(f"n_{c}").alias("n"), F.col(f"l_{c}").alias("length")) for c in tags]))
    out = sums.select("_rows", "_length", table.alias("t"))
    return out.select(
        F.col("t.tag").alias("tag"), F.col("t.n").alias("n"), F.col("t.length").alias("length"),
        (100.0 * F.col("t.n") / F.nullif(F.col("_rows"), F.lit(0))).alias("pct_rows"), (100.0 * F.col("t.length") / F.nullif(F.col("_length"), F.lit(0))).alias("pct_length"),
    )
