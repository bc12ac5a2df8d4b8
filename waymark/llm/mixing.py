"""Mixing sources to target weights: certain whole copies, then a Pareto sample of each source for the rest."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, unit

#: A target is at most so many times its source's size.
MOST = 3
#: Classes of document sizes for each doubling of the size, by which inclusion probabilities are scaled.
CLASSES = 16
#: Buckets of a source's places in the order.
FAN = 1 << 16
#: Sources at most: a table with a row for each is broadcast.
SOURCES = 100_000


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST) -> dict[str | None, float]:
    """Each source's share of all sizes by weight; none above `most` times its own size, and what is above goes to the
    others by weight, until none is above."""
    out: dict[str | None, float] = {}
    left, free = float(sum(sizes.values())), dict(weights)
    while free:
        total = sum(free.values())
        share = {s: left * w / total for s, w in free.items()}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del free[s]
    return out


def cycle_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, 1, ... in code point order, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(k % 3 + 1) for k, s in enumerate(ordered)}


def inclusion_scale(classes: list[tuple[int, int]], quota: float) -> float:
    """c such that documents taken with probability min(1, c * size) have `quota` words on average. classes holds the sum
    of sizes and of squared sizes of the documents of a source by class of size; a class is certain as a whole or not."""
    certain, squares = 0, sum(q for _, q in classes)
    for words, square in sorted(classes, key=lambda c: c[0] / c[1]):  # the longest documents first
        scale = (quota - certain) / squares if squares else 0.0
        if scale * square <= words:
            return scale
        certain, squares = certain + words, squares - square
    return float("inf")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """docs with _id (the id; for a row without one, a digest of its text), _source, _size (words) and _u, a number in
    (0, 1) that follows from seed and _id. Built-in functions only, so a document's row is never moved for it."""
    text = F.col("text").cast("string")
    ident = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return docs.withColumns({
        "_id": ident, "_source": F.col("source").cast("string"), "_size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint"),
        "_u": unit(F.md5(F.concat(F.lit(f"{seed}:"), ident))),
    })


def place(c: str) -> Column:
    """Where a document stands in its source's Pareto order, in [0, 1]: q / (1 + q), with q its random odds divided by its
    inclusion odds. Certain documents stand at 0, those without words at 1."""
    p = F.col(c) * F.col("_size")
    q = F.col("_u") / (1 - F.col("_u")) * ((1 - p) / p)
    return F.when(F.col("_size") == 0, F.lit(1.0)).when(p >= 1, F.lit(0.0)).when(p <= 0, F.lit(1.0)).otherwise(q / (1 + q))


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row a source, which every task reads."""
    table = F.broadcast(table.withColumnRenamed("source", "_of"))
    return rows.join(table, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")


def plan(rows: DataFrame, weights=cycle_weights, most: float = MOST) -> DataFrame:
    """One row for each source of rows (_id, _source, _size, _u): source, source_size, target, whole, scale, and the place,
    size and id of the last document that the sample takes (_last; null if it takes none).

    What comes to the driver are sums by source and class of size; sources are few. No source is gathered in one task:
    amounts are summed by FAN buckets of the place, then by 256 coarse ones, and only the one bucket of each source in
    which its quota ends is put in order.
    """
    spark: SparkSession = rows.sparkSession
    of_class = F.floor(F.log2(F.greatest(F.col("_size"), F.lit(1))) * CLASSES).cast("int").alias("class")
    sums = rows.groupBy("_source", of_class).agg(F.sum("_size").alias("words"), F.sum(F.col("_size").cast("double") ** 2).alias("squares")).collect()
    classes: dict[str | None, list[tuple[int, int]]] = defaultdict(list)
    for r in sorted(sums, key=lambda r: r["class"]):
        classes[r._source] += [(r.words, r.squares)] if r.words else []
    sizes = {s: sum(w for w, _ in c) for s, c in ((r._source, classes[r._source]) for r in sums)}
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    goal = targets(sizes, weights(list(sizes)), most)
    table = []
    for s, size in sizes.items():
        whole = min(int(goal[s] // size), int(most)) if size else 0
        quota = max(0.0, goal[s] - whole * size)
        scale = inclusion_scale(classes[s], quota) if quota else 0.0
        table.append((s, size, goal[s], whole, quota, min(scale, 1.0)))
    sources = spark.createDataFrame(table, "source string, source_size long, target double, whole int, quota double, scale double")
    placed = by_source(rows, sources.select("source", "quota", "scale")).filter("_size > 0 and quota > 0")
    placed = placed.select("_source", "_id", "_size", "quota", place("scale").alias("_place"))
    placed = placed.withColumn("_at", F.least(F.lit(FAN - 1), F.floor(F.col("_place") * FAN)).cast("int"))
    steps = materialize(placed.groupBy("_source", "_at").agg(F.sum("_size").alias("amount"), F.first("quota").alias("quota")), "steps")

    def end(table: DataFrame, at: str) -> DataFrame:
        """The step of each source in which its quota ends, or its last one, with the amount before it."""
        w = Window.partitionBy("_source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = table.withColumn("before", F.sum("amount").over(w) - F.col("amount") + F.col("start"))
        found = upto.filter("before <= quota").groupBy("_source").agg(F.max(at).alias(at), F.max("before").alias("before"))
        return found.withColumnRenamed("_source", "source")

    coarse = steps.groupBy("_source", F.floor(F.col("_at") / 256).cast("int").alias("hi")).agg(F.sum("amount").alias("amount"), F.first("quota").alias("quota"))
    coarse = end(coarse.withColumn("start", F.lit(0)), "hi").withColumnsRenamed({"before": "start", "hi": "end_hi"})
    fine = by_source(steps, coarse).filter(F.floor(F.col("_at") / 256) == F.col("end_hi"))
    ends = materialize(end(fine, "_at"), "ends")
    edge = by_source(placed, ends.withColumnRenamed("_at", "_end")).filter("_at = _end")
    # Rows of one id and size stand together: they are all taken, or none.
    edge = edge.groupBy("_source", "_place", "_size", "_id", "quota", "before").agg(F.sum("_size").alias("amount"))
    order = Window.partitionBy("_source").orderBy("_place", "_size", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("ahead", F.sum("amount").over(order) - F.col("amount") + F.col("before"))
    last = edge.filter(2 * F.col("ahead") + F.col("amount") <= 2 * F.col("quota")).groupBy("_source").agg(F.max(F.struct("_place", "_size", "_id")).alias("_last"))
    ends = ends.select("source", (F.col("_at") / F.lit(float(FAN))).alias("_from"))
    out = sources.join(F.broadcast(ends), sources["source"].eqNullSafe(ends["source"]), "left").drop(ends["source"])
    last = last.withColumnRenamed("_source", "_of")
    out = out.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("_of")), "left")
    return materialize(out.select("source", "source_size", "target", "whole", "scale", "quota", "_from", "_last"), "plan")


def copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (_id, _source, _size, _u and any others) with the columns of plan() and how many copies the mix takes."""
    rows = by_source(rows, sources)
    own = F.struct(place("scale").alias("_place"), F.col("_size").alias("_size"), F.col("_id").alias("_id"))
    # Without a last document in the bucket where the quota ends, all before that bucket are taken.
    taken = F.coalesce(own <= F.col("_last"), own["_place"] < F.col("_from"), F.lit(False)) & (F.col("quota") > 0) & (F.col("_size") > 0)
    return rows.withColumn("copies", F.when(F.col("_size") > 0, F.col("whole")).otherwise(0) + taken.cast("int"))


def mix(docs: DataFrame, weights=cycle_weights, most: float = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, text, source; others aren't
    read).

    A document is expected in the mix target / source_size times. The whole part of that is certain. For the rest, a
    document is included with probability min(1, c * size), so that long ones, too, are certain from a size on; c is set
    such that the included documents of a source have as many words as its target still lacks. Documents are ranked by
    random odds u / (1 - u) divided by inclusion odds p / (1 - p), and those that come first are taken: a sample of fixed
    size, the size being counted in words, to the nearest document. taken is copies * size.

    Null sources are a source of their own. A row without an id draws its number by its text. Rows that share an id draw
    the same number; those of one id and size are taken together or not at all. Texts without words have size 0 and
    take nothing. Ties of place go by size and id. An empty table gives an empty result.
    """
    rows = materialize(sized(docs, seed).select(F.col("doc_id").cast("bigint").alias("doc_id"), "_id", "_source", "_size", "_u"), "sizes")
    out = copies(rows, plan(rows, weights, most))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def apply_mix(docs: DataFrame, weights=cycle_weights, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. Texts aren't shuffled: each task
    compares its rows' places with the last ones taken."""
    clash = [c for c in docs.columns if c.startswith("_") or c in ("source_size", "target", "whole", "scale", "quota", "copies")]
    named = reduce(lambda d, c: d.withColumnRenamed(c, f"own {c}"), clash, docs)
    rows = materialize(sized(docs.select("doc_id", "source", "text"), seed).select("_id", "_source", "_size", "_u"), "sizes")
    out = copies(sized(named, seed), plan(rows, weights, most)).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select([F.col(f"`own {c}`").alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns])
