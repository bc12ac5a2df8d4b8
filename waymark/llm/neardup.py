"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard similarity on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import components
from .words import mix64, shingle_set

WIDTH = 5
#: Coordinates: BANDS * ROWS. A pair at similarity 0.75 shares no band once in 300,000 times (1 - 0.75 ** 6) ** 64.
BANDS, ROWS = 64, 6
#: Linked from this similarity on, in percent.
PERCENT = 75
#: Shingles permuted at once, for all coordinates: 400 kB, which stay in a core's cache.
_BLOCK = 1 << 8


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: one permutation scatters the shingles over the 32-bit numbers; coordinate k is the least
    value that the second permutation, shifted k places round, gives any of them."""
    at = _permute((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32))
    # Places are taken odd multiples apart, so that neighbours on the circle don't meet again in the next coordinate.
    shifts = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)[:, None]
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), _BLOCK):
        x = at[None, i : i + _BLOCK] + shifts
        y = x >> np.uint32(16)
        for factor in (0x7FEB352D, 0x846CA68B):  # _permute, in place
            x ^= y
            x *= np.uint32(factor)
            np.right_shift(x, np.uint32(15 if factor == 0x7FEB352D else 16), out=y)
        x ^= y
        np.minimum(out, x.min(1), out=out)
    return out


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of the signature; equal keys of different bands are kept apart."""
    parts = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    key = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1))
    for r in range(rows):
        key = mix64(key ^ parts[:, r])
    return key.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text of docs. The key is a digest of the text: rows that share an id but not a text are told apart
    by it."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, n_shingles, high and low (a 128-bit digest of the shingle set), bands (empty without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), WIDTH)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    high.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                    low.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(s, bands, rows) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_shingles", "high", "low", "bands"],
            )

    return keyed(docs).mapInArrow(run, "doc_id bigint, key bigint, n_shingles bigint, high bigint, low bigint, bands array<bigint>")


def linked(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, ka, b, kb, text_a, text_b) whose whole shingle sets reach the similarity, as (a, ka, b, kb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            good = []
            heads = zip(batch.column("a").to_pylist(), batch.column("ka").to_pylist(), strict=True)
            for a, ta, tb in zip(heads, batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != known[0]:
                    known = a, shingle_set(ta.as_py(), WIDTH)
                x, y = known[1], shingle_set(tb.as_py(), WIDTH)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "ka", "b", "kb"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "ka", "b", "kb", "text_a", "text_b").mapInArrow(run, "a bigint, ka bigint, b bigint, kb bigint")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Fetch the texts of pairs (a, ka, b, kb) and keep the linked ones. Both joins are on a unique key of texts."""
    named = lambda n: texts.select(F.col("doc_id").alias(n), F.col("key").alias("k" + n), F.col("text").alias("text_" + n))
    return linked(pairs.join(named("a"), ["a", "ka"]).join(named("b"), ["b", "kb"]))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns aren't read).

    Texts of fewer than five words have their whole sequence as one shingle; null texts and texts without words have
    none, and are linked with nothing. Rows that share an id count as linked, whatever their texts, and each of these
    texts is compared. A row without an id is linked with nothing: its component_id is null and it is kept. An empty
    table gives an empty result.

    Documents with equal sets are one class, and only the class's smallest member is banded. In each bucket the members
    are first compared with the smallest one alone; links so found are contracted, and what then remains to be
    compared are members of different components. So a group of n near copies costs about n comparisons for each of
    its buckets' first members, and not n * n.
    """
    small_batches(docs.sparkSession)
    sketch = materialize(sketches(docs, bands, rows), "sketches")
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    # Of two texts of one id either may be the head: which one changes no link.
    heads = materialize(some.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("head"), F.min_by("key", "doc_id").alias("key")), "heads")
    same = some.select("doc_id", "high", "low", "n_shingles").join(heads, ["high", "low", "n_shingles"]).filter("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    firsts = some.join(heads.select(F.col("head").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
    buckets = firsts.select("doc_id", "key", "n_shingles", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("a"), F.min_by("key", "doc_id").alias("ka")).filter("size > 1").drop("size")
    crowd = materialize(buckets.join(shared, "bucket"), "crowd")
    sizes = crowd.select("doc_id", "key", "n_shingles").distinct()
    texts = materialize(keyed(docs).join(sizes.select("doc_id", "key"), ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"]), "texts")
    stars = crowd.filter("doc_id != a or key != ka").select("a", "ka", F.col("doc_id").alias("b"), F.col("key").alias("kb"), F.col("n_shingles").alias("nb")).distinct()
    stars = stars.join(sizes.select(F.col("doc_id").alias("a"), F.col("key").alias("ka"), F.col("n_shingles").alias("na")), ["a", "ka"])
    done = materialize(stars.filter(_may("na", "nb") & (F.col("a") != F.col("b"))).select("a", "ka", "b", "kb"), "stars")
    links = materialize(verify(done, texts).select("a", "b").distinct(), "links")
    labels = components(links)
    # Buckets whose members are still in different components: what the hub was not linked with may be linked itself.
    left = crowd.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = materialize(left.select("bucket", "doc_id", "key", "component"), "left")
    mixed = left.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket")
    open_ = materialize(left.join(mixed, "bucket", "left_semi").select("doc_id", "key", "component").distinct(), "open")
    rest = materialize(rare_pairs(texts.join(open_, ["doc_id", "key"])).join(done, ["a", "ka", "b", "kb"], "left_anti"), "rest")
    again = materialize(verify(rest, texts).select("a", "b").distinct(), "again")
    found = components(links.unionByName(again).unionByName(same))
    out = sketch.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: Counters by which shingles are ordered from rare to frequent; their number doesn't depend on the data.
COUNTERS = 1 << 18
#: Rows that a task holds before it hands them on.
FLUSH = 1 << 16


def rare_pairs(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs (a, ka, b, kb; a < b) of docs (doc_id, key, text, component) of different components that can reach the
    similarity.

    Exact: sets of m and n shingles reach it if they share at least o = ceil(percent * (m + n) / (100 + percent)). Put
    in any one order, they then share one of the first m - o + 1 of the one and n - o + 1 of the other. Rare shingles
    come first, so passages that many documents share seldom make a pair. The order follows COUNTERS counts of hashed
    shingles, a table of fixed size that the tasks read as a broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                slots, n = np.unique(shingle_set(text.as_py(), WIDTH) % np.uint64(COUNTERS), return_counts=True)
                total[slots.astype(np.int64)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for slot, n in docs.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n")).toLocalIterator():
        counts[slot] = n
    order = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "key", "component", "n", "token", "place"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[c] for h in held]), pa.int64()) for c in range(len(names))], names=names)

        for batch in batches:
            whole = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "component")), batch.column("text"), strict=True)
            for *ids, text in whole:
                s = shingle_set(text.as_py(), WIDTH)
                first = len(s) - -(-percent * len(s) // 100) + 1
                chosen = s[np.lexsort((s, order.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))[:first]].view(np.int64)
                for at in range(0, len(chosen), FLUSH):
                    part = chosen[at : at + FLUSH]
                    held.append([*(np.full(len(part), i) for i in (*ids, len(s))), part, np.arange(at + 1, at + 1 + len(part))])
                    n += len(part)
                    if n >= FLUSH:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    rows = materialize(docs.select("doc_id", "key", "component", "text").mapInArrow(prefixes, ", ".join(f"{c} bigint" for c in names)), "prefixes")
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("token")
    rows = materialize(rows.join(mixed, "token", "left_semi"), "prefixes")
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.col("x.doc_id") < F.col("y.doc_id"))
    least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    on = on & (F.col("x.place") <= F.col("x.n") - least + 1) & (F.col("y.place") <= F.col("y.n") - least + 1)
    return x.join(y, on).select(F.col("x.doc_id").alias("a"), F.col("x.key").alias("ka"), F.col("y.doc_id").alias("b"), F.col("y.key").alias("kb")).distinct()


def _may(a: str, b: str):
    """Sets of these sizes can reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of its component; rows without an id stay."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
