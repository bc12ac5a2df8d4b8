"""Near-duplicate documents by SimHash: fingerprints of word shingles, and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import components

WIDTH, SEED = 3, 42
#: Fingerprints link at this many differing bits. The ball that each emits has half this radius, one bit.
RADIUS = 2
#: Shingles whose bits are counted at once: 64 bytes each.
_BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text: a bit is 1 if it is set in over half of the hashes of the word shingles,
    repeats included. Of fewer than three words the whole sequence is the only shingle; without words it is 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends.tolist()[min(WIDTH, len(words)) - 1 :]
    ones, n = np.zeros(64, np.int64), len(last)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _BLOCK], last[at : at + _BLOCK], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, print bigint")


def close_prints(prints: DataFrame) -> DataFrame:
    """Links (a, b; a < b) between the distinct fingerprints (print: long) of a table that join the same fingerprints as
    all pairs within RADIUS would.

    Each fingerprint emits its ball of half the radius: itself and its 64 neighbours at one bit. Two of them within two
    bits share a variant, which lies between them; all that share one lie within two bits of each other. So the variants
    are shuffled, and in each bucket, which has 65 members at most, neighbours in order are a colliding pair: a chain
    joins a bucket with one pair a member and not with all. Pairs are then deduplicated and verified.
    """
    ball = F.expr("transform(sequence(0, 64), i -> CASE WHEN i = 64 THEN print ELSE print ^ shiftleft(1L, i) END)")
    variants = prints.select("print").distinct().select("print", F.explode(ball).alias("variant"))
    pairs = variants.withColumn("a", F.lag("print").over(Window.partitionBy("variant").orderBy("print"))).filter("a is not null")
    return pairs.select("a", F.col("print").alias("b")).distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_prints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable over links, itself
    included) for each row of docs (doc_id, text; other columns aren't read).

    Null texts and texts without words have fingerprint zero and are linked like any other. Rows that share an id count as
    linked, whatever their fingerprints. A row without an id has its fingerprint, but is linked with nothing: its
    component_id is null. An empty table gives an empty result. A group of copies is one fingerprint, so it costs a row
    each and no pairs.
    """
    rows = materialize(fingerprints(docs), "prints")
    known = rows.filter("doc_id is not null")
    heads = materialize(known.groupBy("print").agg(F.min("doc_id").alias("head")), "heads")
    links = materialize(close_prints(heads), "close")
    named = lambda side: heads.select(F.col("print").alias(side), F.col("head").alias(f"h{side}"))
    ids = links.join(named("a"), "a").join(named("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    # An id with several fingerprints joins them.
    several = known.groupBy("doc_id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo != hi").select("doc_id")
    shared = known.join(several, "doc_id").distinct().join(heads, "print").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    found = components(ids.unionByName(shared))
    labels = heads.join(found.withColumnRenamed("node", "head"), "head", "left").select("print", F.coalesce("component", "head").alias("label"))
    out = rows.join(labels, "print", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("label")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
