"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .words import mix64

#: Buckets of the hashed n-grams, and bytes of an n-gram.
SLOTS, GRAM = 1 << 16, 4
#: The share of documents to keep is the labelled share of quality 1 and so many standard errors more, since a clean
#: document lost is dearer than a poor one kept.
ERRORS = 2.0
#: N-grams that a text counts as, whatever its length. N-grams of one text overlap and repeat, so their summed log ratio says
#: far more than they know: at full length the noise decided nothing, and length weighed more than quality.
EVIDENCE = 50.0
#: The log weight of a text without n-grams: none at all.
NOTHING = -1e9


def gram_slots(text: str | None) -> np.ndarray:
    """The bucket of each run of GRAM bytes of a text; a shorter text has none."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.uint32)
    packed = b[: len(b) - GRAM + 1].copy()
    for k in range(1, GRAM):
        packed = (packed << np.uint32(8)) | b[k : len(b) - GRAM + 1 + k]
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(16)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts of docs. Each task sends at most SLOTS sums, and so does Spark to the
    driver, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(total, gram_slots(text.as_py()), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot bigint, n bigint")
    for slot, n in rows.groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out


@dataclass(frozen=True)
class Importance:
    """log p_target - log p_raw for each bucket, and the share of documents to keep."""

    ratio: np.ndarray
    share: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Log importance weights: the log probability of each text's n-grams under the target's model less that under
        the raw text's, on the scale of EVIDENCE n-grams. A text without n-grams weighs nothing."""
        slots = (gram_slots(text.as_py()) for text in texts)
        return np.array([EVIDENCE * self.ratio[s].mean() if len(s) else NOTHING for s in slots], float)

    def kept(self, keys: np.ndarray, cut: float) -> np.ndarray:
        return (keys >= cut) & (keys > NOTHING / 2)

    def keys(self, ids: pa.Array, scores: np.ndarray) -> np.ndarray:
        """Gumbel keys: log weight plus noise that depends on the id alone, so that reruns agree. The documents of the k
        largest keys are a sample of k without replacement by these weights."""
        i = np.array(ids.fill_null(-1), np.int64).view(np.uint64)
        u = ((mix64(i ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
        return scores - np.log(-np.log(u))


def fit_importance(docs: DataFrame, labels: DataFrame, bound: int = 10_000) -> Importance | None:
    """Raw counts come from all of docs; the target's from labelled documents of quality 1. The share to keep is the
    share of these among the labelled documents that docs hold, plus ERRORS standard errors. At most `bound` labelled
    documents are used (the ids that hash lowest). None if none of them is of quality 1 or docs have no text. Null ids,
    texts and labels are passed over."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sample = materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled")
    raw, target = gram_counts(docs), gram_counts(sample.filter("quality = 1"))
    if not target.any() or not raw.any():
        return None
    smooth = lambda n: np.log((n + 1.0) / (n.sum() + SLOTS))
    clean, n = sample.agg(F.count(F.when(F.col("quality") == 1, 1)), F.count(F.lit(1))).first()
    share = clean / n
    return Importance(smooth(target) - smooth(raw), min(1.0, share + ERRORS * (share * (1 - share) / n) ** 0.5))


def score(docs: DataFrame, model: Importance) -> DataFrame:
    """doc_id, score (log importance weight), key for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array(model.keys(batch.column("doc_id"), s))], names=["doc_id", "score", "key"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, score double, key double"
    )


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest of the values of a column of doubles without nulls, by histograms of 4,096 buckets that close
    in on it; only those come to the driver. With fewer than k values, -inf; with k < 1, inf."""
    if k < 1:
        return float("inf")
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if n < k:
        return float("-inf")
    while high > low:
        step = (high - low) / 4096
        if low + step == low:
            values = sorted((r[0] for r in rows.filter(F.col(column).between(low, high)).select(column).distinct().collect()), reverse=True)
            counts = dict(rows.filter(F.col(column).between(low, high)).groupBy(column).count().collect())
            for v in values:
                k -= counts[v]
                if k <= 0:
                    return v
        inside = rows.filter(F.col(column).between(low, high))
        slot = F.least(F.lit(4095), F.floor((F.col(column) - F.lit(low)) / F.lit(step))).alias("slot")
        got = sorted(inside.groupBy(slot).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect(), reverse=True)
        for _, count, least, most in got:
            if k <= count:
                low, high = least, most
                break
            k -= count
    return low


def resample(docs: DataFrame, model: Importance | None) -> tuple[DataFrame, float]:
    """(doc_id, score, key and kept for each row of docs, the least key kept): Gumbel top-k with k = ceil(share * rows).

    Null texts and texts shorter than an n-gram weigh nothing and are never kept; null ids share one noise; keys equal to the k-th are all
    kept, so repeated rows are kept or rejected together; other columns aren't read. Without a model every row is kept,
    with null scores and keys.
    """
    if model is None:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("key"), F.lit(True).alias("kept")), float("-inf")
    small_batches(docs.sparkSession)
    rows = materialize(score(docs, model), "scores")
    cut = kth_largest(rows, "key", math.ceil(model.share * rows.count()))
    return rows.withColumn("kept", (F.col("key") >= F.lit(cut)) & (F.col("key") > NOTHING / 2)), cut


def keep_sampled(docs: DataFrame, model: Importance | None) -> DataFrame:
    """The rows of docs, with all their columns, that `resample` keeps."""
    if model is None:
        return docs
    cut = resample(docs, model)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = model.keys(batch.column("doc_id").cast(pa.int64()), model.scores(batch.column("text").cast(pa.string())))
            yield batch.filter(pa.array(model.kept(key, cut)))

    return docs.mapInArrow(run, docs.schema)
