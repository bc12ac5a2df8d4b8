"""Quality rules: an isolation forest over rule statistics of whole documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: ASCII white space, as in common.WORD; the same that bytes.split() takes.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Statistics as the forest sees them: shares, none of which follows a document's length.
FEATURES = ("symbols", "upper", "stutter", "commonest", "marks")
STATS_SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "features array<double>"
)
STATS_NAMES = [c.split()[0] for c in STATS_SCHEMA.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight found twice or more. Equal windows have equal hashes; those of equal hash
    are then compared word by word, so the count is exact."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    tied = rolled[order][1:] == rolled[order][:-1]
    if not tied.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][tied], order[:-1][tied]]))
    places: dict[tuple, list[int]] = {}
    for i in suspects.tolist():
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    step = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for same in places.values() if len(same) > 1 for i in same], np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the features of one text; null is empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dups += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    n, c = max(1, len(words)), max(1, chars)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper = int(counts[65:91].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    h = np.fromiter(map(hash, words), np.int64, len(words))
    stutter = int((h[1:] == h[:-1]).sum())
    commonest = int(np.unique(h, return_counts=True)[1].max(initial=0))
    features = [symbols / n, upper / c, stutter / n, commonest / (n + WINDOW), marks / c]
    return len(words), chars, symbols, dups, repeats, [float(x) for x in features]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """One row of STATS_SCHEMA for each row of docs; only doc_id and text are read. Runs where the rows are, without a
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([r[i] for r in got], pa.int64()) for i in range(5)]
            features = pa.array([r[5] for r in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, features], names=STATS_NAMES)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STATS_SCHEMA)


@dataclass(frozen=True)
class Forest:
    """Isolation trees as flat arrays [tree, node]: feature (-1 at a leaf), split value, left child (right is the next
    node) and, at leaves, the path length. At most trees * (2 * sample - 1) nodes, whatever the corpus."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 ** (-mean path length / expected path length)."""
        total = np.zeros(len(x))
        for feature, split, left, length in zip(self.feature, self.split, self.left, self.length, strict=True):
            node = np.zeros(len(x), np.int32)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= split[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(expected_path(self.sample), 1e-9))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Grow isolation trees, each on its own random sample of the rows of x; splits are uniform in a random feature."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    size = max(1, 2 * sample - 1)
    arrays = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size), np.int32), np.zeros((trees, size))
    limit = math.ceil(math.log2(max(2, sample))) + 4
    for t in range(trees):
        feature, split, left, length = (a[t] for a in arrays)
        todo, used = [(0, x[rng.choice(len(x), sample, replace=False)], 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if len(rows) < 2 or depth >= limit or not len(able):
                length[node] = depth + expected_path(len(rows))
                continue
            f = int(rng.choice(able))
            v = rng.uniform(low[f], high[f])
            feature[node], split[node], left[node] = f, v, used
            todo += [(used, rows[rows[:, f] < v], depth + 1), (used + 1, rows[rows[:, f] >= v], depth + 1)]
            used += 2
    return Forest(*arrays, sample)


@dataclass(frozen=True)
class QualityRules:
    """A fitted forest with its threshold. Without labelled rows there is no forest, and only the base rules judge."""

    forest: Forest | None
    threshold: float

    def verdicts(self, texts: pa.Array) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Statistics, anomaly scores (nan without a forest), base_failed and kept of each text."""
        got = [statistics(t.as_py()) for t in texts]
        n = np.array([r[0] for r in got], np.int64)
        repeats = np.array([r[4] for r in got], np.int64)
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        score = np.full(len(got), np.nan)
        if self.forest is not None and len(got):
            score = self.forest.score(np.array([r[5] for r in got]))
        return got, score, failed, ~failed & ~(score > self.threshold)


def calibrate(score: np.ndarray, clean: np.ndarray, price: float = 30.0) -> float:
    """The threshold with the least cost on labelled rows, where a clean row above it costs `price` times a junk row
    below it; both are counted as shares of their class. Among equals, the largest."""
    order = np.argsort(score)
    s, c = score[order], clean[order].astype(float)
    kept_junk = np.cumsum(1 - c) / max(1.0, (1 - c).sum())
    lost_clean = (c.sum() - np.cumsum(c)) / max(1.0, c.sum())
    cost = kept_junk + price * lost_clean
    last = np.append(s[1:] > s[:-1], True)  # equal scores fall on one side
    best = np.flatnonzero(last & (cost <= cost[last].min() + 1e-12))[-1]
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float("inf")


def fit_quality_rules(docs: DataFrame, labels: DataFrame, bound: int = 10_000) -> QualityRules:
    """Fit the forest on labelled rows without their labels, the anomalous ones among them, and set its threshold from the
    labels.

    At most `bound` labelled documents are used: those whose ids hash lowest. Null ids, texts or labels are passed
    over; so are rows that the base rules reject, on which the forest has no say. The sample is joined as a
    broadcast of `bound` ids.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rule_statistics(texts.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").filter(
        (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    got = rows.select("doc_id", "quality", "features").orderBy("doc_id", "features").limit(bound).collect()
    clean = np.array([r.quality == 1 for r in got], bool)
    x = np.array([r.features for r in got], float).reshape(len(got), len(FEATURES))
    if not clean.any():
        return QualityRules(None, float("inf"))
    forest = fit_forest(x)
    return QualityRules(forest, calibrate(forest.score(x), clean))


def judge(docs: DataFrame, model: QualityRules) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly (null without a forest) and kept, for each row of docs.

    Null texts count as empty, and fail the base rules; null ids stay null; repeated rows give repeated rows; other
    columns are not looked at.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, score, failed, kept = model.verdicts(batch.column("text"))
            columns = [pa.array([r[i] for r in got], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns, pa.array(score, from_pandas=True), pa.array(failed), pa.array(kept)],
                names=[*STATS_NAMES[:-1], "anomaly", "base_failed", "kept"],
            )

    schema = STATS_SCHEMA.replace("features array<double>", "anomaly double, base_failed boolean, kept boolean")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityRules) -> DataFrame:
    """The rows of docs, with all their columns, that `judge` keeps."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.verdicts(batch.column("text"))[3]))

    return docs.mapInArrow(run, docs.schema)
