"""Spelling variants: counted words, each with its near words by full neighbourhood generation, and their common forms."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .words import mix64

#: The runs of letters that are words, once A-Z are lower-cased.
_RUN = re.compile("[a-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point if this divides its hash.
DAMAGE = 97
#: Different words that a task counts before it hands them on.
FLUSH = 1 << 17
#: Candidates hashed at once.
_BLOCK = 1 << 20
#: The filter of the vocabulary has 16 bits a word, within these bounds: 128 MB at most.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def count_words(docs: DataFrame) -> DataFrame:
    """word and n: the words of all whole texts of docs (doc_id, text) that have LEAST_LENGTH code points and LEAST_COUNT
    occurrences. A run is damaged by the hash of its document's id and itself. Null texts have no words; a null id
    hashes as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(total)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                lowered = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(lowered)).items():
                    if len(word) < LEAST_LENGTH:
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % DAMAGE == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) >= FLUSH:
                    yield flush()
        if total:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(_BASE)
    return np.multiply.accumulate(out)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


def _terms(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in a filter of so many bits, a power of two."""
    down = np.uint64(64 - (bits.bit_length() - 1))
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> down, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> down


def _by_length(words: list[str]) -> Iterator[list[int]]:
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        yield np.flatnonzero(lengths == length).tolist()


def vocabulary_filter(vocabulary: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of the words, two places each, as 64-bit cells. Its size is bounded by MOST_BITS; a larger
    vocabulary fills it more, so that more candidates pass that are no words, and none is lost."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * size - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for rows in _by_length(words):
                codes = _codes([words[i] for i in rows])
                h = (_terms(codes) * _powers(codes.shape[1])).sum(1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(h, bits)).astype(np.int64))], names=["slot"])

    cells = np.zeros(bits // 64, np.uint64)
    slots = vocabulary.select("word").mapInArrow(run, "slot bigint")
    cell = F.shiftright("slot", 6)
    found = slots.groupBy(cell.alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")).toArrow()
    cells[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return cells


def neighbourhood(words: list[str], alphabet: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, str]]:
    """(index, candidate): every distinct string that differs from a word by one deletion, replacement or insertion of a
    letter of the alphabet (code points) and may be in the filter. All are generated, as hashes; only those that pass
    become strings."""
    bits = len(cells) * 64
    letters = _terms(alphabet)

    def passed(h: np.ndarray) -> np.ndarray:
        at = np.arange(h.size)
        h = h.ravel()
        for k in (0, 1):
            slot = _slots(h[at], bits)[k]
            at = at[(cells[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0]
        return at

    for group in _by_length(words):
        length = len(words[group[0]])
        power = _powers(length + 2)
        step = max(1, _BLOCK // (length * len(alphabet)))
        for first in range(0, len(group), step):
            rows = group[first : first + step]
            codes = _codes([words[i] for i in rows])
            value = _terms(codes) * power[:length]
            before = np.zeros((len(rows), length + 1), np.uint64)
            np.cumsum(value, axis=1, out=before[:, 1:])
            whole = before[:, -1:]
            after = whole - before
            # The second of two equal letters in a row gives nothing new, nor does a letter put in front of its equal.
            h = before[:, :-1] + after[:, 1:] * np.uint64(_BACK)
            fresh = np.ones(codes.shape, bool)
            fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
            for k in passed(h).tolist():
                r, i = divmod(k, length)
                if fresh[r, i]:
                    w = words[rows[r]]
                    yield rows[r], w[:i] + w[i + 1 :]
            wide = max(1, _BLOCK // (len(rows) * len(alphabet)))
            for lo in range(0, length + 1, wide):
                hi = min(lo + wide, length + 1)
                put = letters[None, None, :] * power[None, lo:hi, None]
                inserted = put + (before[:, lo:hi] + after[:, lo:hi] * np.uint64(_BASE))[:, :, None]
                for k in passed(inserted).tolist():
                    r, rest = divmod(k, (hi - lo) * len(alphabet))
                    i, a = divmod(rest, len(alphabet))
                    i += lo
                    if i == length or codes[r, i] != alphabet[a]:
                        w = words[rows[r]]
                        yield rows[r], w[:i] + chr(alphabet[a]) + w[i:]
                top = min(hi, length)
                if top > lo:
                    replaced = put[:, : top - lo] + (whole - value[:, lo:top])[:, :, None]
                    for k in passed(replaced).tolist():
                        r, rest = divmod(k, (top - lo) * len(alphabet))
                        i, a = divmod(rest, len(alphabet))
                        i += lo
                        if codes[r, i] != alphabet[a]:
                            w = words[rows[r]]
                            yield rows[r], w[:i] + chr(alphabet[a]) + w[i + 1 :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, form, n_near and form_n for each row of vocabulary (word, n; words are distinct and have letters).

    Two words are near at one inserted, deleted or replaced code point; n_near counts a word's near ones. form is the one
    of largest n, ties to the smallest in code-point order, if it has at least twice the word's n.

    Every word emits its whole neighbourhood over the alphabet that the vocabulary shows. A candidate that is in the
    vocabulary is near, so the hash join on the word decides and no distance is computed. A Bloom filter of the
    vocabulary drops most candidates that are no words before they are shuffled. Nearness goes both ways: candidates are
    grouped where they are joined, and say which words reach them.
    """
    spark = vocabulary.sparkSession
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c != ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in letters.collect()), np.uint32)
    shared = spark.sparkContext.broadcast((alphabet, vocabulary_filter(vocabulary, max(1, vocabulary.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, cells = shared.value
        for batch in batches:
            words = batch.column("word").to_pylist()
            index: list[int] = []
            found: list[str] = []

            def flush(batch: pa.RecordBatch = batch, index: list = index, found: list = found) -> pa.RecordBatch:
                rows = batch.take(pa.array(index, pa.int64()))
                out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), rows.column("word"), rows.column("n")], names=["word", "other", "other_n"])
                index.clear()
                found.clear()
                return out

            for i, candidate in neighbourhood(words, alphabet, cells):
                index.append(i)
                found.append(candidate)
                if len(found) >= FLUSH // 4:
                    yield flush()
            if found:
                yield flush()

    candidates = vocabulary.select("word", "n").mapInArrow(run, "word string, other string, other_n bigint")
    best = candidates.join(vocabulary, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    out = vocabulary.join(best, "word", "left")
    strong = -F.col("best.rank") >= 2 * F.col("n")
    return out.select("word", "n", F.when(strong, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(strong, -F.col("best.rank")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each row of forms (word, form) that has a form: the last word that following forms leads to.

    A form has at least twice its word's count, so chains have no loops. Each round goes twice as far as the one before.
    """
    up = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(up.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = step.drop("moved")
        if step.filter("moved").isEmpty():
            return up


def group_variants(docs: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n for each word of docs (doc_id, text): see count_words, near_words, roots. A
    word without a form is its own root. An empty table gives an empty result."""
    vocabulary = materialize(count_words(docs), "vocabulary")
    forms = materialize(near_words(vocabulary), "forms")
    return forms.join(roots(forms), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
