"""Packing documents into sequences: shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokens import load

SIZE = 2048
#: The id that ends every document.
END = 1
#: Pieces of one length that are ranked together.
RANKED = 50_000


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids cut into runs of `size` and a rest."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            at = 0
            for lengths, ids in encoder.encode_many(batch.column("text").to_pylist()):
                own = batch.column("doc_id")[at : at + len(lengths)].to_pylist()
                at += len(lengths)
                ends = np.cumsum(lengths)
                view = memoryview(np.insert(ids, ends, end).astype("<u4").view(np.uint8))
                starts = (ends - lengths + np.arange(len(lengths))).tolist()
                rows = []
                for i, s, n in zip(own, starts, (lengths + 1).tolist(), strict=True):
                    rows += [(i, k, min(size, n - k), zlib.crc32(view[4 * (s + k) : 4 * (s + min(k + size, n))]), n) for k in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, how many such packs). Lengths are placed longest first, each into the shortest pack that
    there is, if it fits, else into a new one; packs of one pattern are handled by their count. A pack may take several
    pieces of one length.

    The work depends on the different lengths, at most `size`, and on `size`, and not on the number of pieces.
    """
    # By the space left: runs (length, pieces) and how many packs have these.
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = defaultdict(dict)
    widest = 0

    def put(space: int, runs: tuple[tuple[int, int], ...], length: int, pieces: int, count: int) -> None:
        """Packs of one pattern, each after `pieces` more of this length."""
        if runs and runs[-1][0] == length:
            runs, pieces = runs[:-1], pieces + runs[-1][1]
        runs = (*runs, (length, pieces))
        open_[space][runs] = open_[space].get(runs, 0) + count

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while widest and not open_[widest]:
                widest -= 1
            if widest >= length:
                runs, count = open_[widest].popitem()
                used = min(n, count)
                if count > used:
                    open_[widest][runs] = count - used
                put(widest - length, runs, length, 1, used)
                n -= used
                continue
            # No pack has room, so a new one stays the shortest until this length no longer fits.
            most = size // length
            for pieces, count in ((most, n // most), (n % most, 1)):
                if pieces and count:
                    put(size - pieces * length, (), length, pieces, count)
                    widest = max(widest, size - pieces * length)
            n = 0
    return [(tuple(k for k, m in runs for _ in range(m)), n) for space in sorted(open_) for runs, n in open_[space].items()]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, sequence of the first rank, offset, pieces) for each run of one length
    in each pattern: each of its sequences takes `pieces` ranks in a row."""
    out, used, sequence = [], defaultdict(int), 0
    for pattern, count in packs:
        offset = 0
        for length, run in groupby(pattern):
            n = len(list(run))
            out.append((length, used[length], used[length] + n * count, sequence, offset, n))
            used[length] += n * count
            offset += n * length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece of each row of docs.

    Null texts count as empty and give one piece, the end id; null ids stay null; repeated rows are packed once for
    each row; other columns aren't read; an empty table gives no pieces. Sequences are numbered from 0.

    Only the histogram of piece lengths, at most `size` rows, comes to the driver. Pieces of one length are ranked in
    chunks of about RANKED rows, chosen by hash, so that a frequent length needs no task of its own.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, size, end), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(
        slots(patterns(histogram, size)) or [(0, 0, 0, 0, 0, 1)], "length long, low long, high long, sequence long, offset long, pieces long"
    )
    counts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()] or [(0, 1)], "length long, chunks long")
    rows = cut.join(F.broadcast(counts), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), "chunks"))
    sums = rows.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(sums, ["length", "chunk"]).withColumn("rank", F.col("own") + F.col("ahead"))
    placed = ranked.alias("p").join(
        F.broadcast(table).alias("s"),
        (F.col("p.length") == F.col("s.length")) & (F.col("p.rank") >= F.col("s.low")) & (F.col("p.rank") < F.col("s.high")),
    )
    sequence = F.col("sequence") + F.expr("(rank - low) div pieces")
    offset = F.col("offset") + (F.col("rank") - F.col("low")) % F.col("pieces") * F.col("p.length")
    return placed.select("doc_id", "start", "p.length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), offset.alias("offset"))
