"""Media columns: chroma fingerprints of audio, and a search that aligns recordings by them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Samples a second, in a frame, and from frame to frame.
RATE, FRAME, HOP = 8000, 2048, 400
#: Recordings match from this share of differing bits down, over at least OVERLAP frames. Measured on vectors rendered
#: as sound, related recordings differ in 0.28 or less and unrelated ones in 0.31 or more. Where fewer than twice so many
#: frames are compared, chance comes nearer, and SHORT is the limit.
BIT_ERRORS, OVERLAP, SHORT = 0.28, 24, 0.18
#: Bits of a query's code that lie nearest to a filter's threshold; codes with up to two of them flipped are looked up too.
DOUBTS = 5
#: Share of differing bits around a code in common from which it is held to be chance. Only each filter's first bit, which
#: noise changes less than the second, is compared, at up to NEAR places on either side, STEP frames from one to the next.
RIM, NEAR, STEP = 0.33, 8, 5
#: A code that stands in more places of the index is dealt out in parts of about so many, each joined with each part of
#: the places that look it up. No pair is lost by it.
FREQUENT = 4096
#: Parts of one code at most; of codes in over a hundred million places they grow.
PARTS = 1 << 15
#: So many frequent codes are sent to every task; with more, they are joined.
LISTED = 1 << 20
#: Frames that one filter spans, and the steps between its values' four levels.
SPAN, LEVELS = 8, (-0.12, 0.0, 0.12)


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters as (kind, first pitch class, pitch classes, frames): kind 0 compares the halves in time, 1 the halves
    in pitch, 2 the checkerboard of both, 3 the middle third in time with the outer ones."""
    return [(k % 4, (5 * k) % 9, (4, 6, 8, 12)[k // 4] if (5 * k) % 9 + (4, 6, 8, 12)[k // 4] <= 12 else 12 - (5 * k) % 9 & ~1, (8, 4, 6, 8)[(k + k // 4) % 4]) for k in range(16)]


_FILTERS = filters()
_CLASS = np.full(FRAME // 2 + 1, -1)
_HZ = np.arange(FRAME // 2 + 1) * RATE / FRAME
_HEARD = (_HZ >= 100) & (_HZ <= 2000)
_CLASS[_HEARD] = np.round(12 * np.log2(_HZ[_HEARD] / 440.0)).astype(int) % 12
_FOLD = (np.arange(12)[:, None] == _CLASS[None, :]).astype(np.float32)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """[frame, 12]: the energy of each pitch class in each frame, scaled to length 1; silence is zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32) ** 2
    out = (power @ _FOLD.T).astype(float)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-3)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 32-bit integer for each place at which all filters fit: two bits, Gray coded, from each of 16 filters over
    the integral image of the chroma frames; and with each, the DOUBTS bits whose filters lie nearest to a threshold.
    Recordings too short for a place have none."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    integral = np.zeros((len(c) + 1, 13))
    integral[1:, 1:] = c.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return integral[at + t1, p1] - integral[at + t0, p1] - integral[at + t1, p0] + integral[at + t0, p0]

    out = np.zeros(n, np.uint32)
    gaps, bits = np.zeros((len(_FILTERS), n)), np.zeros((len(_FILTERS), n), np.uint32)
    for k, (kind, p, height, width) in enumerate(_FILTERS):
        q, h, w = p + height, p + height // 2, width // 2
        whole = area(0, width, p, q)
        if kind == 0:
            part = area(0, w, p, q)
        elif kind == 1:
            part = area(0, width, p, h)
        elif kind == 2:
            part = area(0, w, p, h) + area(w, width, h, q)
        else:
            part = 1.5 * area(width // 3, width - width // 3, p, q)
        value = (2 * part - whole) / np.maximum(whole, 1e-6)
        level = sum((value > x).astype(np.uint32) for x in LEVELS)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
        away = np.abs(value - np.array(LEVELS)[:, None])
        gaps[k] = away.min(0)
        # Crossing the middle threshold changes a Gray code's high bit, crossing another one its low bit.
        bits[k] = np.where(away.argmin(0) == 1, np.uint32(2), np.uint32(1)) << np.uint32(2 * (len(_FILTERS) - 1 - k))
    nearest = np.argsort(gaps, axis=0, kind="stable")[:DOUBTS]
    return out, np.bitwise_or.reduce(np.take_along_axis(bits, nearest, axis=0), axis=0)


def sonify(vector: list[float] | None, note: int = 800) -> np.ndarray:
    """A recording for a vector: one note of 0.1 s for each number, its pitch one of 24 semitones by the number's place
    among normal ones of the vector's own spread, with two overtones. Null and empty vectors are silent."""
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in (() if vector is None else vector)], float)
    if not len(v):
        return np.zeros(0, np.float32)
    spread = float(np.sqrt((v * v).mean())) or 1.0
    pitch = np.array([min(23, int(24 * NormalDist().cdf(x / spread))) for x in v])
    hz = np.repeat(220.0 * 2.0 ** (pitch / 12.0), note)
    phase = 2 * np.pi * np.cumsum(hz) / RATE
    sound = np.sin(phase) + 0.5 * np.sin(2 * phase) + 0.25 * np.sin(3 * phase)
    return (sound * 0.5).astype(np.float32)


def fingerprints(rows: DataFrame, id_column: str, media: str, decode) -> DataFrame:
    """id, codes and doubts (arrays of ints, signed) for each row; decode turns a value of the media column into samples.
    Other columns aren't read."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(decode(x.as_py())) for x in batch.column("media")]
            codes, doubts = (pa.array([g[k].view(np.int32) for g in got], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), codes, doubts], names=["id", "codes", "doubts"])

    return rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(media).alias("media")).mapInArrow(run, "id bigint, codes array<int>, doubts array<int>")


def pcm16(data: bytes | None) -> np.ndarray:
    """Samples of a binary column of little-endian 16-bit mono PCM at RATE; null is silence."""
    return np.frombuffer(data or b"", "<i2").astype(np.float32) / 32768.0


def align(prints: DataFrame, is_query, bit_errors: float = BIT_ERRORS, overlap: int = OVERLAP) -> DataFrame:
    """Matches of the rows of prints (id, codes, doubts) for which is_query holds, against all rows.

    Rows of equal codes are one class, named by its smallest id. The result has a row of kind 'member' for each row of
    prints (id, class_id, codes in n_frames) and a row of kind 'match' for each query and each class that it matches,
    its own included: the offset, in frames, by which the query's codes lie later, the frames compared and the share
    of bits that differ there.

    Classes are joined on single codes, a query's also with up to two doubtful bits flipped; each code in common votes for
    an offset, and every pair's best offset is verified by its bit errors. Codes that very many recordings have, as
    silence has, are joined in parts, so whether a query and a class match depends on nothing but these two. Rows without
    codes are members of a class without matches. Null ids are members only.
    """
    rows = materialize(prints.withColumn("class", F.md5(F.concat_ws(",", F.col("codes").cast("array<string>")))), "prints")
    classes = rows.groupBy("class").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes"), F.min_by("doubts", "id").alias("doubts"))
    classes = materialize(classes, "classes")
    member = rows.select("id", "class", F.size("codes").alias("n_frames")).join(classes.select("class", "class_id"), "class")
    asked = member.filter(F.col("id").isNotNull() & is_query).select(F.col("id").alias("query_id"), F.col("class_id").alias("asked")).distinct()
    some = classes.filter((F.size("codes") > 0) & F.col("class_id").isNotNull()).select("class_id", "codes", "doubts")
    heads = some.join(asked.select(F.col("asked").alias("class_id")).distinct(), "class_id", "left_semi")

    def around(j, side: int, block: int):
        """The first bits at four places of one side of j in one number, zero where there is no code."""
        first = [F.coalesce(F.get("codes", j + side * STEP * (4 * block + k)), F.lit(0)).cast("long").bitwiseAND(F.lit(0xAAAAAAAA)) for k in (1, 2, 3, 4)]
        two = [a.bitwiseOR(F.shiftright(b, 1)) for a, b in (first[:2], first[2:])]
        return F.shiftleft(two[1], 32).bitwiseOR(two[0])

    def posts(df: DataFrame, name: str, at: str, mark: str) -> DataFrame:
        """A row for each code, with the number of codes after it and the first bits around it."""
        rims = [partial(around, side=side, block=block) for side in (-1, 1) for block in range(NEAR // 4)]
        codes = F.transform("codes", lambda c, j: F.struct(c.alias("code"), j.alias("j"), F.get("doubts", j).alias("doubt"), *(rim(j).alias(f"rim{k}_{mark}") for k, rim in enumerate(rims))))
        return df.select(F.col("class_id").alias(name), F.size("codes").alias("n"), F.explode(codes).alias("p")).select(
            name, F.col("p.j").alias(at), (F.col("n") - F.col("p.j") - 1).alias(f"after_{mark}"), F.col("p.code").alias("code"), "p.doubt", *(f"p.rim{k}_{mark}" for k in range(len(rims)))
        )

    def flipped(code, doubt):
        """The code, and with each one and each two of its doubtful bits flipped."""
        bits = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda b: b.bitwiseAND(doubt) != 0)
        two = F.flatten(F.transform(bits, lambda a: F.transform(F.filter(bits, lambda b: b < a), lambda b: a.bitwiseOR(b))))
        return F.transform(F.concat(F.array(F.lit(0)), bits, two), lambda b: code.bitwiseXOR(b))

    index = posts(some, "class_id", "j", "y").drop("doubt")
    parts = F.least(F.ceil(F.col("count") / FREQUENT), F.lit(PARTS)).cast("int").alias("parts")
    frequent = materialize(index.groupBy("code").count().filter(F.col("count") > FREQUENT).select("code", parts), "frequent")
    few = frequent.count() <= LISTED

    def keyed(df: DataFrame, own: list[str], mine: int, other: int) -> DataFrame:
        """A row of a frequent code goes to one part of its own side, by hash, and to every part of the other one."""
        dealt = df.join(F.broadcast(frequent) if few else frequent, "code", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = F.col("code").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        key = key.bitwiseOR(F.shiftleft(F.pmod(F.xxhash64(*own), F.col("parts")), mine)).bitwiseOR(F.shiftleft(F.col("other").cast("long"), other))
        return dealt.withColumn("key", key).drop("code", "parts", "other")

    probes = posts(heads, "asked", "i", "x").withColumn("code", F.explode(flipped(F.col("code"), F.col("doubt")))).drop("doubt")
    # A code in common counts if less than RIM of the first bits around it differ, of the places that both recordings have
    # there. Offsets at which too few frames lie over each other can't match.
    masks = F.array(*(F.lit(x) for x in (0, 0xAAAAAAAA, 0xFFFFFFFF, 0xAAAAAAAAFFFFFFFF - 2**64, -1)))
    before, after = F.least("i", "j"), F.least("after_x", "after_y")
    wrong, bits = F.lit(0), F.lit(0)
    for k in range(NEAR // 2):
        side, block = (before, after)[k // (NEAR // 4)], k % (NEAR // 4)
        places = F.least(F.greatest(F.floor(side / STEP).cast("int") - 4 * block, F.lit(0)), F.lit(4))
        wrong = wrong + F.bit_count(F.col(f"rim{k}_x").bitwiseXOR(F.col(f"rim{k}_y")).bitwiseAND(F.get(masks, places)))
        bits = bits + 16 * places
    enough = (before + after + 1 >= overlap) | (F.col("asked") == F.col("class_id"))
    votes = keyed(probes, ["asked", "i"], 32, 48).join(keyed(index, ["class_id", "j"], 48, 32), "key").filter(enough & (wrong <= bits * RIM))
    votes = votes.groupBy("asked", "class_id", (F.col("i") - F.col("j")).alias("offset")).count()
    best = votes.groupBy("asked", "class_id").agg(F.max(F.struct("count", (-F.abs("offset")).alias("near"), "offset")).alias("best"))
    pairs = best.select("asked", "class_id", F.col("best.offset").alias("offset"), F.col("best.count").alias("votes"))
    pairs = pairs.join(heads.select(F.col("class_id").alias("asked"), F.col("codes").alias("x")), "asked").join(some.select("class_id", F.col("codes").alias("y")), "class_id")
    first = F.greatest(F.col("offset"), F.lit(0))
    frames = F.least(F.size("x") - first, F.size("y") - (first - F.col("offset")))
    pairs = pairs.withColumn("first", first).withColumn("n_frames", frames).filter(f"n_frames >= {overlap} or asked = class_id")
    # bit_count widens a negative number to 64 bits, so the low 32 are cut out.
    wrong = F.aggregate(
        F.zip_with(F.expr("slice(x, first + 1, n_frames)"), F.expr("slice(y, first - offset + 1, n_frames)"), lambda a, b: F.bit_count(a.bitwiseXOR(b).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))),
        F.lit(0), lambda a, b: a + b,
    )
    found = pairs.withColumn("bit_error_rate", wrong / (32.0 * F.col("n_frames"))).filter(
        F.col("bit_error_rate") <= F.when(F.col("n_frames") >= 2 * overlap, F.lit(bit_errors)).otherwise(F.lit(min(SHORT, bit_errors)))
    )
    found = asked.join(found.select("asked", "class_id", "offset", "n_frames", "bit_error_rate"), "asked")
    return member.select(
        F.lit("member").alias("kind"), "id", "class_id", F.lit(None).cast("int").alias("offset"), F.col("n_frames"), F.lit(None).cast("double").alias("bit_error_rate")
    ).unionByName(found.select(F.lit("match").alias("kind"), F.col("query_id").alias("id"), "class_id", F.col("offset").cast("int").alias("offset"), F.col("n_frames").cast("int").alias("n_frames"), "bit_error_rate"))
