"""Conversation structure repair: cheapest edits of roles to a grammar, by cost layers of state bitsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD, materialize, small_batches

#: Costs of the edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar (s?(ua)+)?: at the start, after the system's row, after the user's, after the assistant's. A set of
#: states is four bits; four such sets, one for each state that a block can end in, lie side by side in one number.
START, SYSTEM, USER, ASSISTANT = range(4)
_LANES = 0x1111
#: The state after a row that an edit makes, from each state: only the user's or the assistant's turn can be next.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_FAR = 1 << 40
#: Rows of a conversation that are judged at once, as a power of two.
BLOCK_BITS = 8


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with the damage that crc32 of `conv_id:turn` modulo 20 stands for: 0 drops a row, 1
    empties its text, 2 removes its full stops, question and exclamation marks, 3 repeats it, 4 sets its role to user.
    Nulls in role, text and the hashed key count as one space; conv_id and turn themselves stay null. copy tells a row's
    repeat from it."""
    space = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with pos: a number that rises by one from row to row of a conversation, in order of turn, nulls first; rows of
    one turn go by role and the text's hash. The order is dealt by ranges, so a long conversation spreads over tasks."""
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "hash", "copy"]
    out = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(out.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"), "turns")


def judged(rows: DataFrame) -> DataFrame:
    """pos, conv_id and code of placed rows. A row's first fault counts: blank, duplicate (role and text seen earlier in the
    conversation) or truncated. code is four times the role's initial (s, u, a, another) and the fault's kind: 0 none,
    1 truncated, 2 blank, 3 duplicate, as one letter from A on."""
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(WORD), 2).when(F.col("first").isNull(), 3).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 1).otherwise(0)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.join(firsts, "pos", "left").select("pos", "conv_id", F.char(F.lit(65) + 4 * kind + fault).alias("code"))


def _edited(m: int) -> int:
    """The states from which a row of the next role in turn leads into one of m."""
    return ((m >> USER) & _LANES) * 0b1011 | ((m & (_LANES << ASSISTANT)) >> 1)


def _kept(m: int, role: int) -> int:
    """The states from which a row of this role (0 s, 1 u, 2 a, 3 another), kept, leads into one of m."""
    if role == 0:
        return (m & (_LANES << SYSTEM)) >> 1
    if role == 1:
        return ((m >> USER) & _LANES) * 0b1011
    return (m & (_LANES << ASSISTANT)) >> 1 if role == 2 else 0


def layers(codes: list[int], ends: dict[int, int]) -> Iterator[list[int]]:
    """For each cost from 0 on: the set of states, before each row and after the last one, from which the rows that follow
    can be edited at exactly this cost. ends has the sets that are accepted behind the rows, by cost."""
    n, made = len(codes), []
    while True:
        c = len(made)
        back = lambda k, i, c=c: made[c - k][i] if c >= k else 0
        row = [0] * n + [ends.get(c, 0) | _edited(back(INSERT, n))]
        made.append(row)
        for i in range(n - 1, -1, -1):
            role, fault = divmod(codes[i], 4)
            m = _edited(back(INSERT, i)) | back(DELETE, i + 1)
            if fault < 2:
                k = TRUNCATED * fault
                m |= _kept(back(k, i + 1), role) | _edited(back(k + REROLE, i + 1))
            row[i] = m
        yield row


def block_costs(codes: list[int]) -> list[int]:
    """The least cost of editing the rows of a block from each state to each state, 16 numbers; _FAR where none will do."""
    out = [_FAR] * 16
    # All of these can be reached; START only from itself, SYSTEM from itself or, with a system's row to keep, from START.
    wanted = {4 * a + b for a in range(4) for b in (USER, ASSISTANT)} | {0, 5} | ({1} if any(x // 4 == 0 and x % 4 < 2 for x in codes) else set())
    for c, row in enumerate(layers(codes, {0: 0x8421})):
        for k in [k for k in wanted if row[0] >> (4 * (k % 4) + k // 4) & 1]:
            out[k] = c
            wanted.discard(k)
        if not wanted:
            return out


def block_edits(codes: list[int], goal: list[int], entry: int) -> tuple[int, list[str]]:
    """The state at a block's end, and the edits' initials for each of its rows, of the ASCII-least cheapest edits from an
    entry state. goal: the cost of what follows the block, from each state. Rows put in stand before the row that they
    precede; those behind the last row of a conversation are a piece of their own."""
    least = min(goal)
    ends: dict[int, int] = {}
    for s, cost in enumerate(goal):
        if cost < _FAR:
            ends[cost - least] = ends.get(cost - least, 0) | 1 << s
    made = []
    for row in layers(codes, ends):
        made.append(row)
        if row[0] >> entry & 1:
            break
    c, i, s, pieces, piece = len(made) - 1, 0, entry, [], ""
    has = lambda k, i, s: c >= k and made[c - k][i] >> s & 1
    while i < len(codes) or goal[s] - least != c:
        if i == len(codes):
            c, s, piece = c - INSERT, _NEXT[s], piece + "I"
            continue
        role, fault = divmod(codes[i], 4)
        k = TRUNCATED * fault
        keep = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}.get((role, s))
        if has(DELETE, i + 1, s):
            c, i, letter = c - DELETE, i + 1, "D"
        elif has(INSERT, i, _NEXT[s]):
            c, s, piece = c - INSERT, _NEXT[s], piece + "I"
            continue
        elif fault < 2 and keep is not None and has(k, i + 1, keep):
            c, i, s, letter = c - k, i + 1, keep, "K"
        else:
            c, i, s, letter = c - k - REROLE, i + 1, _NEXT[s], "R"
        pieces.append(piece + letter)
        piece = ""
    return s, pieces + [piece] if piece else pieces


#: What a whole conversation costs behind its last row.
_ACCEPTED = [0, _FAR, _FAR, 0]


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def edits(coded: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """pos and edits (the initials of the cheapest edits at that row; after the last row of a conversation, pos is one more
    than its and edits are the rows put in behind it) of judged rows.

    A conversation is judged in blocks of at most 2 ** block_bits rows. A block's least costs from each state to each are
    16 numbers. Read from the last block on, they give what remains to be paid behind each block; then each block
    traces its edits from each of the four states, and read from the first block on, the states say which trace holds. The
    two readings stream one small row a block through the tasks, sorted, and keep four numbers.
    """
    kind = coded.schema["conv_id"].dataType
    numbers = F.array_sort(F.collect_list(F.struct("pos", "code")))
    blocks = coded.groupBy("conv_id", F.shiftright("pos", block_bits).alias("block")).agg(numbers.alias("rows"))
    blocks = blocks.select("conv_id", F.col("rows")[0]["pos"].alias("first"), F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = [block_costs([b - 65 for b in x.as_py().encode()]) for x in batch.column("codes")]
            yield batch.append_column("costs", pa.array(costs, pa.list_(pa.int64())))

    longs = lambda *names: StructType([StructField("conv_id", kind)] + [StructField(n, LongType()) for n in names])
    blocks = materialize(blocks.mapInArrow(cost, longs("first").add("codes", "string").add("costs", ArrayType(LongType()))), "blocks")

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        goal = _ACCEPTED
        for batch in batches:
            goals = []
            for conv, costs in _rows(batch, "conv_id", "costs"):
                goal = goal if known == (conv,) else _ACCEPTED
                known = (conv,)
                goals.append(goal)
                goal = [min(costs[4 * a + b] + goal[b] for b in range(4)) for a in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(goals, pa.list_(pa.int64()))], names=["first", "goal"])

    goals = blocks.select("conv_id", "first", "costs").repartition("conv_id").sortWithinPartitions(F.desc("first")).mapInArrow(backward, "first bigint, goal array<bigint>")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, pieces = [], []
            for codes, goal in _rows(batch, "codes", "goal"):
                done = [block_edits([b - 65 for b in codes.encode()], goal, s) for s in range(4)]
                ends.append([d[0] for d in done])
                pieces.append([d[1] for d in done])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("conv_id", "first")), pa.array(ends, pa.list_(pa.int64())), pa.array(pieces, pa.list_(pa.list_(pa.string())))], names=["conv_id", "first", "ends", "pieces"])

    traced = blocks.drop("costs").join(goals, "first").mapInArrow(trace, longs("first").add("ends", ArrayType(LongType())).add("pieces", ArrayType(ArrayType(StringType()))))
    traced = materialize(traced, "traces")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        state = START
        for batch in batches:
            entries = []
            for conv, ends in _rows(batch, "conv_id", "ends"):
                state = state if known == (conv,) else START
                known = (conv,)
                entries.append(state)
                state = ends[state]
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(entries, pa.int64())], names=["first", "entry"])

    entries = traced.select("conv_id", "first", "ends").repartition("conv_id").sortWithinPartitions("first").mapInArrow(forward, "first bigint, entry bigint")
    chosen = traced.join(entries, "first").select("first", F.posexplode(F.get("pieces", F.col("entry").cast("int"))).alias("k", "edits"))
    return chosen.select((F.col("first") + F.col("k")).alias("pos"), "edits")


def _summary(kind) -> StructType:
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    return StructType([StructField("conv_id", kind)] + [StructField(n, LongType()) for n in names] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")])


def repair(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """For each conv_id of conversations (conv_id, turn, role, text; other columns aren't read): gaps, blank, duplicate,
    truncated, illegal, cost, audit and repaired_sha256, after the damage of `damage`.

    gaps is maxTurn - minTurn + 1 - distinct turns, nulls aside; blank, duplicate and truncated count rows by their first
    fault; illegal counts neighbours whose roles can't follow each other; cost and audit are those of the cheapest edits to
    the grammar, ties to the ASCII-least; repaired_sha256 is the digest of the repaired `role:text` lines. Rows with a
    null conv_id are one conversation. A conversation without rows after damage has zeros, an empty audit and the digest
    of nothing; an empty table gives an empty result.

    A digest needs a conversation's texts in order, so they are streamed, sorted, through one task that keeps the digest,
    a state and the audit's letters, one a row; all else is spread over blocks.
    """
    small_batches(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType
    rows = placed(damage(conversations))
    coded = materialize(judged(rows), "judged")
    made = edits(coded, block_bits)
    behind = made.join(coded.select("pos"), "pos", "left_anti").select((F.col("pos") - 1).alias("pos"), F.col("edits").alias("behind"))
    lines = rows.join(coded.drop("conv_id"), "pos").join(made, "pos").join(behind, "pos", "left").select("conv_id", "pos", "role", "text", "code", "edits", "behind")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ()
        counts, audit, sha, state, last, empty = [0] * 5, [], hashlib.sha256(), START, None, True

        def row() -> list:
            return [known[0], *counts, "".join(audit), sha.hexdigest()]

        def put(line: str) -> None:
            nonlocal empty
            sha.update(("" if empty else "\n").encode() + line.encode("utf-8", "surrogatepass"))
            empty = False

        out = []
        for batch in batches:
            for conv, role, text, code, pieces, behind in _rows(batch, "conv_id", "role", "text", "code", "edits", "behind"):
                if known != (conv,):
                    if known:
                        out.append(row())
                    known, counts, audit, sha, state, last, empty = (conv,), [0] * 5, [], hashlib.sha256(), START, None, True
                initial, fault = divmod(ord(code) - 65, 4)
                for k, which in enumerate((2, 3, 1)):
                    counts[k] += fault == which
                counts[3] += last is not None and (last, initial) not in ((0, 1), (1, 2), (2, 1))
                last = initial
                for letter in pieces + (behind or ""):
                    audit.append(letter)
                    if letter == "D":
                        counts[4] += DELETE
                        continue
                    state = SYSTEM if letter == "K" and initial == 0 else _NEXT[state]
                    put(f"{role if letter == 'K' else _NAMES[state]}:{'' if letter == 'I' else text}")
                    counts[4] += INSERT if letter == "I" else TRUNCATED * fault + REROLE * (letter == "R")
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)
                out = []
        if known:
            yield pa.RecordBatch.from_pylist([dict(zip(names, row(), strict=True))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _summary(kind)
    names, arrow = schema.names, to_arrow_schema(schema)
    told = lines.repartition("conv_id").sortWithinPartitions("pos").mapInArrow(digest, schema)
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = conversations.select("conv_id").distinct()
    same = lambda side, other: F.col(f"{side}.conv_id").eqNullSafe(F.col(f"{other}.conv_id"))
    out = every.alias("e").join(told.alias("t"), same("e", "t"), "left").join(gaps.alias("g"), same("e", "g"), "left")
    zero = F.lit(0).cast("bigint")
    numbers = [F.coalesce(F.col(n).cast("bigint"), zero).alias(n) for n in ("gaps", *names[1:6])]
    return out.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
