"""Entry triggers over position streams: a change of state needs a streak of readings, so jitter at a border is quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.sources.scratch import settle

#: Readings in a row that enter or leave.
ENTER, EXIT = 3, 3
OUTPUT = "user_id long, ts timestamp, event string"


def step(inside: bool, streak: int, reading: bool) -> tuple[bool, int, str | None]:
    """The state after one reading and the event that it makes."""
    streak = streak + 1 if reading != inside else 0
    if streak >= (EXIT if inside else ENTER):
        return reading, 0, "enter" if reading else "exit"
    return inside, streak, None


def fold(rows: pd.DataFrame, inside: bool = False, streak: int = 0) -> tuple[list[tuple], bool, int]:
    events = []
    for ts, reading in zip(rows["ts"], rows["inside"], strict=True):
        inside, streak, event = step(inside, streak, bool(reading))
        if event:
            events.append((ts, event))
    return events, inside, streak


#: A state (inside, streak) is numbered inside * STREAKS + streak; for each state and reading the next one and the event.
STREAKS = max(ENTER, EXIT)
TABLE = [[(int(i) * STREAKS + n, event) for i, n, event in (step(s >= STREAKS, s % STREAKS, r) for r in (False, True))] for s in range(2 * STREAKS)]
#: What a chunk says of a user: an event, with the state at its start that leads to it (null: any), or the state at its
#: end for each state at its start.
PART = "user_id long, chunk int, start int, at long, event string, ends array<int>"


def fold_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PART from user_id, at and inside, in order. Each user is followed from every state; ways that meet go on as one."""
    chunk = TaskContext.get().partitionId()
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in PART.split(", ")]
    out: list[tuple] = []
    now, ways = None, {}  # ways: the states at the start by the state that they have led to

    def end() -> tuple:
        return now, chunk, None, None, None, [k for _, k in sorted((s, k) for k, starts in ways.items() for s in starts)]

    for batch in batches:
        for user, at, reading in zip(*(batch.column(c).to_pylist() for c in ("user_id", "at", "inside")), strict=True):
            if not ways or user != now:
                if ways:
                    out.append(end())
                now, ways = user, {s: [s] for s in range(2 * STREAKS)}
            met: dict[int, list[int]] = {}
            for state, starts in ways.items():
                state, event = TABLE[state][bool(reading)]
                met[state] = met[state] + starts if state in met else starts
                if event:
                    out += [(user, chunk, s, at, event, None) for s in (starts if len(ways) > 1 else [None])]
            ways = met
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)
            out = []
    if ways:
        out.append(end())
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=names)


def entry_events(positions: DataFrame) -> DataFrame:
    """user_id, ts, event for a stream (or batch) of positions (user_id, ts, inside). State is one flag and one count
    for each user; rows of a micro-batch are folded in order of ts, then of event_id if there is one, then of inside.

    In a batch, rows are put in that order by ranges, so a user of any size is spread over tasks. Each range is folded
    from every state, a user's ranges are put together from the states at their ends, and the events of the ways that
    weren't taken are dropped.
    """
    ties = [c for c in ("event_id", "inside") if c in positions.columns]
    if not positions.isStreaming:
        order = [F.col("user_id"), F.col("ts").asc_nulls_last(), *ties]
        rows = positions.select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), *ties)
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        parts = settle(rows.select("user_id", F.unix_micros("ts").alias("at"), "inside").mapInArrow(fold_chunks, PART), "triggers")
        ranges = parts.filter("ends IS NOT NULL").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends"))).alias("ranges"))
        starts = F.aggregate("ranges", F.array(F.lit(0)), lambda done, r: F.concat(done, F.array(F.get(r["ends"], F.element_at(done, -1)))))
        taken = ranges.select("user_id", F.explode(F.arrays_zip(F.col("ranges.chunk").alias("chunk"), F.slice(starts, 1, F.size("ranges")).alias("taken"))).alias("r"))
        taken = taken.select(F.col("user_id").alias("user"), F.col("r.chunk").alias("range"), F.col("r.taken").alias("taken"))
        events = parts.filter("event IS NOT NULL").join(taken, F.col("user_id").eqNullSafe(F.col("user")) & (F.col("chunk") == F.col("range")))
        return events.filter("start IS NULL OR start = taken").select("user_id", F.timestamp_micros("at").alias("ts"), "event")

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, streak = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", *ties])
        events, inside, streak = fold(rows, bool(inside), int(streak))
        state.update((inside, streak))
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["user_id", "ts", "event"])

    return positions.groupBy("user_id").applyInPandasWithState(update, OUTPUT, "inside boolean, streak int", "append", GroupStateTimeout.NoTimeout)
