"""Arrivals: a stream of positions against places that are revealed on arrival, each once for good."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.functions import geo
from waymark.operators import shapes

from .triggers import ENTER, EXIT, step

#: Fixed value: how near a point counts as reached where nothing else is said, in metres.
NEAR_M = 40.0
OUTPUT = "user_id long, role_id long, ts timestamp"


def near_roles(positions: DataFrame, roles: DataFrame, areas: DataFrame | None = None, cell: float = 0.01) -> DataFrame:
    """user_id, role_id, ts, seq, inside: each position (user_id, ts, seq, lon, lat) against each role of its trip (role_id,
    trip_id = the position's trip_id, lon, lat, radius_m, on_arrival) that is revealed on arrival.

    A role with an area (areas: role_id, k, lon, lat, a ring) counts as reached inside it, whatever its point; others
    within radius_m (NEAR_M if null). Roles are static: a trip has few, and positions meet only those of their own trip.
    """
    some = roles.filter("on_arrival").select("role_id", "trip_id", F.col("lon").alias("_rlon"), F.col("lat").alias("_rlat"), F.coalesce("radius_m", F.lit(NEAR_M)).alias("_r"))
    ring = None
    if areas is not None:
        legs = shapes.legs(areas, ["role_id"], ["k"], closed=True)
        ring = legs.groupBy("role_id").agg(F.collect_list(F.struct("lon", "lat", "lon2", "lat2")).alias("_ring"))
        some = some.join(ring, "role_id", "left")
    else:
        some = some.withColumn("_ring", F.lit(None).cast("array<struct<lon:double,lat:double,lon2:double,lat2:double>>"))
    rows = positions.join(some, "trip_id")
    py, px = F.col("lat"), F.col("lon")
    meets = lambda g: ((g["lat"] > py) != (g["lat2"] > py)) & (px < (g["lon2"] - g["lon"]) * (py - g["lat"]) / F.nullif(g["lat2"] - g["lat"], F.lit(0.0)) + g["lon"])
    within = F.size(F.filter("_ring", meets)) % 2 == 1
    close = geo.haversine_m(px, py, F.col("_rlon"), F.col("_rlat")) <= F.col("_r")
    return rows.select("user_id", "role_id", "ts", "seq", F.coalesce(F.when(F.col("_ring").isNotNull(), within).otherwise(close), F.lit(False)).alias("inside"))


class Arrivals(StatefulProcessor):
    """The state of one user's role: whether it has fired, for good, and the streak of readings until then. Readings of a
    micro-batch are taken in order of ts and seq; one that isn't later than the last reading taken came too late and is
    passed over, so a replayed batch changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("arrival", "fired boolean, inside boolean, streak int, last_ts timestamp, last_seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fired, inside, streak, last = False, False, 0, None
        if self.state.exists():
            fired, inside, streak, *last = self.state.get()
            last = (pd.Timestamp(last[0]), last[1])
        out = []
        every = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for ts, seq, reading in zip(every["ts"], every["seq"], every["inside"], strict=True):
            if fired:
                break
            if last is not None and (ts, seq) <= last:
                continue
            last = (ts, seq)
            inside, streak, event = step(bool(inside), int(streak), bool(reading))
            if event == "enter":
                fired = True
                out.append((key[0], key[1], ts))
        if last is not None:
            self.state.update((fired, bool(inside), int(streak), last[0].to_pydatetime(), int(last[1])))
        yield pd.DataFrame(out, columns=["user_id", "role_id", "ts"])

    def close(self) -> None:
        pass


def arrivals(readings: DataFrame) -> DataFrame:
    """user_id, role_id, ts: the reading at which each role fires for each user, once and for good: the last of ENTER
    readings in a row inside it. readings are those of near_roles, as a stream or as a table.

    A table is folded without state: a role fires first at the end of the first ENTER readings in a row inside, since it
    must be outside before, so windows over a user's readings of a role tell it.
    """
    if readings.isStreaming:
        return readings.groupBy("user_id", "role_id").transformWithStateInPandas(Arrivals(), OUTPUT, "append", "none")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "role_id").orderBy("ts", "seq")
    streak = F.min(F.col("inside").cast("int")).over(w.rowsBetween(1 - ENTER, 0)) == 1
    full = F.count(F.lit(1)).over(w.rowsBetween(1 - ENTER, 0)) == ENTER
    rows = readings.withColumn("_hit", streak & full).filter("_hit")
    return rows.groupBy("user_id", "role_id").agg(F.min("ts").alias("ts")).select("user_id", "role_id", "ts")


__all__ = ["ENTER", "EXIT", "Arrivals", "arrivals", "near_roles"]
