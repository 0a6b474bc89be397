"""Stored entries as the state of a stream: see operators.store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENTRY = "value string, created_at bigint, expires_at bigint, access_count bigint, last_access bigint"
OUT = f"key string, {ENTRY}, removed boolean"
#: The state store that timers and typed state need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _out(key: str, entry: tuple, removed: bool) -> pd.DataFrame:
    cells = [key, *entry, removed]
    df = pd.DataFrame([cells], columns=[c.split()[0] for c in OUT.split(", ")])
    return df.astype({c: "Int64" for c in ("created_at", "expires_at", "access_count", "last_access")})


class Entries(StatefulProcessor):
    """One value state for each key; a timer at its expiry, ``grace`` seconds later, drops it."""

    def __init__(self, grace: int):
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        before, touched = entry, False
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            ts = int(r.ts)
            if r.op == "put":
                entry, touched = (r.value, ts, None if pd.isna(r.ttl) else ts + int(r.ttl), 0, None), True
            elif r.op == "delete":
                touched, entry = touched or entry is not None, None
            elif r.op == "get" and entry is not None and (entry[2] is None or ts < entry[2]):
                entry, touched = (*entry[:3], entry[3] + 1, ts), True
        if not touched:
            return
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if entry is None:
            self.entry.clear()
            if before is not None:
                yield _out(key[0], before, True)
            return
        self.entry.update(entry)
        if entry[2] is not None:
            self.handle.registerTimer(1000 * (entry[2] + self.grace))
        yield _out(key[0], entry, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            entry = tuple(self.entry.get())
            self.entry.clear()
            yield _out(key[0], entry, True)

    def close(self) -> None:
        pass


def entries(ops: DataFrame, late: str = "0 seconds", grace: int = 0) -> DataFrame:
    """After each micro-batch the entries that changed, and those removed: by a delete, or ``grace`` seconds after they expired.

    ops: as for operators.store, with time (a timestamp) beside ts. Reads bump
    the count and time of access in the state. A read that comes after its
    entry has left the state finds nothing, as one that comes after its expiry.
    """
    return (
        ops.withWatermark("time", late)
        .select("key", "time", "ts", "seq", "op", "value", F.col("ttl").cast("double").alias("ttl"))
        .groupBy("key")
        .transformWithStateInPandas(Entries(grace), OUT, "Update", "EventTime")
    )
