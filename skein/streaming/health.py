"""Streaming forms: source health, incremental results, seen URLs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.state import COLUMNS, SCHEMA, fold_calls

def engine_state(calls: DataFrame) -> DataFrame:
    """The state of each source after each micro-batch; calls: engine, ts, seq, outcome, response_ms."""

    kinds = {"success": 0, "failure": 1}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = pd.concat(list(frames)).sort_values(["ts", "seq"])
        before = state.get if state.exists else (0, 0, 0, 0, 0, None)
        after = fold_calls(before, c.ts.to_numpy(), c.outcome.map(lambda o: kinds.get(o, 2)).to_numpy(np.int64), c.response_ms.fillna(0).to_numpy(np.int64))
        state.update(after)
        yield pd.DataFrame([(key[0], *after)], columns=["engine", *COLUMNS]).astype({"disabled_until": "Int64"})

    return calls.groupBy("engine").applyInPandasWithState(update, SCHEMA, SCHEMA.removeprefix("engine string, "), "update", GroupStateTimeout.NoTimeout)


def incremental(items: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch of items to on_batch as it comes; returns the query."""
    return items.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()


def unseen(items: DataFrame, watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """Items whose URL has not come within the watermark."""
    return items.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["url"])


def call_rates(calls: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window), "engine").agg(F.count("*").alias("calls"))
