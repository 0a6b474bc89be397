"""Health of sources, folded over their calls in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("total", "ok", "failed", "consecutive", "avg_ms", "disabled_until")
SCHEMA = "engine string, " + ", ".join(f"{c} bigint" for c in COLUMNS)
# Minutes of the first pause and the growth's last power; failures in a row that look
# like network trouble, and the seconds of their pause.
BASE_MINUTES, MOST_POWER = 5, 5
FAILURES, PAUSE = 3, 300


def backoff_minutes(consecutive: Column) -> Column:
    return (BASE_MINUTES * F.pow(F.lit(5.0), F.least(consecutive - 1, F.lit(MOST_POWER)))).cast("bigint")


def fold_calls(s: tuple, ts: np.ndarray, kind: np.ndarray, ms: np.ndarray) -> tuple:
    """The state (COLUMNS) after some calls of one source in order; kind: 0 success, 1 failure, 2 no results.

    Counts are sums and runs; only the mean, floored at each success, goes step by step.
    """
    total, ok, failed, consecutive, mean, until = s
    done = np.flatnonzero(kind == 0)
    answered = total + np.cumsum(kind < 2)
    for n, x in zip(answered[done].tolist(), ms[done].tolist()):
        mean = x if n == 1 else (mean * (n - 1) + x) // n
    # Calls after the last success, and the pause of the last empty one among them.
    last = int(done[-1]) + 1 if len(done) else 0
    if len(done):
        consecutive, until = 0, None
    empty = np.flatnonzero(kind[last:] == 2)
    if len(empty):
        at = int(empty[-1])
        until = int(ts[last + at]) + 60 * BASE_MINUTES * 5 ** min(consecutive + at, MOST_POWER)
    return total + int((kind < 2).sum()), ok + len(done), failed + int((kind == 1).sum()), consecutive + len(kind) - last, mean, until


def fold(calls: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """engine and COLUMNS after all calls; calls: engine, ts (epoch seconds), seq, outcome, response_ms.

    ``before``: the states that an earlier fold returned; a source in it goes on
    from its state, so that a log can be folded in batches as it grows. Calls
    are sorted by source and time and stream through their task; a source's
    state is all that is kept of it, however many calls it has. (The mean is
    floored at each step, so that the calls of one source have to be read in order.)
    """
    kind = F.when(F.col("outcome") == "success", 0).when(F.col("outcome") == "failure", 1).otherwise(2)
    empty = [F.lit(None).cast("bigint").alias(c) for c in COLUMNS]
    rows = calls.select("engine", F.lit(1).alias("_gen"), "ts", "seq", kind.cast("bigint").alias("kind"), F.coalesce("response_ms", F.lit(0)).cast("bigint").alias("ms"), *empty)
    if before is not None:
        nothing = [F.lit(0).cast("bigint").alias(c) for c in ("ts", "seq", "kind", "ms")]
        rows = before.select("engine", F.lit(0).alias("_gen"), *nothing, *[F.col(c).cast("bigint") for c in COLUMNS]).unionByName(rows)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine, state = None, None
        for batch in batches:
            done: list[tuple] = []
            names = batch.column(0).fill_null("").to_pylist()  # with the null flag beside: a null engine is a source, too
            null = batch.column(0).is_null().to_pylist()
            gen, ts, kind, ms = (np.asarray(batch.column(i)) for i in (1, 2, 4, 5))
            held = list(zip(null, names))
            bounds = [i for i in range(len(held)) if not i or held[i] != held[i - 1]] + [len(held)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if held[a] != engine:
                    if engine is not None:
                        done.append((None if engine[0] else engine[1], *state))
                    engine, state = held[a], (0, 0, 0, 0, 0, None)
                if gen[a] == 0:
                    state, a = tuple(batch.column(6 + i)[a].as_py() for i in range(len(COLUMNS))), a + 1
                state = fold_calls(state, ts[a:b], kind[a:b], ms[a:b])
            yield _states(done)
        if engine is not None:
            yield _states([(None if engine[0] else engine[1], *state)])

    def _states(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (1 + len(COLUMNS))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if not i else pa.int64()) for i, c in enumerate(columns)], names=["engine", *COLUMNS])

    placed = rows.repartition("engine").sortWithinPartitions(F.asc_nulls_first("engine"), "_gen", "ts", "seq")
    return placed.select("engine", "_gen", "ts", "seq", "kind", "ms", *COLUMNS).mapInArrow(folded, SCHEMA)


# What errors of the network say.
NETWORK = ("HTTP 错误", "status", "连接", "超时")
# Calls of a source are put in order by as many seconds; results do not depend on it.
SLICE = 7 * 86400


def pause_log(calls: DataFrame) -> DataFrame:
    """Every pause that network errors brought: engine, disabled_until, failures, re_enabled_at, temporarily_disabled.

    calls: as for fold, with error. Failures in a row are counted; a failure
    whose error speaks of the network pauses its source if FAILURES or more are,
    anew each time, until PAUSE seconds after the last such one. A success ends
    the row and its pause: re_enabled_at is its time, failures the length of the
    row. A pause that no success has ended is temporarily_disabled.

    Calls are put in order by source and SLICE seconds. A slice gives one piece
    a row; rows that lie within it and pause nothing are left there, the others'
    pieces are put together by source. Calls without a time come last.
    """
    network = F.lit(False)
    for part in NETWORK:
        network = network | F.contains(F.coalesce("error", F.lit("")), F.lit(part))
    is_ = lambda o: F.coalesce(F.col("outcome") == o, F.lit(False))
    known = calls.where("outcome is not null").select("engine", "ts", "seq", is_("success").alias("_ok"), (is_("failure") & network).alias("_network"))
    ok, cut, before = F.col("_ok"), F.col("_network"), (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("engine", "_slice").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("seq"), "_ok", "_network")
    placed = known.withColumn("_slice", F.floor(F.col("ts") / SLICE)).withColumn("_n", F.row_number().over(inside))
    # A success belongs to the row that it ends.
    rows = placed.withColumn("_healed", F.max(F.when(ok, F.col("_n"))).over(inside.rowsBetween(*before)))
    pieces = rows.groupBy("engine", "_slice", "_healed").agg(
        F.count_if(~ok).alias("failures"),
        F.max(F.when(cut, F.col("_n") - F.coalesce("_healed", F.lit(0)))).alias("_last"),
        F.max(F.when(cut, F.col("ts"))).alias("_at"),
        F.max(F.when(ok, F.col("ts"))).alias("re_enabled_at"),
        F.bool_or(ok).alias("_ended"),
    )
    left = pieces.where(F.col("_healed").isNull() | ~F.col("_ended") | (F.col("_last") >= FAILURES))
    along = F.asc_nulls_last("_slice"), F.asc_nulls_first("_healed")
    upto = lambda c, *keys: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(*along).rowsBetween(*before)), F.lit(0))
    joined = left.withColumn("_row", upto(F.col("_ended").cast("int"), "engine"))
    hit = F.coalesce(upto(F.col("failures"), "engine", "_row") + F.col("_last") >= FAILURES, F.lit(False))
    found = joined.withColumn("_hit", hit).groupBy("engine", "_row").agg(
        (F.max(F.when(F.col("_hit"), F.col("_at"))) + PAUSE).alias("disabled_until"),
        F.sum("failures").alias("failures"),
        F.max("re_enabled_at").alias("re_enabled_at"),
        (~F.bool_or("_ended")).alias("temporarily_disabled"),
        F.bool_or("_hit").alias("_paused"),
    )
    return found.where("_paused").drop("_row", "_paused")


def pauses(calls: DataFrame) -> DataFrame:
    """Sources that a network error paused, and until when: the pauses of pause_log that no success has ended."""
    return pause_log(calls).where("temporarily_disabled").select("engine", "disabled_until")


def fold_totals(calls: DataFrame) -> DataFrame:
    """total, ok and failed of each source: sums, combined before the shuffle, where the whole state is not needed."""
    is_ = lambda o: F.count_if(F.col("outcome") == o).cast("bigint")
    return calls.groupBy("engine").agg((is_("success") + is_("failure")).alias("total"), is_("success").alias("ok"), is_("failure").alias("failed"))


# What errors say that may go away by themselves.
TRANSIENT = ("timeout", "network", "connection")


def may_retry(error: Column) -> Column:
    out = F.lit(False)
    for part in TRANSIENT:
        out = out | F.contains(error, F.lit(part))
    return out


def retry_delays(attempts: Column, first: float = 1.0) -> Column:
    """Seconds to wait before each attempt after the first: doubled every time."""
    return F.when(attempts > 1, F.transform(F.sequence(F.lit(0), attempts - 2), lambda n: first * F.pow(F.lit(2.0), n))).otherwise(F.array().cast("array<double>"))


def active(state: DataFrame, now: int) -> DataFrame:
    return state.where(F.col("disabled_until").isNull() | (F.col("disabled_until") <= now))


def counters(calls: DataFrame, cache: bool = False) -> DataFrame:
    """Searches, failures and empty answers; with ``cache`` also timeouts, apart from failures, and hits and misses of the cache.

    Nothing in a search raises the last two; they are there for those who read them.
    """
    n = lambda o: F.count_if(F.col("outcome") == o).cast("bigint")
    out = calls.agg(F.count("*").alias("total_searches"), n("failure").alias("failures"), n("zero").alias("zero_results"), n("timeout").alias("timeouts"))
    none = F.lit(0).cast("bigint")
    return out.withColumns({"cache_hits": none, "cache_misses": none}) if cache else out.drop("timeouts")
