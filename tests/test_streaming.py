from pyspark.sql import functions as F

from skein.operators import state
from skein.streaming import health


def test_stream_agrees_with_the_fold(spark, tmp_path):
    calls = [(f"e{i % 3}", i, i, ("success", "failure", "zero")[i % 7 % 3], i * 13 % 101) for i in range(60)]
    df = spark.createDataFrame(calls, "engine string, ts bigint, seq bigint, outcome string, response_ms bigint")
    df.repartitionByRange(1, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = health.engine_state(stream).writeStream.outputMode("update").format("memory").queryName("health").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("health").collect()}
    want = {tuple(r) for r in state.fold(df).select("engine", "total", "ok", "failed", "consecutive", "avg_ms", F.col("disabled_until")).collect()}
    assert got == want


def test_fold_of_a_source_with_most_calls(spark):
    """One source holds two thirds; batches, nulls and a source without a name; against a plain loop."""
    import random

    rng = random.Random(4)
    calls = [(None if i % 50 == 0 else "hot" if i % 3 else f"e{i % 7}", i // 2, i, rng.choice(("success", "failure", "zero")), rng.choice((None, 0, 17, 90))) for i in range(3000)]
    want = {}
    for engine, ts, _, outcome, ms in calls:
        total, ok, failed, row, mean, until = want.get(engine, (0, 0, 0, 0, 0, None))
        if outcome == "success":
            total, ok, row, until = total + 1, ok + 1, 0, None
            mean = (ms or 0) if total == 1 else (mean * (total - 1) + (ms or 0)) // total
        elif outcome == "failure":
            total, failed, row = total + 1, failed + 1, row + 1
        else:
            row += 1
            until = ts + 300 * 5 ** min(row - 1, 5)
        want[engine] = (total, ok, failed, row, mean, until)
    df = spark.createDataFrame(calls, "engine string, ts bigint, seq bigint, outcome string, response_ms bigint").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        whole = {r.engine: tuple(r)[1:] for r in state.fold(df).collect()}
        parts = None
        for low in range(0, 1500, 400):
            parts = spark.createDataFrame(state.fold(df.where(F.col("ts").between(low, low + 399)), parts).collect(), state.SCHEMA)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == want and {r.engine: tuple(r)[1:] for r in parts.collect()} == want


def test_a_success_ends_a_pause(spark):
    log = [("a", 1, "x 超时"), ("a", 2, "HTTP 错误"), ("a", 3, "status"), ("b", 1, "status"), ("b", 2, "status"), ("b", 3, "status"), ("c", 1, "status"), ("c", 2, "other"), ("c", 3, "status"), ("c", 4, "other"), ("d", 1, "status"), ("d", 2, "status")]
    rows = [(e, t, t, "failure", m) for e, t, m in log] + [("b", 4, 4, "success", None)]
    df = spark.createDataFrame(rows, "engine string, ts bigint, seq bigint, outcome string, error string")
    assert {tuple(r) for r in state.pauses(df).collect()} == {("a", 303), ("c", 303)}


def test_pauses_that_a_success_ended_are_kept(spark, monkeypatch):
    """Against a plain loop: a source with most calls, one without a name, calls without a time, and some at one time."""
    import random

    rng = random.Random(9)
    calls = [(None if i % 20 == 0 else "hot" if i % 3 else f"e{i % 7}", None if i >= 2980 else i // 2, i, rng.choice(("success", "failure", "failure", "zero")), rng.choice(("status 500", "parse", None))) for i in range(3000)]
    want, rows = [], {}

    def end(engine, at, still):
        row, until = rows.pop(engine, ([], None))
        if until is not None:
            want.append((engine, max((ts + 300 for ts in until if ts is not None), default=None), len(row), at, still))

    for engine, ts, _, outcome, error in calls:
        if outcome == "success":
            end(engine, ts, False)
            continue
        row, until = rows.get(engine, ([], None))
        row = [*row, ts]
        if outcome == "failure" and error == "status 500" and len(row) >= 3:
            until = [*(until or []), ts]
        rows[engine] = row, until
    for engine in list(rows):
        end(engine, None, True)
    df = spark.createDataFrame(calls, "engine string, ts bigint, seq bigint, outcome string, error string").repartition(7)
    for seconds in (1, 4, 50, state.SLICE):
        monkeypatch.setattr(state, "SLICE", seconds)
        got = [tuple(r) for r in state.pause_log(df).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[0] for r in got} > {None, "hot"}
    assert {r[4] for r in got} == {True, False}
    assert sorted(map(repr, map(tuple, state.pauses(df).collect()))) == sorted(repr(r[:2]) for r in want if r[4])


def test_query_keeps_pauses_that_a_success_ended(spark, tmp_path):
    from skein.plans import catalogue

    kinds = ("error", "view", "error", "click", "error", "error", "click", "error", "error", "view")
    log = spark.createDataFrame([(2 * i, i, 1, k, 1.0) for i, k in enumerate(kinds)], "event_id bigint, at bigint, user_id bigint, event_type string, value double")
    log.withColumn("ts", F.timestamp_seconds("at")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in catalogue.queries()["engine_network_pauses"](spark, str(tmp_path)).collect()}
    assert got == {("1", 302, 3, 3, False), ("1", 309, 3, None, True)}


def test_calls_before_1970_are_floored_to_seconds(spark, tmp_path):
    from skein.plans import tables

    at = spark.createDataFrame([(-1500,), (-1000,), (1500,), (None,)], "ms bigint")
    at.selectExpr("ms AS event_id", "timestamp_millis(ms) AS ts", "1L AS user_id", "'view' AS event_type", "1.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert {(r.seq, r.ts) for r in tables.calls(spark, str(tmp_path)).collect()} == {(-1500, -2), (-1000, -1), (1500, 1), (None, None)}
