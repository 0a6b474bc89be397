import random

from pyspark.sql import functions as F

from skein.operators import store
from skein.streaming import store as streamed

rng = random.Random(6)
SCHEMA = "key string, ts bigint, seq bigint, op string, value string, ttl bigint"


def log(n):
    """One key has a third of all operations."""
    kinds = ("put", "get", "get", "get", "get_stale", "delete")
    return [("hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}", i * 10 + rng.randrange(10), i, kind, f"v{i}" if kind == "put" else None, rng.choice((None, 50, 300, 1000)) if kind == "put" else None) for i, kind in enumerate(rng.choices(kinds, k=n))]


def plain(rows):
    held, found = {}, {}
    for key, ts, seq, op, value, ttl in sorted(rows, key=lambda r: (r[1], r[2])):
        e = held.get(key)
        if op == "put":
            held[key] = [value, ts, None if ttl is None else ts + ttl, 0, None]
        elif op == "delete":
            held.pop(key, None)
        else:
            stale = e is not None and e[2] is not None and ts >= e[2]
            hit = e is not None and (op == "get_stale" or not stale)
            if hit and op == "get":
                e[3], e[4] = e[3] + 1, ts
            found[seq] = (e[0], stale, e[3]) if hit else (None, False, None)
    return {k: tuple(v) for k, v in held.items()}, found


def test_reads_and_what_is_left(spark):
    rows = log(900)
    held, found = plain(rows)
    ops = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert {r.seq: (r.value, r.is_stale, r.access_count) for r in store.reads(ops).collect()} == found
    assert {r.key: tuple(r)[1:] for r in store.left(ops).collect()} == held
    now = 8000
    assert {r.key for r in store.left(ops, now).collect()} == {k for k, e in held.items() if e[2] is None or e[2] > now}
    s = store.statistics(ops).first()
    assert s.hits == sum(r[3] == "get" and found[r[2]][0] is not None for r in rows) and s.hits + s.misses == sum(r[3] == "get" for r in rows)


def test_stream_keeps_the_same_entries_and_drops_expired_ones(spark, tmp_path):
    rows = log(400)
    held, _ = plain(rows)
    last = max(r[1] for r in rows)
    rows += [("tick", last + 100_000 + i, 10**6 + i, "put", "x", None) for i in range(2)]
    for n, at in enumerate(range(0, 402, 67)):
        spark.createDataFrame(rows[at : at + 67], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert n < 6
    spark.conf.set(*streamed.PROVIDER)
    try:
        ops = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("ts"))
        got = []
        q = streamed.entries(ops, late="1 minute", grace=30).writeStream.outputMode("update").foreachBatch(lambda df, i: got.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(streamed.PROVIDER[0])
    latest = {r[0]: r[1:] for batch in got for r in batch if r[0] != "tick"}
    assert {k for k, v in latest.items() if not v[-1]} == {k for k, e in held.items() if e[2] is None}  # all others have expired by now
    assert {k: v[:-1] for k, v in latest.items() if k in held} == held
