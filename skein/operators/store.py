"""Stored entries under a log of operations: values as reads find them, access counts, and what is left.

ops: key, ts (epoch seconds), seq, op, value, ttl (seconds; null: none). put
replaces an entry and its counts; get finds a value that has not expired and
counts as an access; get_stale also finds an expired one, without counting;
delete removes the entry. Expired entries stay until they are replaced,
deleted or cleaned. Equal times go by seq. The same fold over a stream is in
streaming.store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(ops: DataFrame) -> DataFrame:
    """ops with _put (the last put that still stands: ts, seq, value, expires_at; null where there is none), hit, and the accesses since it."""
    at = F.struct("ts", "seq")
    upto = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = F.struct("ts", "seq", "value", (F.col("ts") + F.col("ttl")).alias("expires_at"), (F.col("op") == "put").alias("stands"))
    changed = F.last(F.when(F.col("op").isin("put", "delete"), put), ignorenulls=True).over(upto)
    seen = ops.withColumn("_put", changed).withColumn("_put", F.when(F.col("_put.stands"), F.col("_put").dropFields("stands")))
    fresh = F.col("_put").isNotNull() & (F.col("_put.expires_at").isNull() | (F.col("ts") < F.col("_put.expires_at")))
    seen = seen.withColumn("hit", F.when(F.col("op") == "get", fresh).when(F.col("op") == "get_stale", F.col("_put").isNotNull()))
    counted = F.when((F.col("op") == "get") & F.col("hit"), at)
    since = Window.partitionBy("key", "_put").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seen.withColumns({"access_count": F.count(counted).over(since), "last_access": F.max(counted["ts"]).over(since)})


def reads(ops: DataFrame) -> DataFrame:
    """key, ts, seq, op, value (null: a miss), is_stale and access_count (this read included) of each read."""
    r = replay(ops).where(F.col("op").isin("get", "get_stale"))
    stale = F.coalesce(F.col("ts") >= F.col("_put.expires_at"), F.lit(False))
    return r.select("key", "ts", "seq", "op", F.when(F.col("hit"), F.col("_put.value")).alias("value"), (F.col("hit") & stale).alias("is_stale"), F.when(F.col("hit"), F.col("access_count")).alias("access_count"))


def left(ops: DataFrame, now: int | None = None) -> DataFrame:
    """key, value, created_at, expires_at, access_count and last_access of the entries at the end; now: without those expired by then."""
    last = replay(ops).groupBy("key").agg(F.max_by(F.struct("_put", "access_count", "last_access"), F.struct("ts", "seq")).alias("s"))
    out = last.where("s._put is not null").select("key", "s._put.value", F.col("s._put.ts").alias("created_at"), "s._put.expires_at", "s.access_count", "s.last_access")
    return out if now is None else out.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def statistics(ops: DataFrame) -> DataFrame:
    """hits, misses, writes and deletes; get_stale counts in neither."""
    r = replay(ops)
    n = lambda c: F.count_if(c).cast("bigint")
    got = F.col("op") == "get"
    return r.agg(n(got & F.col("hit")).alias("hits"), n(got & ~F.col("hit")).alias("misses"), n(F.col("op") == "put").alias("writes"), n(F.col("op") == "delete").alias("deletes"))
