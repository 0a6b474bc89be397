"""Stored entries: expiry, statistics, puts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR = 365 * 86400


def expired(expires_at: Column, now: int | Column) -> Column:
    return F.coalesce(F.lit(now) >= expires_at, F.lit(False)) if isinstance(now, int) else F.coalesce(now >= expires_at, F.lit(False))


def stale(created_at: Column, age: int, now: int) -> Column:
    return F.greatest(F.lit(now) - created_at, F.lit(0)) >= age


def needs_update(last_updated: Column, interval: Column, now: int) -> Column:
    """Never fetched: yes; without an interval: no."""
    return F.when(last_updated.isNull(), True).when(interval.isNull(), False).otherwise(F.greatest(F.lit(now) - last_updated, F.lit(0)) >= interval)


def dns_expired(age: Column, ttl: int) -> Column:
    return age > ttl


def get(entries: DataFrame, key: str, now: int, include_stale: bool = False) -> DataFrame:
    found = entries.where(F.col("key") == key).withColumn("is_stale", expired(F.col("expires_at"), now))
    return found if include_stale else found.where(~F.col("is_stale"))


class CacheFull(ValueError):
    """More entries than a store may hold, expired ones not counted."""


def put(entries: DataFrame, new: DataFrame, capacity: int | None = None, now: int | None = None) -> DataFrame:
    """new in place of the entries of its keys; over capacity expired entries go first, and CacheFull is raised if that is not enough."""
    others = entries.join(new.select("key"), "key", "left_anti")
    if capacity is None:
        return others.unionByName(new)
    # One look at what stays, one at what comes.
    n = others.agg(F.count("*").alias("all"), F.count_if(~expired(F.col("expires_at"), now or 0)).alias("live")).first()
    room = capacity - new.count()
    if n.live > room:
        raise CacheFull(f"more than {capacity} entries")
    return (others if n["all"] <= room else cleaned(others, now or 0)).unionByName(new)


def clear(entries: DataFrame) -> DataFrame:
    return entries.limit(0)


def put_metadata(entries: DataFrame, new: DataFrame, kind: str, now: int, ttl: int = YEAR) -> DataFrame:
    """Entries (key, value, expires_at) with those of new (name, value) under the prefix of the kind, for a year unless told."""
    named = new.select(F.concat(F.lit(f"{kind}:"), "name").alias("key"), "value", F.lit(now + ttl).cast("bigint").alias("expires_at"))
    return put(entries, named)


def get_metadata(entries: DataFrame, kind: str, now: int) -> DataFrame:
    """name and value of the unexpired entries of a kind."""
    prefix = f"{kind}:"
    own = entries.where(F.startswith("key", F.lit(prefix)) & ~expired(F.col("expires_at"), now))
    return own.select(F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key")).alias("name"), "value")


def delete_metadata(entries: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    return delete(entries, names.select(F.concat(F.lit(f"{kind}:"), "name").alias("key")))


def pool_stats(names: DataFrame, ttl: int) -> DataFrame:
    """Total, expired and active rows of resolved names (age, in seconds)."""
    old = dns_expired(F.col("age"), ttl)
    return names.agg(F.count("*").alias("total"), F.count_if(old).cast("bigint").alias("expired"), F.count_if(~old).cast("bigint").alias("active"))


def connection_hit_rate(log: DataFrame) -> DataFrame:
    """Share of requests (reused) that met an open connection."""
    return log.agg(F.count("*").alias("requests"), hit_rate(F.count_if("reused"), F.count_if(~F.col("reused"))).alias("hit_rate"))


def item_totals(batches: DataFrame) -> DataFrame:
    """Batches and items of each query, and the longest batch; batches: query_id, items."""
    return batches.groupBy("query_id").agg(F.count("*").alias("batches"), F.sum(F.size("items")).cast("bigint").alias("total"), F.max(F.size("items")).alias("longest"))


def delete(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def cleaned(entries: DataFrame, now: int) -> DataFrame:
    return entries.where(~expired(F.col("expires_at"), now))


def of_kind(entries: DataFrame, kind: str) -> DataFrame:
    """Entries of a prefix; a table partitioned by kind is pruned to it."""
    return entries.where(F.col("kind") == kind)


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def stats(log: DataFrame) -> DataFrame:
    """Counts of an access log with an outcome column."""
    is_ = lambda o: F.count_if(F.col("outcome") == o).cast("bigint")
    out = log.agg(is_("hit").alias("hits"), is_("miss").alias("misses"), is_("write").alias("writes"), is_("delete").alias("deletes"))
    return out.withColumn("hit_rate", hit_rate(F.col("hits"), F.col("misses")))


def cache_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


def with_feed_meta(feeds: DataFrame, meta: DataFrame) -> DataFrame:
    return feeds.join(meta, "feed_url", "left")
