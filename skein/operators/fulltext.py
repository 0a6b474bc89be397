"""Full-text search over new, cached and feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scoring import keyword_rescore
from skein.operators import textindex
from skein.operators.dedup import by_lower_url
from skein.operators.filters import stored_matches

CACHED, FEEDS = 50, 30
FEED_SCORE = 0.7


def search(network: DataFrame, cached: DataFrame, feeds: DataFrame, query: str, now: int) -> DataFrame:
    """title, url, content and score of all three, first of equal URLs, rescored by keyword.

    network needs position and score; cached: key, pos, title, url, content,
    score; feeds: key, pos, title, link, description, content.
    """
    words = query.split()
    b = stored_matches(cached, words, ["title", "content", "url"], CACHED, now)
    c = stored_matches(feeds, words, ["title", "description", "content", "link"], FEEDS, now)
    return _rescored(network, b, c, query)


def search_indexed(network: DataFrame, cached: str, feeds: str, query: str) -> DataFrame:
    """As search, with stored entries found by the indexes (textindex) in two folders."""
    spark = network.sparkSession
    asked = spark.createDataFrame([(0, w) for w in query.split()], "query_id int, word string")
    b = textindex.search(spark, cached, asked, ["title", "content", "url"], CACHED)
    c = textindex.search(spark, feeds, asked, ["title", "description", "link"], FEEDS)
    return _rescored(network, b, c, query)


def _rescored(network: DataFrame, cached: DataFrame, feeds: DataFrame, query: str) -> DataFrame:
    a = network.select(F.lit(0).alias("engine_ord"), F.lit("").alias("key"), F.col("position").cast("bigint").alias("pos"), "title", "url", "content", "score")
    b = cached.select(F.lit(1).alias("engine_ord"), "key", F.col("pos").cast("bigint").alias("pos"), "title", "url", "content", "score")
    c = feeds.select(F.lit(2).alias("engine_ord"), "key", F.col("pos").cast("bigint").alias("pos"), "title", F.col("link").alias("url"), F.coalesce("description", F.lit("")).alias("content"), F.lit(FEED_SCORE).alias("score"))
    out = by_lower_url(a.unionByName(b).unionByName(c), ("engine_ord", "key", "pos"))
    return out.withColumn("score", keyword_rescore(F.col("score"), F.col("title"), F.col("content"), query)).orderBy(F.desc("score"), "engine_ord", "key", "pos")
