"""Standardising, scoring and merging items of many sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scoring
from skein.functions.text import SPACE, clean_text, tokenize
from skein.operators.dedup import by_raw_url, by_url, round_robin
from skein.operators.scan import checkpointed, join_unique, numbered, running


def standardize(items: DataFrame) -> DataFrame:
    """Clean titles (200 bytes) and contents (500); a blank URL becomes #."""
    url = F.when(F.regexp_replace("url", SPACE, "") == "", "#").otherwise(F.col("url"))
    return items.withColumns({"title": clean_text(F.col("title"), 200), "content": clean_text(F.col("content"), 500), "url": url})


def standardize_results(items: DataFrame) -> DataFrame:
    return by_url(standardize(items), within=("engine_ord",))


def enumerate_items(items: DataFrame) -> DataFrame:
    """position: the place, from 0, in the order of sources and places; numbered over ranges, no task holds a source."""
    return numbered(items, [F.asc("engine_ord"), F.asc("pos")], "position").withColumn("position", F.col("position") - 1)


def score_results(items: DataFrame, query: str, engine: str | None = scoring.MERGED) -> DataFrame:
    """Scores of items that have a position; engine None scores each row's own source."""
    tokens = scoring.words(query)
    df = items.withColumns({"_t": tokenize(F.col("title")), "_c": tokenize(F.col("content"))})
    means = df.agg(F.avg(F.size("_t")).alias("_tm"), F.avg(F.size("_c")).alias("_cm"))
    df = df.join(F.broadcast(means))  # one row
    col = F.col
    score = scoring.total(col("title"), col("_t"), col("_tm"), col("content"), col("_c"), col("_cm"), col("url"), col("position"), F.lit(engine) if engine else col("engine_name"), query, tokens)
    return df.withColumn("score", score).drop("_t", "_c", "_tm", "_cm")


def aggregate_with_scoring(items: DataFrame, query: str) -> DataFrame:
    """Standardised, without repeated URLs in and across sources, scored; sort by rank_order().

    Texts are cut before the one shuffle by URL (the first item of a URL in
    order is also the first of its source), so that no whole text is shuffled.
    """
    return score_results(enumerate_items(by_url(standardize(items))), query)


def aggregate_queries(items: DataFrame, queries: DataFrame) -> DataFrame:
    """As aggregate_with_scoring, for many queries at once; items have a query_id, queries: query_id, query.

    Items whose query isn't among ``queries`` are left out. URLs, positions and means are those of a query.
    """
    once = by_url(standardize(items), within=("query_id",))
    placed = running(once, ["query_id"], [F.asc("engine_ord"), F.asc("pos")], {"position": F.lit(1)})
    placed = placed.withColumn("position", F.col("position") - 1)
    sizes = placed.select("query_id", F.size(tokenize(F.col("title"))).alias("t"), F.size(tokenize(F.col("content"))).alias("c"))
    means = sizes.groupBy("query_id").agg(F.avg("t").alias("_tm"), F.avg("c").alias("_cm"), F.count("*").alias("_rows"))
    told = queries.select("query_id", F.lower("query").alias("_query"), tokenize(F.col("query")).alias("_words")).dropDuplicates(["query_id"])
    df = join_unique(placed, checkpointed(means.join(told, "query_id")), ["query_id"], F.col("_rows"))
    df = df.withColumns({"_t": tokenize(F.col("title")), "_c": tokenize(F.col("content"))})
    col = F.col
    score = scoring.total(col("title"), col("_t"), col("_tm"), col("content"), col("_c"), col("_cm"), col("url"), col("position"), F.lit(scoring.MERGED), col("_query"), col("_words"))
    return df.withColumn("score", score).drop("_t", "_c", "_tm", "_cm", "_query", "_words", "_rows")


def best_of_queries(scored: DataFrame, most: int) -> DataFrame:
    """The first items of each query, by score, then position; cut in every task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ranked(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("score"), "position")


def merged(items: DataFrame, strategy: str = "merged", sort_by: str | None = None) -> DataFrame:
    """merged and ranked: by score; round_robin; custom: as they come. sort_by source: by URL; others change nothing."""
    if strategy == "round_robin":
        return round_robin(items)
    out = by_raw_url(items)
    if sort_by == "source":
        return out.orderBy("url", "engine_ord", "pos")
    return out.orderBy("engine_ord", "pos") if strategy == "custom" else out.orderBy(F.desc("score"), "engine_ord", "pos")
