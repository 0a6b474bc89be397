"""Limits, pages and orders of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import scoring

MOST_ROWS = 100


def page_size(asked: Column, most: int = MOST_ROWS) -> Column:
    """Within 1 and most."""
    return F.least(F.greatest(asked, F.lit(1)), F.lit(most))


def page(items: DataFrame, number: int, size: int, order: tuple = ("position",)) -> DataFrame:
    """The rows of a page, from 1, in an order."""
    return items.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def by_several(items: DataFrame, query: str, now: Column, most: int, ties: tuple = ("position",)) -> DataFrame:
    """The first items by relevance, score and freshness (published) together."""
    relevance = scoring.relevance(F.col("title"), F.col("content"), F.col("url"), query)
    both = scoring.combined(relevance, F.col("score"), scoring.freshness(F.col("published"), now))
    return items.withColumn("combined", F.round(both, 9)).orderBy(F.desc("combined"), *ties).limit(most)


def by_relevance(items: DataFrame, query: str, ties: tuple = ("position",)) -> DataFrame:
    return items.withColumn("relevance", scoring.relevance(F.col("title"), F.col("content"), F.col("url"), query)).orderBy(F.desc("relevance"), *ties)
