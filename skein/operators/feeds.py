"""Limits, filters and rankings of feed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scoring import feed_score
from skein.operators.dedup import first_by
from skein.operators.filters import holds_any


def fetched(items: DataFrame, most: int = 10, words: list[str] | None = None) -> DataFrame:
    """The first items of each feed, and of these the ones with a keyword."""
    out = items.where(F.col("pos") < most)
    return out.where(holds_any(["title", "description"], words)) if words else out


def rank(items: DataFrame, keywords: list[tuple[str, float, bool]], least: float = 0.0, most: int = 100, distinct_links: bool = True) -> DataFrame:
    """Scored items in order; of equal links the one of the highest score."""
    score, matched = feed_score(F.col("title"), F.col("description"), keywords)
    out = items.withColumns({"score": score, "matched_keywords": matched}).where(F.col("score") >= least)
    order = (F.desc("score"), "feed_url", "pos")
    if distinct_links:
        out = first_by(out, F.col("link"), order)
    return out.orderBy(*order).limit(most)
