"""Predicates over items and searches over stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of navigation, and bounds of titles.
NAVIGATION = ("首页", "登录", "注册", "更多", "返回", "下一页", "上一页")
TITLE_LENGTHS = (10, 200)


def holds_any(columns: list[str], words: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        for w in words:
            out = out | F.coalesce(F.contains(F.lower(c), F.lit(w.lower())), F.lit(False))
    return out


def min_score(items: DataFrame, least: float) -> DataFrame:
    return items.where(F.col("score") >= least)


def blocked(items: DataFrame, domains: list[str]) -> DataFrame:
    """Items of whose URL and display URL none holds a blocked domain."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.contains("url", F.lit(d)) | F.coalesce(F.contains("display_url", F.lit(d)), F.lit(False))
    return items.where(~hit)


def valid_result(title: Column, url: Column, host: str = "news.cn") -> Column:
    out = F.length(title).between(*TITLE_LENGTHS) & F.contains(url, F.lit(host))
    for w in NAVIGATION:
        out = out & ~F.contains(title, F.lit(w))
    return out


def has_link(title: Column, url: Column) -> Column:
    return (title != "") & F.startswith(url, F.lit("http"))


def is_blocked_page(body: Column) -> Column:
    """A page, or a request for a captcha, instead of a JSON answer."""
    # How such answers begin, and what they hold.
    start = F.regexp_replace(body, r"^\s+", "")
    return F.coalesce(
        F.startswith(start, F.lit("<")) | F.startswith(start, F.lit("Found")) | F.contains(body, F.lit("wappass.baidu.com")) | F.contains(body, F.lit("captcha")) | F.contains(F.lower(body), F.lit("please verify")),
        F.lit(False),
    )


def stored_matches(entries: DataFrame, words: list[str], columns: list[str], most: int, now: int, stale: bool = True) -> DataFrame:
    """The first rows, by key and place, that hold any of the words."""
    fresh = entries if stale else entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return fresh.where(holds_any(columns, words)).orderBy("key", "pos").limit(most)


def batches_with(items: DataFrame, phrase: str, batch: str = "query_id") -> DataFrame:
    """All items of batches of which one item's title or content holds the phrase."""
    hit = items.where(holds_any(["title", "content"], [phrase])).select(batch).distinct()
    return items.join(hit, batch, "left_semi")


def available(names: DataFrame, allowed: list[str], disabled: DataFrame) -> DataFrame:
    """Names in the allow-list that are not disabled now."""
    return names.where(F.col("engine").isin(allowed)).join(disabled, "engine", "left_anti")
