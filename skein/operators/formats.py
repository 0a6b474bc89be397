"""Results as text, HTML, JSON and short tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_text(n: Column) -> Column:
    return F.format_string("%d. %s\n   %s\n   %s\n   Score: %.2f\n\n", n, F.col("title"), F.col("url"), F.col("content"), F.col("score"))


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def as_html() -> Column:
    shown = F.coalesce("display_url", "url")
    return F.format_string(
        '\n<div class="result-item">\n    <h3 class="title"><a href="%s">%s</a></h3>\n    <div class="url">%s</div>\n    <div class="content">%s</div>\n    <div class="meta">Score: %.2f</div>\n</div>',
        escaped(F.col("url")), escaped(F.col("title")), shown, escaped(F.col("content")), F.col("score"),
    )


def as_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def response_rows(items: DataFrame) -> DataFrame:
    """As an HTTP answer lists them: the merged source only."""
    return items.select("title", "url", F.col("content").alias("description"), F.lit("aggregated").alias("engine"), "score")


def sdk_rows(items: DataFrame) -> DataFrame:
    """What a client library returns of each item."""
    return items.select("title", "url", "content", "score")


def described(items: DataFrame, length: int = 200) -> DataFrame:
    """title, url, the beginning of the content as description, and score."""
    return items.select("title", "url", F.substring("content", 1, length).alias("description"), "score")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of whole characters within so many bytes, with dots where something is left out."""
    head = lambda n: F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(F.coalesce(*[head(most - k) for k in range(4)]), F.lit("..."))).otherwise(text)


def screen_rows(items: DataFrame, verbose: bool = False, order: tuple = ("position",), length: int = 200) -> DataFrame:
    """n, title, url and description (cut at so many bytes) of the first 20 items, or 50, and what else they have."""
    first = items.orderBy(*order).limit(50 if verbose else 20)
    return first.withColumns({"n": F.row_number().over(Window.orderBy(*order)), "description": cut_bytes(F.col("content"), length)})
