"""Tolerant scans of RSS and Atom texts, from SQL functions alone."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.cache import needs_update
from skein.operators.dedup import merge_feed

#: Fields of an item, and the tags they come from.
RSS_TAGS = {"title": "title", "link": "link", "description": "description", "author": "author", "pub_date": "pubDate", "guid": "guid"}


def kind(body: Column) -> Column:
    return F.when(F.contains(body, F.lit("<rss")), "rss").when(F.contains(body, F.lit("<feed")), "atom")


def tag(text: Column, name: str) -> Column:
    """What the first such tag holds, without CDATA marks; null if there is none."""
    raw = F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1)
    clean = F.replace(F.replace(raw, F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    return F.when(text.rlike(rf"(?s)<{name}>.*?</{name}>"), F.regexp_replace(clean, r"^\s+|\s+$", ""))


def rss_items(feeds: DataFrame) -> DataFrame:
    """feed_url, pos and fields of the items; feeds: feed_url, body."""
    items = feeds.where(kind(F.col("body")) == "rss").select("feed_url", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("pos", "item"))
    return items.select("feed_url", "pos", *[tag(F.col("item"), t).alias(f) for f, t in RSS_TAGS.items()])


def channels(feeds: DataFrame) -> DataFrame:
    """feed_url, title, link, description and language of RSS channels, and title and link of Atom feeds."""
    channel = F.regexp_extract("body", r"(?s)<channel>(.*?)</channel>", 1)
    rss = feeds.where(kind(F.col("body")) == "rss").select("feed_url", *[tag(channel, t).alias(t) for t in ("title", "link", "description", "language")])
    outside = F.split(F.regexp_replace("body", r"(?sm)^\s*<entry[ >].*?^\s*</entry>", ""), "\n")
    lines = F.transform(outside, lambda x: F.trim(x))
    none = F.lit(None).cast("string")
    atom = feeds.where(kind(F.col("body")) == "atom").select("feed_url", _of_line(lines, "title", False).alias("title"), _href(lines, ("title",), False).alias("link"), none.alias("description"), none.alias("language"))
    every = rss.unionByName(atom)
    return every.withColumns({"title": F.coalesce("title", F.lit("")), "link": F.coalesce("link", F.lit(""))})


def _closed(line: Column, name: str) -> Column:
    return F.contains(line, F.lit(f"<{name}>")) & F.contains(line, F.lit(f"</{name}>"))


def _pick(found: Column, last: bool) -> Column:
    return F.try_element_at(found, F.lit(-1 if last else 1))


def _of_line(lines: Column, name: str, last: bool = True, before: tuple[str, ...] = ()) -> Column:
    """What the last (first) line holds that opens and closes the tag, and none of those before it."""
    def own(line: Column) -> Column:
        hit = _closed(line, name)
        for other in before:
            hit = hit & ~_closed(line, other)
        return hit

    line = _pick(F.filter(lines, own), last)
    return F.substring_index(F.regexp_extract(line, f"(?s)<{name}>(.*)", 1), f"</{name}>", 1)


def _href(lines: Column, before: tuple[str, ...], last: bool = True) -> Column:
    def own(line: Column) -> Column:
        hit = F.contains(line, F.lit("<link")) & F.contains(line, F.lit("href="))
        for other in before:
            hit = hit & ~_closed(line, other)
        return hit

    return F.regexp_extract(_pick(F.filter(lines, own), last), 'href="([^"]*)"', 1)


#: Tags of an Atom entry; of those in one line the first counts.
ATOM_TAGS = ("title", "id", "updated", "content")


def atom_items(feeds: DataFrame) -> DataFrame:
    """As rss_items. Line by line: an entry's marks begin lines, a field opens and closes in one line, its last line counts."""
    entry = F.regexp_extract_all("body", F.lit(r"(?sm)^\s*<entry[ >][^\n]*\n(.*?)^\s*</entry>"), F.lit(1))
    rows = feeds.where(kind(F.col("body")) == "atom").select("feed_url", F.posexplode(entry).alias("pos", "item"))
    lines, none = F.transform(F.split("item", "\n"), lambda x: F.trim(x)), F.lit(None).cast("string")
    of = {t: _of_line(lines, t, before=ATOM_TAGS[:i]) for i, t in enumerate(ATOM_TAGS)}
    return rows.select(
        "feed_url", "pos", F.coalesce(of["title"], F.lit("")).alias("title"), F.coalesce(_href(lines, ATOM_TAGS), F.lit("")).alias("link"), none.alias("description"), none.alias("author"),
        of["updated"].alias("pub_date"), of["id"].alias("guid"), of["content"].alias("content"),
    )


def items(feeds: DataFrame, unknown: str = "drop") -> DataFrame:
    """Items of RSS and Atom bodies; a body of neither format is dropped, or, with unknown="error", an error."""
    if unknown == "error":
        body = F.when(kind(F.col("body")).isNull(), F.raise_error(F.lit("unknown feed format")).cast("string")).otherwise(F.col("body"))
        feeds = feeds.withColumn("body", body)
    return rss_items(feeds).withColumn("content", F.lit(None).cast("string")).unionByName(atom_items(feeds))


TEMPLATE = "file string, name string, description string, language string, provider string, version string, persistent boolean, auto_update boolean, update_interval bigint, urls map<string,string>"


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """A row of TEMPLATE for each ``*.rss.see`` file; a file without name, description or feeds is an error."""
    rows = []
    for p in sorted(Path(folder).glob("*.rss.see")):
        t = tomllib.loads(p.read_text(encoding="utf-8"))
        meta = t["meta"]
        flags = (meta.get("persistent", True), meta.get("auto_update", True), meta.get("update_interval", 3600))
        rows.append((p.name.removesuffix(".rss.see"), meta["name"], meta["description"], *(meta.get(k) for k in ("language", "provider", "version")), *flags, dict(t["feeds"])))
    return spark.createDataFrame(rows, TEMPLATE)


def template_feeds(templates_: DataFrame, categories: list[str] | None = None) -> DataFrame:
    out = templates_.select("name", "persistent", "update_interval", F.explode("urls").alias("category", "feed_url"))
    return out.where(F.col("category").isin(categories)) if categories is not None else out


def refreshed(stored: DataFrame, meta: DataFrame, answers: DataFrame, now: int) -> DataFrame:
    """Stored items after a refresh: feeds that are due and have an answer are parsed and merged, all others stay.

    stored: items with expires_at; meta: feed_url, last_updated, update_interval;
    answers: feed_url, body. Merged: new items, then unexpired old ones not among them.
    """
    known = answers.join(meta, "feed_url", "left")
    due = known.where(needs_update(F.col("last_updated"), F.col("update_interval"), now))
    expires = due.select("feed_url", (F.lit(now) + F.coalesce("update_interval", F.lit(3600))).cast("bigint").alias("expires_at"))
    columns = ["feed_url", "pos", "title", "link", "description", "guid", "expires_at"]
    new = items(due.select("feed_url", "body")).join(expires, "feed_url").select(*columns)
    names = due.select("feed_url").distinct()
    old = stored.select(*columns)
    merged = merge_feed(new, old.join(names, "feed_url", "left_semi"), F.lit(now))
    return merged.select(*columns, "gen").unionByName(old.join(names, "feed_url", "left_anti").withColumn("gen", F.lit(1)))


def template_answers(templates_: DataFrame, answers: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Feeds of templates with their answers, body null where none came; a failed feed counts like any other."""
    return template_feeds(templates_, categories).join(answers, "feed_url", "left")
