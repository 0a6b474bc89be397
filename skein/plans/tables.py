"""The test tables in the roles of the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as items: a source is an engine, a document's id its place."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", F.col("source").alias("engine_name"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("engine_ord"), F.col("doc_id").alias("pos"),
        F.substring_index("text", "\n", 1).alias("title"), url.alias("url"), F.col("text").alias("content"), F.lit(1.0).alias("score"),
    )


def with_copies(df: DataFrame) -> DataFrame:
    """items, and every seventh again under another source in capitals and blanks."""
    again = df.where(F.col("doc_id") % 7 == 0).withColumns({"engine_ord": F.col("engine_ord") + 100, "url": F.concat(F.lit(" "), F.upper("url"))})
    return df.unionByName(again)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "zero").otherwise("success")
    return e.select(F.col("user_id").cast("string").alias("engine"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("ts"), F.col("event_id").alias("seq"), outcome.alias("outcome"), F.floor(F.col("value") * 100).alias("response_ms"))


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    link = F.concat(F.lit("https://feed.example/"), F.substring_index("text", " ", 2))
    return c.select(F.col("conv_id").cast("string").alias("feed_url"), F.col("turn").cast("bigint").alias("pos"), F.col("role").alias("title"), link.alias("link"), F.col("text").alias("description"), F.concat_ws("-", "conv_id", "turn").alias("guid"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as cached entries that expire at 1000 + 37 doc_id seconds."""
    return items(spark, sf_dir).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), F.lit(0).cast("bigint").alias("pos"), "doc_id", "title", "url", "content", "score", (F.col("doc_id") * 37 + 1000).alias("expires_at"), (F.col("doc_id") * 37).alias("created_at"))
