"""First row of each key, in an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import normalize_url, url_key

ORDER = ("engine_ord", "pos")


def first_by(df: DataFrame, key: Column, order: Sequence[str | Column], within: Sequence[str] = ()) -> DataFrame:
    """Rows that come first among those of equal key; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*within, "_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def by_url(df: DataFrame, order: Sequence[str | Column] = ORDER, within: Sequence[str] = ()) -> DataFrame:
    return first_by(df, url_key(F.col("url")), order, within)


def by_lower_url(df: DataFrame, order: Sequence[str | Column] = ORDER) -> DataFrame:
    return first_by(df, F.lower("url"), order)


def by_raw_url(df: DataFrame, order: Sequence[str | Column] = ORDER) -> DataFrame:
    return first_by(df, F.col("url"), order)


def by_normalized_url(df: DataFrame, order: Sequence[str | Column] = ORDER) -> DataFrame:
    return first_by(df, normalize_url(F.col("url")), order)


def round_robin(df: DataFrame) -> DataFrame:
    """The first item of each source, then the second of each; first of equal URLs in that order."""
    return by_raw_url(df, ("pos", "engine_ord")).orderBy("pos", "engine_ord")


def merge_feed(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """New items, then old ones not among them (by guid, else link) that have not expired."""
    key = F.coalesce("guid", "link")
    both = new.withColumn("gen", F.lit(0)).unionByName(old.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).withColumn("gen", F.lit(1)))
    return first_by(both, F.struct(F.col("feed_url"), key), ("gen", "pos"))
