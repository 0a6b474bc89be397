"""Stored feeds in two tables of files, refreshed in place.

``items``: feed_url, place and the columns of a feed's items; ``meta``: a row a
feed: name, last_updated, persistent, update_interval, item_count and
expires_at. Both are laid out by kind and by bucket of the feed's address. A
refresh takes the answers of any number of feeds; those that are due and have
an answer are merged, and only the files of their buckets are written anew.

A feed is due if it was never fetched, or its interval is over; one without an
interval (a temporary one) is fetched once. The new items come first, each
guid, or else link, once, then stored ones that are not among them, unless the
feed has expired. The merged feed expires TTL seconds after the refresh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.cache import needs_update
from skein.operators.scan import checkpointed
from skein.sources import feeds

# Fixed value: seconds until a stored feed expires.
TTL = 3600
BUCKETS = 64
ITEM = "feed_url string, place bigint, title string, link string, description string, author string, pub_date string, guid string, content string"
META = "feed_url string, name string, last_updated bigint, persistent boolean, update_interval bigint, item_count bigint, expires_at bigint"
_BY = "kind string, bucket int"


class FeedStore:
    """Stored feeds in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        whole = f"{schema}, {_BY}"
        return self.spark.read.schema(whole).parquet(f"{self.folder}/{table}") if there else self.spark.createDataFrame([], whole)

    def items(self) -> DataFrame:
        return self._read("items", ITEM)

    def meta(self) -> DataFrame:
        return self._read("meta", META)

    def due(self, asked: DataFrame, now: int) -> DataFrame:
        """asked (feed_url and what else it has) that need an update, with the expiry of what is stored of them."""
        known = self.meta().select("feed_url", "last_updated", F.col("update_interval").alias("_every"), F.col("expires_at").alias("_expires"))
        return asked.join(known, "feed_url", "left").where(needs_update(F.col("last_updated"), F.col("_every"), now)).drop("last_updated", "_every")

    def refresh(self, answers: DataFrame, now: int) -> int:
        """Merges what is due into the store; answers: feed_url, body (null: failed), persistent, update_interval. How many feeds were due and answered."""
        columns = [c.split()[0] for c in ITEM.split(", ")]
        due = self.due(answers.dropDuplicates(["feed_url"]).where(feeds.kind(F.col("body")).isNotNull()), now)
        bucket = F.pmod(F.xxhash64("feed_url"), F.lit(BUCKETS)).cast("int")
        due = checkpointed(due.withColumns({"kind": F.when(F.col("persistent"), "persistent").otherwise("temporary"), "bucket": bucket}))
        new = feeds.items(due.select("feed_url", "body")).join(due.select("feed_url", "kind", "bucket"), "feed_url")
        live = due.where(F.col("_expires").isNull() | (F.col("_expires") > now)).select("feed_url", F.col("kind").alias("_kind"))
        stored = self.items()
        old = stored.join(live, "feed_url").withColumn("kind", F.col("_kind")).drop("_kind")
        both = new.select(*columns[:1], F.col("pos").cast("bigint").alias("place"), *columns[2:], "kind", "bucket", F.lit(0).alias("_gen")).unionByName(old.withColumn("_gen", F.lit(1)))
        key = F.coalesce("guid", "link")
        once = both.withColumn("_n", F.row_number().over(Window.partitionBy("feed_url", key).orderBy("_gen", "place"))).where("_n = 1")
        placed = once.withColumn("place", F.row_number().over(Window.partitionBy("feed_url").orderBy("_gen", "place")).cast("bigint") - 1).drop("_gen", "_n")
        merged = checkpointed(placed)
        name = feeds.channels(due.select("feed_url", "body")).select("feed_url", F.col("title").alias("name"))
        count = merged.groupBy("feed_url").agg(F.count("*").alias("item_count"))
        fresh = due.join(name, "feed_url", "left").join(count, "feed_url", "left").select(
            "feed_url", "name", F.lit(now).cast("bigint").alias("last_updated"), "persistent", F.col("update_interval").cast("bigint").alias("update_interval"), F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"), F.lit(now + TTL).cast("bigint").alias("expires_at"), "kind", "bucket"
        )
        self._replace("items", stored, merged, due)
        self._replace("meta", self.meta(), fresh, due)
        return due.count()

    def _replace(self, table: str, stored: DataFrame, new: DataFrame, due: DataFrame) -> None:
        """Writes the buckets of ``due`` anew: what is stored there of other feeds, and ``new``.

        What is written is cut from the files that it replaces, so that a task may be run again.
        """
        touched = F.broadcast(due.select("bucket").distinct())  # BUCKETS at most
        others = stored.join(touched, "bucket").join(due.select("feed_url"), "feed_url", "left_anti")
        whole = checkpointed(others.unionByName(new))
        # A feed may have changed its kind: the folders of both kinds are written, one of them perhaps empty.
        kinds = ["persistent", "temporary"]
        path = f"{self.folder}/{table}"
        whole.repartition("kind", "bucket").write.partitionBy("kind", "bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        left = {tuple(r) for r in whole.select("kind", "bucket").distinct().collect()}
        jvm = self.spark._jvm.org.apache.hadoop.fs
        for b in (r.bucket for r in due.select("bucket").distinct().collect()):
            for k in kinds:
                if (k, b) not in left:
                    at = jvm.Path(f"{path}/kind={k}/bucket={b}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def add_template(self, templates: DataFrame, answers: DataFrame, now: int, categories: list[str] | None = None) -> int:
        """Fetches all feeds of templates in one pass; the number of feeds told, also of those that failed or were not due.

        answers: feed_url and body.
        """
        asked = checkpointed(feeds.template_feeds(templates, categories).select("feed_url", F.lit(True).alias("persistent"), "update_interval").join(answers, "feed_url", "left"))
        self.refresh(asked, now)
        return asked.count()
