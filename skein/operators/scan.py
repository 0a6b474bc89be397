"""Numbers and running sums in a global order, and joins of many rows with one a key, where a key may hold any share of all rows.

Rows are put in order by ranges; only one row a range, whatever the input, comes to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most ranges, and so most rows on the driver.
MOST_RANGES = 1 << 16
#: A key with more than one in SHARE of all rows, and FEW at least, is joined by broadcast: there are fewer than SHARE such keys.
SHARE, FEW = 1000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may do without."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        folder = context.getCheckpointDir()
    return folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that a query writes and reads; it is removed when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def ranges(spark: SparkSession) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES))


def _ranged(df: DataFrame, by: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(ranges(df.sparkSession), *by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_row", 33).cast("int"))


def numbered(df: DataFrame, by: list[Column], name: str = "number") -> DataFrame:
    """Adds the number of each row, from 1, in the order of ``by``; rows equal in it are numbered as they come."""
    rows = checkpointed(_ranged(df, by))
    spark, before, sums = df.sparkSession, 0, []
    for r in sorted(rows.groupBy("_part").agg(F.min("_row").alias("first"), F.count("*").alias("n")).collect()):
        sums.append((r[0], before - r.first + 1))
        before += r.n
    base = spark.createDataFrame(sums, "_part int, _base bigint")
    return rows.join(F.broadcast(base), "_part").withColumn(name, F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")


def running(df: DataFrame, keys: list[str], by: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its column (long) over the rows of the same keys up to this one, in the order of ``by``.

    A key goes over as many ranges as it has rows for. Sums inside a range are
    windows; what a key has in earlier ranges is added from one row a range.
    Null keys count as equal. Rows equal in keys and order stand as they come.
    """
    spark = df.sparkSession
    placed = _ranged(df, [F.col(k).asc_nulls_first() for k in keys] + by)
    upto = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = checkpointed(placed.select("*", *[F.sum(c.cast("bigint")).over(upto).alias(k) for k, c in sums.items()]))
    edge = F.struct(*keys), F.struct(*keys, *sums)
    found = rows.groupBy("_part").agg(F.min_by(edge[0], "_row").alias("first"), F.max_by(edge[1], "_row").alias("last")).collect()
    carried, base = dict.fromkeys(sums, 0), []
    held: tuple | None = None
    for r in sorted(found, key=lambda r: r._part):
        first, last = tuple(r.first), tuple(r.last)[: len(keys)]
        if held != first:
            carried = dict.fromkeys(sums, 0)
        elif any(carried.values()):
            base.append((r._part, *first, *carried.values()))
        carried = {k: (carried[k] if first == last else 0) + (r.last[k] or 0) for k in sums}
        held = last
    if not base:
        return rows.drop("_part", "_row")
    kinds = dict(rows.dtypes)
    schema = ", ".join(["_scan_part int", *[f"_scan_key{i} {kinds[k]}" for i, k in enumerate(keys)], *[f"_scan_base{i} bigint" for i in range(len(sums))]])
    on = F.col("_part") == F.col("_scan_part")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_scan_key{i}"))
    joined = rows.join(F.broadcast(spark.createDataFrame(base, schema)), on, "left")
    more = {k: F.col(k) + F.coalesce(f"_scan_base{i}", F.lit(0)) for i, k in enumerate(sums)}
    return joined.select(*[more.get(c, F.col(c)).alias(c) for c in rows.columns if c not in ("_part", "_row")])


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], n: Column, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with ``unique``, which has each key once; n: how many of the rows have its key.

    The keys that more than one in SHARE of the rows have are fewer than SHARE:
    these are broadcast, so that their rows stay where they are. All others
    are joined as usual. Both inputs are read twice: cut their lineage before.
    """
    few = unique.withColumn("_n", n)
    total = few.agg(F.sum("_n")).first()[0] or 0
    hot = few.where(F.col("_n") > max(total // SHARE, FEW)).drop("_n")
    keys = hot.select(*on)
    found = keys.take(SHARE)
    if not found:
        return rows.join(unique, on, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame(found, keys.schema))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(unique, on, how), allowMissingColumns=False)
