"""Shared plumbing: table access, lineage cuts, Arrow batches, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the fixed-size membership filter; its broadcast table has at most
#: FILTER_WORDS rows whatever the input.
FILTER_WORDS = 1 << 16

#: Texts are handled in slices of about this many bytes, so that the work
#: arrays of a task stay small.
SLICE_BYTES = 1 << 19

_forget: list[Callable[[], None]] = []
_work: list[str | None] = [None]


def forgets(drop: Callable[[], None]) -> Callable[[], None]:
    """Registers what empties a module's tables in a Python worker."""
    _forget.append(drop)
    return drop


def begin(work: str) -> None:
    """Called first in a task. A worker lives on from stage to stage: what it kept for other work goes back to the system."""
    if _work[0] != work:
        for drop in _forget:
            drop()
        _work[0] = work
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and written tables.

    ``spark.checkpoint.dir`` names it. Where that is unset a local session uses
    a temporary folder; on a cluster it is an error, as executors would not see it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
        folder = context.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sweep(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect its garbage, as spark.cleaner.periodicGC.interval does.

    Shuffle files of steps that are done are removed when nothing refers to
    them any more, and a driver that has little to do may not look for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def snug(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """As cut, in as many partitions as its rows need: each task that shuffles it writes files, however few its rows."""
    df = cut(df)
    return df.coalesce(max(1, df.count() // rows + 1))


def string_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def membership(keys: DataFrame, key: str) -> DataFrame:
    """A filter of at most FILTER_WORDS rows (word, bits) over a column of longs.

    Its size is fixed, so that it may be broadcast at any scale; when it is
    full it lets more rows through, and an exact join has to follow.
    """
    h = F.xxhash64(F.lit("member"), F.col(key))
    return (
        keys.select(F.pmod(h, F.lit(FILTER_WORDS)).alias("_word"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int").alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))).alias("_bits"))
    )


def possibly_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose key may be among those of ``membership``; none is missed."""
    h = F.xxhash64(F.lit("member"), F.col(key))
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    hit = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return df.join(F.broadcast(bits), word == F.col("_word")).where(hit).drop("_word", "_bits")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for the nodes of the edges; component: smallest node.

    Alternating large-star and small-star steps: every step is a minimum per
    node (combined before the shuffle) and a join back, so that no
    neighbourhood is ever gathered in a task. The number of rounds grows with
    the logarithm of the longest path. Edges that snug leaves in one partition
    need no exchange: a round of these is one task, whatever the shuffle partitions.
    """
    e = snug(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first())

    before = mark(e)
    while before[0]:
        # Edges of one partition stay there: told so after each join, Spark plans no exchange.
        alone = e.rdd.getNumPartitions() == 1
        stay = (lambda x: x.coalesce(1)) if alone else (lambda x: x)
        # All edges lead down (u > v): a node's least neighbour is among those it leads to, or it is least itself.
        low = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = stay(e.join(low, "v", "left")).select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        others = stay(large.join(least, "u")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stay(others.unionByName(least.withColumnRenamed("m", "v"))).distinct()
        e = snug(small)
        after = mark(e)
        if after == before:
            break
        before = after
    labels = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
