"""A stored trigram index of entries, for searches of substrings without a scan of all entries.

Two tables of Parquet files in one folder. ``entries``: the rows with an id that
numbers them in the order of key and place. ``postings``: for each trigram and
block of BLOCK ids, a bit for each id that holds it in one of the indexed columns, in
folders by hash of the trigram, sorted. Trigrams are of UTF-8 bytes: a text holds a word
where its bytes hold the word's. A search reads the folders of its own
trigrams, meets the bits of a word's trigrams block by block, and looks at the
texts of the ids left only, each text once for all its words. A trigram that
every entry holds is spread over as many rows as there are blocks.

Where the first entries are asked for only, ids are searched in ranges that
grow, each for the words that did not have enough before it.

Words of one or two bytes have no trigram: for these all entries of a range are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.scan import checkpointed, numbered

GRAM = 3
#: Ids of one row of bits, up to 64.
BLOCK = 1 << 6
FOLDERS = 64
#: Words up to this many are told to all tasks; ids of texts and hits up to ten times as many.
MOST_TOLD = 10_000
#: Ids of the first range searched for the first entries, and how much longer the next range ends.
FIRST, WIDER = 1 << 12, 8
#: Bytes of text taken apart at once.
SLICE = 1 << 20


def grams(word: Column) -> Column:
    """Distinct runs of GRAM bytes of a word, as numbers."""
    runs = F.transform(F.sequence(F.lit(0), F.octet_length(word) - GRAM), lambda i: F.conv(F.substring(F.hex(word), 2 * i + 1, F.lit(2 * GRAM)), 16, 10).cast("int"))
    return F.when(F.octet_length(word) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<int>"))


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the trigram at each place of the rows' bytes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(row) < GRAM:
        return row[:0], row[:0]
    x = data.astype(np.int64)
    inside = row[2:] == row[:-2]
    return row[:-2][inside], ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[inside]


def _bits(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """gram, block and bits of a slice of rows: id, texts."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        columns = []
        for column in batch.columns[1:]:
            column = column.cast(pa.large_string())
            _, offsets, data = column.buffers()
            columns.append((np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]))
        ends = np.cumsum(sum(np.diff(o) for _, o in columns))
        start = 0
        while start < len(ids):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
            rows, found = zip(*(text_grams(d[o[start] : o[end]], o[start : end + 1] - o[start]) for d, o in columns))
            number = ids[start:end][np.concatenate(rows)]
            blocks, at = np.unique(number // block, return_inverse=True)
            key = np.sort((((at << 8 * GRAM) | np.concatenate(found)) << 6) | number % block)
            first = np.flatnonzero(np.append(True, key[1:] >> 6 != key[:-1] >> 6)) if len(key) else key
            if len(key):
                bits = np.bitwise_or.reduceat(np.left_shift(np.int64(1), key & 63), first)
                gram = key[first] >> 6
                yield pa.RecordBatch.from_arrays([pa.array((gram & ((1 << 8 * GRAM) - 1)).astype(np.int32)), pa.array(blocks[gram >> 8 * GRAM]), pa.array(bits)], names=["gram", "block", "bits"])
            start = end


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(entries: DataFrame, columns: list[str], folder: str, order: tuple[str, ...] = ("key", "pos")) -> None:
    """Writes the index of entries over columns; two shuffles, of rows to number them and of (trigram, block)."""
    numbered(entries, [F.col(c) for c in order], "id").write.parquet(f"{folder}/entries")
    rows, block = entries.sparkSession.read.parquet(f"{folder}/entries"), BLOCK
    at = rows.select("id", *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]).mapInArrow(lambda batches: _bits(batches, block), "gram int, block bigint, bits bigint")
    # Dealt by trigram once: blocks are put together and written where they are.
    placed = at.withColumn("folder", _folder(F.col("gram"))).repartition("folder", "gram").groupBy("folder", "gram", "block").agg(F.bit_or("bits").alias("bits"))
    placed.sortWithinPartitions("folder", "gram", "block").write.partitionBy("folder").parquet(f"{folder}/postings")


def _small(df: DataFrame, most: int = MOST_TOLD) -> DataFrame:
    return F.broadcast(df) if len(df.take(most + 1)) <= most else df


def candidates(spark: SparkSession, folder: str, words: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """word and id of entries that hold all trigrams of a word of three bytes or more; words: word, in small letters; ids from low, below high (both of whole blocks)."""
    wanted = words.select("word", grams(F.col("word")).alias("g")).where(F.size("g") > 0)
    wanted = wanted.select("word", F.size("g").alias("n"), F.explode("g").alias("gram")).withColumn("folder", _folder(F.col("gram")))
    lists = spark.read.schema("gram int, block bigint, bits bigint, folder int").parquet(f"{folder}/postings").where(F.col("block") >= low // BLOCK)
    if high is not None:
        lists = lists.where(F.col("block") < high // BLOCK)
    hit = lists.join(_small(wanted), ["folder", "gram"]).groupBy("word", "block").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("m"), F.max("n").alias("n"))
    met = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    hit = hit.where((F.col("m") == F.col("n")) & (F.col("bits") != 0)).select("word", "block", F.explode(met).alias("at"))
    return hit.select("word", (F.col("block") * BLOCK + F.col("at")).alias("id"))


def _holding(spark: SparkSession, folder: str, words: DataFrame, columns: list[str], low: int = 0, high: int | None = None) -> DataFrame:
    """word and id of the entries of a range that hold a word."""
    rows = spark.read.parquet(f"{folder}/entries").where(F.col("id") >= low)
    if high is not None:
        rows = rows.where(F.col("id") < high)
    rows = rows.select("id", *columns)
    texts = F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    held = F.get(F.transform(F.array(texts), lambda t: F.filter("words", lambda w: F.exists(t, lambda x: F.contains(x, w)))), F.lit(0))
    some = checkpointed(candidates(spark, folder, words, low, high).groupBy("id").agg(F.collect_list("word").alias("words")))
    found = rows.join(_small(some, 10 * MOST_TOLD), "id").select("id", F.explode(held).alias("word"))
    # The words that have no trigram: as many at most as there are texts of two bytes.
    short = words.where(F.octet_length("word") < GRAM)
    if short.take(1):
        told = F.broadcast(short.agg(F.collect_list("word").alias("words")))
        found = found.unionByName(rows.crossJoin(told).select("id", F.explode(held).alias("word")))
    return found.select("word", "id")


def _first(df: DataFrame, by: str, most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("id"))).where(F.col("_n") <= most).drop("_n")


def _first_holding(spark: SparkSession, folder: str, words: DataFrame, columns: list[str], most: int) -> DataFrame:
    """As _holding, the first ``most`` of each word: a range is searched for the words that had fewer before it."""
    last = spark.read.parquet(f"{folder}/entries").agg(F.max("id")).first()[0] or 0
    low, high, found = 0, FIRST, None
    while True:
        got = checkpointed(_first(_holding(spark, folder, words, columns, low, high), "word", most))
        found = got if found is None else found.unionByName(got)
        if high > last:
            return found
        enough = found.groupBy("word").count().where(F.col("count") >= most)
        words = checkpointed(words.join(enough, "word", "left_anti"))
        if not words.take(1):
            return found
        low, high = high, high * WIDER


def search(spark: SparkSession, folder: str, asked: DataFrame, columns: list[str], most: int | None = None, by: str = "query_id") -> DataFrame:
    """For each query the entries of which a column holds any of its words, in order of ids, the first ``most``.

    asked: query_id and word, a row a word. Returns query_id and the entry's columns and id.
    """
    asked = checkpointed(asked.select(by, F.lower("word").alias("word")).where("word != ''").distinct())
    words = asked.select("word").distinct()
    # What is among the first of a query is among the first of one of its words.
    found = _holding(spark, folder, words, columns) if most is None else _first_holding(spark, folder, words, columns, most)
    hits = asked.join(found, "word").select(by, "id").distinct()
    if most is not None:
        hits = _first(hits, by, most)
    return _small(checkpointed(hits), 10 * MOST_TOLD).join(spark.read.parquet(f"{folder}/entries"), "id")
