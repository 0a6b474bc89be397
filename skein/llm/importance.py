"""Resampling by importance towards a target distribution, over a sparse count matrix.

Rows of the matrix are documents, columns the buckets of hashed features (runs
of 1 to 2 words). It is written once as Parquet files of CSR blocks: bounds of
the rows (indptr), buckets (indices) and counts (data), as little-endian
arrays. Sums of its columns give the distribution of the corpus, and, with
those of the target texts, each bucket's gain; a product of the matrix with the
vector of gains gives the weights of the documents. Only vectors as long as
the number of buckets pass through the driver.

The draw is the top of weight plus Gumbel noise keyed by doc_id, which is
sampling without replacement in proportion to exp(weight / 1000). Its order is
made by ranges, so that no task numbers all rows.

Edge cases: a null text has no words; a document of one word has that word as
its one feature, one without words has weight 0; the noise of a null doc_id is
that of an empty one; a null doc_id comes after others of equal score; rows
that repeat a doc_id are drawn each by itself, those with more features first,
and equal rows in any order; empty tables count as no features, which makes
every gain that of an unseen bucket; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import begin, string_slices
from skein.llm.hashing import LOWER
from skein.operators.scan import numbered, work_folder

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Longer words are hashed one at a time.
LONGEST = 48

#: Bytes of a row group of its files: what writer and reader hold at once.
GROUP_BYTES = 1 << 23

BLOCKS = "doc_ids binary, doc_nulls binary, n_words binary, indptr binary, indices binary, data binary"

#: Bytes of words: digits, small letters (capitals become small) and all bytes above ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """crc32 of each span, or of what has the checksum ``before`` followed by the span: one byte of all spans at a time."""
    out = (np.zeros(len(starts), np.uint32) if before is None else before) ^ _FULL
    length = ends - starts
    short = length <= LONGEST
    order = np.argsort(np.where(short, -length, 1), kind="stable")[: int(short.sum())]
    state, at = out[order], starts[order]
    for k, live in enumerate(np.searchsorted(-length[order], -np.arange(LONGEST), side="left").tolist()):
        if not live:
            break
        state[:live] = _step(state[:live], data[at[:live] + k])
    out[order] = state
    out ^= _FULL
    for i in np.flatnonzero(~short):
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(0 if before is None else before[i]))
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_words of the rows, and their counts of buckets in CSR form: indptr, indices, data."""
    n = len(offsets) - 1
    small = LOWER[data]
    inside = _WORD[small]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    one = crc32_spans(small, starts, ends)
    pair = np.flatnonzero(row[1:] == row[:-1])
    spaced = _step(one[pair] ^ _FULL, np.uint32(32)) ^ _FULL
    two = crc32_spans(small, starts[pair + 1], ends[pair + 1], spaced)
    key = np.concatenate([row * buckets + one % np.uint32(buckets), row[pair] * buckets + two % np.uint32(buckets)])
    key, count = np.unique(key, return_counts=True)
    return np.bincount(row, minlength=n), np.searchsorted(key, np.arange(n + 1) * buckets), key % buckets, count


def _index(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def write_matrix(documents: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> None:
    """The matrix of all documents, as Parquet files of CSR blocks in folder."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1)):
                n_words, indptr, indices, counts = features(data, offsets, buckets)
                ids = batch.column(0).slice(a, b - a)
                cells = (np.asarray(ids.fill_null(0), "<i8"), np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), n_words.astype("<i8"), indptr.astype("<i8"), indices.astype(_index(buckets)), counts.astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cells], names=[c.split()[0] for c in BLOCKS.split(", ")])

    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(folder)


def read_matrix(documents: DataFrame, folder: str) -> DataFrame:
    return documents.sparkSession.read.schema(BLOCKS).parquet(folder)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, for buckets that occur: summed in each task, then over the tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in zip(batch.column(0), batch.column(1)):
                at, n = np.frombuffer(indices.as_buffer(), _index(buckets)), np.frombuffer(counts.as_buffer(), "<u4")
                total += np.bincount(at, n, buckets).astype(np.int64)  # doubles, but exact: a block's counts stay far below 2**53
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return matrix.select("indices", "data").mapInArrow(sums, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in target and corpus: a vector of fixed length."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in found:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight and _at: the product of the matrix and the vector, by features, floored.

    _at, the place in the block, lets equal rows be dealt to several ranges.
    """
    index = _index(len(gain))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        for batch in batches:
            for row in zip(*batch.columns):
                ids, null, n_words, indptr, indices, counts = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, ("<i8", np.uint8, "<i8", "<i8", index, "<u4")))
                upto = np.concatenate([[0], np.cumsum(gain[indices] * counts)])
                total = upto[indptr[1:]] - upto[indptr[:-1]]
                n = n_words + np.maximum(n_words - 1, 0)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(n_words), pa.array(n), pa.array(weight), pa.array(np.arange(len(n)))], names=["doc_id", "n_words", "n_features", "weight", "_at"])

    return matrix.mapInArrow(product, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, _at bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g), g from a Gumbel distribution, keyed by seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document.

    Of the documents with least_words or more, percent of a hundred are drawn,
    by score, ties to the smaller doc_id.
    """
    folder = work_folder(documents.sparkSession, "importance")
    write_matrix(documents, f"{folder}/documents", buckets=buckets)
    write_matrix(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), f"{folder}/target", buckets=buckets)
    matrix = read_matrix(documents, f"{folder}/documents")
    gain = gains(column_sums(matrix, buckets), column_sums(read_matrix(target, f"{folder}/target"), buckets), buckets)
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= least_words
    # Those that may be drawn come first; all rows are numbered in one go.
    placed = numbered(scored.withColumn("_fit", fit), [F.desc("_fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.asc("_at")], "rank")
    drawn = placed.where("_fit").count() * percent // 100
    rank = F.when(F.col("_fit") & (F.col("rank") <= drawn), F.col("rank"))
    return placed.select("doc_id", "n_words", "n_features", "weight", F.col("score").cast("bigint").alias("score"), rank.cast("bigint").alias("rank"))
