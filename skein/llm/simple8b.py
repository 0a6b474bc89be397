"""Simple-8b word-aligned coding of token ids, and its file format.

A 64-bit word holds a 4-bit selector in its low bits and, above it, COUNTS[s]
fields of WIDTHS[s] bits. Ids are coded in blocks of BLOCK ids. A field with
all bits set is an escape: the id itself stands in the block's list of
escapes, in order. Offsets of each block's words and escapes let all blocks
of a chunk be decoded at once by array operations.

The files are Parquet files of chunks: whole documents in ascending doc_id
order, of about CHUNK ids. Columns: file, chunk (numbers), first (ids before
it in its file), n_ids, doc_ids and doc_nulls and counts (little-endian
arrays), words, word_offsets, escapes, escape_offsets.

Edge cases: a null or empty text is coded as the end id alone; rows without
doc_id come last; rows that repeat a doc_id are ordered by text; an empty
table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import begin, string_slices
from skein.llm.tokens import encoder

BLOCK = 256
CHUNK = 1 << 16
# Fields and their bits by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
#: Bits that an escape adds.
ESCAPE_BITS = 32


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, word offsets of the blocks, escapes, escape offsets of the blocks."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    limit = (np.uint64(1) << WIDTHS) - np.uint64(1)  # ids below it fit
    # The selector of the word that would begin at each position: the least bits
    # an id, escapes included. Selectors that cost far more on average are left out.
    bits = np.bincount(np.minimum(np.frexp(ids.astype(np.float64))[1], 60), minlength=61)
    fit = [float(bits[: int(w)].sum()) / max(n, 1) for w in WIDTHS]  # roughly: one bit is left for escapes
    fit[-1] = 1.0
    mean = 64 / COUNTS + ESCAPE_BITS * (1 - np.array(fit))
    best, least = np.zeros(n, np.int8), np.full(n, np.inf, np.float32)
    for s in np.flatnonzero((mean <= 1.6 * mean.min()) | (np.arange(len(COUNTS)) == len(COUNTS) - 1)):
        c = int(COUNTS[s])
        wide = np.zeros(n + c + 1, np.int32)
        np.cumsum(ids >= limit[s], out=wide[1 : n + 1])
        wide[n + 1 :] = wide[n]
        cost = (wide[c : c + n] - wide[:n]).astype(np.float32)
        cost += np.float32(64 / ESCAPE_BITS)
        cost *= np.float32(1 / c)
        better = cost < least
        np.copyto(least, cost, where=better)
        best[better] = s
    # One word of every block at a time.
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(at + BLOCK, n)
    live = np.arange(blocks)
    word_block, word_start, word_selector = [], [], []
    while len(live):
        s = best[at[live]]
        word_block.append(live)
        word_start.append(at[live].copy())
        word_selector.append(s)
        at[live] = np.minimum(at[live] + COUNTS[s], end[live])
        live = live[at[live] < end[live]]
    if not blocks:
        return np.zeros(0, "<u8"), np.zeros(1, "<u4"), np.zeros(0, "<u4"), np.zeros(1, "<u4")
    start = np.concatenate(word_start)
    order = np.argsort(start, kind="stable")
    start, selector, block = start[order], np.concatenate(word_selector)[order].astype(np.int64), np.concatenate(word_block)[order]
    count = np.append(start[1:], n) - start
    # Fields.
    of = np.repeat(np.arange(len(start)), count)
    place = (np.arange(n) - start[of]).astype(np.uint64)
    width, top = WIDTHS[selector[of]], limit[selector[of]]
    escaped = ids >= top
    field = np.where(escaped, top, ids) << (np.uint64(4) + place * width)
    words = np.bitwise_or.reduceat(field, start) | selector.astype(np.uint64)
    word_offsets = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
    escape_offsets = np.concatenate([[0], np.cumsum(np.bincount(np.flatnonzero(escaped) // BLOCK, minlength=blocks))])
    return words.astype("<u8"), word_offsets.astype("<u4"), ids[escaped].astype("<u4"), escape_offsets.astype("<u4")


def decode(words: np.ndarray, word_offsets: np.ndarray, escapes: np.ndarray, escape_offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks, or of a run of blocks given their words and escapes."""
    if not n:
        return np.zeros(0, np.uint32)
    words = words.astype(np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    blocks = len(word_offsets) - 1
    block = np.repeat(np.arange(blocks), np.diff(word_offsets.astype(np.int64)))
    count = COUNTS[selector]
    # The last word of a block may hold fewer than its selector says.
    size = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    before = np.concatenate([[0], np.cumsum(count)])
    last = word_offsets[1:].astype(np.int64) - 1
    count[last] = size - (before[last] - before[word_offsets[:-1].astype(np.int64)])
    start = np.cumsum(count) - count
    of = np.repeat(np.arange(len(words)), count)
    place = (np.arange(n) - start[of]).astype(np.uint64)
    width = WIDTHS[selector[of]]
    top = (np.uint64(1) << width) - np.uint64(1)
    out = (words[of] >> (np.uint64(4) + place * width)) & top
    out[out == top] = escapes.astype(np.uint64)
    return out.astype(np.uint32)


SCHEMA = "file int, chunk int, first bigint, n_ids bigint, doc_ids binary, doc_nulls binary, counts binary, words binary, word_offsets binary, escapes binary, escape_offsets binary"


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end_id: int) -> None:
    """Encodes whole texts, each followed by end_id, into files in folder.

    One shuffle ranges the texts by doc_id; each task writes a file through
    Spark's commit protocol, so that a lost executor costs its tasks only.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        enc, file, chunk, first = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first, held
            ids = np.concatenate([h[0] for h in held])
            row = [file, chunk, first, len(ids), b"".join(h[1] for h in held), b"".join(h[2] for h in held), b"".join(h[3] for h in held), *(x.tobytes() for x in encode(ids))]
            chunk, first, held = chunk + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 7)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            keys = batch.column(0)
            for a, b, data, offsets in string_slices(batch.column(1), 1 << 18):
                ids, bounds = enc.encode(data, offsets)
                with_end = np.insert(ids, bounds[1:], end_id).astype(np.uint32)
                part = keys.slice(a, b - a)
                held.append((with_end, np.asarray(part.fill_null(0), "<i8").tobytes(), np.asarray(part.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes(), (np.diff(bounds) + 1).astype("<i8").tobytes()))
                size += len(with_end)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    # Ranges of doc_id alone: the sample that finds their bounds must not hold texts.
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"), "text")
    texts.mapInArrow(chunks, SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian; null without with_ids) of each document, from the files."""

    files = spark.read.schema(SCHEMA).parquet(folder)
    # One row for each file.
    base = files.groupBy("file").agg(F.sum("n_ids").alias("n"))
    base = base.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, word_offsets, escapes, escape_offsets = (np.frombuffer(r[c], t) for c, t in (("words", "<u8"), ("word_offsets", "<u4"), ("escapes", "<u4"), ("escape_offsets", "<u4")))
                ids = decode(words, word_offsets, escapes, escape_offsets, r["n_ids"]).astype("<u4")
                count = np.frombuffer(r["counts"], "<i8")
                bounds = np.concatenate([[0], np.cumsum(count)])
                raw = memoryview(ids.tobytes())
                parts = [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["doc_nulls"], np.uint8).astype(bool)),
                        pa.array(bounds[:-1] + (r["base"] + r["first"])),
                        pa.array(count),
                        pa.array(np.array([zlib.crc32(p) for p in parts], np.int64)),
                        pa.array([bytes(p) for p in parts], pa.binary()) if with_ids else pa.array([None] * len(count), pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return files.join(F.broadcast(base), "file").select("first", "n_ids", "doc_ids", "doc_nulls", "counts", "words", "word_offsets", "escapes", "escape_offsets", "base").mapInArrow(documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
