"""Removal of repeated multi-line passages by content-defined chunks of lines.

Lines without words are no lines here. A rolling hash over the hashes of two
neighbouring lines is taken at each line; of the lines that begin within
WINDOW words of each other the one of the smallest hash begins a piece, and
a line of WINDOW words or more is a piece of its own. So boundaries depend on
a few lines around only, and a passage is cut at the same places wherever it
stands. A chunk is a piece and the next one; a piece is a chunk by itself where
it has several lines, or MIN_WORDS words, or a neighbour of several lines. So a
passage of two lines or more that are cut from their neighbours is covered by
chunks, each of which stands whole wherever the passage does; and a chunk's
first occurrence is a place where its lines stand together, whatever lines
stand between them elsewhere. Chunks that occur repeatedly are compared byte by
byte. From an equal chunk on, the lines before and after it are compared, too,
as far as boundaries may differ between two places (CONTEXT words), and go with
it if they are equal: so the ends of a passage go where they share a piece with
other lines.

What is removed is a run of lines that stands as such in one earlier place, of
at least two lines and LEAST_WORDS words, or of MIN_WORDS words. A chunk is held
against its first occurrence (in the order of doc_id, text hash, line) and
against the one before it; a third place counts only for lines at the ends of
a passage that are part of a longer piece. A line is only ever removed in
favour of an equal one that stands earlier, so that the first copy of
everything stays.

One shuffle carries the chunks that may be repeated, those that a filter over
the counted 64-bit hashes lets through. A task sends the bytes of a chunk
once, and compares its other copies with those itself; in the shuffle's sorted
partitions a hash's occurrences go by one at a time, so that the copies of the
commonest passage are never held together.

Edge cases: a null or empty text stays as it is; lines without words stay,
but go with the lines around them; a passage repeated inside one document is
removed there, too; rows without doc_id are left alone; rows that repeat
doc_id and text are one document and treated alike, rows that repeat a
doc_id with another text are documents of their own; an empty table gives no
rows; all columns are kept, but n_lines and n_removed of the caller give way.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import begin, cut, string_slices
from skein.llm.hashing import BYTE, SEEDS, mix, span_hashes, words

MIN_LINES = 2
MIN_WORDS = 50
LEAST_WORDS = 10
WINDOW = 9
CONTEXT = 3 * WINDOW
#: Bits of the filter for each repeated hash, and in all: 8 MB at most, whatever the input.
FILTER_RATIO = 16
FILTER_BITS = (16, 26)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with words: row, first byte, byte after the last (without its line feed), number in its row, words, words before it in the slice."""
    n = len(data)
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    starts = starts[starts < n]
    row = np.searchsorted(offsets, starts, side="right") - 1
    limit = np.append(starts[1:], n)
    ends = np.where(data[limit - 1] == 10, limit - 1, limit) if n else limit
    number = np.arange(len(starts)) - np.searchsorted(row, np.arange(len(offsets) - 1))[row]
    word_starts, _, _ = words(data, offsets)
    before = np.searchsorted(word_starts, np.append(starts, n))
    count = np.diff(before)
    some = count > 0
    return row[some], starts[some], ends[some], number[some], count[some], before[:-1][some]


def least_ahead(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each line, the one of the smallest hash among those of its row that begin within WINDOW words from it."""
    best = np.arange(len(h))
    for k in range(1, WINDOW):
        j = np.arange(len(h) - k)
        near = (row[j] == row[j + k]) & (at[j + k] < at[j] + WINDOW)
        if not near.any():
            break
        better = near & (h[j + k] < h[best[j]])
        best[j[better]] = j[better] + k
    return best


def chunk_table(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of each chunk: row, first and last byte, number of the first line, lines up to the last, hash; first and last of the lines with words."""
    row, start, end, number, count, at = lines_of(data, offsets)
    n = len(row)
    h = span_hashes(BYTE[data], start, end)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    rolling = h * SEEDS[40]
    rolling[1:] += np.where(first[1:], np.uint64(0), h[:-1] * SEEDS[41])
    open_ = first.copy()
    open_[least_ahead(mix(rolling), row, at)] = True
    long = count >= WINDOW
    open_ |= long
    open_[1:] |= long[:-1]
    a = np.flatnonzero(open_)
    b = np.append(a[1:], n) - 1 if n else a
    total = np.concatenate([[0], np.cumsum(count)])
    # Chunks: neighbouring pieces, and single ones that may go alone or with some lines of a neighbour.
    several = b > a
    alone = several | (total[b + 1] - total[a] >= MIN_WORDS)
    alone[1:] |= several[:-1] & (row[a[1:]] == row[a[:-1]])
    alone[:-1] |= several[1:] & (row[a[1:]] == row[a[:-1]])
    pair = np.flatnonzero(row[a[1:]] == row[a[:-1]])
    a, b = np.concatenate([a[alone], a[pair]]), np.concatenate([b[alone], b[pair + 1]])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return {
        "row": row[a],
        "start": start[a],
        "end": end[b],
        "line": number[a],
        "lines": number[b] - number[a] + 1,
        "hash": span_hashes(BYTE[data], start[a], end[b]).astype(np.int64),
        "first": a,
        "last": b,
        "line_row": row,
        "line_start": start,
        "line_end": end,
        "total": total,
    }


def contexts(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the lines before and after each chunk, CONTEXT words at most."""
    a, b, row, total, n = c["first"], c["last"], c["line_row"], c["total"], len(c["line_row"])
    low = np.maximum(np.searchsorted(total, total[a] - CONTEXT), np.searchsorted(row, row[a]))
    high = np.minimum(np.searchsorted(total, total[b + 1] + CONTEXT, side="right") - 1, np.searchsorted(row, row[a], side="right"))
    left, right = low < a, high > b + 1
    start, end = c["line_start"], c["line_end"]
    none = np.zeros(len(a), np.int64)
    return np.where(left, start[low], none), np.where(left, start[a] - 1, none), np.where(right, end[b] + 1, none), np.where(right, end[np.maximum(high - 1, 0)], none)


def chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("lines")
    for batch in batches:
        for _, _, data, offsets in string_slices(batch.column(0)):
            h, n = np.unique(chunk_table(data, offsets)["hash"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["hash", "n"])


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def repeated_filter(hashes: DataFrame) -> np.ndarray:
    """Bits, as bytes, of which those of the hashes are set; more where there are more hashes, within a bound."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], int(FILTER_RATIO * hashes.count()).bit_length()))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("lines")
        mask = np.zeros(1 << bits, bool)
        for batch in batches:
            mask[slot(np.asarray(batch.column(0)), bits)] = True
        packed = np.packbits(mask).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["word", "bits"])

    got = hashes.select("hash").mapInArrow(words_of, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    packed = np.zeros((1 << bits) // 64, np.int64)
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return packed.view(np.uint8)


FOUND = "hash bigint, check bigint, doc_id bigint, text_hash bigint, line int, lines int, chunk binary, before binary, after binary"
MATCH = "doc_id bigint, text_hash bigint, line int, lines int, source bigint, source_hash bigint, source_line int"


def possible_chunks(docs: DataFrame, packed: np.ndarray) -> DataFrame:
    """The chunks that the filter lets through, and where they stand.

    chunk: its bytes, null where the task has sent equal ones already.
    before, after: bytes of the lines around it, where its passage may begin or end.
    """
    bits = (len(packed) * 8).bit_length() - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("lines")
        sent: dict[tuple[int, int], bytes] = {}
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1)):
                c = chunk_table(data, offsets)
                s = slot(c["hash"], bits)
                hit = np.flatnonzero((packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1)
                raw, row, start, end = data.tobytes(), c["row"], c["start"].tolist(), c["end"].tolist()
                check = mix(span_hashes(BYTE[data ^ 0x5A], c["start"][hit], c["end"][hit])).astype(np.int64)
                around = [x[hit].tolist() for x in contexts(c)]
                chunks = []
                for j, key in zip(hit.tolist(), zip(c["hash"][hit].tolist(), check.tolist())):
                    chunk = raw[start[j] : end[j]]
                    if sent.get(key) == chunk:
                        chunk = None
                    elif len(sent) < SENT and key not in sent:
                        sent[key] = chunk
                    chunks.append(chunk)
                before, after = ([raw[x:y] if y > x else None for x, y in zip(*around[i : i + 2])] for i in (0, 2))
                take = pa.array(row[hit])
                arrays = [c["hash"][hit], check, batch.column(0).slice(a, b - a).take(take), batch.column(2).slice(a, b - a).take(take), c["line"][hit].astype(np.int32), c["lines"][hit].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(x if isinstance(x, pa.Array) else pa.array(x) for x in arrays), *(pa.array(x, pa.binary()) for x in (chunks, before, after))], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.mapInArrow(task, FOUND)


#: Chunks whose bytes a task keeps to send them once; it affects the size of the shuffle alone.
SENT = 1 << 16


def shared_end(x: bytes | None, y: bytes | None, side: int) -> int:
    """How many lines the contexts of equal chunks share at the end that touches the chunk (side -1: their last lines)."""
    if not x or not y:
        return 0
    x, y, n = x.split(b"\n")[::side], y.split(b"\n")[::side], 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of occurrences sorted by (hash, check, doc_id, text_hash, line): the lines that stand as such at the first and at the one before."""
    begin("lines")
    key, first, last, body = None, None, None, None
    for batch in batches:
        out: list[tuple] = []
        for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if r[:2] != key:
                key, first, last, body = r[:2], None, None, r[6]
            elif r[6] is not None:
                if body is not None and body != r[6]:
                    continue  # other bytes of the same hashes
                body = r[6]
            here = r[2:5]
            if last is not None and last[2:5] == here:
                continue  # a repeated row
            for at in (first, last) if last is not first else (first,):
                if at is not None:
                    low, high = shared_end(r[7], at[7], -1), shared_end(r[8], at[8], 1)
                    out.append((r[2], r[3], r[4] - low, r[5] + low + high, at[2], at[3], at[4] - low))
            first, last = first or r, r
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()])], names=[x.split()[0] for x in MATCH.split(", ")])


def removals(documents: DataFrame) -> DataFrame:
    """Runs of lines (doc_id, text_hash, line, lines) and the earlier place where they stand, too (source, source_hash, source_line)."""
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    counts = docs.select("text").mapInArrow(chunk_keys, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    packed = repeated_filter(cut(counts.where("n > 1").select("hash")))
    by = ["hash", "check", "doc_id", "text_hash", "line"]
    return possible_chunks(docs, packed).repartition("hash", "check").sortWithinPartitions(*by).mapInArrow(matches, MATCH)


def kept_lines(lines: list[str], gone: list[dict]) -> np.ndarray:
    """Which lines stay; gone: runs of lines and where they stand, too."""
    n = len(lines)
    keep, count = np.ones(n, bool), np.array([len(WORD.findall(t)) for t in lines])
    some = np.append(0, np.cumsum(count > 0))
    total = np.append(0, np.cumsum(count))
    places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for x in gone:
        places[x["source"], x["source_hash"], x["line"] - x["source_line"]].append((x["line"], x["line"] + x["lines"]))
    for runs in places.values():
        runs.sort()
        a, b = runs[0]
        for c, d in [*runs[1:], (n + 2, n + 2)]:
            if c <= b or c <= n and some[c] == some[b]:  # nothing or lines without words between
                b = max(b, d)
                continue
            if total[b] - total[a] >= (LEAST_WORDS if some[b] - some[a] >= MIN_LINES else MIN_WORDS):
                inside = a + np.flatnonzero(count[a:b])
                keep[inside[0] : inside[-1] + 1] = False
            a, b = c, d
    return keep


def dedup_lines(documents: DataFrame) -> DataFrame:
    """All columns, the text without repeated passages, and n_lines and n_removed."""
    documents = documents.drop("n_lines", "n_removed")
    gone = removals(documents).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line", "lines", "source", "source_hash", "source_line")).alias("_gone"))
    # Named so that no column of the caller clashes.
    gone = gone.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_gone")
    keyed = documents.withColumn("_text_hash", F.xxhash64("text"))
    joined = keyed.join(gone, (F.col("doc_id") == F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")), "left").drop("_doc", "_hash", "_text_hash")
    columns = documents.columns
    schema = T.StructType([*documents.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("lines")
        for whole in batches:
            for low, high, _, _ in string_slices(whole.column(columns.index("text")), 1 << 24):
                batch = whole.slice(low, high - low)
                column, gone = batch.column(columns.index("text")), batch.column(len(columns))
                total = pa.compute.add(pa.compute.count_substring(column, "\n"), 1).cast(pa.int64()).fill_null(0)
                removed = np.zeros(batch.num_rows, np.int64)
                hit = np.flatnonzero(np.asarray(gone.is_valid()))
                if len(hit):
                    texts = column.to_pylist()
                    for i in hit.tolist():
                        lines = texts[i].split("\n")
                        keep = kept_lines(lines, gone[i].as_py())
                        removed[i] = len(lines) - keep.sum()
                        texts[i] = "\n".join([t for t, k in zip(lines, keep) if k])
                    column = pa.array(texts, batch.column(columns.index("text")).type)
                arrays = [column if c == "text" else batch.column(i) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*arrays, total, pa.array(removed)], names=[*columns, "n_lines", "n_removed"])

    return joined.select(*columns, "_gone").mapInArrow(rebuilt, schema)
