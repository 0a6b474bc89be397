"""Packing token sequences by non-negative least squares.

A document's ids are cut into full windows and a remainder. The lengths of
the remainders of a block of documents, in bins of BIN ids, form a histogram;
the columns of a small matrix are the combinations of up to DEPTH bins that
fill a window exactly; non-negative least squares finds how often to repeat
each, and the counts are rounded down. What is left over is one stream that
fills the gaps of these windows, then windows of its own, and at the end
windows whose sizes are powers of two, so that nothing is padded.

Blocks are packed independently: no shuffle, a task holds at most one block
of about BLOCK_IDS ids besides its longest document, and a lost task is
simply run again.

Edge cases: a null or empty text has the end id only; rows that repeat a
doc_id are packed as documents of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import begin, string_slices
from skein.llm.tokens import encoder

DEPTH = 3
BIN = 32
BLOCK_IDS = 1 << 22
#: Bytes of text encoded at once: the work arrays take some 60 times as much.
SLICE = 1 << 18
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def combinations(bins: int, depth: int = DEPTH) -> np.ndarray:
    """Columns: how many of each bin; the bins' numbers, from 1, add up to bins."""
    out = []
    for k in range(1, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, bins + 1), k - 1):
            last = bins - sum(head)
            if last >= (head[-1] if head else 1):
                out.append(np.bincount([*head, last], minlength=bins + 1)[1:])
    return np.array(out, float).T


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    ata, atb = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n):
        w = atb - ata @ x
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance * max(1.0, np.abs(atb).max()):
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(ata[np.ix_(on, on)], atb[on], rcond=None)[0]
            if s.min() > 0:
                break
            low = s <= 0
            step = (x[on][low] / np.maximum(x[on][low] - s[low], 1e-300)).min()
            x[on] += step * (s - x[on])
            passive[on[x[on] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                s = np.zeros(0)
                on = np.flatnonzero(passive)
                break
        x[:] = 0
        x[on] = s
    return x


def plan(lengths: np.ndarray, window: int, combos: np.ndarray, width: int = BIN) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of (piece, its first id, ids) without gaps.

    lengths: of the pieces, each below window. All windows are full but the
    last few, whose sizes are powers of two.
    """
    bins = (lengths + width - 1) // width
    by_bin = {int(b): np.flatnonzero(bins == b)[::-1].tolist() for b in np.unique(bins)}
    histogram = np.bincount(bins, minlength=combos.shape[0] + 1)[1 : combos.shape[0] + 1].astype(float)
    present = np.flatnonzero((combos[histogram == 0] == 0).all(axis=0))
    windows: list[list[tuple[int, int, int]]] = []
    if len(present) and len(lengths):
        for column, times in zip(combos[:, present].T, np.floor(nnls(combos[:, present], histogram) + 1e-6).astype(int)):
            parts = np.repeat(np.arange(1, len(column) + 1), column.astype(int)).tolist()
            for _ in range(times):
                if any(len(by_bin.get(b, ())) < parts.count(b) for b in parts):
                    break
                windows.append([(i := by_bin[b].pop(), 0, int(lengths[i])) for b in parts])
    rest = sorted((i for v in by_bin.values() for i in v), key=lambda i: (-lengths[i], i))
    gaps, left = sum(window - sum(p[2] for p in w) for w in windows), int(sum(lengths[i] for i in rest))
    while gaps > left:  # too little to fill the gaps with: take a window apart
        w = windows.pop()
        have = sum(p[2] for p in w)
        gaps, left = gaps - (window - have), left + have
        rest += [p[0] for p in w]
    stream, place, first = iter(rest), -1, 0

    def fill(room: int) -> list[tuple[int, int, int]]:
        nonlocal place, first, left
        out = []
        while room:
            if place < 0:
                place, first = next(stream), 0
            take = min(room, int(lengths[place]) - first)
            out.append((place, first, take))
            room, first, left = room - take, first + take, left - take
            if first == lengths[place]:
                place = -1
        return out

    for w in windows:
        w += fill(window - sum(p[2] for p in w))
    while left:
        windows.append(fill(window if left >= window else 1 << (left.bit_length() - 1)))
    return windows


def pack(documents: DataFrame, tokenizer: str, end_id: int, window: int = 2048) -> DataFrame:
    """A row for each piece: which ids of which document, and where they lie."""
    bins = window // BIN

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens")
        enc, combos = encoder(tokenizer), combinations(bins)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            doc: list[int | None] = [d for h in held for d in h[0]]
            ids = np.concatenate([h[1] for h in held]).astype("<u4", copy=False)
            count = np.concatenate([h[2] for h in held])
            held = []
            at = np.cumsum(count) - count
            raw = memoryview(ids).cast("B")
            rows: list[tuple] = []

            def put(d: int, start: int, length: int, offset: int) -> None:
                a = int(at[d]) + start
                rows.append((doc[d], start, length, zlib.crc32(raw[4 * a : 4 * (a + length)]), int(count[d]), sequence, offset))

            for d in np.flatnonzero(count >= window).tolist():
                for start in range(0, int(count[d]) - window + 1, window):
                    put(d, start, window, 0)
                    sequence += 1
            short = np.flatnonzero(count % window)
            base = count[short] // window * window
            for w in plan(count[short] - base, window, combos):
                offset = 0
                for i, first, length in w:
                    put(int(short[i]), int(base[i]) + first, length, offset)
                    offset += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            keys = batch.column(0)
            for a, b, data, offsets in string_slices(batch.column(1), SLICE):
                ids, bounds = enc.encode(data, offsets)
                held.append((keys.slice(a, b - a).to_pylist(), np.insert(ids, bounds[1:], end_id).astype(np.uint32), np.diff(bounds) + 1))
                size += len(ids) + b - a
                if size >= BLOCK_IDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, SCHEMA)
