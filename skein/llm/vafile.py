"""Exact top-k inner products over a vector-approximation file.

Vectors are integers: floor(scale * x) of each component, whole numbers kept
in doubles. The approximation file holds, of each distinct vector, a byte a
component: the cell it falls in. Of the 256 cells of a component 254 divide
the range between its outer quantiles, the other two hold what lies outside.

1. Scan: tiles of the file meet tiles of queries. The cells' bounds give, for
   each query and vector, the least and the greatest score it may have; a
   vector is left if its greatest is not below the kth greatest of the least.
2. The tiles' kth bounds are merged, and what they rule out goes.
3. Exact vectors are read by id in the order of their bounds: first, of each
   query, the PROBE best by bound; their kth exact score is a bound that rules
   out nearly all others, and the rest is read.

Equal vectors are one row of the file, with their smallest ids: of more than
k + 1 ids the others can be no result, so that a vector that a third of all
rows hold is scored once. All pairs of a tile of queries and a tile of the
file are work of their own; a tile has a size that doesn't grow with the input.

Edge cases: vectors that are null, empty, or hold null or non-finite
components take no part; components may be of any finite size, and products
that a double does not hold exactly are computed in whole numbers; a score
beyond a long among the results is an error, as in SQL; only
vectors of as many components are compared; a query id that is repeated asks
once, with its smallest vector; a candidate row that is repeated counts as
often, and no candidate has the query's own id; ties go to the smaller id;
rows without an id take no part; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import begin, cut
from skein.operators.scan import work_folder

CELLS = 256
#: Vectors of a tile of the file (fewer where that gives no work to all tasks, but LEAST), and queries of a tile. Each tile of
#: the file is copied for every tile of queries, and these for every tile of the file: the larger, the less is shuffled.
TILE = 1 << 18
LEAST = 1 << 13
QUERIES = 1 << 14
#: Vectors that are bounded at a time.
BLOCK = 1024
#: Shares of the components that lie outside the inner cells, on either side.
OUTER = 0.0005
PROBE = 4
#: Whole numbers up to here are exact in doubles.
EXACT = 2.0**53


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    """Beyond the doubles: the greatest of them, of which any multiple but 0 is beyond a long, too."""
    top = np.finfo(float).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -top, top)


def marks(quantiles: list[tuple[float, float, float, float]]) -> np.ndarray:
    """Per component (rows) the least value of each cell, and the greatest of all at the end; cells hold whole numbers."""
    out = np.empty((len(quantiles), CELLS + 1))
    for row, (low, inner_low, inner_high, high) in zip(out, quantiles):
        row[0], row[CELLS] = low, high
        row[1:CELLS] = np.ceil(2 * np.linspace(inner_low / 2, inner_high / 2, CELLS - 1))  # halves: the range may be beyond the doubles
    return out


def cells_of(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cell of each component."""
    out = np.empty(v.shape, np.uint8)
    for c in range(v.shape[1]):
        out[:, c] = np.clip(np.searchsorted(at[c, :CELLS], v[:, c], side="right") - 1, 0, CELLS - 1)
    return out


def limits(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of each component's cells."""
    low, high = at[:, :CELLS], np.maximum(at[:, :CELLS], at[:, 1:] - 1)
    high[:, -1] = np.maximum(at[:, CELLS - 1], at[:, CELLS])
    middle = low / 2 + high / 2
    return middle, np.maximum(high - middle, middle - low)


def scan(q: np.ndarray, cells: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector, least and greatest score of what a tile may hold of the k best of each query."""
    middle, half = limits(at)
    every = np.arange(cells.shape[1])
    kept: list[list[np.ndarray]] = [[], [], [], []]
    floor = np.full(len(q), -np.inf)
    best = np.full((len(q), k + 1), -np.inf)
    size = np.abs(q)
    for start in range(0, len(cells), BLOCK):
        part = cells[start : start + BLOCK]
        m, w = middle[every, part], half[every, part]
        with np.errstate(over="ignore", invalid="ignore"):
            mid, slack = q @ m.T, size @ w.T
            slack += 1e-9 * (slack + size @ np.abs(m).T)  # rounding
            low, high = np.nan_to_num(mid - slack, nan=-np.inf), np.nan_to_num(mid + slack, nan=np.inf, posinf=np.inf)
        # One vector more than k: one of them may be the query itself.
        best = np.sort(np.concatenate([best, low], axis=1), axis=1)[:, -(k + 1) :]
        floor = best[:, 0]
        i, j = np.nonzero(high >= floor[:, None])
        for x, y in zip(kept, (i, j + start, low[i, j], high[i, j])):
            x.append(y)
    i, j, low, high = (np.concatenate(x) if x else np.zeros(0) for x in kept)
    stay = high >= floor[i.astype(int)]
    return i[stay].astype(int), j[stay].astype(int), low[stay], high[stay]


def scores(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact products of rows, and which are beyond a long (and stand as the nearest long)."""
    top = (np.abs(x).max(axis=1) * np.abs(y).max(axis=1) * x.shape[1]) if len(x) else np.zeros(0)
    out = np.zeros(len(x), np.int64)
    small = top < EXACT
    out[small] = np.einsum("ij,ij->i", x[small], y[small]).astype(np.int64)
    over = np.zeros(len(x), bool)
    for n in np.flatnonzero(~small):
        s = sum(int(a) * int(b) for a, b in zip(x[n].tolist(), y[n].tolist()))
        out[n] = max(-(2**63), min(2**63 - 1, s))
        over[n] = int(out[n]) != s
    return out, over


def topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best."""
    spark = vectors.sparkSession
    folder = work_folder(spark, "vafile")
    sound = F.forall(F.col(vector), lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c), F.lit(False)))
    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).where(F.size(vector) > 0)
    good = good.select(F.col(key).cast("bigint").alias("id"), F.transform(F.col(vector), lambda c: c.cast("double")).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("vectors")
        for batch in batches:
            x = batch.column(1)
            v = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths()))]), pa.int32()), pa.array(whole(np.asarray(x.flatten(), float), scale) + 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, batch.column(2)], names=["id", "v", "asked"])

    rows = good.mapInArrow(floors, "id bigint, v array<double>, asked boolean").withColumn("dim", F.size("v"))
    # A vector's ids, the smallest of them, and how often each occurs.
    counted = rows.groupBy("id", "v", "dim").agg(F.count("*").alias("times"), F.max("asked").alias("asked"))
    counted.write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    h = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]
    named = rows.select("id", "times", *[x.alias(c) for x, c in zip(h, ("h1", "h2"))])
    smallest = Window.partitionBy("h1", "h2").orderBy("id")
    holders = cut(named.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1).drop("place"))
    rows.dropDuplicates(["v"]).select(*[x.alias(c) for x, c in zip(h, ("h1", "h2"))], "v", "dim").write.parquet(f"{folder}/exact")
    exact = spark.read.parquet(f"{folder}/exact")
    queries = cut(rows.where("asked").groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.v", "x.dim"))

    # Cells, by component and number of components (a row for each of them comes to the driver).
    each = exact.select("dim", F.posexplode("v").alias("c", "x")).groupBy("dim", "c")
    spread = each.agg(F.min("x").alias("low"), F.percentile_approx("x", [OUTER, 1 - OUTER], 2000).alias("inner"), F.max("x").alias("high")).collect()
    at: dict[int, np.ndarray] = {}
    for dim in {r.dim for r in spread}:
        at[dim] = marks([(r.low, r.inner[0], r.inner[1], r.high) for r in sorted((r for r in spread if r.dim == dim), key=lambda r: r.c)])

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("vectors")
        for batch in batches:
            dims, out = np.asarray(batch.column(3)), [b""] * batch.num_rows
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                c = cells_of(np.asarray(batch.column(2).take(pa.array(own)).flatten(), float).reshape(-1, dim), at[dim])
                for i, r in zip(own.tolist(), c):
                    out[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.binary())], names=["h1", "h2", "dim", "cells"])

    n, m = exact.count(), queries.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles, query_tiles = max(1, -(-n // TILE), min(tasks, -(-n // LEAST))), max(1, -(-m // QUERIES))
    file = exact.select("h1", "h2", "v", "dim").mapInArrow(approximate, "h1 bigint, h2 bigint, dim int, cells binary")
    file = file.withColumn("vt", F.pmod("h1", F.lit(tiles)).cast("int")).withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    asked = queries.withColumn("qt", F.pmod(F.xxhash64("id"), F.lit(query_tiles)).cast("int")).withColumn("vt", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        begin("vectors")
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "h1": [], "h2": [], "low": [], "high": []}).astype({"query_id": "int64", "h1": "int64", "h2": "int64", "low": float, "high": float})
        dim = int(q.dim.iloc[0])
        cells = np.frombuffer(b"".join(c.cells), np.uint8).reshape(-1, dim)
        out = []
        for start in range(0, len(q), 256):
            i, j, low, high = scan(np.stack(q.v.iloc[start : start + 256].to_numpy()).astype(float), cells, at[dim], k)
            out.append(pd.DataFrame({"query_id": q.id.to_numpy()[start + i], "h1": c.h1.to_numpy()[j], "h2": c.h2.to_numpy()[j], "low": low, "high": high}))
        return pd.concat(out)

    by = ["dim", "qt", "vt"]
    near = cut(asked.groupBy(by).cogroup(file.groupBy(by)).applyInPandas(meet, "query_id bigint, h1 bigint, h2 bigint, low double, high double"))
    # The kth bound over all tiles; k + 1, as one of these vectors may be the query's own.
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "h1", "h2"))).where(F.col("place") == k + 1).select("query_id", F.col("low").alias("floor"))
    left = near.join(first, "query_id", "left").where("floor is null or high >= floor").select("query_id", "h1", "h2", "high")
    left = cut(left.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), "h1", "h2"))))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("vectors")
        for batch in batches:
            dims, out, over = np.asarray(batch.column(3).value_lengths()), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims).tolist():
                own = pa.array(np.flatnonzero(dims == dim))
                x, y = (np.asarray(batch.column(i).take(own).flatten(), float).reshape(-1, dim) for i in (3, 4))
                out[np.asarray(own)], over[np.asarray(own)] = scores(x, y)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out), pa.array(over)], names=["query_id", "h1", "h2", "score", "over"])

    def scored(some: DataFrame) -> DataFrame:
        read = some.select("query_id", "h1", "h2").join(exact.select("h1", "h2", F.col("v").alias("y")), ["h1", "h2"])
        both = read.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("x")), "query_id").select("query_id", "h1", "h2", "x", "y")
        found = both.mapInArrow(exactly, "query_id bigint, h1 bigint, h2 bigint, score bigint, over boolean").join(holders, ["h1", "h2"]).where("id != query_id")
        found = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
        return found.select("query_id", F.col("id").alias("vec_id"), "score", "over", "n")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "n")
    probes = cut(scored(left.where(F.col("place") <= PROBE * (k + 1))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    certain = probes.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")
    others = left.where(F.col("place") > PROBE * (k + 1)).join(certain, "query_id", "left").where("kth is null or high >= kth")
    every = probes.unionByName(scored(others))
    score = F.when(F.col("over"), F.raise_error(F.lit("a score is beyond a long")).cast("bigint")).otherwise(F.col("score"))
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
