"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction made of one codeword for each half of the components,
both from random spherical codes, after a random turn of all vectors. A vector
passes the filters whose product with it exceeds a threshold, its own, so that
a given number pass; they are list-decoded half by half without trying all
products. That number is chosen by trial on random pairs, so that a pair at
the least cosine meets with probability RECALL at any size of table; the turn
makes every pair as good as a random one. The codes grow with the largest
label of vectors of a length, so that few but near vectors meet.

Equal vectors of a label are one class before any of this. First only the
numbers of classes and filters are counted by filter; vectors are then sent to
the filters where they meet another. There their cosines are computed in
double precision; a pair is counted in the smallest filter that both pass. A
filter of more than TILE classes is cut into tiles, and each pair of tiles is
work of its own. Of a tile only counts and a spanning forest come out, never
its pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing; vectors of
different lengths have no cosine; a repeated row counts as a vector of its
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import connected_components, cut

#: Of pairs exactly at the least cosine, the share that must pass a common filter, and the pairs it is tried on.
RECALL = 0.999
TRIALS = 4000
#: Filters that a vector passes at least.
PASSED = 8
#: Codewords of a half at most; beyond it more vectors meet in a filter, and no pair is lost.
CODEWORDS = 1 << 14
#: Classes of a tile, rows of a task's unit of work, classes of a filter that are compared together with other filters',
#: and numbers in a work array.
TILE = 2048
ROWS = 8192
FEW = 24
BLOCK = 1 << 20


@lru_cache(maxsize=4)
def codes(dim: int, size: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Two random codebooks of unit vectors, for the halves of the components."""
    rng = np.random.default_rng(seed)
    out = []
    for d in (dim - dim // 2, dim // 2):
        u = rng.normal(size=(size, d))
        out.append(u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12))
    return out[0], out[1]


@lru_cache(maxsize=4)
def turn(dim: int, seed: int = 9) -> np.ndarray:
    """A random rotation."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def list_decode(x: np.ndarray, size: int, passed: int) -> list[np.ndarray]:
    """The numbers, ascending, of the filters that each unit vector passes."""
    n, dim = x.shape
    first, second = codes(dim, size)
    x = x @ turn(dim)
    a, b = x[:, : first.shape[1]] @ first.T, x[:, first.shape[1] :] @ second.T if dim > 1 else np.zeros((n, size))
    passed, most = min(passed, size**2), min(passed, size)
    top_a, top_b = (-np.sort(np.partition(-c, most - 1, axis=1)[:, :most], axis=1) for c in (a, b))
    out = []
    for i in range(n):
        # The best sums are among the best codewords of each half.
        cap = np.partition((top_a[i][:, None] + top_b[i][None, :]).ravel(), -passed)[-passed] - 1e-12
        p = np.flatnonzero(a[i] >= cap - top_b[i, 0])
        q = np.flatnonzero(b[i] >= cap - top_a[i, 0])
        u, v = np.nonzero(a[i, p][:, None] + b[i, q][None, :] >= cap)
        out.append(np.sort(p[u] * size + q[v]))
    return out


def trial_pairs(dim: int, least: float, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and for each another at the given cosine."""
    rng = np.random.default_rng(seed)
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    x = unit(rng.normal(size=(n, dim)))
    w = rng.normal(size=(n, dim))
    w = unit(w - (w * x).sum(axis=1, keepdims=True) * x)
    return x, least * x + np.sqrt(max(0.0, 1 - least**2)) * w


def met(dim: int, size: int, least: float, passed: int, seed: int = 11) -> float:
    """The share of random pairs at the least cosine that pass a common filter."""
    x, y = trial_pairs(dim, least, TRIALS, seed)
    common = 0
    for low in range(0, TRIALS, 512):
        both = zip(list_decode(x[low : low + 512], size, passed), list_decode(y[low : low + 512], size, passed))
        common += sum(len(np.intersect1d(p, q, assume_unique=True)) > 0 for p, q in both)
    return common / TRIALS


@lru_cache(maxsize=4096)
def enough(dim: int, size: int, least: float) -> int:
    """The number of filters to pass."""
    passed = PASSED
    while passed < size**2 and met(dim, size, least, passed) < RECALL:
        passed = passed * 3 // 2
    return min(passed, size**2)


def code_size(n: int) -> int:
    """Codewords of a half for n vectors of a label."""
    return min(CODEWORDS, 1 << max(3, int(np.ceil(np.log2(16 * np.sqrt(max(1.0, n)))))))


def linked(x: np.ndarray, norms: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosines of the pairs of rows are at least the given one."""
    return np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= least


def met_before(keys: np.ndarray, here: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs of rows meet in a filter before this one, too; keys: filters of a row, padded by the greatest number."""
    found = np.zeros(len(i), bool)
    step = max(1, BLOCK // keys.shape[1])
    for low in range(0, len(i), step):
        p, q, h = i[low : low + step], j[low : low + step], here[low : low + step]
        for c in range(keys.shape[1]):
            own = keys[p, c]
            found[low : low + step] |= (own < h) & (keys[q] == own[:, None]).any(axis=1)
    return found


def few_pairs(bucket: np.ndarray, apart: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring rows, up to most - 1 apart, of a bucket; of two tiles, those across them. Rows are sorted by bucket."""
    i, j = [], []
    for d in range(1, most):
        p = np.flatnonzero(bucket[d:] == bucket[:-d])
        p = p[(apart[p] < 0) | (apart[p] != apart[p + d])]
        i.append(p)
        j.append(p + d)
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, int), np.zeros(0, int))


def many_pairs(x: np.ndarray, norms: np.ndarray, keys: np.ndarray, here: int, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a large filter that meet first here; left and right: rows of the two tiles, the same for one."""
    one = left is right
    shared, times = np.unique(keys[left if one else np.concatenate([left, right])], return_counts=True)
    shared = shared[(times > 1) & (shared < here)]
    dense = len(shared) * len(right) <= 8 * BLOCK
    member = lambda at: np.isin(keys[at], shared)

    def marks(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), len(shared)), np.float32)
        r, c = np.nonzero(member(at))
        out[r, np.searchsorted(shared, keys[at[r], c])] = 1
        return out

    other = marks(right) if dense and len(shared) else None
    unit = x[right] / norms[right, None]
    i_all, j_all = [], []
    step = max(1, BLOCK // len(right))
    for low in range(0, len(left), step):
        at = left[low : low + step]
        near = (x[at] / norms[at, None]) @ unit.T
        near = np.abs(near - least) < 1e-9, near >= least
        hit = near[0] | near[1]
        if one:
            hit &= np.arange(low, low + len(at))[:, None] < np.arange(len(right))[None, :]
        if other is not None:
            hit &= marks(at) @ other.T == 0
        p, q = np.nonzero(hit)
        close = near[0][p, q]
        p, q = at[p], right[q]
        sure = np.ones(len(p), bool)
        sure[close] = linked(x, norms, p[close], q[close], least)
        p, q = p[sure], q[sure]
        if not dense:
            first = ~met_before(keys, np.full(len(p), here), p, q)
            p, q = p[first], q[first]
        i_all.append(p)
        j_all.append(q)
    return np.concatenate(i_all), np.concatenate(j_all)


def summed(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Of linked pairs of rows: links of each id, and the smallest id that it reaches."""
    nodes, at = np.unique(ids, return_inverse=True)
    a, b = at[i], at[j]
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, a, copies[j])
    np.add.at(count, b, copies[i])
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    on = count > 0
    return pd.DataFrame({"a": nodes[on], "n": count[on], "b": nodes[root[on]]})


def compare(x: pd.DataFrame, least: float) -> pd.DataFrame:
    """Counts and forest of the links of rows (label, key, h, copies, v, keys, own, ti, tj) that share label, key and tiles."""
    out = []
    for _, part in x.groupby(x.v.map(len)):
        part = part.assign(bucket=part.groupby(["label", "key", "ti", "tj"]).ngroup()).sort_values(["bucket", "h"])
        v = np.stack(part.v.to_numpy()).astype(float)
        v = v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True))))  # exact; keeps squares finite
        norms = np.sqrt((v * v).sum(axis=1))
        wide = part["keys"].map(len).max()
        keys = np.full((len(part), wide), np.iinfo(np.int64).max)
        for r, k in enumerate(part["keys"]):
            keys[r, : len(k)] = k
        bucket, here, own = part.bucket.to_numpy(), part.key.to_numpy(), part.own.to_numpy()
        apart = np.where(part.ti == part.tj, -1, own)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(part))
        small = np.repeat(ends - starts <= FEW, ends - starts)
        at = np.flatnonzero(small)
        i, j = few_pairs(bucket[at], apart[at], FEW)
        i, j = at[i], at[j]
        step = max(1, BLOCK // v.shape[1])
        near = np.concatenate([np.zeros(0, bool), *(linked(v, norms, i[low : low + step], j[low : low + step], least) for low in range(0, len(i), step))])
        i, j = i[near], j[near]
        first = ~met_before(keys, here[i], i, j)
        i_all, j_all = [i[first]], [j[first]]
        for low, high in zip(starts, ends):
            if high - low > FEW:
                rows = np.arange(low, high)
                left, right = (rows, rows) if apart[low] < 0 else (rows[own[rows] == part.ti.iloc[low]], rows[own[rows] == part.tj.iloc[low]])
                if len(left) and len(right):
                    i, j = many_pairs(v, norms, keys, int(here[low]), left, right, least)
                    i_all.append(i)
                    j_all.append(j)
        out.append(summed(part.h.to_numpy(), part.copies.to_numpy(), np.concatenate(i_all), np.concatenate(j_all)))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "n": [], "b": []}).astype("int64")


def links(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row."""
    v = F.col(vector)
    exact = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    sound = F.forall(v, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c), F.lit(False)))
    some = F.exists(v, lambda c: c != 0)
    takes_part = F.coalesce(F.col(label).isNotNull() & F.col(key).isNotNull() & v.isNotNull() & sound & some, F.lit(False))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).cast("string").alias("label"), F.when(takes_part, F.transform(v, lambda c: c.cast(exact))).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "label", "v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v", "label"))})
    classes = cut(rows.where("v is not null").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "v")).alias("x"), F.count("*").alias("copies")).select("h1", "h2", "copies", "x.vec_id", "x.label", "x.v"))
    counts = classes.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most")).collect()
    sizes = {r.dim: code_size(r.most) for r in counts}
    few = {d: enough(d, size, float(least)) for d, size in sizes.items()}

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, dims = batch.column(2), np.asarray(batch.column(2).value_lengths())
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                step = max(1, BLOCK // max(d, sizes[int(d)]))
                for low in range(0, len(at), step):
                    take = pa.array(at[low : low + step])
                    x = np.asarray(values.take(take).flatten(), float).reshape(-1, d)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    found = list_decode(x / np.linalg.norm(x, axis=1, keepdims=True), sizes[int(d)], few[int(d)])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(2)), pa.array([int(d)] * len(take), pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["h", "label", "dim", "filters"])

    passed = classes.select(F.col("h1").alias("h"), "label", "v").mapInArrow(passing, "h bigint, label string, dim int, filters array<bigint>")
    met_in = cut(passed.select("h", F.explode("filters").alias("filter"), "label", "dim").select("h", F.xxhash64("label", "dim", "filter").alias("key")))
    crowded = met_in.groupBy("key").count().where(F.col("count") > 1).select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    # As many as the filters passed: a bounded list.
    live = cut(met_in.join(crowded, "key").groupBy("h").agg(F.sort_array(F.collect_set(F.struct("key", "tiles"))).alias("met")))
    work = live.agg(F.sum(F.aggregate("met", F.lit(0).cast("bigint"), lambda n, m: n + m["tiles"]))).first()[0] or 0
    spread = classes.select(F.col("h1").alias("h"), "label", "copies", "v").join(live, "h")
    spread = spread.withColumn("keys", F.col("met.key")).withColumn("m", F.explode("met")).withColumn("own", F.pmod(F.xxhash64("h"), F.col("m.tiles")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m.tiles") - 1)))
    spread = spread.select("label", F.col("m.key").alias("key"), "h", "copies", "v", "keys", "own", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"))
    spread = spread.withColumn("g", F.pmod(F.xxhash64("key", "ti", "tj"), F.lit(work // ROWS + 1)))
    found = cut(spread.groupBy("g").applyInPandas(lambda x: compare(x, least), "a bigint, n bigint, b bigint"))
    components = connected_components(found.select("a", "b")).withColumnRenamed("node", "h1")
    counts = found.groupBy(F.col("a").alias("h1")).agg(F.sum("n").alias("n"))
    by_class = classes.select("h1", "h2", "copies", "vec_id").join(counts, "h1", "left").join(components, "h1", "left")
    smallest = by_class.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("smallest"))
    by_class = by_class.join(smallest, "component", "left").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("smallest", "vec_id").alias("component"))
    out = rows.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
