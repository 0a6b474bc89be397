"""The nearest stored vectors of queries, by exact products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors of a tile at most. All tiles of one kind meet all of the other, so that what is shuffled falls as
#: these grow; a task holds one of each.
ASKED, STORED = 1 << 14, 1 << 16


def nearest(stored: DataFrame, asked: Column, least: float, most: int) -> DataFrame:
    """query_id, vec_id and score (0 to 1, six digits) of the best of all other vectors for each asked one.

    stored: vec_id and embedding; only vectors of as many components are
    compared, null ones not at all. Each pair of a tile of queries and a tile of
    vectors is work of its own, and gives the best of each query only.
    """
    rows = stored.select("vec_id", "embedding").where("embedding is not null")
    col = F.col
    q = rows.where(asked).select(col("vec_id").alias("query_id"), col("embedding").alias("e"))
    n, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As many tiles as give work to all tasks, but for small tables.
    tiles, query_tiles = max(1, -(-n // STORED), min(tasks, n >> 10)), max(1, -(-q.count() // ASKED))
    q = q.withColumn("qt", F.pmod(F.xxhash64("query_id"), F.lit(query_tiles))).withColumn("vt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))).withColumn("dim", F.size("e"))
    v = rows.withColumn("vt", F.pmod(F.xxhash64("vec_id"), F.lit(tiles))).withColumn("qt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_tiles - 1).cast("bigint")))).withColumn("dim", F.size("embedding"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": float})]
        if len(a) and len(b):
            y, ids = np.stack(b.embedding.to_numpy()).astype(float), b.vec_id.to_numpy()
            for low in range(0, len(a), 64):
                x, own = np.stack(a.e.iloc[low : low + 64].to_numpy()).astype(float), a.query_id.to_numpy()[low : low + 64]
                near = x @ y.T
                for i in range(len(own)):
                    s = np.where(ids == own[i], -np.inf, near[i])
                    kth = np.partition(s, -most)[-most] if len(s) > most else -np.inf
                    at = np.flatnonzero(s >= min(max(least, kth), 1.0) - 1e-5)
                    score = np.zeros(len(at))
                    for d in range(x.shape[1]):  # in the order of the components, as SQL sums
                        score += x[i, d] * y[at, d]
                    out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "score": np.clip(score, 0.0, 1.0)}))
        return pd.concat(out)

    found = q.groupBy("dim", "qt", "vt").cogroup(v.groupBy("dim", "qt", "vt")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    found = found.withColumn("score", F.round("score", 6)).where(col("score") >= least)
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(col("n") <= most).drop("n")
