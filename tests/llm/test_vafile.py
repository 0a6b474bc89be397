"""op4: tiles of any size, components of any size, repeated rows, columns of other names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import vafile

SCHEMA = "vec_id bigint, embedding array<double>, v int, id string, score int"


def brute(rows, asked, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            ok.setdefault(i, []).append([int(np.floor(256 * c)) if abs(c) < 1e300 else int(c) * 256 for c in v])
    out = []
    for q in ok:
        if asked(q):
            x = min(ok[q])
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i in ok if i != q for y in ok[i] if len(x) == len(y))[:k]
            out += [(q, n + 1, i, -score) for n, (score, i) in enumerate(s)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("tile, least, queries", [(1 << 18, 1 << 13, 1 << 14), (40, 16, 7), (1000, 5, 3)])
def test_tiles_of_any_size(spark, monkeypatch, tile, least, queries):
    monkeypatch.setattr(vafile, "TILE", tile)
    monkeypatch.setattr(vafile, "LEAST", least)
    monkeypatch.setattr(vafile, "QUERIES", queries)
    g = np.random.default_rng(2)
    rows = [(i, [float(x) for x in g.normal(size=8)]) for i in range(150)] + [(i, [0.5] * 8) for i in range(200, 230)]  # a large group of copies
    rows += [rows[3], rows[10], (10, [1.0] * 8), (300, [1.0] * 5), (310, [2.0] * 5), (320, None), (330, []), (340, [float("nan")] * 8), (350, [None] + [1.0] * 7), (None, [1.0] * 8), (360, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    assert found(vafile.topk(df, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0, 5)


def test_components_of_any_size(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1e307]), (2, [3.0, -1e307]), (3, [4.0, 5e-324]), (4, [1e13, 2.0]), (10, [0.0, 1.0 / 256]), (11, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    assert found(vafile.topk(df, F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0, 5)
    with pytest.raises(Exception, match="a score is beyond a long"):
        vafile.topk(df, F.col("vec_id") == 10).collect()
