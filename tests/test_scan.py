import random
from itertools import accumulate, groupby

import pytest
from pyspark.sql import functions as F

from skein.operators import scan

rng = random.Random(3)


def test_numbers_in_a_global_order(spark):
    values = [rng.randrange(50) for _ in range(2000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, id int").repartition(5)
    got = [(r.v, r.number) for r in scan.numbered(df, [F.desc("v"), F.asc("id")]).orderBy("number").collect()]
    assert got == list(zip(sorted(values, reverse=True), range(1, 2001)))
    assert scan.numbered(df.limit(0), [F.asc("v")]).count() == 0


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_running_sums_of_keys_that_span_ranges(spark, hot):
    rows = [(None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randrange(40), f"k{rng.randrange(2)}", i, rng.choice([None, 1, 5])) for i in range(1500)]
    df = spark.createDataFrame(rows, "a int, b string, t int, x bigint").repartition(6)
    got = {(r.a, r.b, r.t): (r.n, r.s) for r in scan.running(df, ["a", "b"], [F.asc("t")], {"n": F.lit(1), "s": F.coalesce("x", F.lit(0))}).collect()}
    want = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for _, group in groupby(sorted(rows, key=lambda r: (key(r), r[2])), key):
        group = list(group)
        for r, n, s in zip(group, range(1, 10**6), accumulate(r[3] or 0 for r in group)):
            want[r[0], r[1], r[2]] = (n, s)
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_keys_of_many_rows(spark, how, monkeypatch):
    monkeypatch.setattr(scan, "FEW", 20)
    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 200, i) for i in range(3000)]
    few = [(k, f"v{k}") for k in range(0, 200, 2)] + [(1, "v1")]
    counts = {k: sum(r[0] == k for r in rows) for k, _ in few}
    unique = spark.createDataFrame([(*f, counts[f[0]]) for f in few], "k int, v string, n bigint")
    got = scan.join_unique(spark.createDataFrame(rows, "k int, i int"), unique, ["k"], F.col("n"), how).select("k", "i", "v").collect()
    names = dict(few)
    want = [(k, i, names.get(k)) for k, i in rows if how == "left" or k in names]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
