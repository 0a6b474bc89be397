"""op5: plans of many sources, against the plain water-filling, and the queue with plans that are not broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing

rng = random.Random(50)


@pytest.mark.parametrize("n, weights", [(1, (5, 2, 1)), (7, (5, 2, 1)), (400, (5, 2, 1)), (50, (1,)), (30, (3, 0.5)), (0, (5, 2, 1))])
def test_plans_are_the_targets(spark, n, weights):
    sizes = [(None if i == 3 else f"s{i:03d}", rng.choice((0, 1, 5, 10, 200, 10**6, rng.randrange(10**9)))) for i in range(n)]
    df = spark.createDataFrame([(s is None, s or "", x, 1) for s, x in sizes], "no_source boolean, source_key string, source_size bigint, rows bigint").repartition(3)
    got = {None if r.no_source else r.source_key: (r.source_size, r.target, r.budget) for r in mixing.plans(df, weights).collect()}
    want = {s: (x, t, int(t)) for s, x, t in mixing.targets(sizes, weights)}
    assert got.keys() == want.keys()
    for s in want:
        assert got[s][0] == want[s][0] and got[s][1] == pytest.approx(want[s][1], rel=1e-12) and abs(got[s][2] - want[s][2]) <= (got[s][1] != want[s][1])


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))), "hot" if i % 3 == 0 else f"host{rng.randrange(300)}" if i % 7 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    key = lambda m: sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in m.collect())
    few = key(mixing.mix(df))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 5)
    assert key(mixing.mix(df)) == few and sum(r[4] for r in few) == sum(r[1] for r in few)
    assert mixing.queue(df).count() == sum((2 * r[4] + r[1]) // (2 * r[1]) for r in few if r[1])
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).where("taken != 0 or target != 0").count() == 0
