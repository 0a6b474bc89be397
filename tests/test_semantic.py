import itertools
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import semantic

rng = random.Random(21)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_all_pairs_of_enough_similarity_by_brute_force(spark, threshold):
    words = [f"term{i}" for i in range(14)]
    queries = sorted({" ".join(rng.choices(words, weights=[8, 4, *[1] * 12], k=rng.randrange(1, 7))) for _ in range(160)} | {"", "?"})
    stored = spark.createDataFrame([(q,) for q in queries], "query string").withColumn("vector", vectors.vectorize(F.col("query")))
    rows = {r.query: r.vector for r in stored.collect()}
    got = {(r.asked, r.query): r.similarity for r in semantic.similar(stored, stored.select(F.col("query").alias("asked")), threshold, 10**6).collect()}
    want = {}
    for a, b in itertools.product(queries, queries):
        s = round(min(1.0, sum(x * y for x, y in zip(rows[a], rows[b]))), 9)
        if s >= threshold:
            want[a, b] = s
    assert got == pytest.approx(want) and len(want) > len(queries)
    # The first of each by similarity, then query.
    few = {(r.asked, r.query) for r in semantic.similar(stored, stored.select(F.col("query").alias("asked")), threshold, 3).collect()}
    assert few == {(a, q) for a in queries for _, q in sorted((-s, q) for (x, q), s in want.items() if x == a)[:3]}


def test_no_key_holds_many_vectors(spark):
    """Words as in a text: the commonest is in every fourth query."""
    words = [f"w{i}" for i in range(2000)]
    queries = [(" ".join(rng.choices(words, weights=[1 / (i + 2) for i in range(2000)], k=4)),) for _ in range(3000)]
    stored = spark.createDataFrame(queries, "query string").withColumn("vector", vectors.vectorize(F.col("query")))
    keys = semantic.keyed(stored, "query", semantic._ranks(stored), 0.7)
    most = keys.groupBy("key").count().agg(F.max("count")).first()[0]
    bucket = stored.select(F.posexplode("vector")).where("col != 0").groupBy("pos").count().agg(F.max("count")).first()[0]
    assert most < 0.05 * 3000 and most < bucket / 4


@pytest.mark.parametrize("short", [2, 6])
def test_first_of_each_with_short_and_long_vectors(spark, monkeypatch, short):
    monkeypatch.setattr(semantic, "SHORT", short)
    words = [f"t{i}" for i in range(10)]
    queries = sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 4, 4, 5, 8, 9]))) for _ in range(250)})
    stored = spark.createDataFrame([(q,) for q in queries], "query string").withColumn("vector", vectors.vectorize(F.col("query")))
    rows = {r.query: r.vector for r in stored.collect()}
    got = {(r.asked, r.rank): (r.query, r.similarity) for r in semantic.similar(stored, stored.select(F.col("query").alias("asked")), 0.7, 5).collect()}
    want = {}
    for a in queries:
        near = sorted((-round(min(1.0, sum(x * y for x, y in zip(rows[a], rows[b]))), 9), b) for b in queries)
        want |= {(a, i + 1): (q, -s) for i, (s, q) in enumerate(near[:5]) if -s >= 0.7}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [v[1] for _, v in sorted(got.items())] == pytest.approx([v[1] for _, v in sorted(want.items())])


def test_rows_grow_with_the_queries_not_their_pairs(spark):
    """Queries of four words out of few: nearly all pairs share three buckets with hundreds of others."""
    words = [f"w{i}" for i in range(12)]
    made = sorted({" ".join(rng.sample(words, 4)) for _ in range(1500)})
    stored = spark.createDataFrame([(q,) for q in made], "query string").withColumn("vector", vectors.vectorize(F.col("query")))
    weights = semantic.checkpointed(stored.select("query", semantic._weights(F.col("vector")).alias("e")))
    parts = weights.select("query", F.explode(semantic._parts(F.col("e"), 0.7, False)).alias("p"))
    assert parts.count() <= 11 * len(made)
    got = semantic.similar(stored, stored.select(F.col("query").alias("asked")))
    assert got.count() == 5 * len(made)
