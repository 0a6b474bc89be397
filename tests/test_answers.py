import os
import time

import pytest
from pyspark.sql import functions as F

from skein.operators import answers, state
from skein.streaming import search

ROWS = [
    (1, "slow", 50, 1, "success", 40, [("Slow one", "https://same.example", "x"), ("Slow two", "https://s.example/2", "y")]),
    (1, "fast", 10, 2, "success", 5, [("Fast one", "HTTPS://same.example ", "z")]),
    (1, "none", 5, 3, "success", 5, []),
    (1, "null", 5, 3, "success", 5, None),
    (1, "broken", 6, 4, "failure", 5, [("never", "https://n.example", "")]),
    (2, "late", 7, 5, "timeout", 60000, None),
    (2, "fast", 20, 6, "success", 5, [("Two", "https://t.example", "two words")]),
    (3, "fast", 20, 7, "success", 5, [("Nobody asked", "https://q.example", "")]),
]


def test_merge_in_the_order_of_answers(spark):
    df = spark.createDataFrame(ROWS, answers.ANSWER).repartition(3)
    queries = spark.createDataFrame([(1, "one"), (2, "two words"), (9, "no answers")], "query_id bigint, query string")
    assert {(r.query_id, r.engine, r.engine_ord) for r in answers.engines_used(df).collect()} == {(1, "fast", 0), (1, "slow", 1), (2, "fast", 0), (3, "fast", 0)}
    got = {(r.query_id, r.position, r.title, r.engine_name) for r in answers.merged(df, queries).collect()}
    assert got == {(1, 0, "Fast one", "fast"), (1, 1, "Slow two", "slow"), (2, 0, "Two", "fast")}
    assert tuple(answers.counters(df).first()) == (3, 1, 1)
    folded = {r.engine: (r.total, r.ok, r.failed, r.consecutive) for r in state.fold(answers.calls(df)).collect()}
    assert folded == {"fast": (3, 3, 0, 0), "slow": (1, 1, 0, 0), "none": (0, 0, 0, 1), "null": (0, 0, 0, 1), "broken": (1, 0, 1, 1)}


def test_stream_with_a_batch_that_is_run_again(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "kept", "c"))
    for n in range(3):
        spark.createDataFrame(ROWS[3 * n : 3 * n + 3], answers.ANSWER).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    like = spark.read.parquet(source)
    queries = spark.createDataFrame([(1, "one"), (2, "two words")], "query_id bigint, query string")
    seen = []

    def run():
        stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = search.incremental(stream, folder, checkpoint, lambda df, n: seen.append((n, sorted(r.engine for r in df.collect()))))
        q.processAllAvailable()
        q.stop()

    run()
    assert [n for n, _ in seen] == [0, 1, 2] and sorted(e for _, x in seen for e in x) == ["fast", "fast", "fast", "slow"]
    for name in ("2", ".2.crc"):
        os.remove(f"{checkpoint}/commits/{name}")  # as if the driver had been lost before it could say that batch 2 is done
    run()
    assert seen[3] == seen[2]
    cells = lambda df: sorted((r.query_id, r.position, r.url, round(r.score, 9)) for r in df.collect())
    assert search.kept(like, folder).count() == len(ROWS)
    assert cells(search.final(like, folder, queries)) == cells(answers.merged(like, queries))
    assert search.counters(like, folder).first() == answers.counters(like).first()


@pytest.mark.parametrize("rows", [[], ROWS[2:6]])
def test_no_results(spark, rows):
    df = spark.createDataFrame(rows, answers.ANSWER)
    assert answers.merged(df, spark.createDataFrame([(1, "one")], "query_id bigint, query string")).where(F.col("query_id") == 1).count() == 0
