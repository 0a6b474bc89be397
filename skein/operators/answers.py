"""Answers of sources to queries, merged in the order in which they came.

answers: query_id, engine, ts, seq (when it came; equal times by seq), outcome
(success, failure or timeout), elapsed_ms and items, an array of title, url and
content. An answer without items counts as one of no results, whatever its
outcome says, and has no part in the merge; nor has a failed one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.aggregate import aggregate_queries
from skein.operators.scan import running

ANSWER = "query_id bigint, engine string, ts bigint, seq bigint, outcome string, elapsed_ms bigint, items array<struct<title:string,url:string,content:string>>"


def _has_results() -> Column:
    return (F.col("outcome") == "success") & (F.coalesce(F.size("items"), F.lit(0)) > 0)


def with_results(answers: DataFrame) -> DataFrame:
    return answers.where(_has_results())


def in_order(answers: DataFrame) -> DataFrame:
    """Answers with results and engine_ord, their number in their query, from 0, as they came."""
    came = [F.asc("ts"), F.asc("seq"), F.asc("engine")]
    return running(with_results(answers), ["query_id"], came, {"engine_ord": F.lit(1)}).withColumn("engine_ord", F.col("engine_ord") - 1)


def merged(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """Items of each query, standardised, each URL once (of the answer that came first), scored; queries: query_id, query."""
    items = in_order(answers).select("query_id", F.col("engine").alias("engine_name"), "engine_ord", F.posexplode("items").alias("pos", "x"))
    return aggregate_queries(items.select("query_id", "engine_name", "engine_ord", "pos", "x.*"), queries)


def engines_used(answers: DataFrame) -> DataFrame:
    """query_id, engine and engine_ord of the sources that gave results, as they came."""
    return in_order(answers).select("query_id", "engine", "engine_ord")


def calls(answers: DataFrame) -> DataFrame:
    """The answers as calls of operators.state: empty ones are zero; timeouts leave a source's state as it is."""
    outcome = F.when(_has_results(), "success").when(F.col("outcome") == "success", "zero").when(F.col("outcome") == "failure", "failure")
    return answers.select("engine", "ts", "seq", outcome.alias("outcome"), F.col("elapsed_ms").alias("response_ms")).where("outcome is not null")


def counters(answers: DataFrame) -> DataFrame:
    """total_searches, engine_failures and timeouts. (Where results come one by one an error is counted twice and a timeout
    in both; this counts each once.)"""
    n = lambda o: F.count_if(F.col("outcome") == o).cast("bigint")
    return answers.agg(F.countDistinct("query_id").alias("total_searches"), n("failure").alias("engine_failures"), n("timeout").alias("timeouts"))
