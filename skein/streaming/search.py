"""Results of sources as they come, and the final answer: see operators.answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skein.operators import answers

#: Files of each micro-batch, by its number, so that a batch that is run again replaces itself.
BATCH = "batch"


def incremental(stream: DataFrame, folder: str, checkpoint: str, on_results: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Hands the answers with results of each micro-batch to on_results, and keeps all answers in ``folder``.

    A batch that is run again after a failure is written over what its first
    run left, so that nothing is kept twice; on_results may see it again, with
    the same number.
    """

    def batch(df: DataFrame, number: int) -> None:
        at = f"{folder}/{BATCH}={number}"
        df.write.mode("overwrite").parquet(at)
        if on_results is not None:
            on_results(answers.with_results(df.sparkSession.read.schema(df.schema).parquet(at)), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def kept(like: DataFrame, folder: str) -> DataFrame:
    """All answers that ``incremental`` has kept; like: a DataFrame of their columns."""
    return like.sparkSession.read.schema(like.schema).option("basePath", folder).parquet(f"{folder}/{BATCH}=*").select(*like.columns)


def final(like: DataFrame, folder: str, queries: DataFrame) -> DataFrame:
    """The merged and scored items of each query, once its sources have answered."""
    return answers.merged(kept(like, folder), queries)


def counters(like: DataFrame, folder: str) -> DataFrame:
    return answers.counters(kept(like, folder))


