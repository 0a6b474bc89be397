"""A corpus pipeline of five stages, each on what the one before kept.

Edge cases, for all stages: an empty table stays empty; rows that repeat a
doc_id are each decided for, and copies of a row alike; further columns pass
through whatever their names, also those that the operators give to results.

language_id drops null and empty texts, as they have no letters; line_dedup
leaves rows without doc_id alone; near_duplicates keeps rows without doc_id,
and all rows of the doc_id that stays; mix_sources serves a null source as a
source of its own; pack returns the pieces with a null doc_id as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import jaccard, langid, linededup, mixing, packing
from skein.llm.common import table
from skein.llm.queries import WEIGHTS, tokenizer_path
from skein.operators.scan import work_folder

#: Documents below this score are taken to be of no known language.
LEAST_SCORE = 0.35


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that an operator reads, and the others in one, so that no name clashes and no text is sent twice."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in ("doc_id", "text")]).alias("_row"))


def _unpacked(packed: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    known = {"doc_id": F.col("doc_id"), "text": F.col("text")} | made
    return packed.select(*[known.get(c, F.col("_row")[c]).alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without letters or of no clear language go."""
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.predict(_packed(docs), model)
    return _unpacked(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one; what has no words left goes."""
    found = linededup.dedup_lines(_packed(docs))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _unpacked(found.where((F.col("n_removed") == 0) | words), docs.columns, n_chars=F.length("text").cast("bigint"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix serves them, in its order; empty ones are served no time."""
    return mixing.queue(docs, WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences."""
    return packing.pack(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Shingle sets, trained models and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
