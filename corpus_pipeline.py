"""A corpus pipeline: quality, near-duplicates, benchmark leaks, privacy, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of its input; its result is written as
Parquet and read again as the next one's `docs`. `run` applies them to the documents, with tables in the shared folder
in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motecraft.llm import decontamination, kneser_ney, mixing, simhash_ball, surrogates
from motecraft.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's quantile stay."""
    return kneser_ney.judge(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_ball.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return surrogates.replace(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: each document as often as it is taken."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("privacy", privacy), ("mixture", mixture)]
#: SQL can't express SimHash over XXH64, nor the model's perplexity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
