"""Queries of the unwanted-language operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.toxicity import Bounds, fit_on, score
from loomstone.sources.tables import table


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return score(docs, fit_on(docs, table(spark, sf_dir, "doc_label", "doc_id", "toxic")), "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexually explicit language."""
    return _scores(spark, sf_dir).where(F.col("score") > Bounds().threshold).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    return _scores(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents, unwanted ones and their rate."""
    bad = F.count_if(F.col("score") > Bounds().threshold)
    return _scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), bad.alias("n_unwanted"), (bad / F.count("*")).alias("rate"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
