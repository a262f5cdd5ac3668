"""Queries of the container operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.packing import fill_report, pack
from loomstone.llm.texts import with_token_counts
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table


def _capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pack_capacity", "capacity_id", F.col("capacity_tokens").cast("long").alias("capacity"), "tokenizer").dropDuplicates(["capacity_id"])


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity."""
    capacities = _capacities(spark, sf_dir)
    names = sorted(r[0] for r in capacities.select("tokenizer").distinct().collect())  # a stated list of tokenizers
    if not names:
        return spark.createDataFrame([], "capacity_id long, container_id string, doc_id long, part_no int, first_token long, n_tokens long")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    sizes = cut(with_token_counts(docs, "text", names), "tokens")
    n = sizes.count()
    packed = [pack(sizes.select("doc_id", F.col(f"n_tokens_{i}").alias("n_tokens")), capacities.where(F.col("tokenizer") == name).select("capacity_id", "capacity"), n) for i, name in enumerate(names)]
    return reduce(DataFrame.unionByName, packed)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    return fill_report(p8_containers(spark, sf_dir), _capacities(spark, sf_dir).select("capacity_id", "capacity"))


QUERIES = {"p8_containers": p8_containers, "p8_report": p8_report}
