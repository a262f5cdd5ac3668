"""Queries of the encoding repair operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.encoding import context_counts, learn, restore
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table

FIELDS = ("description", "materials")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "fashion_item", "id", *FIELDS)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])
    items = items.select(F.lit("fashion_item").alias("table_name"), F.col("id").alias("row_id"), F.explode(pairs).alias("t")).select("table_name", "row_id", "t.field_name", "t.text")
    terms = table(spark, sf_dir, "ontology_term", "term_id", "list_name", "term").where("list_name = 'external_seed_keywords'")
    terms = terms.select(F.lit("ontology_term").alias("table_name"), F.col("term_id").alias("row_id"), F.col("list_name").alias("field_name"), F.col("term").alias("text"))
    return items.unionByName(terms).where("text is not null").withColumn("source", F.concat_ws(".", "table_name", "field_name"))


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values with the original text, as far as it can be restored."""
    texts = _texts(spark, sf_dir)
    cipher = learn(cut(context_counts(texts), "contexts"))
    found = restore(texts, cipher, "table_name", "row_id", "field_name")
    return found.dropDuplicates(["table_name", "row_id", "field_name"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with text that was read in the wrong encoding."""
    return p7_restored(spark, sf_dir).select("table_name", "row_id", "field_name")


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
