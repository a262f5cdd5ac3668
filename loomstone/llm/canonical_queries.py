"""Queries of the canonical term operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.canonical import attached, match_values
from loomstone.operators.packed import FIELDS as PACKED
from loomstone.operators.packed import unpack
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed value `(table_name, row_id, field_name, slot, value)`."""
    items = table(spark, sf_dir, "fashion_item", "id", "materials", "object")
    materials = unpack(items, "id", {"materials": PACKED["materials"]}).select("id", "field_name", F.lit("materials").alias("slot"), F.col("item_value").alias("value"))
    objects = items.where("object <> ''").select("id", F.lit("object").alias("field_name"), F.lit("garments").alias("slot"), F.col("object").alias("value"))
    terms = table(spark, sf_dir, "ontology_term", "term_id", "slot", "list_name", "term").where("list_name = 'archive_keywords' and term <> ''")
    terms = terms.select(F.lit("ontology_term").alias("table_name"), F.col("term_id").alias("row_id"), F.col("list_name").alias("field_name"), "slot", F.col("term").alias("value"))
    fashion = materials.unionByName(objects).select(F.lit("fashion_item").alias("table_name"), F.col("id").alias("row_id"), "field_name", "slot", "value")
    return fashion.unionByName(terms)


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "canonical_term", "ref_id", "slot", "term", "term_it")
    return entries.select("ref_id", "slot", F.explode(F.array("term", "term_it")).alias("form"))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    typed = cut(_typed(spark, sf_dir).distinct(), "typed")
    return typed, cut(match_values(typed, _reference(spark, sf_dir)), "matched"), typed.count()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry each inexactly typed value means, 0 for none."""
    typed, matched, n = _matched(spark, sf_dir)
    return attached(typed, matched, n).select("table_name", "row_id", "field_name", "ref_id").distinct()


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values that mean no entry, with the number of their uses."""
    typed, matched, n = _matched(spark, sf_dir)
    rows = attached(typed, matched.where("ref_id = 0"), n).select("slot", "value", "score", "table_name", "row_id", "field_name").distinct()
    return rows.groupBy("slot", "value", "score").agg(F.count("*").alias("n_rows"))


QUERIES = {"p6_found": p6_found, "p6_unmatched": p6_unmatched}
