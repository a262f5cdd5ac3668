"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.packed import FIELDS, unpack
from loomstone.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the fields that hold two or more."""
    return unpack(table(spark, sf_dir, "fashion_item", "id", *FIELDS), "id", FIELDS, least=2)


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items have how many values in a field."""
    values = unpack(table(spark, sf_dir, "fashion_item", "id", *FIELDS), "id", FIELDS)
    per_item = values.groupBy("field_name", "id").agg(F.count("*").alias("n_values"))
    return per_item.groupBy("field_name", "n_values").agg(F.count("*").alias("n_items"))


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
