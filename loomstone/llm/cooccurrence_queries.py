"""Queries of the co-occurrence operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.cooccurrence import pair_counts, tag_set, with_lift
from loomstone.sources.tables import table

FIELDS = ("garments_tags", "material_tags", "embellishment_tags")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tags of an item, with counts and lift."""
    items = table(spark, sf_dir, "fashion_item", "id", *FIELDS).select("id", tag_set(*FIELDS).alias("tags")).dropDuplicates(["id"])
    counts = items.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_tag"))
    n = table(spark, sf_dir, "fashion_item", "id").where("id is not null").distinct().count()
    return with_lift(pair_counts(items, "tags", counts, n), counts, n)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are frequent and at least three times as frequent as by chance."""
    usual = "n >= 12 and n * 250 >= n_records and n * n_records >= 3 * n_a * n_b"
    return p4_pairs(spark, sf_dir).where(usual).select("tag_a", "tag_b")


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}

_SQL = """
WITH raw AS (
  SELECT DISTINCT id, unnest(list_concat(list_concat(coalesce(garments_tags, []), coalesce(material_tags, [])), coalesce(embellishment_tags, []))) AS t
  FROM fashion_item),
tags AS (SELECT DISTINCT id, lower(trim(t)) AS t FROM raw WHERE trim(t) <> ''),
n AS (SELECT count(DISTINCT id) AS n_records FROM fashion_item),
c AS (SELECT t, count(*) AS k FROM tags GROUP BY t),
p AS (SELECT a.t AS tag_a, b.t AS tag_b, count(*) AS n FROM tags a JOIN tags b ON a.id = b.id AND a.t < b.t GROUP BY 1, 2),
q AS (
  SELECT tag_a, tag_b, n, x.k AS n_a, y.k AS n_b, n_records, n * n_records::DOUBLE / (x.k * y.k) AS lift
  FROM p JOIN c x ON x.t = tag_a JOIN c y ON y.t = tag_b CROSS JOIN n)
"""
ORACLES = {
    "p4_found": _SQL + "SELECT tag_a, tag_b FROM q WHERE n >= 12 AND n * 250 >= n_records AND n * n_records >= 3 * n_a * n_b",
    "p4_pairs": _SQL + "SELECT tag_a, tag_b, n, n_a, n_b, n_records, lift FROM q",
}
