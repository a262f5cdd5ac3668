"""Queries of the term frequency operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.termfreq import ngram_counts, term_counts, with_verdict
from loomstone.sources.tables import table

FIELDS = ("garments_tags", "colors_tags")


def _tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "fashion_item", "id", *FIELDS).dropDuplicates(["id"])
    clean = [
        F.struct(F.lit(f).alias("field_name"), F.filter(F.transform(f, lambda t: F.lower(F.trim(t))), lambda t: t != "").alias("terms"))
        for f in FIELDS
    ]
    return items.select(F.col("id").alias("record"), F.explode(F.array(*clean)).alias("f")).select("f.field_name", "record", "f.terms")


def _keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "ontology_term", "term_id", "edition", "list_name", "term").where("list_name = 'archive_keywords'")
    terms = terms.dropDuplicates(["term_id"]).withColumn("term", F.lower(F.trim("term"))).where("term <> ''")
    return terms.select(F.col("list_name").alias("field_name"), F.col("edition").alias("record"), F.array("term").alias("terms"))


def p5_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag and keyword with its counts and whether it is rare, common or useful."""
    n_items = table(spark, sf_dir, "fashion_item", "id").where("id is not null").distinct().count()
    n_editions = table(spark, sf_dir, "ontology_term", "edition").where("edition is not null").distinct().count()
    tags = term_counts(_tag_rows(spark, sf_dir), whole_records=True)
    keywords = term_counts(_keyword_rows(spark, sf_dir), whole_records=False)
    return with_verdict(tags.unionByName(keywords), {f: n_items for f in FIELDS} | {"archive_keywords": n_editions})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p5_terms(spark, sf_dir).where("verdict <> 'useful'").select("field_name", "term", "verdict")


def p5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All n-grams of words within tags and keywords."""
    keywords = ngram_counts(_keyword_rows(spark, sf_dir), whole_records=False)
    return ngram_counts(_tag_rows(spark, sf_dir)).unionByName(keywords)


QUERIES = {"p5_found": p5_found, "p5_terms": p5_terms, "p5_ngrams": p5_ngrams}

_SQL = """
WITH t AS (
  SELECT DISTINCT ON (id) id, garments_tags, colors_tags FROM fashion_item),
k AS (SELECT DISTINCT term_id, edition, lower(trim(term)) AS term FROM ontology_term WHERE list_name = 'archive_keywords' AND trim(term) <> ''),
x AS (
  SELECT 'garments_tags' AS field_name, id::VARCHAR AS record, lower(trim(g)) AS term FROM (SELECT id, unnest(garments_tags) AS g FROM t) WHERE trim(g) <> ''
  UNION ALL SELECT 'colors_tags', id::VARCHAR, lower(trim(g)) FROM (SELECT id, unnest(colors_tags) AS g FROM t) WHERE trim(g) <> ''
  UNION ALL SELECT 'archive_keywords', edition, term FROM k),
c AS (SELECT field_name, term, count(*)::BIGINT AS n_occurrences, count(DISTINCT record)::BIGINT AS n_records FROM x GROUP BY 1, 2),
v AS (
  SELECT *, CASE WHEN n_records <= 2 THEN 'rare'
    WHEN n_records * 5 > CASE WHEN field_name = 'archive_keywords' THEN (SELECT count(DISTINCT edition) FROM ontology_term) ELSE (SELECT count(DISTINCT id) FROM fashion_item) END THEN 'common'
    ELSE 'useful' END AS verdict FROM c)
"""
_GRAMS = """
, w AS (SELECT field_name, record, string_split(term, ' ') AS w FROM x),
g AS (SELECT field_name, record, w, unnest(range(1, len(w) + 1)) AS n FROM w),
h AS (SELECT field_name, record, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM g))
SELECT field_name, n::INT AS n, gram, count(*)::BIGINT AS n_occurrences, count(DISTINCT record)::BIGINT AS n_records FROM h GROUP BY 1, 2, 3
"""
ORACLES = {
    "p5_ngrams": _SQL + _GRAMS,
    "p5_found": _SQL + "SELECT field_name, term, verdict FROM v WHERE verdict <> 'useful'",
    "p5_terms": _SQL + "SELECT field_name, term, n_occurrences, n_records, verdict FROM v",
}
