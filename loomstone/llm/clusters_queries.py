"""Queries of the similarity clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.clusters import cluster, described, pairs_within, usable
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table

DIMS = 64


def same_path(path: str) -> Column:
    """A path with one spelling of separators, without a leading `./` and outer blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(path), r"[\\/]+", "/"), r"^(?:\./)+", "")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(id, vec)`: each item's image vector."""
    images = table(spark, sf_dir, "image_embedding", "path", "embedding").where(usable("embedding"))
    images = images.select(same_path("path").alias("path"), F.col("embedding").alias("vec")).where("path <> ''").dropDuplicates(["path"])
    items = table(spark, sf_dir, "fashion_item", "id", "source_path").select("id", same_path("source_path").alias("path")).where("id is not null and path <> ''")
    return items.dropDuplicates(["id"]).join(images, "path").select("id", "vec")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items whose images belong to the same cluster."""
    vectors = cut(_vectors(spark, sf_dir), "vectors")
    return pairs_within(vectors, cluster(vectors))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its size, its medoid and its most typical items."""
    vectors = cut(_vectors(spark, sf_dir), "vectors")
    out = described(vectors, cluster(vectors).members, DIMS)
    return out.withColumn("typical_items", F.array_join(F.transform("typical_items", lambda i: i.cast("string")), " "))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with an image and its cluster."""
    return cluster(cut(_vectors(spark, sf_dir), "vectors")).members


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters, "p2_members": p2_members}

_PATH = "regexp_replace(regexp_replace(trim({}), '[\\\\/]+', '/', 'g'), '^(\\./)+', '')"
ORACLES = {
    "p2_found": f"""
WITH img AS (
  SELECT {_PATH.format('path')} AS p, any_value(embedding::DOUBLE[]) AS e FROM image_embedding
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
it AS (SELECT DISTINCT id, {_PATH.format('source_path')} AS p FROM fashion_item WHERE source_path IS NOT NULL),
v AS (SELECT id, e FROM it JOIN img USING (p))
SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id AND list_cosine_distance(a.e, b.e) <= 0.12
"""
}
