"""Views of the archive's tables that the reference operators' queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.paths import same_path
from loomstone.sources.tables import table


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Items, each once; repeated deliveries differ in their loading time only."""
    return table(spark, sf_dir, "fashion_item", *dict.fromkeys(("id", *columns))).dropDuplicates(["id"])


def images(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Images with a vector that isn't all zero, each once, by comparable path."""
    rows = table(spark, sf_dir, "image_embedding", *dict.fromkeys(("id", "path", "embedding", *columns)))
    rows = rows.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("path", same_path(F.col("path"))).dropDuplicates(["id"])


#: The same views in SQL.
ITEMS_SQL = "items AS (SELECT DISTINCT ON (id) * EXCLUDE (loaded_at) FROM fashion_item)"
PATH_SQL = "regexp_replace(regexp_replace(trim({}), '[\\\\/]+', '/', 'g'), '^(\\./)+', '')"
IMAGES_SQL = (
    "images AS (SELECT DISTINCT ON (id) id, filename, season, text, embedding::DOUBLE[] AS v, "
    + PATH_SQL.format("path")
    + " AS path FROM image_embedding WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"
)
#: The signs of a vector's 64 components as a long, as vectors.sign_hash() packs them.
_BITS = "(" + " + ".join(f"(CASE WHEN v[{i}] > 0 THEN 1::HUGEINT << {64 - i} ELSE 0 END)" for i in range(1, 65)) + ")"
HASH_SQL = f"({_BITS} - CASE WHEN v[1] > 0 THEN 1::HUGEINT << 64 ELSE 0 END)::BIGINT"
