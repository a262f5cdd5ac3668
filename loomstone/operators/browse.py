"""Browsing items: facets, feed with one card per cluster, detail and cluster views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.paths import title
from loomstone.functions.text import is_blank
from loomstone.operators.predicates import FilterSpec


def facet(items: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values of a text column, or elements of an array column."""
    source = F.explode(column) if dict(items.dtypes)[column].startswith("array") else F.col(column)
    return items.select(source.alias("value")).where("value <> ''").distinct()


def cluster_key(status: Column, cluster: Column, key: Column) -> Column:
    """Items without a document, or not clustered yet, stand alone; others share their cluster's key. The two kinds can't collide."""
    alone = F.coalesce(status == "missing", F.lit(True)) | cluster.isNull()
    return F.struct(alone.alias("alone"), F.when(alone, key.cast("string")).otherwise(cluster).alias("key"))


def one_per_cluster(items: DataFrame) -> DataFrame:
    """The first item of each cluster by path and id. Filters belong before this step: the representative is the first matching item."""
    w = Window.partitionBy(cluster_key(F.col("pdf_available"), F.col("cluster_id"), F.col("id"))).orderBy("source_path", "id")
    return items.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def cards(items: DataFrame, url: Column) -> DataFrame:
    return items.select("id", title(F.col("source_path")).alias("title"), url.alias("url"), "source_path")


def feed(items: DataFrame, spec: FilterSpec) -> DataFrame:
    return one_per_cluster(items.where(spec.condition()))


def page(rows: DataFrame, limit: int = 24, offset: int = 0, seed: int | None = None) -> DataFrame:
    """A page in the order of ids, or in a random order that stays the same for a seed."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    order = [F.xxhash64(F.lit(seed), F.col("id"))] if seed is not None else []
    return rows.orderBy(*order, "id").offset(offset).limit(limit)


def page_state(page_rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """Whether more may follow (true on an exactly full last page) and the next offset."""
    return page_rows.agg(F.count("*").alias("n_items")).select("n_items", (F.col("n_items") == limit).alias("has_more"), F.lit(offset + limit).alias("next_offset"))


def detail(items: DataFrame, path: str, fallback: bool = True) -> DataFrame:
    """The item of a path; with `fallback`, else the item of the least id."""
    hit = items.where(F.col("source_path") == path).withColumn("_prio", F.lit(0))
    if fallback:
        hit = hit.unionByName(items.orderBy("id").limit(1).withColumn("_prio", F.lit(1)))
    return hit.orderBy("_prio", "id").limit(1).drop("_prio")


def cluster_views(items: DataFrame, path: str) -> DataFrame:
    """All items with a document that share the item's cluster, or the item alone if it has none."""
    anchor = items.where(F.col("source_path") == path).orderBy("id").limit(1)
    alone = F.coalesce(F.col("pdf_available") == "missing", F.lit(True)) | F.col("cluster_id").isNull()
    mates = items.where(F.col("pdf_available") != "missing").join(F.broadcast(anchor.where(~alone).select("cluster_id")), "cluster_id", "left_semi")
    return mates.unionByName(anchor.where(alone)).orderBy("source_path", "id")


def heading(items: DataFrame) -> DataFrame:
    """Heading and description of an item: the first field with text; a description that comes from a model is marked."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    fields = [text(c) for c in ("object", "file", "look", "label")]
    line = F.concat_ws(" ", text("collection_line"), text("season"))
    archival = text("description")
    return items.select(
        "id", F.coalesce(*fields, line).alias("heading"), F.coalesce(archival, text("llm_description")).alias("body"),
        (archival.isNull() & ~is_blank(F.col("llm_description"))).alias("by_model"),
        F.coalesce(text("season_path"), text("season")).alias("season_shown"), F.coalesce(text("year_path"), text("year")).alias("year_shown"),
    )
