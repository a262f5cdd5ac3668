"""Queries of the language operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.langid import Bounds, Model, fit_on, label_language, mislabelled, segments
from loomstone.sources.tables import table

FIELDS = ("description", "remark", "working_process")


def _item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "fashion_item", "id", *FIELDS)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in FIELDS])
    return items.select(F.col("id").alias("row_id"), F.explode(pairs).alias("t")).select("row_id", "t.field_name", "t.text").where("text <> ''")


def _item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "item_text_lang").dropDuplicates(["id"])
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_lang").alias("label")) for f in FIELDS])
    return labels.select(F.col("id").alias("row_id"), F.explode(pairs).alias("t")).select("row_id", "t.field_name", "t.label")


def _document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("row_id"), F.lit("text").alias("field_name"), "text").where("text <> ''")


def _document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "lang").select(F.col("doc_id").alias("row_id"), F.lit("text").alias("field_name"), F.col("lang").alias("label"))


def _model(spark: SparkSession, sf_dir: str, bounds: Bounds = Bounds()) -> Model | None:
    """Fit on a bounded sample, by hash, of labelled documents and labelled item texts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("lang", label_language(F.col("lang")))
    docs = docs.where("lang is not null and text <> ''").orderBy(F.xxhash64("doc_id")).limit(bounds.rows).select("text", "lang")
    some = _item_labels(spark, sf_dir).withColumn("lang", label_language(F.col("label"))).where("lang is not null")
    some = some.orderBy(F.xxhash64("row_id", "field_name")).limit(bounds.rows).select("row_id", "field_name", "lang")
    items = _item_texts(spark, sf_dir).join(F.broadcast(some), ["row_id", "field_name"]).select("text", "lang")
    return fit_on([docs, items], bounds)


def _all_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    model = _model(spark, sf_dir)
    items = segments(_item_texts(spark, sf_dir), model).dropDuplicates(["row_id", "field_name", "seg_no"])
    return items, segments(_document_texts(spark, sf_dir), model)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the texts whose label is missing or wrong or which mix languages."""
    items, docs = _all_segments(spark, sf_dir)
    columns = ("row_id", "field_name", "seg_no", "lang")
    a = mislabelled(items, _item_labels(spark, sf_dir)).select(F.lit("fashion_item").alias("table_name"), *columns)
    b = mislabelled(docs, _document_labels(spark, sf_dir)).select(F.lit("documents").alias("table_name"), *columns)
    return a.unionByName(b)


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and confidence."""
    items, docs = _all_segments(spark, sf_dir)
    return items.select(F.lit("fashion_item").alias("table_name"), "*").unionByName(docs.select(F.lit("documents").alias("table_name"), "*"))


QUERIES = {"p1_found": p1_found, "p1_segments": p1_segments}
