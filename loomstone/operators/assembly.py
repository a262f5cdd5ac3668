"""Assembly of item rows: cleaned records, flattened outfits, sheets' fields, model results and clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.paths import basename, parent_name
from loomstone.functions.repair import clean_key, clean_value, known_repair
from loomstone.functions.text import shorten, squeeze, year_of

#: The fields of a sheet, and the tag lists of an item.
SHEET_FIELDS = ["season", "label", "acquisition", "look", "file", "inventory", "object", "source", "description", "exhibitions", "size", "materials", "present_location", "remark", "bibliography", "designer", "working_process", "condition", "collection", "year"]
TAG_FIELDS = ["garments_tags", "colors_tags", "material_tags", "patterns_tags", "silhouette_tags", "length_tags", "neckline_tags", "sleeve_tags", "closure_tags", "embellishment_tags", "style_tags"]
#: How many tags of a list an item with a sheet keeps, and one without.
WITH_SHEET, WITHOUT_SHEET = 10, 5


def without(rows: DataFrame, *columns: str) -> DataFrame:
    """All columns but some, whether they exist or not."""
    return rows.drop(*columns)


def flattened(rows: DataFrame, struct: str, lifted: dict[str, str] | None = None) -> DataFrame:
    """A struct's fields as columns beside the others; `lifted` takes further nested fields up as `{column: path}`.

    A field whose name an outer column has already gets the struct's name in front. A null struct
    gives null fields.
    """
    own = [c for c in rows.columns if c != struct]
    taken = set(own) | set(lifted or {})
    inner = [F.col(f"`{struct}`.`{f.name}`").alias(f"{struct}_{f.name}" if f.name in taken else f.name) for f in rows.schema[struct].dataType.fields]
    return rows.select(*[F.col(f"`{c}`") for c in own], *inner, *[F.col(p).alias(c) for c, p in (lifted or {}).items()])


def cleaned_records(rows: DataFrame, key: str, flag: str = "cleaned", repairs: dict[tuple[str, str], str] | None = None, check: bool = True) -> DataFrame:
    """Every text cleaned, empty ones null, the key as a comparison key, and whether anything differs from before.

    Values that aren't texts stay. With `check`, keys that become equal are an error when the
    result is computed; the count of a key is taken with a window over the key.
    """
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    new = {c: F.nullif(known_repair(c, clean_value(F.col(c)), repairs or {}), F.lit("")) for c in texts}
    out = rows.withColumns({f"_{c}": v for c, v in new.items()} | {"_key": clean_key(F.col(key))})
    differs = [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts] + [~F.col(key).eqNullSafe(F.col("_key"))]
    out = out.withColumn(flag, reduce(lambda a, b: a | b, differs))
    out = out.select(F.col("_key").alias(key), *[F.col(f"_{c}").alias(c) if c in texts else F.col(c) for c in rows.columns if c != key], flag)
    return unique_keys(out, key) if check else out


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows, or an error that names a key of several rows. Counts are aggregated before they are shuffled."""
    twice = rows.groupBy(key).count().where("count > 1").agg(F.min(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("k"))
    message = F.concat(F.lit("several rows have the key "), F.col("k"))
    checked = twice.select(F.when(F.col("k").isNotNull(), F.raise_error(message)).cast("boolean").alias("_never"))
    return rows.crossJoin(F.broadcast(checked)).where(F.col("_never").isNull()).drop("_never")  # one row


def season_of_cluster(cluster: Column) -> Column:
    """The part of a cluster's id before `_outfit_` or `_cluster_`; null if there is none."""
    return F.nullif(F.regexp_extract(cluster, r"^(.+?)_(?:outfit|cluster)_", 1), F.lit(""))


def outfit_of_cluster(cluster: Column) -> Column:
    """The outfit number in a cluster's id, or null."""
    return F.nullif(F.regexp_extract(cluster, r"_outfit_([^_]+)", 1), F.lit(""))


def season_of_file(name: Column) -> Column:
    """`FWyyyy-yyyy`, `FWyyyy` or `SSyyyy` from the last tokens but two and one of a file name such as `x_1986-87_fw_all.json`; else the year token."""
    tokens = F.split(F.regexp_replace(basename(name), r"\.json$", ""), "_")
    year, season = F.try_element_at(tokens, F.lit(-3)), F.lower(F.try_element_at(tokens, F.lit(-2)))
    start, end = F.split_part(year, F.lit("-"), F.lit(1)), F.split_part(year, F.lit("-"), F.lit(2))
    winter = F.when(end != "", F.concat(F.lit("FW"), start, F.lit("-"), F.substring(start, 1, 2), end)).otherwise(F.concat(F.lit("FW"), year))
    return F.when(season == "fw", winter).when(season == "ss", F.concat(F.lit("SS"), year)).otherwise(year)


def chosen_outfits(rows: DataFrame, key: str, wanted: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Only the wanted outfits, if any are named, and at most so many in the order of their numbers."""
    if wanted:
        rows = rows.where(F.col(key).isin(wanted))
    return rows.orderBy(F.length(key), key).limit(most) if most else rows


def sheet_fields(entry: Column | None) -> list[Column]:
    """The twenty fields of a sheet's struct, white space squeezed and blank ones null; without an entry all are null."""
    if entry is None:
        return [F.lit(None).cast("string").alias(f) for f in SHEET_FIELDS]
    return [squeeze(F.replace(entry[f].cast("string"), F.lit(" "), F.lit(" "))).alias(f) for f in SHEET_FIELDS]


def sheet_payload(entry: Column) -> Column:
    """A sheet as JSON text, with its nulls."""
    return F.to_json(F.struct(*[entry[f].alias(f) for f in SHEET_FIELDS]), {"ignoreNullFields": "false"})


#: The answer a model gives for a cluster: one element per image.
ANSWER = "struct<images_metadata:array<struct<source_path:string,llm_description:string," + ",".join(f"{t}:array<string>" for t in TAG_FIELDS) + ">>>"


def first_sheet(clusters: DataFrame, sheets: DataFrame) -> DataFrame:
    """`(cluster_id, entry)`: of each cluster the first sheet, in the order of its paths, that its season has by file name.

    `clusters` has `(cluster_id, season, pdf_paths)`, `sheets` `(season, pdf, entry)`, the last of
    equal ones by `seq` if that column exists.
    """
    if "seq" in sheets.columns:
        sheets = sheets.groupBy("season", "pdf").agg(F.max_by("entry", "seq").alias("entry"))
    each = clusters.select("cluster_id", "season", F.posexplode("pdf_paths").alias("pos", "path")).select("cluster_id", "season", "pos", basename(F.col("path")).alias("pdf"))
    return each.join(sheets, ["season", "pdf"]).groupBy("cluster_id").agg(F.min_by("entry", "pos").alias("entry"))


def split_by_presence(clusters: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clusters with only the images that exist, and the rejects with their reasons.

    A missing image is rejected as `missing_file`; a cluster without any image left as
    `no_existing_images_left_in_cluster`. `files` has `(path)`.
    """
    each = clusters.select("cluster_id", F.posexplode("image_paths").alias("pos", "source_path"))
    there = each.join(files.select(F.col("path").alias("source_path")).distinct().withColumn("there", F.lit(True)), "source_path", "left")
    kept = there.where("there").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source_path"))), lambda x: x["source_path"]).alias("kept"))
    both = clusters.join(kept, "cluster_id", "left")
    gone = there.where("there is null").select("cluster_id", "source_path", F.lit("missing_file").alias("reason"))
    empty = both.where("kept is null").select("cluster_id", F.lit(None).cast("string").alias("source_path"), F.lit("no_existing_images_left_in_cluster").alias("reason"))
    return both.where("kept is not null").drop("image_paths").withColumnRenamed("kept", "image_paths"), gone.unionByName(empty)


def assembled(clusters: DataFrame, entries: DataFrame, results: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row per image of a cluster, with 20 sheet fields, 11 tag lists and the cluster's own fields.

    `clusters`: `(cluster_id, season, outfit_id, pdf_status, image_paths)`; `entries`:
    `(cluster_id, entry)`; `results`: `(source_path, seq, llm_description, <tag lists>)`, of which
    the last of a path counts and unknown paths are ignored; `vocabulary`: one row with an array
    per tag list. Images without a result have empty tag lists; sheet fields are null unless the
    cluster's status says that there is a sheet.
    """
    last = results.groupBy("source_path").agg(F.max_by(F.struct("llm_description", *TAG_FIELDS), "seq").alias("r"))
    each = clusters.select("cluster_id", "season", "outfit_id", "pdf_status", F.explode("image_paths").alias("source_path"))
    backed = F.col("pdf_status").isin("available", "incomplete")
    rows = each.join(entries, "cluster_id", "left").join(last, "source_path", "left")
    rows = rows.crossJoin(F.broadcast(vocabulary.select(*[F.col(t).alias(f"v_{t}") for t in TAG_FIELDS]).limit(1)))
    entry = F.when(backed, F.col("entry"))
    tags = [F.when(backed, _kept(t, WITH_SHEET)).otherwise(_kept(t, WITHOUT_SHEET)).alias(t) for t in TAG_FIELDS]
    return rows.select(
        "source_path", F.lit("ALTA MODA").alias("collection_line"), F.nullif("season", F.lit("")).alias("season_path"), year_of(F.col("season")).alias("year_path"),
        parent_name(F.col("source_path")).alias("asset_type"), *sheet_fields(entry), *tags, shorten(squeeze(F.col("r")["llm_description"]), 320).alias("llm_description"),
        F.col("pdf_status").alias("pdf_available"), "cluster_id", "outfit_id",
    )


def _kept(field: str, most: int) -> Column:
    own = F.transform(F.coalesce(F.col("r")[field], F.array().cast("array<string>")), squeeze)
    return F.slice(F.array_distinct(F.filter(own, lambda t: t.isNotNull() & F.array_contains(F.col(f"v_{field}"), t))), 1, most)


def vocabulary_of(terms: DataFrame) -> DataFrame:
    """One row with an array per tag list, out of `(slot, list_no, pos, term)`: each slot's terms, squeezed, once, in order.

    A vocabulary is a reference list; it is gathered per slot.
    """
    first = terms.select("slot", squeeze(F.col("term")).alias("term"), F.struct("list_no", "pos").alias("at")).where("term is not null").groupBy("slot", "term").agg(F.min("at").alias("at"))
    lists = first.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))
    return lists.agg(*[F.coalesce(F.max(F.when(F.col("slot") == t, F.col("terms"))), F.array().cast("array<string>")).alias(t) for t in TAG_FIELDS])


def by_priority(exact: DataFrame, near: DataFrame, expanded: DataFrame, path: str, order: str) -> DataFrame:
    """One row per path out of three kinds of links, exact before near before expanded; within a kind the last exact and the first other one counts."""
    kinds = [("exact", exact), ("near", near), ("expanded", expanded)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("match_type", F.lit(k)).withColumn("_prio", F.lit(i)) for i, (k, df) in enumerate(kinds)])
    at = F.when(F.col("_prio") == 0, -F.col(order)).otherwise(F.col(order))
    w = Window.partitionBy(path).orderBy("_prio", at)
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_prio")
