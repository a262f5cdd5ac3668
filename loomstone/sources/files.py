"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.paths import basename, extension, parts, season_of_folder


def json_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """JSON lines with a stated schema, the file's name and the season it names; blank lines are passed over, unreadable ones come with `_corrupt_record`."""
    s = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if "_corrupt_record" not in s.fieldNames():
        s = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("mode", "PERMISSIVE").json(path).withColumn("file_name", F.col("_metadata.file_name")).withColumn("file_season", season_of_folder(F.col("file_name")))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds an array of objects, with or without a byte order mark."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """`(key, value)` of a file that is one object; of keys that repeat, the last wins."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>", {"mapKeyDedupPolicy": "LAST_WIN"}).alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of several paths that exists."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """`(name, text)` of text files, by name before the first dot."""
    return spark.read.text(path, wholetext=True).select(F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("name"), F.col("value").alias("text"))


#: The extensions of images.
IMAGES = ("jpg", "jpeg", "png", "gif", "webp")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """`(path, length, modificationTime)` of the files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def image_files(files: DataFrame, folder: str, season: str = r"(?i)^(?:fw|ss)[-_ ]?\d{4}") -> DataFrame:
    """Images below a folder of that name, in any case, with the season their path names, else `unknown`."""
    p = parts(F.col("path"))
    named = F.exists(F.slice(p, 1, F.size(p) - 1), lambda x: F.lower(x) == folder.lower())
    first = F.get(F.filter(p, lambda x: x.rlike(season)), F.lit(0))
    return files.where(extension(F.col("path")).isin(*IMAGES) & named).select("path", basename(F.col("path")).alias("filename"), F.coalesce(first, F.lit("unknown")).alias("season"))


def sparql_labels(text: Column) -> Column:
    """Labels of a SPARQL JSON result: the label's value, else the local name of the first address."""
    rows = F.from_json(text, "struct<results:struct<bindings:array<map<string,struct<type:string,value:string>>>>>")["results"]["bindings"]

    def label(b: Column) -> Column:
        address = F.get(F.filter(F.map_values(b), lambda v: v["value"].startswith("http")), F.lit(0))["value"]
        return F.coalesce(F.try_element_at(b, F.lit("label"))["value"], F.regexp_extract(address, r"([^/#]+)$", 1))

    return F.filter(F.transform(rows, label), lambda x: x.isNotNull())


def term_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """`(line_no, term)` of a term list, without blank lines, comments and the first `skip` lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "term"))
    return lines.select("line_no", F.trim("term").alias("term")).where((F.col("line_no") >= skip) & (F.col("term") != "") & ~F.col("term").startswith("#"))


TREE_KEYS = ("name", "label", "term", "value")


def tree_values(text: Column, keys: tuple[str, ...] = TREE_KEYS) -> Column:
    """Texts of the given keys, in any case, at any depth of a JSON document or of JSON lines, in order; what can't be parsed gives none.

    A walk of any depth is no expression: it is done in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def found(text: str | None) -> list[str]:
            out: list[str] = []
            for tree in _trees(text):
                todo = [tree]
                while todo:
                    node = todo.pop()
                    if isinstance(node, _Named):
                        out.append(node.text)
                    elif isinstance(node, dict):
                        inner = []
                        for k, v in node.items():
                            if k.lower() in keys and isinstance(v, str):
                                inner.append(_Named(v))
                            inner.append(v)
                        todo += reversed(inner)
                    elif isinstance(node, list):
                        todo += reversed(node)
            return out

        return texts.map(found, na_action=None)

    return walk(text)


class _Named:
    """A text to be taken when its turn comes."""

    def __init__(self, text: str):
        self.text = text


def _trees(text: str | None) -> list:
    """The document a text is, else those of its lines."""
    if not text:
        return []
    try:
        return [json.loads(text)]
    except (ValueError, RecursionError):
        out = []
        for line in text.splitlines():
            try:
                out.append(json.loads(line))
            except (ValueError, RecursionError):
                continue
        return out


def xml_terms(text: Column) -> Column:
    """Texts of literal elements and local names in attributes of an XML vocabulary, in order; of a document that can't be parsed those that patterns find."""

    @F.pandas_udf("array<string>")
    def read(texts: pd.Series) -> pd.Series:
        def found(text: str | None) -> list[str]:
            if not text:
                return []
            try:
                if "<!ENTITY" in text:
                    raise ElementTree.ParseError
                root = ElementTree.fromstring(text)
            except ElementTree.ParseError:
                literals = re.findall(r"<(?:\w+:)?(?:Literal|label|prefLabel|altLabel)[^>]*>([^<]+)<", text)
                return literals + [_local(x) for x in re.findall(r'(?:IRI|abbreviatedIRI|rdf:about|rdf:ID)="([^"]+)"', text)]
            out = []
            for e in root.iter():
                if isinstance(e.tag, str) and e.tag.rsplit("}", 1)[-1].lower() in ("literal", "label", "preflabel", "altlabel") and e.text and e.text.strip():
                    out.append(e.text)
                out += [_local(v) for v in e.attrib.values() if "#" in v or ":" in v]
            return out

        return texts.map(found, na_action=None)

    return read(text)


def _local(iri: str) -> str:
    return iri.rsplit("#", 1)[-1].rsplit("/", 1)[-1].rsplit(":", 1)[-1]


def without_suffix(rows: DataFrame, key: str, suffix: str = ".pdf") -> DataFrame:
    """The rows with a suffix stripped off their keys; of keys that become equal the last by the old key counts."""
    old = F.col(f"`{key}`")
    new = F.when(F.lower(old).endswith(suffix), F.substring(old, F.lit(1), F.length(old) - len(suffix))).otherwise(old)
    rest = [c for c in rows.columns if c != key]
    got = rows.withColumn("_new", new).groupBy("_new").agg(F.max_by(F.struct(*rest), key).alias("r"))
    return got.select(F.col("_new").alias(key), "r.*")


def pretty_json(rows: DataFrame, path: str, order: str, most: int = 100_000) -> None:
    """A small table as one JSON array in one file; more than `most` rows are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no single file")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rows.columns).alias("r")))), lambda x: x["r"])
    rows.agg(F.to_json(listed, {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_if_empty(rows: DataFrame, path: str, fields: list[str]) -> bool:
    """Write the known fields of the rows unless the table holds rows already; whether it wrote."""
    spark = rows.sparkSession
    if first_existing(spark, [path]) and not spark.read.parquet(path).isEmpty():
        return False
    rows.select([c for c in fields if c in rows.columns]).write.mode("overwrite").parquet(path)
    return True


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key isn't in the table yet, and return these."""
    from loomstone.plans.lineage import cut

    spark = rows.sparkSession
    if first_existing(spark, [path]):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    new = cut(rows, "new")  # the table is read for the anti join before it is appended to
    new.write.mode("append").parquet(path)
    return new


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that the rows touch and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rejects(rows: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key exists, and a report of the others with the reason."""
    keys = existing.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti").withColumn("reason", F.lit("missing_file"))
