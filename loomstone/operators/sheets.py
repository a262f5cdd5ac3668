"""Fields and images of parsed sheets: layout lines to fields, images to sections, and the fields' clean-up.

The inputs are parsed values: spans `(doc, page, line_no, x0, y0, height, text, color)` and images
with their places. Decoding of files is not part of it. Nothing here gathers more than one
document's lines of one field in a row, which are that field's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.paths import extension, parts, stem
from loomstone.functions.text import parse_norm, strip_ws
from loomstone.functions.vectors import red
from loomstone.operators.sequences import carried, gap_groups

#: The labels of a sheet's fields in English, with common misspellings, and in Italian, and the field each one names.
ENGLISH = {
    "acquisition": "acquisition", "acquistion": "acquisition", "author of file": "author_of_file", "bibliography": "bibliography",
    "collection": "collection", "colleciton": "collection", "condition": "condition", "date of file": "date_of_file", "description": "description", "designer": "designer",
    "design": "designer", "designe": "designer", "echibitions": "exhibitions", "exhibition": "exhibitions", "exhibitions": "exhibitions", "file": "file", "inventory": "inventory",
    "label": "label", "look": "look", "material": "materials", "materials": "materials", "object": "object", "picture": "picture",
    "present location": "present_location", "remark": "remark", "remarks": "remark", "season": "season", "size": "size", "sourc": "source",
    "source": "source", "sources": "source", "working proces": "working_process", "working process": "working_process",
    "working processe": "working_process", "workingprocess": "working_process", "year": "year",
}
ITALIAN = {
    "acquisizione": "acquisition", "anno": "year", "autore scheda": "author_of_file", "bibliografia": "bibliography", "collezione": "collection",
    "data scheda": "date_of_file", "descrizione": "description", "etichetta": "label", "fonti": "source", "immagine": "picture",
    "inventario": "inventory", "lavorazioni": "working_process", "luogo conservazione": "present_location", "materiali": "materials",
    "mostre": "exhibitions", "note": "remark", "oggetto": "object", "scheda": "file", "stagione": "season", "stato conservazione": "condition",
    "stilista": "designer", "taglia": "size",
}
#: The fields whose lines are joined with blanks; others keep their lines.
ONE_LINE = ["description", "remark", "materials", "working_process"]
#: How many of a line's spans must be red, how far columns are apart, the bottom margin, and least image sides.
RED_SHARE, COLUMN_GAP, MARGIN, LEAST_SIDE, LEAST_DRAWING = 0.6, 90.0, 80.0, 150, 80
FOOTER = r"(?i)\bprinted on\b|\bstampato il\b|all rights reserved|tutti i diritti riservati|©"
PAGE_MARK = r"(?i)^\s*(?:pg\.?|pag\.?)\s*#?\s*\d+\s*$"
#: The section that a folder's images belong to.
FOLDER_SECTIONS = {
    "fashion show photos": "runway_shots", "technical sheets": "technical_files", "technical drawings": "technical_drawings",
    "catwalk drawings": "fashion_show_drawings", "advertising": "ad_image", "press coverage": "editorial_image", "fashion show drawings": "fashion_show_drawings",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def lines_of(spans: DataFrame) -> DataFrame:
    """`(doc, page, line_no, x0, y0, height, text, is_red)`: spans joined in order; a line is red if at least 0.6 of its spans with text are."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("t")))), lambda s: s["t"]), "")
    told = F.when(strip_ws(F.col("text")) != "", F.when(red(F.col("color")), 1.0).otherwise(0.0))
    rows = spans.groupBy("doc", "page", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("height").alias("height"), strip_ws(text).alias("text"), F.coalesce(F.avg(told) >= RED_SHARE, F.lit(False)).alias("is_red"))
    return rows.where("text <> ''")


def labelled(lines: DataFrame) -> DataFrame:
    """Lines with the field that a red line names, and whether its label is Italian."""
    label = F.regexp_replace(F.regexp_replace(parse_norm(F.col("text")), r"[:\-]+$", ""), r"^\s+|\s+$", "")
    named = F.coalesce(_lookup(label, ENGLISH), _lookup(label, ITALIAN))
    return lines.withColumn("field_label", F.when(F.col("is_red"), named)).withColumn("italian", F.col("is_red") & _lookup(label, ITALIAN).isNotNull())


def column_centres(lines: DataFrame) -> DataFrame:
    """`(doc, centres)`: the mean x of each run of label lines that are at most 90 apart, from left to right; 0 for a document without labels."""
    runs = gap_groups(lines.where("field_label is not null").select("doc", "x0"), ["doc"], ["x0"], "x0", COLUMN_GAP)
    means = runs.groupBy("doc", "grp").agg(F.avg("x0").alias("c"))
    found = means.groupBy("doc").agg(F.array_sort(F.collect_list("c")).alias("centres"))
    return lines.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("centres", F.array(F.lit(0.0))).alias("centres"))


def column_of(x: Column, centres: Column) -> Column:
    """The nearest centre, the first of equal ones."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def sheet_lines(lines: DataFrame) -> DataFrame:
    """`(doc, field, page, y0, x0, line_no, text)`: each black line with the latest label above it in its column, across pages; footers, page marks and page numbers left out."""
    rows = labelled(lines)
    rows = rows.join(column_centres(rows), "doc").withColumn("col", column_of(F.col("x0"), F.col("centres"))).drop("centres")
    rows = carried(rows, ["doc", "col"], ["page", "y0", "x0", "line_no"], "field_label", "field")
    number = F.col("text").rlike(r"^\s*\d+\s*$") & (F.col("y0") > F.col("height") - MARGIN)
    noise = F.col("text").rlike(FOOTER) | F.col("text").rlike(PAGE_MARK) | number
    return rows.where(~F.col("is_red") & F.col("field").isNotNull() & ~noise).select("doc", "field", "page", "y0", "x0", "line_no", "text")


def sheet_fields_of(spans: DataFrame) -> DataFrame:
    """`(doc, field, value)` of all sheets. A field without lines has no row."""
    own = sheet_lines(lines_of(spans))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "x0", "line_no", "text"))), lambda s: s["text"])
    got = own.groupBy("doc", "field").agg(listed.alias("t"))
    flat = strip_ws(F.regexp_replace(F.array_join("t", " "), r"(?U)\s+", " "))
    return got.select("doc", "field", F.when(F.col("field").isin(ONE_LINE), flat).otherwise(F.array_join("t", "\n")).alias("value")).where("value <> ''")


def sheet_language(spans: DataFrame) -> DataFrame:
    """`(doc, language)`: `it` if any label is Italian, else `en`."""
    return labelled(lines_of(spans)).groupBy("doc").agg(F.when(F.bool_or("italian"), "it").otherwise("en").alias("language"))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n|\r"), strip_ws), lambda x: x != "")


def _text(lines: Column) -> Column:
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def _season(c: Column) -> Column:
    low = parse_norm(c)
    return F.when(low.contains("spring") | low.contains("summer"), "Spring-Summer").when(low.contains("fall") | low.contains("winter"), "Fall-Winter")


def cleaned_fields(rows: DataFrame, folder: str) -> DataFrame:
    """The clean-up of a sheet's fields, in order; `folder` is the column with the season's folder name.

    Footer and page lines go; the file keeps its number; a year keeps its four digits, and its
    other lines become the designer if there is none; seasons get one spelling, taken from the
    folder where it is missing and from a label that begins with one; page numbers go from size
    and inventory; a remark's closing mention of design specifications becomes the source if there
    is none. Nulls stay null.
    """
    fields = [c for c in rows.columns if c in set(ENGLISH.values())]
    out = rows.withColumns({f: _text(F.filter(_lines(F.col(f)), lambda x: ~x.rlike(FOOTER) & ~x.rlike(PAGE_MARK))) for f in fields})
    number = F.nullif(F.regexp_extract("file", r"\b(\d{1,6})\b", 1), F.lit(""))
    out = out.withColumn("file", F.coalesce(number, F.get(_lines(F.col("file")), F.lit(0))))
    year = F.nullif(F.regexp_extract("year", r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    rest = F.filter(_lines(F.col("year")), lambda x: ~x.rlike(r"\b(?:19|20)\d{2}\b"))
    designer = F.when(year.isNotNull() & F.col("designer").isNull() & (F.size(rest) > 0), F.array_join(rest, " ")).otherwise(F.col("designer"))
    out = out.withColumns({"year": F.coalesce(year, F.col("year")), "designer": designer})
    name = F.lower(F.trim(folder))
    from_folder = F.when(name.startswith("ss"), "Spring-Summer").when(name.startswith("fw"), "Fall-Winter")
    out = out.withColumn("season", F.coalesce(_season(F.col("season")), F.col("season"), from_folder))
    first = _season(F.get(_lines(F.col("label")), F.lit(0)))
    lines = _lines(F.col("label"))
    out = out.withColumns({"season": F.coalesce(first, F.col("season")), "label": F.when(first.isNotNull(), _text(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))))).otherwise(F.col("label"))})
    for f in ("inventory", "size"):
        out = out.withColumn(f, _text(F.filter(_lines(F.col(f)), lambda x: ~x.rlike(r"(?i)^(?:pg\.?\s*#?\s*)?\d{1,2}$"))))
    source = r"(?is)^(.*?)\s+((?:S/S|F/W)\s*\d{4}.*?(?:design specs|design specifications).*)$"
    hit = F.col("source").isNull() & F.col("remark").rlike(source)
    moved = F.when(hit, strip_ws(F.regexp_extract("remark", source, 2))).otherwise(F.col("source"))
    return out.withColumns({"source": moved, "remark": F.when(hit, F.nullif(strip_ws(F.regexp_extract("remark", source, 1)), F.lit(""))).otherwise(F.col("remark"))})


def numbered_pairs(files: DataFrame, path: str) -> DataFrame:
    """`(number, main, companion)`: files `<n>.pdf` with their companions `<n>_1.pdf`, in the order of the numbers; of several of a name the first path."""
    name = stem(F.col(path))
    rows = files.where(extension(F.col(path)) == "pdf").select(F.col(path).alias("p"), F.regexp_extract(name, r"^(\d+)(?:_\d+)?$", 1).alias("n"), F.regexp_extract(name, r"^\d+_(\d+)$", 1).alias("k"))
    main = rows.where("n <> '' and k = ''").groupBy("n").agg(F.min("p").alias("main"))
    other = rows.where("n <> '' and k = '1'").groupBy("n").agg(F.min("p").alias("companion"))
    return main.join(other, "n").select(F.col("n").alias("number"), "main", "companion").orderBy(F.col("number").cast("decimal(38,0)"), "number")


def large_enough(images: DataFrame, force_all: bool = False) -> DataFrame:
    """Images whose sides are long enough for their section; those of unknown size are kept."""
    least = F.when(F.col("section").contains("drawings"), LEAST_DRAWING).otherwise(LEAST_SIDE)
    ok = F.col("width").isNull() | F.col("height").isNull() | ((F.col("width") >= least) & (F.col("height") >= least))
    return images if force_all else images.where(ok)


def section_of(path: Column, sections: dict[str, str] | None = None) -> Column:
    """The section of the first folder of a path that has one, in any case, with blanks for underscores; else null."""
    folders = F.transform(parts(path), lambda p: F.replace(F.lower(F.trim(p)), F.lit("_"), F.lit(" ")))
    table = F.create_map(*[F.lit(x) for pair in (sections or FOLDER_SECTIONS).items() for x in pair])
    known = F.transform(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda p: F.try_element_at(table, p))
    return F.get(F.filter(known, lambda s: s.isNotNull()), F.lit(0))


def candidate_index(files: DataFrame, path: str, hash_: str, sections: dict[str, str] | None = None) -> DataFrame:
    """`(path, section, hash)` of the images with a readable hash."""
    return files.where(F.col(hash_).isNotNull()).select(F.col(path).alias("path"), section_of(F.col(path), sections).alias("section"), F.col(hash_).alias("hash"))


def in_sections(images: DataFrame, headers: DataFrame) -> DataFrame:
    """Each image `(doc, page, y0, image)` with the last header `(doc, page, y0, section)` at or above it, else the section carried from the page before."""
    a = images.select("doc", "page", "y0", F.lit(1).alias("_kind"), "image", F.lit(None).cast("string").alias("_s"))
    b = headers.select("doc", "page", "y0", F.lit(0).alias("_kind"), F.lit(None).cast(dict(images.dtypes)["image"]).alias("image"), F.col("section").alias("_s"))
    both = carried(a.unionByName(b), ["doc"], ["page", "y0", "_kind", "image"], "_s", "section")
    return both.where("_kind = 1").select("doc", "page", "y0", "image", "section")


def done_seasons(outputs: DataFrame, root: str) -> DataFrame:
    """`(season)` of the seasons whose first output path, in file order, starts with the expected root."""
    first = outputs.groupBy("season").agg(F.min_by("path", "pos").alias("first"))
    return first.where(F.col("first").startswith(root)).select("season")


def last_of(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row that was written last."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def below_root(path: Column, root: str) -> Column:
    """The part of a path below its folder of that name, in any case; the whole path without it."""
    p = parts(path)
    at = F.array_position(F.transform(p, lambda x: F.lower(x)), root.lower()).cast("int")
    return F.when(at > 0, F.array_join(F.slice(p, at + 1, F.size(p)), "/")).otherwise(F.array_join(p, "/"))
