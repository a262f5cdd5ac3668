"""Queries of text repair, sheets' fields and the assembly of item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import repair
from loomstone.functions.paths import same_path
from loomstone.functions.vectors import sign_hash
from loomstone.operators import assembly, sheets
from loomstone.plans.archive import HASH_SQL, IMAGES_SQL, ITEMS_SQL, PATH_SQL, images, items
from loomstone.sources.tables import table

_FIELDS = ["object", "designer", "label", "inventory", "year", "collection", "look", "size", "materials", "file"]
_ITALIAN = {f: label for label, f in sheets.ITALIAN.items()}


def _spans(spark, sf_dir) -> DataFrame:
    """Items' fields laid out as sheets: red labels in two columns, black lines below them, footers, page marks."""
    rows = items(spark, sf_dir, *_FIELDS)
    each = []
    for k, f in enumerate(_FIELDS):
        row = k // 2
        label = F.when(F.col("id") % 3 == 0, _ITALIAN.get(f, f).capitalize() + ":").otherwise(f.capitalize() + " -")
        each.append(F.struct(F.lit(row).alias("row"), F.lit(40.0 if k % 2 == 0 else 320.0).alias("x"), label.alias("label"), F.col(f).alias("value")))
    fields = rows.select("id", F.explode(F.array(*each)).alias("f")).select("id", "f.*").where(F.trim("value") != "")
    # the value of every third row begins on the next page
    page, y = (F.col("row") / 3).cast("int"), (F.col("row") % 3 * 250 + 20).cast("double")
    labels = fields.select("id", page.alias("page"), (F.col("row") * 100).alias("line_no"), F.col("x").alias("x0"), y.alias("y0"), F.lit(0).alias("span_no"), F.col("label").alias("text"), F.lit(0xC81010).alias("color"), F.when(F.col("x") > 100, 1).otherwise(0).alias("side"))
    turned = F.col("row") % 3 == 2
    lines = fields.select("id", "row", "x", F.posexplode(F.split("value", "\n")).alias("at", "t"))
    cut = F.floor(F.length("t") / 2).cast("int")
    halves = lines.select("id", "row", "x", "at", F.posexplode(F.array(F.substring("t", F.lit(1), cut), F.substring("t", cut + 1, F.length("t")))).alias("span_no", "text"))
    values = halves.select(
        "id", F.when(turned, page + 1).otherwise(page).alias("page"), (F.col("row") * 100 + F.col("at") + 1).alias("line_no"), (F.col("x") + 3).alias("x0"),
        (F.when(turned, 1.0).otherwise(y + 5) + F.col("at") * 0.01).alias("y0"), "span_no", "text", F.lit(0x101010).alias("color"), F.when(F.col("x") > 100, 1).otherwise(0).alias("side"),
    )
    noise = rows.select("id", F.explode(F.array(*[F.struct(F.lit(p).alias("page"), F.lit(t).alias("text"), F.lit(n).alias("line_no"), F.lit(990.0).alias("y0")) for p in (0, 1) for n, t in ((900, "Printed on 2020-01-01"), (901, "Pg. # 3"), (902, "7"))])).alias("n"))
    noise = noise.select("id", "n.page", "n.line_no", F.lit(41.0).alias("x0"), "n.y0", F.lit(0).alias("span_no"), "n.text", F.lit(0).alias("color"), F.lit(0).alias("side"))
    both = labels.unionByName(values).unionByName(noise)
    return both.select(F.col("id").alias("doc"), "page", (F.col("line_no") * 2 + F.col("side")).alias("line_no"), "span_no", "x0", "y0", F.lit(1000.0).alias("height"), "text", "color")


def sheet_fields(spark, sf_dir):
    """Fields read from the lines of laid-out sheets."""
    return sheets.sheet_fields_of(_spans(spark, sf_dir))


def sheet_languages(spark, sf_dir):
    """Each sheet's language by its labels."""
    return sheets.sheet_language(_spans(spark, sf_dir))


_CLEANED = ["file", "year", "season", "designer", "label", "size", "inventory", "remark", "source"]


def field_cleanup(spark, sf_dir):
    """Sheets' fields after their clean-up."""
    rows = items(spark, sf_dir, *_CLEANED, "season_path")
    return sheets.cleaned_fields(rows, "season_path").select("id", "file", "year", "season", "designer", "label", "size", "inventory")


def pdf_pairs(spark, sf_dir):
    """Sheets with their companions: an order's file and its first line's."""
    name = lambda *c: F.concat(F.lit("tech/"), *c, F.lit(".pdf"))
    a = table(spark, sf_dir, "orders", "o_orderkey").select(name(F.col("o_orderkey").cast("string")).alias("path"))
    b = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(name(F.concat_ws("_", "l_orderkey", "l_linenumber")).alias("path"))
    return sheets.numbered_pairs(a.unionByName(b), "path")


def image_sections(spark, sf_dir):
    """Each picture of a document with the last heading at or above it."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    pictures = rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("y0"), F.col("l_linenumber").cast("string").alias("image"))
    headings = rows.where("l_linenumber % 2 = 1 and l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.lit(25.0).alias("y0"), F.min("l_returnflag").alias("section"))
    return sheets.in_sections(pictures, headings).select("doc", "page", "section")


_SECTIONS = {"runway": "runway_shots", "sketch": "fashion_show_drawings", "still life": "technical_files", "lookbook": "editorial_image"}


def section_index(spark, sf_dir):
    """The candidate images of each section with their hashes."""
    rows = images(spark, sf_dir).withColumn("h", sign_hash(F.col("embedding")))
    return sheets.candidate_index(rows, "path", "h", _SECTIONS)


def mojibake_repair(spark, sf_dir):
    """Items' descriptions read again as UTF-8, and whether that changed them."""
    rows = items(spark, sf_dir, "description").where("description is not null").withColumn("repaired", repair.repaired(F.col("description")))
    return rows.select("id", F.md5("repaired").alias("repaired_md5"), (F.col("repaired") != F.col("description")).alias("changed"))


def term_repair(spark, sf_dir):
    """Terms read again as UTF-8, once."""
    rows = table(spark, sf_dir, "ontology_term", "term_id", "term").dropDuplicates(["term_id"])
    return rows.select("term_id", repair.repaired_term(F.col("term")).alias("repaired"))


def cleaned_records(spark, sf_dir):
    """Items' records cleaned, with the flag of what changed."""
    rows = items(spark, sf_dir, "source_path", "object", "condition", "materials").dropDuplicates(["source_path"]).where("source_path is not null")
    out = assembly.cleaned_records(rows, "source_path", repairs={("condition", "da restaurare"): "to be restored"}, check=False)
    return out.select("id", "source_path", "object", "condition", "materials", "cleaned")


def outfit_fields(spark, sf_dir):
    """Items as nested outfits, flattened, without two fields."""
    rows = items(spark, sf_dir, "outfit_id", "object", "designer", "year", "remark").select("id", "outfit_id", F.struct("object", "designer", F.col("outfit_id").alias("id"), F.struct("year", "remark").alias("more")).alias("fields"))
    return assembly.without(assembly.flattened(rows, "fields", {"year": "fields.more.year"}), "more", "designer", "no_such_column")


def cluster_id_parts(spark, sf_dir):
    """Season and outfit out of cluster ids, and the season of file names."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "season", "outfit_id").dropDuplicates(["cluster_id"]).where("season is not null and outfit_id is not null")
    named = F.concat_ws("_", "season", F.lit("outfit"), F.regexp_replace("outfit_id", "^outfit_", ""), F.lit("v"))
    file = F.concat(F.lit("set_"), F.replace(F.substring_index("season", "_", -1), F.lit("_"), F.lit("-")), F.lit("_"), F.lower(F.substring("season", 1, 2)), F.lit("_all.json"))
    return rows.select("cluster_id", assembly.season_of_cluster(named).alias("season_part"), assembly.outfit_of_cluster(named).alias("outfit_part"), assembly.season_of_file(file).alias("file_season"))


_SLOTS = dict(zip(["garments", "colors", "materials", "patterns", "silhouette", "length", "neckline", "sleeve", "closure", "embellishment", "style"], assembly.TAG_FIELDS))


def _registry(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "cluster_registry", "cluster_id", "season", "outfit_id", "pdf_status", "pdf_paths", "image_paths").dropDuplicates(["cluster_id"])


def assembled_items(spark, sf_dir):
    """The final row of every image of a cluster: 20 fields of its sheet, 11 tag lists of the model's result, 10 further columns."""
    rows = items(spark, sf_dir, "source_path", "season_path", "outfit_id", "llm_description", *assembly.SHEET_FIELDS, *assembly.TAG_FIELDS)
    pdf = F.concat("outfit_id", F.lit(".pdf"))
    sheets_ = rows.select(F.col("season_path").alias("season"), pdf.alias("pdf"), F.col("id").alias("seq"), F.struct(*assembly.SHEET_FIELDS).alias("entry"))
    results = rows.select(same_path(F.col("source_path")).alias("source_path"), F.col("id").alias("seq"), "llm_description", *assembly.TAG_FIELDS)
    terms = table(spark, sf_dir, "canonical_term", "ref_id", "slot", "term")
    slot = F.try_element_at(F.create_map(*[F.lit(x) for pair in _SLOTS.items() for x in pair]), F.col("slot"))
    vocabulary = assembly.vocabulary_of(terms.select(slot.alias("slot"), F.lit(0).alias("list_no"), F.col("ref_id").alias("pos"), "term"))
    clusters = _registry(spark, sf_dir)
    out = assembly.assembled(clusters, assembly.first_sheet(clusters, sheets_), results, vocabulary)
    return out.select(*[F.array_join(c, "|").alias(c) if c in assembly.TAG_FIELDS else c for c in out.columns])


def rejected_images(spark, sf_dir):
    """Images of clusters that don't exist, and clusters left without any, with the reasons."""
    files = images(spark, sf_dir).select("path").where(~F.col("path").contains("backstage"))
    clusters = _registry(spark, sf_dir).select("cluster_id", F.transform("image_paths", same_path).alias("image_paths"))
    return assembly.split_by_presence(clusters, files)[1]


def linked_images(spark, sf_dir):
    """One row per image out of exact, near and expanded links."""
    rows = _registry(spark, sf_dir).select("cluster_id", "pdf_status", F.posexplode("image_paths").alias("pos", "p")).select("cluster_id", "pdf_status", "pos", same_path(F.col("p")).alias("path"))
    rows = rows.withColumn("at", F.struct("cluster_id", "pos")).withColumn("rank", F.dense_rank().over(_by_cluster()))
    parts = [rows.where(F.col("pdf_status") == s).select("path", "cluster_id", "rank") for s in ("available", "incomplete", "missing")]
    return assembly.by_priority(*parts, "path", "rank").select("path", "cluster_id", "match_type")


def _by_cluster():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("cluster_id", "pos")


QUERIES = {f.__name__: f for f in (sheet_fields, sheet_languages, field_cleanup, pdf_pairs, image_sections, section_index, mojibake_repair, term_repair, cleaned_records, outfit_fields, cluster_id_parts, assembled_items, rejected_images, linked_images)}

_WS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _sql_lines(x: str, noise: bool = True) -> str:
    """Stripped lines that aren't empty, footers or page marks."""
    foot = sheets.FOOTER.replace("(?i)", "")
    keep = f"y <> '' AND NOT regexp_matches(y, '{foot}', 'i') AND NOT regexp_matches(y, '{sheets.PAGE_MARK[4:]}', 'i')" if noise else "y <> ''"
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda z: {_strip('z')}), lambda y: {keep})"


def _squeeze(x: str) -> str:
    return f"nullif(trim(regexp_replace({_strip(x)}, '{_WS}+', ' ', 'g')), '')"


_UNPIVOT = " UNION ALL ".join(f"SELECT id AS doc, '{f}' AS field, {_sql_lines(f)} AS l FROM items WHERE trim({f}) <> ''" for f in _FIELDS)
_JOINED = "CASE WHEN field IN ('description', 'remark', 'materials', 'working_process') THEN " + _strip(f"regexp_replace(array_to_string(l, ' '), '{_WS}+', ' ', 'g')") + " ELSE array_to_string(l, chr(10)) END"
_SEASON = "CASE WHEN regexp_matches(lower({0}), 'spring|summer') THEN 'Spring-Summer' WHEN regexp_matches(lower({0}), 'fall|winter') THEN 'Fall-Winter' END"
_L = {f: f"array_to_string({_sql_lines(f)}, chr(10))" for f in _CLEANED}
_TAG_SQL = ", ".join(
    f"array_to_string(list_slice(list_filter(t_{t}, lambda x, i: list_position(t_{t}, x) = i), 1, CASE WHEN backed THEN 10 ELSE 5 END), '|') AS {t}" for t in assembly.TAG_FIELDS
)
_KEPT_SQL = ", ".join(
    f"list_filter(list_transform(coalesce(r.{t}, []), lambda z: {_squeeze('z')}), lambda y: list_contains(v_{t}, y)) AS t_{t}" for slot, t in _SLOTS.items()
)
ORACLES = {
    "sheet_fields": f"WITH {ITEMS_SQL}, u AS ({_UNPIVOT}), v AS (SELECT doc, field, {_JOINED} AS value FROM u) SELECT * FROM v WHERE value <> ''",
    "sheet_languages": f"WITH {ITEMS_SQL}, f AS (SELECT id, {' OR '.join(f"coalesce(trim({c}), '') <> ''" for c in _FIELDS)} AS any_field FROM items) SELECT id AS doc, CASE WHEN id % 3 = 0 AND any_field THEN 'it' ELSE 'en' END AS language FROM f",
    "field_cleanup": f"""WITH {ITEMS_SQL}, l AS (SELECT id, season_path, {', '.join(f"nullif({x}, '') AS {f}" for f, x in _L.items())} FROM items),
 s AS (SELECT *, {_SEASON.format("string_split(coalesce(label, ''), chr(10))[1]")} AS of_label FROM l)
 SELECT id, coalesce(nullif(regexp_extract(file, '\\b(\\d{{1,6}})\\b', 1), ''), string_split(file, chr(10))[1]) AS file,
 coalesce(nullif(regexp_extract(year, '\\b((?:19|20)\\d{{2}})\\b', 1), ''), year) AS year,
 coalesce(of_label, {_SEASON.format('season')}, season, CASE WHEN lower(trim(season_path)) LIKE 'ss%' THEN 'Spring-Summer' WHEN lower(trim(season_path)) LIKE 'fw%' THEN 'Fall-Winter' END) AS season,
 CASE WHEN regexp_matches(year, '\\b(?:19|20)\\d{{2}}\\b') AND designer IS NULL THEN nullif(array_to_string(list_filter(string_split(year, chr(10)), lambda x: NOT regexp_matches(x, '\\b(?:19|20)\\d{{2}}\\b')), ' '), '') ELSE designer END AS designer,
 CASE WHEN of_label IS NOT NULL THEN nullif(array_to_string(string_split(label, chr(10))[2:], chr(10)), '') ELSE label END AS label,
 nullif(array_to_string(list_filter(string_split(coalesce(size, ''), chr(10)), lambda x: NOT regexp_matches(x, '^(?:pg\\.?\\s*#?\\s*)?\\d{{1,2}}$', 'i')), chr(10)), '') AS size,
 nullif(array_to_string(list_filter(string_split(coalesce(inventory, ''), chr(10)), lambda x: NOT regexp_matches(x, '^(?:pg\\.?\\s*#?\\s*)?\\d{{1,2}}$', 'i')), chr(10)), '') AS inventory FROM s""",
    "pdf_pairs": "SELECT o_orderkey::VARCHAR AS number, 'tech/' || o_orderkey || '.pdf' AS main, 'tech/' || o_orderkey || '_1.pdf' AS companion FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)",
    "image_sections": "WITH x AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity AS y0, 1 AS k, l_linenumber::VARCHAR AS image, NULL AS s FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 25.0, 0, NULL, min(l_returnflag) FROM lineitem WHERE l_linenumber % 2 = 1 AND l_linestatus = 'F' GROUP BY 1, 2), y AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y0, k, image ROWS UNBOUNDED PRECEDING) AS section FROM x) SELECT doc, page, section FROM y WHERE k = 1",
    "section_index": f"WITH {IMAGES_SQL} SELECT path, CASE {' '.join(f'''WHEN list_contains(list_transform(string_split(path, '/')[:-2], lambda p: replace(lower(trim(p)), '_', ' ')), '{k}') THEN '{v}' ''' for k, v in _SECTIONS.items())} END AS section, {HASH_SQL} AS hash FROM images",
    "outfit_fields": f"WITH {ITEMS_SQL} SELECT id, outfit_id, object, outfit_id AS fields_id, year FROM items",
    "cluster_id_parts": "WITH r AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry WHERE season IS NOT NULL AND outfit_id IS NOT NULL) SELECT cluster_id, season AS season_part, regexp_extract(regexp_replace(outfit_id, '^outfit_', ''), '^([^_]+)', 1) AS outfit_part, upper(season[:2]) || string_split(season, '_')[-1] AS file_season FROM r",
    "assembled_items": f"""WITH {ITEMS_SQL}, reg AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry),
 sh AS (SELECT season_path AS s, outfit_id || '.pdf' AS pdf, max(id) AS sheet_id FROM items WHERE outfit_id IS NOT NULL AND season_path IS NOT NULL GROUP BY 1, 2),
 pp AS (SELECT cluster_id, season, generate_subscripts(pdf_paths, 1) AS pos, regexp_extract(unnest(pdf_paths), '([^/\\\\]*)$', 1) AS pdf FROM reg),
 fs AS (SELECT cluster_id, arg_min(sheet_id, pos) AS sheet_id FROM pp JOIN sh ON sh.s = pp.season AND sh.pdf = pp.pdf GROUP BY 1),
 vo AS (SELECT {', '.join(f"list(term) FILTER (slot = '{x}') AS v_{t}" for x, t in _SLOTS.items())} FROM canonical_term),
 im AS (SELECT cluster_id, season, outfit_id, pdf_status, unnest(image_paths) AS source_path FROM reg),
 re AS (SELECT {PATH_SQL.format('source_path')} AS p, max(id) AS rid FROM items WHERE source_path IS NOT NULL GROUP BY 1),
 j AS (SELECT im.*, coalesce(im.pdf_status IN ('available', 'incomplete'), FALSE) AS backed, e.id AS eid, r.llm_description AS d, {', '.join(f'{_squeeze("e." + f)} AS e_{f}' for f in assembly.SHEET_FIELDS)}, {_KEPT_SQL}
   FROM im CROSS JOIN vo LEFT JOIN fs USING (cluster_id) LEFT JOIN items e ON e.id = fs.sheet_id AND im.pdf_status IN ('available', 'incomplete') LEFT JOIN re ON re.p = im.source_path LEFT JOIN items r ON r.id = re.rid)
 SELECT source_path, 'ALTA MODA' AS collection_line, nullif(season, '') AS season_path, nullif(regexp_extract(season, '(\\d{{4}})', 1), '') AS year_path,
 CASE WHEN len(string_split(source_path, '/')) > 1 THEN string_split(source_path, '/')[-2] END AS asset_type,
 {', '.join(f'e_{f} AS {f}' for f in assembly.SHEET_FIELDS)}, {_TAG_SQL},
 CASE WHEN length({_squeeze('d')}) > 320 THEN regexp_replace(substr({_squeeze('d')}, 1, 319), '[ ,;:-]+$', '') || '…' ELSE {_squeeze('d')} END AS llm_description,
 pdf_status AS pdf_available, cluster_id, outfit_id FROM j""",
    "rejected_images": f"WITH {IMAGES_SQL}, reg AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry), e AS (SELECT cluster_id, {PATH_SQL.format('p')} AS source_path FROM (SELECT cluster_id, unnest(image_paths) AS p FROM reg)), f AS (SELECT path FROM images WHERE NOT contains(path, 'backstage')), h AS (SELECT *, source_path IN (SELECT path FROM f) AS there FROM e) SELECT cluster_id, source_path, 'missing_file' AS reason FROM h WHERE NOT there UNION ALL SELECT cluster_id, NULL, 'no_existing_images_left_in_cluster' FROM reg WHERE cluster_id NOT IN (SELECT cluster_id FROM h WHERE there)",
    "linked_images": f"WITH reg AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry), e AS (SELECT cluster_id, pdf_status, generate_subscripts(image_paths, 1) AS pos, unnest(image_paths) AS p FROM reg), x AS (SELECT {PATH_SQL.format('p')} AS path, cluster_id, pos, CASE pdf_status WHEN 'available' THEN 0 WHEN 'incomplete' THEN 1 ELSE 2 END AS prio FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY cluster_id, pos) AS rank FROM x) SELECT path, cluster_id, CASE prio WHEN 0 THEN 'exact' WHEN 1 THEN 'near' ELSE 'expanded' END AS match_type FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY prio, CASE WHEN prio = 0 THEN -rank ELSE rank END) = 1",
}
