"""Queries of browsing, facets, projections and vocabulary membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import paths, tags, text
from loomstone.operators import browse
from loomstone.operators.predicates import FilterSpec
from loomstone.operators.retrieval import first_of
from loomstone.plans.archive import ITEMS_SQL, PATH_SQL, items
from loomstone.sources.tables import table

TAGS = ("garments_tags", "colors_tags", "material_tags", "patterns_tags", "silhouette_tags", "length_tags", "neckline_tags", "sleeve_tags", "closure_tags", "embellishment_tags", "style_tags")
_FEED = ("source_path", "pdf_available", "cluster_id", "season", "colors_tags", "garments_tags")
_SPEC = FilterSpec(tags={"colors_tags": ["black", "white", "red"], "garments_tags": ["jacket", "coat"]})


def _facet(column: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return browse.facet(table(spark, sf_dir, "fashion_item", column), column)

    query.__doc__ = f"Distinct values of {column}."
    return query


def _cards(rows: DataFrame) -> DataFrame:
    return browse.cards(rows, paths.image_url(F.col("source_path")))


def landing_feed(spark, sf_dir):
    """One card per cluster, all pages."""
    return _cards(browse.feed(items(spark, sf_dir, *_FEED), FilterSpec()))


def landing_feed_filtered(spark, sf_dir):
    """The first page of cards that match any of the colours and any of the garments."""
    return _cards(browse.page(browse.feed(items(spark, sf_dir, *_FEED), _SPEC), 24, 0))


def landing_page_state(spark, sf_dir):
    """Whether more follow the second page."""
    return browse.page_state(browse.page(browse.feed(items(spark, sf_dir, *_FEED), _SPEC), 24, 24), 24, 24)


def dedupe_then_filter(spark, sf_dir):
    """How many cards there are if the filter comes before or after taking one per cluster."""
    rows = items(spark, sf_dir, *_FEED)
    before = browse.feed(rows, _SPEC).agg(F.count("*").alias("filter_first"))
    after = browse.one_per_cluster(rows).where(_SPEC.condition()).agg(F.count("*").alias("dedupe_first"))
    return before.crossJoin(after)


def _path_of(spark, sf_dir, where: str) -> str:
    row = table(spark, sf_dir, "fashion_item", "id", "source_path", "pdf_available", "cluster_id").where(where).orderBy("id", "source_path").first()
    return row["source_path"] if row else ""


def item_detail(spark, sf_dir):
    """The item of a known path."""
    return browse.detail(items(spark, sf_dir, "source_path", "season"), _path_of(spark, sf_dir, "source_path = trim(source_path)"), fallback=False)


def item_detail_fallback(spark, sf_dir):
    """An unknown path gives the first item."""
    return browse.detail(items(spark, sf_dir, "source_path", "season"), "no/such/path.jpg")


def item_cluster(spark, sf_dir):
    """All views of an item's cluster."""
    return browse.cluster_views(items(spark, sf_dir, *_FEED), _path_of(spark, sf_dir, "pdf_available <> 'missing' and cluster_id is not null")).select("id", "source_path")


def item_cluster_missing(spark, sf_dir):
    """An item without a document stands alone."""
    return browse.cluster_views(items(spark, sf_dir, *_FEED), _path_of(spark, sf_dir, "pdf_available = 'missing'")).select("id", "source_path")


def item_heading(spark, sf_dir):
    """Heading, text and season shown for each item."""
    columns = ("object", "file", "look", "label", "collection_line", "season", "description", "llm_description", "season_path", "year", "year_path")
    return browse.heading(items(spark, sf_dir, *columns))


def items_in_lookup(spark, sf_dir):
    """Items of the candidate paths of one season's clusters."""
    wanted = table(spark, sf_dir, "cluster_registry", "season", "image_paths").where("season like 'SS%'").select(F.explode("image_paths").alias("p")).select(paths.same_path(F.col("p")).alias("path")).distinct()
    rows = items(spark, sf_dir, "source_path").withColumn("path", paths.same_path(F.col("source_path")))
    return rows.join(wanted, "path", "left_semi").select("id", "path")


def whitelist_seed(spark, sf_dir):
    """Known fields of the items of one asset type."""
    known = [c for c in ("id", "source_path", "season", "asset_type", "cluster_id", "no_such_field") if c in table(spark, sf_dir, "fashion_item").columns]
    return items(spark, sf_dir, *known).where("asset_type = 'runway'")


def tag_document(spark, sf_dir):
    """All tags of an item as one text, else the file name."""
    joined = F.array_join(F.flatten(F.array(*[F.coalesce(F.col(t), F.array().cast("array<string>")) for t in TAGS])), " ")
    return items(spark, sf_dir, "source_path", *TAGS).select("id", F.coalesce(F.nullif(joined, F.lit("")), paths.basename(F.col("source_path"))).alias("document"))


SCALARS = ["collection_line", "season_path", "year_path", "asset_type", "season", "label", "acquisition", "look", "file", "inventory", "object", "source", "description", "exhibitions", "size", "materials", "present_location", "remark", "bibliography", "designer", "working_process", "condition", "collection", "year", "llm_description", "pdf_available", "cluster_id", "outfit_id"]


def store_metadata(spark, sf_dir):
    """28 scalars as texts with empty ones for nulls, 11 tag lists joined."""
    scalars = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SCALARS]
    lists = [F.coalesce(F.array_join(t, ", "), F.lit("")).alias(t) for t in TAGS]
    return items(spark, sf_dir, *SCALARS, *TAGS).select("id", *scalars, *lists)


def tag_normalise(spark, sf_dir):
    """Tags of the reference list, distinct, at most five."""
    entries = table(spark, sf_dir, "canonical_term", "slot", "term").where("slot = 'garments'")
    words = entries.agg(F.sort_array(F.collect_set(F.lower("term"))).alias("words"))
    rows = items(spark, sf_dir, "garments_tags").crossJoin(F.broadcast(words))
    return rows.select("id", F.array_join(tags.allowed(F.col("garments_tags"), F.col("words"), 5), ",").alias("tags"))


def status_of_fields(spark, sf_dir):
    """Completeness of an item's archival fields."""
    fields = ("object", "materials", "description")
    return items(spark, sf_dir, *fields).select("id", tags.completeness(*map(F.col, fields)).alias("status"))


def path_functions(spark, sf_dir):
    """Names, keys, season and media type of each image's path."""
    p = F.col("source_path")
    rows = items(spark, sf_dir, "source_path").withColumn("source_path", paths.same_path(p))
    return rows.select("id", paths.path_key(p).alias("path_key"), paths.basename(p).alias("base"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"), paths.title(p).alias("title"), paths.parent_name(p).alias("folder"), paths.media_type(p).alias("media"), paths.season_of_folder(p).alias("season_code"))


def image_urls(spark, sf_dir):
    """Static and proxy addresses."""
    p = F.col("path")
    return table(spark, sf_dir, "image_embedding", "id", "path").distinct().select("id", paths.same_path(p).alias("path")).select("id", paths.image_url(p).alias("static_url"), paths.image_url(p, "archive").alias("proxy_url"))


def name_hashes(spark, sf_dir):
    """Hash keys of names."""
    return table(spark, sf_dir, "documents", "doc_id", "doc").select("doc_id", paths.chunk_id(F.col("doc"), F.col("doc_id")).alias("chunk_id"), F.md5("doc").alias("md5_hex"), F.sha1("doc").alias("sha1_hex"))


def shortened(spark, sf_dir):
    """Texts of at most 320 characters, whitespace squeezed."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.shorten(F.col("text"), 320).alias("short"))


def years_and_codes(spark, sf_dir):
    """First year of a document's year field, and padded file codes."""
    rows = table(spark, sf_dir, "documents", "doc_id", "doc_year", "doc")
    return rows.select("doc_id", text.year_of(F.col("doc_year")).alias("year"), paths.file_code(F.regexp_extract("doc", r"(\d{1,2})\D*$", 1)).alias("file_code"))


def first_views(spark, sf_dir):
    """The first item by path of each season and look."""
    rows = items(spark, sf_dir, "season", "look", "source_path").where("season is not null and look is not null")
    return first_of(rows, ["season", "look"], ["source_path", "id"]).select("season", "look", "id")


QUERIES = {f"facet_{n}": _facet(c) for n, c in (("seasons", "season"), ("garments", "garments_tags"), ("colors", "colors_tags"), ("materials", "material_tags"))} | {
    f.__name__: f
    for f in (landing_feed, landing_feed_filtered, landing_page_state, dedupe_then_filter, item_detail, item_detail_fallback, item_cluster, item_cluster_missing, item_heading, items_in_lookup, whitelist_seed, tag_document, store_metadata, tag_normalise, status_of_fields, path_functions, image_urls, name_hashes, shortened, years_and_codes, first_views)
}

_ALONE = "(coalesce(pdf_available = 'missing', TRUE) OR cluster_id IS NULL)"
_ONE = f"row_number() OVER (PARTITION BY {_ALONE}, CASE WHEN {_ALONE} THEN id::VARCHAR ELSE cluster_id END ORDER BY source_path, id)"
_STEM = "regexp_replace(regexp_extract({0}, '([^/\\\\]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"
_MATCH = "list_has_any(coalesce(colors_tags, []), ['black', 'white', 'red']) AND list_has_any(coalesce(garments_tags, []), ['jacket', 'coat'])"
_CARD = f"id, replace({_STEM.format('source_path')}, '_', ' ') AS title, '/static/' || replace(replace(url_encode(source_path), '%2F', '/'), '~', '%7E') AS url, source_path"
_FEED_SQL = f"WITH {ITEMS_SQL}, feed AS (SELECT *, {_ONE} AS rn FROM items {{where}})"


def _facet_sql(column: str, array: bool) -> str:
    inner = f"SELECT unnest({column}) AS value FROM fashion_item" if array else f"SELECT {column} AS value FROM fashion_item"
    return f"SELECT DISTINCT value FROM ({inner}) WHERE value <> ''"


_blank = "coalesce(trim({0}, ' \t\n\r'), '') = ''"
ORACLES = {
    "facet_seasons": _facet_sql("season", False),
    "facet_garments": _facet_sql("garments_tags", True),
    "facet_colors": _facet_sql("colors_tags", True),
    "facet_materials": _facet_sql("material_tags", True),
    "landing_feed": _FEED_SQL.format(where="") + f" SELECT {_CARD} FROM feed WHERE rn = 1",
    "landing_feed_filtered": _FEED_SQL.format(where="WHERE " + _MATCH) + f" SELECT {_CARD} FROM feed WHERE rn = 1 ORDER BY id LIMIT 24",
    "landing_page_state": _FEED_SQL.format(where="WHERE " + _MATCH) + ", p AS (SELECT id FROM feed WHERE rn = 1 ORDER BY id LIMIT 24 OFFSET 24) SELECT count(*)::BIGINT AS n_items, count(*) = 24 AS has_more, 48::INT AS next_offset FROM p",
    "dedupe_then_filter": f"WITH {ITEMS_SQL}, a AS (SELECT {_ONE} AS rn FROM items WHERE {_MATCH}), b AS (SELECT *, {_ONE} AS rn FROM items) SELECT (SELECT count(*) FROM a WHERE rn = 1) AS filter_first, (SELECT count(*) FROM b WHERE rn = 1 AND {_MATCH}) AS dedupe_first",
    "item_detail": f"WITH {ITEMS_SQL} SELECT id, source_path, season FROM items WHERE source_path = (SELECT source_path FROM fashion_item WHERE source_path = trim(source_path) ORDER BY id, source_path LIMIT 1) ORDER BY id LIMIT 1",
    "item_detail_fallback": f"WITH {ITEMS_SQL} SELECT id, source_path, season FROM items ORDER BY id LIMIT 1",
    "item_cluster": f"WITH {ITEMS_SQL}, a AS (SELECT cluster_id FROM fashion_item WHERE pdf_available <> 'missing' AND cluster_id IS NOT NULL ORDER BY id, source_path LIMIT 1) SELECT id, source_path FROM items WHERE pdf_available <> 'missing' AND cluster_id IN (SELECT cluster_id FROM a)",
    "item_cluster_missing": "SELECT id, source_path FROM fashion_item WHERE pdf_available = 'missing' ORDER BY id, source_path LIMIT 1",
    "item_heading": f"""WITH {ITEMS_SQL} SELECT id,
 coalesce(nullif(trim(object), ''), nullif(trim(file), ''), nullif(trim(look), ''), nullif(trim(label), ''), concat_ws(' ', nullif(trim(collection_line), ''), nullif(trim(season), ''))) AS heading,
 coalesce(nullif(trim(description), ''), nullif(trim(llm_description), '')) AS body,
 nullif(trim(description), '') IS NULL AND NOT ({_blank.format('llm_description')}) AS by_model,
 coalesce(nullif(trim(season_path), ''), nullif(trim(season), '')) AS season_shown, coalesce(nullif(trim(year_path), ''), nullif(trim(year), '')) AS year_shown FROM items""",
    "items_in_lookup": f"WITH {ITEMS_SQL}, w AS (SELECT DISTINCT {PATH_SQL.format('p')} AS path FROM (SELECT unnest(image_paths) AS p FROM cluster_registry WHERE season LIKE 'SS%')), i AS (SELECT id, {PATH_SQL.format('source_path')} AS path FROM items) SELECT id, path FROM i WHERE path IN (SELECT path FROM w)",
    "whitelist_seed": f"WITH {ITEMS_SQL} SELECT id, source_path, season, asset_type, cluster_id FROM items WHERE asset_type = 'runway'",
    "tag_document": f"WITH {ITEMS_SQL} SELECT id, coalesce(nullif(array_to_string(flatten([{', '.join(f'coalesce({t}, [])' for t in TAGS)}]), ' '), ''), regexp_extract(source_path, '([^/\\\\]*)$', 1)) AS document FROM items",
    "store_metadata": f"WITH {ITEMS_SQL} SELECT id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in SCALARS) + ", " + ", ".join(f"coalesce(array_to_string({t}, ', '), '') AS {t}" for t in TAGS) + " FROM items",
    "tag_normalise": f"WITH {ITEMS_SQL}, e AS (SELECT id, lower(trim(t)) AS t, pos FROM (SELECT id, unnest(garments_tags) AS t, generate_subscripts(garments_tags, 1) AS pos FROM items)), f AS (SELECT id, t, min(pos) AS pos FROM e WHERE t IN (SELECT lower(term) FROM canonical_term WHERE slot = 'garments') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM f) SELECT i.id, coalesce(string_agg(t, ',' ORDER BY pos), '') AS tags FROM items i LEFT JOIN r ON r.id = i.id AND k <= 5 GROUP BY 1",
    "status_of_fields": f"WITH {ITEMS_SQL}, b AS (SELECT id, {', '.join(f'({_blank.format(c)})::INT AS b{i}' for i, c in enumerate(('object', 'materials', 'description')))} FROM items) SELECT id, CASE b0 + b1 + b2 WHEN 0 THEN 'available' WHEN 3 THEN 'empty' ELSE 'incomplete' END AS status FROM b",
    "name_hashes": "SELECT doc_id, substr(sha256(doc), 1, 16) || '-' || doc_id AS chunk_id, md5(doc) AS md5_hex, sha1(doc) AS sha1_hex FROM documents",
    "shortened": "SELECT doc_id, CASE WHEN length(text) > 320 THEN regexp_replace(substr(text, 1, 319), '[ ,;:-]+$', '') || '…' ELSE text END AS short FROM documents",
    "years_and_codes": "SELECT doc_id, nullif(regexp_extract(doc_year, '(\\d{4})', 1), '') AS year, lpad(nullif(regexp_extract(doc, '(\\d{1,2})\\D*$', 1), ''), 3, '0') AS file_code FROM documents",
    "first_views": f"WITH {ITEMS_SQL} SELECT season, look, id FROM items WHERE season IS NOT NULL AND look IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season, look ORDER BY source_path, id) = 1",
}
