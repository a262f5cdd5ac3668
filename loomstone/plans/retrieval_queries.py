"""Queries of vector search, filters, top-up, re-ranking and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.paths import same_path
from loomstone.operators.predicates import FilterSpec, contains_all, parse_filters, where_equal
from loomstone.operators.retrieval import context_block, first_of, joined_text, nearest, nearest_to_each, ranked_candidates, referenced, tag_score, topped_up, unique_sources
from loomstone.plans.archive import IMAGES_SQL, ITEMS_SQL, PATH_SQL, images, items
from loomstone.sources.tables import table

TAGS = ("garments_tags", "colors_tags", "material_tags", "patterns_tags", "silhouette_tags", "length_tags", "neckline_tags", "sleeve_tags", "closure_tags", "embellishment_tags", "style_tags")
CONTEXT = "silk jacket with beading and a velvet coat from 1996, shown in red and black"


def _query_vector(spark, sf_dir) -> list[float]:
    """The vector of id 0, an anchor row looked up by key."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0]


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def knn(spark, sf_dir):
    """The ten vectors nearest to one."""
    return nearest(_vectors(spark, sf_dir), "embedding", _query_vector(spark, sf_dir), 10, key="vec_id").select("vec_id", "label", "distance")


def knn_where(spark, sf_dir):
    """The same among one label, the filter given as an argument."""
    condition = where_equal(parse_filters(['label="3"']))
    return nearest(_vectors(spark, sf_dir), "embedding", _query_vector(spark, sf_dir), 10, condition, key="vec_id").select("vec_id", "label", "distance")


def knn_and(spark, sf_dir):
    """The same under two conditions."""
    condition = FilterSpec(equal={"label": "3"}).condition() & (F.col("vec_id") >= 100)
    return nearest(_vectors(spark, sf_dir), "embedding", _query_vector(spark, sf_dir), 10, condition, key="vec_id").select("vec_id", "label", "distance")


def knn_batch(spark, sf_dir):
    """The five vectors nearest to each whose id is divisible by 20."""
    rows = _vectors(spark, sf_dir)
    found = nearest_to_each(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5)
    return found.select("query", F.col("key").alias("vec_id"), "distance", "rank")


def image_search(spark, sf_dir):
    """Images of one season nearest to an anchor image, with their items."""
    rows = images(spark, sf_dir, "season")
    anchor = rows.orderBy("id").select("embedding", "season").first()
    spec = FilterSpec(equal={"season": anchor["season"]}) if anchor else FilterSpec()
    near = nearest(rows, "embedding", list(anchor["embedding"]) if anchor else [0.0], 15, spec.condition())
    own = items(spark, sf_dir, "source_path").withColumn("path", same_path(F.col("source_path")))
    return near.join(own.select(F.col("id").alias("item_id"), "path"), "path", "left").select("id", "item_id", "distance")


def contains_one(spark, sf_dir):
    """Documents with a substring."""
    return table(spark, sf_dir, "documents", "doc_id", "text").where(contains_all("text", ["Schwarz"])).select("doc_id")


def contains_both(spark, sf_dir):
    """Documents with two substrings."""
    return table(spark, sf_dir, "documents", "doc_id", "text").where(contains_all("text", ["giacca", "seta"])).select("doc_id")


def filter_topup(spark, sf_dir):
    """Few filtered hits, topped up to 15 from all."""
    q = _query_vector(spark, sf_dir)
    every = nearest(_vectors(spark, sf_dir), "embedding", q, 15, key="vec_id").select("vec_id", "label", "distance")
    few = nearest(_vectors(spark, sf_dir), "embedding", q, 3, F.col("label") == 3, key="vec_id").select("vec_id", "label", "distance")
    return topped_up(few, every, "vec_id", "distance", 15, 5).select("vec_id", "label", "distance")


def filter_enough(spark, sf_dir):
    """Five or more filtered hits aren't topped up."""
    q = _query_vector(spark, sf_dir)
    every = nearest(_vectors(spark, sf_dir), "embedding", q, 15, key="vec_id").select("vec_id", "label", "distance")
    own = nearest(_vectors(spark, sf_dir), "embedding", q, 7, F.col("label") == 3, key="vec_id").select("vec_id", "label", "distance")
    return topped_up(own, every, "vec_id", "distance", 15, 5).select("vec_id", "label", "distance")


SCORED = ("garments_tags", "colors_tags", "material_tags", "patterns_tags", "style_tags", "silhouette_tags", "embellishment_tags")


def _scored(spark, sf_dir) -> DataFrame:
    rows = items(spark, sf_dir, *SCORED, "llm_description", "year_path", "source_path")
    tags = F.flatten(F.array(*[F.coalesce(F.filter(c, lambda t: F.trim(t) != ""), F.array().cast("array<string>")) for c in SCORED]))
    return rows.select("id", "source_path", tag_score(tags, F.col("llm_description"), F.coalesce("year_path", F.lit("")), CONTEXT).alias("score"))


def rerank_score(spark, sf_dir):
    """Every item's score for a context."""
    return _scored(spark, sf_dir).select("id", "score")


def rerank_top3(spark, sf_dir):
    """The three best items; ties by id."""
    return _scored(spark, sf_dir).select("id", "score").orderBy(F.desc("score"), "id").limit(3)


def sources_top5(spark, sf_dir):
    """The first five distinct documents in order of their hits."""
    rows = table(spark, sf_dir, "documents", "doc_id", "doc").select("doc_id", F.coalesce("doc", F.lit("Unknown")).alias("document"))
    return unique_sources(rows, ["document"], "doc_id").select("document", "doc_id")


def union_sources(spark, sf_dir):
    """Sources of two searches, each once."""
    rows = table(spark, sf_dir, "documents", "doc_id", "doc", "doc_type")
    a, b = rows.where("doc_type = 'Letter'"), rows.where("doc_id % 3 = 0")
    return a.unionByName(b).select(F.coalesce("doc", F.lit("Unknown")).alias("document")).distinct()


def anchor_filters(spark, sf_dir):
    """Items that match the season, first colour and first garment of a reference item, these as substrings of the tags' text."""
    rows = items(spark, sf_dir, "season_path", "year_path", *TAGS)
    anchor = rows.where("size(colors_tags) > 0 and size(garments_tags) > 0 and trim(colors_tags[0]) <> '' and trim(garments_tags[0]) <> '' and season_path is not null").orderBy("id").first()
    spec = FilterSpec().with_anchor(anchor.asDict() if anchor else {}, ["season", "color", "garment"])
    text = F.array_join(F.flatten(F.array(*[F.coalesce(F.col(t), F.array().cast("array<string>")) for t in TAGS])), " ")
    return rows.withColumn("document", text).where(spec.condition("document")).select("id", "season_path")


def argument_filters(spark, sf_dir):
    """Items that match a model's arguments."""
    spec = FilterSpec.from_arguments({"year": 1996, "season": None, "material_tags": ["silk"], "query": "x"})
    rows = items(spark, sf_dir, "year_path", *TAGS)
    text = F.array_join(F.flatten(F.array(*[F.coalesce(F.col(t), F.array().cast("array<string>")) for t in TAGS])), " ")
    return rows.withColumn("document", text).where(spec.condition("document")).select("id")


def ranked_images(spark, sf_dir):
    """The three best scored of fifteen candidate images, in order, else the first three candidates."""
    near = _candidates(spark, sf_dir).select("path", "rank")
    scored = _scored(spark, sf_dir).select(same_path(F.col("source_path")).alias("path"), "score")
    return ranked_candidates(scored, near, "path").select("path", "score")


def _candidates(spark, sf_dir) -> DataFrame:
    rows = images(spark, sf_dir)
    anchor = rows.orderBy("id").select("embedding").first()
    near = nearest(rows, "embedding", list(anchor["embedding"]) if anchor else [0.0], 15)
    return first_of(near, ["path"], ["distance", "id"]).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))  # 15 rows


def referenced_image(spark, sf_dir):
    """The second of the candidate images, by its number."""
    return referenced(_candidates(spark, sf_dir).select("path", "rank"), 2, "rank")


def found_text(spark, sf_dir):
    """The texts of the ten nearest documents' first sentences joined with blank lines, or a message."""
    rows = table(spark, sf_dir, "documents", "doc_id", "title", "source")
    hits = rows.where("source = 'oral_history'").orderBy("doc_id").limit(10).select(F.col("doc_id").alias("rank"), F.coalesce("title", F.lit("-")).alias("text"))
    return joined_text(hits, "rank", "text").unionByName(joined_text(hits.limit(0), "rank", "text"))


def attributes_left(spark, sf_dir):
    """The tags of an item that aren't colours."""
    rows = items(spark, sf_dir, "garments_tags", "colors_tags")
    return rows.select("id", F.array_join(F.array_sort(F.array_except(F.coalesce("garments_tags", F.array().cast("array<string>")), F.coalesce("colors_tags", F.array().cast("array<string>")))), "|").alias("left"))


def image_context(spark, sf_dir):
    """Each item's block of text for a prompt: a heading, at most ten tags, a description."""
    rows = items(spark, sf_dir, "season_path", "year_path", "collection_line", "llm_description", "garments_tags", "colors_tags", "material_tags")
    return rows.select("id", F.md5(context_block(F.col("id"))).alias("block_md5"))


QUERIES = {f.__name__: f for f in (knn, knn_where, knn_and, knn_batch, image_search, contains_one, contains_both, filter_topup, filter_enough, rerank_score, rerank_top3, sources_top5, union_sources, anchor_filters, argument_filters, ranked_images, referenced_image, found_text, attributes_left, image_context)}

_D = "WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id, label, round(list_cosine_distance(embedding::DOUBLE[], e), 6) AS distance FROM embeddings, q)"
_TAGS = "flatten([" + ", ".join(f"coalesce({c}, [])" for c in SCORED) + "])"
_DOC = "array_to_string(flatten([" + ", ".join(f"coalesce({c}, [])" for c in TAGS) + "]), ' ')"
_CAND = f"WITH {IMAGES_SQL}, {ITEMS_SQL}, an AS (SELECT v FROM images ORDER BY id LIMIT 1), n AS (SELECT i.id, path, round(list_cosine_distance(i.v, an.v), 6) AS distance FROM images i, an ORDER BY 3, 1 LIMIT 15), c AS (SELECT path, row_number() OVER (ORDER BY distance, id) AS rank FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY path ORDER BY distance, id) = 1))"
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
_SCORE = f"""WITH {ITEMS_SQL}, s AS (SELECT id,
 (len(list_filter({_TAGS}, lambda t: trim(t) <> '' AND contains(lower('{CONTEXT}'), lower(t))))
 + CASE WHEN coalesce(year_path, '') <> '' AND contains('{CONTEXT}', year_path) THEN 2 ELSE 0 END
 + len(list_intersect({_WORDS.format("coalesce(llm_description, '')")}, {_WORDS.format(f"'{CONTEXT}'")})) // 5)::INT AS score FROM items)"""
ORACLES = {
    "knn": _D + " SELECT * FROM d ORDER BY distance, vec_id LIMIT 10",
    "knn_where": _D + " SELECT * FROM d WHERE label = 3 ORDER BY distance, vec_id LIMIT 10",
    "knn_and": _D + " SELECT * FROM d WHERE label = 3 AND vec_id >= 100 ORDER BY distance, vec_id LIMIT 10",
    "knn_batch": "WITH d AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY distance, vec_id))::INT AS rank FROM d) SELECT query, vec_id, distance, rank FROM r WHERE rank <= 5",
    "image_search": f"WITH {IMAGES_SQL}, {ITEMS_SQL}, a AS (SELECT v, season FROM images ORDER BY id LIMIT 1), n AS (SELECT i.id, path, round(list_cosine_distance(i.v, a.v), 6) AS distance FROM images i JOIN a ON i.season = a.season ORDER BY 3, 1 LIMIT 15) SELECT n.id, t.id AS item_id, distance FROM n LEFT JOIN (SELECT id, {PATH_SQL.format('source_path')} AS path FROM items) t ON t.path = n.path",
    "contains_one": "SELECT doc_id FROM documents WHERE contains(text, 'Schwarz')",
    "contains_both": "SELECT doc_id FROM documents WHERE contains(text, 'giacca') AND contains(text, 'seta')",
    "filter_topup": _D + ", f AS (SELECT *, 0 AS p FROM d WHERE label = 3 ORDER BY distance, vec_id LIMIT 3), e AS (SELECT *, 1 AS p FROM d ORDER BY distance, vec_id LIMIT 15), u AS (SELECT * FROM f UNION ALL SELECT * FROM e WHERE (SELECT count(*) FROM f) < 5), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY p) = 1) SELECT vec_id, label, distance FROM k ORDER BY p, distance LIMIT 15",
    "filter_enough": _D + " SELECT * FROM d WHERE label = 3 ORDER BY distance, vec_id LIMIT 7",
    "rerank_score": _SCORE + " SELECT id, score FROM s",
    "rerank_top3": _SCORE + " SELECT id, score FROM s ORDER BY score DESC, id LIMIT 3",
    "sources_top5": "SELECT coalesce(doc, 'Unknown') AS document, min(doc_id) AS doc_id FROM documents GROUP BY 1 ORDER BY 2 LIMIT 5",
    "union_sources": "SELECT coalesce(doc, 'Unknown') AS document FROM documents WHERE doc_type = 'Letter' UNION SELECT coalesce(doc, 'Unknown') FROM documents WHERE doc_id % 3 = 0",
    "anchor_filters": f"WITH {ITEMS_SQL}, a AS (SELECT season_path AS s, colors_tags[1] AS c, garments_tags[1] AS g FROM items WHERE len(colors_tags) > 0 AND len(garments_tags) > 0 AND trim(colors_tags[1]) <> '' AND trim(garments_tags[1]) <> '' AND season_path IS NOT NULL ORDER BY id LIMIT 1) SELECT id, season_path FROM items, a WHERE season_path = s AND contains({_DOC}, c) AND contains({_DOC}, g)",
    "argument_filters": f"WITH {ITEMS_SQL} SELECT id FROM items WHERE year_path = '1996' AND contains({_DOC}, 'silk')",
    "referenced_image": _CAND + " SELECT path, rank::INT AS rank FROM c WHERE rank = 2",
    "ranked_images": _CAND + _SCORE.split("WITH " + ITEMS_SQL)[1].replace("AS (SELECT id,", f"AS (SELECT {PATH_SQL.format('source_path')} AS path,") + ", h AS (SELECT c.path, c.rank, s.score FROM c LEFT JOIN s USING (path)) SELECT path, score FROM h WHERE score IS NOT NULL OR NOT EXISTS (SELECT 1 FROM h WHERE score IS NOT NULL) ORDER BY score DESC, rank LIMIT 3",
    "found_text": "WITH h AS (SELECT doc_id, coalesce(title, '-') AS t FROM documents WHERE source = 'oral_history' ORDER BY doc_id LIMIT 10) SELECT coalesce(string_agg(t, chr(10) || chr(10) ORDER BY doc_id), 'No results were found.') AS text FROM h UNION ALL SELECT 'No results were found.'",
    "attributes_left": f"WITH {ITEMS_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_filter(coalesce(garments_tags, []), lambda t: NOT list_contains(coalesce(colors_tags, []), t)))), '|') AS left FROM items",
    "image_context": f"WITH {ITEMS_SQL}, t AS (SELECT *, flatten([coalesce(garments_tags, []), coalesce(colors_tags, []), coalesce(material_tags, [])]) AS tags FROM items) SELECT id, md5('Image ' || id || ' — ' || coalesce(season_path, '') || ' (' || coalesce(year_path, '') || '), ' || coalesce(collection_line, '') || CASE WHEN len(tags) > 0 THEN chr(10) || '  Tags: ' || array_to_string(tags[1:10], ', ') ELSE '' END || chr(10) || '  Description: ' || coalesce(nullif(llm_description, ''), '(no description available)')) AS block_md5 FROM t",
}
