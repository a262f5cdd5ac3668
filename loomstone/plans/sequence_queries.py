"""Queries of splitting, order-dependent and join operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as t
from loomstone.functions.paths import same_path
from loomstone.functions.tokens import token_length
from loomstone.functions.vectors import cosine_distance
from loomstone.operators import chunking, sequences
from loomstone.operators.retrieval import first_of
from loomstone.plans.archive import ITEMS_SQL, PATH_SQL, items
from loomstone.sources.tables import table


def _docs(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", *columns)


def char_chunks(spark, sf_dir):
    """Character windows of 350, 50 of them shared; with their digests to compare."""
    return chunking.char_chunks(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "chunk_ix", F.md5("chunk").alias("chunk_md5"))


def chunk_offsets(spark, sf_dir):
    """Sum of the lengths of a document's chunks before each."""
    rows = chunking.char_chunks(_docs(spark, sf_dir), "doc_id", "text")
    return sequences.offsets(rows, ["doc_id"], ["chunk_ix"], "chunk").select("doc_id", "chunk_ix", "start_index")


def sentence_split(spark, sf_dir):
    """Sentences of documents."""
    return chunking.sentence_rows(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "sent_ix", F.md5("sentence").alias("sentence_md5"))


def sentence_buffer(spark, sf_dir):
    """Each sentence with its neighbours."""
    rows = chunking.sentence_rows(_docs(spark, sf_dir), "doc_id", "text")
    return sequences.buffered(rows, ["doc_id"], ["sent_ix"], "sentence", 1).select("doc_id", "sent_ix", F.md5("context").alias("context_md5"))


def semantic_chunks(spark, sf_dir):
    """Chunks between the largest distances of neighbouring sentences."""
    return chunking.semantic_chunks(_docs(spark, sf_dir), "doc_id", "text")


def recursive_chunks(spark, sf_dir):
    """Chunks by the recursive split."""
    return chunking.recursive_chunks(_docs(spark, sf_dir), "doc_id", "text")


def token_chunks(spark, sf_dir):
    """Chunks by the recursive split, measured in tokens."""
    return chunking.split(_docs(spark, sf_dir), "doc_id", "text", "recursive-split", length=token_length()).select("doc_id", "chunk_ix", F.md5("chunk").alias("chunk_md5"))


def token_windows(spark, sf_dir):
    """Windows of characters measured in tokens."""
    return chunking.split(_docs(spark, sf_dir), "doc_id", "text", "char-split", length=token_length()).select("doc_id", "chunk_ix", F.md5("chunk").alias("chunk_md5"))


def semantic_thresholds(spark, sf_dir):
    """How many chunks each kind of threshold gives a document, and the wish for five."""
    docs, ways = _docs(spark, sf_dir), {**{k: {"kind": k} for k in sequences.BREAKPOINTS}, "five": {"n_chunks": 5}}
    parts = [chunking.semantic_chunks(docs, "doc_id", "text", **how).groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(k).alias("way"), "n") for k, how in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_thresholds(spark, sf_dir):
    """The four kinds of threshold side by side."""
    rows = _distances(spark, sf_dir)
    parts = [sequences.threshold_of(rows, ["label"], ["vec_id"], "d", k).select("label", F.lit(k).alias("kind"), F.round("limit", 6).alias("limit")) for k in sequences.BREAKPOINTS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _distances(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("d", F.round(cosine_distance(F.col("embedding"), F.lead("embedding").over(w)), 6))
    return rows.where("d is not null").select("label", "vec_id", "d")


def neighbor_distance(spark, sf_dir):
    """Distance of each vector to the next of its label."""
    return _distances(spark, sf_dir)


def thresholds(spark, sf_dir):
    """Breakpoint thresholds by percentile, deviation and range."""
    got = sequences.thresholds(_distances(spark, sf_dir), ["label"], "d")
    return got.select("label", *[F.round(c, 6).alias(c) for c in ("by_percentile", "by_deviation", "by_range")])


def threshold_gradient(spark, sf_dir):
    """Percentile of the distances' gradients."""
    g = sequences.gradient(_distances(spark, sf_dir), ["label"], ["vec_id"], "d")
    return g.groupBy("label").agg(F.round(F.percentile("gradient", F.lit(0.95)), 6).alias("by_gradient"))


def threshold_by_count(spark, sf_dir):
    """The threshold that leaves about ten chunks."""
    got = sequences.threshold_for_count(_distances(spark, sf_dir), ["label"], "d", 10)
    return got.select("label", F.round("by_count", 6).alias("by_count"))


def segments(spark, sf_dir):
    """Runs of vectors up to a distance above the percentile."""
    rows = _distances(spark, sf_dir)
    limit = sequences.thresholds(rows, ["label"], "d").select("label", "by_percentile")
    return sequences.segments(rows.join(limit, "label"), ["label"], ["vec_id"], F.col("d") > F.col("by_percentile")).select("label", "vec_id", "segment")


def gap_clusters(spark, sf_dir):
    """Runs of a user's events without a gap of more than six hours, and their mean time."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    rows = sequences.gap_groups(events, ["user_id"], ["s", "event_id"], "s", 6 * 3600)
    return rows.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.round(F.avg("s"), 3).alias("centre"))


def carry_forward(spark, sf_dir):
    """The latest purchase value up to each event."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return sequences.carried(events, ["user_id"], ["ts", "event_id"], "v", "last_value").select("event_id", "last_value")


def asof_header(spark, sf_dir):
    """Each click with the latest view at or before it."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    left = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    right = right.withColumn("tie", F.col("view_id"))
    return sequences.as_of(left, right, ["user_id"], "ts", "view_id", "tie").select("event_id", "view_id")


def nearest_center(spark, sf_dir):
    """The nearest of three centres to each price."""
    rows = table(spark, sf_dir, "part", "p_partkey", "p_retailprice")
    return rows.select("p_partkey", sequences.nearest_centre(F.col("p_retailprice"), [500.0, 1000.0, 1500.0]).alias("centre"))


def enrich_left(spark, sf_dir):
    """Images with their items' fields, by comparable path."""
    own = items(spark, sf_dir, "source_path", "designer").select(t.nfc(same_path(F.col("source_path"))).alias("path"), F.col("id").alias("item_id"), "designer")
    rows = table(spark, sf_dir, "image_embedding", "id", "path").distinct().select("id", t.nfc(same_path(F.col("path"))).alias("path")).distinct()
    return rows.join(own, "path", "left").select("id", "path", "item_id", "designer")


def unmatched_count(spark, sf_dir):
    """Images with and without an item."""
    rows = enrich_left(spark, sf_dir)
    return rows.agg(F.count("*").alias("n_images"), F.count_if(F.col("item_id").isNull()).alias("n_unmatched"))


def missing_anti(spark, sf_dir):
    """Images that no item names."""
    own = items(spark, sf_dir, "source_path").select(same_path(F.col("source_path")).alias("path"))
    rows = table(spark, sf_dir, "image_embedding", "id", "path").select("id", same_path(F.col("path")).alias("path")).distinct()
    return rows.join(own, "path", "left_anti")


def resume_skip(spark, sf_dir):
    """Clusters of which an image isn't known yet, if those of the backstage aren't."""
    known = items(spark, sf_dir, "source_path", "asset_type").where("asset_type <> 'backstage'").select(same_path(F.col("source_path")).alias("path")).distinct()
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "image_paths").dropDuplicates(["cluster_id"])
    each = rows.select("cluster_id", F.explode("image_paths").alias("p")).select("cluster_id", same_path(F.col("p")).alias("path"))
    return each.join(known, "path", "left_anti").select("cluster_id").distinct()


def status_rollup(spark, sf_dir):
    """A cluster's status: available if any of its documents' clusters is."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "pdf_paths", "pdf_status").dropDuplicates(["cluster_id"])
    each = rows.select("cluster_id", "pdf_status", F.explode_outer("pdf_paths").alias("pdf"))
    by_pdf = each.where("pdf is not null").groupBy("pdf").agg(F.bool_or(F.col("pdf_status") == "available").alias("ok"))
    out = each.join(by_pdf, "pdf", "left").groupBy("cluster_id").agg(F.bool_or("ok").alias("any_ok"), F.count("pdf").alias("n"))
    return out.select("cluster_id", F.when(F.col("n") == 0, "missing").when(F.coalesce("any_ok", F.lit(False)), "available").otherwise("incomplete").alias("status"))


def first_match(spark, sf_dir):
    """The first line of each order, by line number."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return rows.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"))


def last_wins(spark, sf_dir):
    """The latest loading time's deliveries of each item."""
    rows = table(spark, sf_dir, "fashion_item", "id", "loaded_at").withColumn("seq", F.col("loaded_at"))
    return sequences.last_wins(rows, ["id"], "loaded_at", "seq").select("id", F.date_format("loaded_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


def explode_images(spark, sf_dir):
    """One row per image of a cluster, with its place."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "image_paths").dropDuplicates(["cluster_id"])
    return rows.select("cluster_id", F.posexplode("image_paths").alias("pos", "image_path"))


def image_map_priority(spark, sf_dir):
    """Per image the first cluster, refined ones before others."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "image_paths", "reclustered").dropDuplicates(["cluster_id"])
    each = rows.select("cluster_id", F.explode("image_paths").alias("image_path"), F.when(F.col("reclustered"), 0).otherwise(1).alias("prio"))
    return first_of(each, ["image_path"], ["prio", "cluster_id"])


def registry_union(spark, sf_dir):
    """The registries of both cluster types, one after the other, with a constant column."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "cluster_type", "season").dropDuplicates(["cluster_id"])
    a = rows.where("cluster_type = 'embedding'").withColumn("origin", F.lit("embedding"))
    b = rows.where("cluster_type = 'dhash'").drop("season").withColumn("origin", F.lit("dhash"))
    return a.unionByName(b, allowMissingColumns=True).select("cluster_id", "season", "origin")


def batch_select(spark, sf_dir):
    """The second batch of 500 orders in order."""
    return sequences.batch_of(table(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey"], 500, 2)


def total_batches(spark, sf_dir):
    """The number of batches of 20."""
    return table(spark, sf_dir, "cluster_registry", "cluster_id").distinct().agg(F.ceil(F.count("*") / 20).cast("long").alias("n_batches"))


def dup_key_check(spark, sf_dir):
    """Comparable paths that items and images spell differently."""
    both = table(spark, sf_dir, "fashion_item", F.col("source_path").alias("p")).unionByName(table(spark, sf_dir, "image_embedding", F.col("path").alias("p"))).where("p is not null").distinct()
    return both.select(same_path(F.col("p")).alias("path_key")).groupBy("path_key").agg(F.count("*").alias("n")).where("n > 1")


def keep_first_paths(spark, sf_dir):
    """Each path of a cluster once, at its first place."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "image_paths").dropDuplicates(["cluster_id"])
    each = rows.select("cluster_id", F.posexplode("image_paths").alias("pos", "p")).select("cluster_id", "pos", same_path(F.col("p")).alias("path"))
    return each.groupBy("cluster_id", "path").agg(F.min("pos").alias("pos"))


def json_props(spark, sf_dir):
    """A number out of each event's JSON."""
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (char_chunks, chunk_offsets, sentence_split, sentence_buffer, semantic_chunks, recursive_chunks, token_chunks, token_windows, semantic_thresholds, all_thresholds, neighbor_distance, thresholds, threshold_gradient, threshold_by_count, segments, gap_clusters, carry_forward, asof_header, nearest_center, enrich_left, unmatched_count, missing_anti, resume_skip, status_rollup, first_match, last_wins, explode_images, image_map_priority, registry_union, batch_select, total_batches, dup_key_check, keep_first_paths, json_props)
}

_N = "greatest(1, ceil((length(text) - 350) / 300.0)::INT + 1)"
_CHUNKS = f"c AS (SELECT doc_id, i AS chunk_ix, substr(text, i * 300 + 1, 350) AS chunk FROM (SELECT doc_id, text, unnest(range({_N})) AS i FROM documents WHERE length(text) > 0))"
_SENT = "s AS (SELECT doc_id, sentence, sent_ix - 1 AS sent_ix FROM (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS sent_ix FROM (SELECT doc_id, string_split(regexp_replace(text, '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(31), 'g'), chr(31)) AS p FROM documents WHERE length(text) > 0)))"
_DIST = "d AS (SELECT label, vec_id, round(list_cosine_distance(embedding::DOUBLE[], (lead(embedding) OVER (PARTITION BY label ORDER BY vec_id))::DOUBLE[]), 6) AS d FROM embeddings QUALIFY lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NOT NULL)"
_REG = "r AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry)"
_IMG = f"i AS (SELECT DISTINCT id, {PATH_SQL.format('path')} AS path FROM image_embedding)"
_OWN = f"o AS (SELECT id AS item_id, designer, {PATH_SQL.format('source_path')} AS path FROM items)"
ORACLES = {
    "char_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_ix::INT AS chunk_ix, md5(chunk) AS chunk_md5 FROM c",
    "chunk_offsets": f"WITH {_CHUNKS} SELECT doc_id, chunk_ix::INT AS chunk_ix, coalesce(sum(length(chunk)) OVER (PARTITION BY doc_id ORDER BY chunk_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_index FROM c",
    "sentence_split": f"WITH {_SENT} SELECT doc_id, sent_ix::INT AS sent_ix, md5(sentence) AS sentence_md5 FROM s",
    "sentence_buffer": f"WITH {_SENT} SELECT doc_id, sent_ix::INT AS sent_ix, md5(array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY sent_ix ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ')) AS context_md5 FROM s",
    "neighbor_distance": f"WITH {_DIST} SELECT label, vec_id, d FROM d",
    "thresholds": f"WITH {_DIST} SELECT label, round(quantile_cont(d, 0.95), 6) AS by_percentile, round(avg(d) + 3 * stddev_pop(d), 6) AS by_deviation, round(avg(d) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 6) AS by_range FROM d GROUP BY label",
    "threshold_gradient": f"WITH {_DIST}, g AS (SELECT label, CASE WHEN b IS NULL THEN a - d WHEN a IS NULL THEN d - b ELSE (a - b) / 2 END AS g FROM (SELECT label, d, lag(d) OVER w AS b, lead(d) OVER w AS a FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id))) SELECT label, round(quantile_cont(g, 0.95), 6) AS by_gradient FROM g GROUP BY label",
    "all_thresholds": f"WITH {_DIST}, g AS (SELECT label, d, CASE WHEN b IS NULL THEN a - d WHEN a IS NULL THEN d - b ELSE (a - b) / 2 END AS g FROM (SELECT label, d, lag(d) OVER w AS b, lead(d) OVER w AS a FROM d WINDOW w AS (PARTITION BY label ORDER BY vec_id))), t AS (SELECT label, quantile_cont(d, 0.95) AS percentile, avg(d) + 3 * stddev_pop(d) AS standard_deviation, avg(d) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS interquartile, quantile_cont(g, 0.95) AS gradient FROM g GROUP BY label) SELECT label, kind, round(v, 6) AS \"limit\" FROM t UNPIVOT (v FOR kind IN (percentile, standard_deviation, interquartile, gradient))",
    "threshold_by_count": f"WITH {_DIST}, n AS (SELECT label, count(*) AS n, list(d ORDER BY d) AS v FROM d GROUP BY label), h AS (SELECT *, (1 - (greatest(1, least(10, n)) - 1) / (n - 1)::DOUBLE) * (n - 1) AS h FROM n) SELECT label, round(v[floor(h)::INT + 1] + (h - floor(h)) * (v[ceil(h)::INT + 1] - v[floor(h)::INT + 1]), 6) AS by_count FROM h",
    "segments": f"WITH {_DIST}, t AS (SELECT label, quantile_cont(d, 0.95) AS t FROM d GROUP BY label) SELECT label, vec_id, coalesce(sum((d > t)::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS segment FROM d JOIN t USING (label)",
    "gap_clusters": "WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS s FROM events), g AS (SELECT *, (s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 21600)::INT AS n FROM e), r AS (SELECT *, sum(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::INT AS grp FROM g) SELECT user_id, grp, count(*) AS n, round(avg(s), 3) AS centre FROM r GROUP BY 1, 2",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_value FROM events",
    "asof_header": "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT c.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts",
    "nearest_center": "SELECT p_partkey, CASE WHEN abs(p_retailprice - 500) <= abs(p_retailprice - 1000) AND abs(p_retailprice - 500) <= abs(p_retailprice - 1500) THEN 0 WHEN abs(p_retailprice - 1000) <= abs(p_retailprice - 1500) THEN 1 ELSE 2 END AS centre FROM part",
    "enrich_left": f"WITH {ITEMS_SQL}, {_IMG}, {_OWN} SELECT id, i.path, item_id, designer FROM i LEFT JOIN o USING (path)",
    "unmatched_count": f"WITH {ITEMS_SQL}, {_IMG}, {_OWN} SELECT count(*) AS n_images, count_if(item_id IS NULL)::BIGINT AS n_unmatched FROM i LEFT JOIN o USING (path)",
    "missing_anti": f"WITH {ITEMS_SQL}, {_IMG}, {_OWN} SELECT id, path FROM i WHERE path NOT IN (SELECT path FROM o WHERE path IS NOT NULL)",
    "resume_skip": f"WITH {ITEMS_SQL}, o AS (SELECT {PATH_SQL.format('source_path')} AS path FROM items WHERE asset_type <> 'backstage'), {_REG}, e AS (SELECT cluster_id, {PATH_SQL.format('p')} AS path FROM (SELECT cluster_id, unnest(image_paths) AS p FROM r)) SELECT DISTINCT cluster_id FROM e WHERE path NOT IN (SELECT path FROM o WHERE path IS NOT NULL)",
    "status_rollup": f"WITH {_REG}, e AS (SELECT cluster_id, pdf_status, unnest(CASE WHEN len(coalesce(pdf_paths, [])) = 0 THEN [NULL] ELSE pdf_paths END) AS pdf FROM r), p AS (SELECT pdf, bool_or(pdf_status = 'available') AS ok FROM e WHERE pdf IS NOT NULL GROUP BY pdf) SELECT cluster_id, CASE WHEN count(e.pdf) = 0 THEN 'missing' WHEN coalesce(bool_or(ok), FALSE) THEN 'available' ELSE 'incomplete' END AS status FROM e LEFT JOIN p USING (pdf) GROUP BY cluster_id",
    "first_match": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1",
    "last_wins": "SELECT id, strftime(max(loaded_at), '%Y-%m-%d %H:%M:%S') AS loaded FROM fashion_item GROUP BY id",
    "explode_images": f"WITH {_REG} SELECT cluster_id, (generate_subscripts(image_paths, 1) - 1)::INT AS pos, unnest(image_paths) AS image_path FROM r",
    "image_map_priority": f"WITH {_REG}, e AS (SELECT cluster_id, unnest(image_paths) AS image_path, CASE WHEN reclustered THEN 0 ELSE 1 END AS prio FROM r) SELECT cluster_id, image_path, prio FROM e QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY prio, cluster_id) = 1",
    "registry_union": f"WITH {_REG} SELECT cluster_id, season, 'embedding' AS origin FROM r WHERE cluster_type = 'embedding' UNION ALL SELECT cluster_id, NULL, 'dhash' FROM r WHERE cluster_type = 'dhash'",
    "batch_select": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 500 OFFSET 500",
    "total_batches": "SELECT ceil(count(DISTINCT cluster_id) / 20.0)::BIGINT AS n_batches FROM cluster_registry",
    "dup_key_check": f"SELECT path_key, count(*) AS n FROM (SELECT DISTINCT p, {PATH_SQL.format('p')} AS path_key FROM (SELECT source_path AS p FROM fashion_item UNION ALL SELECT path FROM image_embedding) WHERE p IS NOT NULL) GROUP BY 1 HAVING count(*) > 1",
    "keep_first_paths": f"WITH {_REG}, e AS (SELECT cluster_id, (generate_subscripts(image_paths, 1) - 1)::INT AS pos, unnest(image_paths) AS p FROM r) SELECT cluster_id, {PATH_SQL.format('p')} AS path, min(pos) AS pos FROM e GROUP BY 1, 2",
    "json_props": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
}
