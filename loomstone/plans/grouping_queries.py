"""Queries of clustering, hash matching, vocabulary and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import text as t
from loomstone.functions.paths import same_path
from loomstone.functions.vectors import sign_hash
from loomstone.operators import grouping, matching, vocabulary
from loomstone.operators.sequences import window_of_history
from loomstone.plans.archive import HASH_SQL, IMAGES_SQL, ITEMS_SQL, images, items
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table

EPS = 0.12


def _images(spark, sf_dir) -> DataFrame:
    return images(spark, sf_dir, "season").where("season is not null")


def eps_edges(spark, sf_dir):
    """Pairs of images of a season within the distance."""
    return grouping.near_pairs(_images(spark, sf_dir), "season", "id", "embedding", EPS).select("season", "a", "b", F.round("d", 6).alias("d"))


def eps_components(spark, sf_dir):
    """Density clusters of each season; noise has none."""
    return grouping.density_clusters(_images(spark, sf_dir), "season", "id", "embedding", EPS).select("season", "id", "comp")


def _refined(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = cut(_images(spark, sf_dir), "images")
    return rows, cut(grouping.refined(rows, "season", "id", "embedding", EPS, most=4, factor=0.7), "refined")


def recluster(spark, sf_dir):
    """Clusters after refining the large ones."""
    return _refined(spark, sf_dir)[1]


def cluster_metrics(spark, sf_dir):
    """Size, mean similarity and largest distance of each refined cluster."""
    rows, members = _refined(spark, sf_dir)
    return grouping.metrics(members, rows, "id", "embedding")


def cluster_registry(spark, sf_dir):
    """The registry of refined clusters with confidence."""
    rows, members = _refined(spark, sf_dir)
    return grouping.registry(members, grouping.metrics(members, rows, "id", "embedding"), "season", "id")


def _hashes(spark, sf_dir) -> DataFrame:
    return _images(spark, sf_dir).select("season", "id", sign_hash(F.col("embedding")).alias("h"))


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.conv(F.substring("id", 1, 6), 16, 10).cast("long") % 20 == 0)


def hamming_1nn(spark, sf_dir):
    """The nearest image of the season, by hash, to each image of the stated query set."""
    rows = cut(_hashes(spark, sf_dir), "hashes")
    return matching.nearest_hash(_queries(rows), rows, ["season"], "id", "h")


def hamming_buckets(spark, sf_dir):
    """The matches by kind, each image used once."""
    return matching.used_once(cut(hamming_1nn(spark, sf_dir), "matches"), ["season"]).select("season", "query", "match", "dist", "kind")


def hamming_radius(spark, sf_dir):
    """All images of the season within the radius of the stated query set."""
    rows = _hashes(spark, sf_dir)
    return matching.within_radius(_queries(rows), rows, ["season"], "id", "h")


def dhash_proxy(spark, sf_dir):
    """Metrics of each season's matches from hash distances."""
    return matching.proxy_metrics(hamming_radius(spark, sf_dir), "season", "dist")


def greedy_expand(spark, sf_dir):
    """Up to five images within the radius of each query, none taken twice."""
    pairs = hamming_radius(spark, sf_dir).select("season", F.col("query").alias("seed_pos"), F.col("query").alias("seed"), F.col("cand"), "dist")
    return grouping.greedy_expansion(pairs, "season", 5)


_BUNDLE = ["year", "season", "collection", "file", "look"]


def bundles(spark, sf_dir):
    """Outfit bundles with the distinct objects of their items."""
    return vocabulary.bundles(items(spark, sf_dir, *_BUNDLE, "source_path", "object"), _BUNDLE, "object", "id")


def harvest_terms(spark, sf_dir):
    """Documents per harvested term."""
    return vocabulary.harvest(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").groupBy("slot", "term").agg(F.count("*").alias("n_documents"))


def support_count(spark, sf_dir):
    """How many items' descriptions hold each canonical term."""
    terms = table(spark, sf_dir, "canonical_term", "term").distinct()
    return vocabulary.support(terms, items(spark, sf_dir, "llm_description").where("llm_description <> ''"), "id", "llm_description")


def _seeds(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "ontology_term").dropDuplicates(["term_id"]).withColumn("term", F.lower(F.trim("term")))
    return rows.select("slot", "term", F.col("edition").alias("source"), F.col("list_name").alias("source_group"), F.when(F.col("list_name") == "archive_keywords", 2).otherwise(1).alias("base_score"))


def seed_terms(spark, sf_dir):
    """Seed terms with sources, groups and best score."""
    return vocabulary.seed_terms(_seeds(spark, sf_dir))


def external_rank(spark, sf_dir):
    """The sixteen best terms of each slot."""
    known = table(spark, sf_dir, "canonical_term", "slot", F.lower("term").alias("term")).distinct().withColumn("archived", F.lit(True))
    terms = vocabulary.seed_terms(_seeds(spark, sf_dir)).join(known, ["slot", "term"], "left").withColumn("archived", F.coalesce("archived", F.lit(False))).withColumn("support", F.least(F.col("n_sources"), F.lit(6)))
    return vocabulary.ranked(terms, 16).select("slot", "term", "score", "rank")


def slot_normalise(spark, sf_dir):
    """Archive keywords with synonyms replaced."""
    rows = table(spark, sf_dir, "ontology_term", "term_id", "slot", "list_name", "term").where("list_name = 'archive_keywords'").dropDuplicates(["term_id"])
    return rows.select("term_id", vocabulary.lookup(F.col("slot"), F.lower(F.trim("term")), vocabulary.SYNONYMS).alias("canonical"))


def infer_slot(spark, sf_dir):
    """The slot each external term's words point to."""
    rows = table(spark, sf_dir, "ontology_term", "term_id", "list_name", "term").where("list_name = 'external_seed_keywords'").dropDuplicates(["term_id"])
    return rows.select("term_id", vocabulary.slot_of(F.lower("term")).alias("inferred"))


def simplify_text(spark, sf_dir):
    """Simplified terms and slugs."""
    rows = table(spark, sf_dir, "ontology_term", "term_id", "term").dropDuplicates(["term_id"])
    return rows.select("term_id", t.simplify(F.col("term")).alias("simple"), t.slugify(F.col("term")).alias("slug"))


def ontology_nested(spark, sf_dir):
    """Each edition's slots with their terms in order."""
    rows = table(spark, sf_dir, "ontology_term", "term_id", "edition", "slot", "list_name", "pos", "term").dropDuplicates(["term_id"])
    listed = F.array_sort(F.collect_list(F.struct("pos", "term_id", "term")))
    return rows.groupBy("edition", "slot", "list_name").agg(F.array_join(F.transform(listed, lambda x: x["term"]), "|").alias("terms"))


def _turns(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "props")
    return rows.select(F.col("user_id").alias("chat"), F.col("event_id").alias("seq"), F.col("ts"), F.col("event_type").alias("role"), F.col("props").alias("content"))


def recent_chats(spark, sf_dir):
    """The twenty chats with the latest turn."""
    return _turns(spark, sf_dir).groupBy("chat").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("dts"), F.count("*").alias("n_turns")).orderBy(F.desc("dts"), "chat").limit(20)


def history_window(spark, sf_dir):
    """Each chat's last fifty turns."""
    return window_of_history(_turns(spark, sf_dir), ["chat"], [F.desc("ts"), F.desc("seq")], 50).select("chat", "seq")


def session_rebuild(spark, sf_dir):
    """Each chat's turns of the kept roles as one text, in order."""
    rows = _turns(spark, sf_dir).where("role in ('view', 'click')")
    turns = F.array_sort(F.collect_list(F.struct("ts", "seq", F.concat_ws(": ", "role", "content").alias("line"))))
    return rows.groupBy("chat").agg(F.md5(F.array_join(F.transform(turns, lambda x: x["line"]), "\n")).alias("session_md5"))


def chat_title(spark, sf_dir):
    """A chat's title: the first fifty characters of its first turn and three dots."""
    first = _turns(spark, sf_dir).groupBy("chat").agg(F.min_by("content", F.struct("ts", "seq")).alias("c"))
    return first.select("chat", F.concat(F.substring(F.coalesce(F.nullif("c", F.lit("")), F.lit("Chat")), 1, 50), F.lit("...")).alias("title"))


def citations(spark, sf_dir):
    """Numbers cited in the bibliography's bracketed markers."""
    rows = items(spark, sf_dir, "bibliography").where("bibliography is not null")
    return rows.select("id", F.posexplode(t.citations(F.col("bibliography"))).alias("at", "cited"))


def answer_json(spark, sf_dir):
    """A number out of a fenced JSON answer."""
    rows = table(spark, sf_dir, "events", "event_id", "props").withColumn("answer", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    return rows.select("event_id", t.json_in(F.col("answer"), "k long")["k"].alias("k"))


def shared_images(spark, sf_dir):
    """Images whose clusters share a document, by cluster type."""
    rows = table(spark, sf_dir, "cluster_registry", "cluster_id", "cluster_type", "image_paths").dropDuplicates(["cluster_id"])
    return rows.select("cluster_type", F.explode("image_paths").alias("p")).select("cluster_type", same_path(F.col("p")).alias("path")).groupBy("cluster_type").agg(F.count_distinct("path").alias("n_images"))


QUERIES = {
    f.__name__: f
    for f in (eps_edges, eps_components, recluster, cluster_metrics, cluster_registry, hamming_1nn, hamming_buckets, hamming_radius, dhash_proxy, greedy_expand, bundles, harvest_terms, support_count, seed_terms, external_rank, slot_normalise, infer_slot, simplify_text, ontology_nested, recent_chats, history_window, session_rebuild, chat_title, citations, answer_json, shared_images)
}

_E = IMAGES_SQL + ", e AS (SELECT a.season, a.id AS a, b.id AS b, list_cosine_distance(a.v, b.v) AS d FROM images a JOIN images b ON a.season = b.season AND a.id < b.id WHERE list_cosine_distance(a.v, b.v) <= 0.12)"


def _comp(edges: str, name: str) -> str:
    return f"{name}_u AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}), {name}_r(x, y) AS (SELECT x, x FROM {name}_u UNION SELECT r.x, u.y FROM {name}_r r JOIN {name}_u u ON r.y = u.x), {name} AS (SELECT x AS id, min(y) AS comp FROM {name}_r GROUP BY 1)"


_R = (
    f"WITH RECURSIVE {_E}, {_comp('e', 'c')}, z AS (SELECT comp FROM c GROUP BY 1 HAVING count(*) > 4), g AS (SELECT id, comp FROM c WHERE comp IN (SELECT comp FROM z)),"
    f" e2 AS (SELECT e.a, e.b FROM e JOIN g ON g.id = e.a WHERE e.d <= 0.084), {_comp('e2', 'k')}, k4 AS (SELECT comp FROM k GROUP BY 1 HAVING count(*) <= 4),"
    " m AS (SELECT i.season, i.id, CASE WHEN g.id IS NOT NULL THEN coalesce(k.comp, i.id) ELSE coalesce(c.comp, i.id) END AS cluster, g.id IS NOT NULL AS reclustered FROM images i LEFT JOIN c ON c.id = i.id LEFT JOIN g ON g.id = i.id LEFT JOIN k ON k.id = i.id AND k.comp IN (SELECT comp FROM k4) WHERE i.season IS NOT NULL)"
)
_M = _R + ", p AS (SELECT x.cluster, list_cosine_distance(a.v, b.v) AS d FROM m x JOIN m y ON x.cluster = y.cluster AND x.id < y.id JOIN images a ON a.id = x.id JOIN images b ON b.id = y.id), q AS (SELECT cluster, avg(1 - d) AS s, max(d) AS d FROM p GROUP BY 1), n AS (SELECT cluster, count(*)::INT AS cluster_size FROM m GROUP BY 1), t AS (SELECT n.cluster, cluster_size, round(coalesce(s, 1.0), 4) AS avg_similarity, round(greatest(coalesce(d, 0.0), 0.0), 4) AS max_pairwise_distance FROM n LEFT JOIN q USING (cluster))"
_H = f"WITH {IMAGES_SQL}, h AS (SELECT season, id, {HASH_SQL} AS h FROM images WHERE season IS NOT NULL), qs AS (SELECT * FROM h WHERE ('0x' || substr(id, 1, 6))::BIGINT % 20 = 0), d AS (SELECT q.season, q.id AS query, c.id AS cand, bit_count(xor(q.h, c.h))::INT AS dist FROM qs q JOIN h c ON q.season = c.season AND q.id <> c.id)"
_NN = _H + ", nn AS (SELECT season, query, cand AS match, dist FROM d QUALIFY row_number() OVER (PARTITION BY season, query ORDER BY dist, cand) = 1)"
_T = "t AS (SELECT user_id AS chat, event_id AS seq, ts, event_type AS role, props AS content FROM events)"
_O = "o AS (SELECT DISTINCT ON (term_id) * FROM ontology_term)"
_S = f"WITH {_O}, s AS (SELECT slot, lower(trim(term)) AS term, count(DISTINCT edition) AS n_sources, count(DISTINCT list_name) AS n_groups, max(CASE WHEN list_name = 'archive_keywords' THEN 2 ELSE 1 END)::INT AS base_score FROM o WHERE NOT (lower(trim(term)) IN ({', '.join(repr(x) for x in vocabulary.STOP_TERMS)}) OR length(trim(term)) > 60 OR regexp_matches(lower(trim(term)), '^[\\d\\W]+$') OR regexp_matches(lower(trim(term)), '^no ')) GROUP BY 1, 2)"
_SYN = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in vocabulary.SYNONYMS) + ") y(slot, f, c)"
_KEY = " || '|' || ".join(f"coalesce(trim({c}), '')" for c in _BUNDLE)
ORACLES = {
    "eps_edges": f"WITH {_E} SELECT season, a, b, round(d, 6) AS d FROM e",
    "eps_components": f"WITH RECURSIVE {_E}, {_comp('e', 'c')} SELECT season, id, comp FROM images LEFT JOIN c USING (id) WHERE season IS NOT NULL",
    "recluster": _R + " SELECT season, id, cluster, reclustered FROM m",
    "cluster_metrics": _M + " SELECT * FROM t",
    "cluster_registry": _M + ", g2 AS (SELECT season, cluster, string_agg(id, ' ' ORDER BY id) AS members, bool_or(reclustered) AS reclustered FROM m GROUP BY 1, 2) SELECT season || '_cluster_' || lpad((row_number() OVER (PARTITION BY season ORDER BY cluster_size = 1, cluster) - 1)::VARCHAR, 3, '0') AS cluster_name, season, members, cluster_size, reclustered, avg_similarity, max_pairwise_distance, CASE WHEN cluster_size >= 2 AND (max_pairwise_distance > 0.35 OR avg_similarity < 0.70) THEN 'low' WHEN cluster_size = 1 THEN 'high' WHEN cluster_size <= 4 THEN CASE WHEN reclustered THEN 'medium' ELSE 'high' END ELSE 'low' END AS cluster_confidence FROM g2 JOIN t USING (cluster)",
    "hamming_1nn": _NN + " SELECT * FROM nn",
    "hamming_buckets": _NN + ", k AS (SELECT *, CASE WHEN dist <= 6 THEN 'exact' WHEN dist <= 14 THEN 'near' ELSE 'unmatched' END AS kind FROM nn) SELECT * FROM k WHERE kind = 'unmatched' UNION ALL SELECT * FROM (SELECT * FROM k WHERE kind <> 'unmatched' QUALIFY row_number() OVER (PARTITION BY season, match ORDER BY query) = 1)",
    "hamming_radius": _H + " SELECT * FROM d WHERE dist <= 10",
    "dhash_proxy": _H + " SELECT season, count(*)::INT AS cluster_size, round(avg(greatest(0.0, 1 - dist / 64.0)), 4) AS avg_similarity, round(max(dist) / 64.0, 4)::DOUBLE AS max_pairwise_distance, CASE WHEN max(dist) <= 2 THEN 'high' WHEN max(dist) <= 6 THEN 'medium' ELSE 'low' END AS cluster_confidence FROM d WHERE dist <= 10 GROUP BY season",
    "bundles": f"WITH {ITEMS_SQL}, b AS (SELECT id, sha1(CASE WHEN replace({_KEY}, '|', '') = '' THEN coalesce(source_path, '') ELSE {_KEY} END) AS bundle, trim(object) AS v FROM items), f AS (SELECT bundle, v, min(id) AS o FROM b WHERE v <> '' GROUP BY 1, 2), x AS (SELECT bundle, string_agg(v, ' | ' ORDER BY o, v) AS texts FROM f GROUP BY 1) SELECT bundle, count(*) AS n_items, any_value(texts) AS texts FROM b LEFT JOIN x USING (bundle) GROUP BY 1",
    "harvest_terms": "SELECT slot, term, count(*) AS n_documents FROM documents JOIN (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in vocabulary.PATTERNS) + ") p(slot, term, pat) ON regexp_matches(lower(text), pat) GROUP BY 1, 2",
    "support_count": f"WITH {ITEMS_SQL}, d AS (SELECT id, regexp_replace(lower(llm_description), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') AS h FROM items WHERE llm_description <> ''), t AS (SELECT DISTINCT trim(regexp_replace(lower(term), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS term FROM canonical_term WHERE term IS NOT NULL) SELECT term, count(id) AS support FROM t LEFT JOIN d ON contains(' ' || h || ' ', ' ' || term || ' ') OR replace(h, ' ', '') = replace(term, ' ', '') WHERE term <> '' GROUP BY 1",
    "seed_terms": _S + " SELECT slot, term, n_sources, n_groups, base_score FROM s",
    "external_rank": _S + ", k AS (SELECT DISTINCT slot, lower(term) AS term FROM canonical_term), x AS (SELECT s.slot, s.term, (base_score + 3 * n_groups + n_sources + least(least(n_sources, 6), 6) + CASE WHEN k.term IS NOT NULL THEN 5 WHEN n_sources > 0 THEN 3 ELSE 0 END)::INT AS score FROM s LEFT JOIN k ON k.slot = s.slot AND k.term = s.term), r AS (SELECT *, (row_number() OVER (PARTITION BY slot ORDER BY score DESC, term))::INT AS rank FROM x) SELECT * FROM r WHERE rank <= 16",
    "slot_normalise": f"WITH {_O} SELECT term_id, coalesce(y.c, lower(trim(term))) AS canonical FROM o LEFT JOIN {_SYN} ON y.slot = o.slot AND y.f = lower(trim(term)) WHERE list_name = 'archive_keywords'",
    "infer_slot": f"WITH {_O} SELECT term_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(term), {w!r})' for w in words)} THEN '{slot}'" for slot, words in vocabulary.HINTS) + " ELSE 'garments' END AS inferred FROM o WHERE list_name = 'external_seed_keywords'",
    "ontology_nested": f"WITH {_O} SELECT edition, slot, list_name, string_agg(term, '|' ORDER BY pos, term_id) AS terms FROM o GROUP BY 1, 2, 3",
    "recent_chats": f"WITH {_T} SELECT chat, max(floor(epoch(ts)))::BIGINT AS dts, count(*) AS n_turns FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "history_window": f"WITH {_T} SELECT chat, seq FROM t QUALIFY row_number() OVER (PARTITION BY chat ORDER BY ts DESC, seq DESC) <= 50",
    "session_rebuild": f"WITH {_T} SELECT chat, md5(string_agg(role || ': ' || content, chr(10) ORDER BY ts, seq)) AS session_md5 FROM t WHERE role IN ('view', 'click') GROUP BY 1",
    "chat_title": f"WITH {_T} SELECT chat, substr(coalesce(nullif(arg_min(content, (ts, seq)), ''), 'Chat'), 1, 50) || '...' AS title FROM t GROUP BY 1",
    "citations": f"WITH {ITEMS_SQL}, m AS (SELECT id, flatten(list_transform(regexp_extract_all(bibliography, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))) AS c FROM items WHERE bibliography IS NOT NULL) SELECT id, (generate_subscripts(c, 1) - 1)::INT AS at, unnest(c)::INT AS cited FROM m",
    "answer_json": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
    "shared_images": "WITH r AS (SELECT DISTINCT ON (cluster_id) * FROM cluster_registry) SELECT cluster_type, count(DISTINCT regexp_replace(regexp_replace(trim(p), '[\\\\/]+', '/', 'g'), '^(\\./)+', '')) AS n_images FROM (SELECT cluster_type, unnest(image_paths) AS p FROM r) GROUP BY 1",
}
