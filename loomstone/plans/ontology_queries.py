"""Queries of the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators import ontology as o
from loomstone.operators import terms as T
from loomstone.operators.vocabulary import bundle_key, support
from loomstone.plans.archive import items
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table

_SLOTS = dict(zip(["garments", "colors", "materials", "patterns", "silhouette", "length", "neckline", "sleeve", "closure", "embellishment", "style"], T.SLOTS))
_FIELDS = ["object", "label", "description", "materials", "working_process", "remark"]
_KEY = ["year", "season", "collection", "file", "look"]


def _slot(column: str = "slot"):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in _SLOTS.items() for x in pair]), F.col(column))


def _terms(spark, sf_dir, list_name: str) -> DataFrame:
    rows = table(spark, sf_dir, "ontology_term", "term_id", "edition", "slot", "list_name", "pos", "term").where(F.col("list_name") == list_name)
    return rows.dropDuplicates(["term_id"]).withColumn("slot", _slot())


def keyword_names(spark, sf_dir):
    """What the vocabulary calls each archive keyword; null for what is none."""
    return o.canonical(_terms(spark, sf_dir, "archive_keywords"), "slot", "term", "name").select("term_id", "name")


def _bundled(spark, sf_dir) -> DataFrame:
    rows = items(spark, sf_dir, "source_path", *_KEY, *_FIELDS).withColumn("bundle", bundle_key(_KEY, "source_path"))
    return o.bundle_texts(rows, "bundle", _FIELDS, "id")


def bundle_fields(spark, sf_dir):
    """Each outfit bundle's distinct texts of each field, cleaned, in order."""
    return _bundled(spark, sf_dir)


def _reference(spark, sf_dir) -> DataFrame:
    entries = table(spark, sf_dir, "canonical_term", "slot", "term", "term_it").where("slot in ('materials', 'garments', 'patterns')")
    return entries.select(_slot().alias("slot"), "term", F.explode(F.array("term", "term_it")).alias("form"))


def harvested_terms(spark, sf_dir):
    """Terms that bundles' texts hold, with the number of bundles."""
    return o.harvested(cut(_bundled(spark, sf_dir), "bundles"), cut(o.phrases(_reference(spark, sf_dir)), "phrases"))


def merged_vocabulary(spark, sf_dir):
    """The newest edition's two lists as one, names in vocabulary form, by support in the items' descriptions."""
    last = table(spark, sf_dir, "ontology_term", "edition").agg(F.max("edition").alias("edition"))
    lists = [_terms(spark, sf_dir, n).join(F.broadcast(last), "edition", "left_semi") for n in ("archive_keywords", "external_seed_keywords")]
    texts = items(spark, sf_dir, "llm_description").select(F.col("id").alias("key"), F.col("llm_description").alias("text"))
    return o.merged(lists, texts)


def external_vocabulary(spark, sf_dir):
    """The best external terms of each slot: seeds expanded, rejected ones left out, scored with their support."""
    seeds = _terms(spark, sf_dir, "external_seed_keywords").where("term is not null").select("slot", "term", F.col("edition").alias("source"), F.lit("seeds").alias("source_group"), F.lit(4).alias("base_score"))
    candidates = cut(o.gathered(seeds), "candidates")
    archive = table(spark, sf_dir, "canonical_term", "slot", "term").select(_slot().alias("slot"), "term")
    texts = items(spark, sf_dir, "llm_description").where("llm_description <> ''")
    return o.external_terms(candidates, archive, support(candidates.select("term"), texts, "id", "llm_description"))


def seed_file_choice(spark, sf_dir):
    """The wanted ones of a folder of seed files, of equal contents the best."""
    names, folders = list(T.SEED_FILES), ["/eval/", "/fashionpedia/", "/deepfashion/anno_fine/", "/semcloth/", "/x/"]
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, folders)), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/seeds"), folder, F.col("p_partkey").cast("string"), F.lit("/"), name)
    return o.seed_files(rows.select(path.alias("path"), F.sha1(F.concat("p_brand", F.col("p_size").cast("string"))).alias("digest")), "path", "digest")


def gated_terms(spark, sf_dir):
    """Canonical terms ranked as if they were seeds of several sources, with the colours' and styles' gates."""
    rows = table(spark, sf_dir, "canonical_term", "ref_id", "slot", "term").select(_slot().alias("slot"), F.lower("term").alias("term"), "ref_id")
    candidates = rows.groupBy("slot", "term").agg(F.max("ref_id").alias("r")).select("slot", "term", (F.col("r") % 4 + 1).alias("n_sources"), (F.col("r") % 3 + 1).alias("n_groups"), (F.col("r") % 7).alias("base_score"))
    archive = rows.where("ref_id % 2 = 0").select("slot", "term")
    counts = rows.groupBy("term").agg((F.max("ref_id") % 9).alias("support"))
    return o.external_terms(candidates, archive, counts)


QUERIES = {f.__name__: f for f in (keyword_names, bundle_fields, harvested_terms, merged_vocabulary, external_vocabulary, seed_file_choice, gated_terms)}

_NAMES = "['" + "', '".join(T.SEED_FILES) + "']"
_SCORES = "[" + ", ".join(map(str, T.SEED_FILES.values())) + "]"
_CASE = "CASE slot " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SLOTS.items()) + " END"
_IN = lambda words: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
ORACLES = {
    "seed_file_choice": f"""WITH f AS (SELECT p_partkey AS k, {_NAMES}[p_partkey % 8 + 1] AS name, {_SCORES}[p_partkey % 8 + 1] AS base, p_partkey % 5 AS d, p_brand || p_size AS c FROM part),
 s AS (SELECT c, '/seeds' || ['/eval/', '/fashionpedia/', '/deepfashion/anno_fine/', '/semcloth/', '/x/'][d + 1] || k || '/' || name AS path,
   (base + [0, 20, 15, 10, 0][d + 1])::INT AS score FROM f WHERE d <> 0 AND (name NOT LIKE 'list_%' OR d = 2))
 SELECT path, score FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY score DESC, length(path), path) = 1""",
    "gated_terms": f"""WITH r AS (SELECT {_CASE} AS slot, lower(term) AS term, ref_id FROM canonical_term), c AS (SELECT slot, term, max(ref_id) AS r FROM r GROUP BY 1, 2), a AS (SELECT DISTINCT slot, term FROM r WHERE ref_id % 2 = 0), n AS (SELECT term, max(ref_id) % 9 AS support FROM r GROUP BY 1),
 x AS (SELECT c.slot, c.term, a.term IS NOT NULL AS archived, support, c.term IN {_IN(T.STYLES_ALLOWED)} AS allowed, r FROM c LEFT JOIN a ON a.slot = c.slot AND a.term = c.term LEFT JOIN n ON n.term = c.term),
 s AS (SELECT slot, term, (r % 7 + 3 * (r % 3 + 1) + r % 4 + 1 + least(support, 6) + CASE WHEN archived THEN 5 WHEN support > 0 THEN 3 ELSE 0 END + CASE WHEN slot = 'style_tags' AND allowed THEN 2 ELSE 0 END)::INT AS score FROM x
   WHERE NOT (slot = 'colors_tags' AND NOT archived AND term NOT IN {_IN(T.CORE_COLORS)}) AND NOT (slot = 'style_tags' AND NOT allowed AND support = 0 AND NOT archived)),
 k AS (SELECT *, (row_number() OVER (PARTITION BY slot ORDER BY score DESC, term))::INT AS rank FROM s)
 SELECT * FROM k WHERE rank <= CASE slot {' '.join(f"WHEN '{s}' THEN {n}" for s, n in T.LIMITS.items())} END""",
}
