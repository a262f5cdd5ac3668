"""Controlled vocabulary: bundles, harvesting, support, normalising, slots and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import squeeze

#: Our own small vocabularies; each table is a parameter of its operator.
SYNONYMS = [("garments", "jackets", "jacket"), ("garments", "giacca", "jacket"), ("garments", "cappotto", "coat"), ("garments", "gonna", "skirt"), ("garments", "abito", "dress"), ("garments", "camicia", "shirt"), ("colors", "nero", "black"), ("colors", "bianco", "white"), ("colors", "rosso", "red"), ("colors", "grigio", "grey"), ("materials", "seta", "silk"), ("materials", "lana", "wool"), ("materials", "cotone", "cotton"), ("materials", "pelle", "leather"), ("materials", "raso", "satin")]
HINTS = [("colors", ["black", "white", "red", "grey", "gold", "silver", "navy"]), ("closure", ["button", "zip", "hook", "lacing"]), ("sleeve", ["sleeve", "raglan"]), ("neckline", ["neck", "collar"]), ("silhouette", ["line", "silhouette", "fitted"]), ("patterns", ["stripe", "dot", "floral", "tartan"]), ("embellishment", ["bead", "sequin", "fringe", "embroider"]), ("materials", ["silk", "wool", "cotton", "satin", "velvet", "lace"]), ("style", ["minimal", "baroque", "romantic"])]
STOP_TERMS = ["n.d.", "other", "altro", "various", "unknown"]
PATTERNS = [("materials", "silk", r"\b(?:silk|seta)\b"), ("materials", "wool", r"\b(?:wool|lana)\b"), ("materials", "cotton", r"\b(?:cotton|cotone)\b"), ("garments", "jacket", r"\b(?:jacket|giacca)\b"), ("garments", "coat", r"\b(?:coat|cappotto)\b"), ("garments", "skirt", r"\b(?:skirt|gonna)\b"), ("patterns", "stripes", r"\b(?:pinstripe|gessato)\b")]


def lookup(slot: Column, term: Column, synonyms: list[tuple[str, str, str]]) -> Column:
    """The canonical term of a slot's synonym, or the term itself."""
    pairs = [F.lit(x) for s, a, b in synonyms for x in (f"{s}\u0000{a}", b)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\u0000", slot, term)), term)


def translated(text: Column, words: dict[str, str]) -> Column:
    """Word by word through a map; unknown words stay."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def slot_of(term: Column, hints: list[tuple[str, list[str]]] = HINTS) -> Column:
    """The first slot one of whose hints the term contains, else garments."""
    out = F.lit("garments")
    for slot, words in reversed(hints):
        hit = F.exists(F.array(*map(F.lit, words)), lambda h: F.contains(term, h))
        out = F.when(hit, slot).otherwise(out)
    return out


def rejected(term: Column, longest: int = 60) -> Column:
    """Terms that are no terms: stop terms, too long ones, bare numbers and negations."""
    return term.isin(STOP_TERMS) | (F.length(term) > longest) | term.rlike(r"^[\d\W]+$") | term.rlike("^no ")


def bundle_key(fields: list[str], fallback: str) -> Column:
    """Hash of the fields; where all are blank, of the fallback."""
    text = F.concat_ws("|", *[F.coalesce(F.trim(f), F.lit("")) for f in fields])
    return F.sha1(F.when(F.length(F.replace(text, F.lit("|"), F.lit(""))) == 0, F.coalesce(F.col(fallback), F.lit(""))).otherwise(text))


def bundles(items: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Items of one outfit as a bundle: number of items, and distinct texts of a field in order of their first item."""
    rows = items.select(bundle_key(keys, "source_path").alias("bundle"), F.trim(value).alias("v"), F.col(order).alias("o"))
    firsts = rows.where("v <> ''").groupBy("bundle", "v").agg(F.min("o").alias("o"))
    texts = firsts.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("t")).select("bundle", F.array_join(F.transform("t", lambda x: x["v"]), " | ").alias("texts"))
    return rows.groupBy("bundle").agg(F.count("*").alias("n_items")).join(texts, "bundle", "left")


def harvest(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str, str]] = PATTERNS) -> DataFrame:
    """`(key, slot, term)` of the patterns that occur in a text; the patterns are a fixed list, tested in one pass over the texts."""
    hits = [F.when(F.lower(F.col(text)).rlike(p), F.struct(F.lit(s).alias("slot"), F.lit(t).alias("term"))) for s, t, p in patterns]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return texts.select(key, F.explode(found).alias("h")).select(key, "h.slot", "h.term").distinct()


def grams(words: Column, longest: int) -> Column:
    """All runs of one to `longest` words, joined with blanks, each once."""
    none = F.array().cast("array<string>")
    runs = F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(none))
    return F.array_distinct(F.flatten(runs))


#: A list of at most so many searched forms is broadcast to the texts, so that only runs that are terms are shuffled.
LISTED = 100_000
_COMPACT = "\u0001"


def support(terms: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """`(term, support)`: how many texts hold each term as whole words, or are the term once blanks are left out.

    The texts' word n-grams, distinct within a text and as long as the longest term, and their
    letters without blanks meet the terms in one equi-join, so neither side is compared with all
    of the other. Of more than `LISTED` forms both sides are shuffled. A key with several texts
    counts once.
    """
    plain = squeeze(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{N}]+", " "))
    wanted = terms.select(plain.alias("term")).where("term is not null").distinct()
    # a sign that no word holds begins the letters without blanks
    compact = F.concat(F.lit(_COMPACT), F.replace("term", F.lit(" "), F.lit("")))
    forms = wanted.select("term", F.explode(F.array("term", compact)).alias("form"))
    n, longest = wanted.agg(F.count("*"), F.max(F.size(F.split("term", " ")))).first()
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), words.alias("w"))
    whole = F.array(F.concat(F.lit(_COMPACT), F.array_join("w", "")))
    runs = rows.select("_key", F.explode(F.concat(grams(F.col("w"), int(longest or 1)), whole)).alias("form"))
    found = runs.join(F.broadcast(forms) if 2 * n <= LISTED else forms, "form")
    counts = found.select("term", "_key").distinct().groupBy("term").agg(F.count("*").alias("support"))
    return wanted.join(counts, "term", "left").select("term", F.coalesce("support", F.lit(0).cast("long")).alias("support"))


def seed_terms(rows: DataFrame) -> DataFrame:
    """Per slot and term of `(slot, term, source, source_group, base_score)`: sources, groups and the best score; rejected terms are left out."""
    kept = rows.where(~rejected(F.col("term")))
    return kept.groupBy("slot", "term").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("source_group").alias("n_groups"), F.max("base_score").alias("base_score"))


def ranked(terms: DataFrame, limit: int) -> DataFrame:
    """The best terms of each slot: base + 3 per group + 1 per source + support up to 6 + 5 if archived, or 3 if supported."""
    known = F.when(F.col("archived"), 5).when(F.col("support") > 0, 3).otherwise(0)
    score = F.col("base_score") + 3 * F.col("n_groups") + F.col("n_sources") + F.least(F.col("support"), F.lit(6)) + known
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "term")
    return terms.withColumn("score", score.cast("int")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
