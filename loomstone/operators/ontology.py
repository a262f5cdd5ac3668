"""The vocabulary: typed keywords by slot, terms harvested from texts, seed terms out of files, ranking and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.paths import basename, extension
from loomstone.functions.repair import repaired_term
from loomstone.functions.text import simplify, squeeze
from loomstone.operators import terms as T
from loomstone.operators.vocabulary import grams, slot_of, support
from loomstone.plans.lineage import cut


def simple(text: Column) -> Column:
    """The comparison form of a text: repaired, lower case, plain letters and digits, single blanks."""
    return simplify(repaired_term(text))


def _named(table: dict[str, str], key: Column) -> Column:
    if not table:
        return key
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), key)


def _words_replaced(text: Column, table: dict[str, str]) -> Column:
    """Whole words and phrases replaced, one after the other."""
    return reduce(lambda c, pair: F.regexp_replace(c, rf"(?U)\b{pair[0]}\b", pair[1]), table.items(), text)


def canonical(rows: DataFrame, slot: str, term: str, out: str) -> DataFrame:
    """A column `out`: what a slot's typed keyword is called in the vocabulary.

    Unknown names come in comparison form, in any slot. Null for what is no keyword: nulls, stop
    terms, more than 70 characters, article codes, shares. Each step is a projection of its own,
    so that what several expressions use is computed once.
    """
    keep = rows.columns
    kind = F.col(f"`{slot}`")
    d = rows.withColumn("_a", squeeze(repaired_term(F.col(f"`{term}`"))))
    d = d.withColumn("_b", F.regexp_replace(F.regexp_replace(F.replace(F.lower("_a"), F.lit("_"), F.lit(" ")), r"(?U)\s+", " "), r"(?U)^[,;:.()\-\s]+|[,;:.()\-\s]+$", ""))
    b = F.col("_b")
    no = b.isin(T.STOP_TERMS) | (F.length(b) > 70) | b.rlike(r"(?U)\b(?:art|col|des|var)\.?\s*[\w./-]+\b") | b.rlike(r"\b\d{1,3}\s*%\b")
    d = d.withColumn("_k", F.when(~no, b))
    fibres = _words_replaced(F.col("_k"), T.MATERIAL_WORDS)
    fibres = F.regexp_replace(F.regexp_replace(fibres, r"\bwool\s*(?:/|e|and)\s*silk\b", "wool/silk"), r"\bsilk\s*(?:/|e|and)\s*wool\b", "wool/silk")
    d = d.withColumn("_f", F.when(kind == "material_tags", F.regexp_replace(fibres, r"\s*/\s*", "/")).otherwise(F.col("_k")))
    d = d.withColumn("_r", repaired_term(F.col("_f"))).withColumn("_s", simplify(F.col("_r")))
    d = d.withColumn("_p", F.when(kind == "colors_tags", _words_replaced(F.col("_s"), T.COLOR_PHRASES)).when(kind == "patterns_tags", _words_replaced(F.col("_s"), T.PATTERN_WORDS)).when(kind.isin([x for x in T.SLOTS if x != "garments_tags"]), F.col("_s")).otherwise(F.replace("_s", F.lit("t shirt"), F.lit("t-shirt"))))
    words = F.array_join(F.transform(F.split("_p", " "), lambda w: _named(T.COLOR_WORDS, w)), " ")
    d = d.withColumn("_n", F.when(kind == "colors_tags", squeeze(F.regexp_replace(words, r"\bcolor\b", ""))).otherwise(F.col("_p")))
    name = F.col("_n")
    for x in T.SLOTS:
        name = F.when(kind == x, _named(T.NAMES[x], F.col("_n"))).otherwise(name)
    d = d.withColumn(out, F.when(~((kind == "colors_tags") & F.col("_n").isin(T.COLOR_REJECTS)), name))
    return d.select(*[F.col(f"`{c}`") for c in keep if c != out], out)


def archive_text(field: str, value: Column) -> Column:
    """An archive field without article, design, colour and variant codes, shares and measures; of materials also without parentheses; stop terms become null."""
    out = squeeze(repaired_term(value))
    out = F.when(~F.lower(out).isin(T.STOP_TERMS), out)
    if field == "materials":
        out = F.regexp_replace(out, r"\([^)]*\)", " ")
    for pattern in (*[rf"(?iU)\b{c}\.?\s*[\w./-]+\b" for c in ("art", "des", "col", "var")], r"(?iU)\b\d{1,3}\s*%\s*[a-zà-ÿ]*\b", r"(?iU)\b\d+(?:[.,]\d+)?\s*cm\b", r"(?iU)\bcm\s*\d+(?:[.,]\d+)?\b"):
        out = F.regexp_replace(out, pattern, " ")
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"(?U)\s*;\s*", "; "), r"(?U)\s*,\s*", ", "))


def bundle_texts(items: DataFrame, bundle: str, fields: list[str], order: str) -> DataFrame:
    """`(bundle, field, pos, text)`: each bundle's distinct texts of each field by comparison form, the first of equal ones, in order. Nothing is gathered into one row."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), archive_text(f, F.col(f)).alias("text")) for f in fields])
    rows = items.select(F.col(bundle).alias("bundle"), F.col(order).alias("o"), F.explode(each).alias("e")).select("bundle", "o", "e.*").where("text is not null")
    rows = rows.withColumn("_r", repaired_term(F.col("text"))).withColumn("_s", simplify(F.col("_r")))
    rows = rows.select("bundle", "field", "o", "text", F.explode(F.filter(F.array("_s"), lambda x: x.isNotNull())).alias("same"))
    first = rows.groupBy("bundle", "field", "same").agg(F.min(F.struct("o", "text")).alias("f")).select("bundle", "field", "f.*")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("bundle", "field").orderBy("o", "text"))).select("bundle", "field", "pos", "text")


def phrases(reference: DataFrame | None = None) -> DataFrame | list[tuple[str, str, str]]:
    """`(slot, phrase, term)`: what texts are searched for: the colours' words and phrases, and each form of a reference list `(slot, term, form)`."""
    own = [("colors_tags", p, t) for p, t in (*T.COLOR_PHRASES.items(), *T.COLOR_WORDS.items(), *((c, c) for c in T.COLORS_THEMSELVES))]
    if reference is None:
        return own
    spark = reference.sparkSession
    listed = reference.select("slot", simple(F.col("form")).alias("phrase"), F.lower("term").alias("term")).where("phrase is not null")
    return spark.createDataFrame(own, "slot string, phrase string, term string").unionByName(listed).distinct()


def harvested(texts: DataFrame, wanted: DataFrame, fields: dict[str, list[str] | None] | None = None) -> DataFrame:
    """`(slot, term, n_bundles)`: terms whose phrases occur as whole words in a bundle's texts of the slot's fields.

    The texts' word runs meet the phrases in an equi-join; a term counts once per bundle.
    """
    fields = T.HARVEST_FIELDS if fields is None else fields
    longest = wanted.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = texts.select("bundle", "field", F.split(simple(F.col("text")), " ").alias("w"))
    runs = words.select("bundle", "field", F.explode(grams(F.col("w"), int(longest))).alias("phrase")).distinct()
    fits = F.lit(False)
    for slot, own in fields.items():
        fits = fits | ((F.col("slot") == slot) & (F.lit(True) if own is None else F.col("field").isin(own)))
    hits = runs.join(wanted, "phrase").where(fits)
    return hits.select("slot", "term", "bundle").distinct().groupBy("slot", "term").agg(F.count("*").alias("n_bundles"))


def merged(lists: list[DataFrame], texts: DataFrame | None = None) -> DataFrame:
    """Lists `(slot, pos, term)`, one after the other, as one: terms by their names in the vocabulary, each once, the first place kept; with texts `(key, text)` the order is by support, then term."""
    rows = reduce(DataFrame.unionByName, [df.select("slot", "pos", "term").withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)])
    # an explode, unlike a filter, isn't pushed into the projections, which would repeat their expressions
    named = canonical(rows, "slot", "term", "name").select("slot", "pos", "list_no", F.explode(F.filter(F.array("name"), lambda x: x.isNotNull())).alias("term"))
    first = named.groupBy("slot", "term").agg(F.min(F.struct("list_no", "pos")).alias("at"))
    order = [F.col("at"), F.col("term")]
    if texts is not None:
        first = cut(first, "names")  # the vocabulary is small, but its plan is long and used three times
        counts = support(first.select("term"), texts, "key", "text")
        first = first.join(counts.withColumnRenamed("term", "_t"), squeeze(F.regexp_replace(F.lower("term"), r"[^\p{L}\p{N}]+", " ")) == F.col("_t"), "left")
        order = [F.desc(F.coalesce("support", F.lit(0))), F.col("term")]
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("slot").orderBy(*order))).select("slot", "pos", "term")


def seed_piece(text: Column) -> Column:
    """A seed term in lower case with ASCII dashes and quotation marks, single blanks and no signs at its ends."""
    out = F.replace(F.lower(squeeze(repaired_term(text))), F.lit("_"), F.lit(" "))
    out = F.translate(out, "–—’“”", "--'\"\"")
    return F.regexp_replace(F.regexp_replace(F.coalesce(out, F.lit("")), r"(?U)\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")


def expanded(rows: DataFrame, slot: str = "slot", term: str = "term") -> DataFrame:
    """The rows once per seed term within a typed one, with its place `piece_no`.

    A term is split at commas outside parentheses; a remark in parentheses at its end is joined
    on, dropped or kept by what it is.
    """
    keep, kind = rows.columns, F.col(f"`{slot}`")
    d = rows.withColumn("_t", seed_piece(F.col(f"`{term}`")))
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(F.split("_t", r",(?![^()]*\))")).alias("piece_no", "_p")).withColumn("_p", F.trim("_p")).where("_p <> ''")
    ends = r"^(.*?)\s*\(([^()]+)\)\s*$"
    d = d.withColumn("_h", F.col("_p").rlike(ends)).withColumn("_core", seed_piece(F.regexp_extract("_p", ends, 1))).withColumn("_note", seed_piece(F.regexp_extract("_p", ends, 2)))
    note = F.col("_note")
    alone = kind.isin("length_tags", "patterns_tags") & note.isin("length", "pattern") | (kind == "closure_tags") & (note == "opening")
    d = d.withColumn("_o", F.when(~F.col("_h"), F.col("_p")).when(alone | ~note.isin(T.CONTEXTS), F.col("_core")).otherwise(F.concat_ws(" ", "_core", "_note")))
    out = F.col("_o")
    for a, b in (("/", " "), ("t shirt", "t-shirt"), ("tee shirt", "t-shirt"), ("zip up", "zip"), ("zipper", "zip"), ("off-the-shoulder", "off the shoulder")):
        out = F.replace(out, F.lit(a), F.lit(b))
    d = d.withColumn("_e", seed_piece(out))
    # an explode, unlike a filter, isn't pushed into the projections, which would repeat their expressions
    return d.select(*[F.col(f"`{c}`") for c in keep if c != term], "piece_no", F.explode(F.filter(F.array("_e"), lambda x: x != "")).alias(term))


def rejected_seed(slot: Column, term: Column) -> Column:
    """Whether a seed term is none: empty, a stop term, over 60 characters, a number, a negation, a banned style, a garment's part."""
    style = (slot == "style_tags") & F.replace(term, F.lit("-"), F.lit(" ")).isin(T.STYLES_BANNED)
    return term.isNull() | term.isin(T.STOP_TERMS + T.SEED_REJECTS) | (F.length(term) > 60) | term.rlike(r"^[0-9 .%-]+$") | term.startswith("no ") | style | ((slot == "garments_tags") & term.isin(T.PARTS))


def file_score(path: Column) -> Column:
    """How much a file is wanted as a seed: by name, with additions for parts of its path; 0 for others."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.lower(basename(path))
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in T.SEED_FILES.items() for x in pair]), name), F.lit(0))
    out = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in T.SEED_BLACKLIST])
    listed = name.isin("list_attr_cloth.txt", "list_category_cloth.txt") & ~low.contains("/anno_fine/")
    more = F.when(low.contains("fashionpedia"), 20).otherwise(0) + F.when(low.contains("deepfashion"), 15).otherwise(0) + F.when(low.contains("semcloth"), 10).otherwise(0)
    more = more + F.when(low.contains("ontology") & extension(path).isin("owl", "xml", "rdf"), 8).otherwise(0)
    return F.when((score == 0) | out | listed | ~extension(path).isin(T.SEED_SUFFIXES), 0).otherwise(score + more)


def seed_files(files: DataFrame, path: str, digest: str) -> DataFrame:
    """`(path, score)` of the wanted files, of equal contents the one with the best score, then the shortest path."""
    rows = files.select(F.col(path).alias("path"), F.col(digest).alias("d"), file_score(F.col(path)).alias("score")).where("score > 0")
    best = rows.groupBy("d").agg(F.min(F.struct((-F.col("score")).alias("s"), F.length("path").alias("n"), "path")).alias("b"))
    return best.select("b.path", (-F.col("b.s")).alias("score"))


def listed_terms(lines: DataFrame, kind: str) -> DataFrame:
    """`(slot, term)` of a list `(line_no, term)` whose lines end in a number: garments of a category list, by number of an attribute list."""
    rows = lines.where("line_no >= 2").select(F.regexp_extract("term", r"^(.*?)\s+(\d+)$", 1).alias("term"), F.regexp_extract("term", r"^(.*?)\s+(\d+)$", 2).alias("n")).where("term <> ''")
    slot = F.lit("garments_tags") if kind == "categories" else F.try_element_at(F.create_map(*[F.lit(x) for pair in T.ATTRIBUTE_SLOTS.items() for x in pair]), F.col("n"))
    return rows.select(slot.alias("slot"), "term").where("slot is not null")


def _any(term: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(term, F.lit(w)) for w in words])


def attribute_slot(group: Column, name: Column) -> Column:
    """The slot of a taxonomy's attribute by its group, and by its name where the group is of several kinds; null for others."""
    g, n = seed_piece(group), seed_piece(name)
    sleeves = _any(n, ["sleeve", "sleeveless", "elbow", "wrist", "three quarter"])
    garments = _any(n, ["dress", "coat", "jacket", "pants", "shorts", "skirt", "top", "shirt", "tee", "t-shirt", "hoodie", "blazer", "anorak", "bolero", "kimono", "robe", "gown", "parka"])
    necks = _any(n, ["neck", "neckline", "collar", "lapel", "off the shoulder", "one shoulder", "collarless"])
    nick = F.when(garments, "garments_tags").when(necks, "neckline_tags").when(n.contains("sleeve"), "sleeve_tags").when(n.contains("opening"), "closure_tags")
    out = F.when(g.isin("textile pattern", "animal"), "patterns_tags").when(g.isin("silhouette", "waistline"), "silhouette_tags").when(g == "length", F.when(sleeves, "sleeve_tags").otherwise("length_tags"))
    out = out.when(g == "neckline type", "neckline_tags").when(g.isin("opening type", "closures"), "closure_tags").when(g.isin("textile finishing, manufacturing techniques", "decorations"), "embellishment_tags")
    return out.when(g.isin("non-textile material type", "leather"), "material_tags").when(g == "nickname", nick)


def taxonomy_terms(text: DataFrame) -> DataFrame:
    """`(slot, term, source_group, base_score)` of taxonomies `(text)`: categories by their group, attributes by attribute_slot()."""
    shape = "struct<categories:array<struct<name:string,supercategory:string>>,attributes:array<struct<name:string,supercategory:string>>>"
    rows = text.select(F.from_json("text", shape).alias("t"))
    cats = rows.select(F.explode("t.categories").alias("c")).select(F.col("c.name").alias("term"), seed_piece(F.col("c.supercategory")).alias("g")).where("term <> ''")
    kinds = F.array(F.when(~F.col("g").isin("garment parts", "closures", "decorations"), F.struct(F.lit("garments_tags").alias("slot"), F.lit(9).alias("base_score"))), F.when(F.col("g") == "closures", F.struct(F.lit("closure_tags").alias("slot"), F.lit(6).alias("base_score"))), F.when(F.col("g") == "decorations", F.struct(F.lit("embellishment_tags").alias("slot"), F.lit(6).alias("base_score"))))
    a = cats.select("term", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("k.slot", "term", F.lit("taxonomy_categories").alias("source_group"), "k.base_score")
    attrs = rows.select(F.explode("t.attributes").alias("c")).select(attribute_slot(F.col("c.supercategory"), F.col("c.name")).alias("slot"), F.col("c.name").alias("term")).where("slot is not null and term <> ''")
    return a.unionByName(attrs.select("slot", "term", F.concat(F.lit("taxonomy_"), "slot").alias("source_group"), F.lit(8).alias("base_score")))


def loose_terms(rows: DataFrame, base: int) -> DataFrame:
    """`(slot, term, source, source_group, base_score)` of terms `(source, term)` without a stated slot, by their hints."""
    return rows.select(slot_of(seed_piece(F.col("term"))).alias("slot"), "term", "source", F.regexp_replace(F.lower(basename(F.col("source"))), r"\.[^.]*$", "").alias("source_group"), F.lit(base).alias("base_score")).where("slot is not null")


def gathered(seeds: DataFrame) -> DataFrame:
    """`(slot, term, n_sources, n_groups, base_score)` of `(slot, term, source, source_group, base_score)`: terms expanded, rejected ones left out."""
    each = expanded(seeds).where(~rejected_seed(F.col("slot"), F.col("term")))
    return each.groupBy("slot", "term").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("source_group").alias("n_groups"), F.max("base_score").alias("base_score"))


def external_terms(candidates: DataFrame, archive: DataFrame, counts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """`(slot, term, score, rank)` of the best candidates of each slot.

    Score: base + 3 per group + 1 per source + support up to 6, + 5 if archived or else 3 if
    supported, + 2 for an allowed style. Colours must be archived or core ones; styles must be
    allowed, supported or archived. `archive` has `(slot, term)`, `counts` `(term, support)`.
    """
    known = archive.select("slot", seed_piece(F.col("term")).alias("term")).distinct().withColumn("archived", F.lit(True))
    rows = candidates.join(known, ["slot", "term"], "left").join(counts, "term", "left").withColumns({"archived": F.coalesce("archived", F.lit(False)), "support": F.coalesce("support", F.lit(0))})
    allowed = F.col("term").isin(T.STYLES_ALLOWED)
    gate = ~((F.col("slot") == "colors_tags") & ~F.col("archived") & ~F.col("term").isin(T.CORE_COLORS)) & ~((F.col("slot") == "style_tags") & ~allowed & (F.col("support") == 0) & ~F.col("archived"))
    score = F.col("base_score") + 3 * F.col("n_groups") + F.col("n_sources") + F.least(F.col("support"), F.lit(6)) + F.when(F.col("archived"), 5).when(F.col("support") > 0, 3).otherwise(0) + F.when((F.col("slot") == "style_tags") & allowed, 2).otherwise(0)
    limit = F.lit(None).cast("int")
    for s, n in (limits or T.LIMITS).items():
        limit = F.when(F.col("slot") == s, n).otherwise(limit)
    ranked = rows.where(gate).withColumn("score", score.cast("int")).withColumn("rank", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "term")))
    return ranked.where(F.col("rank") <= limit).select("slot", "term", "score", "rank")
