"""The vocabulary's operators against plain Python over whole small tables, and on fixtures."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from test_assembly import _term

from loomstone.operators import ontology as o
from loomstone.operators import terms as T
from loomstone.operators import vocabulary
from loomstone.operators.vocabulary import support


def _simple(t):
    t = unicodedata.normalize("NFKD", _term(t).lower().replace("_", " ").replace("-", " "))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", "".join(c for c in t if not unicodedata.combining(c))).split())


def _keyword(t):
    t = re.sub(r"^[,;:.()\-\s]+|[,;:.()\-\s]+$", "", " ".join(" ".join(_term(t).split()).lower().replace("_", " ").split()))
    bad = not t or t in T.STOP_TERMS or len(t) > 70 or re.search(r"\b(?:art|col|des|var)\.?\s*[\w./-]+\b", t) or re.search(r"\b\d{1,3}\s*%\b", t)
    return None if bad else t


def _canonical(slot, t):
    t = _keyword(t)
    if t is None:
        return None
    if slot == "material_tags":
        for a, b in T.MATERIAL_WORDS.items():
            t = re.sub(rf"\b{a}\b", b, t)
        t = re.sub(r"\bsilk\s*(?:/|e|and)\s*wool\b", "wool/silk", re.sub(r"\bwool\s*(?:/|e|and)\s*silk\b", "wool/silk", t))
        t = _simple(re.sub(r"\s*/\s*", "/", t))
    else:
        t = _simple(t)
    if slot == "colors_tags":
        for a, b in T.COLOR_PHRASES.items():
            t = re.sub(rf"\b{a}\b", b, t)
        t = " ".join(re.sub(r"\bcolor\b", "", " ".join(T.COLOR_WORDS.get(w, w) for w in t.split())).split())
        if t in T.COLOR_REJECTS:
            return None
    if slot == "patterns_tags":
        for a, b in T.PATTERN_WORDS.items():
            t = re.sub(rf"\b{a}\b", b, t)
    if slot == "garments_tags" or slot not in T.SLOTS:
        t = t.replace("t shirt", "t-shirt")
    return T.NAMES.get(slot, {}).get(t, t)


HARD = ["Faille di seta", "raso di lana e seta", "art. 123 lana", "45 % seta", "(Nero)", "blu scuro color", "bruciato", "T_Shirt", "piqué", "3/4", "other", "x" * 80, "Righe bird s eye", "cafÃ©", None, "", " ; ", "wool/silk"]


def test_names_equal_plain_python(spark, small):
    given = HARD + [r.term for r in spark.read.parquet(f"{small}/ontology_term.parquet").select("term").distinct().collect()]
    rows = [(s, t) for s in [*T.SLOTS, "other_slot"] for t in given]
    df = spark.createDataFrame(rows, "slot string, term string")
    for r in o.canonical(df, "slot", "term", "name").collect():
        expected = None if r.term is None else _canonical(r.slot, r.term)
        assert r.name == (expected or None), (r.slot, r.term)


def test_archive_text(spark):
    df = spark.createDataFrame([("wool (lining silk) art. 12-A, 100 % lana ;seta 30 cm",), ("N/A",), ("col.7 cm 40 piÃ¹",), (None,)], "t string")
    got = [(r.m, r.d) for r in df.select(o.archive_text("materials", F.col("t")).alias("m"), o.archive_text("description", F.col("t")).alias("d")).collect()]
    assert got == [("wool, ; seta", "wool (lining silk), ; seta"), (None, None), ("più", "più"), (None, None)]


def test_seed_terms(spark):
    cases = [("garments_tags", "Wrap (dress), Coat (a), shirt/blouse (x, y)", ["wrap dress", "coat", "shirt blouse"]), ("length_tags", "Maxi (length)", ["maxi"]), ("neckline_tags", "V (neck)", ["v neck"]), ("closure_tags", "Zip up (opening)", ["zip"]), ("garments_tags", "Tee Shirt", ["t-shirt"]), ("style_tags", " , ;", []), ("style_tags", None, [])]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(cases)], "i int, slot string, term string")
    rows = o.expanded(df).orderBy("i", "piece_no").collect()
    assert [[r.term for r in rows if r.i == i] for i in range(len(cases))] == [e for _, _, e in cases]
    bad = [("style_tags", "size-zero"), ("garments_tags", "collar"), ("sleeve_tags", "no sleeve"), ("length_tags", "12 %"), ("length_tags", "y" * 61), ("length_tags", None), ("length_tags", "regular fit")]
    good = [("style_tags", "casual"), ("neckline_tags", "collar"), ("length_tags", "y" * 60)]
    df = spark.createDataFrame(bad + good, "slot string, term string").withColumn("no", o.rejected_seed(F.col("slot"), F.col("term")))
    assert [r.no for r in df.collect()] == [True] * len(bad) + [False] * len(good)


def test_parsers_of_seed_files(spark):
    lines = spark.createDataFrame([(0, "2"), (1, "name type"), (2, "Anorak 1"), (3, "floral  1"), (4, "crew neck 4"), (5, "odd 9"), (6, "nothing")], "line_no int, term string")
    assert [r.term for r in o.listed_terms(lines, "categories").collect()] == ["Anorak", "floral", "crew neck", "odd"]
    assert [(r.slot, r.term) for r in o.listed_terms(lines, "attributes").collect()] == [("patterns_tags", "Anorak"), ("patterns_tags", "floral"), ("neckline_tags", "crew neck")]
    text = '{"categories": [{"name": "coat", "supercategory": "outerwear"}, {"name": "zip", "supercategory": "closures"}, {"name": "bead", "supercategory": "decorations"}, {"name": "hood", "supercategory": "garment parts"}], "attributes": [{"name": "elbow-length", "supercategory": "length"}, {"name": "maxi", "supercategory": "length"}, {"name": "kimono", "supercategory": "nickname"}, {"name": "fur", "supercategory": "leather"}, {"name": "x", "supercategory": "else"}]}'
    got = {(r.slot, r.term, r.base_score) for r in o.taxonomy_terms(spark.createDataFrame([(text,), ("no json",)], "text string")).collect()}
    assert got == {("garments_tags", "coat", 9), ("closure_tags", "zip", 6), ("embellishment_tags", "bead", 6), ("sleeve_tags", "elbow-length", 8), ("length_tags", "maxi", 8), ("garments_tags", "kimono", 8), ("material_tags", "fur", 8)}


def test_bundles_and_harvest(spark):
    rows = [("b1", 1, "Giacca nera", "seta; lana"), ("b1", 2, "giacca NERA", None), ("b2", 3, "Abito blu scuro", "lana 100 % x"), ("b3", 4, None, " ")]
    texts = o.bundle_texts(spark.createDataFrame(rows, "b string, i int, object string, materials string"), "b", ["object", "materials"], "i")
    assert sorted(tuple(r) for r in texts.collect()) == [("b1", "materials", 1, "seta; lana"), ("b1", "object", 1, "Giacca nera"), ("b2", "materials", 1, "lana"), ("b2", "object", 1, "Abito blu scuro")]
    reference = spark.createDataFrame([("material_tags", "wool", "lana"), ("material_tags", "silk", "seta"), ("garments_tags", "jacket", "giacca"), ("garments_tags", "wool", "lana")], "slot string, term string, form string")
    got = {(r.slot, r.term): r.n_bundles for r in o.harvested(texts, o.phrases(reference)).collect()}
    assert got == {("colors_tags", "black"): 1, ("colors_tags", "dark blue"): 1, ("colors_tags", "blue"): 1, ("material_tags", "wool"): 2, ("material_tags", "silk"): 1, ("garments_tags", "jacket"): 1}


def test_merged_lists(spark):
    a = spark.createDataFrame([("colors_tags", 1, "Nero"), ("colors_tags", 2, "rosso")], "slot string, pos int, term string")
    b = spark.createDataFrame([("colors_tags", 1, "black"), ("colors_tags", 2, "art. 5"), ("colors_tags", 3, "teal")], a.schema)
    assert [r.term for r in o.merged([a, b]).orderBy("pos").collect()] == ["black", "red", "teal"]
    texts = spark.createDataFrame([(1, "a teal coat"), (2, "teal and red"), (3, None)], "key int, text string")
    assert [r.term for r in o.merged([a, b], texts).orderBy("pos").collect()] == ["teal", "red", "black"]


@pytest.mark.parametrize("n", [1, 6])
def test_support_of_long_and_compact_terms(spark, n):
    term = " ".join(f"w{i}" for i in range(n))
    texts = spark.createDataFrame([(1, f"x {term}, y"), (2, term.replace(" ", "")), (3, "w0x"), (3, None)], "id int, t string")
    assert [r.support for r in support(spark.createDataFrame([(term,)], "term string"), texts, "id", "t").collect()] == [2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_computes_names_once_and_shuffles_terms_only(spark, monkeypatch):
    names = spark.createDataFrame([("colors_tags", 1, "Nero"), ("material_tags", 2, "silk georgette")], "slot string, pos int, term string")
    texts = spark.createDataFrame([(1, "black silk georgette"), (2, "silkgeorgette"), (2, "silk georgette"), (3, None), (4, "")], "key int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "EvalPython" not in _plan(o.merged([names], texts))
        counted = support(names.select("term"), texts, "key", "text")
        assert "BroadcastHashJoin [form" in _plan(counted)
        listed = {r.term: r.support for r in counted.collect()}
        monkeypatch.setattr(vocabulary, "LISTED", 0)
        shuffled = support(names.select("term"), texts, "key", "text")
        assert "BroadcastHashJoin [form" not in _plan(shuffled)
        assert listed == {r.term: r.support for r in shuffled.collect()} == {"nero": 0, "silk georgette": 2}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
