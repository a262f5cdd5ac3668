"""Text repair against Python's codecs, and the assembly of item rows on small fixtures."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from loomstone.functions import repair
from loomstone.operators import assembly, sheets

TEXTS = ["piÃ¹ ampio", "cafÃ© crÃªme", "dâ€™alpaca", "l’étole Ã ", "PIZZO MACRAMÃ‰", "perché no", "plain", "", None, "ÃƒÂ© twice", "Â½ circle", "ÂME, MÃOS", "選 Ã©", "met� Ã¨", "€ 5 Ã¨", "x\u0081Ã©", "ï¬\u0081ne", " \t a–b \n c “q” \u00a0 ﬁ "]


def _score(t, marks):
    return sum(t.count(m) for m in marks)


def _redecoded(t, page):
    try:
        return t.encode(page).decode("utf-8")
    except UnicodeError:
        return None


def _repaired(t):
    for _ in range(2):
        options = [(_score(x, repair.VALUE_MARKS), k, x) for k, x in enumerate((t, _redecoded(t, "latin-1"), _redecoded(t, "cp1252"))) if x is not None]
        best = min(options)[2]
        if best == t:
            break
        t = best
    return t


def _term(t):
    t = t.replace("\u00a0", " ")
    for page in ("latin-1", "cp1252"):
        x = _redecoded(t, page)
        if x is not None and _score(x, repair.TERM_MARKS) < _score(t, repair.TERM_MARKS):
            return x
    return t


def test_repair_equals_the_codecs(spark, small):
    given = TEXTS + [r.description for r in spark.read.parquet(f"{small}/fashion_item.parquet").select("description").distinct().collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in df.select("i", repair.repaired(F.col("t")).alias("a"), repair.repaired_term(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(given):
        assert got[i] == ((None, None) if t is None else (_repaired(t), _term(t))), t


def test_clean_values_and_keys(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {TEXTS[r.i]: r.v for r in df.select("i", repair.clean_value(F.col("t")).alias("v")).collect()}
    assert got["dâ€™alpaca"] == "d'alpaca" and got[TEXTS[-1]] == 'a-b\nc "q" fi' and got[None] is None and got[""] == ""
    assert all(v is None or v == unicodedata.normalize("NFKC", v) for v in got.values())
    keys = spark.createDataFrame([(" A\\b  c//MÃ©.JPG",), (None,)], "p string").select(repair.clean_key(F.col("p")).alias("k")).collect()
    assert [r.k for r in keys] == ["a/b_c/mé.jpg", None]


def test_records_are_flagged_and_equal_keys_are_an_error(spark):
    rows = spark.createDataFrame([("a/x.jpg", "Goog", 1), ("a/Y.jpg", " ", 2), ("a/z.jpg", "Good", 3)], "k string, condition string, n int")
    out = {r.k: (r.condition, r.n, r.cleaned) for r in assembly.cleaned_records(rows, "k", repairs={("condition", "Goog"): "Good"}).collect()}
    assert out == {"a/x.jpg": ("Good", 1, True), "a/y.jpg": (None, 2, True), "a/z.jpg": ("Good", 3, False)}
    twice = rows.unionByName(spark.createDataFrame([("A\\X.jpg", "x", 4)], rows.schema))
    with pytest.raises(Exception, match="several rows have the key a/x.jpg"):
        assembly.cleaned_records(twice, "k").collect()
    assert assembly.cleaned_records(rows.limit(0), "k").count() == 0


def test_flatten_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, (2, "x")), (3, None)], "id int, s struct<id:int,v:string>")
    assert [tuple(r) for r in assembly.flattened(rows, "s").orderBy("id").collect()] == [(1, 2, "x"), (3, None, None)]
    assert assembly.flattened(rows, "s").columns == ["id", "s_id", "v"]


def test_names_of_clusters_and_files(spark):
    df = spark.createDataFrame([("FW1986_outfit_012_c1", "x_alta_moda_1986-87_fw_all.json"), ("SS1987_cluster_003", "a/b_1987_ss_all.json"), ("none", "x"), (None, None)], "c string, f string")
    got = [tuple(r) for r in df.select(assembly.season_of_cluster(F.col("c")), assembly.outfit_of_cluster(F.col("c")), assembly.season_of_file(F.col("f"))).collect()]
    assert got == [("FW1986", "012", "FW1986-1987"), ("SS1987", None, "SS1987"), (None, None, None), (None, None, None)]


def test_chosen_outfits(spark):
    rows = spark.createDataFrame([(str(i),) for i in (10, 9, 100, 2)], "k string")
    assert [r.k for r in assembly.chosen_outfits(rows, "k", most=3).collect()] == ["2", "9", "10"]
    assert {r.k for r in assembly.chosen_outfits(rows, "k", ["9", "x"]).collect()} == {"9"}


def test_columns_and_sections(spark):
    spans = [("d", 0, 1, 0, 40.0, 10.0, "Label", True), ("d", 0, 2, 0, 400.0, 12.0, "Size:", True), ("d", 0, 3, 0, 45.0, 20.0, "prima", False), ("d", 0, 4, 0, 390.0, 22.0, "42", False), ("d", 1, 1, 0, 45.0, 5.0, "linea", False), ("d", 1, 2, 0, 45.0, 950.0, "2", False), ("d", 1, 3, 0, 45.0, 30.0, "other red", True)]
    df = spark.createDataFrame([(d, p, n, s, x, y, 1000.0, t, 0xC81010 if r else 0) for d, p, n, s, x, y, t, r in spans], "doc string, page int, line_no int, span_no int, x0 double, y0 double, height double, text string, color int")
    assert {r.field: r.value for r in sheets.sheet_fields_of(df).collect()} == {"label": "prima\nlinea", "size": "42"}
    assert [r.language for r in sheets.sheet_language(df).collect()] == ["en"]
    pictures = spark.createDataFrame([("d", 0, 5.0, "a"), ("d", 0, 30.0, "b"), ("d", 1, 1.0, "c")], "doc string, page int, y0 double, image string")
    heads = spark.createDataFrame([("d", 0, 20.0, "runway_shots"), ("d", 1, 10.0, "ad_image")], "doc string, page int, y0 double, section string")
    assert {r.image: r.section for r in sheets.in_sections(pictures, heads).collect()} == {"a": None, "b": "runway_shots", "c": "runway_shots"}
    sides = spark.createDataFrame([("x", 100, 200), ("technical_drawings", 100, 90), ("x", None, 5), ("x", 150, 150)], "section string, width int, height int")
    assert sheets.large_enough(sides).count() == 3 and sheets.large_enough(sides, True).count() == 4


def test_field_clean_up(spark):
    columns = ["file", "year", "season", "designer", "label", "size", "inventory", "remark", "source", "folder"]
    rows = [("N. 301\nN. 301", "G. Nome\n1987", "Spring - Summer", None, "Fall Winter 1987\nprima", "Pg. 3\n42x", "12\n10301", "wide S/S 1987 some design specs", None, "SS1987"), (None, None, None, None, None, None, None, None, None, "fw 1986"), ("none", "late", "x", "D", "l", "s", "i", "r", "so", None)]
    got = [tuple(r) for r in sheets.cleaned_fields(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)), "folder").select(*columns[:-1]).collect()]
    assert got[0] == ("301", "1987", "Fall-Winter", "G. Nome", "prima", "42x", "10301", "wide", "S/S 1987 some design specs")
    assert got[1] == (None, None, "Fall-Winter", None, None, None, None, None, None)
    assert got[2] == ("none", "late", "x", "D", "l", "s", "i", "r", "so")


def test_rejects_and_last_results(spark):
    clusters = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["b"]), ("c3", [])], "cluster_id string, image_paths array<string>")
    kept, gone = assembly.split_by_presence(clusters, spark.createDataFrame([("a",), ("a",)], "path string"))
    assert [tuple(r) for r in kept.collect()] == [("c1", ["a"])]
    assert sorted((r.cluster_id, r.source_path or "", r.reason) for r in gone.collect()) == [("c1", "b", "missing_file"), ("c2", "", "no_existing_images_left_in_cluster"), ("c2", "b", "missing_file"), ("c3", "", "no_existing_images_left_in_cluster")]
