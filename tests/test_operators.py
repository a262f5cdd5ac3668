"""Core operators on small fixtures: edge cases that the tables don't hold."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.functions import paths, tags, text, vectors
from loomstone.operators import browse, chunking, grouping, matching, sequences, vocabulary
from loomstone.operators.predicates import FilterSpec, parse_filters, where_equal
from loomstone.operators.retrieval import nearest, nearest_to_each, topped_up
from loomstone.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_filter_parser():
    assert parse_filters(["type=lesson", 'title="A B"', "year=1997"]) == {"type": "lesson", "title": "A B", "year": 1997}
    with pytest.raises(ValueError):
        parse_filters(["nothing"])
    assert parse_filters(None) == {} and parse_filters(["a=1", "a=2"]) == {"a": 2}


def test_metadata_filtering_with_k_beyond_the_matches(spark):
    rows = spark.createDataFrame([(i, "lesson" if i % 2 else "talk", [float(i == j) for j in range(4)]) for i in range(4)], "id long, type string, v array<double>")
    got = nearest(rows, "v", [1.0, 1.0, 0.0, 0.0], 10, where_equal({"type": "lesson"})).collect()
    assert [r.id for r in got] == [1, 3]


def test_nearest_with_zero_null_and_identical_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "id long, v array<double>")
    assert [(r.id, r.distance) for r in nearest(rows, "v", [1.0, 0.0], 5).collect()] == [(1, 0.0), (2, 0.0)]
    got = nearest_to_each(rows.where("id < 4"), rows.where("id < 4"), "id", "v", 2).orderBy("query", "rank").collect()
    assert [(r.query, r.key) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_top_k_is_a_prefix_of_top_k_plus_one(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    q = rows.where("vec_id = 3").first().embedding
    a, b = ([r.vec_id for r in nearest(rows, "embedding", q, k, key="vec_id").collect()] for k in (7, 8))
    assert b[:7] == a


@pytest.mark.parametrize(("n", "expected"), [(0, 9), (4, 9), (5, 5)])
def test_top_up_boundary(spark, n, expected):
    every = spark.createDataFrame([(f"p{i}", i) for i in range(9)], "path string, r int")
    own = every.where(F.col("r") < n)
    assert topped_up(own, every, "path", "r", 15, 5).count() == expected


def test_feed_filters_before_it_takes_one_per_cluster(spark):
    rows = spark.createDataFrame(
        [(1, "a.jpg", "available", "c1", ["red"]), (2, "b.jpg", "available", "c1", ["blue"]), (3, "c.jpg", "missing", "c1", ["blue"]), (4, "d.jpg", None, None, None), (5, "e.jpg", "available", "5", [])],
        "id long, source_path string, pdf_available string, cluster_id string, colors_tags array<string>",
    )
    assert sorted(r.id for r in browse.feed(rows, FilterSpec()).collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in browse.feed(rows, FilterSpec(tags={"colors_tags": ["blue"]})).collect()) == [2, 3]
    assert browse.feed(rows.limit(0), FilterSpec()).count() == 0
    with pytest.raises(ValueError):
        browse.page(rows, 101)


def test_text_functions(spark):
    assert one(spark, text.squeeze, " a \t b ") == "a b"
    assert one(spark, text.squeeze, " \n ") is None
    assert one(spark, text.simplify, "Crêpe_de-Chine!") == "crepe de chine"
    assert one(spark, text.slugify, "!!") == "na"
    assert one(spark, lambda c: text.shorten(c, 10), "abcdefgh; jk") == "abcdefgh…"
    assert one(spark, lambda c: text.shorten(c, 320), "x" * 320) == "x" * 320
    assert one(spark, text.year_of, "season 1986-87") == "1986" and one(spark, text.year_of, "none") is None
    assert one(spark, text.citations, "a [1] b [2, 3] [x]") == [1, 2, 3]
    assert one(spark, text.nfc, "é") == "é" and one(spark, text.nfc, None) is None
    assert one(spark, lambda c: text.json_in(c, "a int")["a"], 'so: {"a": 3} there') == 3
    assert one(spark, text.parse_norm, "  Ofﬁce X ") == "office x"
    assert one(spark, text.noise_line, "page 3") and not one(spark, text.noise_line, "page three")


def test_path_functions(spark):
    assert one(spark, paths.path_key, " A\\b c//D.JPG") == "a/b_c/d.jpg"
    assert one(spark, paths.same_path, " ./x\\y//z ") == "x/y/z"
    assert [one(spark, paths.file_code, x) for x in ("7", "301", "12345", "N. 301", "none")] == ["007", "301", "12345", "301", None]
    assert one(spark, paths.season_of_folder, "alta_moda_1986-87_fw/x") == "FW1986-1987"
    assert one(spark, paths.season_of_folder, "alta_moda_1997_ss") == "SS1997" and one(spark, paths.season_of_folder, "misc") is None
    assert one(spark, lambda c: paths.within(c, "root"), "root/a.jpg") and not one(spark, lambda c: paths.within(c, "root"), "root/../a.jpg")
    assert one(spark, paths.stem, "a/b.c.jpg") == "b.c" and one(spark, paths.extension, "a/B.JPG") == "jpg"
    assert one(spark, paths.image_url, "a b/ç.jpg") == "/static/a%20b/%C3%A7.jpg"


def test_vector_and_tag_functions(spark):
    assert one(spark, vectors.normalised, [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, vectors.normalised, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(spark, lambda c: vectors.hamming(c, F.lit(-1).cast("long")), 0, "long") == 64
    assert one(spark, vectors.red, 0xC81010, "int") and not one(spark, vectors.red, 0xC8C810, "int")
    pixels = [9 - c for _ in range(8) for c in range(9)]
    assert one(spark, vectors.gradient_hash, pixels, "array<int>") == -1
    assert one(spark, lambda c: tags.any_of(c, ["top"]), ["topstitching", None], "array<string>") is False
    assert one(spark, lambda c: tags.allowed(c, F.array(F.lit("a"), F.lit("b")), 1), [" A", "a", "b"], "array<string>") == ["a"]


def test_sequences(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (1, 2, 80.0), (1, 3, 200.0), (2, 1, 5.0)], "k int, o int, x double")
    got = sequences.gap_groups(rows, ["k"], ["o"], "x", 90).orderBy("k", "o").collect()
    assert [r.grp for r in got] == [0, 0, 1, 0]
    g = sequences.gradient(rows, ["k"], ["o"], "x").orderBy("k", "o").collect()
    assert [r.gradient for r in g] == [80.0, 100.0, 120.0, None]
    left = spark.createDataFrame([(1, 1), (1, 5), (2, 5)], "k int, at int")
    right = spark.createDataFrame([(1, 2, "a", 1), (1, 5, "b", 1), (1, 5, "c", 2)], "k int, at int, v string, tie int")
    assert [r.v for r in sequences.as_of(left, right, ["k"], "at", "v", "tie").orderBy("k", "at").collect()] == [None, "c", None]
    with pytest.raises(ValueError):
        sequences.batch_of(rows, ["k"], 2, 3)


@pytest.mark.parametrize("n", [0, 1, 349, 350, 351, 650, 651, 1000])
def test_windows_cover_the_text(spark, n):
    s = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, chunking.windows, s)
    assert "".join(c if i == 0 else c[50:] for i, c in enumerate(got)) == s
    assert all(len(c) == 350 for c in got[:-1])


def test_recursive_split():
    s = "aaa bbb\n\nccc ddd eee fff ggg"
    got = chunking.recursive_split(s, 8, 0)
    assert all(len(c) <= 8 for c in got) and "".join(got).replace(" ", "") == s.replace(" ", "").replace("\n", "")
    assert chunking.recursive_split("", 8, 0) == [] and chunking.recursive_split(None) == []
    assert chunking.recursive_split("x" * 20, 8, 2) == ["x" * 8, "x" * 8, "x" * 8]


def test_semantic_chunks_of_short_texts(spark):
    rows = spark.createDataFrame([(1, "One sentence."), (2, "A. B."), (3, ""), (4, None), (5, "Trailing. ")], "id int, t string")
    got = {r.id for r in chunking.semantic_chunks(rows, "id", "t").collect()}
    assert got == {1, 2, 5}


def _chunks_by_numpy(distances, kind="percentile", amount=None, n_chunks=None):
    d = np.array(distances, float)
    told = np.gradient(d) if kind == "gradient" else d
    if n_chunks:
        limit = np.percentile(d, 100 * (1 - (n_chunks - 1) / (len(d) - 1)))
    elif kind == "standard_deviation":
        limit = d.mean() + amount * d.std()
    elif kind == "interquartile":
        limit = d.mean() + amount * (np.percentile(d, 75) - np.percentile(d, 25))
    else:
        limit = np.percentile(told, amount)
    return 1 + int((told > limit).sum())


def test_kinds_of_thresholds(spark):
    texts = spark.createDataFrame([(1, "s", " ".join(f"{w} {w} {w}." for w in "a a a b b c c c d".split()))], "id int, source string, t string")
    for how in ({"kind": "percentile", "amount": 50.0}, {"kind": "standard_deviation", "amount": 0.5}, {"kind": "interquartile", "amount": 0.1}, {"kind": "gradient", "amount": 60.0}, {"n_chunks": 3}, {"n_chunks": 6}):
        rows = chunking.semantic_chunks(texts, "id", "t", around=0, start_index=True, **how).orderBy("chunk_ix").collect()
        assert " ".join(r.chunk for r in rows) == texts.first().t and rows[0].source == "s"
        assert len(rows) == _chunks_by_numpy([0, 0, 1, 0, 1, 0, 0, 1], **how)
        assert [r.start_index for r in rows] == [sum(len(x.chunk) for x in rows[:k]) for k in range(len(rows))]
    for bad in (lambda: chunking.semantic_chunks(texts, "id", "t", kind="none"), lambda: chunking.split(texts, "id", "t", "none")):
        with pytest.raises(ValueError):
            bad()


def test_splits_by_tokens(spark):
    from loomstone.functions.tokens import token_length

    length, text = token_length(), "A silk jacket, «piqué» and taffetà. " * 60
    windows = chunking.measured_windows(text, 50, 10, length)
    assert all(sum(map(length, w)) <= 50 for w in windows) and "".join(windows).count("silk") >= 60
    assert chunking.measured_windows("abc", 2, 0, len) == ["ab", "c"] and chunking.measured_windows(None, 2, 0, len) == []
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    rows = chunking.split(df, "id", "t", "recursive-split", size=50, overlap=5, length=length).collect()
    assert rows and all(length(r.chunk) <= 50 for r in rows) and {r.id for r in rows} == {1}


def test_searches_in_several_blocks(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    a, b = ({(r.query, r.key, r["rank"]) for r in nearest_to_each(asked, rows, "vec_id", "embedding", 5, most_bytes=n).collect()} for n in (1 << 20, 4096))
    assert a == b and len(a) == 5 * asked.count()
    assert nearest_to_each(asked.limit(0), rows, "vec_id", "embedding", 5).count() == 0


def test_candidates_without_scores_stay(spark):
    from loomstone.operators.retrieval import ranked_candidates, referenced

    near = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "path string, rank int")
    scored = spark.createDataFrame([("c", 2), ("b", 2), ("x", 9)], "path string, score int")
    assert [r.path for r in ranked_candidates(scored, near, "path").collect()] == ["b", "c"]
    assert [r.path for r in ranked_candidates(scored.where("path = 'x'"), near, "path").collect()] == ["a", "b", "c"]
    assert [r.path for r in referenced(near, 4, "rank").collect()] == ["d"] and referenced(near, 5, "rank").count() == referenced(near, 0, "rank").count() == 0


def test_numbers_by_ranges(spark):
    rows = spark.createDataFrame([("g" if i % 3 else "h", i % 7, i) for i in range(300)], "g string, a int, b int")
    got = grouping.numbered(rows, "g", ["a", "b"], "n", parts=5).collect()
    for g in "gh":
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.a, r.b))
        assert [r.n for r in own] == list(range(len(own)))


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    from loomstone.streaming.ingest import file_stream, read_latest, upsert_latest

    for k, rows in enumerate(([(i, 1) for i in range(40)], [(3, 2), (99, 2)], [(3, 1)])):
        spark.createDataFrame(rows, "k int, seq int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_latest(file_stream(spark, str(tmp_path / "in"), "k int, seq int"), "k", "seq", str(tmp_path / "out"), str(tmp_path / "cp"), buckets=8)
    assert {r.k: r.seq for r in read_latest(spark, str(tmp_path / "out")).collect()} == {i: 1 for i in range(40)} | {3: 2, 99: 2}
    assert len(list((tmp_path / "out" / "rows" / "2").glob("bucket=*"))) == 1


def test_components_and_refinement(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 51)], "a int, b int")
    got = {r.id: r.comp for r in grouping.components(edges).collect()}
    assert set(got.values()) == {1, 50} and len(got) == 32
    line = [(i, "s", [math.cos(i / 10), math.sin(i / 10)]) for i in range(6)] + [(9, "s", [-1.0, 0.0]), (10, None, [1.0, 0.0]), (11, "s", [0.0, 0.0])]
    rows = spark.createDataFrame(line, "id int, season string, v array<double>")
    near = grouping.near_pairs(rows, "season", "id", "v", 0.006)
    assert sorted((r.a, r.b) for r in near.collect()) == [(i, i + 1) for i in range(5)]
    out = {r.id: (r.cluster, r.reclustered) for r in grouping.refined(rows, "season", "id", "v", 0.006, most=4, factor=0.1).collect()}
    assert out[0] == (0, True) and out[5] == (5, True) and out[9] == (9, False)


def test_blocks_give_the_same_pairs(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    a = {(r.a, r.b) for r in grouping.near_pairs(rows, "label", "vec_id", "embedding", 0.75).collect()}
    b = {(r.a, r.b) for r in grouping.near_pairs(rows, "label", "vec_id", "embedding", 0.75, size=7).collect()}
    assert a == b and a


def test_hash_matching(spark):
    q = spark.createDataFrame([("s", 1, 0b0), ("s", 2, 0b0)], "g string, id int, h long")
    c = spark.createDataFrame([("s", 7, 0b11), ("s", 8, 0b11), ("s", 9, 2**15 - 1), ("t", 10, 0)], "g string, id int, h long")
    nn = matching.nearest_hash(q, c, ["g"], "id", "h")
    assert sorted((r.query, r.match, r.dist) for r in nn.collect()) == [(1, 7, 2), (2, 7, 2)]
    assert [(r.query, r.kind) for r in matching.used_once(nn, ["g"]).collect()] == [(1, "exact")]


@pytest.mark.parametrize("most", [500_000, 7])
def test_nearest_hash_equals_brute_force_and_makes_no_rows_of_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "CANDIDATES", most)
    monkeypatch.setattr(matching, "QUERIES", most)
    monkeypatch.setattr(matching, "_COLUMNS", 16)
    r = np.random.default_rng(1)
    near = r.integers(-(2**63), 2**63, 5)
    rows = [(g, f"{g}{i}é" if i % 3 else f"{g}{i}", int(near[i % 5] ^ (1 << int(r.integers(0, 8))))) for g, n in (("a", 60), ("b", 40), ("c", 1)) for i in range(n)] + [("b", "none", None)]
    df = spark.createDataFrame(rows, "g string, id string, h long")
    queries = df.where("hash(id) % 3 = 0 or g = 'c' or id = 'none'")
    nn = matching.nearest_hash(queries, df, ["g"], "id", "h")
    plan = nn._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    hashes = [x for x in rows if x[2] is not None]
    true = {}
    for g, a, h in ((r.g, r.id, r.h) for r in queries.collect() if r.h is not None):
        of = [(((h ^ x) & (2**64 - 1)).bit_count(), b) for s, b, x in hashes if s == g and b != a]
        if of:
            true[g, a] = min(of)
    assert true and {(r.g, r.query): (r.dist, r.match) for r in nn.collect()} == true


def test_buckets_compute_the_matches_once(spark, small):
    from loomstone.plans.grouping_queries import hamming_buckets

    assert "CoGroup" not in hamming_buckets(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_greedy_expansion_counts_the_limit_after_exclusion(spark):
    rows = [("g", 0, "s0", c, d) for c, d in (("a", 1), ("b", 2), ("s1", 0))] + [("g", 1, "s1", c, d) for c, d in (("a", 1), ("b", 1), ("c", 5), ("d", 6))]
    df = spark.createDataFrame(rows, "g string, seed_pos int, seed string, cand string, dist int")
    got = sorted((r.seed, r.pick) for r in grouping.greedy_expansion(df, "g", 2).collect())
    assert got == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s1", "d")]


def test_support_counts_whole_words(spark):
    terms = spark.createDataFrame([("silk",), ("silk georgette",), ("none",)], "term string")
    texts = spark.createDataFrame([(1, "Silk georgette, silk"), (2, "silky"), (3, None), (4, "")], "id int, t string")
    assert {r.term: r.support for r in vocabulary.support(terms, texts, "id", "t").collect()} == {"silk": 1, "silk georgette": 1, "none": 0}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"k": 1}, {"k": 2}]), encoding="utf-8")
    assert sorted(r.k for r in files.json_array(spark, str(tmp_path / "a.json"), "k int").collect()) == [1, 2]
    (tmp_path / "m.json").write_text('{"x": {"v": 1}, "y": {"v": 2}}')
    assert {r.key: r.value.v for r in files.json_map(spark, str(tmp_path / "m.json"), "struct<v:int>").collect()} == {"x": 1, "y": 2}
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n\n   \nnot json\n')
    rows = files.json_lines(spark, str(tmp_path / "l.jsonl"), "k int").cache()
    assert rows.where("_corrupt_record is null").count() == 1 and rows.where("_corrupt_record is not null").count() == 1
    (tmp_path / "book.one.txt").write_text("text")
    assert files.whole_texts(spark, str(tmp_path / "book.one.txt")).first().name == "book"
    folder = tmp_path / "x" / "Photos" / "FW_1986_87"
    folder.mkdir(parents=True)
    (folder / "A.JPG").write_bytes(b"1")
    (folder / "b.txt").write_bytes(b"1")
    got = files.image_files(files.listing(spark, str(tmp_path / "x")), "photos").collect()
    assert [(r.filename, r.season) for r in got] == [("A.JPG", "FW_1986_87")]
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "x")]) == str(tmp_path / "x")
    sparql = '{"results": {"bindings": [{"i": {"type": "uri", "value": "http://x/y#Silk"}}, {"label": {"type": "literal", "value": "wool"}}]}}'
    assert one(spark, files.sparql_labels, sparql) == ["Silk", "wool"]
    assert one(spark, files.tree_values, '{"a": [{"name": "x", "b": {"term": "y"}}]}') == ["x", "y"]
    assert one(spark, files.tree_values, '{"name": "a \\"b\\" é", "x": "\\"name\\": \\"no\\"", "Label": ["l"]}') == ['a "b" é']
    assert one(spark, files.tree_values, '{"term": "1"}\nbad\n{"a": {"value": "2"}}') == ["1", "2"] and one(spark, files.tree_values, "") == [] and one(spark, files.tree_values, None) == []
    assert one(spark, files.xml_terms, '<c rdf:about="http://x#A_b"><rdfs:label>lab</rdfs:label></c>') == ["lab", "A_b"]
    assert one(spark, files.xml_terms, '<o xmlns:r="http://r"><C IRI="#Coat"/><Literal>a &amp; b</Literal><x r:about="http://x/y"/></o>') == ["Coat", "a & b", "y"]
    (folder / "c.gif").write_bytes(b"1")
    (folder / "d.tif").write_bytes(b"1")
    assert {r.filename for r in files.image_files(files.listing(spark, str(tmp_path / "x")), "photos").collect()} == {"A.JPG", "c.gif"}
    keyed = files.without_suffix(spark.createDataFrame([("a.pdf", 1), ("a", 2), ("b.PDF", 3)], "k string, v int"), "k")
    assert {r.k: r.v for r in keyed.collect()} == {"a": 1, "b": 3}
    files.pretty_json(spark.createDataFrame([(2,), (1,)], "k int"), str(tmp_path / "p"), "k")
    assert json.loads(spark.read.text(str(tmp_path / "p"), wholetext=True).first()[0]) == [{"k": 1}, {"k": 2}]
    good, bad = files.rejects(spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k")
    assert [r.k for r in good.collect()] == [1] and [(r.k, r.reason) for r in bad.collect()] == [(2, "missing_file")]
