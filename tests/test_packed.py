"""Packed fields against a character-by-character reader, and edge cases."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from loomstone.operators.packed import FIELDS, NAMES, TITLES, unpack


def read(text, names):
    """A plain reader of a field: walks the characters and keeps what quotes and parentheses hold."""
    if not text:
        return []
    csv = names or bool(re.search(r'(?:^|[;|,\n])\s*"(?:[^"]|"")*"\s*,|,\s*"(?:[^"]|"")*"\s*(?:$|[;|,\n])', text))
    out, held, i = [], "", 0
    closing = {'"': '"', "«": "»", "“": "”", "(": ")"}
    while i < len(text):
        c, rest = text[i], text[i:]
        end = None
        if c in closing and not re.match(r"\(\d{1,2}\)\s", rest):
            if c == '"':
                m = re.match(r'"(?:[^"]|"")*"', rest)
                end = m.end() if m else None
            elif closing[c] in rest:
                end = rest.index(closing[c]) + 1
        if end:
            held += rest[:end]
            i += end
        elif re.match(r"\d{1,3},\d(?!\d)", rest) and not (i and text[i - 1].isdigit()):
            m = re.match(r"\d{1,3},\d", rest)
            held += m[0]
            i += m.end()
        elif c in ";|\n\t•" and (names or c != "\t") or (names and c == "/") or (c == "," and csv) or rest.startswith("//"):
            out.append(held)
            held = ""
            i += 2 if rest.startswith("//") else 1
        else:
            held += c
            i += 1
    out.append(held)
    clean = []
    for v in out:
        v = re.sub(r"^(?:\(\d{1,2}\)|\[\d{1,2}\]|\d{1,2}\)|[-–—•*])\s+", "", v.strip())
        if re.fullmatch(r'"(?:[^"]|"")*"', v):
            v = v[1:-1].replace('""', '"')
        if v.strip(" "):
            clean.append(v.strip(" "))
    return clean


def unpacked(spark, rows, field="materials"):
    df = spark.createDataFrame([Row(id=i, materials=t if field == "materials" else None, exhibitions=t if field != "materials" else None, bibliography=None) for i, t in rows], "id long, materials string, exhibitions string, bibliography string")
    got = {}
    for r in sorted(unpack(df, "id", FIELDS).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append(r.item_value)
    return got


CASES = [
    ("silk; wool", ["silk", "wool"]),
    ('"silk, washed"; wool 43,5%', ["silk, washed", "wool 43,5%"]),
    ("satin (stampato, lavato), lana", ["satin (stampato, lavato)", "lana"]),
    ("(1) silk (2) wool", ["silk", "wool"]),
    ("1) silk\n2) wool", ["silk", "wool"]),
    ("raso e lana et seta and lino", ["raso", "lana", "seta", "lino"]),
    ("seta;; lana |", ["seta", "lana"]),
    ("gros-grain - lana + pelle", ["gros-grain", "lana", "pelle"]),
    ('"a ""b"" c","d"', ['a "b" c', "d"]),
    ('unclosed " quote; wool', ['unclosed " quote', "wool"]),
    ("\u0001Q0\u0002; wool", ["\u0001Q0\u0002", "wool"]),
    ("", []),
    ("  ", []),
]


def test_cases(spark):
    got = unpacked(spark, [(i, t) for i, (t, _) in enumerate(CASES)])
    assert [got.get(i, []) for i in range(len(CASES))] == [v for _, v in CASES]


TITLE_CASES = [
    ("«A, B», Hall, Town 1982/83; Title, Hall, 2002", ["«A, B», Hall, Town 1982/83", "Title, Hall, 2002"]),
    ('Hall: "X; part II" (2010) // Title (Town, 1997-1998)', ['Hall: "X; part II" (2010)', "Title (Town, 1997-1998)"]),
    ('"A, b, 2000","C 2001"', ["A, b, 2000", "C 2001"]),
    ("- A, b\n- C, d", ["A, b", "C, d"]),
    ("[1] A, p. 1 [2] B, p. 2", ["A, p. 1", "B, p. 2"]),
    ("Il taglio e la piega, Museo, 2000", ["Il taglio e la piega, Museo, 2000"]),
]


def test_titles(spark):
    got = unpacked(spark, [(i, t) for i, (t, _) in enumerate(TITLE_CASES)], "exhibitions")
    assert [got[i] for i in range(len(TITLE_CASES))] == [v for _, v in TITLE_CASES]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet='ab1 ,;|/()"«»\n%', max_size=24), min_size=20, max_size=40))
def test_never_fails_and_keeps_letters(spark, texts):
    got = unpacked(spark, list(enumerate(texts)))
    for i, t in enumerate(texts):
        joined = "".join(got.get(i, []))
        assert joined.count("a") == t.count("a") and joined.count("b") == t.count("b")


def test_against_reader_on_the_tables(spark, small):
    rows = spark.read.parquet(f"{small}/fashion_item.parquet").select("id", "exhibitions", "bibliography").distinct().collect()
    for field in ("exhibitions", "bibliography"):
        plain = [(r.id, r[field]) for r in rows if r[field] and not re.match(r"^\s*(?:\(\d|\[\d|\d+\))", r[field])]
        got = unpacked(spark, plain, "exhibitions")
        for i, t in plain:
            assert got.get(i, []) == read(t, False), t


def test_nulls_repeats_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 2), (2, "a;b", "y", 3), (2, "a;b", "y", 4), (None, "c;c", "z", 5)], "id long, materials string, field_name string, pos int")
    got = sorted((r.id or 0, r.pos, r.item_value) for r in unpack(df, "id", {"materials": NAMES}).collect())
    assert got == [(0, 1, "c"), (0, 2, "c"), (2, 1, "a"), (2, 2, "b")]
    assert unpack(df.limit(0), "id", {"materials": TITLES}).collect() == []


@pytest.mark.parametrize("length", [50_000])
def test_long_text(spark, length):
    text = '"' + "x" * length + '"; ' + "; ".join(["y"] * 500)
    got = unpacked(spark, [(1, text)])[1]
    assert len(got) == 501 and len(got[0]) == length
