"""The subpackage's operators against brute force, round trips and held-out accuracy, and on edge cases."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import canonical, clusters, cooccurrence, encoding, langid, mixing, packing, termfreq, toxicity
from loomstone.llm.texts import count_tokens, sentences, unquoted

WORDS = {
    "it": "il la giacca di seta con bottoni che si apre sul davanti è stata fatta nella sartoria per una signora molto elegante e gentile".split(),
    "en": "the jacket of silk with buttons which opens at the front was made in the workshop for a very elegant and kind lady there".split(),
    "fr": "la veste de soie avec des boutons qui s’ouvre sur le devant a été faite dans un atelier pour une dame très élégante".split(),
    "de": "die Jacke aus Seide mit Knöpfen die sich vorne öffnet wurde in der Werkstatt für eine sehr elegante und freundliche Dame gemacht".split(),
    "es": "la chaqueta de seda con botones que se abre por delante fue hecha en el taller para una señora muy elegante y amable".split(),
}


def sentence(rng, lang, n=11):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    lines = [(sentence(rng, x), x) for x in langid.LANGS for _ in range(200)]
    noisy = [(s, rng.choice(langid.LANGS) if rng.random() < 0.05 else x) for s, x in lines]
    return langid.fit([s for s, _ in noisy], [x for _, x in noisy])


def test_code_rows_differ_in_eight_bits():
    m = langid.code_matrix(5)
    assert m.shape == (5, 15) and {int((a != b).sum()) for a, b in combinations(m, 2)} == {8}


def test_language_held_out(model):
    rng = random.Random(2)
    lines = [(sentence(rng, x), x) for x in langid.LANGS for _ in range(100)]
    got, conf = model.decode(model.bits([s for s, _ in lines])[0])
    assert np.mean([model.langs[g] == x for g, (_, x) in zip(got, lines)]) > 0.98
    assert ((conf > 0) & (conf <= 1)).all()


def test_segments(spark, model):
    rng = random.Random(3)
    it, en = (lambda: sentence(rng, "it")), (lambda: sentence(rng, "en"))
    long_text = " ".join([it() for _ in range(3000)] + [en() for _ in range(3000)])
    texts = [(1, "f", f"{it()} {it()}"), (2, "f", f"{it()} {en()}\n{it()}"), (3, "f", ""), (4, "f", None), (5, "f", "N. 12 / 3-A"), (6, "f", f"{it()[:-1]} («The folded line of the jacket», 1999).\nII.\n{it()}"), (7, "f", long_text), (8, "f", "x" * 400_000)]
    rows = langid.segments(spark.createDataFrame(texts, "row_id long, field_name string, text string"), model).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.row_id, r.seg_no)):
        got.setdefault(r.row_id, []).append(r.lang)
    assert got[1] == ["it"] and got[2] == ["it", "en", "it"] and got[6] == ["it"] and got[7] == ["it", "en"]
    assert not {3, 4, 5} & set(got)
    labels = spark.createDataFrame([(1, "f", "ITALIANO"), (2, "f", "it-IT"), (6, "f", "n/a"), (7, "f", None)], "row_id long, field_name string, label string")
    found = langid.mislabelled(langid.segments(spark.createDataFrame(texts, "row_id long, field_name string, text string"), model), labels)
    assert {r.row_id for r in found.collect()} - {8} == {2, 6, 7}
    assert langid.segments(spark.createDataFrame(texts, "row_id long, field_name string, text string"), None).count() == 0


def test_sentences():
    assert sentences("A b. C d? “E f.” G\n\nH") == ["A b.", "C d?", "“E f.”", "G", "H"]
    assert unquoted("Una giacca («The Folded Line») di seta nera e lana") .count("Folded") == 0
    assert sentences("") == []


def _vectors(n_clusters, size, noise, seed, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n_clusters, dims))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), size, axis=0)
    return x + noise * rng.standard_normal(x.shape) / math.sqrt(dims)


@pytest.mark.parametrize(("part", "block"), [(20_000, 1500), (40, 16)])
def test_pairs_equal_brute_force_also_with_hot_buckets(spark, part, block):
    x = np.concatenate([_vectors(60, 4, 0.2, 1), _vectors(1, 160, 0.15, 2)])
    x[5] = x[4]
    plan = clusters.Plan(part=part, block=block, bucket=64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    got = {(r.id_a, r.id_b) for r in clusters.pairs_within(df, clusters.cluster(df, plan), plan).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.12
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    assert got <= true and len(got) >= 0.99 * len(true)


def test_parts_of_a_bucket_leave_nothing_uncompared(spark):
    """With one bucket only, the edges of any number of parts link what brute force links; a third of the rows are almost copies."""
    x = np.concatenate([_vectors(80, 3, 0.25, 3), _vectors(1, 120, 0.02, 4)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(1 - u @ u.T <= 0.1199, 1)))}
    for part in (1000, 100, 25):
        plan = clusters.Plan(part=part)
        found = clusters.cluster(df, plan)
        assert true <= {(r.id_a, r.id_b) for r in clusters.pairs_within(df, found, plan).collect()}
        dense = [r for r in found.edges.collect() if min(r.a, r.b) >= 240]
        assert len(dense) <= 120 * -(-360 // part)  # about an edge per item and part, never all pairs


def test_codes_keep_the_distance():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 64))
    y = 0.88 * x + 0.475 * rng.standard_normal((400, 64))
    exact = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    coded = (clusters._units(clusters.codes_of(x)) * clusters._units(clusters.codes_of(y))).sum(1)
    assert np.abs(exact - coded).max() < clusters.Plan().slack


def test_recall_at_the_boundary(spark):
    """Pairs spread up to the distance itself: edges of the tables against brute force."""
    x = _vectors(400, 2, 0.35, 5)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    plan = clusters.Plan(bucket=128)
    got = {(r.id_a, r.id_b) for r in clusters.pairs_within(df, clusters.cluster(df, plan), plan).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(1 - u @ u.T <= 0.1199, 1)))}
    assert len(true) > 100 and len(got & true) >= 0.9 * len(true)


@pytest.mark.parametrize("bits", [10, 13])
def test_recall_with_the_bits_of_large_tables(spark, bits):
    """Isolated pairs at the distance itself: the tables grow with the hyperplanes."""
    rng = np.random.default_rng(bits)
    u, w = rng.standard_normal((2, 2048, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    x = np.concatenate([u, 0.8801 * u + math.sqrt(1 - 0.8801**2) * w / np.linalg.norm(w, axis=1, keepdims=True)])
    plan = clusters.Plan(bucket=len(x) / 2**bits)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    edges = {frozenset((r.a, r.b)) for r in clusters.cluster(df, plan).edges.collect()}
    assert sum(frozenset((i, i + 2048)) in edges for i in range(2048)) >= 0.97 * 2048


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    got = clusters.cluster(df)
    members = {r.id: r.cluster for r in got.members.collect()}
    assert members[1] == members[2] != members[3] and 4 not in members
    out = {r.cluster: r for r in clusters.described(df, got.members, 2).collect()}
    assert sorted(r["size"] for r in out.values()) == [1, 2] and out[members[1]].medoid == 1
    bad = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0])], "id long, vec array<float>")
    assert [r.id for r in bad.where(clusters.usable("vec")).collect()] == [5]


def _pairs(records):
    c = Counter()
    for r in records:
        c.update(combinations(sorted(set(r)), 2))
    return c


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3, 1.1])
def test_pair_counts_equal_brute_force(spark, share):
    rng = random.Random(4)
    records = [rng.sample([f"t{int(rng.expovariate(0.2))}" for _ in range(12)], rng.randint(0, 8)) for _ in range(500)]
    records = [sorted(set(r)) for r in records]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)] + [(900, None)], "id long, tags array<string>").repartition(3)
    counts = spark.createDataFrame(list(Counter(t for r in records for t in r).items()), "tag string, n_tag long")
    got = {(r.tag_a, r.tag_b): r.n for r in cooccurrence.pair_counts(df, "tags", counts, 500, share).collect()}
    assert got == dict(_pairs(records))


def test_tag_set(spark):
    df = spark.createDataFrame([([" A", "a", "", None], None), (None, None)], "x array<string>, y array<string>")
    assert [r.t for r in df.select(cooccurrence.tag_set("x", "y").alias("t")).collect()] == [["a"], []]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "a b", "b a b", "c", "a b c", "b", "a  b", "a ", "a\0"]), max_size=5), min_size=1, max_size=8))
def test_suffix_array_equals_counting(records):
    terms = [t for r in records for t in r]
    if not terms:
        return
    at = np.repeat(np.arange(len(records)), [len(r) for r in records])
    sa = termfreq.SuffixArray(terms, at)
    whole = {terms[sa.term[p]]: (int(n), int(r)) for p, n, r in zip(*sa.whole_terms())}
    assert whole == {t: (terms.count(t), sum(t in r for r in records)) for t in set(terms)}
    grams = {(n, g): (int(o), int(r)) for n, found, counts, records in sa.ngrams(3) for g, o, r in zip(found, counts, records)}
    true, seen = Counter(), {}
    for k, r in enumerate(records):
        for t in r:
            w = t.split(" ")
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    true[n, " ".join(w[i : i + n])] += 1
                    seen.setdefault((n, " ".join(w[i : i + n])), set()).add(k)
    assert grams == {g: (c, len(seen[g])) for g, c in true.items()}


def test_terms_of_one_record_in_many_rows(spark):
    rows = [("f", "r1", ["a"])] * 50 + [("f", "r2", ["a"]), ("f", "r2", ["b b"]), ("f", "r3", []), ("f", "r3", None)]
    df = spark.createDataFrame(rows, "field_name string, record string, terms array<string>").repartition(4)
    got = {r.term: (r.n_occurrences, r.n_records) for r in termfreq.term_counts(df, whole_records=False).collect()}
    assert got == {"a": (51, 2), "b b": (1, 1)}


def test_ngrams_of_one_record_in_many_rows(spark):
    rows = [("f", "r1", ["a b c d"])] * 50 + [("f", "r2", ["b c"]), ("f", "r2", ["x b c"]), ("f", "r3", [])]
    df = spark.createDataFrame(rows, "field_name string, record string, terms array<string>").repartition(4)
    got = {r.gram: (r.n, r.n_occurrences, r.n_records) for r in termfreq.ngram_counts(df, whole_records=False).collect()}
    assert got["b c"] == (2, 52, 2) and got["a b c d"] == (4, 50, 1) and got["x"] == (1, 1, 1) and len(got) == 13


REFERENCE = [(1, "m", "silk"), (1, "m", "seta"), (2, "m", "wool"), (2, "m", "lana"), (3, "m", "crêpe de Chine"), (4, "m", "lamé"), (5, "m", "patent leather"), (6, "m", "leather")]
TYPED = {"Silk": 1, "slk": 1, "seta 43,5%": 1, "fodera: lanna": 2, "crÃªpe de Chine (col. 7)": 3, "crepe de chien": 3, "LAMÃ©": 4, "patentleather": 5, "leather patent": 5, "pate.": 5, "thin cork": 0, "???": 0, "broken mirror": 0}


def test_canonical_terms(spark):
    ref = spark.createDataFrame(REFERENCE, "ref_id long, slot string, form string")
    rows = [("m", f"fodera: {v}") for v in ("lana", "seta", "lamé")] + [("m", v) for v in TYPED] * 2 + [("m", "silk"), ("m", None), ("m", ""), ("other", "silk"), ("m", "silk " * 5000)]
    got = {(r.slot, r.value): r.ref_id for r in canonical.match_values(spark.createDataFrame(rows, "slot string, value string"), ref).collect()}
    assert {v: got["m", v] for v in TYPED} == TYPED
    assert got["other", "silk"] == 0 and ("m", "silk") not in got and ("m", "") not in got
    assert canonical.match_values(spark.createDataFrame(rows, "slot string, value string"), ref.limit(0)).where("ref_id <> 0").count() == 0


def test_accompanying_words_are_learnt(spark):
    ref = spark.createDataFrame(REFERENCE, "ref_id long, slot string, form string")
    values = ["zubeh lana", "Zubeh: seta", "zubeh lamé", "zubeh selk", "silk nummer 12", "wool nummer 3", "lamé nummer 44", "leather nummer", "thin silk", "thin wool"]
    df = spark.createDataFrame([("m", v) for v in values], "slot string, value string").distinct()
    by = {"m": [(r, f) for r, _, f in REFERENCE]}
    company = canonical.learn_company(df, by)["m"]
    assert company.before == {"zubeh"} and company.after == {"nummer"} and "patent" in company.words
    got = {r.value: r.ref_id for r in canonical.match_values(df, ref).collect()}
    assert got["zubeh selk"] == 1 and got["silk nummer 12"] == 1 and got["Zubeh: seta"] == 1


def test_abbreviations_need_a_margin(spark):
    ref = spark.createDataFrame([(1, "m", "velvet"), (2, "m", "velour"), (3, "m", "taffeta"), (3, "m", "taffetà")], "ref_id long, slot string, form string")
    df = spark.createDataFrame([("m", "vel."), ("m", "velv."), ("m", "taff.")], "slot string, value string")
    assert {r.value: r.ref_id for r in canonical.match_values(df, ref).collect()} == {"vel.": 0, "velv.": 1, "taff.": 3}


def test_hot_values_are_attached(spark):
    typed = spark.createDataFrame([("m", "a", i) for i in range(300)] + [("m", f"b{i}", i) for i in range(100)], "slot string, value string, row_id long")
    matched = spark.createDataFrame([("m", "a", 300, 1, 1.0)] + [("m", f"b{i}", 1, 2, 1.0) for i in range(99)], "slot string, value string, n_uses long, ref_id long, score double")
    got = canonical.attached(typed, matched, 400, 0.5)
    assert got.count() == 399 and got.where("ref_id = 1").count() == 300


def test_a_value_between_two_entries_is_unmatched(spark):
    ref = spark.createDataFrame([(1, "m", "bata"), (2, "m", "bada")], "ref_id long, slot string, form string")
    values = spark.createDataFrame([("m", "baxa"), ("m", "batta")], "slot string, value string")
    assert {r.value: r.ref_id for r in canonical.match_values(values, ref).collect()} == {"baxa": 0, "batta": 1}


def test_every_form_is_ranked(spark, small):
    """Short values with swapped or missing letters share few n-grams with the entry they mean."""
    rows = spark.read.parquet(f"{small}/canonical_term.parquet").where("slot = 'colors'").collect()
    forms = sorted({(r.ref_id, f) for r in rows for f in (r.term, r.term_it)})
    index, rng = canonical.Index(forms), random.Random(8)
    means = {f: r for r, f in reversed(forms)}
    assert all(index._closest(v, 0.0, 0.0)[0] == means[f] for v, f in (("gery", "grey"), ("rde", "red"), ("bainoc", "bianco")))
    for _ in range(300):
        text = canonical._fold(rng.choice(forms)[1])
        i = rng.randrange(len(text))
        text = (text[:i] + rng.choice("aeiost") + text[i + rng.randint(0, 2) :]).strip()
        every = {}
        for (ref, _), form, cosine in zip(forms, index.forms, index.cosines(text)):
            d = canonical.edits(text.replace(" ", ""), form.replace(" ", ""))
            if " " in text and " " in form:
                d = min(d, canonical.edits("".join(sorted(text.split())), "".join(sorted(form.split()))) + 0.5)
            every[ref] = max(every.get(ref, 0.0), 0.5 * cosine + 0.5 * (1 - d / max(len(text.replace(" ", "")), len(form))))
        assert index._closest(text, 0.0, 0.0) == (min(every, key=lambda r: (-every[r], r)), pytest.approx(max(every.values())))


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
@settings(max_examples=60, deadline=None)
def test_edits_are_a_distance(a, b):
    d = canonical.edits(a, b)
    assert d == canonical.edits(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))


SOUND = ["Il davanti è chiuso in vita e mostra un taffetà più ampio, così è rimasto.", "Le défilé a été très coupé, l’étole dévorée à la fin.", "Die Säume gehören über den Tüll, größer als früher.", "Según la versión de la señora, el tafetán pequeño después se perdió.", "«Forme in bianco» — “La linea” però."]


def _garble(s, written, read, times=1):
    for _ in range(times):
        s = s.encode(written).decode(read, "surrogateescape")
    return s


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1251")])
def test_encoding_round_trip(spark, written, read):
    texts, n = [], 0
    for s in SOUND * 30:
        n += 1
        bad = s
        if n % 12 == 0:
            try:
                bad = s.encode(written).decode(read)
            except UnicodeDecodeError:
                continue
        texts.append((n, "s", bad, s))
    texts += [(900, "s", "½ circle, 21 ±2 °C © 2001", None), (901, "s", "«выставка» e «COLEÇÃO VERÃO»", None), (902, "s", None, None), (903, "s", "", None), (904, "s", "met� inferiore", None)]
    df = spark.createDataFrame([t[:3] for t in texts], "id long, source string, text string")
    cipher = encoding.learn(encoding.context_counts(df.where("text is not null")))
    got = {r.id: r for r in encoding.restore(df, cipher, "id").collect()}
    true = {i: s for i, _, b, s in texts if s is not None and b != s}
    assert true and set(true) <= set(got) and set(got) - set(true) <= {904}
    assert np.mean([got[i].restored == s for i, s in true.items()]) > 0.9
    assert not got[904].restorable


def test_letter_model_covers_small_sources(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MODEL_CONTEXTS", 2)
    rows = [("large", "ca", x, "t ", 100) for x in "éèà"] + [("small", "zo", "ù", "k ", 1)]
    cipher = encoding.learn(spark.createDataFrame(rows, "source string, lft string, run string, rgt string, n long"))
    assert cipher.letters.counts[0]["ù"] == 1


@pytest.mark.parametrize(("written", "read"), [("utf-8", "cp1252"), ("cp1252", "mac_roman"), ("utf-8", "koi8_r")])
def test_units_beyond_those_held_are_learnt_and_restored_alike(spark, monkeypatch, written, read):
    """What is known of a unit doesn't depend on how many units are held in memory, or on how often tasks pass sums on."""
    words = "défilé légende dévorée écharpe décor étole brodée plissée coupée fermée réseau crépon à là où".split()
    rows = [(i, "s", f"la {w} noire {i}") for i, w in enumerate(words * 8)] + [(900 + i, "t", f"più «{w}» ½") for i, w in enumerate(words)]
    rows += [(1000 + i, s, f"la {_garble(w, written, read)} noire") for i, (w, s) in enumerate((w, s) for w in words for s in "st")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    counts = encoding.context_counts(df)
    whole = encoding.learn(counts)
    monkeypatch.setattr(encoding, "MODEL_CONTEXTS", 3)
    few = encoding.learn(counts, bounds=encoding.Bounds(units=1))
    assert whole.rest is None and few.rest is not None
    assert few.letters.total == whole.letters.total and few.letters.counts == whole.letters.counts
    assert few.swaps.keys() == whole.swaps.keys() and all(few.swaps[s] == pytest.approx(whole.swaps[s]) for s in whole.swaps)
    got, same = ({r.id: r.restored for r in encoding.restore(df, c, "id").collect()} for c in (few, whole))
    assert got == same and len(got) > 10


def test_garbled_words_of_other_languages(spark):
    rows = [(i, "s", t) for i, t in enumerate(SOUND * 30)] + [(900, "s", "COLEÇÃO VERÃO, выставка, ζώνη")]
    bad = {1000: ("la COLEÇÃO VERÃO", "latin-1"), 1001: ("la ζώνη μεταξωτή", "latin-1"), 1002: ("la выставка", "latin-1")}
    rows += [(i, "s", _garble(t, "utf-8", page)) for i, (t, page) in bad.items()]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.id: r.restored for r in encoding.restore(df, encoding.learn(encoding.context_counts(df)), "id").collect()}
    assert got == {i: t for i, (t, _) in bad.items()}


@pytest.mark.parametrize(("written", "read"), [("utf-8", "koi8_r"), ("utf-8", "cp1253"), ("utf-8", "cp1257"), ("cp1252", "cp1253"), ("mac_roman", "cp1257")])
def test_letters_of_an_unlisted_swap_are_learnt(spark, written, read):
    """Pairs of pages that are no listed ones; words of other scripts stay as they are."""
    words = "défilé légende dévorée écharpe décor étole brodée plissée coupée fermée réseau crépon".split()
    rows = [(i, "s", f"la {w} noire {i}") for i, w in enumerate(words * 8)]
    bad = {1000 + i: w for i, w in enumerate(words)}
    rows += [(i, "s", f"la {_garble(w, written, read)} noire") for i, w in bad.items()]
    rows += [(2000 + i, "s", f"«{w}»") for i, w in enumerate("выставка платье łódź złoty ζώνη φόρεμα szőlő nyelvű".split())]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    cipher = encoding.learn(encoding.context_counts(df))
    got = {r.id: r.restored for r in encoding.restore(df, cipher, "id").collect()}
    assert got == {i: f"la {w} noire" for i, w in bad.items()}


def test_sound_words_with_odd_letters_stay(spark):
    """Letters that some pair of pages would explain, in contexts that no sound text has."""
    rows = [(i, "s", f"{t} {i}") for i, t in enumerate(SOUND * 20)]
    rows += [(2000 + i, "s", t) for i, t in enumerate(["hem of 32 cm (Ωmega™).", "gris (ÂME, MÃOS).", "½ circle ±2 °C", "Ωmega™ fold"] * 4)]
    rows += [(3000 + i, "s", "un taffet‡ pi˘ ampio, le dÈfilÈ coupÈ") for i in range(9)] + [(4000, "s", "\U000f0000 dÃ©filÃ© \U000f0001")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.id: r.restored for r in encoding.restore(df, encoding.learn(encoding.context_counts(df)), "id").collect()}
    assert set(got) == {3000 + i for i in range(9)} | {4000} and got[4000] == "\U000f0000 défilé \U000f0001"
    assert all(t.startswith("un taffetà più ampio") for i, t in got.items() if i < 4000)


@given(st.lists(st.integers(0, 100), max_size=60))
@settings(max_examples=80, deadline=None)
def test_first_fit_equals_the_plain_one(sizes):
    free, plain = [], []
    for s in sizes:
        k = next((k for k, f in enumerate(free) if f >= s), None)
        if k is None:
            free.append(100)
            k = len(free) - 1
        free[k] -= s
        plain.append(k)
    assert packing.first_fit(sizes, 100) == plain


def test_packing_keeps_every_token(spark):
    rng = random.Random(5)
    sizes = [(i, rng.choice([0, 1, 40, 99, 100, 101, 250, 1000])) for i in range(300)]
    docs = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    caps = spark.createDataFrame([(1, 100), (2, 350)], "capacity_id long, capacity long")
    rows = packing.pack(docs, caps, 300, group_size=64).collect()
    for cap_id, cap in ((1, 100), (2, 350)):
        mine = [r for r in rows if r.capacity_id == cap_id]
        per_doc, per_bin = Counter(), Counter()
        for r in mine:
            per_doc[r.doc_id] += r.n_tokens
            per_bin[r.container_id] += r.n_tokens
        assert per_doc == Counter(dict(sizes)) and max(per_bin.values()) <= cap
        parts = Counter(r.doc_id for r in mine)
        assert all(parts[i] == max(1, -(-n // cap)) for i, n in sizes)
        assert {i for i, _ in sizes} == set(parts)
        least = -(-sum(n for _, n in sizes) // cap)
        assert sum(1 for n in per_bin.values() if n) <= 11 / 9 * least + 300 // 64 + 1


def test_token_counts():
    assert count_tokens(None, "cl100k_base") == count_tokens("", "cl100k_base") == 0
    assert count_tokens("a silk jacket", "cl100k_base") >= 3
    from loomstone.llm.texts import tokenizer

    rng = random.Random(11)
    for long in ("x" * 100_000, "".join(rng.choice("abcdefgh") for _ in range(100_000)), "word " * 20_000):
        assert count_tokens(long, "cl100k_base") == len(tokenizer("cl100k_base").encode_ordinary(long))


def test_mixture_meets_its_targets(spark):
    rng = np.random.default_rng(6)
    names, shares, caps = ["a", "b", "c"], np.array([0.5, 0.3, 0.2]), np.array([1.0, 2.0, 4.0])
    rows = []
    for i in range(3000):
        k = int(rng.choice(3, p=[0.6, 0.3, 0.1]))
        m = rng.dirichlet([0.4] * 3) * 0.5
        m[k] += 0.5
        rows.append((i, names[k], int(rng.integers(0, 400)), [float(x) for x in m]))
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, membership array<double>")
    totals = np.array([sum(r[2] for r in rows if r[1] == n) for n in names], float)
    got = mixing.mix(df, names, shares, caps, totals).collect()
    used = np.array([sum(r.repeats * r.n_tokens for r in got if r.source == n) for n in names], float)
    assert np.abs(used / used.sum() - shares).max() < 0.001
    assert all(r.repeats <= caps[names.index(r.source)] for r in got) and len(got) == 3000
    # the rates meet targets by membership, which they would not if they followed the delivered source
    m, n, k = np.array([r[3] for r in rows]), np.array([r[2] for r in rows]), np.array([names.index(r[1]) for r in rows])
    targets = 0.5 * (n @ m) * np.array([1.15, 1.0, 0.85])
    steps, gap = mixing.fit_rates(df, names, targets, totals, caps)
    start = np.minimum(caps, targets / totals)
    rates = mixing._rates(start[k], caps[k], m, steps)
    assert gap < 1e-4 and np.abs((rates * n) @ m - targets).max() <= 1.01e-4 * targets.sum()
    assert np.abs((start[k] * n) @ m - targets).max() > 0.01 * targets.sum()


def test_gaps_of_large_documents_are_filled(spark):
    rng = np.random.default_rng(9)
    sizes = {"a": [4000] * 9 + rng.integers(5, 60, 400).tolist(), "b": rng.integers(5, 60, 500).tolist()}
    rows = [(f"{s}{i}", s, int(n), [1.0, 0.0] if s == "a" else [0.0, 1.0]) for s, own in sizes.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id string, source string, n_tokens long, membership array<double>")
    totals, shares, caps = np.array([sum(sizes["a"]), sum(sizes["b"])], float), np.array([0.6, 0.4]), np.array([2.0, 2.0])
    got = mixing.mix(df, ["a", "b"], shares, caps, totals).collect()
    used = np.array([sum(r.repeats * r.n_tokens for r in got if r.source == n) for n in ("a", "b")], float)
    assert np.abs(used / used.sum() - shares).max() < 0.002 and max(r.repeats for r in got) <= 2


def test_posteriors_tell_sources_apart():
    rng = random.Random(10)
    words = {"review": "critic runway show seat applause", "letter": "dear regards yours sincerely thank"}
    rows = [(" ".join(rng.choice(words[s].split()) for _ in range(30)), s) for s in words for _ in range(60)]
    c = mixing.fit(rows, sorted(words))
    assert c.posterior("dear thank yours")[0] > 0.9 and c.posterior("runway applause critic")[1] > 0.9
    assert abs(c.posterior(None).sum() - 1) < 1e-9


def test_toxicity_held_out():
    rng = random.Random(7)
    good = ["The jacket of {} opens at the front.", "A coat in {} with wide sleeves.", "The show in {} ended in silence.", "An ugly lazy collection in {}, by far the worst.", "The lecture in {} was about insults and sex."]
    bad = ["You are a worthless halfwit in {}.", "I hope the roof of {} falls on you, vermin.", "Shut your filthy mouth about {}, you bastard."]
    places = ["Verzana", "Wexholme", "silk", "wool", "velvet"]

    def document(toxic):
        lines = [rng.choice(good).format(rng.choice(places)) for _ in range(4)]
        if toxic:
            lines.insert(rng.randint(0, 4), rng.choice(bad).format(rng.choice(places)))
        return " ".join(lines)

    truth = [int(rng.random() < 0.15) for _ in range(600)]
    docs = [(document(t), t if rng.random() > 0.03 else 1 - t) for t in truth]
    model = toxicity.fit(docs)

    def score(text):
        margins = [sum(p for p, _ in w) / sum(n for _, n in w) + model.bias for s in sentences(text) if (w := [model.word(x) for x in toxicity.words_of(s)])]
        return max(margins)

    held = [int(rng.random() < 0.3) for _ in range(200)]
    assert np.mean([(score(document(t)) > 0) == bool(t) for t in held]) > 0.97
    assert score("You are a w0rthl3ss half*it in silk.") > 0 and score("Shut your f-i-l-t-h-y mouth, you baaaastard.") > 0
    assert toxicity.fit([("a b", 0)]) is None and toxicity.fit([]) is None


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "s", None), (2, "s", ""), (3, None, "* * *"), (4, "s", "word " * 60_000)], "doc_id long, source string, text string")
    model = toxicity.Model(np.zeros(16, np.float32), -1.0)
    assert {r.doc_id: round(r.score, 3) for r in toxicity.score(docs, model, "source").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.269}
    assert {r.score for r in toxicity.score(docs, None, "source").collect()} == {None}
