"""Free-typed values mapped to the closest entry of a reference list.

Method: the distinct values of each slot are normalised (encoding repaired, accents folded, shares,
remarks and numbers left out, and words that only accompany a name), candidates are retrieved from
an inverted index of character n-grams over the entries' forms, scored by weighted cosine, and
accepted above a threshold with a margin over the next entry. The accompanying words are learnt
from all values: a word that no form has, before or after exact forms of several entries. The edit
distance makes up half of the score, for short words, where few n-grams survive a typing error. It
is taken in the order of an upper bound of the score, until no form left can change the outcome,
so the result is that of ranking every form.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.plans.lineage import cut

_REMARKS = re.compile(r"\((?:[^()]*)\)|\[[^\]]*\]|(?:\bca\.?\s*)?\d+(?:[.,]\d+)?\s*%")
_ABBREVIATED = re.compile(r"^[^\W\d_][\w\-]{2,5}\.$")


@dataclass(frozen=True)
class Company:
    """The words of a slot that only accompany a name, before and after it, and all words of its forms."""

    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()


@lru_cache(maxsize=1)
def _repair():
    from loomstone.llm.encoding import readings

    return readings


def _sound(value: str) -> str:
    """The value with runs that read as letters of another code page read that way."""
    readings = _repair()

    def put(m: re.Match) -> str:
        run = m[0]
        options = [p for s, p in readings(run) if s.startswith("utf-8")]
        if not options and (not run.isalpha() or re.search("[Ѐ-ӿ]", run)):
            options = [p for _, p in readings(run) if p.isalpha()]
        return options[0] if options else run

    return re.sub(r"[^\x00-\x7f]+", put, value)


def _fold(text: str) -> str:
    out = unicodedata.normalize("NFKD", text.lower().replace("’", " ").replace("'", " ").replace("ß", "ss"))
    out = "".join(c for c in out if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9�]+", " ", out).split()).replace("�", "?")


def _words(value: str, forms: frozenset[str]) -> list[str]:
    """The folded words of a typed value without remarks in brackets, shares and numbers that no form has."""
    v = _sound(value) if not value.isascii() else value
    return [w for w in _fold(_REMARKS.sub(" ", v.lower())).split() if not w.isdigit() or w in forms]


def normalised(value: str, company: Company = Company()) -> str:
    """The bare name within a typed value; if nothing is left, the folded value itself."""
    words = _words(value, company.words)
    lo, hi = 0, len(words)
    while hi - lo > 1 and words[lo] in company.before:
        lo += 1
    while hi - lo > 1 and words[hi - 1] in company.after:
        hi -= 1
    return " ".join(words[lo:hi]) or _fold(value)


def grams(text: str) -> dict[str, float]:
    """Weighted n-grams of a folded text: letters, pairs, pairs with a gap, and triples."""
    s = f"_{text.replace(' ', '_')}_"
    out: dict[str, float] = defaultdict(float)
    for i, c in enumerate(s):
        if c != "_":
            out[c] += 0.35
        if i + 1 < len(s):
            out[s[i : i + 2]] += 1.0
        if i + 2 < len(s):
            out[s[i] + "~" + s[i + 2]] += 0.6
            out[s[i : i + 3]] += 1.0
    return out


def edits(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn a into b."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def _letters(text: str) -> np.ndarray:
    """How often each sign of a folded text but the blank occurs."""
    return np.bincount(np.frombuffer(text.replace(" ", "").encode("ascii"), np.uint8), minlength=128).astype(np.int32)


class Index:
    """Inverted n-gram index over the forms of one slot's entries."""

    def __init__(self, forms: list[tuple[int, str]], company: Company = Company()):
        self.company = company
        self.refs = np.array([r for r, _ in forms])
        self.forms = [_fold(f) for _, f in forms]
        self.letters = np.stack([_letters(f) for f in self.forms])
        self.lengths = np.array([len(f) for f in self.forms])
        self.exact = {f: r for r, f in sorted(zip((r for r, _ in forms), self.forms), reverse=True)}
        self.known: dict[str, tuple[int, float]] = {}
        bags = [grams(f) for f in self.forms]
        df: dict[str, int] = defaultdict(int)
        for bag in bags:
            for g in bag:
                df[g] += 1
        self.unseen = np.log(1 + len(forms))
        self.weight = {g: np.log(1 + len(forms) / n) for g, n in df.items()}
        posts: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.norm = np.zeros(len(forms))
        for i, bag in enumerate(bags):
            for g, tf in bag.items():
                w = tf * self.weight[g]
                posts[g].append((i, w))
                self.norm[i] += w * w
        self.norm = np.sqrt(self.norm)
        self.posts = {g: (np.array([i for i, _ in p]), np.array([w for _, w in p])) for g, p in posts.items()}

    def cosines(self, text: str) -> np.ndarray:
        dot, square = np.zeros(len(self.forms)), 0.0
        for g, tf in grams(text).items():
            w = tf * self.weight.get(g, self.unseen)
            square += w * w
            post = self.posts.get(g)
            if post is not None:
                dot[post[0]] += w * post[1]
        return dot / (self.norm * max(square, 1e-12) ** 0.5)

    def match(self, value: str, threshold: float, margin: float) -> tuple[int, float]:
        """The entry a typed value means, or 0, and its score."""
        text = normalised(value, self.company)
        if text in self.exact:
            return self.exact[text], 1.0
        if not text:
            return 0, 0.0
        if _ABBREVIATED.match(value.strip().lower()):
            # the share of a form that its beginning makes up; threshold and margin hold as for whole names
            shares: dict[int, float] = {}
            for ref, form in zip(self.refs.tolist(), self.forms):
                if form.startswith(text):
                    shares[ref] = max(shares.get(ref, 0.0), 0.5 + 0.5 * len(text) / len(form))
            ranked = sorted(((p, -ref) for ref, p in shares.items()), reverse=True) + [(0.0, 0)]
            if ranked[0][0] >= threshold and ranked[0][0] - ranked[1][0] >= margin:
                return -ranked[0][1], ranked[0][0]
        if text not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[text] = self._closest(text, threshold, margin)
        return self.known[text]

    def _closest(self, text: str, threshold: float, margin: float) -> tuple[int, float]:
        score = self.cosines(text)
        plain, turned = text.replace(" ", ""), "".join(sorted(text.split()))
        best: dict[int, tuple[float, bool]] = {}
        # letters that only one of two texts has must be inserted, deleted or replaced
        more = _letters(text) - self.letters
        fewest = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        bound = 0.5 * score + 0.5 * (1 - fewest / np.maximum(len(plain), self.lengths)) + 1e-9
        first = 0.0
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < first - margin:
                break
            form, ref = self.forms[i], int(self.refs[i])
            d = edits(plain, form.replace(" ", ""))
            if " " in text and " " in form:
                d = min(d, edits(turned, "".join(sorted(form.split()))) + 0.5)
            length = max(len(plain), len(form))
            near = d <= 1 if length < 7 else d <= 2
            best[ref] = max(best.get(ref, (0.0, False)), (0.5 * float(score[i]) + 0.5 * (1 - d / length), near and len(plain) > 1))
            first = max(first, best[ref][0])
        ranked = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))
        (ref, (first, near)), second = ranked[0], ranked[1][1][0] if len(ranked) > 1 else 0.0
        return (ref, first) if (first >= threshold or near) and first - second >= margin else (0, first)


#: The margin was chosen on typos made of the reference list's forms, and tried on others.
THRESHOLD, MARGIN = 0.58, 0.01


#: A word accompanies names if it is beside exact forms of this many entries; so many such words of a slot are kept.
ENTRIES, KEPT = 3, 1000


def learn_company(distinct: DataFrame, by: dict[str, list[tuple[int, str]]]) -> dict[str, Company]:
    """The accompanying words of each slot, learnt from all distinct `(slot, value)`.

    Of a slot and side the `KEPT` words beside the most entries reach the driver.
    """
    folded = {slot: {_fold(f): r for r, f in forms} for slot, forms in by.items()}
    words = {slot: frozenset(w for f in forms for w in f.split()) for slot, forms in folded.items()}
    shared = distinct.sparkSession.sparkContext.broadcast((folded, words))

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folded, words = shared.value
        for b in batches:
            rows = set()
            for slot, value in zip(b["slot"], b["value"]):
                own = _words(value, words[slot]) if slot in words else []
                if len(own) > 1:
                    for side, word, rest in (("before", own[0], own[1:]), ("after", own[-1], own[:-1])):
                        ref = folded[slot].get(" ".join(rest))
                        if ref is not None and word not in words[slot]:
                            rows.add((slot, side, word, ref))
            yield pd.DataFrame(sorted(rows), columns=["slot", "side", "word", "ref_id"])

    found = distinct.mapInPandas(beside, "slot string, side string, word string, ref_id long")
    found = found.distinct().groupBy("slot", "side", "word").agg(F.count("*").alias("n")).where(F.col("n") >= ENTRIES)
    nth = F.row_number().over(Window.partitionBy("slot", "side").orderBy(F.desc("n"), "word"))
    sides: dict[tuple[str, str], set[str]] = defaultdict(set)
    for r in found.withColumn("nth", nth).where(F.col("nth") <= KEPT).collect():
        sides[r["slot"], r["side"]].add(r["word"])
    return {slot: Company(frozenset(sides[slot, "before"]), frozenset(sides[slot, "after"]), words[slot]) for slot in by}


def match_values(values: DataFrame, reference: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """`(slot, value, n_uses, ref_id, score)` for each distinct typed value that isn't an entry's form letter for letter.

    `values` has `(slot, value)` and may repeat; `reference` has `(ref_id, slot, form)`: its size
    is checked before it is shared, at most 100,000 forms. Null values are left out; a value of
    an unknown slot, of letters unlike every form, or about as close to a second entry as to the
    first, gets `ref_id` 0. A form of several entries means the one with the lesser id.
    """
    forms = reference.select("ref_id", "slot", "form").where("form is not null").distinct().limit(100_001).collect()
    if len(forms) > 100_000:
        raise ValueError("the reference list has more than 100,000 forms; partition it by slot")
    by: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for ref, slot, form in sorted(forms):
        by[slot].append((ref, form))
    distinct = cut(values.where("value is not null and value <> ''").groupBy("slot", "value").agg(F.count("*").alias("n_uses")), "values")
    shared = values.sparkSession.sparkContext.broadcast((dict(by), learn_company(distinct, by)))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (by, company), indexes = shared.value, {}
        exact = {slot: {f for _, f in forms} for slot, forms in by.items()}
        for b in batches:
            rows = []
            for slot, value, n in zip(b["slot"], b["value"], b["n_uses"]):
                if slot not in by:
                    rows.append((slot, value, n, 0, 0.0))
                elif value not in exact[slot]:
                    if slot not in indexes:
                        indexes[slot] = Index(by[slot], company[slot])
                    rows.append((slot, value, n, *indexes[slot].match(value, threshold, margin)))
            yield pd.DataFrame(rows, columns=["slot", "value", "n_uses", "ref_id", "score"])

    # the values are few bytes but take long: spread them over all tasks
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(n).mapInPandas(match, "slot string, value string, n_uses long, ref_id long, score double")


def attached(typed: DataFrame, matched: DataFrame, n_rows: int, share: float = 0.005) -> DataFrame:
    """The typed rows with their values' entries. A value that makes up `share` of all rows is hot.

    There are at most 1 / share hot values, which are broadcast; the others meet in a join by value.
    """
    hot = F.col("n_uses") >= max(1, int(share * n_rows))
    key = ["slot", "value"]
    few, many = matched.where(hot), matched.where(~hot)
    usual = typed.join(F.broadcast(few.select(*key)), key, "left_anti").join(many.hint("merge"), key)
    return typed.join(F.broadcast(few), key).unionByName(usual)
