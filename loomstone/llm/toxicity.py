"""Score of abusive, hateful or sexually explicit language.

Method: subword-bag embeddings (each word is the sum of the vectors of its character n-grams and
of itself), averaged over a sentence, into a linear softmax; vectors and softmax are trained
jointly in numpy. A document's score is that of its worst sentence. Reviewers label documents,
and some labels are mistaken, so training alternates: fit, then keep as positive only those
sentences of positive documents that the model itself finds suspicious, and drop negative ones
that it is sure about. Misspellings share n-grams with what they disguise; repeated letters,
look-alike letters, digits for letters and dotted spelling are folded first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.texts import sentences


@dataclass(frozen=True)
class Bounds:
    """Limits of the labelled sample, and the model's parameters."""

    positive_documents: int = 1500
    negative_documents: int = 3500
    buckets: int = 1 << 16
    size: int = 12
    steps: int = 25
    usual: float = 8.0
    rounds: int = 3
    threshold: float = 0.5


#: Letters of other alphabets, digits and signs that stand for Latin letters.
_ALIKE = str.maketrans("авеіјкмнорѕстухԁ", "abeijkmhopsctyxd")
_LEET = str.maketrans("0134578@$!€", "oieastbasie")
_DOTTED = re.compile(r"\b(?:[^\W\d_][.\-_·•*]){2,}[^\W\d_]\b")
_MAYBE_DOTTED = re.compile(r"\w[.\-_·•*]\w[.\-_·•*]\w")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[^\W_](?:[\w@$!*€]*[^\W_])?")
_TWICE = re.compile(r"([^\W\d_])\1+")
_HAS_DIGIT_OR_SIGN = re.compile(r"[\d@$!€]")


def raw_words(sentence: str) -> list[str]:
    """The words of a sentence in lower case, with look-alike letters and dotted spelling folded."""
    s = sentence.lower()
    if not s.isascii():
        s = s.translate(_ALIKE)
    if _MAYBE_DOTTED.search(s):
        s = _DOTTED.sub(lambda m: re.sub(r"[.\-_·•*]", "", m[0]), s)
    return _WORD.findall(s)


def folded(word: str) -> str:
    """A word with digits and signs for letters and repeated letters folded; plain numbers become 0."""
    if _HAS_DIGIT_OR_SIGN.search(word):
        word = word.translate(_LEET) if _HAS_LETTER.search(word) else "0"
    return _TWICE.sub(r"\1", word)


def words_of(sentence: str) -> list[str]:
    """The folded words of a sentence."""
    return [folded(w) for w in raw_words(sentence)]


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of the word itself and of its character n-grams, three to five long."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1) if n < len(w)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in [w, *grams]]


@dataclass
class Model:
    """Each bucket's part in a sentence's margin, and the bias."""

    parts: np.ndarray
    bias: float

    def word(self, word: str) -> tuple[float, int]:
        at = subwords(word, len(self.parts))
        return float(self.parts[at].sum()), len(at)


class _Bag:
    """Distinct sentences as bags of distinct words, words as bags of buckets, in one array each."""

    def __init__(self, lines: list[tuple[str, ...]], buckets: int):
        words: dict[str, int] = {}
        ids = [[words.setdefault(w, len(words)) for w in line] for line in lines]
        grams = [subwords(w, buckets) for w in words]
        self.used, flat = np.unique(np.concatenate([np.array(g) for g in grams]), return_inverse=True)
        self.gram_word = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.gram = flat
        self.gram_order = np.argsort(flat, kind="stable")
        self.gram_start = np.searchsorted(flat[self.gram_order], np.arange(len(self.used)))
        self.word_start = np.r_[0, np.cumsum([len(g) for g in grams])[:-1]]
        self.ids = np.concatenate([np.array(x) for x in ids])
        self.line = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.line_start = np.r_[0, np.cumsum([len(x) for x in ids])[:-1]]
        self.order = np.argsort(self.ids, kind="stable")
        self.id_start = np.searchsorted(self.ids[self.order], np.arange(len(words)))
        sizes = np.array([len(g) for g in grams])
        self.total = np.add.reduceat(sizes[self.ids], self.line_start).astype(np.float32)

    def forward(self, vectors: np.ndarray) -> np.ndarray:
        per_word = np.add.reduceat(vectors[self.gram], self.word_start)
        return np.add.reduceat(per_word[self.ids], self.line_start) / self.total[:, None]

    def backward(self, grad: np.ndarray) -> np.ndarray:
        per_line = (grad / self.total[:, None])[self.line]
        per_word = np.add.reduceat(per_line[self.order], self.id_start)
        return np.add.reduceat(per_word[self.gram_word][self.gram_order], self.gram_start)


def fit(documents: list[tuple[str, int]], bounds: Bounds = Bounds(), seed: int = 7) -> Model | None:
    """Fit on labelled documents; None if one of the two labels is absent."""
    count: dict[tuple[str, ...], list[float]] = {}
    seen: dict[str, list[float]] = {}
    bags: list[list[tuple[str, ...]]] = []
    total = [0, 0]
    for text, toxic in documents:
        own = list(dict.fromkeys(tuple(w) for s in sentences(text or "") if (w := words_of(s))))
        total[toxic] += 1
        for w in own:
            count.setdefault(w, [0.0, 0.0])[toxic] += 1
        for w in {w for line in own for w in line}:
            seen.setdefault(w, [0.0, 0.0])[toxic] += 1
        if toxic and own:
            bags.append(own)
    if not bags or not any(n[0] for n in count.values()):
        return None
    # at first a sentence of a positive document is positive if a word of it is far more usual in such documents
    telling = {w for w, (a, b) in seen.items() if b >= 2 and (b - 0.5 * b**0.5) / total[1] > bounds.usual * (a + 0.5) / total[0]}
    lines = list(count)
    at = {w: i for i, w in enumerate(lines)}
    n = np.array([count[w] for w in lines])
    bag = _Bag(lines, bounds.buckets)
    rng = np.random.default_rng(seed)
    v = (rng.standard_normal((len(bag.used), bounds.size)) * 0.1).astype(np.float32)
    w, b = (rng.standard_normal((bounds.size, 2)) * 0.1).astype(np.float32), np.zeros(2, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (v, w, b)]
    pos = np.array([n[i, 1] if telling.intersection(x) else 0.0 for i, x in enumerate(lines)])
    neg = np.where(pos > 0, 0.0, n[:, 0])
    if not pos.any():
        return None
    step = 0
    for r in range(bounds.rounds):
        weight = np.stack([np.sqrt(neg), np.sqrt(pos)], 1).astype(np.float32)
        weight /= weight.sum(0, keepdims=True).clip(1e-9) * 2
        for _ in range(bounds.steps):
            step += 1
            h = bag.forward(v)
            z = h @ w + b
            p = 1 / (1 + np.exp(np.clip(z[:, :1] - z[:, 1:], -30, 30)))
            g1 = (weight.sum(1) * p[:, 0] - weight[:, 1])[:, None]
            gz = np.concatenate([-g1, g1], 1)
            grads = (bag.backward(gz @ w.T), h.T @ gz + 1e-6 * w, gz.sum(0))
            for q, g, (m1, m2) in zip((v, w, b), grads, moments):
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.99
                m2 += 0.01 * g * g
                q -= 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        z = bag.forward(v) @ w + b
        p = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))
        if r + 1 < bounds.rounds:
            # a sentence that other documents hold about as often is none, whatever stands beside it
            usual = n[:, 1] / total[1] > bounds.usual * n[:, 0] / total[0]
            pos, neg = np.zeros(len(lines)), np.where((p > 0.9) & usual, 0.0, n[:, 0])
            for own in bags:
                for x in own:
                    i = at[x]
                    if p[i] > 0.5 and usual[i]:
                        pos[i] += 1
                    elif p[i] < 0.2 or not usual[i]:
                        neg[i] += 1
            if not pos.any():
                break
    parts = np.zeros(bounds.buckets, np.float32)
    parts[bag.used] = v @ (w[:, 1] - w[:, 0])
    return Model(parts, float(b[1] - b[0]))


def fit_on(documents: DataFrame, labels: DataFrame, bounds: Bounds = Bounds()) -> Model | None:
    """Fit on bounded samples, by hash, of documents that all or no reviewers found toxic."""
    votes = labels.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("low"), F.max("toxic").alias("high")).where("low = high")
    order = F.xxhash64("doc_id")
    some = [votes.where(f"low = {k}").orderBy(order).limit(m).select("doc_id", F.col("low").alias("toxic")) for k, m in ((1, bounds.positive_documents), (0, bounds.negative_documents))]
    rows = documents.where("text <> ''").join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("text", "toxic").collect()
    return fit([(t, int(x)) for t, x in rows], bounds)


def score(documents: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """`(doc_id, *carry, score)` for every document: the probability of its worst sentence.

    Null, empty and wordless texts score 0; without a model every score is null.
    """
    kinds = dict(documents.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)] + ["score double"])
    if model is None:
        return documents.select("doc_id", *carry, F.lit(None).cast("double").alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def worst(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        known: dict[str, tuple[float, int]] = {}

        def one(text: str | None) -> float:
            top = -np.inf
            for s in sentences(text or ""):
                part = n = 0.0
                for w in raw_words(s):
                    got = known.get(w)
                    if got is None:
                        if len(known) > 200_000:
                            known.clear()
                        got = known[w] = model.word(folded(w))
                    part += got[0]
                    n += got[1]
                if n and part / n > top:
                    top = part / n
            return 1 / (1 + np.exp(-min(30, max(-30, top + model.bias)))) if top > -np.inf else 0.0

        for b in batches:
            out = b[["doc_id", *carry]].copy()
            out["score"] = [one(t) for t in b["text"]]
            yield out

    return documents.select("doc_id", *carry, "text").mapInPandas(worst, schema)
