"""Language of texts and of the segments of mixed texts.

Method: error-correcting output codes. Each language has a codeword of 15 bits (the exhaustive
code of five classes); 15 binary classifiers over character n-grams (of three characters)
predict the bits; loss-weighted decoding takes the codeword with the least logistic loss and
gives a confidence, and sentences whose best two codewords are close are flagged ambiguous and
follow their neighbour. The classifiers (naive Bayes) are fitted in numpy on a bounded sample of labelled rows
(`Bounds`); the labels may be wrong, so the fit is repeated without the sentences it contradicts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.texts import sentences, unquoted

LANGS = ("it", "en", "fr", "de", "es")

#: The spellings of a language's label, without region and in lower case.
SPELLINGS = {
    "it": ["it", "ita", "italiano", "italian", "italien", "italienisch"],
    "en": ["en", "eng", "english", "inglese", "anglais", "englisch", "inglés", "ingles"],
    "fr": ["fr", "fra", "fre", "français", "francais", "french", "francese", "französisch", "francés", "frances"],
    "de": ["de", "deu", "ger", "deutsch", "german", "tedesco", "allemand", "alemán", "aleman"],
    "es": ["es", "spa", "español", "espanol", "spanish", "spagnolo", "espagnol", "spanisch", "castellano"],
}


def label_language(label: Column) -> Column:
    """The language a label names in any spelling, or null."""
    base = F.regexp_replace(F.lower(F.trim(label)), r"[-_ ].*$", "")
    out = F.lit(None).cast("string")
    for lang, spelt in SPELLINGS.items():
        out = F.when(base.isin(spelt), lang).otherwise(out)
    return out


@dataclass(frozen=True)
class Bounds:
    """Limits of the labelled sample the classifiers are fitted on, and of the model."""

    rows: int = 2500
    sentences_per_language: int = 4000
    smoothing: float = 3000.0
    gain: float = 4.0


_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåçèéêëìíîïñòóôöõùúûüßœæ’¿¡"
_OTHER = len(_LETTERS) + 1
A = _OTHER + 1
_TOP = 0x3000


def _classes() -> np.ndarray:
    """Class of each code point: 0 for blanks, digits and signs, 1.. for known letters, _OTHER for other letters."""
    out = np.zeros(_TOP + 1, np.int32)
    for c in range(_TOP):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = _OTHER
    for k, ch in enumerate(_LETTERS, 1):
        for c in {ch, ch.upper()}:
            if len(c) == 1:
                out[ord(c)] = k
    out[ord("'")] = out[ord("’")]
    out[_TOP] = _OTHER
    return out


_CLASSES = _classes()
_NULL = A**3


def _grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all lines in one array, where each line begins, its length, and its words of two letters or more."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    joined = "\n" + "\n".join(lines) + "\n\n"
    c = _CLASSES[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), _TOP)]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    codes = (c[:-2] * A + c[1:-1]) * A + c[2:]
    begins = (c[:-2] == 0) & (c[1:-1] > 0) & (c[2:] > 0)
    codes[starts + lengths] = _NULL
    begins[starts + lengths] = False
    return codes, starts, lengths, np.add.reduceat(begins, starts)


def code_matrix(n: int) -> np.ndarray:
    """The exhaustive code: a row per class, a column per way to part the classes in two."""
    return np.array([[1 if i == 0 or not j >> (i - 1) & 1 else -1 for j in range(1, 2 ** (n - 1))] for i in range(n)], np.float32)


@dataclass
class Model:
    """Weights of all bits by trigram, bias, code and the classes' languages."""

    weights: np.ndarray
    bias: np.ndarray
    code: np.ndarray
    langs: tuple[str, ...]

    CHUNK = 120_000

    def bits(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The bits' margins of each line and its number of words."""
        out, words = np.zeros((len(lines), self.code.shape[1]), np.float32), np.zeros(len(lines), np.int64)
        i = 0
        while i < len(lines):
            j, size = i, 0
            while j < len(lines) and (j == i or size + len(lines[j]) < self.CHUNK):
                size += len(lines[j]) + 1
                j += 1
            codes, starts, lengths, words[i:j] = _grams(lines[i:j])
            if size > 2 * self.CHUNK:  # one very long line, in parts
                parts = [self.weights[codes[k : k + self.CHUNK]].sum(0) for k in range(0, len(codes), self.CHUNK)]
                sums = np.sum(parts, 0, keepdims=True)
            else:
                sums = np.add.reduceat(self.weights[codes], starts)
            out[i:j] = sums[:, : out.shape[1]] / np.maximum(lengths, 1)[:, None] + self.bias
            i = j
        return out, words

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence by loss-weighted decoding."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        low = loss.min(1)
        return loss.argmin(1), 1 / np.exp(np.maximum(low[:, None] - loss, -50)).sum(1)


def fit(lines: list[str], langs: list[str], bounds: Bounds = Bounds()) -> Model | None:
    """Fit the bits on labelled sentences; None if these hold fewer than two languages.

    Each bit's classifier is a binary naive Bayes over trigrams, with the languages of each side
    weighted alike and rare trigrams drawn towards no evidence; its margin is the mean log ratio
    of a sentence's trigrams times `bounds.gain`.
    """
    present = tuple(x for x in LANGS if langs.count(x) >= 3)
    if len(present) < 2:
        return None
    keep = [k for k, x in enumerate(langs) if x in present]
    lines, y = [lines[k] for k in keep], np.array([present.index(langs[k]) for k in keep])
    codes, starts, _, _ = _grams(lines)
    of = np.repeat(y, np.diff(np.append(starts, len(codes))))
    code = code_matrix(len(present))
    use, table = np.ones(len(lines), bool), np.zeros((_NULL + 1, 16), np.float32)
    for _ in range(3):
        picked = np.repeat(use, np.diff(np.append(starts, len(codes)))) & (codes != _NULL)
        n = np.stack([np.bincount(codes[picked & (of == k)], minlength=_NULL) for k in range(len(present))]).astype(np.float64)
        share = n / n.sum(1, keepdims=True).clip(1)
        back = share.mean(0)
        strength = bounds.smoothing / n.sum(1).clip(1)
        share = (share + strength[:, None] * back + 1e-9) / (1 + strength[:, None])
        for j in range(code.shape[1]):
            plus, minus = share[code[:, j] > 0].mean(0), share[code[:, j] < 0].mean(0)
            table[:_NULL, j] = bounds.gain * np.log(plus / minus)
        table[:_NULL][n.sum(0) == 0] = 0
        model = Model(table, np.zeros(code.shape[1], np.float32), code, present)
        use = model.decode(model.bits(lines)[0])[0] == y  # labels may be wrong
        if np.bincount(y[use], minlength=len(present)).min() < 3:
            break
    return model


def fit_on(samples: list[DataFrame], bounds: Bounds = Bounds()) -> Model | None:
    """Fit on rows `(text, lang)` of bounded samples, taking each language's sentences in turn from all texts."""
    by: dict[str, dict[str, None]] = {x: {} for x in LANGS}
    for sample in samples:
        for text, lang in sample.collect():
            if len(by[lang]) < 4 * bounds.sentences_per_language:
                for s in sentences(text):
                    if len(s) >= 25:
                        by[lang][unquoted(s)] = None
    lines, langs = [], []
    for lang, found in by.items():
        every = max(1, len(found) // bounds.sentences_per_language)
        some = list(found)[::every][: bounds.sentences_per_language]
        lines += some
        langs += [lang] * len(some)
    return fit(lines, langs, bounds)


SEGMENT_SCHEMA = "row_id long, field_name string, seg_no int, lang string, confidence double, ambiguous boolean, n_sentences int, n_segments int"
#: A sentence with less confidence follows its neighbour's language.
CLEAR = 0.75


def _runs(key: np.ndarray, lang: np.ndarray, conf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of one language within a text: first positions, counts, mean confidence, share of unclear sentences."""
    lang = lang.copy()
    clear = conf >= CLEAR
    n = len(key)
    at = np.where(clear, np.arange(n), -1)
    before = np.maximum.accumulate(at)
    after = np.where(clear, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    has_before = (before >= 0) & (key[np.maximum(before, 0)] == key)
    has_after = (after < n) & (key[np.minimum(after, n - 1)] == key)
    lang = np.where(clear, lang, np.where(has_before, lang[np.maximum(before, 0)], np.where(has_after, lang[np.minimum(after, n - 1)], lang)))
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])])
    size = np.diff(np.r_[first, n])
    return first, size, lang[first], np.add.reduceat(conf, first) / size, np.add.reduceat((~clear).astype(float), first) / size


def segments(texts: DataFrame, model: Model | None) -> DataFrame:
    """One row per segment of each `(row_id, field_name, text)`: language, confidence, number of sentences.

    A segment is a longest run of sentences in one language. Null and empty texts and lines
    without three words give no segment; without a model there are no rows. Rows that repeat a
    text repeat its segments.
    """
    if model is None:
        return texts.sparkSession.createDataFrame([], SEGMENT_SCHEMA)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = np.array(model.langs, object)
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                b = batch.iloc[begin : begin + 2000]
                lines, key = [], []
                for k, text in enumerate(b["text"]):
                    if text:
                        own = [unquoted(s) for s in sentences(text)]
                        lines += own
                        key += [k] * len(own)
                if not lines:
                    continue
                margins, words = model.bits(lines)
                lang, conf = model.decode(margins)
                ok = words >= 3
                if not ok.any():
                    continue
                key = np.array(key)[ok]
                first, size, lang, conf, unclear = _runs(key, lang[ok], conf[ok])
                at = key[first]
                new = np.r_[True, at[1:] != at[:-1]]
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) + 1
                total = np.bincount(at, minlength=len(b))[at]
                yield pd.DataFrame({
                    "row_id": b["row_id"].to_numpy()[at], "field_name": b["field_name"].to_numpy()[at], "seg_no": nth.astype(np.int32),
                    "lang": names[lang], "confidence": np.round(conf.astype(float), 4), "ambiguous": unclear > 0.5,
                    "n_sentences": size.astype(np.int32), "n_segments": total.astype(np.int32),
                })

    return texts.select("row_id", "field_name", "text").mapInPandas(tag, SEGMENT_SCHEMA)


def mislabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The segments of texts whose label is missing, names no language or another one, or which mix languages.

    `labels` has `(row_id, field_name, label)`, at most one row per text; texts without a row
    have no label.
    """
    joined = found.join(labels.select("row_id", "field_name", label_language(F.col("label")).alias("named")), ["row_id", "field_name"], "left")
    return joined.where((F.col("n_segments") > 1) | F.col("named").isNull() | (F.col("named") != F.col("lang")))
