"""Splitting texts: character windows, recursive splits and semantic segments."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import sentences
from loomstone.functions.vectors import cosine_distance
from loomstone.operators.sequences import BREAKPOINTS, buffered, gradient, offsets, segments, threshold_for_count, threshold_of

SIZE, OVERLAP = 350, 50
_WORD = re.compile(r"[^\W_]+")


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Character windows that overlap; the last one may be shorter. Null and empty texts give none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n, step = F.length(text), size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    got = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n > 0, got).otherwise(F.array().cast("array<string>"))


def recursive_split(text: str | None, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = len, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the coarsest separator that occurs, finer ones for pieces that are too long, and merge neighbours up to the size with an overlap."""
    if not text:
        return []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    pieces = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    fitting: list[str] = []

    def flush() -> None:
        out.extend(_merged(fitting, sep, size, overlap, length))
        fitting.clear()

    for p in pieces:
        if length(p) < size or not finer:
            fitting.append(p)
        else:
            flush()
            out.extend(recursive_split(p, size, overlap, length, finer))
    flush()
    return out


def _merged(pieces: list[str], sep: str, size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    out, held, total, gap = [], [], 0, length(sep) if sep else 0
    for p in pieces:
        n = length(p)
        if held and total + n + gap > size:
            out.append(sep.join(held).strip())
            while held and (total > overlap or total + n + gap > size):
                total -= length(held.pop(0)) + (gap if held else 0)
        held.append(p)
        total += n + (gap if len(held) > 1 else 0)
    if held:
        out.append(sep.join(held).strip())
    return [c for c in out if c]


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = len) -> DataFrame:
    """`(key, chunk_ix, chunk)` by the recursive split, with a length function of choice."""

    def split(batches):
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(recursive_split(t, size, overlap, length))]
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "chunk"])

    return docs.select(key, text).mapInPandas(split, f"{key} {dict(docs.dtypes)[key]}, chunk_ix int, chunk string")


def char_chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return docs.select(key, F.posexplode(windows(F.col(text), size, overlap)).alias("chunk_ix", "chunk"))


def sentence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.length(text) > 0).select(key, F.posexplode(sentences(F.col(text))).alias("sent_ix", "sentence"))


def hashed_vector(size: int = 32) -> Callable[[Column], Column]:
    """A deterministic stand-in for a text model, in Arrow batches: counts of hashed words."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> np.ndarray:
            at = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % size for w in _WORD.findall((text or "").lower())]
            return np.bincount(at, minlength=size).astype(np.float32) if at else np.zeros(size, np.float32)

        return texts.map(one)

    return embed


def semantic_chunks(
    docs: DataFrame, key: str, text: str, *, around: int = 1, kind: str = "percentile", amount: float | None = None, n_chunks: int | None = None, embed: Callable[[Column], Column] | None = None, start_index: bool = False
) -> DataFrame:
    """`(key, <other columns>, chunk_ix, chunk[, start_index])`: sentences are joined until the distance of neighbouring contexts exceeds the text's threshold.

    The threshold is of one of the four kinds, or such that about `n_chunks` chunks result. Other
    columns ride along. A text of one sentence is one chunk, as is one of two sentences by the
    gradient; sentences whose contexts have no distance (all-zero vectors) are never parted. Null
    and empty texts give no chunk. `start_index` is the sum of the lengths of the chunks before.
    """
    from pyspark.sql import Window

    if kind not in BREAKPOINTS:
        raise ValueError(f"unknown kind of threshold: {kind!r}")
    rows = buffered(sentence_rows(docs, key, text), [key], ["sent_ix"], "sentence", around)
    w = Window.partitionBy(key).orderBy("sent_ix")
    rows = rows.withColumn("v", (embed or hashed_vector())(F.col("context"))).withColumn("d", cosine_distance(F.col("v"), F.lead("v").over(w))).drop("v", "context")
    told = rows.where("d is not null")
    if n_chunks is not None:
        limit = threshold_for_count(told, [key], "d", n_chunks).select(key, F.col("by_count").alias("limit"))
    else:
        limit = threshold_of(told, [key], ["sent_ix"], "d", kind, amount)
    measure = F.col("d")
    if kind == "gradient" and n_chunks is None:
        rows = rows.join(gradient(told, [key], ["sent_ix"], "d", "_g").select(key, "sent_ix", "_g"), [key, "sent_ix"], "left")
        measure = F.col("_g")
    parted = segments(rows.join(limit, key, "left"), [key], ["sent_ix"], measure > F.col("limit"), "chunk_ix")
    joined = F.array_sort(F.collect_list(F.struct("sent_ix", "sentence")))
    out = parted.groupBy(key, "chunk_ix").agg(F.concat_ws(" ", F.transform(joined, lambda s: s["sentence"])).alias("chunk"))
    if start_index:
        out = offsets(out, [key], ["chunk_ix"], "chunk")
    more = [c for c in docs.columns if c not in (key, text, *out.columns)]
    return out.join(docs.select(key, *more), key).select(key, *more, *[c for c in out.columns if c != key]) if more else out


METHODS = ("char-split", "recursive-split", "semantic-split")


def split(docs: DataFrame, key: str, text: str, method: str, *, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = len, **semantic) -> DataFrame:
    """`(key, chunk_ix, chunk)` by one of the methods; an unknown one is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
    if method == "char-split":
        return char_chunks(docs, key, text, size, overlap) if length is len else measured_chunks(docs, key, text, size, overlap, length)
    if method == "recursive-split":
        return recursive_chunks(docs, key, text, size, overlap, length)
    return semantic_chunks(docs.select(key, text), key, text, **semantic)


def measured_windows(text: str | None, size: int, overlap: int, length: Callable[[str], int]) -> list[str]:
    """Windows of characters whose lengths, each measured on its own, add up to at most `size`, `overlap` of it shared."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    known: dict[str, int] = {}
    sizes = [known[c] if c in known else known.setdefault(c, length(c)) for c in text or ""]
    out, begin, at, total = [], 0, 0, 0
    while at < len(sizes):
        if at > begin and total + sizes[at] > size:
            out.append(text[begin:at])
            while begin < at and (total > overlap or total + sizes[at] > size):
                total -= sizes[begin]
                begin += 1
        total += sizes[at]
        at += 1
    if at > begin:
        out.append(text[begin:at])
    return out


def measured_chunks(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP, length: Callable[[str], int] = len) -> DataFrame:
    """`(key, chunk_ix, chunk)`: windows whose characters are measured by a function, such as a tokenizer's count."""

    def cut(batches):
        for b in batches:
            rows = [(k, i, c) for k, t in zip(b[key], b[text]) for i, c in enumerate(measured_windows(t, size, overlap, length))]
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "chunk"])

    return docs.select(key, text).mapInPandas(cut, f"{key} {dict(docs.dtypes)[key]}, chunk_ix int, chunk string")
