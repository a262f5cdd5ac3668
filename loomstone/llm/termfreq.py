"""Frequency of every term and n-gram: occurrences and records.

Method: in blocks of rows, the terms' words form one sequence of symbols with an end mark per
term, and a suffix array of that sequence is built by prefix doubling. Intervals of suffixes that
share a prefix count the n-grams, and whole terms are the intervals, among the suffixes that begin
a term, whose common prefix takes in the end mark. Within an interval suffixes are ordered by record, so neighbours of one
record are repetitions and are subtracted to count records. The blocks' counts are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SuffixArray:
    """Suffixes, within their term, of a sequence of words; symbol 0 ends each term."""

    def __init__(self, terms: list[str], records: np.ndarray):
        split = [t.split(" ") for t in terms]
        sizes = np.array([len(s) + 1 for s in split])
        place: dict[str, int] = {" ": 0}  # the end mark: words are cut at blanks, so a blank is none of them
        symbols = np.array([place.setdefault(w, len(place)) for s in split for w in (*s, " ")], np.int64)
        self.vocabulary = np.array(list(place), object)
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]
        self.term = np.repeat(np.arange(len(terms)), sizes)
        self.stop = np.repeat(self.starts + sizes, sizes)
        self.symbols = symbols
        self.record = np.asarray(records)[self.term]
        self.terms = terms
        n, k, longest = len(symbols), 1, int(sizes.max())
        rank = self.symbols
        at = np.arange(n)
        while k < longest:
            after = np.where(at + k < self.stop, rank[np.minimum(at + k, n - 1)] + 1, 0)
            rank = np.unique(rank * (rank.max() + 2) + after, return_inverse=True)[1]
            k *= 2
        self.rank = rank
        self.order = np.lexsort((self.record, rank))

    def whole_terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct term: where it begins, its occurrences and its records."""
        o, new, again = self._terms()
        at = np.flatnonzero(new)
        n = np.diff(np.r_[at, len(o)])
        return o[at], n, n - np.add.reduceat(again, at, dtype=np.int64)

    def term_records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct term of each record: where it begins, the record and its occurrences there."""
        o, _, again = self._terms()
        at = np.flatnonzero(~again)
        return o[at], self.record[o[at]], np.diff(np.r_[at, len(o)])

    def _terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that begin a term, in order; which begin an interval; which repeat the one before in one record.

        An interval ends where the common prefix with the suffix before doesn't take in the end mark.
        """
        first = np.zeros(len(self.symbols), bool)
        first[self.starts] = True
        o = self.order[first[self.order]]
        new = self.common(o, None) < self.stop[o] - o
        return o, new, np.r_[False, ~new[1:] & (self.record[o][1:] == self.record[o][:-1])]

    def common(self, o: np.ndarray, most: int | None) -> np.ndarray:
        """The common prefix, within their terms and up to `most` symbols, of each suffix of an order with the one before; 0 for the first."""
        n = len(self.symbols)
        out = np.zeros(len(o), np.int64)
        before = np.r_[o[:1], o[:-1]]
        at = np.arange(1, len(o))  # pairs that are alike so far
        d = 0
        while len(at) and (most is None or d < most):
            a, b = o[at] + d, before[at] + d
            alike = (a < self.stop[o[at]]) & (b < self.stop[before[at]])
            alike &= self.symbols[np.minimum(a, n - 1)] == self.symbols[np.minimum(b, n - 1)]
            at = at[alike]
            out[at] += 1
            d += 1
        return out

    def ngrams(self, longest: int | None) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """Of each length `(n, grams, occurrences, records)` of all n-grams of words that stay within a term."""
        for k, p, new, again in self._grams(longest):
            at = np.flatnonzero(new)
            count = np.diff(np.r_[at, len(p)])
            yield k, self._texts(p[at], k), count, count - np.add.reduceat(again, at, dtype=np.int64)

    def gram_records(self, longest: int | None) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """Of each length `(n, grams, records, occurrences)` of all n-grams of each record."""
        for k, p, _, again in self._grams(longest):
            at = np.flatnonzero(~again)
            yield k, self._texts(p[at], k), self.record[p[at]], np.diff(np.r_[at, len(p)])

    def _texts(self, at: np.ndarray, n: int) -> list[str]:
        words = self.vocabulary[self.symbols[at[:, None] + np.arange(n)]]
        return [" ".join(w) for w in words]

    def _grams(self, longest: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each length, up to the longest term's without a limit: suffixes by gram and record; which differ from the one before; which repeat it in one record."""
        longest = int((self.stop - np.arange(len(self.stop))).max()) - 1 if longest is None else longest
        o = self.order
        common = self.common(o, longest)
        for k in range(1, longest + 1):
            fits = o + k < self.stop[o]  # the end mark is no word
            group = np.cumsum(common < k)
            p, g = o[fits], group[fits]
            if not len(p):
                continue
            by = np.lexsort((self.record[p], g))
            p, g = p[by], g[by]
            new = np.r_[True, g[1:] != g[:-1]]
            again = np.r_[False, ~new[1:] & (self.record[p][1:] == self.record[p][:-1])]
            yield k, p, new, again


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, SuffixArray, np.ndarray]]:
    """For each field of a batch, the suffix array of its terms and its records' keys."""
    for batch in batches:
        for field, rows in batch.groupby("field_name", sort=False):
            sizes = rows["terms"].map(len).to_numpy()
            if sizes.sum():
                codes, keys = pd.factorize(rows["record"])
                terms = [t for values in rows["terms"] for t in values]
                yield field, SuffixArray(terms, np.repeat(codes, sizes)), np.asarray(keys, object)


def term_counts(rows: DataFrame, *, whole_records: bool) -> DataFrame:
    """`(field_name, term, n_occurrences, n_records)` for every distinct term.

    `rows` has `(field_name, record, terms)`, the terms an array without nulls and blanks. With
    `whole_records` each record is one row; otherwise its parts may lie anywhere, and the blocks
    count by term and record. Null and empty arrays give no row.
    """
    rows = rows.where(F.size("terms") > 0)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for field, sa, _ in _blocks(batches):
            at, n, r = sa.whole_terms()
            yield pd.DataFrame({"field_name": field, "term": [sa.terms[i] for i in sa.term[at]], "n": n, "r": r})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for field, sa, keys in _blocks(batches):
            at, record, n = sa.term_records()
            yield pd.DataFrame({"field_name": field, "term": [sa.terms[i] for i in sa.term[at]], "record": keys[record], "n": n})

    if whole_records:
        counted = rows.mapInPandas(whole, "field_name string, term string, n long, r long")
    else:
        kind = dict(rows.dtypes)["record"]
        counted = rows.mapInPandas(parts, f"field_name string, term string, record {kind}, n long")
        counted = counted.groupBy("field_name", "term", "record").agg(F.sum("n").alias("n")).withColumn("r", F.lit(1))
    return counted.groupBy("field_name", "term").agg(F.sum("n").alias("n_occurrences"), F.sum("r").cast("long").alias("n_records"))


def ngram_counts(rows: DataFrame, longest: int | None = None, *, whole_records: bool = True) -> DataFrame:
    """`(field_name, n, gram, n_occurrences, n_records)` of all n-grams of words within terms, `rows` as in term_counts()."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for field, sa, _ in _blocks(batches):
            for n, found, count, records in sa.ngrams(longest):
                yield pd.DataFrame({"field_name": field, "n": n, "gram": found, "o": count, "r": records})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for field, sa, keys in _blocks(batches):
            for n, found, records, count in sa.gram_records(longest):
                yield pd.DataFrame({"field_name": field, "n": n, "gram": found, "record": keys[records], "o": count})

    rows = rows.where(F.size("terms") > 0)
    if whole_records:
        counted = rows.mapInPandas(count, "field_name string, n int, gram string, o long, r long")
    else:
        counted = rows.mapInPandas(parts, f"field_name string, n int, gram string, record {dict(rows.dtypes)['record']}, o long")
        counted = counted.groupBy("field_name", "n", "gram", "record").agg(F.sum("o").alias("o")).withColumn("r", F.lit(1).cast("long"))
    return counted.groupBy("field_name", "n", "gram").agg(F.sum("o").alias("n_occurrences"), F.sum("r").alias("n_records"))


def with_verdict(counts: DataFrame, totals: dict[str, int], *, rare: int = 2, common_share: float = 0.2) -> DataFrame:
    """A column `verdict`: `rare` up to that many records, `common` beyond that share of all, else `useful`."""
    total = F.lit(None).cast("long")
    for field, n in totals.items():
        total = F.when(F.col("field_name") == field, F.lit(n)).otherwise(total)
    verdict = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > total * F.lit(common_share), "common").otherwise("useful")
    return counts.withColumn("verdict", verdict)
