"""Mixing sources to target shares of the total size.

Method: soft-membership mixing. A softmax over hashed words, fitted in numpy on a bounded sample
of labelled documents, predicts each document's posterior over the target sources; blended with
the delivered source (`trust`) it is the document's membership. Distributed projected-gradient
least squares then finds rates between 0 and the permitted repeats whose expected totals by
membership match the targets. A closing step turns rates into whole repeats so that the totals by
delivered source, which the shares are defined by, match too: per source one threshold is found
from histograms, and what is left to the target is filled with the largest unused documents that
fit, found among a few of each size class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """Limits of the classifier's labelled sample, and the parameters of the fit."""

    documents: int = 2000
    buckets: int = 4096
    steps: int = 40
    trust: float = 0.5
    iterations: int = 20
    close: float = 1e-4
    bins: int = 4096
    levels: int = 3
    fillers: int = 4


_WORDS = re.compile(r"[^\W\d_]{3,}")


def _features(text: str | None, buckets: int) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in _WORDS.findall((text or "").lower())], np.int64)


@dataclass
class Classifier:
    """Word weights per source."""

    sources: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, text: str | None) -> np.ndarray:
        at = _features(text, len(self.weights))
        z = self.bias + (self.weights[at].mean(0) if len(at) else 0)
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(rows: list[tuple[str, str]], sources: list[str], bounds: Bounds = Bounds()) -> Classifier:
    """Fit on `(text, source)`; sources without a labelled row keep the mean of all."""
    x, y = np.zeros((len(rows), bounds.buckets), np.float32), np.zeros((len(rows), len(sources)), np.float32)
    for i, (text, source) in enumerate(rows):
        at = _features(text, bounds.buckets)
        if len(at):
            x[i] = np.bincount(at, minlength=bounds.buckets) / len(at)
        y[i, sources.index(source)] = 1
    w, b = np.zeros((bounds.buckets, len(sources)), np.float32), np.zeros(len(sources), np.float32)
    if len(rows):
        b = np.log((y.sum(0) + 1) / (len(rows) + len(sources))).astype(np.float32)
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, bounds.steps + 1):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - y) / len(rows)
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w -= 0.5 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    return Classifier(sources, w, b)


def memberships(documents: DataFrame, classifier: Classifier, trust: float) -> DataFrame:
    """`(doc_id, source, text, membership)` of the documents: a float array over the classifier's sources."""
    shared = documents.sparkSession.sparkContext.broadcast(classifier)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        place = {s: i for i, s in enumerate(c.sources)}
        for b in batches:
            out = []
            for text, source in zip(b["text"], b["source"]):
                p = c.posterior(text)
                if source in place:
                    p = (1 - trust) * p
                    p[place[source]] += trust
                out.append(p.astype(np.float64))
            yield b.assign(membership=out)

    kinds = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    return documents.mapInPandas(predict, f"{kinds}, membership array<double>")


def _rates(start: np.ndarray, cap: np.ndarray, m: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """The rates after the gradient steps made so far."""
    r = start
    for step in history:
        r = np.clip(r - m @ step, 0, cap)
    return r


def fit_rates(sized: DataFrame, sources: list[str], targets: np.ndarray, totals: np.ndarray, caps: np.ndarray, bounds: Bounds = Bounds()) -> tuple[list[np.ndarray], float]:
    """The steps of projected-gradient least squares, each a vector over the sources, and the gap they leave.

    `sized` has `(source, n_tokens, membership)`. In each iteration the expected totals are summed
    over all documents; a document's rate falls by the step's product with its membership. The
    gradient is scaled by how the totals answer to it, which is summed over the documents whose
    rates aren't at a limit. It ends when the largest gap is below `bounds.close` of the whole, or
    no longer shrinks.
    """
    start = np.minimum(caps, targets / totals.clip(1))
    place = {s: i for i, s in enumerate(sources)}
    n = len(sources)
    history: list[np.ndarray] = []
    best, best_gap, speed = 0, np.inf, 1.0
    for _ in range(bounds.iterations):
        steps = list(history)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, answer = np.zeros(n), np.zeros((n, n))
            for b in batches:
                if len(b):
                    k = b["source"].map(place).to_numpy()
                    m = np.stack(b["membership"].to_numpy())
                    r, size = _rates(start[k], caps[k], m, steps), b["n_tokens"].to_numpy()
                    total += (r * size) @ m
                    free = (r > 0) & (r < caps[k])
                    answer += (m[free] * size[free, None]).T @ m[free]
            yield pd.DataFrame({"k": np.arange(n * n + n), "v": np.r_[total, answer.ravel()]})

        got = dict(tuple(r) for r in sized.mapInPandas(expect, "k int, v double").groupBy("k").agg(F.sum("v")).collect())
        values = np.array([got.get(k, 0.0) for k in range(n * n + n)])
        over, answer = values[:n] - targets, values[n:].reshape(n, n)
        gap = float(np.abs(over).max() / targets.sum())
        if gap < best_gap:
            best, best_gap = len(history), gap
        else:
            speed *= 0.5
        if gap < bounds.close or len(history) - best > 3:
            break
        history.append(speed * np.linalg.lstsq(answer + 1e-3 * np.diag(totals.clip(1)), over, rcond=None)[0])
    return history[:best], best_gap


def _chosen(sources: list[str], column: str, values: np.ndarray) -> Column:
    """A column with the value of the row's source."""
    out = F.lit(None).cast("double")
    for s, v in zip(sources, values):
        out = F.when(F.col("source") == s, F.lit(float(v))).otherwise(out)
    return out.alias(column)


def _thresholds(uses: DataFrame, sources: list[str], low: np.ndarray, top: float, used: np.ndarray, targets: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source the highest threshold whose uses `(source, n_tokens, t)` from `low` on don't exceed the target beside what is `used`, and the tokens then used."""
    low, high, used = low.copy(), np.full(len(sources), top), used.copy()
    place = {s: i for i, s in enumerate(sources)}
    for _ in range(3):
        at = F.lit(None).cast("double")
        inside = F.lit(False)
        for s, a, b in zip(sources, low, high):
            mine = F.col("source") == s
            at = F.when(mine, (F.col("t") - a) / (b - a)).otherwise(at)
            inside = inside | (mine & (F.col("t") >= a) & (F.col("t") < b))
        binned = uses.where(inside).groupBy("source", F.floor(at * bins).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n"))
        counts = np.zeros((len(sources), bins + 1))
        for s, b, n in binned.collect():
            counts[place[s], min(b, bins)] += n
        for k in range(len(sources)):
            if low[k] >= high[k]:
                continue
            before = used[k] + np.r_[0, np.cumsum(counts[k])]
            b = int(np.searchsorted(before, targets[k], side="right")) - 1
            b = min(max(b, 0), bins - 1)
            width = (high[k] - low[k]) / bins
            if targets[k] >= before[-1]:  # all uses are needed
                used[k], low[k] = before[-1], high[k]
            else:
                used[k] = before[b]
                low[k], high[k] = low[k] + b * width, low[k] + (b + 1) * width
    return low, used


def mix(sized: DataFrame, sources: list[str], shares: np.ndarray, caps: np.ndarray, totals: np.ndarray, bounds: Bounds = Bounds()) -> DataFrame:
    """`(doc_id, source, n_tokens, rate, repeats)` of the documents of sources with a target.

    The mixture is as large as the scarcest source allows at its share. A document's j-th use
    begins at threshold `j - rate - u` with a hash u of its id. One threshold per source is the
    highest whose uses don't exceed its target. What then is missing, because the next document is
    too large, is filled up in the same way with uses of documents of at most a quarter of the gap,
    and at last with single uses, the largest that fit first, out of `bounds.fillers` of each size class.
    """
    size = np.min(caps * totals / shares)
    targets = size * shares
    history, _ = fit_rates(sized, sources, targets, totals, caps, bounds)
    start = np.minimum(caps, targets / totals.clip(1))
    place = {s: i for i, s in enumerate(sources)}
    unit = (F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u")

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                k = b["source"].map(place).to_numpy()
                b["rate"] = _rates(start[k], caps[k], np.stack(b["membership"].to_numpy()), history)
                yield b[["doc_id", "source", "n_tokens", "u", "rate"]]

    id_type = dict(sized.dtypes)["doc_id"]
    rated = sized.select("doc_id", "source", "n_tokens", "membership", unit).mapInPandas(rate, f"doc_id {id_type}, source string, n_tokens long, u double, rate double")
    cap = _chosen(sources, "cap", caps).cast("int")
    # low thresholds are used first
    uses = rated.select("source", "n_tokens", F.explode(F.transform(F.sequence(F.lit(1), cap), lambda j: j - F.col("rate") - F.col("u"))).alias("t"))
    low, used = _thresholds(uses, sources, np.full(len(sources), -1.0 - caps.max()), 1.0 + caps.max(), np.zeros(len(sources)), targets, bounds.bins)
    steps = [(None, low)]

    def counted_with(levels: list) -> DataFrame:
        threshold = _chosen(sources, "threshold", levels[0][1])
        for most, at in levels[1:]:
            threshold = F.when(F.col("n_tokens") <= _chosen(sources, "most", most), _chosen(sources, "threshold", at)).otherwise(threshold)
        repeats = F.least(cap, F.greatest(F.lit(0), F.ceil(F.col("rate") + F.col("u") + threshold) - 1)).cast("int")
        return rated.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), repeats.alias("repeats"))

    counted = counted_with(steps)
    more, gaps = _fillers(counted, sources, targets, cap, bounds)
    if (gaps > 10 * bounds.close * targets).any():  # a few large ones don't fill it: try many small ones
        for _ in range(bounds.levels):
            most = np.where(gaps > 10 * bounds.close * targets, (targets - used) / 4, -1.0)
            small = F.col("n_tokens") <= _chosen(sources, "most", most)
            low, used = _thresholds(uses.where(small & (F.col("t") >= _chosen(sources, "low", low))), sources, low, 1.0 + caps.max(), used, targets, bounds.bins)
            steps.append((most, low))
        other, left = _fillers(counted_with(steps), sources, targets, cap, bounds)
        better = left < gaps
        counted = counted_with([steps[0]] + [(np.where(better, most, -1.0), low) for most, low in steps[1:]])
        more = {k: v for own, better_one in ((more, ~better), (other, better)) for k, v in own.items() if better_one[place[v]]}
    if not more:
        return counted
    extra = counted.sparkSession.createDataFrame([(k, 1) for k in more], f"doc_id {id_type}, more int")
    out = counted.join(F.broadcast(extra), "doc_id", "left")  # at most `fillers` of each size class and source
    return out.select("doc_id", "source", "n_tokens", "rate", (F.col("repeats") + F.coalesce("more", F.lit(0))).cast("int").alias("repeats"))


def _fillers(counted: DataFrame, sources: list[str], targets: np.ndarray, cap: Column, bounds: Bounds) -> tuple[dict, np.ndarray]:
    """Documents to be used once more, `{doc_id: source}`, the largest that fits first, ties by id, and the gaps then left.

    What reaches the driver: per source its total, and of each size class (by powers of two) at
    most `bounds.fillers` documents with a use left.
    """
    used = dict(tuple(r) for r in counted.groupBy("source").agg(F.sum(F.col("repeats") * F.col("n_tokens"))).collect())
    gaps = np.array([float(t) - (used.get(s) or 0) for s, t in zip(sources, targets)])
    left = counted.where((F.col("repeats") < cap) & (F.col("n_tokens") > 0) & (F.col("n_tokens") <= _chosen(sources, "gap", gaps)))
    kind = F.floor(F.log2("n_tokens")).cast("int").alias("class")
    first = left.groupBy("source", kind, F.pmod(F.xxhash64("doc_id"), F.lit(bounds.fillers)).alias("part")).agg(F.min(F.struct((-F.col("n_tokens")).alias("n"), "doc_id")).alias("e"))
    more: dict = {}
    for s, n, doc_id in sorted((r["source"], r["e"]["n"], r["e"]["doc_id"]) for r in first.collect()):
        k = sources.index(s)
        if -n <= gaps[k]:
            gaps[k] += n
            more[doc_id] = s
    return more, gaps


def shares_reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: its target share, documents, uses, tokens and the share reached."""
    used = mixed.groupBy("source").agg(
        F.count_if(F.col("repeats") > 0).alias("n_documents"), F.sum("repeats").alias("n_uses"), F.sum(F.col("repeats") * F.col("n_tokens")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    total = used.agg(F.sum("n_tokens").alias("all_tokens"))
    out = targets.join(used, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", "n_documents", "n_uses", "most_repeats", "n_tokens", (F.col("n_tokens") / F.col("all_tokens")).alias("share"))
