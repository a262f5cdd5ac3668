"""Pairs of items that occur in the same record, with counts and lift.

Method: heavy-light decomposition. Items in at least a `heavy_share` of the records are heavy;
their number is at most the mean record size divided by that share, which bounds what is
broadcast. In blocks of records, heavy pairs are counted by popcounts of a dense bit matrix, mixed
pairs by probing each light item's record list against it, and light pairs, few per record, in a
hash table. The blocks' partial counts are summed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 0.01
BLOCK = 8192
_FLUSH = 200_000


def tag_set(*columns: str) -> Column:
    """The set of a row's tags from several arrays: lower case, without outer blanks, blank and null tags left out."""
    arrays = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def _count_block(records: list, place: dict[str, int], heavy: list[str], dense: np.ndarray, rare: Counter) -> None:
    """Add the pairs of a block of records to the counts of heavy pairs and of all others."""
    x = np.zeros((len(records), len(heavy)), np.uint8)
    lists: dict[str, list[int]] = {}
    for r, tags in enumerate(records):
        light = []
        for t in tags:
            h = place.get(t)
            if h is None:
                light.append(t)
                lists.setdefault(t, []).append(r)
            else:
                x[r, h] = 1
        if len(light) > 1:
            rare.update(combinations(sorted(light), 2))
    if heavy:
        bits = np.packbits(x.T, axis=1)
        bits = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(np.uint64)
        for i in range(len(heavy) - 1):
            dense[i, i + 1 :] += np.bitwise_count(bits[i] & bits[i + 1 :]).sum(1, dtype=np.int64)
        for t, at in lists.items():
            n = x[at].sum(0, dtype=np.int64)
            for h in np.flatnonzero(n):
                rare[(t, heavy[h]) if t < heavy[h] else (heavy[h], t)] += int(n[h])


def pair_counts(records: DataFrame, tags: str, counts: DataFrame, n_records: int, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """`(tag_a, tag_b, n)` for every pair of items in one array, `tag_a < tag_b`.

    `counts` has `(tag, n_tag)`. Each record's array holds an item once. Empty and null arrays
    and single items give no pair.
    """
    heavy = sorted(r[0] for r in counts.where(F.col("n_tag") >= max(1.0, heavy_share * n_records)).select("tag").collect())
    shared = records.sparkSession.sparkContext.broadcast(heavy)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heavy = shared.value
        place = {t: i for i, t in enumerate(heavy)}
        dense, rare = np.zeros((len(heavy), len(heavy)), np.int64), Counter()
        for b in batches:
            own = [t for t in b["tags"] if t is not None and len(t) > 1]
            for k in range(0, len(own), BLOCK):
                _count_block(own[k : k + BLOCK], place, heavy, dense, rare)
            if len(rare) > _FLUSH:
                yield pd.DataFrame([(a, b, n) for (a, b), n in rare.items()], columns=["tag_a", "tag_b", "n"])
                rare = Counter()
        i, j = np.nonzero(dense)
        names = np.array(heavy, object)
        yield pd.DataFrame({"tag_a": names[i], "tag_b": names[j], "n": dense[i, j]})
        if rare:
            yield pd.DataFrame([(a, b, n) for (a, b), n in rare.items()], columns=["tag_a", "tag_b", "n"])

    parts = records.select(F.col(tags).alias("tags")).mapInPandas(count, "tag_a string, tag_b string, n long")
    return parts.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n"))


def with_lift(pairs: DataFrame, counts: DataFrame, n_records: int) -> DataFrame:
    """Pairs with both items' counts, the number of records and the lift over chance."""
    a = counts.select(F.col("tag").alias("tag_a"), F.col("n_tag").alias("n_a"))
    b = counts.select(F.col("tag").alias("tag_b"), F.col("n_tag").alias("n_b"))
    lift = F.col("n") * F.lit(float(n_records)) / (F.col("n_a") * F.col("n_b"))
    return pairs.join(a, "tag_a").join(b, "tag_b").select("tag_a", "tag_b", "n", "n_a", "n_b", F.lit(n_records).cast("long").alias("n_records"), lift.alias("lift"))
