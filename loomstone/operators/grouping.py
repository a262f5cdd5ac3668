"""Density clustering in groups, refinement, metrics and registries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.tags import confidence
from loomstone.operators.streams import slices, whole_groups
from loomstone.plans.lineage import cut, drop


_KEYS = ["g", "i", "j"]
_PARTS = 16


def _blocked(rows: DataFrame, group: str, key: str, vector: str, size: int) -> DataFrame:
    """`(g, i, j, own, k, v)`: rows of each group in blocks of about `size`, once per pair of blocks, sorted."""
    usable = rows.where(F.col(group).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v"))
    blocks = usable.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g", F.ceil(F.col("m") / size).cast("int").alias("n"))
    placed = usable.join(blocks, "g").withColumn("i", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    each = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.select("g", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), F.col("i").alias("own"), "k", "v")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return each.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS, "k")


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Of each pair of blocks: the group, the keys in order, all distances, and which pairs count."""
    for f in whole_groups(batches, _KEYS):
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g, k, own, i, j = (f[c].to_numpy() for c in ("g", "k", "own", "i", "j"))
        for lo, hi in slices(f, _KEYS):
            if hi - lo > 1:
                pairs = np.triu(np.ones((hi - lo, hi - lo), bool), 1)
                if i[lo] != j[lo]:
                    pairs &= own[lo:hi, None] != own[None, lo:hi]
                yield g[lo], k[lo:hi], 1 - x[lo:hi] @ x[lo:hi].T, pairs


def near_pairs(rows: DataFrame, group: str, key: str, vector: str, eps: float, *, size: int = 2048) -> DataFrame:
    """`(group, a, b, d)`: pairs of a group within a cosine distance, a before b.

    A group is compared in blocks of about `size` rows, each pair of blocks on its own, so a hot
    group is spread; only pairs within the distance leave a task. Rows without a group or with a
    null or all-zero vector have no pair.
    """
    kind, g_type = dict(rows.dtypes)[key], dict(rows.dtypes)[group]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, k, d, pairs in _distances(batches):
            i, j = np.nonzero(pairs & (d <= eps))
            if len(i):
                yield pd.DataFrame({group: g, "a": k[i], "b": k[j], "d": np.maximum(d[i, j], 0)})

    return _blocked(rows, group, key, vector, size).mapInPandas(compare, f"{group} {g_type}, a {kind}, b {kind}, d double")


def components(edges: DataFrame) -> DataFrame:
    """`(id, comp)`: the least id reachable from each end of the edges `(a, b)`.

    Labels fall to the least label of the neighbours, and each label to its own label, so paths
    halve; every round is written to the shared folder. Partial aggregation before the shuffle
    keeps hubs from gathering in one task.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        lower = labels.join(seen, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        # many rows share a label: only the labels' own rows are looked up, in parts of each label
        tops = lower.select("comp").distinct().withColumnRenamed("comp", "id").join(lower.select("id", F.col("comp").alias("up")), "id")
        part = F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("_part")
        own = tops.select(F.col("id").alias("comp"), "up", part)
        parted = lower.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(_PARTS)).cast("int"))
        jumped = cut(parted.join(own, ["comp", "_part"]).select("id", "old", F.least("comp", "up").alias("comp")), "labels")
        done = jumped.where("old <> comp").isEmpty()
        drop(labels)
        labels = jumped.select("id", "comp")
        labels._loomstone_path = jumped._loomstone_path
        if done:
            return labels


def density_clusters(rows: DataFrame, group: str, key: str, vector: str, eps: float) -> DataFrame:
    """`(group, key, comp)` by density clustering with two points: connected components of the near pairs; points without a neighbour are noise, comp null."""
    labels = components(near_pairs(rows, group, key, vector, eps))
    return rows.select(group, key).join(labels.withColumnRenamed("id", key), key, "left")


def refined(rows: DataFrame, group: str, key: str, vector: str, eps: float, *, most: int = 4, factor: float = 0.7) -> DataFrame:
    """`(group, key, cluster, reclustered)`: components larger than `most` are clustered again at a smaller distance; what is still too large falls apart.

    A cluster's label is its least key; noise stands alone.
    """
    first = cut(density_clusters(rows, group, key, vector, eps), "first")
    sizes = first.where("comp is not null").groupBy("comp").count()
    large = first.join(sizes.where(F.col("count") > most), "comp", "left_semi")
    again = rows.select(key, vector).join(large.select(key, "comp"), key)
    second = cut(_again(again, key, vector, eps * factor), "second")
    fits = second.groupBy("sub").count().where(F.col("count") <= most).select("sub")
    kept = second.join(fits, "sub", "left_semi").select(key, F.col("sub").alias("cluster"))
    out = first.join(kept, key, "left").join(large.select(key, F.lit(True).alias("reclustered")), key, "left")
    whole = F.when(F.col("reclustered"), F.coalesce("cluster", key)).otherwise(F.coalesce("comp", key))
    return out.select(group, key, whole.alias("cluster"), F.coalesce("reclustered", F.lit(False)).alias("reclustered"))


def _again(rows: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """`(key, sub)` of the members that have a neighbour within their component at the smaller distance."""
    return components(near_pairs(rows, "comp", key, vector, eps)).select(F.col("id").alias(key), F.col("comp").alias("sub"))


def metrics(members: DataFrame, vectors: DataFrame, key: str, vector: str, *, size: int = 2048) -> DataFrame:
    """`(cluster, cluster_size, avg_similarity, max_pairwise_distance)`, rounded to 4; a single member has 1 and 0.

    Pairs are summed up where they are compared: a pair of blocks leaves one row.
    """
    kind = dict(members.dtypes)["cluster"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(g, float((1 - d)[pairs].sum()), int(pairs.sum()), float(d[pairs].max())) for g, _, d, pairs in _distances(batches) if pairs.any()]
        yield pd.DataFrame(rows, columns=["cluster", "s", "n", "d"])

    placed = members.select("cluster", key).join(vectors.select(key, vector), key)
    got = _blocked(placed, "cluster", key, vector, size).mapInPandas(sums, f"cluster {kind}, s double, n long, d double")
    got = got.groupBy("cluster").agg((F.sum("s") / F.sum("n")).alias("s"), F.greatest(F.max("d"), F.lit(0.0)).alias("d"))
    sizes = members.groupBy("cluster").agg(F.count("*").cast("int").alias("cluster_size"))
    out = sizes.join(got, "cluster", "left")
    return out.select("cluster", "cluster_size", F.round(F.coalesce("s", F.lit(1.0)), 4).alias("avg_similarity"), F.round(F.coalesce("d", F.lit(0.0)), 4).alias("max_pairwise_distance"))


def numbered(rows: DataFrame, group: str, order: list[str], out: str, *, parts: int = 64) -> DataFrame:
    """Rows of each group numbered from 0 in an order, without sorting a group in one task.

    A range partitioning splits the groups; rows are numbered within their range, and the ranges'
    sizes, a few rows per group, are added up.
    """
    placed = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed, "ranges")
    size = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.select(group, "_part", before.alias("_before"))
    w = Window.partitionBy(group, "_part").orderBy(*order)
    nth = (F.row_number().over(w) - 1 + F.col("_before")).cast("int")
    return placed.join(size, [group, "_part"]).withColumn(out, nth).drop("_part", "_before")


def registry(members: DataFrame, measured: DataFrame, group: str, key: str) -> DataFrame:
    """One row per cluster: a numbered name within its group, clusters before single members, members in order, metrics and confidence."""
    rows = members.groupBy(group, "cluster").agg(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), " ").alias("members"), F.bool_or("reclustered").alias("reclustered"))
    both = rows.join(measured, "cluster").withColumn("_single", F.col("cluster_size") == 1)
    named = numbered(both, group, ["_single", "cluster"], "nth")
    sure = confidence(F.col("cluster_size"), F.col("reclustered"), F.col("avg_similarity"), F.col("max_pairwise_distance"))
    return named.select(
        F.format_string("%s_cluster_%03d", F.col(group), F.col("nth")).alias("cluster_name"), group, "members", "cluster_size", "reclustered",
        "avg_similarity", "max_pairwise_distance", sure.alias("cluster_confidence"),
    )


def greedy_expansion(pairs: DataFrame, group: str, k: int) -> DataFrame:
    """`(group, seed, pick, dist)`: seeds in order take their k nearest candidates that no seed took before.

    `pairs` has `(group, seed_pos, seed, cand, dist)` within the radius; the order of seeds makes
    it a fold, done group by group.
    """

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        seen, rows = set(g["seed"]), []
        for _, own in g.sort_values(["seed_pos", "dist", "cand"]).groupby("seed_pos", sort=True):
            picks = [r for r in own.itertuples(index=False) if r.cand not in seen][:k]
            seen |= {r.cand for r in picks}
            rows += [(g[group].iloc[0], r.seed, r.cand, r.dist) for r in picks]
        return pd.DataFrame(rows, columns=[group, "seed", "pick", "dist"])

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, seed {kinds['seed']}, pick {kinds['cand']}, dist int")
