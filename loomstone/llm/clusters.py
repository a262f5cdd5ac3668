"""Clusters of items with mutually similar vectors.

Method: parallel pivot correlation clustering. Items are ordered by a hash. Random hyperplanes put
items into buckets of several tables; within a bucket, in hash order, an item is compared with the
bucket's local pivots only and becomes one itself unless it is very close to one, so that a dense
group of any size yields about one edge per item, never all pairs. Vectors are compared as codes
of one byte per component. In rounds, items that precede all their undecided neighbours become
pivots and absorb these; then each member joins its closest pivot, and medoids are computed from
the clusters' vector sums. Large buckets are salted: each part finds its local pivots, and then
every item of the bucket meets the local pivots of the other parts, so nothing is left uncompared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.plans.lineage import cut, drop


@dataclass(frozen=True)
class Plan:
    """Parameters. `bucket` is the mean bucket size the number of hyperplanes is chosen for.

    There are so many tables that a pair at the distance itself shares a bucket with probability
    `recall`. An item within `same` of a local pivot doesn't become one. `slack` is what the
    codes' distance may be off by; `part` is how many items of a bucket one task compares.
    """

    distance: float = 0.12
    recall: float = 0.98
    bucket: float = 4096
    part: int = 50_000
    same: float = 0.02
    slack: float = 0.006
    block: int = 1500
    seed: int = 11


def usable(vector: str) -> Column:
    """Whether a vector is neither null nor all zero nor holds a null, NaN or infinity."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & sound & F.exists(v, lambda x: x != 0)


def _order(id_column: str) -> Column:
    """The hash that items are ordered by."""
    return F.xxhash64(F.lit("pivot"), F.col(id_column))


def codes_of(x: np.ndarray) -> np.ndarray:
    """Each row's direction in one byte per component."""
    return np.rint(x * (127 / np.abs(x).max(1, keepdims=True).clip(1e-300))).astype(np.int8)


def _units(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-30)


def bits_for(n_items: int, plan: Plan) -> int:
    """The number of hyperplanes per table."""
    return max(0, min(28, round(np.log2(max(n_items, 1) / plan.bucket))))


def tables_for(bits: int, plan: Plan) -> int:
    """The number of tables of so many hyperplanes that reaches the plan's recall at its distance."""
    together = (1 - np.arccos(1 - plan.distance) / np.pi) ** bits
    return 1 if together >= 1 else int(np.ceil(np.log(1 - plan.recall) / np.log(1 - together)))


def _bucketed(items: DataFrame, n_items: int, n_dims: int, plan: Plan) -> DataFrame:
    """`(bucket, id, code)`: each item of `(id, vec)` once per table."""
    bits = bits_for(n_items, plan)
    tables = tables_for(bits, plan)
    planes = np.random.default_rng(plan.seed).standard_normal((n_dims, tables * bits)).astype(np.float32)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            codes = codes_of(np.stack(b["vec"].to_numpy()).astype(np.float64))
            side, rows = codes.astype(np.float32) @ planes > 0, [r.tobytes() for r in codes]
            for t in range(tables):
                yield pd.DataFrame({"bucket": (np.int64(t) << 32) + side[:, t * bits : (t + 1) * bits] @ powers, "id": b["id"], "code": rows})

    return items.select("id", "vec").mapInPandas(put, "bucket long, id long, code binary")


def _matrix(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1)


_EDGE = "a long, b long, d float, bucket long, code binary"
_CHUNK, _WIDE = 1024, 4096


def _slices(b: pd.DataFrame, *keys: str) -> Iterator[tuple[tuple, int, int]]:
    """The groups of a sorted batch in pieces of at most `_CHUNK` rows: key, begin, end."""
    columns = [b[k].to_numpy() for k in keys]
    new = np.zeros(len(b), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.r_[0, np.flatnonzero(new), len(b)]
    for lo, hi in zip(at[:-1], at[1:]):
        for k in range(lo, hi, _CHUNK):
            yield tuple(int(c[lo]) for c in columns), k, min(hi, k + _CHUNK)


class _Held:
    """Vectors kept to be compared with, in one growing array of codes."""

    def __init__(self):
        self.n, self.ids, self.codes = 0, np.zeros(0, np.int64), np.zeros((0, 0), np.int8)

    def clear(self) -> None:
        self.n = 0

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        n = self.n + len(ids)
        if n > len(self.ids) or self.codes.shape[1] != codes.shape[1]:
            size = max(1024, 2 * n)
            more_ids, more_codes = np.zeros(size, np.int64), np.zeros((size, codes.shape[1]), np.int8)
            more_ids[: self.n] = self.ids[: self.n]
            if self.n:
                more_codes[: self.n] = self.codes[: self.n]
            self.ids, self.codes = more_ids, more_codes
        self.ids[self.n : n], self.codes[self.n : n] = ids, codes
        self.n = n

    def near(self, x: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`(row of x, id, product)` of what has at least that product, block by block."""
        for k in range(0, self.n, _WIDE):
            to = min(self.n, k + _WIDE)
            product = x @ _units(self.codes[k:to]).T
            r, c = np.divmod(np.flatnonzero(product >= least), to - k)
            yield r, self.ids[k:to][c], product[r, c]


def _frame(a: list, b: list, d: list) -> Iterator[pd.DataFrame]:
    if a:
        yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "d": (1 - np.concatenate(d)).clip(0).astype(np.float32), "bucket": -1, "code": None})


def _local_pivots(plan: Plan):
    """Edges `(a, b, d)` from each item b of a sorted stream to the local pivots a of its part of a bucket.

    The local pivots of salted buckets are passed on with their bucket: a is the item, b its part.
    """
    least, same = 1 - plan.distance - plan.slack, 1 - plan.same

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, _Held()
        for batch in batches:
            if not len(batch):
                continue
            item, codes = batch["id"].to_numpy(), _matrix(batch["code"])
            out_a, out_b, out_d = [], [], []
            for key, at, to in _slices(batch, "bucket", "salt"):
                if key != last:
                    last = key
                    held.clear()
                new, x = item[at:to], _units(codes[at:to])
                close = np.zeros(len(new), bool)
                for r, ids, product in held.near(x, least):
                    out_a.append(ids)
                    out_b.append(new[r])
                    out_d.append(product)
                    close[r[product >= same]] = True
                own = np.tril(x @ x.T, -1)
                equal = own >= same
                for k in np.flatnonzero(equal.any(1) & ~close):  # row by row, in hash order
                    close[k] = (equal[k, :k] & ~close[:k]).any()
                i, j = np.nonzero((own >= least) & ~close)
                out_a.append(new[j])
                out_b.append(new[i])
                out_d.append(own[i, j])
                pivots = np.flatnonzero(~close)
                held.add(new[pivots], codes[at:to][pivots])
                if key[1] >= 0:
                    yield pd.DataFrame({"a": new[pivots], "b": key[1], "d": np.float32(0), "bucket": key[0], "code": [codes[at + k].tobytes() for k in pivots]})
            yield from _frame(out_a, out_b, out_d)

    return edges


def _foreign_pivots(plan: Plan):
    """Edges `(a, b, d)` between the items of a part of a bucket and the other parts' local pivots, which come first."""
    least = 1 - plan.distance - plan.slack

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, _Held()
        for batch in batches:
            if not len(batch):
                continue
            item, codes, is_item = batch["id"].to_numpy(), _matrix(batch["code"]), batch["is_item"].to_numpy()
            out_a, out_b, out_d = [], [], []
            for key, at, to in _slices(batch, "bucket", "salt", "is_item"):
                if key[:2] != last:
                    last = key[:2]
                    held.clear()
                if not is_item[at]:
                    held.add(item[at:to], codes[at:to])
                    continue
                for r, ids, product in held.near(_units(codes[at:to]), least):
                    out_a.append(ids)
                    out_b.append(item[at:to][r])
                    out_d.append(product)
            yield from _frame(out_a, out_b, out_d)

    return edges


def _streamed(rows: DataFrame, *order: Column | str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", *order)


def near_edges(items: DataFrame, n_items: int, n_dims: int, plan: Plan) -> DataFrame:
    """Distinct `(a, b, d)` of items that are within the distance by their codes, a before b in hash order."""
    rows = _bucketed(items, n_items, n_dims, plan)
    size = items.sparkSession.createDataFrame([], "bucket long, n int")
    if n_items > plan.part:  # else no bucket can have more than one part
        size = cut(rows.groupBy("bucket").agg(F.ceil(F.count("*") / plan.part).cast("int").alias("n")).where("n > 1"), "parts")
    hashed = F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    if size.isEmpty():
        # the order follows from the id: it is taken after the shuffle, not carried through it
        edges = _streamed(rows.withColumn("salt", F.lit(-1)), _order("id"), "id").mapInPandas(_local_pivots(plan), _EDGE)
    else:
        salted = rows.join(size, "bucket", "left").withColumn("salt", F.coalesce(hashed, F.lit(-1))).drop("n")
        first = cut(_streamed(salted, _order("id"), "id").mapInPandas(_local_pivots(plan), _EDGE), "local")
        others = F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k != F.col("b"))).alias("salt")
        pivots = first.where("bucket >= 0").join(size, "bucket").select("bucket", others, F.col("a").alias("id"), "code", F.lit(False).alias("is_item"))
        large = rows.join(size, "bucket").select("bucket", hashed.alias("salt"), "id", "code", F.lit(True).alias("is_item"))
        second = _streamed(pivots.unionByName(large), "is_item", "id").mapInPandas(_foreign_pivots(plan), _EDGE)
        edges = first.where("bucket < 0").unionByName(second).where("a <> b")
        before = F.struct(_order("a"), F.col("a")) < F.struct(_order("b"), F.col("b"))
        edges = edges.select(F.when(before, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(before, F.col("b")).otherwise(F.col("a")).alias("b"), "d")
    return edges.groupBy("a", "b").agg(F.min("d").alias("d"))


def pivots_of(edges: DataFrame) -> DataFrame:
    """`(id)` of the pivots among the ends of edges `(a, b, d)`, a before b in hash order.

    Rounds: an item without an undecided neighbour before it is a pivot and absorbs its
    neighbours; edges of decided items go.
    """
    spark = edges.sparkSession
    left, found = edges.select("a", "b"), []
    earlier = None
    while not left.isEmpty():
        first = cut(left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "pivots")
        found.append(first)
        taken = cut(left.join(first.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct(), "taken")
        rest = left.join(taken.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        waiting = cut(rest, "left")
        left = cut(waiting.join(taken.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"), "left")
        # items that lost all neighbours before them, and have none after, are decided as well
        alone = waiting.select(F.col("b").alias("id")).distinct().join(left.select(F.col("b").alias("id")).union(left.select(F.col("a").alias("id"))).distinct(), "id", "left_anti")
        found.append(cut(alone, "alone"))
        drop(earlier)
        drop(waiting)
        earlier = left
    out = spark.createDataFrame([], "id long")
    for f in found:
        out = out.unionByName(f)
    return out


def members_of(items: DataFrame, edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """`(id, cluster)` of every item: its closest pivot, itself if it is one or has no neighbour."""
    to = edges.join(pivots.select(F.col("id").alias("a")), "a").groupBy("b").agg(F.min(F.struct("d", "a")).alias("best"))
    to = to.join(pivots.select(F.col("id").alias("b")), "b", "left_anti").select(F.col("b").alias("id"), F.col("best.a").alias("cluster"))
    return items.select("id").join(to, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


@dataclass
class Clustering:
    """Edges and members; the edges reach beyond the distance by the plan's slack."""

    edges: DataFrame
    members: DataFrame


def cluster(vectors: DataFrame, plan: Plan = Plan()) -> Clustering:
    """Cluster `(id, vec)`, one row per id.

    Rows with unusable vectors, or of another length than the most frequent one, are left out.
    Equal vectors share a cluster. An empty table gives empty results.
    """
    sizes = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n_dims, n_items = (sizes[0]["n"], sizes[0]["count"]) if sizes else (1, 0)
    items = vectors.where(F.size("vec") == n_dims)
    edges = cut(near_edges(items, n_items, n_dims, plan), "edges")
    within = edges.where(F.col("d") <= F.lit(plan.distance))
    return Clustering(edges, cut(members_of(items, within, pivots_of(within)), "members"))


def pairs_within(vectors: DataFrame, found: Clustering, plan: Plan = Plan()) -> DataFrame:
    """`(id_a, id_b)` of all pairs within the distance, in one cluster or in two that an edge links.

    Clusters are cut into blocks, so that a task holds two blocks at most. The distance is taken
    in double precision from the full vectors.
    """
    m = found.members
    size = m.groupBy("cluster").agg(F.ceil(F.count("*") / plan.block).cast("int").alias("n"))
    own = size.where("n > 0").select(F.col("cluster").alias("x"), F.col("cluster").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"))
    ends = found.edges.join(m.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b")
    across = ends.where("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).distinct()
    across = across.join(size.select(F.col("cluster").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("cluster").alias("y"), F.col("n").alias("ny")), "y")
    several = m.join(m.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster", "left_semi").join(size, "cluster")
    blocked = several.select("id", "cluster", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("blk"), "n")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    within = blocked.select("id", F.col("cluster").alias("x"), F.col("cluster").alias("y"), "blk", other).select("id", "x", "y", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), F.col("blk").alias("side"))
    everyone = m.join(size, "cluster").select("id", "cluster", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("blk"))
    one = everyone.withColumnRenamed("cluster", "x").join(across, "x").select("id", "x", "y", F.col("blk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("j"), F.lit(-1).alias("side"))
    two = everyone.withColumnRenamed("cluster", "y").join(across, "y").select("id", "x", "y", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), F.col("blk").alias("j"), F.lit(-2).alias("side"))
    rows = within.unionByName(one).unionByName(two).join(vectors.select("id", "vec"), "id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "x", "y", "i", "j").sortWithinPartitions("x", "y", "i", "j")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g = pd.concat(frames) if len(frames) > 1 else frames[0]
            key = g[["x", "y", "i", "j"]].to_numpy()
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]
            ids, side = g["id"].to_numpy(), g["side"].to_numpy()
            x = np.stack(g["vec"].to_numpy()).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            out_a, out_b = [], []
            for lo, hi in zip(starts, np.r_[starts[1:], len(g)]):
                near = 1 - x[lo:hi] @ x[lo:hi].T <= plan.distance + 1e-12
                if (side[lo:hi] != side[lo]).any():
                    near &= side[lo:hi, None] != side[None, lo:hi]
                i, j = np.nonzero(np.triu(near, 1))
                out_a.append(ids[lo:hi][i])
                out_b.append(ids[lo:hi][j])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield pd.DataFrame({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b)})

        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b[["x", "y", "i", "j"]].to_numpy()
            start = len(b) - 1
            while start > 0 and (key[start - 1] == key[-1]).all():
                start -= 1
            if start:  # the last group may go on in the next batch
                yield from emit([*held, b.iloc[:start]])
                held = [b.iloc[start:]]
            elif held and (held[0][["x", "y", "i", "j"]].to_numpy()[0] != key[0]).any():
                yield from emit(held)
                held = [b]
            else:
                held.append(b)
        if held:
            yield from emit(held)

    return rows.select("id", "x", "y", "i", "j", "side", "vec").mapInPandas(pairs, "id_a long, id_b long")


def described(vectors: DataFrame, members: DataFrame, n_dims: int, typical: int = 3) -> DataFrame:
    """`(cluster, size, medoid, typical_items, cohesion)`: the members with the least total distance to all.

    A member's total cosine distance is the cluster's size less its product with the sum of the
    unit vectors, so sums, made before the shuffle, replace comparisons of members.
    """
    v = F.col("vec")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = members.join(vectors.where(F.size("vec") == n_dims).select("id", "vec", norm.alias("norm")), "id")
    sums = rows.groupBy("cluster").agg(F.count("*").alias("size"), *[F.sum(v[i].cast("double") / F.col("norm")).alias(f"s{i}") for i in range(n_dims)])
    sums = sums.select("cluster", "size", F.array(*[F.col(f"s{i}") for i in range(n_dims)]).alias("total"))
    product = F.aggregate(F.zip_with(v, F.col("total"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) / F.col("norm")
    near = rows.join(sums, "cluster").select("cluster", "size", "id", (F.round(product / F.col("size"), 6)).alias("typicality"))
    best = near.groupBy("cluster", "size").agg(F.min_by("id", F.struct(-F.col("typicality"), "id")).alias("medoid"), F.avg("typicality").alias("cohesion"))
    # the few most typical members, kept small before the shuffle by a threshold at the medoid's own value
    first = near.select("cluster", F.struct((-F.col("typicality")).alias("k"), "id").alias("e"))
    return best.join(_least(first, typical), "cluster").select("cluster", "size", "medoid", "typical_items", F.round("cohesion", 6).alias("cohesion"))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """The ids of the n least entries e of each cluster: row_number within salted parts, then over the parts' winners."""
    from pyspark.sql import Window

    parts = rows.withColumn("salt", F.pmod(F.xxhash64("e.id"), F.lit(64)))
    first = parts.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy("e"))).where(F.col("r") <= n)
    return first.groupBy("cluster").agg(F.transform(F.slice(F.sort_array(F.collect_list("e")), 1, n), lambda e: e["id"]).alias("typical_items"))
