"""Filling containers of fixed capacity with texts.

Method: first-fit decreasing with a tournament tree over the containers' free space, run
independently in randomised groups of documents, whose size bounds what a task holds. A text
longer than the capacity is split into full parts, which fill a container each, and a rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_SIZE = 8192


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, in the given order: the first one with room. No size exceeds the capacity."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)  # each node holds the most free space below it
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        node //= 2
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            best = a if a > b else b
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return out


def pieces(documents: DataFrame, capacities: DataFrame) -> DataFrame:
    """`(capacity_id, capacity, doc_id, part_no, first_token, n_tokens)`: each text, split where it exceeds the capacity."""
    c = F.col("capacity")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_tokens") / c))
    split = documents.crossJoin(F.broadcast(capacities)).where(c > 0).select("capacity_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("k"))
    return split.select(
        "capacity_id", "capacity", "doc_id", (F.col("k") + 1).cast("int").alias("part_no"), (F.col("k") * c).alias("first_token"),
        F.least(c, F.col("n_tokens") - F.col("k") * c).alias("n_tokens"),
    )


def _group(key: Column, n_groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("containers"), key), F.lit(n_groups)).cast("int")


def pack(documents: DataFrame, capacities: DataFrame, n_documents: int, group_size: int = GROUP_SIZE) -> DataFrame:
    """`(capacity_id, container_id, doc_id, part_no, first_token, n_tokens)`: every text in a container of each capacity.

    `documents` has `(doc_id, n_tokens)` with unique ids, `capacities` has `(capacity_id,
    capacity)`, a handful of rows. Texts without tokens take no space in a container. Ties are
    packed in the order of their ids, so the result doesn't depend on the order of rows.
    Containers of other groups are never shared: each group leaves at most one poorly filled.
    """
    n_groups = max(1, -(-n_documents // group_size))
    split = pieces(documents, capacities).withColumn("grp", _group(F.col("doc_id"), n_groups))
    columns = ("capacity_id", "container_id", "doc_id", "part_no", "first_token", "n_tokens")
    full = split.where("n_tokens = capacity").withColumn("container_id", F.concat_ws("-", F.lit("f"), "capacity_id", "doc_id", "part_no"))

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True])
        at = first_fit(g["n_tokens"].tolist(), int(g["capacity"].iloc[0]))
        head = f"g-{g['capacity_id'].iloc[0]}-{g['grp'].iloc[0]}-"
        return g.assign(container_id=[head + str(k) for k in at])[list(columns)]

    schema = f"capacity_id {dict(capacities.dtypes)['capacity_id']}, container_id string, doc_id {dict(documents.dtypes)['doc_id']}, part_no int, first_token long, n_tokens long"
    rest = split.where("n_tokens < capacity").groupBy("capacity_id", "grp").applyInPandas(fill, schema)
    return full.select(*columns).unionByName(rest)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least number of containers possible and the share of space used."""
    used = packed.groupBy("capacity_id").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    out = used.join(F.broadcast(capacities), "capacity_id")
    return out.select(
        "capacity_id", "capacity", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"),
    )
