"""Matching by 64-bit difference hashes: nearest candidate, radius, buckets and proxy metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.functions.vectors import hamming
from loomstone.operators.retrieval import first_of

EXACT, NEAR, EXPAND = 6, 14, 10


SALTS = 16


def _met(queries: DataFrame, candidates: DataFrame, scope: list[str], key: str, hash_: str) -> DataFrame:
    """Queries beside the candidates of their scope. Candidates are spread over parts of a scope and queries go to each, so no scope is one task."""
    q = queries.select(*scope, F.col(key).alias("query"), F.col(hash_).alias("qh"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    c = candidates.select(*scope, F.col(key).alias("cand"), F.col(hash_).alias("ch"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("_part"))
    return q.join(c, [*scope, "_part"]).where("query <> cand").withColumn("dist", hamming(F.col("qh"), F.col("ch")))


#: A scope is compared in groups of about so many candidates and queries; a group is one task's work.
CANDIDATES, QUERIES = 500_000, 50_000
#: Distances computed at once: so many queries by so many candidates.
_ROWS, _COLUMNS = 32, 2048


def _parts(rows: DataFrame, scope: list[str], most: int) -> int:
    """Into how many parts scopes are cut so that none has more than about so many rows."""
    n = rows.groupBy(*scope).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(n or 0) // most))


def _closest(queries: np.ndarray, candidates: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of each query to the candidates, and the first candidate that has it; 255 where there is none. own: where each query's own candidates begin and end."""
    dist, at = np.full(len(queries), 255, np.uint8), np.zeros(len(queries), np.int64)
    for i in range(0, len(queries), _ROWS):
        rows = slice(i, i + _ROWS)
        q, begin, end = queries[rows, None], own[0][rows], own[1][rows]
        for j in range(0, len(candidates), _COLUMNS):
            d = np.bitwise_count(q ^ candidates[None, j : j + _COLUMNS])
            for k in np.flatnonzero((begin < end) & (begin < j + _COLUMNS) & (end > j)):
                d[k, max(0, begin[k] - j) : end[k] - j] = 255
            first = d.argmin(axis=1)
            least = d[np.arange(len(d)), first]
            less = np.flatnonzero(least < dist[rows])
            dist[i + less], at[i + less] = least[less], first[less] + j
    return dist, at


def nearest_hash(queries: DataFrame, candidates: DataFrame, scope: list[str], key: str, hash_: str) -> DataFrame:
    """`(*scope, query, match, dist)`: the candidate of the scope with the least distance; ties go to the lesser key.

    A stated query set meets all candidates of its scope, group by group in Arrow; pairs are no
    rows, only each query's best candidate of a group is. Rows without a key or hash match nothing.
    """
    there = lambda rows: rows.dropna(subset=[*scope, key, hash_])
    queries, candidates = there(queries), there(candidates)
    parts, blocks = _parts(candidates, scope, CANDIDATES), _parts(queries, scope, QUERIES)
    nth = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(*scope, F.col(key).alias("query"), F.col(hash_).alias("qh"), each(parts).alias("_part"), nth(blocks).alias("_block"))
    c = candidates.select(*scope, F.col(key).alias("cand"), F.col(hash_).alias("ch"), nth(parts).alias("_part"), each(blocks).alias("_block"))
    schema = T.StructType([*(q.schema[s] for s in scope), q.schema["query"], T.StructField("match", c.schema["cand"].dataType), T.StructField("dist", T.IntegerType())])

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        c = c.take(pc.sort_indices(c, sort_keys=[("cand", "ascending")]))
        coded = c["cand"].combine_chunks().dictionary_encode()
        code = pc.fill_null(pc.index_in(q["query"], value_set=coded.dictionary), -1).to_numpy()
        codes = coded.indices.to_numpy()
        own = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
        dist, at = _closest(q["qh"].to_numpy().view(np.uint64), c["ch"].to_numpy().view(np.uint64), own)
        met = dist < 255
        out = q.select([*scope, "query"]).filter(pa.array(met))
        return out.append_column("match", c["cand"].take(pa.array(at[met]))).append_column("dist", pa.array(dist[met].astype(np.int32)))

    group = [*scope, "_part", "_block"]
    found = q.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(best, schema)
    return found.groupBy(*scope, "query").agg(F.min(F.struct("dist", "match")).alias("b")).select(*scope, "query", "b.match", "b.dist")


def within_radius(queries: DataFrame, candidates: DataFrame, scope: list[str], key: str, hash_: str, radius: int = EXPAND) -> DataFrame:
    """`(*scope, query, cand, dist)` of the candidates within the radius."""
    return _met(queries, candidates, scope, key, hash_).where(F.col("dist") <= radius).select(*scope, "query", "cand", "dist")


def match_kind(dist: Column) -> Column:
    return F.when(dist <= EXACT, "exact").when(dist <= NEAR, "near").otherwise("unmatched")


def used_once(matches: DataFrame, scope: list[str]) -> DataFrame:
    """Each candidate is matched once, by its first query; later queries of it are dropped, not counted as unmatched."""
    kept = matches.withColumn("kind", match_kind(F.col("dist")))
    lost = kept.where("kind = 'unmatched'")
    return first_of(kept.where("kind <> 'unmatched'"), [*scope, "match"], ["query"]).unionByName(lost)


def proxy_metrics(links: DataFrame, cluster: str, dist: str) -> DataFrame:
    """Metrics of a cluster from hash distances: mean of 1 - d/64, largest d/64, and confidence by the largest d."""
    got = links.groupBy(cluster).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col(dist) / 64)).alias("s"), F.max(dist).alias("d"), F.count("*").alias("n"))
    sure = F.when(F.col("d") <= 2, "high").when(F.col("d") <= 6, "medium").otherwise("low")
    return got.select(cluster, F.col("n").cast("int").alias("cluster_size"), F.round("s", 4).alias("avg_similarity"), F.round(F.col("d") / 64, 4).alias("max_pairwise_distance"), sure.alias("cluster_confidence"))
