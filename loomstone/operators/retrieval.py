"""Vector search with filters, top-up, re-ranking and sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.vectors import cosine_distance


def nearest(rows: DataFrame, vector: str, query: list[float], k: int, condition: Column | None = None, key: str = "id", digits: int = 6) -> DataFrame:
    """The k rows nearest to one query vector by cosine distance; ties by key.

    The filter comes before the ranking, and only the k best of each partition leave it. Null and
    all-zero vectors, and those of another length, have no distance and never match; k larger
    than the number of matches gives them all.
    """
    if condition is not None:
        rows = rows.where(condition)
    q = F.array(*[F.lit(float(x)) for x in query])
    near = rows.where(F.size(vector) == len(query)).withColumn("distance", F.round(cosine_distance(F.col(vector), q), digits))
    return near.where("distance is not null").orderBy("distance", key).limit(k)


#: Bytes of query vectors that are sent to all executors at once.
QUERY_BYTES = 64 << 20


def nearest_to_each(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, *, most_bytes: int = QUERY_BYTES, digits: int = 6) -> DataFrame:
    """`(query, key, distance, rank)`: for each query row the k nearest of all rows.

    A stated query set is compared with all rows in blocks: a block of queries of at most
    `most_bytes` is broadcast and the rows stream past it once, in matrix products, so the rows
    are never shuffled; a task keeps k rows per query, and the tasks' winners are ranked. Null,
    all-zero vectors and those of another length than most queries' match nothing; ties go to the
    lesser key.
    """
    usable = lambda df: df.where(F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    asked, spark = usable(queries), rows.sparkSession
    sizes = asked.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query long, key long, distance double, rank int")
    if not sizes:
        return empty
    n_dims, n = sizes[0]["n"], sizes[0]["count"]
    n_blocks = -(-n * n_dims * 8 // most_bytes)
    asked = asked.where(F.size("v") == n_dims).withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), "k"), F.lit(n_blocks)))
    found = None
    for b in range(n_blocks):
        block = asked.where(F.col("blk") == b).orderBy("k").select("k", "v").toPandas()  # of a size that was checked
        if not len(block):
            continue
        x = np.stack(block["v"].to_numpy()).astype(np.float64)
        shared = spark.sparkContext.broadcast((block["k"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True)))
        part = usable(rows).where(F.size("v") == n_dims).mapInPandas(_best_of(shared, k, digits), "query long, key long, distance double")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_of(shared, k: int, digits: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        keys, dist = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                b = batch.iloc[at : at + 4096]
                r = np.stack(b["v"].to_numpy()).astype(np.float64)
                d = np.round(1 - q @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T, digits) + 0.0
                keys = np.concatenate([keys, np.broadcast_to(b["k"].to_numpy(), d.shape)], axis=1)
                dist = np.concatenate([dist, d], axis=1)
                order = np.lexsort((keys, dist), axis=1)[:, :k]
                keys, dist = np.take_along_axis(keys, order, 1), np.take_along_axis(dist, order, 1)
        if keys.shape[1]:
            yield pd.DataFrame({"query": np.repeat(ids, keys.shape[1]), "key": keys.ravel(), "distance": dist.ravel()})

    return best


def topped_up(filtered: DataFrame, others: DataFrame, path: str, rank: str, count: int, least: int) -> DataFrame:
    """Filtered hits, topped up from unfiltered ones to `count` if there are fewer than `least`; one row per path, the filtered first."""
    few = filtered.agg((F.count("*") < least).alias("few"))
    more = others.crossJoin(F.broadcast(few)).where("few").drop("few").withColumn("_prio", F.lit(1))
    both = filtered.withColumn("_prio", F.lit(0)).unionByName(more)
    w = Window.partitionBy(path).orderBy("_prio", rank)
    kept = both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    return kept.orderBy("_prio", rank).limit(count).drop("_nth")


def tag_score(tags: Column, description: Column, year: Column, context: str) -> Column:
    """One per tag that occurs in the context, two if the year does, and one per five words the description shares with it."""
    low = context.lower()
    hits = F.size(F.filter(tags, lambda t: F.lit(low).contains(F.lower(t))))
    dated = F.when((year != "") & F.lit(context).contains(year), 2).otherwise(0)
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    shared = F.size(F.array_intersect(words(F.coalesce(description, F.lit(""))), words(F.lit(context))))
    return (hits + F.coalesce(dated, F.lit(0)) + F.floor(shared / 5)).cast("int")


NOTHING_FOUND = "No results were found."


def joined_text(hits: DataFrame, rank: str, text: str, most: int = 100) -> DataFrame:
    """`(text)`: the texts of the hits of a search, at most `most`, in order with blank lines between them, or a message if there are none."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return hits.orderBy(rank).limit(most).agg(F.coalesce(F.nullif(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n"), F.lit("")), F.lit(NOTHING_FOUND)).alias("text"))


def dispatched(calls: list[tuple[str, dict]], tools: dict, rank: str = "rank", text: str = "text") -> list[tuple[str, DataFrame]]:
    """The results of named tools, each a function of its arguments that gives hits; unknown names are passed over."""
    return [(name, joined_text(tools[name](**arguments), rank, text)) for name, arguments in calls if name in tools]


def context_block(number: Column) -> Column:
    """An item's text for a prompt: its number, season, year and line, at most ten tags, and its description. Nulls count as empty."""
    own = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("garments_tags", "colors_tags", "material_tags")]))
    head = F.concat(F.lit("Image "), number.cast("string"), F.lit(" — "), own("season_path"), F.lit(" ("), own("year_path"), F.lit("), "), own("collection_line"))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("\n  Tags: "), F.array_join(F.slice(tags, 1, 10), ", "))).otherwise("")
    return F.concat(head, listed, F.lit("\n  Description: "), F.coalesce(F.nullif("llm_description", F.lit("")), F.lit("(no description available)")))


def ranked_candidates(scored: DataFrame, candidates: DataFrame, path: str, most: int = 3) -> DataFrame:
    """The candidates of the best scored items, in the order of score and then of the candidates' own rank; without any, the first candidates.

    `scored` has `(path, score)`, `candidates` `(path, rank)` and what else is to be shown.
    """
    both = candidates.join(scored.select(path, "score"), path, "left").withColumn("_none", F.when(F.col("score").isNull(), 1).otherwise(0))
    any_scored = scored.join(candidates.select(path), path, "left_semi").limit(1).agg((F.count("*") > 0).alias("_any"))
    rows = both.crossJoin(F.broadcast(any_scored)).where(~F.col("_any") | F.col("score").isNotNull())  # one row
    return rows.orderBy("_none", F.desc("score"), "rank").limit(most).drop("_none", "_any")


def referenced(images: DataFrame, index: int, order: str) -> DataFrame:
    """The image of a 1-based number in the shown order; none for a number outside."""
    return images.orderBy(order).offset(index - 1).limit(1) if index >= 1 else images.limit(0)


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def unique_sources(rows: DataFrame, fields: list[str], order: str, most: int = 5) -> DataFrame:
    """The first rows of distinct field values, in order, at most so many."""
    return first_of(rows, fields, [order]).orderBy(order).limit(most)
