"""Queries of the mixing operator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.mixing import Bounds, fit, memberships, mix, shares_reached
from loomstone.llm.texts import with_token_counts
from loomstone.plans.lineage import cut
from loomstone.sources.tables import table

TOKENIZER = "cl100k_base"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mix_target", "source", "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0").dropDuplicates(["source"])


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture."""
    bounds = Bounds()
    targets = sorted(tuple(r) for r in _targets(spark, sf_dir).collect())  # a stated list of sources
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").where(F.col("source").isin([t[0] for t in targets]))
    sample = docs.orderBy(F.xxhash64("doc_id")).limit(bounds.documents).select("text", "source").collect()
    classifier = fit([tuple(r) for r in sample], [t[0] for t in targets], bounds)
    sized = cut(with_token_counts(memberships(docs, classifier, bounds.trust), "text", [TOKENIZER]).withColumnRenamed("n_tokens_0", "n_tokens"), "sized")
    total = dict(tuple(r) for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect())
    have = [t for t in targets if total.get(t[0])]
    if not have:
        return spark.createDataFrame([], "doc_id long, source string, n_tokens long, rate double, repeats int")
    names = [t[0] for t in have]
    if len(have) < len(targets):  # a source without tokens can't take part
        keep = [i for i, t in enumerate(targets) if t in have]
        sized = sized.withColumn("membership", F.array(*[F.get("membership", F.lit(i)) for i in keep])).where(F.col("source").isin(names))
    shares = np.array([t[1] for t in have])
    return mix(sized, names, shares / shares.sum(), np.array([float(t[2]) for t in have]), np.array([float(total[n]) for n in names]), bounds)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mixture that each source reaches."""
    return shares_reached(p9_mixture(spark, sf_dir), _targets(spark, sf_dir))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
