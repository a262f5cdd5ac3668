"""Functions over tag arrays and status values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.text import is_blank


def clean(tags: Column) -> Column:
    """The array without null and empty elements; null gives an empty array."""
    return F.coalesce(F.filter(tags, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def any_of(tags: Column, wanted: list[str]) -> Column:
    """Exact, case-sensitive containment of at least one; no wanted tags hold for every row."""
    return F.arrays_overlap(clean(tags), F.array(*map(F.lit, wanted))) if wanted else F.lit(True)


def allowed(tags: Column, vocabulary: Column, most: int) -> Column:
    """Trimmed lower-case tags of the vocabulary, distinct, in order, at most so many."""
    low = F.transform(clean(tags), lambda t: F.lower(F.trim(t)))
    return F.slice(F.array_distinct(F.filter(low, lambda t: F.array_contains(vocabulary, t))), 1, most)


def completeness(*fields: Column) -> Column:
    """`available` if all fields hold text, `empty` if none does, else `incomplete`."""
    blank = [is_blank(f) for f in fields]
    return F.when(~reduce(lambda a, b: a | b, blank), "available").when(reduce(lambda a, b: a & b, blank), "empty").otherwise("incomplete")


def confidence(size: Column, reclustered: Column, similarity: Column, distance: Column) -> Column:
    """Confidence of a cluster from its size, whether it was refined, and its rounded metrics."""
    loose = (size >= 2) & ((distance > 0.35) | (similarity < 0.70))
    return F.when(loose, "low").when(size == 1, "high").when(size <= 4, F.when(reclustered, "medium").otherwise("high")).otherwise("low")
