"""Vector and hash functions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """The unit vector; an all-zero one stays as it is."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for null or all-zero vectors."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(a: Column, bits: int = 64) -> Column:
    """The signs of the first components as bits of a long, at most 64 of them, the first one highest."""
    picked = F.slice(a, 1, bits)
    return F.aggregate(picked, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def gradient_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Difference hash of a row-major grey image: one bit per pixel that is brighter than its right neighbour."""
    at = F.array(*[F.lit(r * width + c) for r in range(height) for c in range(width - 1)])
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 1).bitwiseOR(F.when(F.get(pixels, i) > F.get(pixels, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")))


def red(colour: Column, low: int = 180, high: int = 90) -> Column:
    """Whether a 24-bit colour is red: much red, little green and blue."""
    part = lambda n: F.shiftright(colour, n).bitwiseAND(F.lit(255))
    return (part(16) >= low) & (part(8) <= high) & (part(0) <= high)
