"""Vector functions as column expressions: distances, norms, normalisation, Hamming, quantisation codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l1_norm(a: Column) -> Column:
    return _sum(F.transform(_wide(a), F.abs))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; a tiny constant keeps zero vectors at 0."""
    raw = dot(a, b) / (l2_norm(a) * l2_norm(b) + F.lit(EPSILON))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def inner_product_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalize(a: Column) -> Column:
    """Scaled to length 1; vectors of (nearly) no length stay as they are."""
    n = l2_norm(a)
    return F.when(n <= EPSILON, _wide(a)).otherwise(F.transform(_wide(a), lambda x: x / n))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two longs, or between two arrays of longs."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


METRICS = {
    "euclidean": euclidean,
    "cosine": cosine_distance,
    "inner_product": inner_product_distance,
    "manhattan": manhattan,
    "squared_euclidean": squared_euclidean,
}


def distance(metric: str, a: Column, b: Column) -> Column:
    try:
        return METRICS[metric](a, b)
    except KeyError:
        raise ValueError(f"unknown metric {metric!r}: one of {sorted(METRICS)}") from None


def approx_eq(a: Column, b: Column, tolerance: float = 2.220446049250313e-16) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)
