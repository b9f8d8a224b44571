"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column, least: float = 1e-12) -> Column:
    """The vector over its length."""
    return F.transform(F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(least)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def softmax(scores: Column) -> Column:
    peak = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
    return F.transform(F.array(peak), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def entropy(weights: Column, least: float = 1e-12) -> Column:
    return -F.aggregate(weights, F.lit(0.0), lambda s, w: s + w * F.log(F.greatest(w, F.lit(least))))


def binary_entropy(p: Column, least: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def mass(weights: Column, k: int) -> Column:
    return F.aggregate(F.slice(weights, 1, k), F.lit(0.0), lambda s, w: s + w)
