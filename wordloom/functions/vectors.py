"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is missing or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def offset(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def gaussian_energy(mu1: Column, var1: Column, mu2: Column, var2: Column) -> Column:
    """Minus the Kullback-Leibler divergence of diagonal Gaussians."""
    parts = F.zip_with(F.arrays_zip(mu1.alias("m"), var1.alias("v")), F.arrays_zip(mu2.alias("m"), var2.alias("v")), lambda p, q: p["v"] / q["v"] + F.pow(q["m"] - p["m"], 2) / q["v"] - 1 + F.ln(q["v"]) - F.ln(p["v"]))
    return -0.5 * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int) -> Column:
    """``round`` that leaves zero its sign, as floating-point rounding does."""
    return F.when(x.cast("string").startswith("-"), -F.round(-x, digits)).otherwise(F.round(x, digits))
