"""Array and geometry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def standard(x: Column) -> Column:
    """An array centred and scaled to length one; a constant array becomes zeros. Mean and length are arguments, not parts of a lambda, so each is computed once."""
    values = F.transform(x, lambda v: v.cast("double"))
    centred = F.zip_with(values, F.array_repeat(total(values) / F.size(x), F.size(x)), lambda v, m: v - m)
    length = F.sqrt(total(F.transform(centred, lambda v: v * v)))
    return F.zip_with(centred, F.array_repeat(length, F.size(x)), lambda v, n: F.when(n > 1e-12, v / n).otherwise(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; equal constant arrays have 1, other pairs with a constant array 0."""
    r = dot(standard(a), standard(b))
    return F.round(F.when(a == b, 1.0).otherwise(r), 6)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere of radius 6,371,008.8 m."""
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def interpolated(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    """The whole part of the line through (t0, v0) and (t1, v1) at t; v0 where the points are one."""
    return F.when(t1 == t0, v0).otherwise((v0 + (v1 - v0) * (t - t0) / (t1 - t0)).cast("int")).cast("int")


def complex_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Complex numbers are two columns: the real and the imaginary part."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def complex_quotient(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Null where the divisor is zero."""
    size = F.nullif(b[0] * b[0] + b[1] * b[1], F.lit(0.0))
    re, im = complex_product(a, (b[0], -b[1]))
    return re / size, im / size


def projection(rows: int, columns: int, seed: int, signs: bool = False) -> list[list[float]]:
    """A random matrix from the hash family: signs, or sums of six uniform numbers less three (about normal, variance a half)."""
    from tidemark.functions.hashing import PRIME, coefficients

    a = coefficients(6, seed)
    value = (lambda k: float((a[0][0] * k + a[0][1]) % PRIME % 2 * 2 - 1)) if signs else (lambda k: round(sum((p * (k + 1) + q) % PRIME for p, q in a) / PRIME - 3, 6))
    return [[value(r * columns + c) for c in range(columns)] for r in range(rows)]


def projected(x: Column, matrix: list[list[float]]) -> Column:
    """One number for each row of the matrix."""
    return F.array(*[dot(x, F.expr("array(" + ", ".join(f"{v!r}D" for v in row) + ")")) for row in matrix])


def ranks(x: Column) -> Column:
    """Ranks from 1, the mean rank for ties."""
    return F.transform(x, lambda v: F.size(F.filter(x, lambda y: y < v)) + (F.size(F.filter(x, lambda y: y == v)) + 1) / 2)


def spearman(a: Column, b: Column) -> Column:
    """Rank correlation of two short arrays, with the rule for constants of pearson."""
    return pearson(ranks(a), ranks(b))
