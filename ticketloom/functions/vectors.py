"""Vector expressions over array columns; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def population_std(v: Column) -> Column:
    """Over the components, in two passes; 0 counts as 1."""
    x = doubles(v)
    mean = _sum(x) / F.size(x)
    s = F.sqrt(_sum(F.transform(F.arrays_zip(x.alias("x"), F.array_repeat(mean, F.size(x)).alias("m")), lambda p: (p["x"] - p["m"]) * (p["x"] - p["m"]))) / F.size(x))
    return F.when(s == 0, 1.0).otherwise(s)


def kmeans_confidence(point: Column, centroid: Column) -> Column:
    """exp(-distance / spread of the point), within 0 and 1; 0.5 where it can't be computed."""
    c = F.exp(-euclidean(point, centroid) / population_std(point))
    return F.when(c.isNull() | F.isnan(c), 0.5).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
