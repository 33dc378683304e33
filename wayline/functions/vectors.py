"""Distances of vectors held as arrays, computed in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; two zero vectors have 1, one gives 0."""
    na, nb = norm(a), norm(b)
    inner = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(inner)


def distance(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6, eps: float = 1e-12) -> Column:
    """(norm_a, norm_b, diff, relative, largest, cosine, equal, close). ``relative`` divides by the mean of the norms,
    ``close`` allows atol + rtol * |b| for each component, relative to the second vector."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)
    diff = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    na, nb = norm(a), norm(b)
    return F.struct(
        na.alias("norm_a"), nb.alias("norm_b"), diff.alias("diff"), (diff / F.greatest((na + nb) / 2, F.lit(eps))).alias("relative"),
        F.array_max(F.transform(d, F.abs)).alias("largest"), cosine(a, b).alias("cosine"), (a == b).alias("equal"),
        F.forall(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok).alias("close"),
    )


def mean_difference(rows: DataFrame, by: Sequence[str], vector: str, positive: Column) -> DataFrame:
    """(by, norm, n_dims): the norm of the difference of the two classes' means, by sums for each dimension."""
    cells = rows.select(*by, positive.alias("_p"), F.posexplode(doubles(F.col(vector))).alias("_d", "_x"))
    dims = cells.groupBy(*by, "_d").agg((F.avg(F.when(F.col("_p"), F.col("_x"))) - F.avg(F.when(~F.col("_p"), F.col("_x")))).alias("m"))
    return dims.groupBy(*by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"), F.count("*").alias("n_dims"))
