"""Column expressions over array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TINY = 1e-10


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    n = norm(a) * norm(b)
    return F.when((norm(a) < TINY) | (norm(b) < TINY), 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def _gaps(a: Column, b: Column, f) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double"))))


def manhattan(a: Column, b: Column) -> Column:
    return _gaps(a, b, F.abs)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_gaps(a, b, lambda x: x * x))


def burrows_delta(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(manhattan(a, b) / F.nullif(F.size(a), F.lit(0)))


def eder_delta(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(_gaps(a, b, lambda x: x * x) / F.nullif(F.size(a), F.lit(0))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


DISTANCES = {"cosine": cosine_distance, "burrows_delta": burrows_delta, "manhattan": manhattan, "euclidean": euclidean, "eder_delta": eder_delta}


def distance_to_similarity(d: Column, metric: str) -> Column:
    return 1 - d if metric == "cosine" else 1 / (1 + d)


def distribution_similarity(a: Column, b: Column, metric: str = "jsd") -> Column:
    """jsd (natural log, 1 - divergence), hellinger (1 - distance), cosine, kl (1 / (1 + divergence))."""
    eps = 1e-10
    p, q = (F.transform(x, lambda v: v.cast("double") + eps) for x in (a, b))
    if metric == "cosine":
        return cosine_similarity(a, b)
    if metric == "hellinger":
        return 1 - F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), 2)))) / F.sqrt(F.lit(2.0))
    kl = lambda x, y: _sum(F.zip_with(x, y, lambda u, v: u * F.ln(u / v)))
    if metric == "kl":
        return 1 / (1 + kl(p, q))
    if metric != "jsd":
        raise ValueError(f"unknown metric {metric!r}")
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return 1 - (kl(p, m) + kl(q, m)) / 2
