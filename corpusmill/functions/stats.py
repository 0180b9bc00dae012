"""Statistics of 2x2 tables [[a, b], [c, d]] and corrections of p-values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def expected(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = a + b + c + d
    return F.when(n == 0, 0.0).otherwise((a + b).cast("double") * (a + c) / F.nullif(n, F.lit(0)))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, 0 where y is 0."""
    return F.when(y == 0, 0.0).otherwise(x / F.nullif(y, F.lit(0.0)))


def chi2_stat(a: Column, b: Column, c: Column, d: Column, yates: bool = False) -> Column:
    """Pearson's statistic; NaN if a margin is 0."""
    o = [x.cast("double") for x in (a, b, c, d)]
    n = o[0] + o[1] + o[2] + o[3]
    rows, cols = (o[0] + o[1], o[2] + o[3]), (o[0] + o[2], o[1] + o[3])
    total = F.lit(0.0)
    for k, x in enumerate(o):
        e = rows[k // 2] * cols[k % 2] / F.nullif(n, F.lit(0.0))
        gap = F.abs(x - e)
        gap = F.greatest(gap - 0.5, F.lit(0.0)) if yates else gap
        total = total + gap * gap / F.nullif(e, F.lit(0.0))
    return F.coalesce(total, F.lit(float("nan")))


def g2_stat(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Log-likelihood ratio; empty cells add nothing; NaN for an empty table."""
    o = [x.cast("double") for x in (a, b, c, d)]
    n = o[0] + o[1] + o[2] + o[3]
    rows, cols = (o[0] + o[1], o[2] + o[3]), (o[0] + o[2], o[1] + o[3])
    total = F.lit(0.0)
    for k, x in enumerate(o):
        e = rows[k // 2] * cols[k % 2] / F.nullif(n, F.lit(0.0))
        total = total + F.when(x > 0, x * F.ln(F.nullif(x, F.lit(0.0)) / F.nullif(e, F.lit(0.0)))).otherwise(0.0)
    return F.when(n == 0, float("nan")).otherwise(2 * total)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: Stirling's series after a shift by 8."""
    x = np.asarray(x, float)
    low = np.log(x) + sum(np.log(x + k) for k in range(1, 8))
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low


ALTERNATIVES = ("two-sided", "greater", "less")


def fisher_tests(tables: np.ndarray, alternative: str = "two-sided", cells: int = 1 << 20) -> np.ndarray:
    """Fisher's exact test of the rows (a, b, c, d), all at once. Terms beyond 40 standard deviations of the mean and of a are below any double and are left out."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative!r}")
    tables = np.asarray(tables, np.int64).reshape(-1, 4)
    if (tables < 0).any():
        raise ValueError("cells must not be negative")
    a, b, c, d = tables.T
    n, r, k = tables.sum(1), a + b, a + c
    size = np.maximum(n, 1).astype(float)
    mean = r * (k / size)
    sd = np.sqrt(np.maximum(1e-9, mean * ((n - r) / size) * ((n - k) / np.maximum(1, n - 1))))
    first = np.maximum(np.maximum(0, r + k - n), np.minimum(a, mean - 40 * sd).astype(np.int64) - 10)
    last = np.minimum(np.minimum(r, k), np.maximum(a, mean + 40 * sd).astype(np.int64) + 10)
    if alternative == "greater":
        first = a
    elif alternative == "less":
        last = a
    const = log_gamma(r + 1) + log_gamma(n - r + 1) + log_gamma(k + 1) + log_gamma(n - k + 1) - log_gamma(n + 1)

    def logs(x: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        return const[at] - log_gamma(x + 1) - log_gamma(r[at] - x + 1) - log_gamma(k[at] - x + 1) - log_gamma((n - r - k)[at] + x + 1)

    own, many = logs(a, slice(None)), last - first + 1
    out, upto, lo = np.ones(len(tables)), np.cumsum(many), 0
    while lo < len(tables):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + cells, side="right")))
        m = many[lo:hi]
        at = np.repeat(np.arange(lo, hi), m)
        x = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        lp = logs(x, at)
        if alternative == "two-sided":
            lp = np.where(lp <= own[at] + 1e-8, lp, -np.inf)
        out[lo:hi] = np.bincount(at - lo, np.exp(lp), hi - lo)
        lo = hi
    return np.where(n == 0, 1.0, np.clip(out, 0.0, 1.0))


def fisher_p(a: int, b: int, c: int, d: int, alternative: str = "two-sided") -> float:
    return float(fisher_tests(np.array([[a, b, c, d]]), alternative)[0])


def fisher_udf(alternative: str = "two-sided"):
    """A column function of (a, b, c, d). Not deterministic for the optimizer, so that a filter on it doesn't run it twice: filter on counts before."""

    @F.arrow_udf("double")
    def p(cells: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in cells:
            null = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in batch], axis=0)
            tables = np.stack([x.fill_null(0).to_numpy(zero_copy_only=False) for x in batch], axis=1).astype(np.int64)
            each, at = np.unique(tables, axis=0, return_inverse=True)
            yield pa.array(fisher_tests(each, alternative)[at.reshape(-1)], mask=null)

    return p.asNondeterministic()


def chi2_p_udf():
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(x / 2))."""

    @F.arrow_udf("double")
    def p(stats: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import math

        for x in stats:
            yield pa.array([None if v is None else v if v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x.to_pylist()], pa.float64())

    return p.asNondeterministic()


def correct(df: DataFrame, method: str, p: str = "p_value", out: str = "adjusted_p_value") -> DataFrame:
    """Bonferroni or Benjamini-Hochberg ("fdr_bh") over all rows of df. Ranks come from ranges of the order: no task holds all rows."""
    from ..plans.order import running_sum
    from ..plans.shared import written

    if method not in ("bonferroni", "fdr_bh"):
        raise ValueError(f"unknown correction {method!r}")
    rows = written(df, "tests")
    n = rows.count()
    if method == "bonferroni":
        return rows.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    ranks = running_sum(rows, [p], out="__before").withColumn("__q", F.col(p) * n / (F.col("__before") + 1))
    # the least quotient from a row on: within ranges of p, then over the ranges after it
    q = written(ranks.repartitionByRange(p).withColumn("__part", F.spark_partition_id()), "quotients")
    least = q.groupBy("__part").agg(F.min("__q").alias("__least"))
    later = least.select(F.col("__part").alias("__p"), F.min("__least").over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))  # a row a range
    mine = F.min("__q").over(Window.partitionBy("__part").orderBy("__before").rowsBetween(0, Window.unboundedFollowing))
    joined = q.withColumn("__mine", mine).join(F.broadcast(later), F.col("__part") == F.col("__p"))
    return joined.withColumn(out, F.least(F.lit(1.0), "__mine", "__later")).drop("__before", "__q", "__part", "__p", "__later", "__mine")


def check_options(given: dict | None, known: set[str]) -> dict:
    if given is None:
        return {}
    if not isinstance(given, dict):
        raise TypeError("filters must be a dict")
    if unknown := set(given) - known:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    return given
