"""Numbers and running sums over a whole order without one partition that holds it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .shared import written


def ranged(df: DataFrame, by: list) -> DataFrame:
    """df as a written table with __part: ranges of the order, whose numbers ascend with it. Rows that are equal in it share a range."""
    return written(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")


def running_sum(df: DataFrame, order: list[str], value: str | None = None, keys: list[str] = [], out: str = "before") -> DataFrame:  # noqa: B006
    """df with out: the sum of value (of ones if None) over the rows before it, in order, within keys. Nulls come first; equal rows count in any order.

    A range is ordered in its own task; what ranges add up to is a table of as many rows as there are ranges and keys.
    """
    rows = ranged(df, [*keys, *order])
    one = F.lit(1).cast("long") if value is None else F.col(value)
    sums = rows.groupBy(*keys, "__part").agg(F.sum(one).alias("__sum"))
    upto = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.withColumn("__base", F.coalesce(upto, F.lit(0))).drop("__sum")
    mine = F.sum(one).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    base = base.select(F.col("__part").alias("__p"), "__base", *[F.col(k).alias(f"__k_{k}") for k in keys])
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = rows.withColumn("__mine", F.coalesce(mine, F.lit(0))).join(base, same)
    return joined.withColumn(out, F.col("__base") + F.col("__mine")).drop("__part", "__p", "__base", "__mine", *[f"__k_{k}" for k in keys])
