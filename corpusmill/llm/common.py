"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.shared import remove, shared_dir, written

__all__ = ["BLANK", "BROADCAST_ROWS", "docs_of", "remove", "shared_dir", "sized", "tokens", "written"]

BLANK = "[ \\t\\n\\r\\f]+"
#: A table of at most this many rows (of a few numbers each) may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 250_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, with a broadcast hint only if it is small; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= most else df


def docs_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokens(text):
    """Words between blanks; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
