"""Lexical measures of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def relative_frequencies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, n, rel_freq)."""
    counts = docs.select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("rel_freq", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def type_token_ratio(tokens: Column, variant: str = "standard") -> Column:
    """standard V/N, root V/sqrt(N), log ln V/ln N (1 for one token); null without tokens."""
    v, n = F.size(F.array_distinct(tokens)).cast("double"), F.nullif(F.size(tokens), F.lit(0)).cast("double")
    forms = {"standard": lambda: v / n, "root": lambda: v / F.sqrt(n), "log": lambda: F.when(n == 1, 1.0).otherwise(F.ln(F.nullif(v, F.lit(0.0))) / F.nullif(F.ln(n), F.lit(0.0)))}
    if variant not in forms:
        raise ValueError(f"unknown variant {variant!r}")
    return forms[variant]()


def vocabulary_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, yule_k, token_count, type_count, ttr) by a two-level aggregate: 1e4 * (sum f**2 - N) / N**2, 0 up to one token."""
    counts = docs.select(key, F.explode_outer("tokens").alias("t")).groupBy(key, "t").agg(F.count("t").alias("f"))
    per = counts.groupBy(key).agg(F.sum("f").alias("token_count"), F.count("t").alias("type_count"), F.sum(F.col("f") * F.col("f")).alias("s"))
    n = F.col("token_count").cast("double")
    k = F.when(n <= 1, 0.0).otherwise(1e4 * (F.col("s") - n) / F.nullif(n * n, F.lit(0.0)))
    return per.select(key, k.alias("yule_k"), "token_count", "type_count", F.when(n > 0, F.col("type_count") / F.nullif(n, F.lit(0.0))).alias("ttr"))


def types_in_windows(tokens: pa.ListArray, window: int) -> np.ndarray:
    """Of each list the number of distinct tokens, summed over all its windows: an occurrence counts in the windows that hold it but not the one before."""
    flat = tokens.flatten()
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.empty(0, np.int64)
    size = np.array([0 if n is None else n for n in tokens.value_lengths().to_pylist()], np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((pos, code, doc))
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1])
    before = np.full(len(doc), -1)
    before[order[same]] = pos[order[np.flatnonzero(same) - 1]]
    held = np.minimum(pos, size[doc] - window) - np.maximum(np.maximum(before + 1, pos - window + 1), 0) + 1
    return np.bincount(doc, np.maximum(held, 0), len(size))


def _mattr(window: int):
    def run(batches):
        for b in batches:
            lists = b.column(1)
            n = np.array([0 if k is None else k for k in lists.value_lengths().to_pylist()], np.int64) - window + 1
            mean = types_in_windows(lists, window) / np.maximum(n * window, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, mask=n <= 0)], names=["key", "mattr"])

    return run


def mattr(docs: DataFrame, window: int = 500, key: str = "doc_id") -> DataFrame:
    """(key, mattr): the mean type-token ratio of all windows, from the places of each token's last occurrence; null for a document shorter than it."""
    if window < 1:
        raise ValueError("window must be positive")
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), "tokens").mapInArrow(_mattr(window), f"key {kind}, mattr double").withColumnRenamed("key", key)


def rolling_average(df: DataFrame, value: str, window: int, order: list[str], by: list[str] | None = None, edges: str = "truncate", out: str = "rolling") -> DataFrame:
    """Trailing mean. truncate: rows before a full window go; pad_none: they are null; partial: they have the mean of what there is."""
    if window < 1:
        raise ValueError("window must be positive")
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    full = F.row_number().over(w) >= window
    mean = F.avg(value).over(w.rowsBetween(-(window - 1), 0))
    if edges == "partial":
        return df.withColumn(out, mean)
    if edges == "pad_none":
        return df.withColumn(out, F.when(full, mean))
    if edges != "truncate":
        raise ValueError(f"unknown edges {edges!r}")
    return df.withColumns({"__full": full, out: mean}).where("__full").drop("__full")
