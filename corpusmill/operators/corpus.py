"""Vocabularies, counts and filters of tokenized corpora: DataFrames with tokens ARRAY<STRING>."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..plans.order import running_sum


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n, doc_freq): how often a token occurs and in how many documents. Both counts combine on the map side."""
    return word_counts(docs).join(doc_freq(docs), "token")


def word_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def doc_freq(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("doc_freq"))


def n_texts(docs: DataFrame) -> int:
    """Documents with a token. An empty corpus and one of empty documents are different errors."""
    r = docs.agg(F.count("*").alias("n"), F.count_if(F.size("tokens") > 0).alias("full")).first()
    if not r["n"]:
        raise ValueError("input cannot be empty")
    if not r["full"]:
        raise ValueError("all input texts are empty")
    return r["full"]


def most_frequent(docs: DataFrame, n: int) -> DataFrame:
    """The n most frequent tokens; equal counts by token."""
    return word_counts(docs).orderBy(F.desc("n"), "token").limit(n)


def limited_vocabulary(docs: DataFrame, min_word_count: int = 1, min_doc_count: int = 1, max_vocab_size: int | None = None, vocab: Iterable[str] | None = None) -> DataFrame:
    """(token, n, doc_freq) of the words that pass; an explicit vocab is kept whole, with 0 for words that don't occur."""
    v = word_counts(docs).join(doc_freq(docs), "token")
    if vocab is not None:
        own = docs.sparkSession.createDataFrame([(w,) for w in sorted(set(vocab))], "token string")
        return own.join(v, "token", "left").fillna(0, ["n", "doc_freq"])
    v = v.where((F.col("n") >= min_word_count) & (F.col("doc_freq") >= min_doc_count))
    return v.orderBy(F.desc("n"), "token").limit(max_vocab_size) if max_vocab_size else v


def without(df: DataFrame, words: Iterable[str] | DataFrame, column: str = "token") -> DataFrame:
    """Rows whose word isn't a stopword: an anti join, broadcast where the planner finds it small."""
    if not isinstance(words, DataFrame):
        words = df.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return df.join(words.toDF("__stop"), F.col(column) == F.col("__stop"), "left_anti")


def balanced(docs: DataFrame, period: str = "period", order: str = "doc_id", how: str = "balanced", share: float = 1.0) -> DataFrame:
    """Periods cut to a budget of tokens, in document order; the last document that fits in part is cut. balanced: share of the smallest period's tokens for
    each; proportional: share of its own. A period is ordered in ranges, so that a long one is no single task."""
    if how not in ("balanced", "proportional") or not 0 < share <= 1:
        raise ValueError("how is balanced or proportional, share in (0, 1]")
    sized = docs.withColumn("__n", F.size("tokens").cast("long"))
    totals = sized.groupBy(period).agg(F.sum("__n").alias("__budget"))
    if how == "balanced":
        totals = totals.withColumn("__budget", F.lit(totals.agg(F.min("__budget")).first()[0] or 0))
    budget = totals.select(F.col(period).alias("__period"), F.floor(F.col("__budget") * share).alias("__budget"))
    before = running_sum(sized, [order], "__n", [period], "__before").join(budget, F.col(period).eqNullSafe(F.col("__period"))).drop("__period")
    out = before.withColumn("__left", F.col("__budget") - F.col("__before")).where("__left > 0")
    return out.withColumn("tokens", F.slice("tokens", 1, F.least("__left", F.greatest("__n", F.lit(1))).cast("int"))).drop("__n", "__left", "__budget", "__before")
