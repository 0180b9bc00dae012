"""Incremental counts under Structured Streaming: additive aggregates of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import tokenized


def streaming_word_counts(docs: DataFrame, how: str = "words") -> DataFrame:
    """A stream of (text): running (token, n), for update or complete mode."""
    return tokenized(docs, how).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def streaming_windowed_counts(docs: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes", how: str = "words") -> DataFrame:
    """(window, token, n) with a watermark, for append mode: late rows beyond delay are dropped and state is bounded."""
    rows = tokenized(docs.withWatermark(time, delay), how).select(time, F.explode("tokens").alias("token"))
    return rows.groupBy(F.window(time, window), "token").agg(F.count("*").alias("n"))
