"""Packing by power-of-two decomposition: no sequence crosses documents, and sequences of a bucket have one length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import tokens


def pack(docs: DataFrame, max_power: int = 13) -> DataFrame:
    """(doc_id, source, start, length, bucket, text): the pieces of each document, whose lengths are the powers of two in its token count.

    Tokens are words between blanks. A document of n tokens gives n // 2**max_power pieces of the greatest length, then one for each bit of
    the rest, longest first; start counts tokens. All tokens are in exactly one piece, in order. bucket is log2(length). Null, empty
    and blank texts give no piece. Repeated rows give repeated pieces. No shuffle: pieces of a document are made from its row alone.
    """
    bits = F.expr(f"transform(filter(sequence({max_power - 1}, 0, -1), j -> (shiftright(n, j) & 1) = 1), j -> struct(cast(shiftleft(shiftright(n, j + 1), j + 1) AS bigint) AS start, j AS bucket))")
    whole = F.expr(f"transform(filter(sequence(0, cast(n div {1 << max_power} AS int)), i -> i < n div {1 << max_power}), i -> struct(cast(i AS bigint) * {1 << max_power} AS start, {max_power} AS bucket))")
    out = docs.select("doc_id", "source", tokens(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    pieces = F.concat(whole, bits)
    cut = F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["bucket"].alias("bucket"), F.array_join(F.slice("t", p["start"].cast("int") + 1, F.call_function("shiftleft", F.lit(1), p["bucket"])), " ").alias("text")))
    # outer: else a filter on the array's size is inferred and pushed to the scan, where tokens are made anew for each piece
    return out.select("doc_id", "source", F.explode_outer(cut).alias("p")).where("p IS NOT NULL").select("doc_id", "source", "p.start", F.expr("cast(shiftleft(1, p.bucket) AS bigint)").alias("length"), "p.bucket", "p.text")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, from which batches of one shape can be read."""
    pieces.write.partitionBy("bucket").parquet(path)


def sql(docs: str = "documents", max_power: int = 13) -> str:
    size = 1 << max_power
    return rf"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+') AS w FROM {docs}),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM t),
p AS (
  SELECT doc_id, source, w, unnest(range(n // {size})) * {size} AS start, {max_power} AS bucket FROM n
  UNION ALL
  SELECT doc_id, source, w, ((n >> (j + 1)) << (j + 1)) AS start, j AS bucket FROM n, (SELECT unnest(range({max_power})) AS j) WHERE (n >> j) & 1 = 1)
SELECT doc_id, source, CAST(start AS BIGINT) AS start, CAST(1 << bucket AS BIGINT) AS length, CAST(bucket AS INTEGER) AS bucket,
       array_to_string(w[start + 1 : start + (1 << bucket)], ' ') AS text FROM p"""
