"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; within a source, the smallest keys come first.
A source's budget is met by complete epochs, then by the longest run of first keys whose tokens fit the rest. The prefix sum
needs no sort of a whole source: tokens are summed by (source, slice of keys), and only the slice in which the
budget ends is sorted, so one hot source is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import sized, tokens, written

SLICES = 1 << 14


def keyed(docs: DataFrame, labels: DataFrame, seed: int, good: float, bad: float, other: float) -> DataFrame:
    quality = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__q")).withColumnRenamed("doc_id", "__id")
    weight = F.when(F.col("__q") > 0, good).when(F.col("__q") <= 0, bad).otherwise(other)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return docs.join(quality, F.col("doc_id") == F.col("__id"), "left").withColumn("__key", -F.log(u) / weight).drop("__q", "__id")


def mix(docs: DataFrame, labels: DataFrame, *, target: dict[str, float] | None = None, power: float = 0.7, budget_tokens: int | None = None, seed: int = 11, good: float = 2.0, bad: float = 0.5, other: float = 1.0) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document enters the mix, for those that do.

    target: weight of each source (others get none); None: tokens ** power. budget_tokens: None for all tokens there are. Tokens are words
    between blanks; null or blank text has none. Quality weights: label 1 good, 0 bad, none other. Rows that agree in
    (key, doc_id, n_tokens) enter together or not at all. A null source is a source; null doc_ids share one key. Columns of docs with
    the names of the result are read as what they are named; others are ignored. Sources without tokens get no copies.
    """
    narrow = docs.select("doc_id", "source", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))
    table = written(keyed(narrow, labels, seed, good, bad, other), "keys")
    return table.transform(copies_of, target, power, budget_tokens).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def copies_of(table: DataFrame, target: dict[str, float] | None, power: float, budget_tokens: int | None) -> DataFrame:
    """The written table (doc_id, source, n_tokens, __key, ...) with copies."""
    spark = table.sparkSession
    slices = table.withColumn("__slice", F.floor((1 - F.exp(-F.col("__key"))) * SLICES))
    sums = written(slices.groupBy("source", "__slice").agg(F.sum("n_tokens").alias("n")), "slices")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("have")).where("have > 0")
    if target is None:
        wanted = by_source.withColumn("w", F.pow(F.col("have").cast("double"), F.lit(power)))
    else:
        w = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "source string, w double")
        wanted = by_source.join(w, "source", "left").fillna(0.0, ["w"])
    total = wanted.agg(F.sum("w").alias("w"), F.sum("have").alias("have")).first()
    if not total["w"]:
        return table.withColumn("copies", F.lit(0).cast("long"))
    budget = F.floor(F.lit(float(total["have"] if budget_tokens is None else budget_tokens)) * F.col("w") / F.lit(float(total["w"])))
    need = wanted.withColumn("b", budget).select("source", F.expr("b div have").alias("epochs"), F.expr("b % have").alias("rest"))
    s = sums.withColumnRenamed("source", "__s")
    ends = (
        s.withColumn("upto", F.sum("n").over(Window.partitionBy("__s").orderBy("__slice")))
        .join(need, F.col("__s").eqNullSafe(F.col("source")))
        .where("upto > rest")
        .groupBy("source", "epochs", "rest")
        .agg(F.min(F.struct("__slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
        .select(F.col("source").alias("__s"), "epochs", "rest", F.col("e.__slice").alias("__end"), "e.before")
    )
    ends = written(ends, "ends")
    last = (
        slices.join(sized(ends), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__end")))
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("__key", "doc_id", "n_tokens")))
        .where("upto <= rest")
        .groupBy("__s")
        .agg(F.max(F.struct("__key", "doc_id", "n_tokens")).alias("__last"))
        .withColumnRenamed("__s", "__s2")
    )
    cut = written(ends.join(last, F.col("__s").eqNullSafe(F.col("__s2")), "left").drop("__s2", "rest", "before"), "cuts")
    inside = (F.col("__slice") < F.col("__end")) | ((F.col("__slice") == F.col("__end")) & F.col("__last").isNotNull() & (F.struct("__key", "doc_id", "n_tokens") <= F.col("__last")))
    out = slices.join(sized(cut), F.col("source").eqNullSafe(F.col("__s")), "left")
    return out.withColumn("copies", F.coalesce(F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("long"), F.lit(0)).cast("long")).drop("__slice", "__s", "__end", "__last", "epochs")


def sql(docs: str = "documents", power: float = 0.7, seed: int = 11, good: float = 2.0, bad: float = 0.5, other: float = 1.0) -> str:
    return rf"""
WITH t AS (
  SELECT d.doc_id, d.source, CAST(len(regexp_extract_all(coalesce(d.text, ''), '[^ \t\n\r\f]+')) AS BIGINT) AS n_tokens,
         -ln((CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
           / CASE WHEN l.q > 0 THEN {good} WHEN l.q <= 0 THEN {bad} ELSE {other} END AS k
  FROM {docs} d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS have FROM t GROUP BY source HAVING sum(n_tokens) > 0),
b AS (SELECT source, have, CAST(floor(CAST(sum(have) OVER () AS DOUBLE) * pow(have, {power}) / sum(pow(have, {power})) OVER ()) AS BIGINT) AS b FROM s),
c AS (
  SELECT t.*, b.b // b.have AS epochs, b.b % b.have AS rest, CAST(sum(t.n_tokens) OVER (PARTITION BY t.source ORDER BY k, t.doc_id, t.n_tokens) AS BIGINT) AS upto
  FROM t JOIN b ON t.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs in the mix that mix() defines, each row as many times as it has copies, with its columns as they are."""
    chosen = written(mix(docs, labels, **how).distinct(), "mix").toDF("__id", "__source", "__n", "__copies")
    n = F.size(tokens(F.col("text"))).cast("long")
    rows = docs.join(sized(chosen), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (n == F.col("__n")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
