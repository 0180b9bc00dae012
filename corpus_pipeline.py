"""A training corpus from raw documents: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources are mixed, texts are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm import line_dedup, mixing, packing, simhash, toxicity
from corpusmill.llm.common import docs_of, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, fitted on the labels, calls toxic. Null and wordless texts stay; without toxic labels all do. Rows with a null id or a repeated one are judged each by its text."""
    return toxicity.keep_clean(docs, docs_of(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document all of whose lines stand in earlier ones goes; the others keep what is theirs, and n_chars is counted anew. Null and empty texts stay. Rows equal in id and text are one document and both stay."""
    out = line_dedup.line_dedup(docs).where("n_dropped = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id. Rows equal in id and text become one; null ids and wordless texts stay."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as it has copies in the mix; sources weigh tokens ** 0.7, so that large ones lose some documents to small ones. Texts without tokens may stay or go: they have no part in budgets."""
    return mixing.mixed(docs, docs_of(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, with its id and source; null, empty and blank texts have none."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express the classifier of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each on all that the one before kept. Empty tables give an empty result; other columns of documents pass through to the last stage, whatever their names."""
    docs = docs_of(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
