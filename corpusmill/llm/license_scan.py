"""Licence scan by diagonal voting.

All windows of K words of every document, as hashes, are joined with the windows of the templates (a fixed, small table). A match at document
position p and template position t votes for the diagonal p - t. Votes are summed by diagonal, neighbouring diagonals merge (words put in or left
out shift them), and spans with enough votes are verified word by word. Only matches shuffle.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, sized, written
from .license_templates import TEMPLATES

K = 3
WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def jvm_words(text):
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def window_hashes(w: str) -> str:
    """SQL for the hashes of all windows of K words of the array w; none if it is shorter."""
    parts = ", ".join(f"get({w}, i + {j})" for j in range(K))
    return f"CASE WHEN size({w}) >= {K} THEN transform(sequence(0, size({w}) - {K}), i -> xxhash64({parts})) ELSE array() END"


def shift_of(length: int) -> int:
    """How far neighbouring diagonals of a template of so many words may lie apart."""
    return max(1, min(8, length // 8))


def similarity(window: list[str], template: list[str]) -> tuple[float, int, int]:
    """(1 - edits / template words, first, last + 1): the whole template against the part of the window that takes the fewest edits."""
    n, m = len(window), len(template)
    vocab: dict[str, int] = {}
    w = np.array([vocab.setdefault(x, len(vocab)) for x in window], np.int64)
    prev, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    index = np.arange(n + 1)
    for i, x in enumerate(template, 1):
        same = w == vocab.get(x, -1)
        take = prev[:-1] + ~same
        drop = prev[1:] + 1
        cost = np.r_[prev[0] + 1, np.minimum(take, drop)]
        start = np.r_[begin[0], np.where(take <= drop, begin[:-1], begin[1:])]
        # a word put in costs one more than the best to the left of it
        best = np.minimum.accumulate(cost - index)
        source = np.maximum.accumulate(np.where(cost - index == best, index, 0))
        prev, begin = best + index, start[source]
    end = int(np.argmin(prev))
    return 1 - float(prev[end]) / max(1, m), int(begin[end]), end


def best_spans(found: list[tuple]) -> list[tuple]:
    """Of (template, start, n_words, votes, similarity) those that no better one overlaps: the more similar, then the longer, then the first by name."""
    starts: list[int] = []
    ends: dict[int, int] = {}
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (-x[4], -x[2], x[0], x[1])):
        # what is kept doesn't overlap: only the neighbours can be in the way
        k = bisect.bisect_left(starts, x[1])
        before = k > 0 and ends[starts[k - 1]] > x[1]
        after = k < len(starts) and starts[k] < max(x[1] + x[2], x[1] + 1)
        if not before and not after:
            starts.insert(k, x[1])
            ends[x[1]] = x[1] + x[2]
            kept.append(x)
    return sorted(kept, key=lambda x: (x[1], x[0]))


def _verify(templates: dict[str, list[str]], least: float):
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, key, text, spans in pdf.itertuples(index=False):
                w, found = words(text), []
                for x in spans:
                    s, a, b = similarity(w[x["lo"] : x["hi"]], templates[x["template"]])
                    if s >= least:
                        found.append((x["template"], x["lo"] + a, b - a, x["votes"], round(s, 6)))
                rows += [(doc_id, key, *x) for x in best_spans(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "t", "template", "start", "n_words", "votes", "similarity"]).astype({"doc_id": "Int64"})

    return run


def license_scan(docs: DataFrame, *, templates: dict[str, str] | None = None, least_votes: float = 0.3, least_similarity: float = 0.8) -> DataFrame:
    """(doc_id, license, template, start, n_words, votes, similarity): every span of a document that agrees with a template.

    Words are runs of a-z and 0-9 of the lower-case text, start counts them. A span needs votes from least_votes of the template's windows,
    and at most 1 - least_similarity edits a template word. Where spans overlap, the more similar stays, then the longer, then the first by name.
    Null and short texts have no spans. Rows equal in doc_id and text are reported once; a null doc_id is reported as null.
    Long texts are scanned whole. Templates under K words are an error. Other columns are ignored.
    """
    spark = docs.sparkSession
    of = {k: words(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    if short := [k for k, w in of.items() if len(w) < K]:
        raise ValueError(f"templates need {K} words: {short}")
    t = spark.createDataFrame([(k, w, len(w), shift_of(len(w))) for k, w in of.items()], "template string, w array<string>, n int, shift int")
    places = t.select("template", F.posexplode(F.expr(window_hashes("w"))).alias("tpos", "h"))
    doc = docs.select("doc_id", F.xxhash64("text").alias("t"), jvm_words(F.col("text")).alias("w"))
    # outer: else a filter on the size of the array is inferred and pushed to the scan, where w is computed again for each window; the join drops nulls
    grams = doc.select("doc_id", "t", F.posexplode_outer(F.expr(window_hashes("w"))).alias("pos", "h"))
    # templates don't grow with the documents; a caller's large set is joined by shuffle
    small_enough = F.broadcast if sum(len(w) for w in of.values()) <= BROADCAST_ROWS else (lambda df: df)
    hits = grams.join(small_enough(places), "h").select("doc_id", "t", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos")
    votes = hits.groupBy("doc_id", "t", "template", "diagonal").agg(F.count_distinct("tpos").alias("votes"))
    small = small_enough(t.select("template", "n", "shift"))
    by = Window.partitionBy("doc_id", "t", "template").orderBy("diagonal")
    merged = (
        votes.join(small, "template")
        .withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(1 << 30)) > F.col("shift")).cast("int"))
        .withColumn("run", F.sum("new").over(by))
        .groupBy("doc_id", "t", "template", "n", "shift", "run")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
        .where(F.col("votes") >= F.greatest(F.lit(1), F.ceil(least_votes * (F.col("n") - K + 1))))
    )
    span = F.struct("template", "votes", F.greatest(F.col("low") - F.col("shift"), F.lit(0)).cast("int").alias("lo"), (F.col("high") + F.col("n") + F.col("shift")).cast("int").alias("hi"))
    spans = written(merged.groupBy("doc_id", "t").agg(F.collect_list(span).alias("spans")), "spans")
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), "text")
    found = texts.join(sized(spans), (F.col("x") == F.col("t")) & F.col("d").eqNullSafe(F.col("doc_id")))
    schema = "doc_id bigint, t bigint, template string, start bigint, n_words bigint, votes bigint, similarity double"
    checked = found.select("doc_id", "t", "text", "spans").mapInPandas(_verify(of, least_similarity), schema)
    return checked.dropDuplicates().select("doc_id", F.split_part("template", F.lit("/"), F.lit(1)).alias("license"), "template", "start", "n_words", "votes", "similarity")
