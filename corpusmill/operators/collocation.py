"""Collocates, concordances and their comparison."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import check_options, correct, expected, fisher_udf, safe_ratio
from ..functions.tokens import truncated
from ..plans.order import running_sum
from ..plans.shared import written
from .pairs import pieces

FILTERS = {"stopwords", "min_word_length", "max_p", "max_adjusted_p"} | {f"{m}_{c}" for m in ("min", "max") for c in ("obs_local", "obs_global", "exp_local", "ratio_local")}
BOTH = {"stopwords", "min_word_length", "max_p"}


def sides(horizon: int | tuple[int, int]) -> tuple[int, int]:
    left, right = (horizon, horizon) if isinstance(horizon, int) else horizon
    if left < 0 or right < 0 or left + right == 0:
        raise ValueError("horizon must reach somewhere")
    return left, right


def _targets(targets: str | Iterable[str]) -> list[str]:
    out = sorted({targets} if isinstance(targets, str) else set(targets))
    if not out:
        raise ValueError("targets cannot be empty")
    return out


def window_hits(corpus: DataFrame, names: list[str], left: int, right: int) -> DataFrame:
    """(target, w, n): the places of each word that see the target; with a null target all places of the word."""

    def run(batches):
        for batch in batches:
            for b, size in pieces(batch):
                d = b.column(0).flatten().dictionary_encode()
                words, k = d.dictionary, len(d.dictionary)
                at = d.indices.fill_null(k).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(size)), size)
                place = pa.compute.index_in(pa.array(names, pa.string()), words).to_pylist()
                for name, own in [(None, None), *((t, p) for t, p in zip(names, place) if p is not None)]:
                    if name is None:
                        n = np.bincount(at, minlength=k + 1)
                    else:
                        it, seen = at == own, np.zeros(len(at), bool)
                        for j in range(1, min(max(left, right), len(at) - 1) + 1):
                            same = row[j:] == row[:-j]
                            if j <= left:
                                seen[:-j] |= it[j:] & same
                            if j <= right:
                                seen[j:] |= it[:-j] & same
                        n = np.bincount(at[seen & ~it & (at < k)], minlength=k + 1)
                    have = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(have), pa.string()), words.take(pa.array(have, mask=have == k)), pa.array(n[have])], names=["target", "w", "n"])

    return corpus.mapInArrow(run, "target string, w string, n bigint").groupBy("target", "w").agg(F.sum("n").alias("n"))


def contingency(docs: DataFrame, targets: str | Iterable[str], method: str = "window", horizon: int | tuple[int, int] = 5, max_length: int | None = 256) -> DataFrame:
    """(target, collocate, a, b, c, d). Hits are found in each document's array: the only shuffles are of counts.

    window: places of the collocate that see the target, against all places not of the target. sentence: documents that hold both, against all.
    """
    names = _targets(targets)
    corpus = docs.select(truncated(F.col("tokens"), max_length).alias("tokens")).where(F.size("tokens") > 0)
    each = F.explode(F.array(*map(F.lit, names))).alias("target")
    held = corpus.where(F.arrays_overlap("tokens", F.array(*map(F.lit, names)))).select("tokens", each).where(F.array_contains("tokens", F.col("target")))
    if method == "window":
        # one pass over the texts, whose sums are read more than once
        found = written(window_hits(corpus, names, *sides(horizon)), "hits")
        hits, counts = found.where("target IS NOT NULL"), found.where("target IS NULL").select("w", "n")
        pairs = hits.select("target", F.col("w").alias("collocate"), F.col("n").alias("a"))
    elif method == "sentence":
        hits = held.select("target", F.explode(F.array_distinct("tokens")).alias("collocate")).where("target <> collocate")
        counts = corpus.select(F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    else:
        raise ValueError(f"unknown method {method!r}")
    if method == "sentence":
        pairs = hits.groupBy("target", "collocate").agg(F.count("*").alias("a"))
    # the totals of a few targets: tables of as many rows as there are targets
    t = counts.where(F.col("w").isin(names)).select(F.col("w").alias("target"), F.col("n").alias("n_target"))
    if method == "window":
        seen = pairs.groupBy("target").agg(F.sum("a").alias("seen"))
        total = counts.agg(F.sum("n").alias("total"))
        rows = pairs.join(counts, F.col("collocate") == F.col("w")).join(F.broadcast(t), "target").join(F.broadcast(seen), "target").crossJoin(F.broadcast(total))
        rest = F.col("total") - F.col("n_target") - F.col("seen") - F.col("n") + F.col("a")
        return rows.select("target", "collocate", "a", (F.col("seen") - F.col("a")).alias("b"), (F.col("n") - F.col("a")).alias("c"), rest.alias("d"))
    total = corpus.agg(F.count("*").alias("total"))
    rows = pairs.join(counts, F.col("collocate") == F.col("w")).join(F.broadcast(t), "target").crossJoin(F.broadcast(total))
    rest = F.col("total") - F.col("n_target") - F.col("n") + F.col("a")
    return rows.select("target", "collocate", "a", (F.col("n_target") - F.col("a")).alias("b"), (F.col("n") - F.col("a")).alias("c"), rest.alias("d"))


def find_collocates(docs: DataFrame, targets: str | Iterable[str], *, method: str = "window", horizon: int | tuple[int, int] = 5, filters: dict | None = None, correction: str | None = None, alternative: str = "greater", max_length: int | None = 256, sort_by: str = "obs_local", ascending: bool = False) -> DataFrame:
    """(target, collocate, exp_local, obs_local, ratio_local, obs_global, p_value[, adjusted_p_value]); horizon is relative to the target.

    Count filters run before the test, max_p after it, the correction over what is left, max_adjusted_p last.
    """
    f = check_options(filters, FILTERS)
    if "max_adjusted_p" in f and not correction:
        raise ValueError("max_adjusted_p needs a correction")
    cells = [F.col(x) for x in "abcd"]
    out = contingency(docs, targets, method, horizon, max_length).withColumn("exp_local", expected(*cells)).withColumn("ratio_local", safe_ratio(F.col("a"), F.col("exp_local")))
    out = out.withColumns({"obs_local": F.col("a"), "obs_global": F.col("a") + F.col("c")})
    if f.get("stopwords"):
        out = out.where(~F.col("collocate").isin(sorted(f["stopwords"])))
    if f.get("min_word_length"):
        out = out.where(F.char_length("collocate") >= f["min_word_length"])
    for key, value in f.items():
        side, _, column = key.partition("_")
        if side in ("min", "max") and column in ("obs_local", "obs_global", "exp_local", "ratio_local"):
            out = out.where(F.col(column) >= value if side == "min" else F.col(column) <= value)
    out = out.withColumn("p_value", fisher_udf(alternative)(*cells))
    if "max_p" in f:
        out = out.where(F.col("p_value") <= f["max_p"])
    columns = ["target", "collocate", "exp_local", "obs_local", "ratio_local", "obs_global", "p_value"]
    if correction:
        out, columns = correct(out, correction), [*columns, "adjusted_p_value"]
        if "max_adjusted_p" in f:
            out = out.where(F.col("adjusted_p_value") <= f["max_adjusted_p"])
    first = F.col(sort_by).asc() if ascending else F.col(sort_by).desc()
    return out.select(*columns).orderBy(first, "target", "collocate")


def change_status(a: Column, b: Column, change: Column, threshold: float = 0.1) -> Column:
    return F.when(a.isNull(), "appeared").when(b.isNull(), "disappeared").when(change > threshold, "strengthened").when(change < -threshold, "weakened").otherwise("stable")


def compare_collocates(docs_a: DataFrame, docs_b: DataFrame, targets: str | Iterable[str], **how) -> DataFrame:
    """Collocates of two corpora side by side, with the change of their ratio; the greatest change first, unknown ones before."""
    sides_ = []
    for s, docs in (("a", docs_a), ("b", docs_b)):
        sides_.append(find_collocates(docs, targets, **how).select("target", "collocate", F.col("ratio_local").alias(f"ratio_{s}"), F.col("obs_local").alias(f"obs_{s}"), F.col("p_value").alias(f"p_value_{s}")))
    both = sides_[0].join(sides_[1], ["target", "collocate"], "full_outer")
    change = F.when((F.col("ratio_a") > 0) & (F.col("ratio_b") > 0), F.log2(F.col("ratio_b") / F.nullif("ratio_a", F.lit(0.0))))
    out = both.withColumn("log_ratio_change", change).withColumn("status", change_status(F.col("obs_a"), F.col("obs_b"), F.col("log_ratio_change")))
    out = out.select("target", "collocate", "ratio_a", "ratio_b", "log_ratio_change", F.coalesce("obs_a", F.lit(0)).alias("obs_a"), F.coalesce("obs_b", F.lit(0)).alias("obs_b"), "p_value_a", "p_value_b", "status")
    return out.orderBy(F.abs("log_ratio_change").desc_nulls_first(), "target", "collocate")


def kwic(docs: DataFrame, targets: str | Iterable[str], *, horizon: int | tuple[int, int] = 5, separator: str = " ", sort: str = "right", max_results: int | None = None, max_length: int | None = 256, order: str = "doc_id") -> DataFrame:
    """(left, node, right, left_tokens, right_tokens, doc_index, position) of each hit. doc_index counts documents with tokens, in order.

    max_results cuts in corpus order before the sort: by right context, by the last left token, or by place.
    """
    left, right = sides(horizon)
    names = _targets(targets)
    corpus = docs.select(F.col(order).alias("__order"), truncated(F.col("tokens"), max_length).alias("tokens")).where(F.size("tokens") > 0)
    # ids are numbered without their tokens, in ranges of their order
    index = running_sum(corpus.select("__order"), ["__order"], out="doc_index")
    hit = corpus.where(F.arrays_overlap("tokens", F.array(*map(F.lit, names))))
    places = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i).isin(names))
    rows = hit.select("__order", F.explode(F.transform(places, lambda i: F.struct(i.alias("position"), F.get("tokens", i).alias("node"), F.slice("tokens", F.greatest(i - left, F.lit(0)) + 1, F.least(i, F.lit(left))).alias("left_tokens"), F.slice("tokens", i + 2, F.lit(right)).alias("right_tokens")))).alias("h"))
    out = rows.join(index, "__order").select("h.*", "doc_index")
    if max_results is not None:
        out = out.orderBy("doc_index", "position").limit(max_results)
    out = out.select(F.array_join("left_tokens", separator).alias("left"), "node", F.array_join("right_tokens", separator).alias("right"), "left_tokens", "right_tokens", "doc_index", "position")
    by = {"right": ["right"], "left": [F.element_at(F.when(F.size("left_tokens") > 0, F.col("left_tokens")), -1)], "position": []}[sort]
    return out.orderBy(*by, "doc_index", "position")
