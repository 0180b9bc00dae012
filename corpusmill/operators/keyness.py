"""Keyness: which words tell two corpora apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import check_options, chi2_p_udf, chi2_stat, correct, fisher_udf, g2_stat

FILTERS = {"min_count", "max_p", "max_adjusted_p", "stopwords", "min_word_length"}


def keyness_counts(tokens: DataFrame) -> DataFrame:
    """tokens (side 'a' or 'b', token): (word, abs_freqA, abs_freqB, n_a, n_b); one shuffle for both sides."""
    side = lambda s: F.count_if(F.col("side") == s)
    counts = tokens.where(F.col("side").isin("a", "b")).groupBy(F.col("token").alias("word")).agg(side("a").alias("abs_freqA"), side("b").alias("abs_freqB"))
    total = counts.agg(F.sum("abs_freqA").alias("n_a"), F.sum("abs_freqB").alias("n_b"))
    return counts.crossJoin(F.broadcast(total))


def compare_corpora(tokens: DataFrame, *, method: str = "fisher", filters: dict | None = None, correction: str | None = None, with_p: bool = True) -> DataFrame:
    """(word, abs_freqA, abs_freqB, rel_freqA, rel_freqB, rel_ratio[, statistic][, p_value][, adjusted_p_value]), the greatest ratio first.

    min_count is for both sides, or a pair (a, b); it, stopwords and word length come before the test, max_p after it (not with a correction), max_adjusted_p last. An empty side is an error.
    """
    f = check_options(filters, FILTERS)
    if "max_p" in f and correction:
        raise ValueError("with a correction use max_adjusted_p")
    if "max_adjusted_p" in f and not correction:
        raise ValueError("max_adjusted_p needs a correction")
    out = keyness_counts(tokens)
    low = f.get("min_count", 0)
    low_a, low_b = (low, low) if isinstance(low, int) else low
    out = out.where((F.col("abs_freqA") >= low_a) & (F.col("abs_freqB") >= low_b))
    if f.get("stopwords"):
        out = out.where(~F.col("word").isin(sorted(f["stopwords"])))
    if f.get("min_word_length"):
        out = out.where(F.char_length("word") >= f["min_word_length"])
    for s in ("A", "B"):
        out = out.withColumn(f"rel_freq{s}", F.col(f"abs_freq{s}") / F.when(F.col(f"n_{s.lower()}") == 0, F.raise_error(F.lit("a side is empty")).cast("long")).otherwise(F.col(f"n_{s.lower()}")))
    out = out.withColumn("rel_ratio", F.when(F.col("rel_freqB") == 0, float("inf")).otherwise(F.col("rel_freqA") / F.nullif("rel_freqB", F.lit(0.0))))
    cells = [F.col("abs_freqA"), F.col("abs_freqB"), F.col("n_a") - F.col("abs_freqA"), F.col("n_b") - F.col("abs_freqB")]
    columns = ["word", "abs_freqA", "abs_freqB", "rel_freqA", "rel_freqB", "rel_ratio"]
    stats = {"chi2": chi2_stat(*cells), "chi2_corrected": chi2_stat(*cells, yates=True), "log_likelihood": g2_stat(*cells)}
    if method in stats:
        out, columns = out.withColumn("statistic", stats[method]), [*columns, "statistic"]
    elif method != "fisher":
        raise ValueError(f"unknown method {method!r}")
    if with_p or correction:
        out = out.withColumn("p_value", fisher_udf()(*cells) if method == "fisher" else chi2_p_udf()("statistic"))
        columns.append("p_value")
        if "max_p" in f:
            out = out.where(F.col("p_value") <= f["max_p"])
    if correction:
        out, columns = correct(out, correction), [*columns, "adjusted_p_value"]
        if "max_adjusted_p" in f:
            out = out.where(F.col("adjusted_p_value") <= f["max_adjusted_p"])
    return out.select(*columns).orderBy(F.desc("rel_ratio"), "word")


def sides_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two corpora with tokens arrays as the one table that compare_corpora() reads."""
    one = lambda d, s: d.select(F.lit(s).alias("side"), F.explode("tokens").alias("token"))
    return one(a, "a").unionByName(one(b, "b"))
