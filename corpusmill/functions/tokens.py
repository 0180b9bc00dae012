"""Tokenizers and array expressions over array<string> tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = "(?U)[\\s\\x1c-\\x1f]"


def words(text: Column, lower: bool = True) -> Column:
    """Runs of letters."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit("(\\p{L}+)"), F.lit(1))


def blanks(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda w: w != "")


TOKENIZERS = {"words": words, "blanks": blanks, "characters": characters}


def barrier(x: Column) -> Column:
    """x, evaluated once where it stands: the optimizer takes it for random, so it neither copies it into later lambdas and filters nor pushes those below it."""
    return F.when(F.rand(0) < 0.5, x).otherwise(x)


def tokenized(docs: DataFrame, how: str = "words", text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with an array of tokens; null text has none. Filter docs before: filters after this aren't pushed to the scan."""
    return docs.withColumn(out, barrier(F.coalesce(TOKENIZERS[how](F.col(text)), F.array().cast("array<string>"))))


def truncated(tokens: Column, longest: int | None) -> Column:
    return tokens if longest is None else F.slice(tokens, 1, longest)


def _joined(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def ngrams(tokens: Column, low: int = 1, high: int | None = None) -> Column:
    """All n-grams of low..high tokens, joined by a blank: all of one n before the next."""
    out = []
    for n in range(low, (high or low) + 1):
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        out.append(tokens if n == 1 else F.transform(at, _joined(tokens, n)))
    return F.concat(*out)


def chunks(x: Column, size: int, overlap: float = 0.0, text: bool = False) -> Column:
    """Pieces of size items; each starts size - int(size * overlap) after the one before; the last may be shorter."""
    if size < 1 or not 0 <= overlap < 1:
        raise ValueError("size must be positive and overlap in [0, 1)")
    step = max(1, size - int(size * overlap))
    n = F.char_length(x) if text else F.size(x)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n), F.lit(step))).otherwise(F.array().cast("array<int>"))
    # a start whose predecessor reaches the end isn't needed
    starts = F.filter(starts, lambda i: (i == 1) | (i - step + size - 1 < n))
    return F.transform(starts, lambda i: F.substring(x, i, F.lit(size)) if text else F.slice(x, i, size))


def tagged(tokens: Column, label: Column, targets: list[str]) -> Column:
    """token_label where the token is a target."""
    return F.transform(tokens, lambda t: F.when(t.isin(targets), F.concat_ws("_", t, label)).otherwise(t))
