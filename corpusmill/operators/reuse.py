"""Text reuse: shared passages by n-gram seeds, islands on diagonals and banded edit distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


def seeds(a: DataFrame, b: DataFrame | None = None, n: int = 5, within_documents: bool = False) -> DataFrame:
    """(doc_a, doc_b, pos_a, pos_b) of equal n-grams. With b: between the two corpora; else between documents, doc_a < doc_b (and within one, pos_a < pos_b).

    The key is the n-gram itself, so there are no collisions; a hot n-gram is a skewed key, which adaptive execution splits.
    """
    def grams(docs: DataFrame, s: str) -> DataFrame:
        at = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1)).otherwise(F.array().cast("array<int>"))
        g = docs.select(F.col("doc_id").alias(f"doc_{s}"), F.posexplode(F.transform(at, lambda i: F.array_join(F.slice("tokens", i, n), "\x1f"))).alias(f"pos_{s}", "gram"))
        return g

    pairs = grams(a, "a").join(grams(a if b is None else b, "b"), "gram")
    if b is None:
        rule = F.col("doc_a") < F.col("doc_b")
        if within_documents:
            rule = rule | ((F.col("doc_a") == F.col("doc_b")) & (F.col("pos_a") < F.col("pos_b")))
        pairs = pairs.where(rule)
    return pairs.select("doc_a", "doc_b", "pos_a", "pos_b")


def islands(found: DataFrame, n: int = 5, max_gap: int = 3) -> DataFrame:
    """(doc_a, doc_b, pos_a, pos_b, end_a, end_b): seeds in order of (diagonal, pos_a), cut where the diagonal or pos_a leaps by more than max_gap.

    Bounds are those of the first and the last seed in that order; islands without positive length go.
    """
    diagonal = (F.col("pos_a") - F.col("pos_b")).alias("diagonal")
    w = Window.partitionBy("doc_a", "doc_b").orderBy("diagonal", "pos_a")
    leap = (F.col("diagonal") - F.lag("diagonal").over(w) > max_gap) | (F.col("pos_a") - F.lag("pos_a").over(w) > max_gap + n)
    s = found.withColumn("diagonal", diagonal).withColumn("new", F.coalesce(leap, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    key = F.struct("diagonal", "pos_a")
    out = s.groupBy("doc_a", "doc_b", "island").agg(F.min_by("pos_a", key).alias("pos_a"), F.min_by("pos_b", key).alias("pos_b"), (F.max_by("pos_a", key) + n).alias("end_a"), (F.max_by("pos_b", key) + n).alias("end_b"))
    return out.where("end_a > pos_a AND end_b > pos_b").drop("island")


def banded_distances(left: list[np.ndarray], right: list[np.ndarray], band: int, cells: int = 1 << 22) -> np.ndarray:
    """Edit distances of pairs of token numbers, or band + 1 where they are more than band: one row of the table for all pairs at a time, within the band."""
    far = band + 1
    out = np.full(len(left), far)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right)]).reshape(-1, 2)
    todo = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= band)
    todo = todo[np.argsort(sizes[todo, 0], kind="stable")]  # pairs of like length together
    while len(todo):
        step = max(1, cells // max(1, int(sizes[todo[-1]].max()) + 2 * band))
        part, todo = todo[:step], todo[step:]
        n, m = sizes[part].T
        a = np.full((len(part), n.max(initial=0) + 1), -1)
        b = np.full((len(part), n.max(initial=0) + 2 * band + 2), -2)  # b's place j is column j + band
        for k, p in enumerate(part):
            a[k, : n[k]] = left[p]
            b[k, band : band + m[k]] = right[p]
        offset = np.arange(-band, band + 1)
        row = np.where(offset >= 0, np.minimum(offset, far), far)[None].repeat(len(part), 0)
        done = row.copy()
        for i in range(1, n.max(initial=0) + 1):
            differ = a[:, i - 1 : i] != b[:, i - 1 : i + 2 * band]
            new = np.minimum(row + differ, np.c_[row[:, 1:], np.full(len(part), far)] + 1)
            j = i + offset
            new = np.where(j < 0, far, np.where(j == 0, i, new))
            for k in range(1, 2 * band + 1):
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)
            row = np.minimum(new, far)
            done[n == i] = row[n == i]
        out[part] = done[np.arange(len(part)), m - n + band]
    return out


def banded_distance(a: list[str], b: list[str], band: int) -> int:
    """Edit distance of tokens, or band + 1 if it is more than band."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (a, b))
    return int(banded_distances([x], [y], band)[0])


def _verify(band: int, least: float, shortest: int):
    def run(batches):
        for pdf in batches:
            number: dict[str, int] = {}
            left, right = ([np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in pdf[c]] for c in ("ta", "tb"))
            length = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
            d = np.where(length >= shortest, banded_distances(left, right, band), band + 1)
            s = np.where(length > 0, 1 - d / np.maximum(length, 1), 0.0)
            pdf = pdf.assign(length=length, similarity=s.round(4), passage_a=pdf["ta"].map("".join), passage_b=pdf["tb"].map("".join))
            yield pdf.loc[(d <= band) & (s >= least), ["doc_a", "doc_b", "pos_a", "pos_b", "length", "similarity", "passage_a", "passage_b"]]

    return run


def find_shared_sequences(a: DataFrame, b: DataFrame | None = None, *, n: int = 5, min_length: int = 10, min_similarity: float = 0.8, max_gap: int = 3, within_documents: bool = False) -> DataFrame:
    """(doc_a, doc_b, pos_a, pos_b, length, similarity, passage_a, passage_b), the most similar and longest first. An empty corpus gives no rows.

    At most max(1, int((1 - min_similarity) * min_length)) edits are allowed, however long the passage.
    """
    if n < 1 or min_length < n or not 0 < min_similarity <= 1:
        raise ValueError("n must be positive, min_length at least n, min_similarity in (0, 1]")
    band = max(1, int((1 - min_similarity) * min_length))
    found = islands(seeds(a, b, n, within_documents), n, max_gap).where((F.col("end_a") - F.col("pos_a") >= min_length - band) & (F.col("end_b") - F.col("pos_b") >= min_length - band))
    text = lambda d, s: d.select(F.col("doc_id").alias(f"doc_{s}"), F.col("tokens").alias(f"tokens_{s}"))
    cut = lambda s: F.slice(f"tokens_{s}", F.col(f"pos_{s}") + 1, F.col(f"end_{s}") - F.col(f"pos_{s}")).alias(f"t{s}")
    rows = found.join(text(a, "a"), "doc_a").join(text(a if b is None else b, "b"), "doc_b").select("doc_a", "doc_b", "pos_a", "pos_b", cut("a"), cut("b"))
    kinds = dict(rows.dtypes)
    out = rows.mapInPandas(_verify(band, min_similarity, min_length), f"doc_a {kinds['doc_a']}, doc_b {kinds['doc_b']}, pos_a int, pos_b int, length int, similarity double, passage_a string, passage_b string")
    return out.orderBy(F.desc("similarity"), F.desc("length"), "doc_a", "doc_b", "pos_a", "pos_b")
