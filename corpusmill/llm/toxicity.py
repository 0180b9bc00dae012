"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

A linear classifier is fitted in numpy from confirmed toxic documents and unlabelled text, which is the whole corpus: the risk is
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)), so that toxic documents among the unlabelled
aren't learnt as clean. Features are words and their first letters; those significantly more frequent in the positive
documents take part. Gradients of the unlabelled part are summed where the texts are, over cells of these features alone. Scoring is a sum over a document's distinct words, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import remove, sized, written
from .wordhash import WordReader

STEMS, CLIP = (4, 5), 3


def _distinct(c) -> tuple[np.ndarray, ...]:
    """Each distinct word of each text once: row, hash, and for each length of STEMS the prefix's hash, 0 where the word isn't longer."""
    names, first, at = np.unique(c.hash, return_index=True, return_inverse=True)
    pairs = np.unique(c.doc * max(1, len(names)) + at)
    row, word = pairs // max(1, len(names)), first[pairs % max(1, len(names))]
    length = (c.stop - c.start)[word]
    return row, c.hash[word], *(np.where(length > n, c.prefix(n)[word], np.uint64(0)) for n in STEMS)


def text_features(column: pa.Array, reader: WordReader):
    """For each chunk of lower-case texts: (row, feature, times) with rows in order; times counts a row's distinct words with the feature, CLIP at most."""
    for row, word, *prefixes in reader.read(column, _distinct):
        order = np.lexsort((word, row))
        new = np.r_[True, (np.diff(row[order]) != 0) | (np.diff(word[order]) != 0)] if len(row) else np.empty(0, bool)
        order = order[new]  # pieces of a long text share words
        row = row[order]
        each = [word[order], *(p[order] for p in prefixes)]
        rows = np.concatenate([row[f != 0] for f in each])
        feats = np.concatenate([f[f != 0] for f in each])
        order = np.lexsort((feats, rows))
        rows, feats = rows[order], feats[order]
        cuts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (feats[1:] != feats[:-1])]) if len(rows) else np.empty(0, np.int64)
        yield rows[cuts], feats[cuts], np.minimum(np.diff(np.r_[cuts, len(rows)]), CLIP)


def _bags(batches):
    """Each text's features and times, packed."""
    reader = WordReader()
    for b in batches:
        out = {}
        for rows, feats, times in text_features(b.column(1), reader):
            cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(rows)]):
                out[int(rows[lo])] = feats[lo:hi].tobytes(), times[lo:hi].astype(np.int8).tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([out.get(r, (b"", b""))[k] for r in range(b.num_rows)], pa.binary()) for k in (0, 1))], names=["positive", "features", "times"])


def positive_bags(docs: DataFrame, labels: DataFrame, max_positive: int, seed: int) -> list[tuple[bytes, bytes]]:
    """Features and times of the confirmed toxic documents that are fitted on: the first max_positive in the order of a seeded hash."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    chosen = written(ids.join(toxic, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_positive), "fit")
    rows = docs.join(sized(chosen, max_positive), "doc_id").select(F.lit(1).alias("positive"), F.lower("text").alias("text")).mapInArrow(_bags, "positive int, features binary, times binary").toArrow()
    return sorted(set(zip(*(rows[c].to_pylist() for c in ("features", "times")))))


def lookup(names: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted names, which of feats they are) of the feats that names has."""
    k = np.minimum(np.searchsorted(names, feats), max(0, len(names) - 1))
    hit = names[k] == feats
    return k[hit], hit


def _frequencies(names: np.ndarray):
    def run(batches):
        """In how many texts each of names occurs; -1 stands for their number."""
        reader, n, texts = WordReader(), np.zeros(len(names), np.int64), 0
        for b in batches:
            texts += b.num_rows
            for _, feats, _ in text_features(b.column(0), reader):
                n += np.bincount(lookup(names, feats)[0], minlength=len(names))
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, i]), pa.array(np.r_[texts, n[i]])], names=["i", "n"])

    return run


def _cells(names: np.ndarray):
    def run(batches):
        """The features in names that texts have, packed; texts without one only count."""
        reader = WordReader()
        for b in batches:
            row, col, val, texts = [], [], [], 0
            for rows, feats, times in text_features(b.column(0), reader):
                k, hit = lookup(names, feats)
                if len(k):
                    at = np.unique(rows[hit], return_inverse=True)
                    row.append(at[1].reshape(-1) + texts)
                    texts += len(at[0])
                    col.append(k.astype(np.int32))
                    val.append(times[hit].astype(np.int8))
            packed = [np.concatenate([*x, np.empty(0, t)]).astype(t).tobytes() for x, t in ((row, np.int32), (col, np.int32), (val, np.int8))]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([texts]), *(pa.array([x], pa.binary()) for x in packed)], names=["texts", "with_cells", "row", "col", "val"])

    return run


CELLS = "texts bigint, with_cells bigint, row binary, col binary, val binary"


class Sums:
    """Loss and slopes of scores of a set of texts given by cells."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, texts: int, features: int):
        self.row, self.col, self.val, self.texts, self.features = row, col, val.astype(float), texts, features

    def of(self, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(loss if clean, loss's slope if clean, slope if toxic, loss if toxic) summed, and the slopes' sums by feature, each as a row."""
        s = np.clip(np.bincount(self.row, self.val * w[self.col], self.texts) + b, -60, 60)
        up, down = 1 / (1 + np.exp(-s)), 1 / (1 + np.exp(s))  # slopes of log(1+e^s) and, but for the sign, of log(1+e^-s)
        by = [np.bincount(self.col, self.val * g[self.row], self.features) for g in (up, down)]
        return np.array([np.logaddexp(0, s).sum(), up.sum(), down.sum(), np.logaddexp(0, -s).sum()]), np.stack(by)


def _gradient(w: np.ndarray, b: float):
    def run(batches):
        total, by = np.zeros(2), np.zeros((2, len(w)))
        for batch in batches:
            for texts, some, row, col, val in zip(*(batch.column(k).to_pylist() for k in range(5))):
                t, g = Sums(np.frombuffer(row, np.int32), np.frombuffer(col, np.int32), np.frombuffer(val, np.int8), some, len(w)).of(w, b)
                rest = texts - some  # they score the bias
                total += t[:2] + rest * np.array([np.logaddexp(0, b), 1 / (1 + np.exp(-b))])
                by += g
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[total, by[0]].tobytes()], pa.binary())], names=["g"])

    return run


def _summed(batches):
    rows = [np.frombuffer(g, float) for b in batches for g in b.column(0).to_pylist()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([sum(rows).tobytes()], pa.binary())], names=["g"])


def gradient_of(cells: DataFrame, parts: int, w: np.ndarray, b: float, most: int = 256) -> np.ndarray:
    """(loss, slope, slopes by feature) over all texts: a row of a few kilobytes from each partition, first added up in the cluster where there are many."""
    rows = cells.mapInArrow(_gradient(w, b), "g binary")
    if parts > most:
        rows = rows.repartition(math.isqrt(parts)).mapInArrow(_summed, "g binary")
    return sum(np.frombuffer(r["g"], float) for r in rows.collect())


def train(positive: list[tuple[bytes, bytes]], texts: DataFrame, prior: float, least_z: float = 4.0, least_docs: int = 4, steps: int = 60, rate: float = 0.4, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """positive: bags; texts (text): all unlabelled text. Returns the features in order, their weights and the bias; without positives or features, none and a negative bias.

    Features are those whose share among the positives is least_z standard errors above that among all texts. Each step is one pass over the cells of all texts; the state of the least corrected risk is returned, as steps
    back from a negative risk (a prior above the true share) may overshoot.
    """
    none = np.empty(0, np.uint64), np.empty(0), -1.0
    if not positive:
        return none
    names, pos = np.unique(np.concatenate([np.frombuffer(f, np.uint64) for f, _ in positive] + [np.empty(0, np.uint64)]), return_counts=True)
    names, pos = names[pos >= least_docs], pos[pos >= least_docs]
    if not len(names):
        return none
    counted = {r["i"]: r["n"] for r in texts.mapInArrow(_frequencies(names), "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n1, n0 = len(positive), counted.get(-1, 0)
    neg = np.array([counted.get(i, 0) for i in range(len(names))])
    share = (pos + neg) / (n0 + n1)
    z = (pos / n1 - neg / max(1, n0)) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / max(1, n0) + 1 / n1))
    at = names[z >= least_z]
    if not len(at) or not n0:
        return none
    found = [(*lookup(at, np.frombuffer(f, np.uint64)), np.frombuffer(t, np.int8)) for f, t in positive]
    own = Sums(np.repeat(np.arange(n1), [len(k) for k, _, _ in found]), np.concatenate([k for k, _, _ in found]), np.concatenate([t[hit] for _, hit, t in found]), n1, len(at))
    cells = written(texts.mapInArrow(_cells(at), CELLS), "cells")
    parts = cells.rdd.getNumPartitions()
    w, b = np.zeros(len(at)), -1.0
    m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    best = (np.inf, w, b)
    for step in range(1, steps + 1):
        g = gradient_of(cells, parts, w, b) / n0
        total, by = own.of(w, b)
        total, by = total / n1, by / n1
        unlabelled, toxic_as_clean = np.r_[g[2:], g[1]], np.r_[by[0], total[1]]
        negative = g[0] - prior * total[0]
        risk = prior * total[3] + max(0.0, negative)
        if risk < best[0]:
            best = (risk, w, b)
        if negative >= 0:
            grad = unlabelled - prior * toxic_as_clean - prior * np.r_[by[1], total[2]]
        else:  # the corrected risk went below zero: step back along that part
            grad = prior * toxic_as_clean - unlabelled
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    remove(cells)
    return at, best[1], float(best[2])


def model(docs: DataFrame, labels: DataFrame, *, prior: float | None = None, max_positive: int = 3000, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """max_positive bounds the labelled rows that the classifier is fitted on; unlabelled text is all of docs. prior: the toxic share of the corpus; None: that of the labels, which should then be of a random sample, 0.1 without any of both kinds. A prior well above the
    true share makes the corrected risk indifferent to calling clean text toxic."""
    if prior is None:
        share = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = share if share and 0 < share < 1 else 0.1
    return train(positive_bags(docs, labels, max_positive, seed), docs.where("text IS NOT NULL").select(F.lower("text").alias("text")), prior)


def _score(names: np.ndarray, weights: np.ndarray, bias: float):
    def run(texts):
        reader = WordReader()
        for t in texts:
            out = np.full(len(t), bias)
            if len(names):
                for rows, feats, times in text_features(t, reader):
                    k, hit = lookup(names, feats)
                    out += np.bincount(rows[hit], weights[k] * times[hit], len(t))
            yield pa.array(out)

    return run


def with_score(docs: DataFrame, fitted: tuple[np.ndarray, np.ndarray, float], name: str = "score") -> DataFrame:
    run = _score(*fitted)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(texts)

    return docs.withColumn(name, F.round(score.asNondeterministic()(F.lower("text")), 9))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, score, toxic) of every row of docs; toxic is score > 0.

    A feature counts as many of a text's distinct words as have it, CLIP at most: prefixes of many words are no more than that. Long texts are read in pieces, as one text. Null, empty and wordless texts score the bias, which is clean unless the fit says otherwise. Rows with a null id are scored too; they
    aren't fitted on. Repeated rows get the same score. Without positive labels nothing is toxic. Other columns are ignored.
    """
    fitted = model(docs, labels, **how)
    return with_score(docs.select("doc_id", "text"), fitted).select("doc_id", "score", (F.col("score") > 0).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs without the toxic ones, with its columns as they are."""
    return with_score(docs, model(docs, labels, **how), "__score").where("__score <= 0").drop("__score")
