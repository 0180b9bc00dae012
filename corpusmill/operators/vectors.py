"""Lookups over embedding tables: (word, vec ARRAY<FLOAT>)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import cosine_similarity, distance_to_similarity, dot, norm
from ..plans.shared import written

#: A task has so many queries at once, as numpy rows; more are taken in turn.
QUERIES_A_BLOCK, CELLS = 4096, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n < 1e-10, 0.0, x / np.where(n < 1e-10, 1.0, n))


def _gaps(x: np.ndarray, y: np.ndarray, f) -> np.ndarray:
    """f of the differences of each row of x to all of y."""
    return np.stack([f(y - row) for row in x]) if len(x) else np.empty((0, len(y)))


#: Distances of all rows of x to all rows of y.
BLOCKS = {
    "cosine": lambda x, y: 1 - _unit(x) @ _unit(y).T,
    "burrows_delta": lambda x, y: _gaps(x, y, lambda d: np.abs(d).mean(1) if d.shape[1] else np.zeros(len(d))),
    "manhattan": lambda x, y: _gaps(x, y, lambda d: np.abs(d).sum(1)),
    "euclidean": lambda x, y: _gaps(x, y, lambda d: np.sqrt((d * d).sum(1))),
    "eder_delta": lambda x, y: _gaps(x, y, lambda d: np.sqrt((d * d).mean(1)) if d.shape[1] else np.zeros(len(d))),
}


def rows_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _blocks(table: DataFrame, key: str, vec: str, size: int | None = None):
    """The rows of a written table as (keys, matrix), in parts of about size rows: one part at a time is on the driver."""
    n = table.count()
    parts = max(1, -(-n // (size or QUERIES_A_BLOCK)))
    for k in range(parts):
        part = table.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k).select(key, F.col(vec).cast("array<double>").alias(vec)).toArrow().combine_chunks()
        if len(part):
            yield part[key].combine_chunks(), rows_of(part[vec].combine_chunks())


def nearest(queries: DataFrame, vectors: DataFrame, k: int, distance=BLOCKS["cosine"], key: str = "word", vec: str = "vec") -> DataFrame:
    """(query, word, distance, rank): of each query the k nearest vectors but itself; ties by word.

    Blocks of queries go to the vectors, which stay where they are; each batch of vectors returns its k best of each query, by matrix products. distance takes two matrices.
    """
    kinds = dict(queries.dtypes)[key], dict(vectors.dtypes)[key]
    out = None
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("word"), F.col(vec).cast("array<double>").alias("vec"))
    for names, x in _blocks(written(queries.where(F.col(vec).isNotNull()).select(key, vec), "queries"), key, vec):

        def run(batches, names=names, x=x):
            for b in batches:
                word, y = b.column(0), rows_of(b.column(1))
                at_q, at_w, far = [], [], []
                order = pa.compute.rank(word, sort_keys="ascending", tiebreaker="first").to_numpy(zero_copy_only=False).astype(np.int64) if len(word) else np.empty(0, np.int64)
                step = max(1, CELLS // max(1, len(y)))
                for lo in range(0, len(x) if len(y) else 0, step):
                    d = distance(x[lo : lo + step], y)
                    same = pa.compute.index_in(names[lo : lo + step], word).fill_null(-1).to_numpy(zero_copy_only=False)
                    d[np.flatnonzero(same >= 0), same[same >= 0]] = np.inf
                    m = min(k, len(y))
                    # all that are as near as the k-th, then the first by word
                    limit = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
                    q, w = np.nonzero((d <= limit) & (d < np.inf))
                    best = np.lexsort((order[w], d[q, w], q))
                    q, w = q[best], w[best]
                    first = np.searchsorted(q, q)
                    keep = np.arange(len(q)) - first < m
                    at_q.append(q[keep] + lo)
                    at_w.append(w[keep])
                    far.append(d[q[keep], w[keep]])
                if at_q:
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(at_q))), word.take(pa.array(np.concatenate(at_w))), pa.array(np.concatenate(far))], names=["query", "word", "distance"])

        part = rows.mapInArrow(run, f"query {kinds[0]}, word {kinds[1]}, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"query {kinds[0]}, word {kinds[1]}, distance double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "word"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, metric="cosine") -> DataFrame:
    """queries, vectors (word, vec): (query, word, similarity, rank): the k most similar of each query, itself left out; ties by word; all if there are fewer.

    metric: cosine, or a function of two matrices that gives the similarities of all rows of one to all of the other; or a name of BLOCKS, whose similarity is 1 / (1 + distance).
    """
    if callable(metric):
        return nearest(queries, vectors, k, lambda x, y: -metric(x, y)).select("query", "word", (-F.col("distance")).alias("similarity"), "rank")
    found = nearest(queries, vectors, k, BLOCKS[metric])
    return found.select("query", "word", distance_to_similarity(F.col("distance"), metric).alias("similarity"), "rank")


def cross_space(model: DataFrame, other: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """most_similar() of words of one space among the words of another of the same width, such as a model's output vectors; a word's own namesake is left out."""
    return most_similar(model.where(F.col("word").isin(sorted(set(words)))), other, k)


def distances(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = tuple(BLOCKS)) -> DataFrame:
    """(a, b, a column for each metric) of all rows of a with all of b: as many rows as that, made where b's rows are."""
    kinds = dict(a.dtypes)["word"], dict(b.dtypes)["word"]
    schema = f"a {kinds[0]}, b {kinds[1]}, " + ", ".join(f"{m} double" for m in metrics)
    out = None
    rows = b.where("vec IS NOT NULL").select("word", F.col("vec").cast("array<double>").alias("vec"))
    for names, x in _blocks(written(a.where("vec IS NOT NULL").select("word", "vec"), "queries"), "word", "vec"):

        def run(batches, names=names, x=x):
            for batch in batches:
                word, y = batch.column(0), rows_of(batch.column(1))
                step = max(1, CELLS // 8 // max(1, len(y)))
                for lo in range(0, len(x) if len(y) else 0, step):
                    part = x[lo : lo + step]
                    i, j = np.divmod(np.arange(len(part) * len(y)), len(y))
                    cols = [BLOCKS[m](part, y).ravel() for m in metrics]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i + lo)), word.take(pa.array(j)), *map(pa.array, cols)], names=["a", "b", *metrics])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return a.sparkSession.createDataFrame([], schema) if out is None else out


def pairwise(vectors: DataFrame, metric: str = "cosine") -> DataFrame:
    """(a, b, distance), a < b."""
    return distances(vectors, vectors, (metric,)).where("a < b").withColumnRenamed(metric, "distance")


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0))))


def bias_direction(pairs: DataFrame) -> DataFrame:
    """pairs (pos, neg) of vectors: (direction), the unit vector of the mean difference; a zero mean stays."""
    gaps = pairs.select(F.posexplode(F.zip_with("pos", "neg", lambda p, n: p.cast("double") - n.cast("double"))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    return gaps.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("d")).select(unit(F.col("d")).alias("direction"))


def bias(vectors: DataFrame, direction: DataFrame) -> DataFrame:
    """(word, bias): the product with the direction; vectors aren't normalized."""
    return vectors.crossJoin(F.broadcast(direction)).select("word", dot(F.col("vec"), F.col("direction")).alias("bias"))


def project_bias(vectors: DataFrame, words: list[str], *axes: DataFrame) -> DataFrame:
    """(word, axis_1[, axis_2]): biases of given words along one or two directions. Missing words are an error."""
    words = sorted(set(words))
    chosen = vectors.where(F.col("word").isin(words))
    have = {r["word"] for r in chosen.select("word").collect()}
    if missing := [w for w in words if w not in have]:
        raise ValueError(f"words without a vector: {missing}")
    out = chosen
    for i, axis in enumerate(axes, 1):
        out = out.crossJoin(F.broadcast(axis.withColumnRenamed("direction", f"__d{i}"))).withColumn(f"axis_{i}", dot(F.col("vec"), F.col(f"__d{i}"))).drop(f"__d{i}")
    return out.drop("vec")


def _moments(batches):
    """Sums of products, of each side, and the rows of a part of the corpus: d x d numbers."""
    xy = x = y = None
    n = 0
    for b in batches:
        s, t = rows_of(b.column(0)), rows_of(b.column(1))
        if not len(s):
            continue
        xy, x, y = (s.T @ t, s.sum(0), t.sum(0)) if xy is None else (xy + s.T @ t, x + s.sum(0), y + t.sum(0))
        n += len(s)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in (xy, x, y)] + [pa.array([n])], names=["xy", "x", "y", "n"])


def cross_moments(source: DataFrame, target: DataFrame, centred: bool = True) -> np.ndarray:
    """d x d sums of products over the words that both have, summed where the rows are; a matrix of each partition leaves the cluster."""
    both = source.select("word", F.col("vec").cast("array<double>").alias("s")).join(target.select("word", F.col("vec").cast("array<double>").alias("t")), "word").select("s", "t")
    rows = both.mapInArrow(_moments, "xy binary, x binary, y binary, n bigint").collect()
    if not rows:
        raise ValueError("no word in both")
    x, y = (sum(np.frombuffer(r[k]) for r in rows) for k in ("x", "y"))
    xy, n = sum(np.frombuffer(r["xy"]) for r in rows).reshape(len(x), len(y)), sum(r["n"] for r in rows)
    return xy - np.outer(x, y) / n if centred else xy


def align_vectors(source: DataFrame, target: DataFrame, centred: bool = True) -> tuple[DataFrame, np.ndarray]:
    """source rotated onto target (orthogonal Procrustes), and the rotation. The covariance is of centred vectors, the rotation is applied to them as they are."""
    u, _, vt = np.linalg.svd(cross_moments(source, target, centred))
    r = u @ vt

    def turn(batches):
        for b in batches:
            out = rows_of(b.column(1)) @ r if b.num_rows else np.empty((0, r.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), r.shape[1]).cast(pa.list_(pa.float64()))], names=["word", "vec"])

    kind = dict(source.dtypes)["word"]
    return source.select("word", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(turn, f"word {kind}, vec array<double>"), r


def temporal_drift(vectors: DataFrame) -> DataFrame:
    """vectors (period_ord, word, vec): (word, period_ord, drift): the cosine distance to the period before."""
    w = Window.partitionBy("word").orderBy("period_ord")
    return vectors.withColumn("before", F.lag("vec").over(w)).where("before IS NOT NULL").select("word", "period_ord", (1 - cosine_similarity(F.col("before"), F.col("vec"))).alias("drift"))


def semantic_change(vectors: DataFrame, counts: DataFrame, target: str, *, min_word_count: int = 1, min_word_length: int = 1, stopwords: list[str] | None = None, reference_words: list[str] | None = None, top_n: int | None = None) -> DataFrame:
    """vectors (period_ord, word, vec), counts (period_ord, word, n): (period_ord, next_ord, word, change), the greatest first.

    change is that of the cosine with the target between adjacent periods; a reference word needs min_word_count (at least 1) in both.
    """
    refs = counts.where((F.col("n") >= max(1, min_word_count)) & (F.char_length("word") >= min_word_length) & (F.col("word") != target))
    if stopwords:
        refs = refs.where(~F.col("word").isin(stopwords))
    if reference_words is not None:
        refs = refs.where(F.col("word").isin(reference_words))
    if top_n:
        refs = refs.withColumn("r", F.row_number().over(Window.partitionBy("period_ord").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top_n).drop("r")
    own = vectors.where(F.col("word") == target).select("period_ord", F.col("vec").alias("t"))
    sim = vectors.join(refs.select("period_ord", "word"), ["period_ord", "word"], "left_semi").join(F.broadcast(own), "period_ord").select("period_ord", "word", cosine_similarity(F.col("vec"), F.col("t")).alias("s"))
    after = sim.select((F.col("period_ord") - 1).alias("period_ord"), "word", F.col("s").alias("s2"))
    return sim.join(after, ["period_ord", "word"]).select("period_ord", (F.col("period_ord") + 1).alias("next_ord"), "word", (F.col("s2") - F.col("s")).alias("change")).orderBy("period_ord", F.desc("change"), "word")


def pca(vectors: DataFrame, k: int = 2, loadings: bool = False) -> DataFrame | tuple[DataFrame, np.ndarray, np.ndarray]:
    """(word, coords): principal coordinates of the centred vectors; signs are arbitrary. With loadings also the k axes (d x k) and the share of the variance that each explains."""
    moments = cross_moments(vectors.select("word", "vec"), vectors.select("word", "vec"))
    values, axes = np.linalg.eigh((moments + moments.T) / 2)
    order = np.argsort(-values)[:k]
    mean = np.array(vectors.select(F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).orderBy("i").toPandas()["x"])
    columns = [F.array(*[F.lit(float(x)) for x in axes[:, j]]) for j in order]
    shift = [float(mean @ axes[:, j]) for j in order]
    out = vectors.select("word", F.array(*[dot(F.col("vec"), c) - m for c, m in zip(columns, shift)]).alias("coords"))
    return (out, axes[:, order], values[order] / max(values.sum(), 1e-300)) if loadings else out
