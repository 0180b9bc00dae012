"""Stylometry: documents as arrays of values over a bounded list of features, counted where the documents are."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tokens import ngrams
from ..functions.vectors import DISTANCES, distance_to_similarity
from ..plans.shared import written
from .pairs import pieces
from .vectors import BLOCKS, _blocks, distances, rows_of

METRICS = tuple(sorted(DISTANCES))


def feature_counts(docs: DataFrame, keys: list[str], ngram_range: tuple[int, int] = (1, 1)) -> DataFrame:
    """(keys..., feature, n, total); total counts n-grams of all orders."""
    grams = docs.select(*keys, F.explode(ngrams(F.col("tokens"), *ngram_range)).alias("feature"))
    return grams.groupBy(*keys, "feature").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _counted(names: list[str], n_keys: int):
    def run(batches):
        """Keys, the count of each feature in each row's list, and the lists' lengths as they come. Lists hold features only, a bounded number of which is looked at at once."""
        known = pa.array(names, pa.string())
        for batch in batches:
            for b, size in pieces(batch, n_keys):
                at = pa.compute.index_in(b.column(n_keys).flatten(), known)
                cell = np.repeat(np.arange(len(size)) * len(names), size)[at.is_valid().to_numpy(zero_copy_only=False)] + at.drop_null().to_numpy(zero_copy_only=False)
                n = np.bincount(cell, minlength=len(size) * len(names)).astype(np.int64)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * len(names)), pa.array(n))
                yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], counts, b.column(n_keys + 1)], names=[*b.schema.names[:n_keys], "counts", "total"])

    return run


def literal(x) -> Column:
    return F.array(*[F.lit(float(v)) for v in x])


@dataclass
class Fitted:
    names: list[str]  # at most n_features
    mean: np.ndarray
    std: np.ndarray
    idf: np.ndarray
    relative: DataFrame  # (doc_id, author, rel): written
    centroids: DataFrame  # (author, vec): written


class Stylometry:
    def __init__(self, n_features: int = 100, ngram_range: tuple[int, int] = (1, 1), transform: str = "zscore", distance: str = "cosine", cull: float | None = None, min_variance: float | None = None, mode: str = "centroid", classifier: str = "delta"):
        if transform not in ("zscore", "tfidf") or distance not in METRICS or mode not in ("centroid", "instance") or classifier not in ("delta", "svm"):
            raise ValueError("unknown transform, distance, mode or classifier")
        self.n_features, self.ngram_range, self.kind, self.distance_name, self.cull, self.min_variance, self.mode = n_features, ngram_range, transform, distance, cull, min_variance, mode
        self.classifier = classifier
        self.fitted: Fitted | None = None

    def _relative(self, docs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
        """(keys..., rel): shares of the features in each document's n-grams. Counts are made in the documents' rows; rows of one document are added up."""
        kinds = dict(docs.dtypes)
        schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", counts array<bigint>, total bigint"
        grams = docs.select(*keys, ngrams(F.col("tokens"), *self.ngram_range).alias("grams"))
        # other n-grams don't leave the JVM; a null can be a feature
        known = [x for x in names if x is not None]
        held = grams.select(*keys, F.filter("grams", lambda g: g.isNull() | g.isin(known) if len(known) < len(names) else g.isin(known)).alias("grams"), F.size("grams").cast("long").alias("total"))
        rows = held.mapInArrow(_counted(names, len(keys)), schema)
        zero = F.array_repeat(F.lit(0).cast("long"), len(names))
        whole = rows.groupBy(*keys).agg(F.aggregate(F.collect_list("counts"), zero, lambda s, c: F.zip_with(s, c, lambda x, y: x + y)).alias("counts"), F.sum("total").alias("total"))
        return whole.select(*keys, F.transform("counts", lambda n: n / F.nullif(F.col("total"), F.lit(0))).alias("rel"))

    def _value(self, rel: Column) -> Column:
        f = self._ready()
        if self.kind == "zscore":
            return F.zip_with(F.zip_with(rel, literal(f.mean), lambda x, m: x - m), literal(f.std), lambda x, s: x / s)
        return F.zip_with(rel, literal(f.idf), lambda x, i: x * i)

    def _long(self, wide: DataFrame, keys: list[str]) -> DataFrame:
        names = F.array(*map(F.lit, self._ready().names))
        return wide.select(*keys, F.posexplode("vec").alias("i", "value")).select(*keys, F.get(names, F.col("i")).alias("feature"), "value")

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, author, tokens): (doc_id, author, feature, value). Needs two documents with tokens."""
        docs = docs.where(F.size("tokens") > 0)
        n_docs = docs.select("doc_id", "author").distinct().count()
        if n_docs < 2:
            raise ValueError("at least two documents are needed")
        grams = docs.select("doc_id", "author", F.explode(ngrams(F.col("tokens"), *self.ngram_range)).alias("feature"))
        chosen = grams.groupBy("feature").agg(F.count("*").alias("n"))
        if self.cull:
            held = grams.distinct().groupBy("feature").agg(F.count("*").alias("df")).where(F.col("df") >= math.ceil(self.cull * n_docs))
            chosen = chosen.join(held, "feature", "left_semi")
        names = [r["feature"] for r in chosen.orderBy(F.desc("n"), "feature").limit(self.n_features).select("feature").collect()]
        relative = written(self._relative(docs, ["doc_id", "author"], names), "relative")
        stats = relative.select(F.posexplode("rel").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"), F.var_pop("x").alias("var"), F.count_if(F.col("x") > 0).alias("df")).orderBy("i").collect()
        stats = [r for r in stats if not self.min_variance or r["var"] >= self.min_variance]
        if len(stats) < len(names):
            kept = F.array(*[F.lit(r["i"]) for r in stats])
            relative = written(relative.select("doc_id", "author", F.transform(kept, lambda i: F.get("rel", i)).alias("rel")), "relative")
        self.fitted = Fitted([names[r["i"]] for r in stats], np.array([r["mean"] for r in stats]), np.array([1.0 if r["s"] < 1e-10 else r["s"] for r in stats]), np.array([math.log(n_docs / max(1, r["df"])) for r in stats]), relative, relative)
        means = relative.select("author", F.posexplode("rel").alias("i", "x")).groupBy("author", "i").agg(F.avg("x").alias("x"))
        centroids = means.groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("rel"))
        self.fitted.centroids = written(centroids.select("author", self._value(F.col("rel")).alias("vec")), "centroids")
        return self._long(self._vectors(), ["doc_id", "author"])

    def _ready(self) -> Fitted:
        if self.fitted is None:
            raise ValueError("fit_transform() comes first")
        return self.fitted

    def _vectors(self) -> DataFrame:
        """(doc_id, author, vec) of the fitted documents."""
        return self._ready().relative.select("doc_id", "author", self._value(F.col("rel")).alias("vec"))

    def arrays(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """Vectors of unseen documents: (keys..., vec), in the order of the features."""
        return self._relative(docs.where(F.size("tokens") > 0), list(keys), self._ready().names).select(*keys, self._value(F.col("rel")).alias("vec"))

    def transform(self, docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """(keys..., feature, value) of unseen documents. Warns if none of them has a known feature."""
        import warnings

        known = F.array(*map(F.lit, self._ready().names))
        if docs.where(F.arrays_overlap(ngrams(F.col("tokens"), *self.ngram_range), known)).isEmpty() and not docs.isEmpty():
            warnings.warn("no document has a feature of the fitted ones", stacklevel=2)
        return self._long(self.arrays(docs, keys), list(keys))

    def _candidates(self) -> DataFrame:
        if self.mode == "centroid":
            return self._ready().centroids.select(F.col("author").alias("candidate"), "author", "vec")
        return self._vectors().select(F.col("doc_id").cast("string").alias("candidate"), "author", "vec")

    def predict(self, docs: DataFrame, k: int = 5) -> DataFrame:
        """(doc_id, candidate, author, distance, rank): the k nearest authors, or documents in instance mode; with the svm classifier the k most probable authors, (doc_id, author, probability, rank)."""
        if self.classifier == "svm":
            rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("probability"), "author"))
            return self.svm_probabilities(docs).withColumn("rank", rank).where(F.col("rank") <= k)
        rows = self.arrays(docs)
        kind = dict(rows.dtypes)["doc_id"]
        distance, out = BLOCKS[self.distance_name], None
        # candidates go to the documents in blocks; documents stay where they are
        for names, y in _blocks(written(self._candidates(), "candidates"), "candidate", "vec"):
            of = self._authors(names)

            def run(batches, names=names, y=y, of=of):
                name = np.array(names.to_pylist(), object)
                order = np.argsort(np.argsort(name.astype(str), kind="stable"))
                for b in batches:
                    x = rows_of(b.column(1))
                    if not len(x):
                        continue
                    d = np.concatenate([distance(x[lo : lo + 512], y) for lo in range(0, len(x), 512)])
                    best = np.lexsort((np.broadcast_to(order, d.shape), d), axis=1)[:, :k]
                    at = np.repeat(np.arange(len(x)), best.shape[1])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(name[best.ravel()], pa.string()), pa.array(of[best.ravel()], pa.string()), pa.array(d[at, best.ravel()])], names=["doc_id", "candidate", "author", "distance"])

            part = rows.mapInArrow(run, f"doc_id {kind}, candidate string, author string, distance double")
            out = part if out is None else out.unionByName(part)
        rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("distance", "candidate"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k)

    def _authors(self, candidates: pa.Array) -> np.ndarray:
        if self.mode == "centroid":
            return np.array(candidates.to_pylist(), object)
        ids = candidates.to_pylist()
        of = {r["c"]: r["author"] for r in self._ready().relative.select(F.col("doc_id").cast("string").alias("c"), "author").where(F.col("c").isin(ids)).collect()}
        return np.array([of[i] for i in ids], object)

    def predict_author(self, docs: DataFrame, k: int = 5) -> DataFrame:
        """(doc_id, author): the nearest author, or the most common among the k nearest documents; ties to the nearer."""
        if self.classifier == "svm":
            return self.svm_predict(docs)
        near = self.predict(docs, 1 if self.mode == "centroid" else k)
        votes = near.groupBy("doc_id", "author").agg(F.count("*").alias("n"), F.min("rank").alias("r"))
        return votes.groupBy("doc_id").agg(F.min_by("author", F.struct(-F.col("n"), "r")).alias("author"))

    def predict_confidence(self, docs: DataFrame, k: int = 5) -> DataFrame:
        """predict() with confidence: a softmax of distances over what it returns, or the svm's probability."""
        p = self.predict(docs, k)
        if self.classifier == "svm":
            return p.withColumn("confidence", F.col("probability"))
        w = Window.partitionBy("doc_id")
        p = p.withColumn("__e", F.exp(F.min("distance").over(w) - F.col("distance")))
        return p.withColumn("confidence", F.col("__e") / F.sum("__e").over(w)).drop("__e")

    def bootstrap_predict(self, docs: DataFrame, n_iter: int = 100, share: float = 0.5, seed: int = 0) -> DataFrame:
        """(doc_id, author, votes, share, mean, std): nearest authors over random parts of the features; every candidate sees the same part. Centroids, authors times features, are on the driver."""
        f = self._ready()
        rows = self.arrays(docs)
        cents = sorted(f.centroids.collect(), key=lambda r: r["author"])
        names, y = [r["author"] for r in cents], np.array([r["vec"] for r in cents], float)
        m, rng = max(1, int(len(f.names) * share)), np.random.default_rng(seed)
        parts = [np.sort(rng.choice(len(f.names), m, replace=False)) for _ in range(n_iter)]
        distance, kind = BLOCKS[self.distance_name], dict(rows.dtypes)["doc_id"]

        def run(batches):
            for b in batches:
                for lo in range(0, len(b), 512):
                    x = rows_of(b.column(1).slice(lo, 512))
                    d = np.stack([distance(x[:, p], y[:, p]) for p in parts])
                    won = np.zeros((len(x), len(y)), np.int64)
                    np.add.at(won, (np.tile(np.arange(len(x)), n_iter), d.argmin(2).ravel()), 1)
                    at = np.repeat(np.arange(len(x)), len(y))
                    cols = [pa.array(names * len(x), pa.string()), *(pa.array(v.ravel()) for v in (won, won / n_iter, d.mean(0), d.std(0)))]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512).take(pa.array(at)), *cols], names=["doc_id", "author", "votes", "share", "mean", "std"])

        return rows.mapInArrow(run, f"doc_id {kind}, author string, votes bigint, share double, mean double, std double")

    def rolling_delta(self, docs: DataFrame, window: int = 1000, step: int = 100, author: str | None = None) -> DataFrame:
        """(doc_id, position, distance, end_position): windows of each document against an author's centroid, or the document's own vector."""
        starts = F.sequence(F.lit(0), F.size("tokens") - window, F.lit(step))
        pieces = docs.where(F.size("tokens") >= window).select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.cast("long").alias("position"), F.slice("tokens", i + 1, window).alias("tokens")))).alias("w")).select("doc_id", "w.*")
        x = self.arrays(pieces, ("doc_id", "position")).withColumnRenamed("vec", "x")
        if author is None:
            pairs = x.join(self.arrays(docs).withColumnRenamed("vec", "y"), "doc_id")
        else:
            own = self._ready().centroids.where(F.col("author") == author).first()
            if own is None:
                raise ValueError(f"unknown author {author!r}")
            pairs = x.withColumn("y", literal(own["vec"]))
        d = DISTANCES[self.distance_name](F.col("x"), F.col("y"))
        return pairs.select("doc_id", "position", d.alias("distance"), (F.col("position") + window).alias("end_position"))

    def _named(self, level: str) -> DataFrame:
        if level not in ("author", "document"):
            raise ValueError("level is author or document")
        return self._ready().centroids.select(F.col("author").alias("word"), "vec") if level == "author" else self._vectors().select(F.col("doc_id").alias("word"), "vec")

    def distance_matrix(self, level: str = "document") -> DataFrame:
        """(a, b, distance) for all ordered pairs, a <> b."""
        v = self._named(level)
        return distances(v, v, (self.distance_name,)).where("a <> b").withColumnRenamed(self.distance_name, "distance")

    def _query(self, what) -> tuple[list[float], bool]:
        """The vector of a fitted document's id or of a list of tokens, and whether it is the former."""
        if isinstance(what, (list, tuple)):
            spark = self._ready().relative.sparkSession
            return self.arrays(spark.createDataFrame([(0, list(what))], "doc_id bigint, tokens array<string>")).first()["vec"], False
        row = self._vectors().where(F.col("doc_id") == what).select("vec").first()
        if row is None:
            raise ValueError(f"unknown document {what!r}")
        return row["vec"], True

    def most_similar(self, what, k: int = 10, level: str = "document") -> DataFrame:
        """(doc_id, distance, similarity) of the documents, or (author, ...) of the authors, nearest to a fitted document, given by its id, or to a list of tokens; a document isn't its own neighbour."""
        vec, fitted = self._query(what)
        v = self._named(level)
        d = DISTANCES[self.distance_name](F.col("vec"), literal(vec))
        rows = v.where(F.col("word") != what) if fitted and level == "document" else v
        out = rows.select(F.col("word").alias("doc_id" if level == "document" else "author"), d.alias("distance"))
        return out.withColumn("similarity", distance_to_similarity(F.col("distance"), self.distance_name)).orderBy("distance", out.columns[0]).limit(k)

    def distance(self, a, b) -> float:
        """Between two documents, each an id or a list of tokens."""
        x, y = (np.array([self._query(w)[0]], float) for w in (a, b))
        return float(BLOCKS[self.distance_name](x, y)[0, 0])

    def similarity(self, a, b) -> float:
        d = self.distance(a, b)
        return 1 - d if self.distance_name == "cosine" else 1 / (1 + d)

    def author_profile(self, author: str | None = None) -> DataFrame:
        """(author, feature, value) of one author or of all, the greatest values first."""
        c = self._ready().centroids
        rows = self._long(c if author is None else c.where(F.col("author") == author), ["author"])
        return rows.orderBy("author", F.desc("value"), "feature")

    def feature_comparison(self) -> DataFrame:
        """(feature, a column for each author, variance): the sample variance across authors, the greatest first."""
        c = self._long(self._ready().centroids, ["author"])
        var = c.groupBy("feature").agg(F.var_samp("value").alias("variance"))
        return c.groupBy("feature").pivot("author").agg(F.first("value")).join(var, "feature").orderBy(F.desc("variance"), "feature")

    def _svm(self, rows: DataFrame, labels: list[str]) -> list[tuple[np.ndarray, float]]:
        """Weights and intercept of each author against the rest, of (author, features)."""
        from pyspark.ml.classification import LinearSVC

        out = []
        for a in labels:
            m = LinearSVC(maxIter=1000, tol=1e-6).fit(rows.withColumn("label", (F.col("author") == a).cast("double")))
            out.append((m.coefficients.toArray(), float(m.intercept)))
        return out

    def _features(self) -> tuple[DataFrame, list[str]]:
        from pyspark.ml.functions import array_to_vector

        rows = written(self._vectors().withColumn("features", array_to_vector("vec")).withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3))), "svm").persist()
        return rows, sorted(r[0] for r in rows.select("author").distinct().collect())

    def _margins(self, rows: DataFrame, models: list[tuple[np.ndarray, float]]) -> Column:
        return F.array(*[F.aggregate(F.zip_with("vec", literal(w), lambda x, y: x * y), F.lit(b), lambda s, x: s + x) for w, b in models])

    def svm_predict(self, docs: DataFrame) -> DataFrame:
        """(doc_id, author) by one-versus-rest linear SVMs on the document vectors. Margins differ from those of other solvers; the classes seldom do."""
        rows, labels = self._features()
        models = self._svm(rows, labels)
        rows.unpersist()
        best = F.array_position("m", F.array_max("m"))
        return self.arrays(docs).select("doc_id", self._margins(rows, models).alias("m")).select("doc_id", F.element_at(F.array(*map(F.lit, labels)), best.cast("int")).alias("author"))

    def svm_probabilities(self, docs: DataFrame) -> DataFrame:
        """(doc_id, author, probability): Platt's sigmoids over margins of documents that weren't trained on (three folds), brought to a sum of 1."""
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        rows, labels = self._features()
        models = self._svm(rows, labels)
        held = None
        for fold in range(3):
            part = rows.where(F.col("fold") == fold)
            part = part.select("author", self._margins(part, self._svm(rows.where(F.col("fold") != fold), labels)).alias("m"))
            held = part if held is None else held.unionByName(part)
        held = written(held, "margins")
        sigmoids = []
        for k, a in enumerate(labels):
            one = held.select((F.col("author") == a).cast("double").alias("label"), array_to_vector(F.array(F.get("m", F.lit(k)))).alias("features"))
            fit = LogisticRegression(maxIter=200).fit(one)
            sigmoids.append((float(fit.coefficients[0]), float(fit.intercept)))
        rows.unpersist()
        p = [1 / (1 + F.exp(-(F.get("m", F.lit(k)) * w + b))) for k, (w, b) in enumerate(sigmoids)]
        out = self.arrays(docs).select("doc_id", self._margins(rows, models).alias("m")).select("doc_id", F.array(*p).alias("p"))
        total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
        return out.select("doc_id", total.alias("t"), F.posexplode("p").alias("i", "x")).select("doc_id", F.get(F.array(*map(F.lit, labels)), F.col("i")).alias("author"), (F.col("x") / F.nullif("t", F.lit(0.0))).alias("probability"))

    def hierarchical_clustering(self, method: str = "average", level: str = "author", max_items: int = 5000) -> tuple[np.ndarray, list]:
        """Linkage rows (a, b, distance, size) and the labels; the matrix of at most max_items items is on the driver."""
        if method == "ward" and self.distance_name != "euclidean":
            raise ValueError("ward needs euclidean distances")
        rows = self._named(level).limit(max_items + 1).collect()
        if len(rows) > max_items:
            raise ValueError(f"more than {max_items} items")
        rows.sort(key=lambda r: r["word"])
        x = np.array([r["vec"] for r in rows], float)
        return linkage(BLOCKS[self.distance_name](x, x), method), [r["word"] for r in rows]


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Agglomerative clustering by the Lance-Williams update."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), np.ones(n), []
    alive = np.ones(n, bool)
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(np.where(alive[:, None] & alive[None], d, np.inf))), n)
        i, j = min(i, j), max(i, j)
        h, si, sj = d[i, j], size[i], size[j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (si * d[i] + sj * d[j]) / (si + sj)
        elif method == "weighted":
            new = (d[i] + d[j]) / 2
        elif method == "ward":
            t = si + sj + size
            new = np.sqrt(np.maximum(0, ((si + size) * d[i] ** 2 + (sj + size) * d[j] ** 2 - size * h * h) / t))
        else:
            raise ValueError(f"unknown method {method!r}")
        out.append((*sorted((ids[i], ids[j])), h, si + sj))
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        ids[i], size[i] = n + step, si + sj
    return np.array(out)
