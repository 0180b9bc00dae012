"""Models: invariants and learning, not exact numbers."""

import random

import numpy as np
import pytest

from corpusmill.operators import embeddings, topics, vectors
from corpusmill.sources import texts


@pytest.fixture
def two_topics(spark):
    r = random.Random(0)
    rows = [(i, [r.choice(("abc", "xyz")[i % 2]) for _ in range(30)], ("old", "new")[i % 2]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, period string")


def test_lda(two_topics, spark):
    m = topics.LDA(2, alpha=0.1, iterations=6).fit(two_topics)
    theta = {r["doc_id"]: r["theta"] for r in m.document_topics().collect()}
    assert all(sum(t) == pytest.approx(1) for t in theta.values())
    side = [int(np.argmax(theta[i])) for i in range(40)]
    assert len(set(side[::2])) == 1 and len(set(side[1::2])) == 1 and side[0] != side[1]
    assert m.n_wt.sum() == 40 * 30 and m.phi().sum(1) == pytest.approx(np.ones(2))
    assert m.perplexity() < 6
    new = spark.createDataFrame([(1, ["a", "b"]), (2, ["unknown"])], "doc_id bigint, tokens array<string>")
    got = {r["doc_id"]: r["theta"] for r in m.inference(new, 3).collect()}
    assert got[2] == [0.5, 0.5] and sum(got[1]) == pytest.approx(1)


def test_lda_gives_every_document_a_theta(spark):
    d = spark.createDataFrame([(1, ["a", "a"]), (2, ["rare"]), (3, []), (4, None)], "doc_id bigint, tokens array<string>")
    got = {r["doc_id"]: r["theta"] for r in topics.LDA(2, iterations=1, min_word_count=2, max_vocab=None).fit(d).document_topics().collect()}
    assert got.keys() == {1, 2, 3, 4} and got[2] == got[3] == got[4] == [0.5, 0.5] and sum(got[1]) == pytest.approx(1)


def test_registered_trainings_have_no_cap(spark, monkeypatch):
    from corpusmill.plans import queries

    import inspect

    for cls in (topics.LDA, embeddings.Word2Vec, embeddings.GloVe):
        assert inspect.signature(cls.__init__).parameters["max_vocab"].default is None
    made = []

    class Spy:
        def __init__(self, *a, **how):
            made.append(how)

        fit = train = lambda self, docs: self
        document_topics = vectors = lambda self, *a: None

    monkeypatch.setattr(queries, "docs", lambda s, d: None)
    for module, name in ((topics, "LDA"), (embeddings, "Word2Vec"), (embeddings, "GloVe")):
        monkeypatch.setattr(module, name, Spy)
    for name in ("lda_fit", "w2v_train", "glove_train"):
        queries.QUERIES[name][0](spark, "")
    assert all(how.get("max_vocab") is None and how.get("min_count", 5) == 5 and how.get("min_doc_count", 1) == 1 for how in made)
    assert made[0]["iterations"] == 100


def test_svm_is_trained_to_convergence(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from corpusmill.operators.stylometry import Stylometry

    made, fit = [], LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, rows: made.append((self.getMaxIter(), self.getTol())) or fit(self, rows))
    d = spark.createDataFrame([(i, ["a"] * (3 + i) + ["b"] * (9 - i), "xy"[i > 3]) for i in range(8)], "doc_id bigint, tokens array<string>, author string")
    m = Stylometry(n_features=2)
    m.fit_transform(d)
    assert {r["doc_id"]: r["author"] for r in m.svm_predict(d).collect()} == {i: "xy"[i > 3] for i in range(8)}
    assert made and all(n >= 100 and tol <= 1e-6 for n, tol in made)


def test_assignment():
    s = np.array([[0.9, 0.8, 0.0], [0.95, 0.1, 0.0], [0.0, 0.2, 0.3]])
    assert topics.assign(s) == [(0, 1), (1, 0), (2, 2)]


def test_word2vec_learns(two_topics, spark):
    m = embeddings.Word2Vec(size=8, min_count=1, epochs=4, sample=0, workers=2, alpha=0.1, seed=2).train(two_topics)
    assert m.losses[-1] < m.losses[0]
    w = m.w / np.linalg.norm(m.w, axis=1, keepdims=True)
    at = {x: i for i, x in enumerate(m.words)}
    assert w[at["a"]] @ w[at["b"]] > w[at["a"]] @ w[at["x"]]
    top = vectors.most_similar(m.vectors(spark).where("word = 'a'"), m.vectors(spark), 2).collect()
    assert {r["word"] for r in top} == {"b", "c"}


def test_glove_and_vector_files(two_topics, spark, tmp_path):
    m = embeddings.GloVe(size=4, min_count=1, epochs=4).train(two_topics)
    assert m.losses[-1] < m.losses[0]
    for form in ("glove", "word2vec"):
        texts.write_vectors(m.vectors(spark), str(tmp_path / form), form)
        assert texts.read_vectors(spark, str(tmp_path / form)).count() == 6


def test_temporal_models(two_topics, spark):
    t = embeddings.TempRefWord2Vec(["a", "x"], size=4, min_count=1, epochs=1, workers=2).train_periods(two_topics)
    assert {"a_old", "x_new"} <= set(t.words)
    for mode in ("sequential", "joint"):
        d = embeddings.DynamicWord2Vec(mode, size=4, min_count=1, epochs=1, workers=2).train(two_topics, ["old", "new"])
        assert d.vectors(spark).count() == 12


def test_procrustes_recovers_a_rotation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    frame = lambda m: spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(m)], "word string, vec array<double>")
    out, r = vectors.align_vectors(frame(x), frame(x @ q))
    assert np.allclose(r, q, atol=1e-8)


def test_sources_and_streaming(spark, tmp_path):
    from corpusmill.streaming.counts import streaming_word_counts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the cat\n\n the dog \n")
    assert [r["tokens"] for r in texts.read_lines(spark, str(tmp_path / "in")).collect()] == [["the", "cat"], ["the", "dog"]]
    stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    q = streaming_word_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["token"]: r["n"] for r in spark.table("counts").collect()} == {"the": 2, "cat": 1, "dog": 1}


def test_encodings_and_stopwords(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("中文文本".encode("utf-8"))
    (tmp_path / "t" / "b.txt").write_bytes("中文文本".encode("gb18030"))
    assert {r["text"] for r in texts.read_texts(spark, str(tmp_path / "t")).collect()} == {"中文文本"}
    assert texts.detect_encoding(("x" + "中" * 4000).encode("utf-8")) == "utf-8"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "zh_a.txt").write_text("的\n 了 \n\n")
    (tmp_path / "s" / "zh_b.txt").write_text("的\n也\n")
    paths = texts.stopwords_of(str(tmp_path / "s"), "zh")
    assert {r["word"] for r in texts.read_stopwords(spark, paths).collect()} == {"的", "了", "也"}
    with pytest.raises(ValueError):
        texts.stopwords_of(str(tmp_path / "s"), "xx")


def test_steps_are_added_by_row(spark):
    """By a row's first steps, then its second ones, and so on: as one by one, and in a fraction of the time."""
    import time

    rng = np.random.default_rng(0)
    at, rows, scale = rng.zipf(1.3, (2000, 6)) % 50_000, rng.random((2000, 100)).astype(np.float32), rng.random((2000, 6)).astype(np.float32)
    want = np.zeros((50_000, 100))
    steps = scale[:, :, None] * rows[:, None, :]
    began = time.perf_counter()
    np.add.at(want, at.reshape(-1), steps.reshape(-1, 100))
    slow, best = time.perf_counter() - began, np.inf
    for _ in range(5):
        began = time.perf_counter()
        place, total, times = embeddings.by_row(at, rows, scale)
        best = min(best, time.perf_counter() - began)
    assert len(set(place)) == len(place) and times.sum() == at.size and (times == np.bincount(at.reshape(-1))[place]).all()
    got = np.zeros_like(want)
    got[place] = total
    assert np.allclose(got, want, rtol=1e-4) and best < slow / 2
    one = embeddings.by_row(np.array([3]), np.ones((1, 2)))
    assert one[0].tolist() == [3] and one[1].tolist() == [[1, 1]] and one[2].tolist() == [1]


def test_glove_pairs_are_those_of_the_kept_words(spark, monkeypatch):
    """Distances close over rare words; each pair is trained on in both orders."""
    d = spark.createDataFrame([(["a", "rare", "b", "a"],), (["b", "a"],), (["c", "c"],)], "tokens array<string>")
    seen, own = {}, embeddings.written
    monkeypatch.setattr(embeddings, "written", lambda df, what: (out := own(df, what), seen.update({what: out.collect()}))[0])
    m = embeddings.GloVe(size=2, window=2, min_count=2, epochs=1).train(d)
    assert m.words == ["a", "b", "c"]
    assert {(m.words[r["i"]], m.words[r["j"]]): r["x"] for r in seen["pairs"]} == {("a", "b"): 3.0, ("b", "a"): 3.0, ("a", "a"): 1.0, ("c", "c"): 2.0}


def test_documents_swept_side_by_side_keep_their_counts(monkeypatch):
    """Counts that a part tells are those of its topics; a document alone draws as one token after the other."""
    import pandas as pd

    rng = np.random.default_rng(0)
    words = [rng.integers(0, 30, n).astype(np.int32) for n in rng.integers(1, 60, 200)]
    z = [rng.integers(0, 3, len(w)).astype(np.int32) for w in words]
    tally = lambda z: np.bincount(np.concatenate(words) * 3 + np.concatenate(z), minlength=90).reshape(30, 3).astype(float)
    n_wt, alpha = tally(z), np.array([0.5, 1.0, 2.0])

    def swept(share):
        monkeypatch.setattr(topics, "SHARE", share)
        out = list(topics._sweep(n_wt, alpha, 0.1, 5, False)([pd.DataFrame({"doc_id": range(200), "words": words, "z": z})]))
        heard = n_wt.copy()
        n, logs = topics._heard([(out[1]["sums"][0],)], heard)
        new = list(out[0]["z"])
        assert (heard == tally(new)).all() and n == 200 and [len(x) for x in new] == [len(w) for w in words]
        theta = np.stack([(np.bincount(x, minlength=3) + alpha) / (len(x) + alpha.sum()) for x in new])
        assert logs == pytest.approx(np.log(theta).sum(0))
        return new

    counts, totals = n_wt.copy(), n_wt.sum(0)
    want = {}
    for d in np.argsort([-len(w) for w in words], kind="stable"):
        draws, mine, n = np.random.default_rng([5, hash(int(d))]).random(len(words[d])), z[d].copy(), np.bincount(z[d], minlength=3).astype(float)
        for i, w in enumerate(words[d]):
            for step, t in ((-1, mine[i]), (1, None)):
                if t is None:
                    p = np.cumsum((counts[w] + 0.1) / (totals + 3.0) * (n + alpha))
                    t = mine[i] = int(np.searchsorted(p, draws[i] * p[-1], side="right"))
                counts[w, t], totals[t], n[t] = counts[w, t] + step, totals[t] + step, n[t] + step
        want[d] = mine
    alone = swept(1000)
    assert all((alone[d] == want[d]).all() for d in want)
    swept(4)
    swept(1)
