"""Models that are saved and loaded, orders by ranges, probabilities, adapters and lookups."""

import random
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.operators import corpus, embeddings, reuse, segment, topics, vectors
from corpusmill.operators.stylometry import Stylometry
from corpusmill.plans import shared
from corpusmill.plans.order import running_sum
from corpusmill.sources import texts


@pytest.fixture
def two_topics(spark):
    r = random.Random(0)
    rows = [(i, [r.choice(("abc", "xyz")[i % 2]) for _ in range(30)] + ["both"] * 2, ("old", "new")[i // 20]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, period string")


def test_shared_tables_need_a_folder_on_a_cluster():
    class Conf:
        def __init__(self, **have):
            self.have = have

        def get(self, name, default=None):
            return self.have.get(name, default)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(types.SimpleNamespace(conf=Conf(**{"spark.master": master})))
    assert shared.shared_dir(types.SimpleNamespace(conf=Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"}))) == "hdfs:///x"


def test_running_sums_equal_a_loop(spark):
    r = random.Random(1)
    rows = [(r.choice(["p", "q", None]), i, r.randrange(9)) for i in range(400)]
    got = {(x["k"], x["i"]): x["before"] for x in running_sum(spark.createDataFrame(rows, "k string, i int, v long"), ["i"], "v", ["k"]).collect()}
    assert got == {(k, i): sum(v for a, j, v in rows if a == k and j < i) for k, i, _ in rows}
    numbers = running_sum(spark.createDataFrame(rows, "k string, i int, v long"), ["i"], out="n").collect()
    assert all(x["n"] == x["i"] for x in numbers)


def test_false_discovery_rates_equal_a_loop(spark):
    r = random.Random(2)
    p = [round(r.random() ** 3, 3) for _ in range(300)]
    got = [x["adjusted_p_value"] for x in stats.correct(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double"), "fdr_bh").orderBy("i").collect()]
    order = sorted(range(300), key=lambda i: p[i])
    want, least = [0.0] * 300, 1.0
    for rank in range(300, 0, -1):
        least = min(least, p[order[rank - 1]] * 300 / rank)
        want[order[rank - 1]] = least
    assert got == pytest.approx(want)
    assert stats.correct(spark.createDataFrame([], "p_value double"), "fdr_bh").count() == 0


def test_banded_distances_equal_the_whole_table():
    r = random.Random(3)
    pairs = [([r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]) for _ in range(300)]

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for band in (1, 3):
        got = reuse.banded_distances([np.array(a, int) for a, _ in pairs], [np.array(b, int) for _, b in pairs], band, cells=64)
        assert got.tolist() == [min(whole(a, b), band + 1) for a, b in pairs]


def test_models_are_saved_and_loaded(two_topics, spark, tmp_path):
    m = embeddings.Word2Vec(size=6, min_count=1, epochs=1, workers=2).train(two_topics)
    m.save(spark, str(tmp_path / "w2v"))
    n = embeddings.Word2Vec.load(spark, str(tmp_path / "w2v"))
    assert n.words == m.words and np.array_equal(n.w, m.w) and np.array_equal(n.c, m.c) and n.losses == m.losses
    n.train(two_topics)
    assert len(n.losses) == 2
    lda = topics.LDA(2, alpha=0.1, iterations=2, estimate_alpha=1).fit(two_topics)
    lda.save(spark, str(tmp_path / "lda"))
    again = topics.LDA.load(spark, str(tmp_path / "lda"))
    assert again.words == lda.words and np.array_equal(again.n_wt, lda.n_wt) and again.perplexity() == pytest.approx(lda.perplexity())
    xy = lda.topic_map(spark).collect()
    assert len(xy) == 2 and sum(r["share"] for r in xy) == pytest.approx(1)


def test_temporal_reference_change_and_counts(two_topics, spark, tmp_path):
    t = embeddings.TempRefWord2Vec(["both"], size=6, min_count=1, epochs=2, workers=2, sample=0).train_periods(two_topics, periods=["old", "new"], order="doc_id")
    change = t.semantic_change(spark, "both").collect()
    at = {w: t.w[i] / np.linalg.norm(t.w[i]) for i, w in enumerate(t.words) if np.linalg.norm(t.w[i])}
    assert {r["word"] for r in change} == set("abcxyz")
    for r in change:
        assert r["change"] == pytest.approx(float(at["both_new"] @ at[r["word"]] - at["both_old"] @ at[r["word"]]), abs=1e-5)
    assert t.vocabulary_of("old").where("word = 'both'").first()["n"] == 40
    with pytest.raises(ValueError):
        t.semantic_change(spark, "a")
    t.save(spark, str(tmp_path / "t"))
    assert embeddings.TempRefWord2Vec.load(spark, str(tmp_path / "t")).semantic_change(spark, "both").count() == 6


def test_joint_training_pulls_periods_together_and_decays(two_topics):
    gap = {}
    for pull in (0.0, 8.0):
        d = embeddings.DynamicWord2Vec("joint", pull=pull, align=False, size=6, min_count=1, epochs=3, workers=1, sample=0, alpha=0.05).train(two_topics, ["old", "new"])
        a, b = (m.w for m in d.models.values())
        gap[pull] = np.abs(a - b).mean()
        assert all(len(m.losses) == 3 for m in d.models.values())
    assert gap[8.0] < gap[0.0]


def test_proportional_and_balanced_sampling(spark):
    d = spark.createDataFrame([(i, "p" if i < 6 else "q", ["w"] * 4) for i in range(9)], "doc_id bigint, period string, tokens array<string>")
    n = lambda **how: {r["period"]: r["n"] for r in corpus.balanced(d, **how).groupBy("period").agg(F.sum(F.size("tokens")).alias("n")).collect()}
    assert n() == {"p": 12, "q": 12} and n(how="proportional") == {"p": 24, "q": 12} and n(how="proportional", share=0.5) == {"p": 12, "q": 6}


def test_svm_probabilities_and_queries_by_tokens(spark):
    r = random.Random(4)
    text = lambda w: [r.choice(w) for _ in range(60)]
    d = spark.createDataFrame([(i, text(("aaab", "bbba")[i % 2]), "xy"[i % 2]) for i in range(24)], "doc_id bigint, tokens array<string>, author string")
    m = Stylometry(n_features=2, classifier="svm")
    m.fit_transform(d)
    p = {}
    for row in m.predict_confidence(d).collect():
        p.setdefault(row["doc_id"], {})[row["author"]] = row["confidence"]
    assert all(sum(x.values()) == pytest.approx(1) and x["xy"[i % 2]] > 0.5 for i, x in p.items())
    delta = Stylometry(n_features=2, distance="burrows_delta")
    delta.fit_transform(d)
    tokens = d.where("doc_id = 0").first()["tokens"]
    near = delta.most_similar(tokens, 3).collect()
    assert near[0]["doc_id"] == 0 and near[0]["distance"] == pytest.approx(0)
    assert 0 not in {x["doc_id"] for x in delta.most_similar(0, 5).collect()}
    assert delta.most_similar(["b"] * 5, 1, level="author").first()["author"] == "y"
    assert delta.distance(0, tokens) == pytest.approx(0) and delta.similarity(0, 1) == pytest.approx(1 / (1 + delta.distance(0, 1)))
    with pytest.warns(UserWarning, match="no document"):
        delta.transform(spark.createDataFrame([(1, ["zzz"])], "doc_id bigint, tokens array<string>"))
    z, names = delta.hierarchical_clustering("average", "document")
    assert len(z) == 23 and names == list(range(24))
    inst = Stylometry(n_features=2, mode="instance")
    inst.fit_transform(d)
    assert {x["doc_id"]: x["author"] for x in inst.predict_author(d, 3).collect()} == {i: "xy"[i % 2] for i in range(24)}


def test_nearest_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_A_BLOCK", 7)
    x = np.random.default_rng(5).normal(size=(40, 5))
    x[7] = x[3]
    v = spark.createDataFrame([(f"w{i:02}", [float(a) for a in e]) for i, e in enumerate(x)], "word string, vec array<double>").repartition(3)
    for metric, far in vectors.BLOCKS.items():
        d = far(x, x)
        np.fill_diagonal(d, np.inf)
        want = {f"w{i:02}": [f"w{j:02}" for j in sorted(range(40), key=lambda j: (round(d[i, j], 9), j))[:4]] for i in range(40)}
        got = {}
        for r in vectors.most_similar(v, v, 4, metric).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r["word"])
        assert got == want
    own = vectors.most_similar(v, v, 1, lambda a, b: a @ b.T).collect()
    assert len(own) == 40
    coords, axes, share = vectors.pca(v, 2, loadings=True)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(np.sort(share)[::-1], (s**2 / (s**2).sum())[:2]) and coords.count() == 40
    assert vectors.cross_space(v, v.withColumn("word", F.concat("word", F.lit("x"))), ["w00"], 1).first()["word"] == "w00x"


def test_adapters_import_on_the_worker_and_tags_exclude(spark, monkeypatch):
    fake = types.ModuleType("jieba")
    fake.added = []
    fake.add_word = lambda *a: fake.added.append(a)
    fake.cut = lambda t: iter(t.split("_"))
    posseg = types.ModuleType("jieba.posseg")
    posseg.cut = lambda t: [types.SimpleNamespace(word=w, flag="n" if w.isalpha() else "x") for w in t.split("_")]
    fake.posseg = posseg
    monkeypatch.setitem(sys.modules, "jieba", fake)
    monkeypatch.setitem(sys.modules, "jieba.posseg", posseg)
    assert segment.REGISTRY["jieba"](user_dict={"word": "n"})(["a_b"]) == [["a", "b"]] and fake.added == [("word", None, "n")]
    assert segment.REGISTRY["jieba"](tags=True)(["a_1"]) == [[("a", "n"), ("1", "x")]]
    segment.register("tagging", lambda: lambda found: [[(w, "P" if w == "." else "W") for w in t.split()] for t in found])
    d = spark.createDataFrame([(1, "a . b")], "doc_id int, text string")
    assert segment.segment(d, how="tagging", excluded_pos=["P"]).first()["tokens"] == ["a", "b"]
    assert segment.segment(d, how="tagging").first()["tokens"] == ["a", ".", "b"]
    with pytest.raises(ValueError):
        segment.segment(d, how="words", excluded_pos=["P"])
    assert set(segment.REGISTRY) >= {"spacy", "jieba", "pkuseg", "bert", "hanlp", "dictionary"}
    assert segment.merged_words(list("abcde"), list("BESBE")) == ["ab", "c", "de"]


def test_user_dictionaries_and_word_lists(tmp_path):
    (tmp_path / "d.txt").write_text("one\n\ntwo 5 n\n")
    assert segment.user_words(str(tmp_path / "d.txt")) == [("one",), ("two", "5", "n")]
    assert segment.user_words({"a": "n"}) == [("a", "n")] and segment.user_words(["a", ("b", 3)]) == [("a",), ("b", 3)]
    assert "the" in texts.bundled_stopwords("en") and "zh" in texts.stopword_languages()
    with pytest.raises(ValueError):
        texts.bundled_stopwords("xx")


def test_binary_vectors(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 2.5]), ("日本", [-1.0, 0.5])], "word string, vec array<float>")
    texts.write_word2vec_binary(v, str(tmp_path / "v.bin"))
    assert sorted(map(tuple, texts.read_word2vec_binary(spark, str(tmp_path / "v.bin")).collect())) == [("a", [1.0, 2.5]), ("日本", [-1.0, 0.5])]
