"""Golden cases with hand-derived values, and brute force on random token lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats, tokens as T, vectors as V
from corpusmill.operators import collocation, cooc, corpus, keyness, lexical, normalize, reuse, segment
from corpusmill.operators.stylometry import Stylometry, linkage


@pytest.fixture
def corpus_of(spark):
    def make(lists, **columns):
        rows = [(i, t, *(v[i] for v in columns.values())) for i, t in enumerate(lists)]
        return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>" + "".join(f", {k} string" for k in columns))

    return make


def cells(df):
    return {(r["target"], r["collocate"]): (r["a"], r["b"], r["c"], r["d"]) for r in df.collect()}


@pytest.mark.parametrize("tokens, horizon, want", [("w0 T w1 w2 w3 w4", (0, 3), "w1 w2 w3"), ("w4 w3 w2 w1 T w0", (3, 0), "w1 w2 w3"), ("v3 v2 v1 T w1 w2 w3 w4", (2, 3), "v1 v2 w1 w2 w3")])
def test_horizon_is_relative_to_the_target(corpus_of, tokens, horizon, want):
    assert {c for _, c in cells(collocation.contingency(corpus_of([tokens.split()]), "T", horizon=horizon))} == set(want.split())


def test_repeated_targets_count_a_place_once(corpus_of):
    got = cells(collocation.contingency(corpus_of([x.split() for x in ("dog dog cat", "dog bird", "cat dog")]), "dog", horizon=1))
    assert got["dog", "cat"][0] == 2 and got["dog", "cat"][0] + got["dog", "cat"][2] == 2


def test_window_cells_equal_brute_force(corpus_of):
    r = random.Random(0)
    lists = [[r.choice("abcde") for _ in range(r.randrange(0, 12))] for _ in range(40)]
    left, right = 2, 1
    want = {}
    for t in "ab":
        seen = {}
        for s in lists:
            for i, w in enumerate(s):
                if w != t and any(s[j] == t for j in range(max(0, i - right), min(len(s), i + left + 1)) if j != i):
                    seen[w] = seen.get(w, 0) + 1
        total, count = sum(map(len, lists)), {w: sum(s.count(w) for s in lists) for w in "abcde"}
        for w, a in seen.items():
            b, c = sum(seen.values()) - a, count[w] - a
            want[t, w] = (a, b, c, total - count[t] - a - b - c)
    assert cells(collocation.contingency(corpus_of(lists), ["a", "b"], horizon=(left, right))) == want


def test_sentence_statistics(corpus_of):
    lists = [["dog", "cat"]] * 3 + [["dog", "x"]] * 3 + [["cat", "y"]] * 2 + [["z"]] * 2
    r = collocation.find_collocates(corpus_of(lists), "dog", method="sentence").where("collocate = 'cat'").first()
    assert (r["obs_local"], r["obs_global"], r["exp_local"], r["ratio_local"]) == (3, 5, 3.0, 1.0)
    none = collocation.find_collocates(corpus_of(lists), "absent")
    assert none.count() == 0 and none.columns[0] == "target"


def test_filters_and_truncation(corpus_of):
    d = corpus_of([["t", "a"] * 5 + ["tail"] * 300 + ["t", "zz"]])
    assert "zz" not in {c for _, c in cells(collocation.contingency(d, "t", horizon=1))}
    assert "zz" in {c for _, c in cells(collocation.contingency(d, "t", horizon=1, max_length=None))}
    with pytest.raises(ValueError):
        collocation.find_collocates(d, "t", filters={"nonsense": 1})
    with pytest.raises(TypeError):
        collocation.find_collocates(d, "t", filters=["min_obs_local"])


def test_kwic_and_comparison(corpus_of):
    d = corpus_of([[], ["a", "b", "T", "c"], ["T", "z"]])
    got = [(r["left"], r["right"], r["doc_index"], r["position"]) for r in collocation.kwic(d, "T", horizon=1).collect()]
    assert got == [("b", "c", 0, 2), ("", "z", 1, 0)]
    assert [r["position"] for r in collocation.kwic(d, "T", max_results=1).collect()] == [2]
    c = collocation.compare_collocates(corpus_of([["T", "x"]]), corpus_of([["T", "y"]]), "T", horizon=1).collect()
    assert {(r["collocate"], r["status"]) for r in c} == {("x", "disappeared"), ("y", "appeared")}


def test_cooc(corpus_of):
    m = {(r[0], r[1]): r[2] for r in cooc.cooc_matrix(corpus_of([list("abcd")]), horizon=(0, 1)).collect()}
    assert m["a", "b"] == 1 and ("b", "a") not in m
    assert cooc.get(cooc.cooc_matrix(corpus_of([list("abxab")]), horizon=1), "a", "b") == 2
    gap = cooc.cooc_matrix(corpus_of([["a", "x", "x", "b"]]), horizon=2, vocab=["a", "b"])
    assert cooc.lookup(gap, "a").count() == 0
    doc = {(r[0], r[1]): r[2] for r in cooc.cooc_matrix(corpus_of([["a", "a", "b"]]), method="document").collect()}
    assert doc == {("a", "b"): 2, ("b", "a"): 2}
    with pytest.raises(ValueError):
        cooc.to_ppmi(gap, 0)
    assert cooc.to_dense(cooc.cooc_matrix(corpus_of([["a", "b"]]), horizon=1)).orderBy("row_word").collect()[0]["b"] == 1


def test_keyness_min_count(spark):
    n = {"both": (5, 5), "short_b": (5, 4), "only_a": (5, 0), "only_b": (0, 5)}
    rows = [(s, w) for w, c in n.items() for s, k in zip("ab", c) for _ in range(k)]
    d = spark.createDataFrame(rows, "side string, token string")
    words = lambda m: {r["word"] for r in keyness.compare_corpora(d, filters={"min_count": m}).collect()}
    assert words(5) == {"both"} and words((5, 0)) == {"both", "short_b", "only_a"} and words((0, 5)) == {"both", "only_b"}
    assert keyness.compare_corpora(d).where("word = 'only_a'").first()["rel_ratio"] == math.inf
    with pytest.raises(ValueError):
        keyness.compare_corpora(d, filters={"max_p": 0.1}, correction="bonferroni")


def exact_fisher(a, b, c, d, alternative):
    r, k, n = a + b, a + c, a + b + c + d
    p = {x: math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r) for x in range(max(0, r + k - n), min(r, k) + 1)}
    if alternative == "greater":
        return sum(v for x, v in p.items() if x >= a)
    if alternative == "less":
        return sum(v for x, v in p.items() if x <= a)
    return sum(v for v in p.values() if v <= p[a] * (1 + 1e-8))


def test_fisher():
    r = random.Random(1)
    for _ in range(150):
        t = [r.randrange(30) for _ in range(4)]
        for alt in ("greater", "less", "two-sided"):
            if sum(t):
                assert stats.fisher_p(*t, alt) == pytest.approx(min(1, exact_fisher(*t, alt)), abs=1e-9)
    assert stats.fisher_p(0, 0, 0, 0) == 1.0
    assert 0 <= stats.fisher_p(5000, 200_000, 4000, 10_000_000) < 1e-300


def test_table_statistics_and_corrections(spark):
    d = spark.createDataFrame([(10, 10, 10, 10), (0, 0, 0, 0), (12, 5, 7, 20)], "a long, b long, c long, d long")
    c = [F.col(x) for x in "abcd"]
    rows = d.select(stats.g2_stat(*c), stats.chi2_stat(*c), stats.chi2_stat(*c, yates=True)).collect()
    assert rows[0][0] == pytest.approx(0) and math.isnan(rows[1][1]) and math.isnan(rows[1][0])
    assert rows[2][1] == pytest.approx(44 * (12 * 20 - 5 * 7) ** 2 / (17 * 27 * 19 * 25))
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p_value double")
    adjusted = lambda m: [round(r[1], 4) for r in stats.correct(p, m).select("p_value", "adjusted_p_value").orderBy("p_value").collect()]
    assert adjusted("bonferroni") == [0.03, 0.09, 0.12] and adjusted("fdr_bh") == [0.03, 0.04, 0.04]


def test_lexical(corpus_of):
    d = corpus_of([["a", "a", "a", "b", "b", "c"], [], ["x"]])
    r = {x["doc_id"]: x for x in lexical.vocabulary_stats(d).collect()}
    assert r[0]["yule_k"] == pytest.approx(10_000 * (14 - 6) / 36) and r[1]["token_count"] == 0 and r[2]["yule_k"] == 0
    rnd = random.Random(2)
    words = [rnd.choice("abcdef") for _ in range(50)]
    m = lexical.mattr(corpus_of([words, ["a"]]), 7).orderBy("doc_id").collect()
    assert m[0]["mattr"] == pytest.approx(sum(len(set(words[i : i + 7])) / 7 for i in range(44)) / 44) and m[1]["mattr"] is None
    f = {r["token"]: r["rel_freq"] for r in lexical.relative_frequencies(corpus_of([["a", "a", "b", "c"]])).collect()}
    assert f == {"a": 0.5, "b": 0.25, "c": 0.25}


def test_vector_functions(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [1.5, 2.5, 3.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 0.0, 0.0])], "a array<double>, b array<double>")
    got = d.select(V.burrows_delta(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 0.5 and got[1][1] == 1.0 and got[2][1] == 1.0


def test_stylometry(corpus_of):
    r = random.Random(3)
    text = lambda w: [r.choice(w) for _ in range(80)]
    d = corpus_of([text("aaab"), text("aaab"), text("bbba"), text("bbba")], author=["x", "x", "y", "y"])
    m = Stylometry(n_features=2)
    m.fit_transform(d)
    guess = {x["doc_id"]: x["author"] for x in m.predict_author(d).collect()}
    assert guess == {0: "x", 1: "x", 2: "y", 3: "y"}
    assert sum(x["votes"] for x in m.bootstrap_predict(d, 4).where("doc_id = 0").collect()) == 4
    with pytest.raises(ValueError):
        Stylometry(transform="none")
    import numpy as np

    z = linkage(np.array([[0, 1, 4.0], [1, 0, 5], [4, 5, 0]]), "average")
    assert z.tolist() == [[0, 1, 1, 2], [2, 3, 4.5, 3]]


def test_chunks_ngrams_segments(spark):
    d = spark.createDataFrame([("abcdefghij", ["a", "b", "c"]), ("", [])], "s string, t array<string>")
    got = d.select(T.chunks(F.col("s"), 5, text=True), T.ngrams(F.col("t"), 1, 2), T.chunks(F.col("t"), 2, 0.5)).collect()
    assert got[0][0] == ["abcde", "fghij"] and got[0][1] == ["a", "b", "c", "a b", "b c"] and got[0][2] == [["a", "b"], ["b", "c"]]
    assert got[1][0] == [] and got[1][1] == []
    s = spark.createDataFrame([(1, "Hi there! Go. \n Yes")], "doc_id int, text string")
    assert [r["tokens"] for r in segment.segment(s, strategy="sentence", how="blanks").orderBy("unit").collect()] == [["Hi", "there!"], ["Go."], ["Yes"]]
    assert [r["tokens"] for r in segment.segment(spark.createDataFrame([(1, "我爱北京")], "doc_id int, text string"), how="dictionary", dictionary=["北京"]).collect()] == [["我", "爱", "北京"]]
    t = spark.createDataFrame([(list("abcde"), list("BESBE"))], "w array<string>, t array<string>")
    assert t.select(segment.merge_tags(F.col("w"), F.col("t"))).first()[0] == ["ab", "c", "de"]
    assert segment.large_pieces("a" * 70 + "。" + "b" * 60, 100) == ["a" * 70 + "。", "b" * 60]


def test_normalize(spark):
    d = spark.createDataFrame([("  Ａb１ \t x,\n\n y  ",)], "s string")
    run = lambda o: d.select(normalize.normalize(F.col("s"), o)).first()[0]
    assert run({"whitespace": "collapse", "letters": "half", "numbers": "half", "punctuation": "full"}) == "Ab1 x，\ny"
    assert run({"whitespace": "remove", "unicode": "NFKC"}) == "Ab1x,y" and run({}) == d.first()[0]
    assert normalize.requoted("\"a 'b' c\" “d”", "corner") == "「a 『b』 c」 「d」"
    with pytest.raises(ValueError):
        run({"whitespace": "other"})


def test_text_reuse(corpus_of):
    d = corpus_of([list("ABCDEFGHIJKL"), list("ABCDEFGHIJKL"), list("zzABCDEFxHIJKLzz")])
    top = reuse.find_shared_sequences(d, n=3, min_length=10, min_similarity=0.8).collect()
    assert (top[0]["doc_a"], top[0]["doc_b"], top[0]["similarity"], top[0]["passage_a"]) == (0, 1, 1.0, "ABCDEFGHIJKL")
    twice = reuse.find_shared_sequences(corpus_of([list("ABCDEFGHIJ") * 2]), n=3, min_length=8, within_documents=True).collect()
    assert twice and all(r["doc_a"] == r["doc_b"] and r["pos_a"] < r["pos_b"] for r in twice)
    assert reuse.find_shared_sequences(corpus_of([]), n=3).count() == 0
    assert reuse.banded_distance(list("kitten"), list("sitting"), 3) == 3 and reuse.banded_distance(list("abc"), list("xyz"), 1) == 2


def test_balanced_and_vocabulary(corpus_of, spark):
    d = corpus_of([["a"] * 5, ["b"] * 5, ["c"] * 7], period=["p", "p", "q"])
    got = {r["doc_id"]: len(r["tokens"]) for r in corpus.balanced(d).collect()}
    assert got == {0: 5, 1: 2, 2: 7}
    v = {r["token"]: (r["n"], r["doc_freq"]) for r in corpus.limited_vocabulary(d, vocab=["a", "zz"]).collect()}
    assert v == {"a": (5, 1), "zz": (0, 0)}
    with pytest.raises(ValueError, match="cannot be empty"):
        corpus.n_texts(corpus_of([]))
    with pytest.raises(ValueError, match="all input"):
        corpus.n_texts(corpus_of([[]]))
