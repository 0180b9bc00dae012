"""Pairs within a window as packed numbers: against loops, and how little they send."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.operators import cooc, embeddings, pairs


def corpus(spark, seed=3, n=60):
    r = random.Random(seed)
    rows = [(i, [r.choice("abcdefghijklmnopqrstuvwxyz") * r.choice((1, 1, 2)) for _ in range(r.randrange(40))]) for i in range(n)] + [(n, None), (n + 1, ["only"]), (n + 2, ["a", None, "b", "a"])]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), [t for _, t in rows if t]


def looped(texts, left, right, weight=lambda k: 1):
    out = Counter()
    for t in texts:
        for i, a in enumerate(t):
            for j in range(max(0, i - left), min(len(t), i + right + 1)):
                if j != i and a is not None and t[j] is not None:
                    out[a, t[j]] += weight(abs(i - j))
    return out


def as_dict(df):
    rows = df.collect()
    out = {(r[0], r[1]): r[2] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def small(monkeypatch):
    """Many pieces, flushes, buckets and batches."""
    for name, value in (("TOKENS", 50), ("PAIRS", 200), ("BUCKET", 500), ("ROWS", 64)):
        monkeypatch.setattr(pairs, name, value)


@pytest.mark.parametrize("horizon", [(2, 3), (0, 1), (4, 0), (3, 3)])
def test_window_matrices_equal_loops(spark, small, horizon):
    docs, texts = corpus(spark)
    assert as_dict(cooc.cooc_matrix(docs, horizon=horizon)) == looped(texts, *horizon)


def test_glove_sums_of_long_and_short_windows(spark, small):
    docs, texts = corpus(spark)
    for window in (3, 30):  # beyond 22 places sums are of doubles
        want = looped(texts, window, window, lambda k: 1 / k)
        assert as_dict(embeddings.glove_cooc(docs, window)) == {k: pytest.approx(x) for k, x in want.items()}
    some = as_dict(embeddings.glove_cooc(docs, 3, 2.0))
    assert some.keys() == {k for k, x in looped(texts, 3, 3, lambda k: 1 / k).items() if x >= 2 - 1e-9}


def test_vocabulary_limits_keep_places(spark, small):
    docs, texts = corpus(spark)
    want = {(a, b): n for (a, b), n in looped(texts, 2, 3).items() if {a, b} <= {"a", "b", "cc"}}
    assert as_dict(cooc.cooc_matrix(docs, horizon=(2, 3), vocab=["a", "b", "cc", "none"])) == want
    assert as_dict(cooc.cooc_of_words(docs, ["a", "b", "cc", "none"], horizon=(2, 3))) == want


def test_ppmi_and_sums_without_the_matrix(spark, small):
    docs, _ = corpus(spark)
    matrix = cooc.cooc_matrix(docs, horizon=(2, 3))
    assert as_dict(cooc.window_ppmi(docs, (2, 3), 0.75)) == {k: pytest.approx(x) for k, x in as_dict(cooc.to_ppmi(matrix, 0.75)).items()}
    key = lambda rows: sorted(map(tuple, rows), key=str)
    assert key(cooc.window_sums_and_cells(docs, (2, 3)).collect()) == key(cooc.all_sums(matrix).collect())
    empty = docs.where("doc_id < 0")
    assert cooc.window_ppmi(empty).count() == 0 and cooc.cooc_matrix(empty).count() == 0
    assert [tuple(r) for r in cooc.window_sums_and_cells(empty).collect()] == [(None, None, None, 0)]


def test_words_with_one_hash_get_another_key(monkeypatch):
    own = pairs.hashed
    monkeypatch.setattr(pairs, "hashed", lambda w, key: np.zeros(len(w), np.uint64) if key.endswith("0") else own(w, key))
    x = pairs.Lexicon.of(pa.array(["a", "b", "c"]), np.array([1, 3, 2]))
    assert x.words.to_pylist() == ["b", "c", "a"] and x.key.endswith("1")
    assert pairs.places(pa.array(["c", None, "z", "a"]), x.hashes, x.places, x.key).tolist() == [1, -1, -1, 2]


def test_packed_numbers_come_back():
    a, b, c = np.array([0, 5, 70000, 1 << 40]), np.array([1, 0, 0, 255]), np.array([0.5, 1 / 3, 0, 1e9])
    got = pairs.unpacked(pairs.packed(a, b, c), [np.int64, np.int64, np.float64])
    assert all((x == y).all() for x, y in zip(got, (a, b, c)))


def test_pairs_travel_once_and_in_few_bytes(spark):
    """What shuffles for a pair was two words, a sum and the row around them, for each order."""
    r = np.random.default_rng(0)
    text = [" ".join(f"word{k}" for k in r.zipf(1.3, 500) % 5000) for _ in range(100)]
    docs = spark.createDataFrame([(t.split(),) for t in text], "tokens array<string>")
    sent, own = [], pairs.packed
    high, low = np.sort(r.integers(0, 5000, 100_000)), r.integers(0, 5000, 100_000)
    sent.append(len(own(np.diff(high, prepend=0), low, np.ones(100_000, np.int64))))
    assert sent[0] < 4 * 100_000
    plan = embeddings.glove_cooc(docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan and plan.count("Exchange") == 1


def test_document_matrix_equals_loops_and_sends_no_rows_of_pairs(spark, small):
    docs, texts = corpus(spark)
    want = Counter()
    for t in texts:
        n = Counter(w for w in t if w is not None)
        want.update({(a, b): n[a] * n[b] for a in n for b in n if a != b})
    out = cooc.cooc_matrix(docs, method="document")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert as_dict(out) == want
    assert "Generate" not in plan and "collect_list" not in plan and plan.count("Exchange") == 1
    assert cooc.cooc_matrix(docs.where("doc_id < 0"), method="document").count() == 0


def test_texts_are_read_once_for_collocates(spark, small, monkeypatch):
    """They were tokenized for each of the counts that tables of collocates are made of."""
    from corpusmill.operators import collocation

    docs, texts = corpus(spark)
    passes, own = [], collocation.window_hits
    monkeypatch.setattr(collocation, "window_hits", lambda *a: passes.append(a[1:]) or own(*a))
    out = collocation.contingency(docs, ["a", "b", "none"], "window", (1, 4), None)
    assert passes == [(["a", "b", "none"], 1, 4)] and "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["target"], r["collocate"]): (r["a"], r["b"], r["c"], r["d"]) for r in out.collect()}
    n, a, total = Counter(w for t in texts for w in t), Counter(), sum(map(len, texts))
    for t in texts:
        for i, w in enumerate(t):
            a.update((x, w) for x in ("a", "b") if w not in (x, None) and x in t[max(0, i - 4) : i + 2])
    seen = Counter()
    for (x, _), k in a.items():
        seen[x] += k
    assert got == {(x, w): (k, seen[x] - k, n[w] - k, total - n[x] - seen[x] - n[w] + k) for (x, w), k in a.items()}
