"""Registered queries against brute force on small tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.plans.queries import QUERIES

TEXTS = [("en", "The cat sat on the mat, the cat slept."), ("en", "A rare word stood once; the rest of it is of the common kind."), ("de", "Der Hund und die Katze und der Hund"), ("fr", ""), ("de", None)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, t, lang, f"src{i % 2}", None if t is None else len(t)) for i, (lang, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def words(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def test_relative_frequencies_of_all_words(spark, folder):
    want = Counter((lang, w) for lang, t in TEXTS for w in words(t))
    total = Counter(lang for lang, t in TEXTS for _ in words(t))
    got = {(r["lang"], r["token"]): (r["n"], r["rel_freq"]) for r in QUERIES["relative_frequencies"][0](spark, folder).collect()}
    assert got == {k: (n, pytest.approx(n / total[k[0]], abs=1e-8)) for k, n in want.items()}


def test_matrices_of_the_whole_vocabulary(spark, folder):
    run = lambda name: {(r[0], r[1]): r[2] for r in QUERIES[name][0](spark, folder).collect()}
    window, whole, glove = Counter(), Counter(), Counter()
    for _, t in TEXTS:
        w = words(t)
        for i, a in enumerate(w):
            window.update((a, b) for j, b in enumerate(w) if j != i and i - 2 <= j <= i + 3)
            whole.update((a, b) for b in w if b != a)
            for j, b in enumerate(w):
                if 0 < abs(i - j) <= 5:
                    glove[a, b] += 1 / abs(i - j)
    assert run("cooc_window") == window and run("cooc_document") == whole
    assert run("glove_cooc") == {k: pytest.approx(x, abs=1e-6) for k, x in glove.items()}
    row, col = Counter(), Counter()
    for (a, b), n in window.items():
        row[a] += n
        col[b] += n
    total = sum(c**0.75 for c in col.values())
    ppmi = {(a, b): math.log2(n * total / (row[a] * col[b] ** 0.75)) for (a, b), n in window.items()}
    assert run("ppmi") == {k: pytest.approx(x, abs=1e-4) for k, x in ppmi.items() if x > 0}
    assert run("cooc_sums") == {(a, None): n for a, n in row.items()} | {(None, b): n for b, n in col.items()} | {(None, None): sum(row.values())}


def test_vector_queries_ask_every_fiftieth_vector_against_all(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(130, 64))
    spark.createDataFrame([(i, [float(v) for v in e], i % 7) for i, e in enumerate(x)], "vec_id bigint, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    near = {}
    for r in QUERIES["cosine_topk"][0](spark, str(tmp_path)).collect():
        near.setdefault(r["query"], set()).add(r["word"])
    assert near == {i: set(np.argsort(-sim[i])[:5].tolist()) for i in (0, 50, 100)}
    got = {(r["a"], r["b"]): (r["cosine"], r["manhattan"]) for r in QUERIES["vector_distance_matrix"][0](spark, str(tmp_path)).collect()}
    assert got == {(i, j): (pytest.approx(1 - u[i] @ u[j], abs=2e-5), pytest.approx(abs(x[i] - x[j]).sum(), abs=2e-5)) for i in (0, 50, 100) for j in range(130)}
