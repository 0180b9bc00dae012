"""Counts of features: only features leave the JVM, and a bounded number is looked at once."""

import pyarrow as pa
import pytest

from corpusmill.operators import pairs, stylometry
from corpusmill.operators.stylometry import Stylometry


def test_only_features_are_sent_to_be_counted(spark, monkeypatch):
    """Other words took memory of the Python workers: batches hold rows of any length."""
    sent, own = [], stylometry._counted

    def spy(names, n_keys):
        run = own(names, n_keys)

        def watched(batches):
            def told(b):
                extra = set(b.column(n_keys).flatten().to_pylist()) - set(names)
                if extra:
                    raise AssertionError(f"sent: {extra}")
                return b

            return run(map(told, batches))

        sent.append(names)
        return watched

    monkeypatch.setattr(stylometry, "_counted", spy)
    rows = [(i, "xy"[i % 2], ["a"] * (i + 1) + ["b", "b", None] + [f"other{i}-{k}" for k in range(30)]) for i in range(6)]
    m = Stylometry(n_features=2)
    m.fit_transform(spark.createDataFrame(rows, "doc_id bigint, author string, tokens array<string>")).collect()
    assert sent == [["a", "b"]]
    assert {r["doc_id"]: r["rel"] for r in m.fitted.relative.collect()} == {i: [pytest.approx((i + 1) / (i + 34)), pytest.approx(2 / (i + 34))] for i in range(6)}


def test_pieces_hold_few_items(monkeypatch):
    monkeypatch.setattr(pairs, "TOKENS", 4)
    lists = [["a", "b"], None, ["a"], [], ["b"] * 9, ["a", "b"], ["b"]]
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string())), pa.array([len(x or []) + 1 for x in lists])], names=["k", "grams", "total"])
    cut = list(pairs.pieces(b, 1))
    assert [len(x) for x, _ in cut] == [4, 1, 2] and sum((s.tolist() for _, s in cut), []) == [2, 0, 1, 0, 9, 2, 1]
    out = pa.Table.from_batches(stylometry._counted(["b", "a"], 1)([b])).to_pydict()
    assert out["counts"] == [[(x or []).count("b"), (x or []).count("a")] for x in lists] and out["total"] == [len(x or []) + 1 for x in lists] and out["k"] == list(range(7))
