"""Line dedup, mixing, packing and word hashes against plain Python."""

import math
import random
import re
from hashlib import md5

import numpy as np
import pyarrow as pa

import pytest

from corpusmill.llm import line_dedup, mixing, packing
from corpusmill.llm.wordhash import WordReader, hash_word


def text_hash(spark, rows):
    """Texts' hashes, which order rows that share an id."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(t,) for _, t in rows], "t string")
    return {x["t"]: x["h"] for x in d.select("t", F.xxhash64("t").alias("h")).distinct().collect()}


def brute_lines(rows, hashes):
    """{(id, text): (text, n_lines, n_dropped)}"""
    seen, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        if t is None:
            out[i, t] = (None, 0, 0)
            continue
        kept, lines = [], t.split("\n")
        for k, line in enumerate(lines):
            key = line.strip(" \t\r")
            if key == "" or seen.setdefault(key, (i, t, k)) == (i, t, k):
                kept.append(line)
        out[i, t] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def same_lines(docs, spark, rows):
    d = docs(rows).selectExpr("*", "text AS before")
    got = sorted(((x["doc_id"], x["before"], x["text"], x["n_lines"], x["n_dropped"]) for x in line_dedup.line_dedup(d).collect()), key=str)
    want = brute_lines(rows, text_hash(spark, rows))
    assert got == sorted(((i, t, *want[i, t]) for i, t in rows), key=str)


def test_line_dedup_equals_brute_force(docs, spark, monkeypatch):
    r = random.Random(1)
    words = [f"line {k}" for k in range(60)] + ["", " x", "x ", "\tx"]
    rows = [(i, "\n".join(r.choice(words) for _ in range(r.randrange(12)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "y " * 200_000 + "\n" + "y " * 200_000), (None, "line 3\nonly here")]
    same_lines(docs, spark, rows)
    monkeypatch.setattr(line_dedup, "MOST_ROWS", 0)
    monkeypatch.setattr(line_dedup, "SHARD_LINES", 64)  # some shards have repeats, some have none
    same_lines(docs, spark, rows)


@pytest.mark.parametrize("rows", [[(1, "a"), (2, "b")], [(1, "only\nthis")], [(1, None)], [(1, "")], [(1, "a\nb"), (1, "a\nc")], [(None, "a\nb"), (None, "a\nc"), (None, "a\nb")], [(5, "x\ny\nx"), (4, "y")], [(1, "a\n" * 50_000 + "b")]])
@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_without_repeats_and_with_shared_ids(docs, spark, monkeypatch, rows, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_dedup, "MOST_ROWS", -1)
    same_lines(docs, spark, rows)


def test_line_dedup_sends_only_the_texts_concerned(docs, spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_ROWS", -1)
    d = docs([(i, f"own line {i}\n" + ("shared" if i < 5 else f"other {i}")) for i in range(2000)])
    drops = line_dedup.repeated_lines(d)
    out = line_dedup.with_drops(d, drops)
    assert out.where("__drop IS NOT NULL").count() == 4 and out.count() == 2000


def test_line_dedup_repeated_rows_extra_columns_and_empty(docs, spark):
    from pyspark.sql import functions as F

    d = docs([(1, "a\nb"), (1, "a\nb"), (2, "b\nc")]).withColumn("n_lines", F.lit("clash")).withColumn("extra", F.lit(5))
    got = sorted((x["doc_id"], x["text"], x["extra"]) for x in line_dedup.line_dedup(d).collect())
    assert got == [(1, "a\nb", 5), (1, "a\nb", 5), (2, "c", 5)]
    assert line_dedup.line_dedup(docs([]).limit(0)).count() == 0


def test_twice_seen_filter_has_no_false_negatives():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    once, twice = line_dedup.bloom_pair([a, np.r_[b, a[:500]]], [b[:10]])
    small = line_dedup.fold(twice)
    for bits in (twice, small):
        for h in (a[:500], b[:10]):
            assert all(bits[p].all() for p in line_dedup._positions(h, len(bits) - 1))
    assert len(small) < len(twice) and once.sum() > twice.sum()


def brute_mix(rows, labels, target, power, budget, seed=11):
    quality = {}
    for i, q in labels:
        quality[i] = max(q, quality.get(i, q))
    keyed = []
    for i, t, s in rows:
        n = len((t or "").split())
        w = {1: 2.0, 0: 0.5}.get(quality.get(i) if i is not None else None, 1.0)
        u = (int(md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keyed.append((s, -math.log(u) / w, i, n))
    have = {}
    for s, _, _, n in keyed:
        have[s] = have.get(s, 0) + n
    have = {s: n for s, n in have.items() if n}
    weight = {s: (target or {}).get(s, 0.0) if target is not None else n**power for s, n in have.items()}
    total = sum(have.values()) if budget is None else budget
    out = []
    for s, n in have.items():
        b = math.floor(total * weight[s] / sum(weight.values())) if sum(weight.values()) else 0
        mine = sorted((x for x in keyed if x[0] == s), key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[3]))
        for x in mine:
            upto = sum(y[3] for y in mine if (y[1], y[2] is not None, y[2] or 0, y[3]) <= (x[1], x[2] is not None, x[2] or 0, x[3]))
            c = b // n + (upto <= b % n)
            if c:
                out.append((x[2], s, x[3], c))
    return sorted(out, key=str)


def test_mixing_equals_brute_force(docs, spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randrange(40), "en", r.choice(["a", "a", "a", "b", None])) for i in range(150)] + [(7, "w w", "en", "a"), (7, "w w", "en", "a"), (None, "w w w", "en", "b"), (999, None, "en", "b"), (1000, "", "en", "empty")]
    labels = [(i, i % 2) for i in range(0, 150, 3)] + [(3, 1), (None, 1)]
    lab = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id bigint, quality int, toxic int")
    plain = [(i, t, s) for i, t, _, s in rows]
    for target, budget in ((None, None), ({"a": 1.0, "b": 3.0}, 9000), ({"b": 1.0}, 50), ({"zzz": 1.0}, 100)):
        got = sorted(map(tuple, mixing.mix(docs(rows), lab, target=target, budget_tokens=budget).collect()), key=str)
        assert got == brute_mix(plain, labels, target, 0.7, budget)
    assert mixing.mix(docs([]), lab).count() == 0
    chosen = mixing.mixed(docs(rows), lab, target={"a": 1.0, "b": 3.0}, budget_tokens=9000)
    assert chosen.count() == sum(x[3] for x in brute_mix(plain, labels, {"a": 1.0, "b": 3.0}, 0.7, 9000))
    assert chosen.columns == docs(rows).columns


def test_packing_is_an_exact_round_trip(docs):
    r = random.Random(3)
    rows = [(i, " ".join(f"t{k}" for k in range(r.randrange(70)))) for i in range(60)] + [(100, None), (101, ""), (102, " \n "), (103, "z " * 20_000), (None, "a b c")]
    for power in (3, 13):
        by = {}
        for x in packing.pack(docs(rows), power).collect():
            assert x["length"] == 2 ** x["bucket"] <= 2**power and len(x["text"].split(" ")) == x["length"]
            by.setdefault(x["doc_id"], []).append((x["start"], x["text"]))
        for i, t in rows:
            pieces = sorted(by.get(i, []))
            assert " ".join(p for _, p in pieces) == " ".join((t or "").split())
            lengths = [len(p.split(" ")) for _, p in pieces]
            assert lengths == sorted(lengths, reverse=True)
    assert packing.pack(docs([])).count() == 0


def test_word_hashes_agree_with_a_regex():
    texts = ["hello world's end", "", None, "日本 go", "a b—c", "x" * 3_000_000 + " y", "été_9"]
    reader, got = WordReader(), {}
    for doc, hashes in reader.read(pa.array(texts), lambda w: (w.doc, w.hash)):
        for d, h in zip(doc, hashes):
            got.setdefault(int(d), []).append(int(h))
    for k, t in enumerate(texts):
        words = re.findall(r"[a-z0-9_éèà]+|[　-￿]", (t or ""))
        assert got.get(k, []) == [hash_word(w) for w in words]


def test_words_of_long_texts_are_read_in_pieces(monkeypatch):
    from corpusmill.llm import wordhash

    r = random.Random(8)
    texts = [" ".join(r.choice(["ab", "cde", "日本", "x—y", "été", "q" * 50]) for _ in range(r.randrange(120))) for _ in range(30)] + ["z" * 1000, "日" * 300, ""]
    got = {}
    for size in (1 << 20, 64, 17):
        monkeypatch.setattr(wordhash, "CHUNK", size)
        for doc, h in WordReader().read(pa.array(texts), lambda w: (w.doc, w.hash)):
            for d, x in zip(doc, h):
                got.setdefault((size, int(d)), []).append(int(x))
    for size in (64, 17):
        for d in range(len(texts)):
            assert got.get((size, d)) == got.get((1 << 20, d))


def test_mixing_and_packing_with_clashing_columns_repeats_and_ties(docs, spark):
    names = ["'x' AS copies", "'y' AS n_tokens", "'z' AS start", "'l' AS length", "'b' AS bucket", "'q' AS quality"]
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, "d e f", "en", "s"), (None, "g h i", "en", "s"), (None, "g h i", "en", "s"), (3, None, "en", None)]
    lab = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int").selectExpr("*", "'c' AS source")
    d = docs(rows).selectExpr("*", *names)
    plain = [(i, t, s) for i, t, _, s in rows]
    for budget in (None, 9, 30):
        got = sorted(map(tuple, mixing.mix(d, lab, budget_tokens=budget).collect()), key=str)
        assert got == brute_mix(plain, [(1, 1)], None, 0.7, budget)
    assert sorted(mixing.mixed(d, lab).columns) == sorted(d.columns)
    pieces = sorted((x["doc_id"] or 0, x["start"], x["length"], x["text"]) for x in packing.pack(d).collect())
    one = lambda i, w: [(i, 0, 2, " ".join(w[:2])), (i, 2, 1, w[2])]
    assert pieces == sorted(one(1, ["a", "b", "c"]) * 2 + one(2, ["d", "e", "f"]) + one(0, ["g", "h", "i"]) * 2)
