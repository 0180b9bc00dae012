"""SimHash, SpotSigs and embedding search against all pairs; the pipeline's stages."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from corpusmill.llm import pq, simhash, spotsigs
from corpusmill.llm.components import components
from corpusmill.llm.wordhash import WordReader


def prose(r, n):
    vocab = [f"{a}{b}" for a in ("ba", "do", "ki", "mu", "re", "so", "ta") for b in ("l", "m", "n", "r", "st", "x", "z", "pp", "qu")]
    return [r.choice(["the", "is", "was", "of", "and"]) if r.random() < 0.4 else r.choice(vocab) + r.choice(vocab) for _ in range(n)]


def copies(seed, bases=40):
    r, rows = random.Random(seed), []
    for _ in range(bases):
        w = prose(r, r.randrange(60, 300))
        rows.append(" ".join(w))
        for _ in range(r.randrange(4)):
            x = list(w)
            for _ in range(r.choice([0, 1, 3])):
                x[r.randrange(len(x))] = "changed" + str(r.randrange(1000))
            rows.append(" ".join(x))
    return list(enumerate(rows))


def groups(pairs):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for x in up:
        out.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def test_masks_cover_every_pair_within_the_radius():
    every = simhash.tables(simhash.RADIUS)
    assert len(every) == 186 and all(sum(int(x).bit_count() for x in m) >= 16 for _, m in every)
    rng = np.random.default_rng(0)
    ms = np.stack([m for _, m in every])
    for radius in (simhash.RADIUS, 13):
        ms = np.stack([m for _, m in simhash.tables(radius)])
        for _ in range(2000):
            bits = rng.choice(256, rng.integers(1, radius + 1), replace=False)
            d = np.array([sum(1 << int(b) % 64 for b in bits if b // 64 == k) for k in range(4)], np.uint64)
            assert ((ms & d) == 0).all(axis=1).any()


M = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_hash(word):
    base = 0x9E3779B97F4A7C15
    return plain_mix(sum(plain_mix((b + 1) * base & M) * pow(base, i, M + 1) for i, b in enumerate(word.encode())) + 1 & M)


def plain_code(text):
    """The code of a text, written anew: a set of the bits that are on."""
    total = [0] * 256
    for word, times in Counter(re.findall(r"[a-z0-9_]+", text.lower())).items():
        weight, h = round(16 * times**simhash.POWER), plain_hash(word)
        for k in range(4):
            bits = plain_mix(h + (k + 1) * 0x632BE59BD9B4E019 & M)
            for i in range(64):
                total[64 * k + i] += weight if bits >> i & 1 else -weight
    return {i for i, x in enumerate(total) if x > 0}


def brute_groups(rows):
    codes = {i: plain_code(t) for i, t in rows if re.search("[a-z0-9_]", t.lower())}
    return groups([(a, b) for a, b in itertools.combinations(codes, 2) if len(codes[a] ^ codes[b]) <= simhash.RADIUS])


def test_simhash_equals_all_pairs(docs):
    rows = copies(1)
    got = [tuple(x) for x in simhash.duplicates(docs(rows)).collect()]
    assert groups(got) == brute_groups(rows) and len(got) > 20
    assert all(b < a for a, b in got)


def planted_codes(seed=4):
    """Codes in pairs at the radius or one beyond, and some hundred close variants of one."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (60, 256), dtype=np.uint8)
    flipped = bits.copy()
    for k in range(60):
        flipped[k, rng.choice(256, simhash.RADIUS + k % 2, replace=False)] ^= 1
    hot = np.repeat(bits[:1], 150, axis=0)
    for k in range(150):
        hot[k, rng.choice(64, 3, replace=False)] ^= 1
    return np.unique(np.packbits(np.r_[bits, flipped, hot], axis=1).view(np.int64), axis=0)


def test_simhash_finds_every_pair_within_the_radius(spark, monkeypatch):
    codes = planted_codes()
    names = simhash.node_of(codes).tolist()
    table = spark.createDataFrame([(n, *map(int, c)) for n, c in zip(names, codes)], ["node", *simhash.CODE])
    d = np.bitwise_count(codes.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None]).sum(axis=2)
    pairs = [(names[i], names[j]) for i, j in itertools.combinations(range(len(codes)), 2) if d[i, j] <= simhash.RADIUS]
    assert len(groups(pairs)) == 30 and len(pairs) > 4000
    # as it is; and with cells cut into blocks and most buckets searched breadth first
    for cell, small in ((100_000, 64), (60, 4)):
        monkeypatch.setattr(simhash, "CELL_ENTRIES", cell)
        monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
        edges = [tuple(x) for x in simhash.near_edges(table).collect()]
        assert groups(edges) == groups(pairs)


def test_simhash_odd_rows_and_one_of_each_group_stays(docs):
    r = random.Random(7)
    long = " ".join(prose(r, 60_000))
    rows = [(1, "same words here"), (2, "same words here"), (2, "same words here"), (3, None), (4, ""), (5, ""), (None, "same words here"), (6, "!!"), (7, long), (8, long + " more"), (9, "alone in the corpus")]
    assert sorted(map(tuple, simhash.duplicates(docs(rows)).collect())) == [(2, 1), (8, 7)]
    kept = simhash.near_dedup(docs(rows)).collect()
    assert sorted((x["doc_id"] or 0 for x in kept)) == [0, 1, 3, 4, 5, 6, 7, 9]
    assert simhash.duplicates(docs([])).count() == 0 and simhash.near_dedup(docs([])).count() == 0
    same = simhash.near_dedup(docs([(1, "x y"), (1, "x y"), (2, "other thing")])).collect()
    assert sorted(x["doc_id"] for x in same) == [1, 2]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    by = {}
    for x in got:
        by.setdefault(x["component"], set()).add(x["node"])
    assert sorted(map(sorted, by.values())) == groups([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def classes(rows, linked):
    """[(id, least id of its group, links)] of rows (id, value), by comparing all pairs of rows."""
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if linked(rows[i][1], rows[j][1])]
    n = Counter(x for p in pairs for x in p)
    of = {x: g for g in groups(pairs) for x in g}
    ids = lambda g: [rows[x][0] for x in g if rows[x][0] is not None]
    return sorted(((r[0], min(ids(of[k]), default=None) if k in of else r[0], n[k]) for k, r in enumerate(rows)), key=str)


def plain_signatures(text):
    """SpotSigs written anew, over words instead of hashes."""
    words = re.findall(r"[\w]+", (text or "").lower())
    content = [(k, w) for k, w in enumerate(words) if w not in spotsigs.COMMON]
    out = set()
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [c for at, c in content if at > k][: spotsigs.CHAIN]
            if len(after) == spotsigs.CHAIN:
                out.add((w, *after))
    return out or (tuple(words) or None)


def test_spotsigs_equals_all_pairs(docs):
    rows = copies(2) + [(900, None), (901, ""), (902, "..."), (3, "an id that others have"), (None, "the cat sat here"), (None, "the cat sat here"), (903, "Один два три"), (904, "один, два три!"), (905, "word word"), (906, "word word word")]
    sets = [(i, plain_signatures(t)) for i, t in rows]
    for threshold in (0.5, 0.8):

        def linked(a, b):
            if not a or not b or type(a) is not type(b):
                return False
            return a == b if isinstance(a, tuple) else len(a & b) / len(a | b) >= threshold - 1e-12

        got = sorted(map(tuple, spotsigs.spotsigs(docs(rows), threshold).collect()), key=str)
        assert got == classes(sets, linked) and sum(n for _, _, n in got) > 40


def test_spotsigs_odd_rows(docs, spark):
    from pyspark.sql import functions as F

    text = "the cat sat here and the dog ran there is another day"
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "nothing"), (None, text), (6, "The quick " * 50_000), (7, text + " the end of all")]
    d = docs(rows).withColumn("node", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("class_id", F.lit(0))
    got = sorted(map(tuple, spotsigs.spotsigs(d).collect()), key=str)
    assert got == sorted([(1, 1, 4), (2, 1, 4), (2, 1, 4), (3, 3, 0), (4, 4, 0), (5, 5, 0), (None, 1, 4), (6, 6, 0), (7, 1, 4)], key=str)
    assert spotsigs.spotsigs(docs([])).count() == 0
    assert [tuple(x) for x in spotsigs.spotsigs(docs([(1, "the lone wolf"), (2, None)])).orderBy("doc_id").collect()] == [(1, 1, 0), (2, 2, 0)]


def crowds(seed=5):
    """Near copies of two texts and the texts of copies(), some ids and texts twice."""
    r, rows = random.Random(seed), copies(seed, 15)
    for size in (60, 150):
        base = prose(r, size)
        for k in range(45):
            x = list(base)
            for _ in range(r.choice([1, 2, 4, 8])):
                x[r.randrange(len(x))] = r.choice(["changed", "other", f"own{r.randrange(300)}"])
            rows.append((len(rows), " ".join(x[: len(x) - r.randrange(12)])))
    return rows + rows[-3:] + [(None, rows[-1][1])]


def test_spotsigs_of_many_near_copies_equals_all_pairs(docs, monkeypatch):
    rows = crowds()
    sets = [(i, plain_signatures(t)) for i, t in rows]
    linked = lambda a, b: bool(a and b) and isinstance(a, set) and isinstance(b, set) and len(a & b) / len(a | b) >= 0.6 - 1e-12
    want = classes(sets, linked)
    tables = {}
    keep = spotsigs.written
    monkeypatch.setattr(spotsigs, "written", lambda df, what: tables.setdefault(what, keep(df, what)))
    for hot, cell, meetings in ((10, 3000, 50), (10, 1 << 18, 1 << 20), (1000, 1 << 18, 7)):
        tables.clear()
        for name, value in (("HOT", hot), ("CELL_COST", cell), ("MEETINGS", meetings)):
            monkeypatch.setattr(spotsigs, name, value)
        got = sorted(map(tuple, spotsigs.spotsigs(docs(rows)).collect()), key=str)
        assert got == want and sum(n for _, _, n in got) > 1500
        assert ("blocks" in tables) == (hot == 10)
        assert tables["pairs"].count() < 300 or hot > 10  # pairs of near copies of one text aren't written


def test_spotsigs_expands_a_bounded_number_of_pairs():
    import pandas as pd

    n = 600
    entries = pd.DataFrame({"sig": [7] * n + [9] * 40, "size": [50] * (n + 40), "node": [*range(n), *range(40)]})
    parts = list(spotsigs._meet(0.6, 100, 200)(iter([entries])))
    assert max(map(len, parts)) <= n
    out = pd.concat(parts)
    assert sorted(out[out["hot"]]["b"]) == list(range(n)) and set(out[out["hot"]]["a"]) == {0}
    assert sorted(zip(out[~out["hot"]]["a"], out[~out["hot"]]["b"])) == list(itertools.combinations(range(40), 2))


def vectors_with_partners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 32))
    x[300:450] = x[:150] + rng.normal(scale=0.2, size=(150, 32)) * np.linalg.norm(x[:150], axis=1, keepdims=True) / 32**0.5
    x[450:520] = x[450] + rng.normal(scale=0.02, size=(70, 32))
    return [(i, [float(v) for v in e.astype(np.float32)]) for i, e in enumerate(x)] + [(600 + i, [float(v) for v in x[7].astype(np.float32)]) for i in range(5)]


def test_embedding_search_equals_all_pairs(spark, monkeypatch):
    rows = vectors_with_partners()
    rows += [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] * 32), (None, [1.0] * 32), (None, [1.0] * 32), (5, rows[5][1]), (1004, [1.0, 2.0]), (1004, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id bigint, embedding array<float>, list string, node int, class_id string")
    ok = [(i, np.array(e) / np.linalg.norm(e) if e and len(e) == 32 and np.isfinite(e).all() and any(e) else None) for i, e in rows]
    want = classes(ok, lambda a, b: a is not None and b is not None and a @ b >= 0.95)
    assert sum(n for _, _, n in want) > 5000
    for residents, codes, per_list in ((4096, 1 << 17, 64), (4, 50, 20)):
        monkeypatch.setattr(pq, "RESIDENTS", residents)
        monkeypatch.setattr(pq, "CODES", codes)
        monkeypatch.setattr(pq, "PER_LIST", per_list)
        assert sorted(map(tuple, pq.near_embeddings(df).collect()), key=str) == want
    assert pq.near_embeddings(df.limit(0)).count() == 0
    assert [tuple(x) for x in pq.near_embeddings(df.where("vec_id = 1")).collect()] == [(1, 1, 0)]
    assert [tuple(x) for x in pq.near_embeddings(df.where("vec_id = 1000")).collect()] == [(1000, 1000, 0)]


def test_embedding_search_equals_its_sql(spark):
    import duckdb
    import pandas as pd

    rows = vectors_with_partners()
    frame = pd.DataFrame({"vec_id": [i for i, _ in rows], "embedding": [np.array(e, np.float32) for _, e in rows]})
    con = duckdb.connect()
    con.register("frame", frame)
    con.execute("CREATE TABLE embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding FROM frame")
    want = con.execute(f"SELECT vec_id, class_id, n_links FROM ({pq.sql()}) ORDER BY 1").fetchall()
    got = sorted(map(tuple, pq.near_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()))
    assert got == want and sum(n > 0 for *_, n in got) > 200


def test_simhash_with_clashing_columns_and_ties(docs):
    text = " ".join(prose(random.Random(2), 80))
    d = docs([(5, text), (3, text), (3, "quite another text of its own"), (4, text), (None, text)]).selectExpr("*", "1 AS node", "2 AS c0", "3 AS duplicate_of", "4 AS g")
    assert sorted(map(tuple, simhash.duplicates(d).collect())) == [(4, 3), (5, 3)]
    assert sorted((x["doc_id"] or 0, x["node"]) for x in simhash.near_dedup(d).collect()) == [(0, 1), (3, 1), (3, 1)]


def run_pipeline(spark, folder, docs, labels):
    import corpus_pipeline

    docs.write.parquet(str(folder / "documents.parquet"))
    labels.write.parquet(str(folder / "labels.parquet"))
    return corpus_pipeline.run(spark, str(folder)).collect()


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_pipeline_drops_toxic_documents_repeats_and_near_copies(docs, spark, tmp_path):
    r = random.Random(6)
    clean = {i: " ".join(prose(r, r.randrange(60, 120))) for i in range(150)}
    bad = {200 + i: " ".join(prose(r, 40) + ["vilefoo", "scumbar", "filthbaz"]) for i in range(40)}
    rows = list(clean.items()) + list(bad.items()) + [(300, clean[3]), (301, clean[4] + "\n" + "a line of its own, the only one here"), (302, " ".join(clean[5].split()[:-1] + ["changed"])), (None, "no id here " + clean[6]), (303, None), (303, ""), (7, "a second text that has the id seven"), (7, "a second text that has the id seven")]
    d = docs(rows).selectExpr("*", "'e' AS copies", "1 AS n_lines", "2 AS __score2")
    got = run_pipeline(spark, tmp_path, d, labelled(spark, [(i, 1, 1) for i in range(200, 230)] + [(i, 1, 0) for i in range(0, 118)] + [(None, None, None), (3, 1, 0)]))
    left = {x["doc_id"] for x in got}
    assert not left & set(bad) and 300 not in left and 302 not in left and None in left
    assert len(set(clean) & left) >= 148 and 7 in left and 303 not in left
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append((x["start"], x["text"]))
    assert " ".join(t for _, t in sorted(by[301])[:20]) == "a line of its own, the only one here" or 301 not in by


def test_pipeline_on_empty_and_clean_tables(docs, spark, tmp_path):
    none = labelled(spark, [])
    for name, d in (("empty", docs([])), ("nulls", docs([(None, None), (None, None), (1, None)])), ("clean", docs([(1, "one clean text"), (2, "and another quite different one")]))):
        (tmp_path / name).mkdir()
        got = run_pipeline(spark, tmp_path / name, d, none)
        assert {x["doc_id"] for x in got} == ({1, 2} if name == "clean" else set())


def test_pipeline_stages(docs, spark, tmp_path):
    import corpus_pipeline

    rows = copies(5) + [(900, "the fool fooz " * 3), (901, None), (902, "")]
    d = docs(rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "packing" or out.columns == d.columns
        out.write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        if name == "SimHash near-dedup":
            left = [(x["doc_id"], x["text"] or "") for x in now.collect()]
            assert brute_groups(left) == []
            gone = {x["doc_id"] for x in before.collect()} - {i for i, _ in left}
            assert gone <= {i for g in brute_groups([(x["doc_id"], x["text"] or "") for x in before.collect()]) for i in g[1:]}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, now.collect()))
