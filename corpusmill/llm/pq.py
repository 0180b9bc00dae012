"""Embedding near-dedup by product quantisation (Jegou, Douze and Schmid 2011): coarse inverted lists, residual codes, exact rerank.

Every vector lives in the list of its nearest centroid, with its full coordinates, and is a query there. Its code (of what its centroid leaves over) visits all lists that could hold a partner: of
two partners in different lists, which lie on either side of the plane between the centroids, one is within half the greatest distance of partners of that plane.
A vector visits the lists whose plane with its own is that near, so no pair is lost. What travels to a visited list is the code, a few bytes, not the vector.

In a list, the distances of its vectors to all codes there come from tables of inner products with the codewords (asymmetric); as each code's error is known, no
partner is lost there either, by the triangle inequality. What passes is compared exactly, in blocks with the vectors that they need. Each block returns a spanning forest of its links and
their number for each vector: copies in their thousands don't become millions of rows. Equal vectors are one before all this.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .components import components
from .simhash import least_labels

#: A task holds so many vectors of a list and so many codes; a list with more is cut into blocks.
RESIDENTS, CODES = 4096, 1 << 17
PAIRS_A_BLOCK, CELLS = 500_000, 1 << 21
PER_LIST, MOST_LISTS = 64, 4096


def unit_rows(column: pa.Array, n: int) -> np.ndarray:
    """Vectors of one width as rows of length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.empty((0, 1), np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].astype(np.float32).copy()
    for _ in range(rounds):
        near = np.concatenate([squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def train(sample: np.ndarray, lists: int, parts: int, codewords: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centroids of the lists, and for each part of the residual its codewords."""
    coarse = kmeans(sample, lists, seed=seed)
    own = np.concatenate([squares(sample[i : i + 4096], coarse).argmin(1) for i in range(0, len(sample), 4096)])
    rest = sample - coarse[own]
    return coarse, [kmeans(rest[:, p], codewords, seed=seed) for p in np.array_split(np.arange(sample.shape[1]), parts)]


def parts_of(width: int, books: list[np.ndarray]) -> list[np.ndarray]:
    return np.array_split(np.arange(width), len(books))


def encode(rest: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals and what they stand for."""
    codes = np.stack([squares(rest[:, p], b).argmin(1) for p, b in zip(parts_of(rest.shape[1], books), books)], axis=1).astype(np.uint8)
    return codes, np.concatenate([b[codes[:, k]] for k, b in enumerate(books)], axis=1)


def _assign(coarse: np.ndarray, books: list[np.ndarray], margin: float):
    gaps = np.sqrt(squares(coarse, coarse))
    np.fill_diagonal(gaps, 1.0)

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            every = unit_rows(b.column(1), len(node))
            for lo in range(0, len(node), 1024):
                x = every[lo : lo + 1024]
                d = squares(x, coarse)
                own = d.argmin(1)
                codes, rebuilt = encode(x - coarse[own], books)
                stands = coarse[own] + rebuilt
                plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * gaps[own])
                plane[np.arange(len(x)), own] = np.inf
                visits = [np.flatnonzero(p <= margin).astype(np.int32).tobytes() for p in plane]
                # what a code needs to give distances: its list, its length, its error
                entry = np.zeros(len(x), entry_type(len(books)))
                entry["node"], entry["list"], entry["code"] = node[lo : lo + 1024], own, codes
                entry["square"], entry["error"] = (stands * stands).sum(1), np.sqrt(((x - stands) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(node[lo : lo + 1024]), pa.array(own.astype(np.int32)), *(pa.array(c, pa.binary()) for c in ([v.tobytes() for v in x], visits, [e.tobytes() for e in entry]))], names=["node", "list", "vec", "visits", "entry"])

    return run


ASSIGNED = "node bigint, list int, vec binary, visits binary, entry binary"


def entry_type(parts: int) -> np.dtype:
    return np.dtype([("node", np.int64), ("list", np.int32), ("square", np.float32), ("error", np.float32), ("code", np.uint8, (parts,))])


def _census(lists: int):
    def run(batches):
        """Vectors in each list and codes that come to it."""
        n = np.zeros((2, lists), np.int64)
        for b in batches:
            n[0] += np.bincount(b.column(0).to_numpy(zero_copy_only=False), minlength=lists)
            n[1] += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32), minlength=lists)
        k = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[0, k]), pa.array(n[1, k])], names=["list", "own", "visit"])

    return run


def spread(node: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return ((node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % blocks.astype(np.uint64)).astype(np.int64)


def _place(blocks: np.ndarray, parts: int):
    """blocks: of each list, of its vectors and of its codes. Packed rows (list, i, j, then vectors with their visits, or codes) for each pair of blocks."""

    def run(batches):
        for b in batches:
            node, own = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(node):
                continue
            vec, visits, entries = (b.column(k).to_pylist() for k in (2, 3, 4))
            out: list[tuple] = []
            # vectors, each to all blocks of codes
            i = spread(node, blocks[0][own])
            for r in range(len(node)):
                for j in range(blocks[1][own[r]]):
                    out.append((int(own[r]), int(i[r]), j, node[r].tobytes(), vec[r], visits[r], None))
            # codes, each to all blocks of vectors; packed by list
            to = np.frombuffer(b"".join(visits), np.int32)
            row = np.r_[np.arange(len(node)), np.repeat(np.arange(len(node)), [len(v) // 4 for v in visits])]
            to = np.r_[own, to].astype(np.int64)
            j = spread(node[row], blocks[1][to])
            order = np.lexsort((j, to))
            row, to, j = row[order], to[order], j[order]
            every = np.frombuffer(b"".join(entries), entry_type(parts))
            cuts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (j[1:] != j[:-1])])
            for lo, hi in zip(cuts, [*cuts[1:], len(to)]):
                packed = every[row[lo:hi]].tobytes()
                for i_ in range(blocks[0][to[lo]]):
                    out.append((int(to[lo]), i_, int(j[lo]), None, None, None, packed))
            kinds = (pa.int32(),) * 3 + (pa.binary(),) * 4
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["list", "i", "j", "node", "vec", "visits", "codes"])

    return run


PLACED = "list int, i int, j int, node binary, vec binary, visits binary, codes binary"


def _search(coarse: np.ndarray, books: list[np.ndarray], reach: float):
    at = parts_of(coarse.shape[1], books)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs that may be partners, each in one list only, packed."""
        here = int(key[0])
        q = pdf[pdf["codes"].isna()]
        m = np.frombuffer(b"".join(pdf.loc[pdf["codes"].notna(), "codes"]), entry_type(len(books)))
        out: list[tuple] = []
        if len(q) and len(m):
            x = np.frombuffer(b"".join(q["vec"]), np.float32).reshape(len(q), -1)
            node, visits = np.frombuffer(b"".join(q["node"]), np.int64), [np.frombuffer(v, np.int32) for v in q["visits"]]
            width = len(coarse)
            goes = np.sort(np.concatenate([k * width + v.astype(np.int64) for k, v in enumerate(visits)]))
            codes, of = np.ascontiguousarray(m["code"].T), m["list"].astype(np.int64)
            lists, at_list = np.unique(of, return_inverse=True)
            most = (reach + m["error"] + 1e-3) ** 2
            step = max(1, CELLS // len(m))
            for lo in range(0, len(q), step):
                part = x[lo : lo + step]
                inner = (part @ coarse[lists].T)[:, at_list]
                for k, (p, b) in enumerate(zip(at, books)):
                    inner += np.take(part[:, p] @ b.T, codes[k], axis=1)
                far = (part * part).sum(1)[:, None] + m["square"][None] - 2 * inner
                i, j = np.divmod(np.flatnonzero(far <= most), len(m))
                i += lo
                same = of[j] == here
                # in its own list a pair meets twice; in two lists, if both visit: the lesser list has it
                spot = i * width + of[j]
                met = np.zeros(len(i), bool)
                if len(goes) and len(i):
                    found = np.minimum(np.searchsorted(goes, spot), len(goes) - 1)
                    met = goes[found] == spot
                keep = np.where(same, node[i] < m["node"][j], ~met | (here < of[j]))
                a, b_ = node[i[keep]], m["node"][j[keep]]
                for s in range(0, len(a), PAIRS_A_BLOCK):
                    out.append((a[s : s + PAIRS_A_BLOCK].tobytes(), b_[s : s + PAIRS_A_BLOCK].tobytes()))
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": object, "b": object})

    return run


def _needed(batches):
    for b in batches:
        block, node = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k, x, y in zip(*(b.column(c).to_pylist() for c in range(3))):
            n = np.unique(np.r_[np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)])
            block.append(np.full(len(n), k))
            node.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(block)), pa.array(np.concatenate(node))], names=["block", "node"])


def _rerank(threshold: float):
    def run(pairs: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """For each vector of the block with a link: another one of its group, and the number of rows that it has links to here."""
        names = vectors["node"].to_numpy(np.int64)
        order = np.argsort(names)
        names = names[order]
        x = np.frombuffer(b"".join(vectors["vec"].to_numpy()[order]), np.float32).reshape(len(names), -1) if len(names) else np.empty((0, 1), np.float32)
        rows = vectors["rows"].to_numpy(np.int64)[order]
        links, label = np.zeros(len(names), np.int64), np.arange(len(names))
        for a, b in zip(pairs["a"], pairs["b"]):
            i, j = (np.searchsorted(names, np.frombuffer(c, np.int64)) for c in (a, b))
            for lo in range(0, len(i), 65536):
                p, q = i[lo : lo + 65536], j[lo : lo + 65536]
                ok = np.einsum("ij,ij->i", x[p].astype(np.float64), x[q].astype(np.float64)) >= threshold
                p, q = p[ok], q[ok]
                links += np.bincount(p, rows[q], len(names)).astype(np.int64) + np.bincount(q, rows[p], len(names)).astype(np.int64)
                label = least_labels(np.r_[p, np.arange(len(names))], np.r_[q, label], len(names))
        some = links > 0
        return pd.DataFrame({"u": names[some], "v": names[label[some]], "links": links[some]})

    return run


def usable_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, node, embedding as floats) of the usable rows, and their width; node is a hash of the vector."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = v.withColumn("norm", norm).where("norm > 1e-20 AND norm < 1e30 AND NOT isnan(norm)").drop("norm")
    d = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = d["d"] if d else 0
    return v.where(F.size("embedding") == width).withColumn("node", F.xxhash64("embedding")), width


def near_embeddings(vectors: DataFrame, *, threshold: float = 0.95, parts: int = 8, codewords: int = 256, max_train: int = 20_000, margin: float | None = None, seed: int = 4) -> DataFrame:
    """(vec_id, class_id, n_links), one row for each row of vectors. n_links: the other rows whose cosine with it is at least threshold. class_id: the least
    vec_id of the rows that links join with it, directly or through others; its own where it has none.

    margin: how far the plane between a vector's own and another centroid may be for that list to be visited; None is half the greatest distance
    of partners, with which no pair is lost; less is faster. Lists hold PER_LIST vectors on average, MOST_LISTS and an eighth of the fitted vectors are the most. The index is fitted on at most max_train vectors,
    the first in the order of a seeded hash; all are in it. Vectors that are null, empty, zero,
    not finite or of another length than most have no link. Repeated rows, and rows that share an id or have none, are rows of their own; null is no least id, but the class of a group without ids.
    Equal vectors are links. Ties of ids need no order. Other columns are ignored.
    """
    v, width = usable_vectors(vectors)
    if not width:
        return vectors.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    rows = written(v, "vectors")
    nodes = written(rows.groupBy("node").agg(F.count("*").alias("rows"), F.first("embedding").alias("embedding")), "nodes")
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(max_train).select("embedding").toArrow()["embedding"]
    sample = unit_rows(sample.combine_chunks(), len(sample))
    lists = max(1, min(MOST_LISTS, len(sample) // 8 or 1, math.ceil(n / PER_LIST)))
    coarse, books = train(sample, lists, min(parts, width), codewords, seed)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    assigned = written(nodes.select("node", "embedding").mapInArrow(_assign(coarse, books, reach / 2 if margin is None else margin), ASSIGNED), "assigned")
    census = assigned.select("list", "visits").mapInArrow(_census(len(coarse)), "list int, own bigint, visit bigint").groupBy("list").agg(F.sum("own").alias("own"), F.sum("visit").alias("visit")).collect()
    blocks = np.ones((2, len(coarse)), np.int64)
    for r in census:  # one row a list
        blocks[:, r["list"]] = max(1, math.ceil(r["own"] / RESIDENTS)), max(1, math.ceil((r["own"] + r["visit"]) / CODES))
    placed = assigned.mapInArrow(_place(blocks, len(books)), PLACED)
    pairs = placed.groupBy("list", "i", "j").applyInPandas(_search(coarse, books, reach), "a binary, b binary")
    pairs = written(pairs.where("length(a) > 0").withColumn("block", F.xxhash64("a", "b")), "pairs")
    need = pairs.select("block", "a", "b").mapInArrow(_needed, "block bigint, node bigint")
    vec = need.join(assigned.select("node", "vec"), "node").join(nodes.select("node", "rows"), "node")
    near = pairs.groupBy("block").cogroup(vec.groupBy("block")).applyInPandas(_rerank(threshold), "u bigint, v bigint, links bigint")
    near = written(near, "near")
    links = near.groupBy("u").agg(F.sum("links").alias("links"))
    group = components(near.select("u", "v"))
    of = nodes.select("node", "rows").join(links, F.col("node") == F.col("u"), "left").drop("u").join(group, "node", "left")
    of = of.select("node", F.coalesce("component", "node").alias("g"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    member = written(rows.select("vec_id", "node").join(of, "node"), "members")
    # only groups of several rows have a class to look up; the least id is found with partial sums, so that a large group is no hot key
    several = member.where("n_links > 0")
    least = several.groupBy("g").agg(F.min("vec_id").alias("class_id"))
    linked = several.join(least, "g").select("vec_id", "class_id", "n_links")
    alone = member.where("n_links = 0").select("vec_id", F.col("vec_id").alias("class_id"), "n_links")
    usable = linked.unionByName(alone)
    bad = written(vectors.select("vec_id").exceptAll(rows.select("vec_id")), "unusable")
    return usable.unionByName(bad.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def sql(table: str = "embeddings", threshold: float = 0.95) -> str:
    """All pairs, and classes by following links until nothing changes. For tables of single ids; quadratic."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding FROM {table}),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= {threshold}),
reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a)
SELECT r.vec_id, min(r.other) AS class_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links
FROM reached r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON r.vec_id = n.a GROUP BY r.vec_id"""
