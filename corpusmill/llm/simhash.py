"""SimHash near-dedup by covering locality-sensitive hashing (Pagh 2016).

A document's code has 256 bits, cut into WORDS words of 42 or 43 bits. Codes within RADIUS bits have a word in which they differ in at most (RADIUS + 1) // WORDS - 1 bits, and structured
masks of each word guarantee that two such words are equal under one of them: every pair within the radius collides in some
table, without exception. What collides is compared by whole codes where it meets.

Only distinct codes take part. They travel packed, 32 bytes each, once a table, to groups of bounded size: cells of keys with more codes are cut into blocks, and each two blocks meet. Of
each group a spanning forest of its near pairs is left, for which near copies of one document are compared once each; so no group of copies is written or compared as all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sized, written
from .components import components
from .wordhash import WordReader, mix

BITS, WORDS, RADIUS = 256, 6, 29
#: A word of the text weighs its count to this power: near copies stay within the radius, and texts that share frequent words alone stay out of it.
POWER = 0.6
CELL_ENTRIES = 100_000
#: Buckets of more codes are searched breadth first instead of by all pairs.
SMALL_BUCKET = 64
PAIR_BLOCK = 1 << 15
CODE = [f"c{i}" for i in range(BITS // 64)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """(words, 256) of 0 and 1: the bits of each word's hash, mixed once for each 64 bits of the code."""
    bits = np.stack([mix(hashes + np.uint64((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) for k in range(len(CODE))], axis=1)
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(hashes), -1), axis=1)


def _counted(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, times) of the distinct words of each text."""
    names, at = np.unique(c.hash, return_inverse=True)
    pairs, times = np.unique(c.doc * max(1, len(names)) + at, return_counts=True)
    return pairs // max(1, len(names)), names[pairs % max(1, len(names))], times


def text_codes(column: pa.Array, reader: WordReader) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a word, their codes): each distinct word adds or takes round(16 * times ** POWER) at each of 256 bits."""
    rows, codes = [], []
    for doc, word, times in reader.read(column, _counted):
        if not len(doc):
            continue
        order = np.lexsort((word, doc))
        doc, word, times = doc[order], word[order], times[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])
        doc, word, times = doc[new], word[new], np.add.reduceat(times, new)  # pieces of a long text share words
        weight = np.rint(16 * times.astype(float) ** POWER).astype(np.float32)
        docs, index = np.unique(doc, return_inverse=True)
        total = np.zeros((len(docs), BITS), np.float64)
        for lo in range(0, len(doc), PAIR_BLOCK):
            part = slice(lo, lo + PAIR_BLOCK)
            w, i, on = weight[part], index[part], signs(word[part]).astype(np.float32)
            cuts = [*np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)]
            for lo_, hi_ in zip(cuts, cuts[1:]):
                # a bit of 0 takes what a bit of 1 adds: twice the ones less all
                total[i[lo_]] += 2 * (w[lo_:hi_] @ on[lo_:hi_]) - w[lo_:hi_].sum()
        rows.append(docs)
        codes.append(np.packbits(total > 0, axis=1).view(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty((0, len(CODE)), np.int64)
    return np.concatenate(rows), np.concatenate(codes)


def node_of(codes: np.ndarray) -> np.ndarray:
    """A number of 64 bits for each code."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[:, k].view(np.uint64) + np.uint64(k + 1))
    return out.view(np.int64)


def _codes(batches):
    reader = WordReader()
    for b in batches:
        rows, codes = text_codes(b.column(1), reader)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(node_of(codes)), *(pa.array(codes[:, k].copy()) for k in range(len(CODE)))], names=["doc_id", "node", *CODE])


def masks(radius: int, bits: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks of bits: words within radius are equal under some mask. Bit i has a nonzero vector of radius + 1 bits, a mask v keeps the bits
    whose vector has an odd product with v; up to radius differing bits leave some v orthogonal to all their vectors. Vectors are spread over all there are."""
    n = (1 << (radius + 1)) - 1
    vectors = 1 + np.random.default_rng(5).permutation(n)[np.arange(bits) % n]
    return [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, n + 1)]


def tables(radius: int) -> list[tuple[int, np.ndarray]]:
    """(word, mask of the whole code as numbers of 64 bits) of every table. The words' radii and one each add up to radius + 1, so that a pair within it keeps to the radius of one word."""
    out = []
    ends = [BITS * k // WORDS for k in range(WORDS + 1)]
    for w in range(WORDS):
        share = (radius + 1) // WORDS + (w < (radius + 1) % WORDS)
        if share:
            for m in masks(share - 1, ends[w + 1] - ends[w]):
                whole = m << ends[w]
                out.append((w, np.array([whole >> 64 * k & (1 << 64) - 1 for k in range(len(CODE))], np.uint64)))
    return out


def key_of(codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """codes (n, 4) as unsigned numbers."""
    out = np.ones(len(codes), np.uint64)
    for k in np.flatnonzero(mask):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + (codes[:, k] & mask[k]))
    return out


def codes_of(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(CODE))], axis=1).view(np.uint64) if b.num_rows else np.empty((0, len(CODE)), np.uint64)


def cell_of(key: np.ndarray, cells: int) -> np.ndarray:
    return ((key >> np.uint64(24)) % np.uint64(cells)).astype(np.int64)


def _cells(radius: int, cells: int):
    def run(batches):
        """How many codes each cell of each table has."""
        every = tables(radius)
        n = np.zeros((len(every), cells), np.int64)
        for b in batches:
            codes = codes_of(b)
            for t, (_, m) in enumerate(every):
                n[t] += np.bincount(cell_of(key_of(codes, m), cells), minlength=cells)
        t, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[t, c])], names=["t", "c", "n"])

    return run


def block_of(codes: np.ndarray, blocks: int) -> np.ndarray:
    return ((node_of(codes).view(np.uint64) >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)


def _pack(radius: int, cells: int, hot: dict[tuple[int, int], int]):
    """(t, c, i, j, codes), packed, for all tables: cells with several blocks send each code to every pair of blocks that it is in."""

    def run(batches):
        every = tables(radius)
        for b in batches:
            codes = codes_of(b)
            if not len(codes):
                continue
            for t, (_, m) in enumerate(every):
                out: list[tuple] = []
                cell = cell_of(key_of(codes, m), cells)
                order = np.argsort(cell, kind="stable") if cells > 1 else np.arange(len(cell))
                cuts = [*np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0]), len(order)]
                for lo, hi in zip(cuts, cuts[1:]):
                    at = order[lo:hi]
                    c = int(cell[at[0]])
                    blocks = hot.get((t, c), 1)
                    if blocks == 1:
                        out.append((c, 0, 0, codes[at].tobytes()))
                        continue
                    own = block_of(codes[at], blocks)
                    for i in np.unique(own).tolist():
                        packed = codes[at[own == i]].tobytes()
                        out += [(c, min(i, j), max(i, j), packed) for j in range(blocks)]
                cols = [pa.array([t] * len(out), pa.int32()), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int32(),) * 3 + (pa.binary(),)))]
                yield pa.RecordBatch.from_arrays(cols, names=["t", "c", "i", "j", "code"])

    return run


PACKED = "t int, c int, i int, j int, code binary"


def collisions(n: int, cuts: np.ndarray, rows: int = 1 << 20):
    """Places (i, j), i < j, of all pairs within each run of n places that cuts begin, in parts."""
    size = np.diff(np.r_[cuts, n])
    after = np.repeat(size, size) - 1 - (np.arange(n) - np.repeat(cuts, size))
    upto = np.cumsum(after)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + rows, side="right")))
        k = after[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        lo = hi


def within(columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within radius; codes are given by columns, and most pairs are out after the first ones."""
    left = np.arange(len(i))
    d = np.zeros(len(i), np.uint16)
    for c in columns:
        d = d + np.bitwise_count(c[i[left]] ^ c[j[left]])
        ok = d <= radius
        left, d = left[ok], d[ok]
    return left


def forest(codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of near codes. Each code is compared with those that no search has reached yet: near copies of one document cost one comparison each."""
    todo = np.arange(len(codes))
    u, v = [], []
    while len(todo):
        front, todo = [int(todo[0])], todo[1:]
        while front and len(todo):
            x = front.pop()
            hit = np.bitwise_count(codes[x] ^ codes[todo]).sum(axis=1) <= radius
            found, todo = todo[hit], todo[~hit]
            u.append(found)
            v.append(np.full(len(found), x))
            front += found.tolist()
    return (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64),) * 2


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(radius: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A spanning forest of the near pairs that collide in this table and group; without the pairs of small buckets that an earlier table of the same word brings together."""
        t = int(key[0])
        every = tables(radius)
        word, mask = every[t]
        earlier = [m for w, m in every[:t] if w == word]
        codes = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(-1, len(CODE))
        k = key_of(codes, mask)
        order = np.argsort(k)
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(k[order]) != 0]), len(k)])
        order = order[np.repeat(size > 1, size)]
        size = size[size > 1]
        codes = codes[order]
        cuts = np.r_[0, np.cumsum(size)].astype(np.int64)
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        large = np.repeat(size > SMALL_BUCKET, size)
        small = codes[~large]
        columns = [np.ascontiguousarray(small[:, c]) for c in range(len(CODE))]
        at = np.flatnonzero(~large)
        sizes = size[size <= SMALL_BUCKET]
        for i, j in collisions(len(small), np.cumsum(sizes) - sizes):
            ok = within(columns, i, j, radius)
            i, j = i[ok], j[ok]
            diff = small[i] ^ small[j]
            first = np.ones(len(i), bool)
            for m in earlier:
                first &= ((diff & m) != 0).any(axis=1)
            u.append(at[i[first]])
            v.append(at[j[first]])
        for b in np.flatnonzero(size > SMALL_BUCKET):
            x, y = forest(codes[cuts[b] : cuts[b + 1]], radius)
            u.append(x + cuts[b])
            v.append(y + cuts[b])
        # a node of several buckets is linked in all of them; the forest is of this table alone
        label = least_labels(np.concatenate(u), np.concatenate(v), len(codes))
        moved = np.flatnonzero(label != np.arange(len(codes)))
        return pd.DataFrame({"u": node_of(codes[moved]), "v": node_of(codes[label[moved]])})

    return run


def near_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) of the written table (node, c0...) of distinct codes: a graph with the connected components of that of all pairs within radius."""
    n = nodes.count()
    codes = nodes.select(*CODE)
    cells, hot = 1, {}
    if n > CELL_ENTRIES:
        cells = 1 << math.ceil(math.log2(2 * n / CELL_ENTRIES))
        count = codes.mapInArrow(_cells(radius, cells), "t int, c int, n bigint").groupBy("t", "c").agg(F.sum("n").alias("n"))
        # no more of them than entries divided by CELL_ENTRIES
        hot = {(r["t"], r["c"]): math.ceil(r["n"] / CELL_ENTRIES) for r in count.where(F.col("n") > CELL_ENTRIES).collect()}
    return codes.mapInArrow(_pack(radius, cells, hot), PACKED).groupBy("t", "c", "i", "j").applyInPandas(_meet(radius), "u bigint, v bigint")


def code_table(docs: DataFrame) -> DataFrame:
    """(doc_id, node, codes) of the documents that have an id and a word, written."""
    codes = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("text"))
    return written(codes.mapInArrow(_codes, "doc_id bigint, node bigint, " + ", ".join(f"{c} bigint" for c in CODE)), "codes")


def duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, duplicate_of) of every document that a group's first document, the one with the smallest id, stands for.

    Two documents are near-duplicates if their codes differ in at most radius of 256 bits; all such pairs are found, and groups
    are connected components, found exactly. Equal codes are one node. Null ids and texts without words are never duplicates. Long texts are read in pieces, as one text. Rows that share an id are one document:
    they don't make each other a duplicate, and either's code counts for it. Other columns aren't read.
    """
    table = code_table(docs)
    nodes = written(table.groupBy("node").agg(*(F.first(c).alias(c) for c in CODE)), "nodes")
    edges = written(near_edges(nodes, radius), "near")
    # documents that share an id link their nodes
    twice = table.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    if not twice.isEmpty():
        edges = edges.union(table.select("doc_id", "node").distinct().join(twice, "doc_id").where("node <> a").select("a", "node"))
    found = components(edges)
    of = table.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("g")).distinct()
    of = written(of, "members")
    first = of.groupBy("g").agg(F.min("doc_id").alias("duplicate_of"), F.count("*").alias("n")).where("n > 1")
    return of.join(first, "g").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that duplicates() finds: one of each group stays. Rows equal in id and text become one; null ids stay."""
    gone = written(duplicates(docs, **how).select("doc_id"), "gone")
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(sized(gone), "doc_id", "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(sized(repeated), "doc_id", "left_anti")
    return once.unionByName(kept.join(sized(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
