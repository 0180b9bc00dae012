"""SpotSigs: near-duplicate documents by signatures at common words (Theobald, Siddharth and Paepcke 2008).

Each anchor (a common word) opens a signature: the anchor and the CHAIN content words after it. Documents are compared
as sets of signatures by Jaccard similarity. Signatures that one document alone has can't match; the others are put in order of rarity, and
documents meet only over the first of them (prefix filter), within the range of set lengths that the threshold admits. Sets are then
compared exactly, each pair once, in the group of the first signature that it shares.

Where more than HOT documents meet over one signature (a text with thousands of near copies), no pairs are written: the documents that such
signatures join are compared all with all, in cells of two blocks of bounded size, and only link counts and a forest leave a cell.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import sized, written
from .components import components
from .simhash import least_labels
from .wordhash import WordReader, hash_word, mix

CHAIN, STEP = 2, 1
GROUP_ENTRIES, PAIRS_A_BLOCK, BLOCK_ENTRIES = 2_000_000, 50_000, 4_000_000
#: Beyond HOT documents that meet over a signature they are compared in cells. Two blocks to a cell, of CELL_COST at most and one set: a set costs its length and ROW_COST, so 1,024 sets and 262,144 signatures.
HOT, CELL_COST, ROW_COST = 128, 1 << 18, 256
#: Pairs that are expanded at once.
MEETINGS = 1 << 20
ANCHORS = "the a an is are was were be been has have had do did that there this le la les un une des est sont était cette ce der die das ein eine ist sind war den dem el los las una es son era".split()
COMMON = ANCHORS + "of and to in it for on with as by from at or not but you he she they we his her its which who will would can could if so no all de et du que en dans par pour au aux qui sur pas plus avec ne se sa son il elle nous vous ou und zu von mit sich auf für im nicht als auch aus bei nach wie über einer um am y del al por con para su lo como más o pero sus".split()


def signatures(column: pa.Array, reader: WordReader, anchors: np.ndarray, common: np.ndarray):
    """(row, signature) of a column of lower-case texts, each once, in order of both."""
    for doc, word in reader.read(column, lambda w: (w.doc, w.hash)):
        content = np.flatnonzero(~np.isin(word, common))
        spots = np.flatnonzero(np.isin(word, anchors))
        k = np.searchsorted(content, spots, side="right")
        ok = k + (CHAIN - 1) * STEP < len(content)
        spots, k = spots[ok], k[ok]
        ok = doc[content[k + (CHAIN - 1) * STEP]] == doc[spots]
        spots, k = spots[ok], k[ok]
        s = word[spots]
        for j in range(CHAIN):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + word[content[k + j * STEP]])
        row = doc[spots]
        order = np.lexsort((s, row))
        row, s = row[order], s[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (s[1:] != s[:-1])] if len(row) else np.empty(0, bool)
        yield row[new], s[new]


def word_sets() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.unique(np.array([hash_word(w) for w in ws], np.uint64)) for ws in (ANCHORS, COMMON))


def text_node(text: str) -> int | None:
    """A hash of the words of a lower-case text; none without words."""
    words = " ".join(re.findall(r"\w+", text))
    return int.from_bytes(hashlib.blake2b(words.encode(), digest_size=8).digest(), "little", signed=True) if words else None


def _sets(batches):
    """(doc_id, node, size, sigs) of every row; node is a hash of the set, or of the text's words if it has no signature, null without words."""
    reader, (anchors, common) = WordReader(), word_sets()
    for b in batches:
        sets: list = [np.empty(0, np.uint64)] * b.num_rows
        for row, s in signatures(b.column(1), reader, anchors, common):
            cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(row)]):
                sets[int(row[lo])] = s[lo:hi]
        node = [int(mix(np.array([np.bitwise_xor.reduce(mix(s))], np.uint64) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else text_node(t.as_py() or "") for s, t in zip(sets, b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "node", "size", "sigs"])


def _pack(groups: int):
    def run(batches):
        for b in batches:
            sizes = b.column(1).to_numpy(zero_copy_only=False)
            if not len(sizes):
                continue
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64)
            g = (sig >> np.uint64(32)) % np.uint64(groups)
            order = np.argsort(g, kind="stable")
            cuts = np.searchsorted(g[order], np.arange(groups + 1))
            used = np.flatnonzero(cuts[1:] > cuts[:-1])
            node, sig = node[order], sig[order]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in used], pa.binary()) for x in (sig, node))], names=["g", "sig", "node"])

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, sig, df) of the signatures that two nodes have, df counting nodes."""
    sig, node = (np.frombuffer(b"".join(pdf[c]), t) for c, t in (("sig", np.int64), ("node", np.int64)))
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[new], node[new]
    _, at, df = np.unique(sig, return_inverse=True, return_counts=True)
    df = df[at]
    m = df > 1
    return pd.DataFrame({"node": node[m], "sig": sig[m], "df": df[m]})


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def _meet(threshold: float, hot: int, most: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each signature's documents the pairs whose set lengths the threshold admits, with the first signature that they share here and the sum of their lengths.
        Of a signature with more than hot documents: each with the least of them, and hot is true."""
        pdf = pd.concat(parts)
        sig, size, node = (pdf[c].to_numpy(np.int64) for c in ("sig", "size", "node"))
        order = np.lexsort((node, size, sig))
        sig, size, node = sig[order], size[order], node[order]
        begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        have = np.diff(np.r_[begin, len(sig)])
        many = np.repeat(have > hot, have)
        if many.any():
            least = np.repeat(np.minimum.reduceat(node, begin), have)
            yield pd.DataFrame({"a": least[many], "b": node[many], "sig": sig[many], "weight": 0, "hot": True})
            sig, size, node = sig[~many], size[~many], node[~many]
        run_of = np.cumsum(np.r_[False, sig[1:] != sig[:-1]]) if len(sig) else sig
        far = 1 << 40
        top = np.searchsorted(run_of * far + size, run_of * far + np.floor(size / threshold + 1e-9).astype(np.int64), side="right")
        n = np.maximum(top - np.arange(len(size)) - 1, 0)
        upto = np.cumsum(n)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
            k = n[lo:hi]
            i = np.repeat(np.arange(lo, hi), k)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            out = pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "sig": sig[i], "weight": size[i] + size[j], "hot": False})
            yield out.drop_duplicates(["a", "b"])  # signatures are in order: the least stays
            lo = hi

    return run


def shared_counts(left: np.ndarray, right: np.ndarray, begin: np.ndarray, sigs: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Of each pair of sets the number of signatures in both. Set k is sigs[begin[k]:begin[k + 1]], numbers from 0 on, without repeats."""
    n = np.diff(begin)
    top = int(sigs.max(initial=0)) + 1
    held = np.sort(np.repeat(np.arange(len(n)), n) * top + sigs)
    out = np.zeros(len(left), np.int64)
    upto = np.cumsum(n[left])
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        size = n[left[lo:hi]]
        pair = np.repeat(np.arange(lo, hi), size)
        at = np.repeat(begin[left[lo:hi]], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        ask = right[pair] * top + sigs[at]
        k = np.minimum(np.searchsorted(held, ask), len(held) - 1)
        out += np.bincount(pair[held[k] == ask], minlength=len(left))
        lo = hi
    return out


def _compare(threshold: float):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        """For each node of the block with a link: another one of its group, and the number of rows that it has links to here."""
        sets = sets.sort_values("node")
        names, size, rows = (sets[c].to_numpy(np.int64) for c in ("node", "size", "rows"))
        _, sigs = np.unique(np.concatenate([*sets["sigs"], np.empty(0, np.int64)]), return_inverse=True)
        begin = np.r_[0, np.cumsum([len(s) for s in sets["sigs"]])].astype(np.int64)
        a, b = (np.searchsorted(names, pairs[c].to_numpy(np.int64)) for c in "ab")
        both = shared_counts(a, b, begin, sigs.astype(np.int64))
        ok = both / np.maximum(size[a] + size[b] - both, 1) >= threshold - 1e-12
        a, b = a[ok], b[ok]
        links = (np.bincount(a, rows[b], len(names)) + np.bincount(b, rows[a], len(names))).astype(np.int64)
        label = least_labels(a, b, len(names))
        some = links > 0
        return pd.DataFrame({"u": names[some], "v": names[label[some]], "links": links[some]})

    return run


def shared_table(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], dense: int = 1024, step: int = 512, most: int = 1 << 20) -> np.ndarray:
    """Of each set of the left with each of the right the number of signatures in both. Sides are (set, signature), both numbers from 0 on, without repeats."""
    top = int(max(left[1].max(initial=0), right[1].max(initial=0))) + 1
    n_left, n_right = (np.bincount(sig, minlength=top) for _, sig in (left, right))
    out = np.zeros(shape, np.float32)
    frequent = n_left * n_right > dense
    for columns in np.split(np.flatnonzero(frequent), range(step, int(frequent.sum()), step)):
        column = np.full(top, -1)
        column[columns] = np.arange(len(columns))
        held = [np.zeros((n, len(columns)), np.float32) for n in shape]
        for table, (row, sig) in zip(held, (left, right)):
            c = column[sig]
            table[row[c >= 0], c[c >= 0]] = 1
        out += held[0] @ held[1].T
    row = right[0][np.argsort(right[1], kind="stable")]
    begin = np.cumsum(n_right) - n_right
    at = np.flatnonzero(~frequent[left[1]] & (n_right[left[1]] > 0))
    k, first = n_right[left[1][at]], begin[left[1][at]]
    upto = np.cumsum(k)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        n = k[lo:hi]
        j = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(left[0][at[lo:hi]], n), row[j]), 1)
        lo = hi
    return out


def _cell(threshold: float, strip: int = 128):
    def run(sets: pd.DataFrame) -> pd.DataFrame:
        """All pairs of a left and a right block, or within one that comes alone: for each node with a link another one of its group, and the number of rows that it has links to here."""
        sets = sets.sort_values(["side", "node"])
        names, size, rows, side = (sets[c].to_numpy(np.int64) for c in ("node", "size", "rows", "side"))
        _, sigs = np.unique(np.concatenate([*sets["sigs"]]), return_inverse=True)
        of = np.repeat(np.arange(len(names)), [len(s) for s in sets["sigs"]])
        n_left = int((side == 0).sum())
        alone = n_left == len(names)
        second = 0 if alone else n_left
        here, there = of < n_left, of >= second
        both = shared_table((of[here], sigs[here]), (of[there] - second, sigs[there]), (n_left, len(names) - second))
        links = np.zeros(len(names), np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, n_left, strip):
            hi = min(n_left, lo + strip)
            c = both[lo:hi].astype(np.float64)
            ok = c / np.maximum(size[lo:hi, None] + size[None, second:] - c, 1) >= threshold - 1e-12
            if alone:
                ok &= np.arange(n_left) > np.arange(lo, hi)[:, None]
            links[lo:hi] += ok @ rows[second:]
            links[second:] += rows[lo:hi] @ ok
            x, y = np.nonzero(ok)
            a.append(x + lo)
            b.append(y + second)
        label = least_labels(np.concatenate(a), np.concatenate(b), len(names))
        some = links > 0
        return pd.DataFrame({"u": names[some], "v": names[label[some]], "links": links[some]})

    return run


def _within(lists: DataFrame, group: DataFrame, threshold: float) -> DataFrame:
    """(u, v, links) of all pairs of nodes of one component. A component in order of set length is cut into blocks; a cell is two blocks whose lengths the threshold admits."""
    order = Window.partitionBy("component").orderBy("size", "node").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.sum(F.col("n") + ROW_COST).over(order)
    member = group.join(lists.select("node", "size", F.size("sigs").cast("long").alias("n")), "node")
    member = written(member.select("component", "node", "size", F.floor(cost / CELL_COST).alias("block")), "blocks")
    blocks = member.groupBy("component", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    right = blocks.select("component", F.col("block").alias("other"), F.col("lo").alias("other_lo"))
    cells = blocks.join(right, "component").where((F.col("other") >= F.col("block")) & (F.col("other_lo") <= F.floor(F.col("hi") / threshold + 1e-9)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("block").alias("at")), F.struct(F.lit(1).alias("side"), F.col("other").alias("at")))
    cells = cells.select("component", F.col("block").alias("x"), F.col("other").alias("y"), F.explode(sides).alias("s")).where("s.side = 0 OR x <> y").select("component", "x", "y", "s.side", F.col("s.at").alias("block"))
    sets = cells.join(member.select("component", "block", "node"), ["component", "block"]).join(lists.select("node", "size", "rows", "sigs"), "node")
    return sets.groupBy("component", "x", "y").applyInPandas(_cell(threshold), "u bigint, v bigint, links bigint")


def spotsigs(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc_id, class_id, n_links), one row for each row of docs. n_links: the other rows whose signature sets have at least the Jaccard similarity threshold with its own.
    class_id: the least doc_id of the rows that links join with it, directly or through others; its own where it has none.

    Rows with equal sets are links, and so are rows without a signature whose words are the same. Null, empty and wordless texts have no link. Repeated rows, and rows that share an id or
    have none, are rows of their own; null is no least id, but the class of a group without ids. Long texts are read in pieces, as one text. Other columns are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    table = written(docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_sets, "doc_id bigint, node bigint, size int, sigs binary"), "sets")
    sets = table.where("size > 0")
    groups = max(1, math.ceil((sets.agg(F.sum("size")).first()[0] or 0) / GROUP_ENTRIES))
    shared = written(sets.select("node", "size", "sigs").mapInArrow(_pack(groups), "g int, sig binary, node binary").groupBy("g").applyInPandas(_shared, "node bigint, sig bigint, df bigint"), "shared")
    sizes = written(table.where("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.count("*").alias("rows")), "sizes")
    # in order of rarity a set begins with its own signatures, which are known by number alone
    entry = F.array_sort(F.collect_list(F.struct("df", "sig")))
    lists = shared.groupBy("node").agg(entry.alias("s")).join(sizes, "node")
    length = F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("s"))
    lists = written(lists.where(length > 0).select("node", "size", "rows", length.cast("int").alias("n"), F.transform("s", lambda x: x["sig"]).alias("sigs")), "lists")
    first = lists.select("node", "size", F.explode(F.slice("sigs", 1, F.col("n"))).alias("sig"))
    parts = max(1, math.ceil((lists.agg(F.sum("n")).first()[0] or 0) / GROUP_ENTRIES * 4))
    met = written(first.groupBy(F.pmod("sig", F.lit(parts))).applyInPandas(_meet(threshold, HOT, MEETINGS), "a bigint, b bigint, sig bigint, weight bigint, hot boolean"), "met")
    pairs = met.where("NOT hot")
    crowd = met.where("hot").select(F.col("b").alias("u"), F.col("a").alias("v"))
    group = written(components(crowd), "groups") if crowd.head(1) else None
    if group:
        # pairs within a component are compared in its cells
        for x in "ab":
            pairs = pairs.join(sized(group).select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")), x, "left")
        pairs = pairs.where(F.coalesce(F.col("a_of") != F.col("b_of"), F.lit(True)))
    pairs = written(pairs.groupBy("a", "b").agg(F.min("sig").alias("sig"), F.first("weight").alias("weight")), "pairs")
    count, weight = pairs.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    blocks = max(1, math.ceil(count / PAIRS_A_BLOCK), math.ceil(weight / BLOCK_ENTRIES))
    pairs = pairs.withColumn("k", F.pmod("sig", F.lit(blocks)))
    need = pairs.select(F.col("k").alias("block"), F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = need.join(lists.select("node", "size", "rows", "sigs"), "node")
    near = pairs.groupBy("k").cogroup(needed.groupBy("block")).applyInPandas(_compare(threshold), "u bigint, v bigint, links bigint")
    near = written(near.unionByName(_within(lists, group, threshold)) if group else near, "near")
    links = near.groupBy("u").agg(F.sum("links").alias("links"))
    of = sizes.join(links, F.col("node") == F.col("u"), "left").drop("u").join(components(near.select("u", "v")), "node", "left")
    of = of.select("node", F.coalesce("component", "node").alias("g"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of = written(of.where("n_links > 0"), "linked")
    # the least id of a group is found with partial sums, so that a group of a third of all rows is no hot key
    member = written(table.select("doc_id", "node").join(sized(of), "node", "left"), "members")
    least = written(member.where("g IS NOT NULL").groupBy("g").agg(F.min("doc_id").alias("class_id")), "least")
    out = member.join(sized(least), "g", "left")
    return out.select("doc_id", F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
