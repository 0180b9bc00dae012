"""Sums over pairs of words within a window, made of numbers: what shuffles is a few bytes a pair.

A first pass counts words. Their places in the order of frequency stand for them in the second: tasks make pairs of places, each pair once for both of its
orders, add up equal ones and send the rest, packed, in buckets of the rarer word. A rare word has few partners, a common one few that are more common, so
that no bucket is hot. Words come back where a bucket is added up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

#: Tokens that are looked at and pairs that are sorted at once; pairs of a bucket; rows of a batch of results.
TOKENS, PAIRS, BUCKET, ROWS = 1 << 20, 4_000_000, 2_000_000, 1 << 16
SCHEMA = "bucket int, data binary"


def pieces(b: pa.RecordBatch, column: int = 0, most: int | None = None):
    """b in runs of rows whose lists hold so many items at most, or one row that holds more, each with the lists' sizes; a null list has none."""
    size = pa.compute.fill_null(pa.compute.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + (most or TOKENS), "right")))
        yield b.slice(lo, hi - lo), size[lo:hi]
        lo = hi


@dataclass
class Lexicon:
    """Words from the most frequent on, with numbers of theirs; for the look-up their hashes in order, with their places. No two words have one hash."""

    words: pa.Array
    hashes: np.ndarray
    places: np.ndarray
    key: str
    sums: list[np.ndarray]

    @classmethod
    def of(cls, words: pa.Array, *sums: np.ndarray) -> Lexicon:
        """The more frequent words are those whose sums add up to more."""
        for k in range(9):
            h = hashed(words, key := f"corpusmill-{k:05}")
            by_hash = np.argsort(h)
            if (np.diff(h[by_hash]) > 0).all():
                break
        else:
            raise ValueError("words aren't distinct")
        order = np.lexsort((h, -sum(sums)))
        places = np.empty(len(h), np.int32)
        places[order] = np.arange(len(h), dtype=np.int32)
        return cls(words.take(pa.array(order)), h[by_hash], places[by_hash], key, [x[order] for x in sums])


def hashed(words: pa.Array, key: str) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), hash_key=key, categorize=False) if len(words) else np.empty(0, np.uint64)


def places(tokens: pa.Array, hashes: np.ndarray, place: np.ndarray, key: str) -> np.ndarray:
    """The places of tokens; -1 for nulls and words that aren't in the lexicon."""
    d = tokens.dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    h = hashed(d.dictionary, key)
    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
    own = np.append(np.where(hashes[at] == h, place[at], -1) if len(hashes) else np.full(len(h), -1), -1).astype(np.int64)
    return own[d.indices.fill_null(len(h)).to_numpy(zero_copy_only=False)]


def _seen(have: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """For each place whether it and the one k further hold words of one document."""
    return (row[:-k] == row[k:]) & have[:-k] & have[k:] if k < len(row) else np.zeros(0, bool)


def window_sums(docs: DataFrame, left: int, right: int) -> DataFrame:
    """(token, row_sum, col_sum): the pairs that each word is in as the row and as the column word. Made of the places of words, without pairs."""

    def run(batches):
        for batch in batches:
            for b, size in pieces(batch):
                d = b.column(0).flatten().dictionary_encode()
                at = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
                after, before = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                r, c = after.copy(), after.copy()
                row = np.repeat(np.arange(len(size)), size)
                for k in range(1, max(left, right) + 1):
                    ok = _seen(at < len(d.dictionary), row, k)
                    after[:], before[:] = 0, 0
                    after[: len(ok)], before[len(before) - len(ok) :] = ok, ok
                    r += after * (k <= right) + before * (k <= left)
                    c += before * (k <= right) + after * (k <= left)
                n = len(d.dictionary)
                sums = [np.bincount(at, x, n + 1)[:n].astype(np.int64) for x in (r, c)]
                yield pa.RecordBatch.from_arrays([d.dictionary, *map(pa.array, sums)], names=["token", "row_sum", "col_sum"])

    rows = docs.where(F.size("tokens") > 1).select("tokens").mapInArrow(run, "token string, row_sum bigint, col_sum bigint")
    return rows.groupBy("token").agg(F.sum("row_sum").alias("row_sum"), F.sum("col_sum").alias("col_sum")).where("row_sum + col_sum > 0")


def column(table: pa.Table, name: str) -> pa.Array:
    x = table[name].combine_chunks()
    return x.cast(pa.string()) if name == "token" else x


def packed(*arrays: np.ndarray) -> bytes:
    """Integers from 0 (or doubles) as planes of their bytes, compressed."""
    head, planes = [len(arrays[0])], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        n = 8 if x.dtype == np.float64 else max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes())
        head.append(n)
    return np.array(head, np.int64).tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(data: bytes, kinds: list) -> list[np.ndarray]:
    head = np.frombuffer(data, np.int64, len(kinds) + 1)
    n, at, out = int(head[0]), 0, []
    raw = np.frombuffer(pa.decompress(data[8 * len(head) :], n * int(head[1:].sum()), "zstd"), np.uint8)
    for width, kind in zip(head[1:], kinds):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(x.reshape(-1).view(kind))
        at += n * width
    return out


def summed(order_of: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different numbers of an ascending array, and of each the sums of the values that stand with it."""
    cuts = np.flatnonzero(np.r_[True, order_of[1:] != order_of[:-1]]) if len(order_of) else np.zeros(0, np.int64)
    return order_of[cuts], *(np.add.reduceat(v, cuts) if len(cuts) else v[:0] for v in values)


@dataclass
class Deal:
    """Pairs as numbers whose order is that of the buckets: of each, the spread place of the rarer word stands before that of the other."""

    bits: int
    buckets: int

    @classmethod
    def of(cls, lexicon: Lexicon, pairs: int, more: int) -> Deal:
        bits = max(1, len(lexicon.words).bit_length())
        if 2 * bits + more > 63:
            raise ValueError(f"{len(lexicon.words)} words are too many for pairs in one number")
        return cls(bits, max(1, min(1 << bits, -(-pairs // BUCKET))))

    @property
    def spread(self) -> int:
        return int(0.6180339887498949 * (1 << self.bits)) | 1

    def key(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((high * self.spread & ((1 << self.bits) - 1)) << self.bits) | low

    def records(self, pair: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        high, low = pair >> self.bits, pair & ((1 << self.bits) - 1)
        cuts = np.searchsorted(high * self.buckets >> self.bits, np.arange(self.buckets + 1))
        held = np.flatnonzero(np.diff(cuts))
        data = [packed(np.diff(high[s], prepend=0), low[s], *(x[s] for x in sums)) for s in (slice(cuts[k], cuts[k + 1]) for k in held)]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    def added(self, batches, kinds: list) -> tuple | None:
        """(low, high, sums...) of a bucket's records; None without any."""
        got = [unpacked(d.as_buffer().to_pybytes(), [np.int64, np.int64, *kinds]) for b in batches for d in b.column(1)]
        if not got:
            return None
        key = np.concatenate([(np.cumsum(g[0]) << self.bits) | g[1] for g in got])
        values = [np.concatenate([g[k] for g in got]) for k in range(2, len(got[0]))]
        del got
        order = np.argsort(key)
        key, *values = summed(key[order], *(v[order] for v in values))
        mask = (1 << self.bits) - 1
        return key & mask, (key >> self.bits) * pow(self.spread, -1, 1 << self.bits) & mask, *values


def pair_sums(docs: DataFrame, lexicon: Lexicon, left: np.ndarray, right: np.ndarray, tokens: int, finish, schema: str, close: bool = False) -> DataFrame:
    """What finish(low, high, a, b) yields for the pairs of each bucket: places low <= high, a the sum of the weights with low as the row word, b with high.

    left, right: weights of the column word at distances 1, 2, ... before and after the row word, integers or doubles. tokens: how many there are, at most.
    Words outside the lexicon keep their places, or with close leave none.
    """
    reach, sc = max(len(left), len(right)), docs.sparkSession.sparkContext
    left, right = (np.r_[w, np.zeros(reach - len(w), w.dtype)] for w in (left, right))
    kinds = sorted({(r, l) for r, l in zip(right, left)} | set(zip(left, right)))
    kind_of = [[kinds.index((r, l)), kinds.index((l, r))] for r, l in zip(right, left)]
    weight = [np.array([k[i] for k in kinds]) for i in (0, 1)]
    both = bool((left == right).all())  # one sum does for both orders
    low_bits = max(1, (len(kinds) - 1).bit_length())
    deal = Deal.of(lexicon, tokens * reach, low_bits)
    known, value = sc.broadcast((lexicon.hashes, lexicon.places, lexicon.key)), weight[0].dtype

    def sent(keys: list[np.ndarray]):
        key = np.concatenate(keys)
        keys.clear()
        key.sort()
        what = weight[0][key & ((1 << low_bits) - 1)], weight[1][key & ((1 << low_bits) - 1)]
        key >>= low_bits
        return deal.records(*summed(key, *what[: 1 if both else 2]))

    def make(batches):
        keys, n = [], 0
        for batch in batches:
            for b, size in pieces(batch):
                at = places(b.column(0).flatten(), *known.value)
                row = np.repeat(np.arange(len(size)), size)
                if close:
                    at, row = at[at >= 0], row[at >= 0]
                for k in range(1, reach + 1):
                    if not (left[k - 1] or right[k - 1]):
                        continue
                    ok = _seen(at >= 0, row, k)
                    first, second = at[: len(ok)][ok], at[len(at) - len(ok) :][ok]
                    high, low = np.maximum(first, second), np.minimum(first, second)
                    keys.append((deal.key(low, high) << low_bits) | np.where(first <= second, *kind_of[k - 1]))
                    n += len(low)
                if n >= PAIRS:
                    yield sent(keys)
                    n = 0
        if n:
            yield sent(keys)

    def add(batches):
        if got := deal.added(batches, [value] * (1 if both else 2)):
            low, high, *sums = got
            yield from finish(low, high, sums[0], sums[-1])

    made = docs.where(F.size("tokens") > 1).select("tokens").mapInArrow(make, SCHEMA)
    return made.repartitionById(deal.buckets, F.col("bucket")).mapInArrow(add, schema)


def document_sums(docs: DataFrame, lexicon: Lexicon, pairs: int, finish, schema: str) -> DataFrame:
    """What finish(low, high, a, a) yields for the pairs of each bucket: places low < high of words that share documents, a the sum of the products of their counts."""
    deal = Deal.of(lexicon, pairs, 0)
    known = docs.sparkSession.sparkContext.broadcast((lexicon.hashes, lexicon.places, lexicon.key))

    def sent(keys: list[np.ndarray], values: list[np.ndarray]):
        key, value = np.concatenate(keys), np.concatenate(values)
        keys.clear()
        values.clear()
        order = np.argsort(key)
        return deal.records(*summed(key[order], value[order]))

    def make(batches):
        keys, values, n = [], [], 0
        for batch in batches:
            for b, size in pieces(batch):
                at, ends = places(b.column(0).flatten(), *known.value), np.cumsum(size)
                for lo, hi in zip(ends - size, ends):
                    own, count = np.unique(at[lo:hi], return_counts=True)
                    own, count = own[own >= 0], count[own >= 0]
                    upto, top = np.cumsum(np.arange(len(own))), 1
                    # words top to stop, each with all more frequent ones; a long document goes in parts
                    while top < len(own):
                        stop = max(top + 1, int(np.searchsorted(upto, upto[top - 1] + PAIRS - n, "right")))
                        j = np.repeat(np.arange(top, stop), np.arange(top, stop))
                        i = np.arange(len(j)) - np.repeat(upto[top - 1 : stop - 1] - upto[top - 1], np.arange(top, stop))
                        keys.append(deal.key(own[i], own[j]))
                        values.append(count[i] * count[j])
                        top, n = stop, n + len(j)
                        if n >= PAIRS:
                            yield sent(keys, values)
                            n = 0
        if n:
            yield sent(keys, values)

    def add(batches):
        if got := deal.added(batches, [np.dtype(np.int64)]):
            low, high, a = got
            yield from finish(low, high, a, a)

    made = docs.where(F.size("tokens") > 1).select("tokens").mapInArrow(make, SCHEMA)
    return made.repartitionById(deal.buckets, F.col("bucket")).mapInArrow(add, schema)


def cells(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray):
    """The cells of a bucket, (row, column, value) by places, in runs of ROWS pairs."""
    for at in range(0, len(low), ROWS):
        l, h, x, y = (v[at : at + ROWS] for v in (low, high, a, b))
        same = l == h
        x, y = np.where(same, x + y, x), np.where(same, 0, y)
        row, col, value = np.r_[l, h], np.r_[h, l], np.r_[x, y]
        yield row[value > 0], col[value > 0], value[value > 0]
