"""Line dedup with two Bloom filters: hashes seen once, hashes seen twice. Only lines that the second filter suspects are confirmed.

Lines become 128-bit hashes in a compact table. Hashes travel packed, 8 bytes each, to shards of bounded size; each shard
keeps a once-seen and a twice-seen filter and returns the second, folded to what it holds. Filters are a table: the
planner broadcasts it while it is small and else joins by shard. Suspects alone are grouped, with map-side
combining, so a line that half of all documents hold is no hot key. Texts stay where they are: the line numbers to drop are broadcast
while they are few; else a filter of the documents concerned tells whose text must shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import remove, written

SHARD_LINES, BITS_A_LINE, MAX_BITS = 1 << 18, 16, 1 << 22
#: Documents to be changed are broadcast up to so many rows and line numbers; beyond, only their texts shuffle.
MOST_ROWS, MOST_LINES = 250_000, 2_000_000


def line_key(line):
    return F.btrim(line, F.lit(" \t\r"))


def _positions(h: np.ndarray, mask: int) -> list[np.ndarray]:
    u = h.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64(mask)).astype(np.int64) for s in (0, 21, 42)]


def _pack(shards: int):
    def run(batches):
        for b in batches:
            h, times = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            s = (((h.view(np.uint64) >> np.uint64(11)).view(np.int64)) ^ h ^ (h >> 37)) % shards
            order = np.argsort(s, kind="stable")
            h, times, s = h[order], times[order], s[order].astype(np.int32)
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, int)
            groups = [(s[i], h[i:j], times[i:j] > 1) for i, j in zip(cuts, [*cuts[1:], len(s)])]
            yield pa.RecordBatch.from_arrays([pa.array([int(g) for g, _, _ in groups], pa.int32()), pa.array([x.tobytes() for _, x, _ in groups], pa.binary()), pa.array([x[t].tobytes() for _, x, t in groups], pa.binary())], names=["shard", "seen", "repeated"])

    return run


def bloom_pair(blobs: list[np.ndarray], repeated: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The once-seen and the twice-seen filter of hashes that come in blobs without repeats; repeated: those a blob held more than once."""
    n = sum(map(len, blobs))
    size = min(MAX_BITS, 1 << max(6, math.ceil(math.log2(max(1, n * BITS_A_LINE)))))
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    for h in blobs:
        at = _positions(h, size - 1)
        hit = once[at[0]] & once[at[1]] & once[at[2]]
        for p in at:
            twice[p[hit]] = True
            once[p] = True
    for h in repeated:
        for p in _positions(h, size - 1):
            twice[p] = True
    return once, twice


def fold(bits: np.ndarray, fullest: float = 0.1) -> np.ndarray:
    """Halves a filter while it stays sparse; positions are masks, so a folded filter still answers yes for all it holds."""
    while len(bits) > 64:
        half = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
        if half.mean() > fullest:
            break
        bits = half
    return bits


def _bitmap(shard: int, bits: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "words": [np.packbits(bits, bitorder="little").view(np.int64)], "mask": [len(bits) - 1]})


NO_BITMAP = pd.DataFrame({"shard": pd.Series(dtype="int32"), "words": pd.Series(dtype=object), "mask": pd.Series(dtype="int64")})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    _, twice = bloom_pair(*([np.frombuffer(x, np.int64) for x in pdf[c]] for c in ("seen", "repeated")))
    return _bitmap(pdf["shard"].iloc[0], fold(twice)) if twice.any() else NO_BITMAP


def _build_once(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter of all hashes of a shard."""
    once, _ = bloom_pair([np.frombuffer(x, np.int64) for x in pdf["seen"]], [])
    return _bitmap(pdf["shard"].iloc[0], fold(once))


def filter_table(hashes: DataFrame, shards: int, build) -> DataFrame:
    """(shard, words, mask) of a column of hashes."""
    return hashes.mapInArrow(_pack(shards), "shard int, seen binary, repeated binary").groupBy("shard").applyInPandas(build, "shard int, words array<bigint>, mask bigint")


def _held(hash: str) -> str:
    """SQL: whether a filter's words may hold the hash."""
    at = lambda s: f"(shiftrightunsigned({hash}, {s}) & mask)"
    return " AND ".join(f"(shiftrightunsigned(words[cast(shiftright({at(s)}, 6) AS INT)], cast({at(s)} & 63 AS INT)) & 1) = 1" for s in (0, 21, 42))


def shard_of(col: str, shards: int):
    """The shard of a hash, as _pack() has it: shifts and xor can't overflow in ANSI mode."""
    return F.expr(f"cast(pmod(shiftrightunsigned({col}, 11) ^ {col} ^ shiftright({col}, 37), {shards}) AS INT)")


#: What tells documents apart: rows equal in both are one document.
DOC = ("doc_id", "t")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t: hash of the text, drop: array of line numbers) of the documents with lines that occur earlier."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(*DOC, "pos", line_key(F.col("line")).alias("line")).where("line <> ''")
    table = written(lines.select(*DOC, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")), "lines")
    shards = max(1, math.ceil(table.count() / SHARD_LINES))
    filters = written(filter_table(table.select("h1"), shards, _build), "filters")
    sharded = table.withColumn("shard", shard_of("h1", shards))
    suspects = written(sharded.alias("l").join(filters.alias("f"), (F.col("l.shard") == F.col("f.shard")) & F.expr(_held("h1"))).select(*DOC, "pos", "h1", "h2"), "suspects")
    first = suspects.groupBy("h1", "h2").agg(F.min(F.struct(*DOC, "pos")).alias("at")).select("at.*", F.lit(True).alias("first"))
    both = suspects.select(*DOC, "pos", F.lit(False).alias("first")).unionByName(first)
    of = lambda flag: F.collect_list(F.when(F.col("first") == flag, F.col("pos")))
    out = written(both.groupBy(*DOC).agg(F.array_except(of(False), of(True)).alias("drop")).where(F.size("drop") > 0), "drops")
    remove(table)
    remove(suspects)
    return out


def with_drops(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with __drop, null where nothing is dropped. Texts of documents without such lines don't shuffle; where drops is small, none does."""
    spark = docs.sparkSession
    n, lines = drops.agg(F.count("*"), F.sum(F.size("drop"))).first()
    drops = drops.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("drop").alias("__drop"))
    same = (F.col("__hash") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    if n <= MOST_ROWS and (lines or 0) <= MOST_LINES:
        return hashed.join(F.broadcast(drops), same, "left").drop("__id", "__t", "__hash")
    shards = max(1, math.ceil(n / SHARD_LINES))
    concerned = written(filter_table(drops.select("__t"), shards, _build_once), "concerned").select(F.col("shard").alias("__shard"), F.col("words").alias("__words"), F.col("mask").alias("__mask"))
    held = F.expr(_held("__hash").replace("words[", "__words[").replace("mask", "__mask"))
    marked = hashed.join(concerned, shard_of("__hash", shards) == F.col("__shard"), "left").withColumn("__held", F.coalesce(held, F.lit(False))).drop("__shard", "__words", "__mask")
    stay = marked.where("NOT __held").withColumn("__drop", F.lit(None).cast("array<int>"))
    go = marked.where("__held").join(drops, same, "left").drop("__id", "__t")
    return stay.unionByName(go.select(*stay.columns)).drop("__held", "__hash")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with its text without the lines that an earlier place holds, and n_lines, n_dropped.

    A line is what stands between newlines; lines are equal if they are so without blanks at their ends. The first place
    (smallest doc_id, null first; then, among rows that share an id or have none, smallest hash of the text; then line number)
    keeps the line. Blank lines stay. Null text stays null with 0 lines, empty text stays empty. Rows that share doc_id and text are one
    document and get the same text; rows that share an id but differ in text are different documents. A document of
    repeats alone keeps its row with empty text. A table without repeated lines comes back as it is, an empty one empty.
    Other columns pass through; columns named n_lines or n_dropped are replaced.
    """
    lines = F.col("__lines")  # a column of its own: else each use would split the text again
    out = with_drops(docs.drop("n_lines", "n_dropped"), repeated_lines(docs)).withColumn("__lines", F.split("text", "\n"))
    # by hash sets, so that the time is linear in the lines
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(kept)
    return out.withColumns({"n_lines": n(F.size(lines)), "n_dropped": n(F.coalesce(F.size("__drop"), F.lit(0))), "text": text}).drop("__drop", "__lines")


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
ranked AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k, row_number() OVER (PARTITION BY trim(line, ' ' || chr(9) || chr(13)) ORDER BY doc_id, pos) AS rn FROM lines)
SELECT d.doc_id, coalesce(x.text, '') AS text, x.n_lines, x.n_dropped
FROM documents d JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (k = '' OR rn = 1) AS text,
         CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (k <> '' AND rn > 1) AS BIGINT) AS n_dropped
  FROM ranked GROUP BY doc_id) x ON d.doc_id = x.doc_id"""
