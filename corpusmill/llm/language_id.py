"""Language identification in two steps: the family by linear SVMs, then one-versus-one linear SVMs among the languages of that family."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import sized, written

BUCKETS, SCALE = 1 << 13, 64.0
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca"), "romance"),
    **dict.fromkeys(("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"), "slavic"),
    **dict.fromkeys(("ja",), "japonic"), **dict.fromkeys(("zh",), "sinitic"), **dict.fromkeys(("fi", "et", "hu"), "uralic"),
}


def folded() -> np.ndarray:
    """Bytes as they count: letters and bytes of other scripts as they are, all else as one blank."""
    t = np.full(256, 32, np.uint32)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    return t


def grams(column: pa.Array, table: np.ndarray, chunk: int = 1 << 20):
    """For chunks of lower-case texts: (first row, offsets, bucket of the three bytes from each place; BUCKETS where they are all blank or leave the text). A text
    longer than chunk comes in pieces, all with its row."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)

    def buckets(begin: int, end: int, upto: int) -> np.ndarray:
        """Of the places from begin to end in a run of bytes that ends at upto."""
        b = np.r_[table[data[begin : min(end + 2, upto)]], np.full(max(0, end + 2 - upto), 32, np.uint32)]
        x = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        h = ((x * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64)
        h[x == 0x202020] = BUCKETS
        return h

    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1))
        begin, upto = int(offsets[lo]), int(offsets[hi])
        for at in range(begin, max(upto, begin + 1), chunk):
            end = min(upto, at + chunk)
            h = buckets(at, end, upto)
            off = np.clip(offsets[lo : hi + 1] - at, 0, end - at)
            ends = np.concatenate([offsets[lo + 1 : hi + 1] - at - 1, offsets[lo + 1 : hi + 1] - at - 2])
            h[ends[(ends >= 0) & (ends < len(h))]] = BUCKETS  # they would reach into the next text
            yield lo, off, h
        lo = hi


def sums_by_row(off: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _vectors(batches):
    table = folded()
    for b in batches:
        rows = {}
        for lo, off, h in grams(b.column(1), table):
            for k, (i, j) in enumerate(zip(off[:-1], off[1:]), lo):
                counts = np.bincount(h[i:j], minlength=BUCKETS + 1)[:BUCKETS].astype(np.float32)
                rows[k] = rows[k] + counts if k in rows else counts
        none = np.zeros(BUCKETS, np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rows.get(k, none).tobytes() for k in range(b.num_rows)], pa.binary())], names=["lang", "v"])


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; y is +1 or -1, classes weigh alike; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    share = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    most = np.array([c * share[s] for s in y])
    q, a, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), most[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def model(docs: DataFrame, families: dict[str, str], max_per_language: int, seed: int) -> dict:
    """Weights of every classifier. Fitted on at most max_per_language labelled rows of each language, the first in the order of a seeded hash."""
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND lang <> ''").select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    chosen = written(labelled.withColumn("r", rank).where(F.col("r") <= max_per_language).select("doc_id", "lang"), "fit")
    rows = docs.select("doc_id", F.col("lang").alias("l"), F.lower("text").alias("text")).join(sized(chosen), "doc_id").where("l = lang").select("lang", "text").mapInArrow(_vectors, "lang string, v binary").collect()
    rows = sorted((r["lang"], bytes(r["v"])) for r in rows)
    x = np.array([np.frombuffer(v, np.float32) for _, v in rows], np.float32).reshape(-1, BUCKETS)
    lang = np.array([k for k, _ in rows])
    full = x.sum(1) > 0
    x, lang = x[full], lang[full]
    x *= SCALE / np.maximum(x.sum(1, keepdims=True), 1)
    family = np.array([families.get(k, f"other:{k}") for k in lang])
    names = sorted(set(family))
    out = {"families": names, "of": {f: sorted(set(lang[family == f])) for f in names}, "weights": []}
    if len(names) > 1:
        for f in names[: 1 if len(names) == 2 else None]:
            out["weights"].append(("family", f, "", svm(x, np.where(family == f, 1, -1))))
    for f in names:
        for i, a in enumerate(out["of"][f]):
            for b in out["of"][f][i + 1 :]:
                m = (lang == a) | (lang == b)
                out["weights"].append(("pair", a, b, svm(x[m], np.where(lang[m] == a, 1, -1))))
    return out


def decide(scores: np.ndarray, fitted: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Families, languages and margins of the rows of classifier scores; margin is the least of the margins on the way. Ties go to the first name."""
    names = fitted["families"]
    column = {(k, a, b): scores[:, i] for i, (k, a, b, _) in enumerate(fitted["weights"])}
    margin = np.full(len(scores), np.inf)
    if len(names) == 1:
        family = np.zeros(len(scores), np.int64)
    elif len(names) == 2:
        v = column["family", names[0], ""]
        family, margin = (v < 0).astype(np.int64), np.abs(v)
    else:
        v = np.stack([column["family", n, ""] for n in names], axis=1)
        family = v.argmax(1)
        two = np.partition(v, -2, axis=1)[:, -2:]
        margin = two[:, 1] - two[:, 0]
    language = np.full(len(scores), "", object)
    for f, name in enumerate(names):
        at = np.flatnonzero(family == f)
        langs = fitted["of"][name]
        votes, strength = np.zeros((len(langs), len(at))), np.zeros((len(langs), len(at)))
        gap = np.full((len(langs), len(langs), len(at)), np.inf)
        for i, a in enumerate(langs):
            for j in range(i + 1, len(langs)):
                v = column["pair", a, langs[j]][at]
                votes[i] += v >= 0
                votes[j] += v < 0
                strength[i] += v
                strength[j] -= v
                gap[i, j] = gap[j, i] = np.abs(v)
        best = np.zeros(len(at), np.int64)
        rows = np.arange(len(at))
        for k in range(1, len(langs)):
            more = (votes[k] > votes[best, rows]) | ((votes[k] == votes[best, rows]) & (strength[k] > strength[best, rows]))
            best[more] = k
        language[at] = np.array(langs, object)[best]
        margin[at] = np.minimum(margin[at], gap[best, :, rows].min(axis=1) if len(at) else np.empty(0))
    return np.array(names, object)[family], language, np.where(np.isinf(margin), 0.0, np.round(margin, 6))


def _predict(fitted: dict):
    weights = [w for *_, w in fitted["weights"]]
    by_bucket = [np.r_[w[:BUCKETS] * SCALE, 0.0] for w in weights]

    def run(batches):
        table = folded()
        for b in batches:
            n, s = np.zeros(b.num_rows), np.zeros((b.num_rows, len(weights)))
            for lo, off, h in grams(b.column(1), table):
                rows = slice(lo, lo + len(off) - 1)
                n[rows] += sums_by_row(off, h < BUCKETS)
                for k, w in enumerate(by_bucket):
                    s[rows, k] += sums_by_row(off, w[h])
            s = s / np.maximum(n, 1)[:, None] + np.array([w[BUCKETS] for w in weights])
            family, language, margin = (np.full(b.num_rows, "und", object), np.full(b.num_rows, "und", object), np.zeros(b.num_rows))
            some = np.flatnonzero(n > 0)
            if fitted["families"] and len(some):
                family[some], language[some], margin[some] = decide(s[some], fitted)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(family, pa.string()), pa.array(language, pa.string()), pa.array(margin)], names=["doc_id", "family", "language", "margin"])

    return run


def language_id(docs: DataFrame, *, families: dict[str, str] | None = None, max_per_language: int = 400, seed: int = 1) -> DataFrame:
    """(doc_id, family, language, margin) of every row of docs, from its whole text.

    Features are frequencies of three-byte windows of the lower-case text. Texts without such a window (null, empty, under three bytes,
    marks alone) are "und" with margin 0; so is everything if no row has a label. A label outside families is a family of its own. Rows with a
    null id are classified, not fitted on. Repeated rows repeat. Ties go to the first name. Long texts are read in pieces, whose sums add up. Other columns are ignored. max_per_language bounds the labelled rows fitted on.
    """
    fitted = model(docs, FAMILIES if families is None else families, max_per_language, seed)
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_predict(fitted), "doc_id bigint, family string, language string, margin double")
