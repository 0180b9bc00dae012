"""Segmentation: split texts into units, tokenize each by a registered tokenizer, filter tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import TOKENIZERS, chunks

ENDS = "。！？\\.!?…"


def sentences(text: Column) -> Column:
    """Sentences with their end marks; blank ones go unless a mark follows."""
    parts = F.regexp_extract_all(text, F.lit(f"([^{ENDS}]*[{ENDS}]+|[^{ENDS}]+)"), F.lit(1))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: s != "")


def units(text: Column, strategy: str = "document", chunk_size: int = 512, overlap: float = 0.0) -> Column:
    if strategy == "document":
        return F.when(text.isNotNull(), F.array(text))
    if strategy == "line":
        return lines(text)
    if strategy == "sentence":
        return sentences(text)
    if strategy == "chunk":
        return chunks(text, chunk_size, overlap, text=True)
    raise ValueError(f"unknown strategy {strategy!r}")


def large_pieces(text: str, limit: int = 100_000) -> list[str]:
    """Cuts a text at the last end mark past half the limit; marks are tried in turn; without one, at the limit."""
    out = []
    while len(text) > limit:
        at = limit
        for mark in "。！？!?\n":
            k = text.rfind(mark, limit // 2, limit)
            if k >= 0:
                at = k + 1
                break
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def merge_tags(tokens: Column, tags: Column, labels: str = "BMES") -> Column:
    """Words of tagged characters. BE and BME: a B begins a word after the one that is open. BMES: a B drops what is open, an S is a word."""
    if labels not in ("BE", "BME", "BMES"):
        raise ValueError(f"unknown labels {labels!r}")
    pairs = F.arrays_zip(tokens.alias("w"), tags.alias("t"))
    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit("").alias("open"))
    push = lambda words, w: F.concat(words, F.array(w))
    flush = lambda s: F.when(s["open"] != "", push(s["words"], s["open"])).otherwise(s["words"])

    def step(s: Column, x: Column) -> Column:
        w, t = x["w"], x["t"]
        begin = F.struct((s["words"] if labels == "BMES" else flush(s)).alias("words"), w.alias("open"))
        go = F.struct(s["words"].alias("words"), F.concat(s["open"], w).alias("open"))
        end = F.struct(push(s["words"], F.concat(s["open"], w)).alias("words"), F.lit("").alias("open"))
        alone = F.struct(push(s["words"], w).alias("words"), s["open"].alias("open"))
        other = F.when(s["open"] != "", go).otherwise(alone)
        out = F.when(t == "B", begin).when(t == "E", end)
        if "M" in labels:
            out = out.when(t == "M", go)
        if "S" in labels:
            out = out.when(t == "S", alone)
        return out.otherwise(other)

    return F.aggregate(pairs, start, step, flush)


def longest_match(dictionary: list[str]) -> Callable[[list[str]], list[list[str]]]:
    """Forward maximum matching over a word list; characters outside it stand alone, blanks go."""
    words, longest = frozenset(dictionary), max(map(len, dictionary), default=1)

    def run(texts: list[str]) -> list[list[str]]:
        out = []
        for text in texts:
            i, tokens = 0, []
            while i < len(text):
                size = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
                if not text[i : i + size].isspace():
                    tokens.append(text[i : i + size])
                i += size
            out.append(tokens)
        return out

    return run


REGISTRY: dict[str, Callable] = {}


def register(name: str, factory: Callable[..., Callable[[list[str]], list[list[str]]]]) -> None:
    """A tokenizer from elsewhere: factory() is called once a worker and gives a function of texts."""
    REGISTRY[name] = factory


def user_words(source: list | dict | str | None) -> list[tuple]:
    """Entries (word[, frequency or tag[, tag]]) of a list of words or tuples, of a dict of words and tags, or of a file with an entry a line."""
    if source is None:
        return []
    if isinstance(source, dict):
        return list(source.items())
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            return [tuple(line.split()) for line in f if line.strip()]
    return [(w,) if isinstance(w, str) else tuple(w) for w in source]


def spacy_tokenizer(model: str = "zh_core_web_sm", disable: tuple[str, ...] = ("ner", "lemmatizer"), user_dict=None, batch_size: int = 200, longest: int = 100_000):
    """Long texts are cut into pieces at end marks; words come with their coarse tags."""
    import spacy

    nlp = spacy.load(model, disable=list(disable))
    if user_dict is not None:
        nlp.tokenizer.pkuseg_update_user_dict([w[0] for w in user_words(user_dict)])

    def run(texts: list[str]):
        pieces = [large_pieces(t, longest) for t in texts]
        found = iter(nlp.pipe((p for ps in pieces for p in ps), batch_size=batch_size))
        return [[(t.text, t.pos_) for _ in ps for t in next(found)] for ps in pieces]

    return run


def jieba_tokenizer(user_dict=None, tags: bool = False):
    import jieba

    for w, *rest in user_words(user_dict):
        freq = next((int(x) for x in rest if str(x).isdigit()), None)
        jieba.add_word(w, freq, next((x for x in rest if not str(x).isdigit()), None))
    if not tags:
        return lambda texts: [list(jieba.cut(t)) for t in texts]
    from jieba import posseg

    return lambda texts: [[(w.word, w.flag) for w in posseg.cut(t)] for t in texts]


def pkuseg_tokenizer(model_name: str = "default", user_dict=None, tags: bool = False):
    import pkuseg

    words = [w[0] for w in user_words(user_dict)]
    seg = pkuseg.pkuseg(model_name=model_name, user_dict=words or "default", postag=tags)
    return lambda texts: [[tuple(x) if tags else x for x in seg.cut(t)] for t in texts]


def bert_tokenizer(model: str, labels: str = "BMES", batch_size: int = 8, longest: int = 510):
    """Words from a model's tag for each character."""
    from transformers import pipeline

    tagger = pipeline("token-classification", model=model)

    def run(texts: list[str]):
        pieces = [[t[i : i + longest] for i in range(0, len(t), longest)] for t in texts]
        out = iter(tagger([p for ps in pieces for p in ps], batch_size=batch_size))
        words = []
        for ps in pieces:
            words.append([])
            for p in ps:
                tag = ["S"] * len(p)
                for x in next(out):
                    tag[x["start"]] = x["entity"][-1:] if x["entity"][-1:] in labels else x["entity"][:1]
                words[-1] += merged_words(list(p), tag)
        return words

    return run


def merged_words(chars: list[str], tags: list[str]) -> list[str]:
    """Characters joined by B, M, E and S tags."""
    out, open_ = [], ""
    for c, t in zip(chars, tags):
        if t in "BS" and open_:
            out.append(open_)
            open_ = ""
        open_ += c
        if t in "ES":
            out.append(open_)
            open_ = ""
    return [*out, open_] if open_ else out


def hanlp_tokenizer(model: str = "COARSE_ELECTRA_SMALL_ZH", user_dict=None):
    import hanlp

    tok = hanlp.load(getattr(hanlp.pretrained.tok, model, model))
    if user_dict is not None:
        tok.dict_combine = {w[0] for w in user_words(user_dict)}
    return lambda texts: [list(x) for x in tok(list(texts))] if texts else []


register("dictionary", lambda dictionary: longest_match([w[0] for w in user_words(dictionary)]))
# each imports its library on the worker that runs it
for _name, _factory in (("spacy", spacy_tokenizer), ("jieba", jieba_tokenizer), ("pkuseg", pkuseg_tokenizer), ("bert", bert_tokenizer), ("hanlp", hanlp_tokenizer)):
    register(_name, _factory)


def segment(docs: DataFrame, *, how: str = "words", strategy: str = "document", stopwords: list[str] | None = None, min_word_length: int = 1, text: str = "text", chunk_size: int = 512, overlap: float = 0.0, excluded_pos: list[str] | None = None, **options) -> DataFrame:
    """docs with a unit number and tokens: a row per document, line, sentence or chunk. excluded_pos: tags whose words go, for tokenizers that give (word, tag); options are the tokenizer's."""
    if excluded_pos and how in TOKENIZERS:
        raise ValueError(f"{how!r} gives no tags")
    if excluded_pos and how in ("jieba", "pkuseg"):
        options["tags"] = True
    out_pos = frozenset(excluded_pos or ())
    out = docs.withColumn("__units", units(F.col(text), strategy, chunk_size, overlap)).select("*", F.posexplode("__units").alias("unit", "__unit")).drop("__units")
    if how in TOKENIZERS:
        tokens = TOKENIZERS[how](F.col("__unit"))
    elif how in REGISTRY:
        factory = REGISTRY[how]

        @F.arrow_udf("array<string>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            f = factory(**options)
            for b in batches:
                found = f([t or "" for t in b.to_pylist()])
                yield pa.array([[t if isinstance(t, str) else t[0] for t in ts if isinstance(t, str) or t[1] not in out_pos] for ts in found], pa.list_(pa.string()))

        tokens = run(F.col("__unit"))
    else:
        raise ValueError(f"unknown tokenizer {how!r}: {sorted([*TOKENIZERS, *REGISTRY])}")
    out = out.withColumn("tokens", tokens).drop("__unit")
    keep = lambda t: (F.char_length(t) >= min_word_length) & (F.trim(t) != "") & (~t.isin(stopwords) if stopwords else F.lit(True))
    return out.withColumn("tokens", F.filter("tokens", keep))
