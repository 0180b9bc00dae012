"""Text, stopword and vector sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tokens import blanks


def read_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(tokens): a sentence per line, tokens between blanks; blank lines go and don't count for limit."""
    out = spark.read.text(path).select(blanks(F.col("value")).alias("tokens")).where(F.size("tokens") > 0)
    return out.limit(limit) if limit is not None else out


def detect_encoding(content: bytes, sample: int = 10_000) -> str:
    """utf-8 if the first bytes are (a character cut at the sample's end aside), else gb18030."""
    try:
        content[:sample].decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < min(len(content), sample) - 4 or len(content) <= sample:
            return "gb18030"
    return "utf-8"


def read_texts(spark: SparkSession, path: str | list[str], encoding: str = "auto") -> DataFrame:
    """(path, text) of whole files; bytes that the encoding doesn't know become replacement marks. Spark's decode() has no GB charsets: an Arrow UDF."""

    @F.arrow_udf("string")
    def decoded(content: pa.Array) -> pa.Array:
        out = []
        for b in content.to_pylist():
            out.append(None if b is None else b.decode(detect_encoding(b) if encoding == "auto" else encoding, "replace"))
        return pa.array(out, pa.string())

    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))


def read_stopwords(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(word): the union of stripped lines of all files."""
    return spark.read.text(paths).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def stopwords_of(folder: str, name: str) -> list[str]:
    """Files of a folder of word lists that a name stands for: the list of that name, else all whose names begin with it and an underscore."""
    from pathlib import Path

    have = stopword_lists(folder)
    found = [name] if name in have else [x for x in have if x.startswith(f"{name}_")]
    if not found:
        raise ValueError(f"no stopword list {name!r}: {have}")
    return [str(Path(folder) / f"{x}.txt") for x in found]


def stopword_lists(folder: str) -> list[str]:
    from pathlib import Path

    return sorted(p.stem for p in Path(folder).glob("*.txt"))


def bundled_stopwords(language: str) -> list[str]:
    """The library's own list of common words of a language."""
    if language not in STOPWORDS:
        raise ValueError(f"no stopword list {language!r}: {stopword_languages()}")
    return STOPWORDS[language].split()


def stopword_languages() -> list[str]:
    return sorted(STOPWORDS)


STOPWORDS = {
    "en": "a about after again all also am an and any are as at be because been before being between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your",
    "de": "aber alle als also am an auch auf aus bei bin bis da das dass dem den der des die dies diese dieser doch du durch ein eine einem einen einer er es für hat habe haben hier ich ihm ihn ihr ihre im in ist ja kann kein keine man mehr mein mit nach nicht noch nun nur ob oder ohne sein seine sich sie sind so um und uns unter von vor war was weil wenn wer wie wir wird wo zu zum zur über",
    "fr": "à au aux avec ce ces cette comme dans de des donc dont du elle elles en est et eu été il ils je la le les leur leurs lui mais me même mes mon ne nos notre nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y",
    "es": "a al algo como con cuando de del desde donde dos el ella ellas ellos en entre era es esa ese eso esta este esto fue ha hasta hay la las le les lo los más me mi mis mucho muy nada ni no nos o otra otro para pero poco por porque que quien se ser si sin sobre son su sus también te tiene todo tu tus un una uno y ya yo",
    "zh": "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 他 她 它 们 我们 你们 他们 这个 那个 与 及 或 但 但是 而 而且 因为 所以 如果 虽然 之 其 以 于 为 被 把 从 向 对 等 吗 呢 吧 啊",
}


def write_word2vec_binary(vectors: DataFrame, path: str) -> None:
    """(word, vec) in the binary word2vec form: one file of a local or mounted folder, written row by row by the driver, which holds one partition at a time."""
    import numpy as np

    n, d = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    with open(path, "wb") as f:
        f.write(f"{n} {d or 0}\n".encode())
        for r in vectors.select("word", "vec").toLocalIterator():
            f.write(r["word"].encode() + b" " + np.asarray(r["vec"], "<f4").tobytes() + b"\n")


def read_word2vec_binary(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of binary word2vec files of up to 2 GB each, parsed on the executors."""

    def parse(batches):
        import numpy as np

        for b in batches:
            for content in b.column(0).to_pylist():
                head = content.index(b"\n")
                n, d = map(int, content[:head].split())
                at, words, rows = head + 1, [], []
                for _ in range(n):
                    blank = content.index(b" ", at)
                    words.append(content[at:blank].decode("utf-8", "replace").lstrip("\n"))
                    rows.append(np.frombuffer(content, "<f4", d, blank + 1))
                    at = blank + 1 + 4 * d
                    at += content[at : at + 1] == b"\n"
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))], names=["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "word string, vec array<float>")


def write_vectors(vectors: DataFrame, path: str, form: str = "glove") -> None:
    """(word, vec) as text, a word and its numbers per line; word2vec files begin with a line of counts and are written by one task."""
    line = vectors.select("word", F.concat_ws(" ", "word", F.transform("vec", lambda x: x.cast("string"))).alias("value"))
    if form == "glove":
        line.select("value").write.text(path)
        return
    if form != "word2vec":
        raise ValueError(f"unknown form {form!r}")
    head = vectors.agg(F.count("*").alias("n"), F.first(F.size("vec")).alias("d")).select(F.lit(0).alias("o"), F.lit("").alias("word"), F.concat_ws(" ", "n", "d").alias("value"))
    head.unionByName(line.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o", "word").select("value").write.text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of either text form; a line of two numbers is the word2vec head."""
    parts = F.split(F.rtrim("value"), " ")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2).select(F.col("p")[0].alias("word"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def save_table(df: DataFrame, path: str) -> None:
    """Models are tables: no pickles. Those with a state of their own have save() and load()."""
    df.write.mode("overwrite").parquet(path)
