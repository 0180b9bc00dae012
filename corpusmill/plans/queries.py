"""The library's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stats import chi2_stat, g2_stat
from ..functions.tokens import chunks, ngrams, tokenized
from ..functions.vectors import cosine_similarity
from ..operators import collocation, cooc, corpus, embeddings, keyness, lexical, normalize, reuse, segment, topics, vectors
from ..operators.stylometry import METRICS, Stylometry

TARGETS = ["the", "that", "de"]
WORDS = ["the", "of", "and", "to", "in", "that", "is", "for", "on", "it", "de", "la", "que", "der", "die", "und"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents").where(where)).select("doc_id", "lang", "source", "tokens")


def split_by_quality(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("side"))
    return docs(s, d).join(q, "doc_id").select("side", F.explode("tokens").alias("token"))


def rounded(df: DataFrame, digits: int = 6, **of: int) -> DataFrame:
    """Doubles rounded (columns named in of to so many digits), and -0.0 as 0.0, so that engines agree."""
    return df.select(*[(F.round(F.col(c), of.get(c, digits)) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


#: p-values: logarithms of factorials are sums of some millions, of which engines have ten digits.
P = {"p_value": 4, "adjusted_p_value": 4}


def stylometry(s: SparkSession, d: str, **how) -> tuple[Stylometry, DataFrame]:
    m = Stylometry(n_features=50, **how)
    return m, m.fit_transform(docs(s, d).withColumn("author", F.col("source")))


TOK = r"SELECT doc_id, lang, source, regexp_extract_all(lower(text), '\p{L}+') AS tokens FROM documents"
ONE = f"WITH d AS ({TOK}), t AS (SELECT doc_id, lang, source, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM d)"


def words_sql(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ---- counts


def q_vocabulary(s, d):
    return corpus.vocabulary(docs(s, d))


SQL_VOCABULARY = f"{ONE} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS doc_freq FROM t GROUP BY token"


def q_doc_freq(s, d):
    return corpus.doc_freq(docs(s, d))


SQL_DOC_FREQ = f"{ONE} SELECT token, count(DISTINCT doc_id) AS doc_freq FROM t GROUP BY token"


def q_most_frequent(s, d):
    return corpus.most_frequent(docs(s, d), 100)


SQL_MOST_FREQUENT = f"{ONE} SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 100"


def q_limited_vocabulary(s, d):
    return corpus.limited_vocabulary(docs(s, d), min_word_count=5, min_doc_count=3)


SQL_LIMITED_VOCABULARY = f"{ONE} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS doc_freq FROM t GROUP BY token HAVING count(*) >= 5 AND count(DISTINCT doc_id) >= 3"


def q_ngrams(s, d):
    return docs(s, d).select(F.explode(ngrams(F.col("tokens"), 1, 2)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


SQL_NGRAMS = f"{ONE} SELECT ngram, count(*) AS n FROM (SELECT token AS ngram FROM t UNION ALL SELECT a.token || ' ' || b.token FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1) GROUP BY ngram"


def q_chunks(s, d):
    c = chunks(F.col("tokens"), 100, 0.25)
    return docs(s, d).select("doc_id", F.posexplode(F.transform(c, lambda x: F.array_join(x, " "))).alias("chunk", "text"))


SQL_CHUNKS = f"""WITH d AS ({TOK}), k AS (SELECT doc_id, tokens, unnest(range(0, greatest(len(tokens), 1), 75)) AS i FROM d WHERE len(tokens) > 0)
SELECT doc_id, CAST(i // 75 AS INTEGER) AS chunk, array_to_string(tokens[i + 1 : i + 100], ' ') AS text FROM k WHERE i = 0 OR i - 75 + 100 < len(tokens)"""


def q_char_chunks(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(segment.units(F.col("text"), "chunk", 500)).alias("unit", "text"))


SQL_CHAR_CHUNKS = "SELECT doc_id, CAST(i // 500 AS INTEGER) AS unit, substr(text, i + 1, 500) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS i FROM documents WHERE length(text) > 0)"


def q_lines(s, d):
    return segment.segment(table(s, d, "documents"), strategy="line", how="blanks", min_word_length=2).select("doc_id", F.col("unit"), F.array_join("tokens", " ").alias("line"))


SQL_LINES = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS s FROM documents),
u AS (SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS unit, unnest(s) AS line FROM l)
SELECT doc_id, unit, array_to_string(list_filter(regexp_extract_all(line, '[^\s\x1c-\x1f]+'), lambda t: length(t) >= 2), ' ') AS line FROM u"""


def q_sentences(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.posexplode(segment.sentences(F.col("text"))).alias("k", "sentence"))


SQL_SENTENCES = r"""WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?…]*[。！？.!?…]+|[^。！？.!?…]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)
SELECT conv_id, turn, CAST(unnest(range(len(s))) AS INTEGER) AS k, unnest(s) AS sentence FROM p"""


def q_balanced(s, d):
    b = corpus.balanced(docs(s, d), "lang", "doc_id")
    return b.groupBy("lang").agg(F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"), F.count("*").alias("n_docs"))


SQL_BALANCED = f"""WITH d AS (SELECT doc_id, lang, len(tokens) AS n FROM ({TOK})), b AS (SELECT min(n) AS b FROM (SELECT sum(n) AS n FROM d GROUP BY lang)),
r AS (SELECT d.*, b.b - coalesce(sum(n) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d, b)
SELECT lang, CAST(sum(least(n, room)) AS BIGINT) AS n_tokens, count(*) AS n_docs FROM r WHERE room > 0 GROUP BY lang"""


# ---- keyness


def keyness_query(method, correction=None, filters=None, with_p=False):
    return lambda s, d: rounded(keyness.compare_corpora(split_by_quality(s, d), method=method, correction=correction, filters=filters or {"min_count": 3}, with_p=with_p), **P)


KEY = r"""WITH x AS (SELECT CASE WHEN l.quality = 1 THEN 'a' ELSE 'b' END AS side, unnest(regexp_extract_all(lower(d.text), '\p{L}+')) AS w FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT w AS word, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM x GROUP BY w),
n AS (SELECT word, a, b, CAST(sum(a) OVER () - a AS BIGINT) AS c, CAST(sum(b) OVER () - b AS BIGINT) AS d FROM c),
f AS (SELECT *, CAST(a AS DOUBLE) AS oa, CAST(b AS DOUBLE) AS ob, CAST(c AS DOUBLE) AS oc, CAST(d AS DOUBLE) AS od, CAST(a + b + c + d AS DOUBLE) AS t FROM n WHERE a >= 3 AND b >= 3),
e AS (SELECT *, (oa + ob) * (oa + oc) / t AS ea, (oa + ob) * (ob + od) / t AS eb, (oc + od) * (oa + oc) / t AS ec, (oc + od) * (ob + od) / t AS ed,
  oa / (oa + oc) AS ra, ob / (ob + od) AS rb FROM f)"""
KEY_OUT = "SELECT word, a AS abs_freqA, b AS abs_freqB, round(ra, 6) AS rel_freqA, round(rb, 6) AS rel_freqB, round(CASE WHEN rb = 0 THEN CAST('inf' AS DOUBLE) ELSE ra / rb END, 6) AS rel_ratio"


def chi_sql(yates: bool) -> str:
    gap = "greatest(abs({0} - {1}) - 0.5, 0)" if yates else "abs({0} - {1})"
    return " + ".join(f"pow({gap.format('o' + x, 'e' + x)}, 2) / e{x}" for x in "abcd")


G2_SQL = "2 * (" + " + ".join(f"CASE WHEN o{x} > 0 THEN o{x} * ln(o{x} / e{x}) ELSE 0 END" for x in "abcd") + ")"


def log_probability(x: str) -> str:
    return f"lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) - lgamma(a + c - {x} + 1) - lgamma(d - a + {x} + 1)"


def fisher_sql(cells: str, keys: str, alternative: str = "two-sided") -> str:
    """CTE fisher (keys, p): the test by its definition, over all tables with the same margins."""
    low, at = ("a", "true") if alternative == "greater" else ("greatest(0, a - d)", "lp <= own + 1e-8")
    return f""", support AS (SELECT {keys}, a, b, c, d, {log_probability("a")} AS own, unnest(range({low}, least(a + b, a + c) + 1)) AS x FROM {cells}),
chance AS (SELECT {keys}, own, {log_probability("x")} AS lp FROM support), fisher AS (SELECT {keys}, least(1, sum(exp(lp)) FILTER ({at})) AS p FROM chance GROUP BY {keys})"""


def adjusted_sql(method: str) -> str:
    """Of p over the rows of the table it stands in."""
    if method == "bonferroni":
        return "least(1, p * count(*) OVER ())"
    return "least(1, min(q) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


KEY_FISHER = KEY + fisher_sql("e", "word") + ", w AS (SELECT e.*, p, row_number() OVER (ORDER BY p) AS k, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM e JOIN fisher USING (word))"


# ---- collocation and concordance

WINDOW_SQL = f"""{ONE}, g AS (SELECT * FROM t WHERE token IN ({words_sql(TARGETS)})),
h AS (SELECT DISTINCT g.token AS target, t.doc_id, t.pos, t.token AS collocate FROM g JOIN t ON t.doc_id = g.doc_id AND t.pos BETWEEN g.pos - {{left}} AND g.pos + {{right}} WHERE t.token <> g.token),
a AS (SELECT target, collocate, count(*) AS a FROM h GROUP BY ALL), n AS (SELECT token, count(*) AS n FROM t GROUP BY token),
x AS (SELECT a.target, a.collocate, a.a, CAST(sum(a.a) OVER (PARTITION BY a.target) AS BIGINT) AS seen, n.n, m.n AS nt, (SELECT count(*) FROM t) AS total FROM a JOIN n ON n.token = a.collocate JOIN n m ON m.token = a.target),
cells AS (SELECT target, collocate, a, seen - a AS b, n - a AS c, total - nt - seen - n + a AS d FROM x)"""
SENTENCE_SQL = f"""{ONE}, u AS (SELECT DISTINCT doc_id, token FROM t), a AS (SELECT g.token AS target, u.token AS collocate, count(*) AS a FROM u g JOIN u ON u.doc_id = g.doc_id AND u.token <> g.token WHERE g.token IN ({words_sql(TARGETS)}) GROUP BY ALL),
n AS (SELECT token, count(*) AS n FROM u GROUP BY token), x AS (SELECT a.*, n.n, m.n AS nt, (SELECT count(*) FROM d WHERE len(tokens) > 0) AS total FROM a JOIN n ON n.token = a.collocate JOIN n m ON m.token = a.target),
cells AS (SELECT target, collocate, a, nt - a AS b, n - a AS c, total - nt - n + a AS d FROM x)"""
CELLS_OUT = " SELECT target, collocate, a, b, c, d, round(CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d), 6) AS exp_local, round(a / (CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d)), 6) AS ratio_local FROM cells"


def cells(method, horizon=3):
    def q(s, d):
        c = collocation.contingency(docs(s, d), TARGETS, method, horizon, None)
        e = collocation.expected(*[F.col(x) for x in "abcd"])
        return rounded(c.select("*", e.alias("exp_local"), collocation.safe_ratio(F.col("a"), e).alias("ratio_local")))

    return q


def q_find_collocates(s, d):
    return rounded(collocation.find_collocates(docs(s, d), TARGETS, horizon=(2, 3), filters={"min_obs_local": 20}, correction="fdr_bh", max_length=None), **P)


# a horizon is relative to the target
FIND_SQL = (
    WINDOW_SQL.replace("{left}", "2").replace("{right}", "3")
    + ", kept AS (SELECT * FROM cells WHERE a >= 20)"
    + fisher_sql("kept", "target, collocate", "greater")
    + """, w AS (SELECT kept.*, p, row_number() OVER (ORDER BY p) AS k, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q, CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d) AS e FROM kept JOIN fisher USING (target, collocate))
SELECT target, collocate, round(e, 6) AS exp_local, a AS obs_local, round(a / e, 6) AS ratio_local, a + c AS obs_global, round(p, 4) + 0.0 AS p_value, """
    + f"round({adjusted_sql('fdr_bh')}, 4) + 0.0 AS adjusted_p_value FROM w"
)


def q_compare_collocates(s, d):
    return rounded(collocation.compare_collocates(docs(s, d, "lang = 'en'"), docs(s, d, "lang <> 'en'"), ["the", "de"], filters={"min_obs_local": 5}, horizon=2, max_length=None).drop("p_value_a", "p_value_b"))


def _compare_sql() -> str:
    side = lambda where: WINDOW_SQL.replace(words_sql(TARGETS), words_sql(["the", "de"])).replace("{left}", "2").replace("{right}", "2").replace("FROM documents)", f"FROM documents WHERE {where})") + " SELECT target, collocate, a AS obs, a / (CAST(a + b AS DOUBLE) * (a + c) / (a + b + c + d)) AS ratio FROM cells WHERE a >= 5"
    return f"""WITH x AS ({side("lang = 'en'")}), y AS ({side("lang <> 'en'")}), z AS (SELECT coalesce(x.target, y.target) AS target, coalesce(x.collocate, y.collocate) AS collocate, x.ratio AS ra, y.ratio AS rb, x.obs AS oa, y.obs AS ob,
CASE WHEN x.ratio > 0 AND y.ratio > 0 THEN log2(y.ratio / x.ratio) END AS g FROM x FULL JOIN y ON x.target = y.target AND x.collocate = y.collocate)
SELECT target, collocate, round(ra, 6) AS ratio_a, round(rb, 6) AS ratio_b, round(g, 6) AS log_ratio_change, coalesce(oa, 0) AS obs_a, coalesce(ob, 0) AS obs_b,
CASE WHEN oa IS NULL THEN 'appeared' WHEN ob IS NULL THEN 'disappeared' WHEN g > 0.1 THEN 'strengthened' WHEN g < -0.1 THEN 'weakened' ELSE 'stable' END AS status FROM z"""


def kwic_query(sort, max_results=None):
    def q(s, d):
        k = collocation.kwic(docs(s, d), ["worthless", "pathetic", "license"], horizon=(4, 2), sort=sort, max_results=max_results, max_length=None)
        return k.select("left", "node", "right", F.col("doc_index").cast("bigint").alias("doc_index"), F.col("position").cast("bigint").alias("position"))

    return q


KWIC_SQL = f"""{ONE}, i AS (SELECT doc_id, tokens, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM d WHERE len(tokens) > 0)
SELECT array_to_string(i.tokens[greatest(t.pos - 3, 1) : t.pos], ' ') AS left, t.token AS node, array_to_string(i.tokens[t.pos + 2 : t.pos + 3], ' ') AS right, i.doc_index, t.pos AS position
FROM t JOIN i ON i.doc_id = t.doc_id WHERE t.token IN ('worthless', 'pathetic', 'license')"""


# ---- matrices

COOC_SQL = f"""{ONE}, m AS (SELECT a.token AS row_word, b.token AS col_word, count(*) AS value FROM (SELECT doc_id, token, pos, unnest([-2, -1, 1, 2, 3]) AS k FROM t) a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.k GROUP BY ALL)"""


def q_cooc(s, d, method="window"):
    return cooc.cooc_matrix(docs(s, d), method=method, horizon=(2, 3))


def q_ppmi(s, d):
    return rounded(cooc.window_ppmi(docs(s, d), (2, 3), 0.75), 4)


PPMI_SQL = COOC_SQL + """, r AS (SELECT row_word, sum(value) AS r FROM m GROUP BY 1), c AS (SELECT col_word, pow(sum(value), 0.75) AS c FROM m GROUP BY 1),
p AS (SELECT m.row_word, m.col_word, log2(m.value * (SELECT sum(c) FROM c) / (r.r * c.c)) AS value FROM m JOIN r USING (row_word) JOIN c USING (col_word))
SELECT row_word, col_word, round(value, 4) AS value FROM p WHERE value > 0"""


def q_cooc_sums(s, d):
    return cooc.window_sums_and_cells(docs(s, d), (2, 3))


COOC_SUMS_SQL = COOC_SQL + " SELECT row_word, col_word, CAST(sum(value) AS BIGINT) AS value, count(*) AS nnz FROM m GROUP BY GROUPING SETS ((row_word), (col_word), ())"


def q_glove_cooc(s, d):
    return rounded(embeddings.glove_cooc(docs(s, d), 5))


GLOVE_SQL = f"""{ONE} SELECT a.token AS row_word, b.token AS col_word, round(sum(1.0::DOUBLE / abs(a.k)), 6) AS x FROM (SELECT doc_id, token, pos, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS k FROM t) a
JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + a.k GROUP BY ALL"""


# ---- lexical measures


def q_ttr(s, d):
    v = [lexical.type_token_ratio(F.col("tokens"), k).alias(k) for k in ("standard", "root", "log")]
    return rounded(docs(s, d).select("doc_id", *v))


TTR_SQL = f"""WITH d AS ({TOK}), v AS (SELECT doc_id, CAST(len(list_distinct(tokens)) AS DOUBLE) AS v, CAST(nullif(len(tokens), 0) AS DOUBLE) AS n FROM d)
SELECT doc_id, round(v / n, 6) AS standard, round(v / sqrt(n), 6) AS root, round(CASE WHEN n = 1 THEN 1 ELSE ln(nullif(v, 0)) / nullif(ln(n), 0) END, 6) AS log FROM v"""


def q_vocabulary_stats(s, d):
    return rounded(lexical.vocabulary_stats(docs(s, d)))


STATS_SQL = f"""WITH d AS ({TOK}), t AS (SELECT doc_id, unnest(tokens) AS w FROM d), c AS (SELECT doc_id, w, count(*) AS f FROM t GROUP BY ALL),
p AS (SELECT doc_id, sum(f) AS n, count(*) AS v, sum(f * f) AS s FROM c GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) <= 1 THEN 0 ELSE 10000.0 * (s - n)::DOUBLE / (n * n)::DOUBLE END, 6) AS yule_k, CAST(coalesce(n, 0) AS BIGINT) AS token_count, coalesce(v, 0) AS type_count, round(v / n::DOUBLE, 6) AS ttr FROM d LEFT JOIN p USING (doc_id)"""


def q_mattr(s, d):
    return rounded(lexical.mattr(docs(s, d), 50))


# an occurrence counts in the windows that hold it but not the one before
MATTR_SQL = f"""{ONE}, n AS (SELECT doc_id, len(tokens) AS n FROM d), p AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS before FROM t),
s AS (SELECT doc_id, sum(greatest(0, least(p.pos, n.n - 50) - greatest(coalesce(before + 1, 0), p.pos - 49, 0) + 1)) AS types FROM p JOIN n USING (doc_id) WHERE n >= 50 GROUP BY doc_id)
SELECT n.doc_id, round(types / ((n - 49) * 50)::DOUBLE, 6) AS mattr FROM n LEFT JOIN s USING (doc_id)"""


def q_rolling_average(s, d):
    e = table(s, d, "events")
    r = lexical.rolling_average(e, "value", 5, ["ts", "event_id"], ["user_id"], "truncate")
    return rounded(r.select("event_id", "rolling"), 4)


ROLLING_SQL = """SELECT event_id, round(r, 4) AS rolling FROM (SELECT event_id, avg(value) OVER w AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE k >= 5"""


def q_relative_frequencies(s, d):
    return rounded(lexical.relative_frequencies(docs(s, d), "lang"), 8)


RELATIVE_SQL = f"{ONE} SELECT lang, token, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE), 8) AS rel_freq FROM t GROUP BY lang, token"


# ---- stylometry

STYLE = f"""{ONE}, tot AS (SELECT doc_id, source, count(*) AS total FROM t GROUP BY ALL),
feat AS (SELECT token AS feature FROM t GROUP BY token ORDER BY count(*) DESC, token LIMIT 50),
cnt AS (SELECT doc_id, token AS feature, count(*) AS n FROM t GROUP BY ALL),
rel AS (SELECT tot.doc_id, tot.source AS author, feat.feature, coalesce(cnt.n / CAST(tot.total AS DOUBLE), 0) AS rel FROM tot CROSS JOIN feat LEFT JOIN cnt ON cnt.doc_id = tot.doc_id AND cnt.feature = feat.feature),
st AS (SELECT feature, avg(rel) AS mean, CASE WHEN stddev_pop(rel) < 1e-10 THEN 1 ELSE stddev_pop(rel) END AS std, ln(count(*)::DOUBLE / greatest(count(*) FILTER (rel > 0), 1)) AS idf FROM rel GROUP BY feature),
z AS (SELECT doc_id, author, feature, (rel - mean) / std AS value FROM rel JOIN st USING (feature)),
cen AS (SELECT author, feature, (avg(rel) - mean) / std AS value FROM rel JOIN st USING (feature) GROUP BY author, feature, mean, std)"""
DIST_SQL = {
    "cosine": "1 - sum(x.value * y.value) / (sqrt(sum(x.value * x.value)) * sqrt(sum(y.value * y.value)))",
    "burrows_delta": "avg(abs(x.value - y.value))",
    "manhattan": "sum(abs(x.value - y.value))",
    "euclidean": "sqrt(sum(pow(x.value - y.value, 2)))",
    "eder_delta": "sqrt(avg(pow(x.value - y.value, 2)))",
}


def style_distance(metric):
    return lambda s, d: rounded(stylometry(s, d, distance=metric)[0].distance_matrix("author"))


def q_style_features(s, d):
    return rounded(stylometry(s, d)[1])


def q_style_tfidf(s, d):
    return rounded(stylometry(s, d, transform="tfidf")[1])


def q_style_predict(s, d):
    m, _ = stylometry(s, d, distance="burrows_delta")
    return rounded(m.predict(docs(s, d), 3).select("doc_id", "author", "distance"), 5)


STYLE_PREDICT_SQL = STYLE + """, dist AS (SELECT x.doc_id, y.author, avg(abs(x.value - y.value)) AS distance FROM z x JOIN cen y USING (feature) GROUP BY ALL)
SELECT doc_id, author, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, author) AS r FROM dist) WHERE r <= 3"""


def q_style_comparison(s, d):
    """Authors as rows: their columns are named by the data."""
    c = stylometry(s, d)[0].feature_comparison()
    authors = [x for x in c.columns if x not in ("feature", "variance")]
    long = c.unpivot(["feature", "variance"], authors, "author", "value")
    return rounded(long, 5)


def q_style_profile(s, d):
    return rounded(stylometry(s, d)[0].author_profile())


def q_style_rolling(s, d):
    m, _ = stylometry(s, d, distance="manhattan")
    return rounded(m.rolling_delta(docs(s, d), 2000, 1000, "src0").select("doc_id", "position", "distance", "end_position"), 5)


STYLE_ROLLING_SQL = STYLE + """, w AS (SELECT doc_id, tokens, unnest(range(0, len(tokens) - 2000 + 1, 1000)) AS position FROM d WHERE len(tokens) >= 2000),
wt AS (SELECT doc_id, position, unnest(tokens[position + 1 : position + 2000]) AS feature FROM w), wc AS (SELECT doc_id, position, feature, count(*) / 2000.0::DOUBLE AS rel FROM wt GROUP BY ALL),
wf AS (SELECT w.doc_id, w.position, st.feature, (coalesce(wc.rel, 0) - mean) / std AS value FROM w CROSS JOIN st LEFT JOIN wc ON wc.doc_id = w.doc_id AND wc.position = w.position AND wc.feature = st.feature)
SELECT x.doc_id, x.position, round(sum(abs(x.value - y.value)), 5) AS distance, x.position + 2000 AS end_position FROM wf x JOIN cen y ON y.feature = x.feature AND y.author = 'src0' GROUP BY x.doc_id, x.position"""


def q_style_bootstrap(s, d):
    m, _ = stylometry(s, d, distance="burrows_delta")
    return m.bootstrap_predict(docs(s, d), 20)


def q_style_svm(s, d):
    x = docs(s, d).withColumn("author", F.col("lang"))
    m = Stylometry(n_features=50)
    m.fit_transform(x)
    return m.svm_predict(x)


def q_style_clusters(s, d):
    rows, names = stylometry(s, d)[0].hierarchical_clustering("average")
    return s.createDataFrame([(int(a), int(b), float(h), int(n)) for a, b, h, n in rows], "a int, b int, distance double, size int")


# ---- text reuse


def reuse_sides(s, d):
    b = tokenized(table(s, d, "benchmark")).select(F.col("item_id").alias("doc_id"), "tokens")
    return docs(s, d).select("doc_id", "tokens"), b


REUSE_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS k FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS k FROM benchmark),
dg AS (SELECT doc_id, i AS pos, array_to_string(k[i + 1 : i + 5], '~') AS g FROM (SELECT doc_id, k, unnest(range(len(k) - 4)) AS i FROM d WHERE len(k) >= 5)),
bg AS (SELECT item_id, i AS pos, array_to_string(k[i + 1 : i + 5], '~') AS g FROM (SELECT item_id, k, unnest(range(len(k) - 4)) AS i FROM b WHERE len(k) >= 5)),
s AS (SELECT dg.doc_id AS doc_a, bg.item_id AS doc_b, CAST(dg.pos AS INTEGER) AS pos_a, CAST(bg.pos AS INTEGER) AS pos_b FROM dg JOIN bg ON dg.g = bg.g)"""
ISLAND_SQL = REUSE_SQL + """, l AS (SELECT *, pos_a - pos_b AS g, CASE WHEN (pos_a - pos_b) - lag(pos_a - pos_b) OVER w > 3 OR pos_a - lag(pos_a) OVER w > 8 OR lag(pos_a) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM s WINDOW w AS (PARTITION BY doc_a, doc_b ORDER BY pos_a - pos_b, pos_a)),
i AS (SELECT *, sum(n) OVER (PARTITION BY doc_a, doc_b ORDER BY g, pos_a) AS island FROM l),
o AS (SELECT doc_a, doc_b, arg_min(pos_a, g * 1000000 + pos_a) AS pos_a, arg_min(pos_b, g * 1000000 + pos_a) AS pos_b, arg_max(pos_a, g * 1000000 + pos_a) + 5 AS end_a, arg_max(pos_b, g * 1000000 + pos_a) + 5 AS end_b FROM i GROUP BY doc_a, doc_b, island)
SELECT * FROM o WHERE end_a > pos_a AND end_b > pos_b"""


# ---- vectors


def vecs(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vec"), "label")


#: What a search looks for: the rows whose id is divisible by 50, against all rows.
ASKED = "word % 50 = 0"


def q_cosine_topk(s, d):
    v = vecs(s, d)
    return rounded(vectors.most_similar(v.where(ASKED), v, 5).select("query", "word", "similarity"), 5)


COSINE_SQL = """SELECT query, word, round(s, 5) AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS word, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s) WHERE a.vec_id % 50 = 0) WHERE r <= 5"""


def q_vector_distances(s, d):
    v = vecs(s, d)
    return rounded(vectors.distances(v.where(ASKED), v), 5)


DISTANCES_SQL = """SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(x, y), 5) AS cosine, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) / 64, 5) AS burrows_delta,
 round(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 5) AS manhattan, round(list_distance(x, y), 5) AS euclidean, round(sqrt(pow(list_distance(x, y), 2) / 64), 5) AS eder_delta
FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 50 = 0) a, (SELECT vec_id, embedding::DOUBLE[] AS y FROM embeddings) b"""


def q_bias(s, d):
    v = vecs(s, d)
    pos, neg = (v.where(f"label = {k}").agg(F.min_by("vec", "word").alias(n)) for k, n in ((3, "pos"), (4, "neg")))
    return rounded(vectors.bias(v, vectors.bias_direction(pos.crossJoin(neg))), 5)


BIAS_SQL = """WITH p AS (SELECT arg_min(embedding, vec_id) FILTER (label = 3)::DOUBLE[] AS p, arg_min(embedding, vec_id) FILTER (label = 4)::DOUBLE[] AS n FROM embeddings),
g AS (SELECT list_transform(list_zip(p, n), lambda z: z[1] - z[2]) AS g FROM p), u AS (SELECT list_transform(g, lambda x: x / sqrt(list_inner_product(g, g))) AS u FROM g)
SELECT vec_id AS word, round(list_inner_product(embedding::DOUBLE[], u), 5) AS bias FROM embeddings, u"""


def q_procrustes(s, d):
    v = vecs(s, d).select("word", "vec")
    turned = v.select("word", F.concat(F.slice("vec", 2, 63), F.slice("vec", 1, 1)).alias("vec"))
    out, _ = vectors.align_vectors(v, turned)
    return out.join(turned.withColumnRenamed("vec", "t"), "word").select("word", F.round(cosine_similarity(F.col("vec"), F.col("t")), 5).alias("similarity"))


PROCRUSTES_SQL = "SELECT vec_id AS word, CAST(1.0 AS DOUBLE) AS similarity FROM embeddings"


def q_drift(s, d):
    v = vecs(s, d).select((F.col("word") % 50).alias("w"), F.col("word").alias("period_ord"), "vec").withColumnRenamed("w", "word")
    return rounded(vectors.temporal_drift(v), 5)


DRIFT_SQL = """SELECT word, period_ord, round(1 - list_cosine_similarity(e::DOUBLE[], b::DOUBLE[]), 5) AS drift FROM (SELECT vec_id % 50 AS word, vec_id AS period_ord, embedding AS e, lag(embedding) OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL"""


def q_semantic_change(s, d):
    v = vecs(s, d).select((F.col("word") % 3).cast("int").alias("period_ord"), F.expr("cast(word div 3 as string)").alias("word"), "vec")
    counts = v.select("period_ord", "word", F.lit(1).alias("n"))
    return rounded(vectors.semantic_change(v, counts, "7"), 5)


CHANGE_SQL = """WITH v AS (SELECT CAST(vec_id % 3 AS INTEGER) AS p, CAST(vec_id // 3 AS VARCHAR) AS w, embedding::DOUBLE[] AS e FROM embeddings), x AS (SELECT v.p, v.w, list_cosine_similarity(v.e, t.e) AS s FROM v JOIN v t ON t.p = v.p AND t.w = '7' WHERE v.w <> '7')
SELECT a.p AS period_ord, CAST(a.p + 1 AS INTEGER) AS next_ord, a.w AS word, round(b.s - a.s, 5) AS change FROM x a JOIN x b ON b.w = a.w AND b.p = a.p + 1"""


# ---- normalization


def q_normalize_ws(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", normalize.normalize(F.col("text"), {"whitespace": "collapse"}).alias("text"))


NORMALIZE_WS_SQL = r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n+', chr(10), 'g'), '(^|\n)[ \r\f]+', '\1', 'g'), '[ \r\f]+($|\n)', '\1', 'g').regexp_replace('^\s+|\s+$', '', 'g') AS text FROM conversations"""


def q_normalize_width(s, d):
    t = normalize.normalize(F.col("text"), {"punctuation": "full", "numbers": "full", "letters": "full"})
    return table(s, d, "conversations").select("conv_id", "turn", t.alias("text"))


def _width_sql() -> str:
    half = "".join(chr(c) for c in range(33, 127))
    full = "".join(chr(c + normalize.WIDE) for c in range(33, 127))
    return f"SELECT conv_id, turn, translate(text, '{half.replace(chr(39), chr(39) * 2)}', '{full}') AS text FROM conversations"


def q_normalize_all(s, d):
    t = normalize.normalize(F.col("text"), {"unicode": "NFKC", "whitespace": "remove", "quotes": "corner"})
    return table(s, d, "conversations").select("conv_id", "turn", t.alias("text"))


# ---- topics and training


def topic_words(s):
    return s.createDataFrame([(k // 4, k % 4, w) for k, w in enumerate(WORDS)], "topic int, rank int, word string")


TOPIC_SQL = f"""{ONE}, w AS (SELECT CAST(k // 4 AS INTEGER) AS topic, k % 4 AS i, [{words_sql(WORDS)}][k + 1] AS word FROM (SELECT unnest(range({len(WORDS)})) AS k)),
u AS (SELECT DISTINCT doc_id, token FROM t), n AS (SELECT token, count(*) AS n FROM u GROUP BY token),
p AS (SELECT a.topic, a.word AS wi, b.word AS wj, (SELECT count(*) FROM u x JOIN u y ON x.doc_id = y.doc_id WHERE x.token = a.word AND y.token = b.word) AS n FROM w a JOIN w b ON a.topic = b.topic AND b.i < a.i),
f AS (SELECT p.*, ni.n AS di, nj.n AS dj, (SELECT count(*)::DOUBLE FROM d WHERE len(tokens) > 0) AS total FROM p LEFT JOIN n ni ON ni.token = wi LEFT JOIN n nj ON nj.token = wj)"""
UMASS_SQL = TOPIC_SQL + " SELECT topic, round(avg(ln((n + 1e-12) / dj)), 6) AS coherence FROM f WHERE dj > 0 GROUP BY topic"
NPMI_SQL = TOPIC_SQL + " SELECT topic, round(avg(CASE WHEN n = total THEN 1 ELSE ln(n * total / (di::DOUBLE * dj)) / -ln(n / total) END), 6) AS coherence FROM f WHERE n > 0 GROUP BY topic"


def q_lda(s, d):
    m = topics.LDA(10, iterations=100, estimate_alpha=1).fit(docs(s, d))
    return m.document_topics()


def q_word2vec(s, d):
    return embeddings.Word2Vec(size=100, min_count=5, cbow=True).train(docs(s, d)).vectors(s)


def q_glove(s, d):
    return embeddings.GloVe(size=100, min_count=5).train(docs(s, d)).vectors(s)


QUERIES = {
    "word_counts": (lambda s, d: corpus.word_counts(docs(s, d)), f"{ONE} SELECT token, count(*) AS n FROM t GROUP BY token"),
    "doc_freq": (q_doc_freq, SQL_DOC_FREQ),
    "vocabulary": (q_vocabulary, SQL_VOCABULARY),
    "vocab_topk": (q_most_frequent, SQL_MOST_FREQUENT),
    "vocab_limited": (q_limited_vocabulary, SQL_LIMITED_VOCABULARY),
    "ngrams": (q_ngrams, SQL_NGRAMS),
    "chunks_overlap": (q_chunks, SQL_CHUNKS),
    "char_chunks": (q_char_chunks, SQL_CHAR_CHUNKS),
    "line_tokens": (q_lines, SQL_LINES),
    "sentences": (q_sentences, SQL_SENTENCES),
    "balanced_periods": (q_balanced, SQL_BALANCED),
    "keyness_g2": (keyness_query("log_likelihood"), f"{KEY} {KEY_OUT}, round({G2_SQL}, 6) AS statistic FROM e"),
    "keyness_chi2": (keyness_query("chi2"), f"{KEY} {KEY_OUT}, round({chi_sql(False)}, 6) AS statistic FROM e"),
    "keyness_chi2_yates": (keyness_query("chi2_corrected"), f"{KEY} {KEY_OUT}, round({chi_sql(True)}, 6) AS statistic FROM e"),
    "keyness_fisher": (keyness_query("fisher", with_p=True), f"{KEY_FISHER} {KEY_OUT}, round(p, 4) + 0.0 AS p_value FROM w"),
    "keyness_bh": (keyness_query("fisher", "fdr_bh", with_p=True), f"{KEY_FISHER} {KEY_OUT}, round(p, 4) + 0.0 AS p_value, round({adjusted_sql('fdr_bh')}, 4) + 0.0 AS adjusted_p_value FROM w"),
    "keyness_bonferroni": (keyness_query("fisher", "bonferroni", with_p=True), f"{KEY_FISHER} {KEY_OUT}, round(p, 4) + 0.0 AS p_value, round({adjusted_sql('bonferroni')}, 4) + 0.0 AS adjusted_p_value FROM w"),
    "collocates_window": (cells("window"), WINDOW_SQL.replace("{left}", "3").replace("{right}", "3") + CELLS_OUT),
    "collocates_asym": (cells("window", (1, 4)), WINDOW_SQL.replace("{left}", "1").replace("{right}", "4") + CELLS_OUT),
    "collocates_sentence": (cells("sentence"), SENTENCE_SQL + CELLS_OUT),
    "find_collocates": (q_find_collocates, FIND_SQL),
    "compare_collocates": (q_compare_collocates, _compare_sql()),
    "kwic_right": (kwic_query("right"), KWIC_SQL),
    "kwic_left": (kwic_query("left"), KWIC_SQL),
    "kwic_position": (kwic_query("position"), KWIC_SQL),
    "cooc_window": (q_cooc, COOC_SQL + " SELECT * FROM m"),
    "cooc_document": (lambda s, d: q_cooc(s, d, "document"), None),  # 80 million rows from 1,000 documents: tested on a fixture
    "cooc_full_window": (lambda s, d: cooc.cooc_matrix(docs(s, d), horizon=(0, 1)), f"{ONE} SELECT a.token AS row_word, b.token AS col_word, count(*) AS value FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY ALL"),
    "cooc_sums": (q_cooc_sums, COOC_SUMS_SQL),
    "ppmi": (q_ppmi, PPMI_SQL),
    "glove_cooc": (q_glove_cooc, GLOVE_SQL),
    "ttr_variants": (q_ttr, TTR_SQL),
    "yule_k": (q_vocabulary_stats, STATS_SQL),
    "mattr_50": (q_mattr, MATTR_SQL),
    "rolling_avg": (q_rolling_average, ROLLING_SQL),
    "relative_frequencies": (q_relative_frequencies, RELATIVE_SQL),
    "stylo_zscore": (q_style_features, STYLE + " SELECT doc_id, author, feature, round(value, 6) + 0.0 AS value FROM z"),
    "stylo_tfidf": (q_style_tfidf, STYLE + " SELECT doc_id, author, feature, round(rel * idf, 6) + 0.0 AS value FROM rel JOIN st USING (feature)"),
    **{f"stylo_distance_{m}": (style_distance(m), STYLE + f" SELECT x.author AS a, y.author AS b, round({DIST_SQL[m]}, 6) AS distance FROM cen x JOIN cen y ON x.feature = y.feature AND x.author <> y.author GROUP BY x.author, y.author") for m in METRICS},
    "stylo_predict": (q_style_predict, STYLE_PREDICT_SQL),
    "stylo_profile": (q_style_profile, STYLE + " SELECT author, feature, round(value, 6) + 0.0 AS value FROM cen"),
    "stylo_comparison": (q_style_comparison, STYLE + " SELECT feature, author, round(value, 5) + 0.0 AS value, round(var_samp(value) OVER (PARTITION BY feature), 5) AS variance FROM cen"),
    "stylo_rolling": (q_style_rolling, STYLE_ROLLING_SQL),
    "stylo_bootstrap": (q_style_bootstrap, None),
    "stylo_svm": (q_style_svm, None),
    "stylo_cluster": (q_style_clusters, None),
    "reuse_seeds": (lambda s, d: reuse.seeds(*reuse_sides(s, d), 5), REUSE_SQL + " SELECT * FROM s"),
    "reuse_islands": (lambda s, d: reuse.islands(reuse.seeds(*reuse_sides(s, d), 5)), ISLAND_SQL),
    "reuse_passages": (lambda s, d: reuse.find_shared_sequences(*reuse_sides(s, d)), None),
    "cosine_topk": (q_cosine_topk, COSINE_SQL),
    "vector_distance_matrix": (q_vector_distances, DISTANCES_SQL),
    "bias_projection": (q_bias, BIAS_SQL),
    "procrustes_align": (q_procrustes, PROCRUSTES_SQL),
    "temporal_drift": (q_drift, DRIFT_SQL),
    "semantic_change": (q_semantic_change, CHANGE_SQL),
    "normalize_ws": (q_normalize_ws, NORMALIZE_WS_SQL),
    "normalize_width": (q_normalize_width, _width_sql()),
    "normalize_quotes": (q_normalize_all, None),
    "coherence_umass": (lambda s, d: rounded(topics.coherence_umass(docs(s, d), topic_words(s))), UMASS_SQL),
    "coherence_npmi": (lambda s, d: rounded(topics.coherence_npmi(docs(s, d), topic_words(s))), NPMI_SQL),
    "lda_fit": (q_lda, None),
    "w2v_train": (q_word2vec, None),
    "glove_train": (q_glove, None),
}
