"""Queries over the generated tables, one or more per operator, and the same in SQL.

The vocabulary is derived from `documents`: the terms and adjacent pairs of the
largest document frequency. Spatial data is integer arithmetic on `events`.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.functions import render
from textmap.functions import tokens as T
from textmap.operators import ranking, ridge, smoothing, space, text, vectors

N_WORDS, N_PAIRS = 300, 60
GRID = space.Grid.regular((20, 24, 20), 4.0, (-40.0, -48.0, -40.0))
FWHM = 9.0
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, dealt to all cores where the files have fewer parts than those (a single small file, say)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() <= cores else docs


# The derived vocabulary: bounded by its two sizes


def _vocabulary(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    return [(r["term"], r["frequency"]) for r in text.derived_vocabulary(_docs(spark, sf_dir), N_WORDS, N_PAIRS).collect()]


def _pipeline(spark: SparkSession, sf_dir: str, **settings) -> text.Pipeline:
    voc = _vocabulary(spark, sf_dir)
    return text.pipeline_from_vocabulary([t for t, _ in voc], [f for _, f in voc], **settings)


_STOPS = ", ".join(f"'{w}'" for w in sorted(T.STOP_WORDS))
_WITH = rf"""
WITH RECURSIVE tok AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{T.WORD_PATTERN}') AS t FROM documents),
kept AS (SELECT doc_id, text, list_filter(list_transform(t, lambda x: lower(x)), lambda x: x NOT IN ({_STOPS})) AS k FROM tok),
word_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(k) AS term FROM kept) GROUP BY 1),
pair_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS term FROM kept WHERE len(k) > 1) GROUP BY 1),
voc AS (
  SELECT term, df::DOUBLE / (SELECT count(*) FROM documents) AS frequency FROM (
    (SELECT * FROM word_df ORDER BY df DESC, term LIMIT {N_WORDS}) UNION ALL (SELECT * FROM pair_df ORDER BY df DESC, term LIMIT {N_PAIRS}))
),
"""
# Greedy matches: every candidate start with its longest phrase, then the chain of starts from each text's first token.
_MATCH = """
starts AS (SELECT doc_id, unnest(range(1, len(k) + 1)) AS i, k FROM kept),
cand AS (SELECT doc_id, i, CASE WHEN i < len(k) AND (k[i] || ' ' || k[i + 1]) IN (SELECT term FROM voc) THEN 2 WHEN k[i] IN (SELECT term FROM voc) THEN 1 ELSE 0 END AS n,
  k[i] AS w1, k[i + 1] AS w2 FROM starts),
step AS MATERIALIZED (SELECT doc_id, i, n, CASE WHEN n = 2 THEN w1 || ' ' || w2 ELSE w1 END AS phrase, i + greatest(n, 1) AS next FROM cand),
chain AS (SELECT doc_id, i, n, phrase, next FROM step WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.n, s.phrase, s.next FROM chain c JOIN step s ON s.doc_id = c.doc_id AND s.i = c.next),
found AS (SELECT doc_id, i, n, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM chain),
"""
_COUNTS = _MATCH + "counts AS (SELECT doc_id, phrase AS term, count(*)::DOUBLE AS value FROM found WHERE n > 0 GROUP BY 1, 2),\n"
_OPERATOR = """
op AS (SELECT term, unigram, count(*)::DOUBLE AS weight FROM (
  SELECT term, term AS unigram FROM voc UNION ALL SELECT term, u AS unigram FROM (SELECT term, unnest(string_split(term, ' ')) AS u FROM voc WHERE contains(term, ' ')) WHERE u IN (SELECT term FROM voc)) GROUP BY 1, 2),
"""
_UNIGRAMS = _COUNTS + _OPERATOR + "wide AS (SELECT doc_id, unigram AS term, sum(value * weight) AS value FROM counts JOIN op USING (term) GROUP BY 1, 2),\n"
_TFIDF = _UNIGRAMS + """
weighted AS (SELECT doc_id, term, value * (1 - ln(frequency)) AS value FROM wide JOIN voc USING (term)),
tfidf AS MATERIALIZED (SELECT doc_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM weighted),
"""


# Tokens


@query(rf"""
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.WORD_PATTERN}') AS t FROM documents)""")
def token_counts(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.WORD_PATTERN}') AS t, regexp_split_to_array(coalesce(text, ''), '{T.WORD_PATTERN}') AS g FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token, unnest(g[1:len(t)]) AS gap FROM s)
SELECT doc_id, (i - 1)::BIGINT AS pos, token, (sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY i) - length(token))::BIGINT AS "start",
  (sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS "end" FROM r""")
def token_positions(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.token_spans(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long"), F.col("s.token").alias("token"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(_WITH + "x AS (SELECT unnest(k) AS term FROM kept) SELECT x.term, count(*)::BIGINT AS n, any_value(df)::BIGINT AS df FROM x JOIN word_df USING (term) GROUP BY 1")
def stopword_filtered_counts(spark, sf_dir):
    rows = text.Pipeline(out_of_voc="keep").extract(_docs(spark, sf_dir))
    per = rows.groupBy(F.col("phrase").alias("term"), "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(_WITH + "x AS (SELECT 1) SELECT doc_id, array_to_string(k, ' ') AS standard FROM kept")
def standardized_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.standardize_text(F.col("text")).alias("standard"))


@query(_WITH + "x AS (SELECT 1) SELECT doc_id, array_to_string(list_transform(string_split(array_to_string(k, ' '), ' '), lambda w: w), '|') AS head FROM kept")
def phrase_codecs(spark, sf_dir):
    tokens = text.Pipeline().standard_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.split_phrase(T.join_phrase(tokens)), "|").alias("head"))


# Phrases


@query(_WITH + "x AS (SELECT 1) SELECT term, frequency FROM voc")
def derived_vocabulary(spark, sf_dir):
    return spark.createDataFrame(_vocabulary(spark, sf_dir), "term string, frequency double")


@query(_WITH + _MATCH + "x AS (SELECT 1) SELECT doc_id, pos::BIGINT AS pos, phrase FROM found WHERE n > 0")
def phrase_longest_match(spark, sf_dir):
    return _pipeline(spark, sf_dir).extract(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), "phrase")


def _oov(policy: str, form: str):
    sql = _WITH + _MATCH + f"x AS (SELECT 1) SELECT doc_id, pos::BIGINT AS pos, CASE WHEN n > 0 THEN phrase ELSE {form} END AS phrase FROM found"

    def run(spark, sf_dir):
        return _pipeline(spark, sf_dir, out_of_voc=policy).extract(_docs(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), "phrase")

    return run, sql


for _name, _policy, _form in (("oov_keep", "keep", "phrase"), ("oov_bracket", "[]", "'[' || phrase || ']'"), ("oov_brace", "{}", "'{' || phrase || '}'"), ("oov_literal", "unknown", "'unknown'")):
    QUERIES[_name], ORACLES[_name] = _oov(_policy, _form)

_SPANS = _MATCH + rf"""
gaps AS (SELECT doc_id, t, regexp_split_to_array(text, '{T.WORD_PATTERN}') AS g FROM tok),
tokens AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token, unnest(g[1:len(t)]) AS gap FROM gaps),
ends AS (SELECT doc_id, i, token, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tokens),
spans AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, e - length(token) AS s, e, lead(e) OVER (PARTITION BY doc_id ORDER BY i) AS e2 FROM ends WHERE lower(token) NOT IN ({_STOPS})),
phrases AS MATERIALIZED (SELECT f.doc_id, f.pos, f.phrase, a.s::BIGINT AS "start", (CASE WHEN f.n = 2 THEN a.e2 ELSE a.e END)::BIGINT AS "end" FROM found f JOIN spans a ON a.doc_id = f.doc_id AND a.i = f.i WHERE f.n > 0),
"""


@query(_WITH + _SPANS + 'x AS (SELECT 1) SELECT doc_id, pos::BIGINT AS pos, phrase, "start", "end" FROM phrases')
def phrase_spans(spark, sf_dir):
    rows = _pipeline(spark, sf_dir).extract_spans(_docs(spark, sf_dir))
    return rows.select("doc_id", F.col("pos").cast("long"), "phrase", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _highlight_sql(head: str, outside: str, inside: str, tail: str) -> str:
    return _WITH + _SPANS + f"""
o AS (SELECT p.*, d.text, coalesce(lag("end") OVER (PARTITION BY p.doc_id ORDER BY pos), 0) AS before FROM phrases p JOIN tok d ON d.doc_id = p.doc_id),
w AS (SELECT doc_id, string_agg({outside.format("text[before + 1:start]")} || {inside}, '' ORDER BY pos) AS woven, max("end") AS last FROM o GROUP BY 1)
SELECT d.doc_id, {head} || coalesce(woven, '') || {outside.format("text[coalesce(last, 0) + 1:]")} || {tail} AS highlighted FROM tok d LEFT JOIN w ON w.doc_id = d.doc_id"""


def _highlighted(form):
    def run(spark, sf_dir):
        spans = _pipeline(spark, sf_dir).spans_in(F.col("text"))
        return _docs(spark, sf_dir).select("doc_id", form(F.col("text"), spans).alias("highlighted"))

    return run


_HIGHLIGHTS = {
    "highlight_xml": (render.highlight_xml, _highlight_sql("'<highlighted_text>'", _ESC, """'<extracted_phrase standardized_form="' || phrase || '">' || """ + _ESC.format('text[start + 1:"end"]') + " || '</extracted_phrase>'", "'</highlighted_text>'")),
    "highlight_terminal": (render.highlight_terminal, _highlight_sql("''", "{0}", """chr(27) || '[94m[' || text[start + 1:"end"] || ']' || chr(27) || '[0m'""", "''")),
    "highlight_terminal_replaced": (functools.partial(render.highlight_terminal, replace=True), _highlight_sql("''", "{0}", "chr(27) || '[92m[' || phrase || ']' || chr(27) || '[0m'", "''")),
    "highlight_html": (render.highlight_html, _highlight_sql("'<span>'", _ESC, f"'{render.HTML_SPAN[0]}' || " + _ESC.format('text[start + 1:"end"]') + f" || '{render.HTML_SPAN[1]}'", "'</span>'")),
}
for _name, (_form_of, _sql) in _HIGHLIGHTS.items():
    QUERIES[_name], ORACLES[_name] = _highlighted(_form_of), _sql


# Vocabulary

_SYNONYMS = "syn AS (SELECT a.term AS a, b.term AS b FROM (SELECT term, row_number() OVER (ORDER BY term) AS r FROM voc WHERE NOT contains(term, ' ')) a JOIN (SELECT term, row_number() OVER (ORDER BY term) AS r FROM voc WHERE NOT contains(term, ' ')) b ON a.r % 10 = 3 AND b.r = a.r + 1),\n"


def _synonyms(voc: list[tuple[str, float]]) -> dict[str, str]:
    """Every tenth word of the vocabulary, from the third on, means the next."""
    words = sorted({t for t, _ in voc if " " not in t})
    return {words[i]: words[i + 1] for i in range(2, len(words) - 1, 10)}


def _with_synonyms(spark, sf_dir):
    voc = _vocabulary(spark, sf_dir)
    return text.pipeline_from_vocabulary([t for t, _ in voc], [f for _, f in voc], voc_mapping=_synonyms(voc))


@query(_WITH + _MATCH + _SYNONYMS + "x AS (SELECT 1) SELECT coalesce(b, phrase) AS term, count(*)::BIGINT AS n FROM found LEFT JOIN syn ON phrase = a WHERE n > 0 GROUP BY 1")
def synonym_mapped_counts(spark, sf_dir):
    rows = _with_synonyms(spark, sf_dir).extract(_docs(spark, sf_dir))
    return rows.groupBy(F.col("phrase").alias("term")).agg(F.count("*").alias("n"))


@query(_WITH + _SYNONYMS + "x AS (SELECT 1) SELECT term FROM voc WHERE term NOT IN (SELECT a FROM syn)")
def vocabulary_minus_mapped(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in _with_synonyms(spark, sf_dir).vocabulary()], "term string")


@query(_WITH + _SYNONYMS + "x AS (SELECT 1) SELECT coalesce(b, term) AS term, sum(frequency) AS frequency FROM voc LEFT JOIN syn ON term = a GROUP BY 1")
def merged_frequencies(spark, sf_dir):
    voc = _vocabulary(spark, sf_dir)
    terms = spark.createDataFrame([(t, f, _synonyms(voc).get(t, t)) for t, f in voc], "term string, frequency double, standard_term string")
    return text.merged_frequencies(terms)


@query(rf"""
WITH t AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '{T.WORD_PATTERN}')) AS term FROM documents), f AS (SELECT term, count(*)::DOUBLE AS frequency FROM t GROUP BY 1)
SELECT lower(term) AS standard_phrase, term AS original_phrase FROM f QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY frequency DESC, term) = 1""")
def standardizing_inverse(spark, sf_dir):
    tokens = _docs(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("term"))
    return text.standardizing_inverse(tokens.groupBy("term").agg(F.count("*").cast("double").alias("frequency")), F.lower("term"))


# Vectors


def _vectors(spark, sf_dir, **settings) -> tuple[DataFrame, DataFrame]:
    v = vectors.Vectorizer(_pipeline(spark, sf_dir), **settings)
    return v.transform(_docs(spark, sf_dir)), v.pipeline.vocabulary_table(spark)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_WITH + _COUNTS + "x AS (SELECT 1) SELECT doc_id, term, value FROM counts")
def term_counts(spark, sf_dir):
    return _vectors(spark, sf_dir, use_idf=False, norm=None, add_unigrams=False)[0]


@query(_WITH + _OPERATOR + "x AS (SELECT 1) SELECT term, unigram, weight FROM op")
def unigram_operator(spark, sf_dir):
    return vectors.unigram_operator(_pipeline(spark, sf_dir).vocabulary_table(spark))


@query(_WITH + _UNIGRAMS + "x AS (SELECT 1) SELECT doc_id, term, value FROM wide")
def unigram_augmented_counts(spark, sf_dir):
    return _vectors(spark, sf_dir, use_idf=False, norm=None)[0]


@query(_WITH + _UNIGRAMS + "x AS (SELECT 1) SELECT doc_id, term, round(value * (1 - ln(frequency)), 6) AS value FROM wide JOIN voc USING (term)")
def idf_weighted(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir, norm=None)[0], "value")


@query(_WITH + _TFIDF + "x AS (SELECT 1) SELECT doc_id, term, round(value, 6) AS value FROM tfidf")
def tfidf_l2(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir)[0], "value")


@query(_WITH + _TFIDF + "x AS (SELECT 1) SELECT doc_id, term, round(value / sum(abs(value)) OVER (PARTITION BY doc_id), 6) AS value FROM weighted")
def tfidf_l1(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir, norm="l1")[0], "value")


@query(_WITH + _TFIDF + "x AS (SELECT term, count(*) AS n FROM tfidf WHERE value > 0 GROUP BY 1) SELECT voc.term, coalesce(n, 0)::BIGINT AS n_documents FROM voc LEFT JOIN x USING (term)")
def document_frequency(spark, sf_dir):
    return vectors.document_frequencies(*_vectors(spark, sf_dir))


# Ranking: the queries are the documents whose id is divisible by 20


def _query_vectors(spark, sf_dir, voc) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 20 = 0").select(F.col("doc_id"), "text")
    return voc.transform(turns).withColumnRenamed("doc_id", "query_id")


@query(_WITH + _TFIDF + f"""
x AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.value * d.value) AS s FROM tfidf q JOIN tfidf d USING (term) WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, doc_id, round(s, 6) AS similarity FROM x WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) <= {ranking.TOP_DOCUMENTS}""")
def similar_documents_topk(spark, sf_dir):
    v = vectors.Vectorizer(_pipeline(spark, sf_dir))
    docs = _docs(spark, sf_dir)
    queries = v.gathered(docs.filter("doc_id % 20 = 0")).withColumnRenamed("doc_id", "query_id")
    return ranking.similar_documents(queries, v.gathered(docs), digits=6).select("query_id", "doc_id", "similarity")


# A fixed factor: term number modulo 7 is its component, weights are simple fractions.
_V = "v AS (SELECT term, ((row_number() OVER (ORDER BY term) - 1) % 7)::INT AS component, 1.0 / (1 + (row_number() OVER (ORDER BY term) - 1) % 5) AS f FROM voc),\n"
_SMOOTH = _TFIDF + _V + f"""
gram AS (SELECT a.component AS c, sum(a.f * a.f) AS g FROM v a GROUP BY 1),
vn AS (SELECT term, component, f / sqrt(f * f * g) AS f FROM v JOIN gram ON component = c),
inner_ AS (SELECT doc_id, component, sum(value * f) AS s FROM tfidf JOIN vn USING (term) GROUP BY 1, 2),
smooth AS MATERIALIZED (SELECT doc_id, term, sum(value) AS value FROM (
  SELECT doc_id, term, s * f * {smoothing.WEIGHT} AS value FROM inner_ JOIN v USING (component) UNION ALL SELECT doc_id, term, value * {1 - smoothing.WEIGHT} FROM tfidf) GROUP BY 1, 2),
"""


def _factor(spark, voc: DataFrame) -> DataFrame:
    at = F.row_number().over(W.orderBy("term")) - 1  # the vocabulary is bounded
    rows = voc.select("term", at.alias("r"))
    return rows.select("term", (F.col("r") % 7).cast("int").alias("component"), (F.lit(1.0) / (1 + F.col("r") % 5)).alias("value"))


@query(_WITH + _SMOOTH + "x AS (SELECT 1) SELECT doc_id, term, round(value, 6) AS value FROM smooth WHERE value <> 0")
def smooth_vectors(spark, sf_dir):
    v = vectors.Vectorizer(_pipeline(spark, sf_dir))
    out = smoothing.smoothed(v.transform(_docs(spark, sf_dir)), _factor(spark, v.pipeline.vocabulary_table(spark)))
    return _rounded(out, "value")


@query(_WITH + _V + "gram AS (SELECT component AS c, sum(f * f) AS g FROM v GROUP BY 1) SELECT term, component, round(f / sqrt(f * f * g), 6) AS value FROM v JOIN gram ON component = c")
def normalized_factor(spark, sf_dir):
    return _rounded(smoothing.normalized_factor(_factor(spark, _pipeline(spark, sf_dir).vocabulary_table(spark))), "value")


@query(_WITH + _SMOOTH + """
x AS (SELECT doc_id, term, value FROM smooth WHERE doc_id % 20 = 0 AND value > 0), norms AS (SELECT term, sqrt(3) * (1 + length(term) % 3) AS norm FROM voc WHERE length(term) % 2 = 0),
b AS (SELECT doc_id, term, value * norm AS w FROM x JOIN norms USING (term)), r AS (SELECT doc_id, term, value FROM tfidf WHERE doc_id % 20 = 0 AND value > 0),
df AS (SELECT term, count(*) AS n FROM tfidf WHERE value > 0 GROUP BY 1)
SELECT coalesce(x.doc_id, r.doc_id) AS query_id, term, round(coalesce(x.value, 0), 6) AS similarity, round(coalesce(w, 0), 6) AS weight_in_brain_map, round(coalesce(r.value, 0), 6) AS weight_in_query, coalesce(n, 0)::BIGINT AS n_documents
FROM x FULL JOIN r USING (doc_id, term) LEFT JOIN b USING (doc_id, term) LEFT JOIN df USING (term)""")
def related_terms(spark, sf_dir):
    v = vectors.Vectorizer(_pipeline(spark, sf_dir))
    voc = v.pipeline.vocabulary_table(spark)
    raw = _query_vectors(spark, sf_dir, v)
    smooth = smoothing.smoothed(raw, _factor(spark, voc), key="query_id")
    coef = voc.filter("length(term) % 2 = 0").select("term", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("target"), (1.0 + F.length("term") % 3).alias("value"))
    df = vectors.document_frequencies(v.transform(_docs(spark, sf_dir)), voc)
    return _rounded(ranking.related_terms(raw, smooth, vectors.feature_norms(coef), df), "similarity", "weight_in_brain_map", "weight_in_query")


# Space: study = user, coordinates by integer arithmetic, some off the grid

_X, _Y, _Z = "((event_id * 37) % 97 - 48)::DOUBLE", "((event_id * 53) % 113 - 56)::DOUBLE", "((event_id * 71) % 89 - 44)::DOUBLE"
_A, _B, _C = GRID.shape
_VOXELS = f"""
WITH c AS (SELECT event_id, user_id AS study_id, {_X} AS x, {_Y} AS y, {_Z} AS z FROM events),
f AS (SELECT *, (x + 40) / 4 AS a, (y + 48) / 4 AS b, (z + 40) / 4 AS c FROM c),
vox AS (SELECT event_id, study_id, floor(a)::INT AS i, floor(b)::INT AS j, floor(c)::INT AS k FROM f WHERE a >= 0 AND a < {_A} AND b >= 0 AND b < {_B} AND c >= 0 AND c < {_C}),
peaks AS (SELECT study_id, i, j, k, count(*)::DOUBLE AS value FROM vox WHERE study_id IS NOT NULL GROUP BY 1, 2, 3, 4),
mask AS (SELECT i, j, k, ((i * {_B} + j) * {_C} + k)::BIGINT AS voxel_id FROM (SELECT unnest(range(0, {_A}))::INT AS i), (SELECT unnest(range(0, {_B}))::INT AS j), (SELECT unnest(range(0, {_C}))::INT AS k)
  WHERE (2 * i + 1 - {_A})::DOUBLE * (2 * i + 1 - {_A}) / {_A * _A} + (2 * j + 1 - {_B})::DOUBLE * (2 * j + 1 - {_B}) / {_B * _B} + (2 * k + 1 - {_C})::DOUBLE * (2 * k + 1 - {_C}) / {_C * _C} <= 1.0),
"""


def _kernel_sql() -> str:
    return ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in space.gaussian_weights(FWHM / (space.FWHM_PER_SIGMA * 4.0)))


def _pass_sql(axis: str, n: int, source: str) -> str:
    cols = ", ".join(f"CASE WHEN (({axis} + o) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({axis} + o) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n - 1} - (({axis} + o) % {2 * n} + {2 * n}) % {2 * n} END AS {axis}" if x == axis else x for x in "ijk")
    return f"SELECT study_id, {cols}, sum(value * w) AS value FROM {source}, kernel GROUP BY ALL"


def _pass(axis: str, n: int, source: str, name: str) -> str:
    inner = _pass_sql(axis, n, source).replace("sum(value * w) AS value", "value * w AS value").replace(" GROUP BY ALL", "")
    return f"{name} AS (SELECT study_id, i, j, k, sum(value) AS value FROM ({inner}) GROUP BY 1, 2, 3, 4),\n"


_MAPS = _VOXELS + f"kernel(o, w) AS (VALUES {_kernel_sql()}),\np0 AS (SELECT * FROM peaks),\n" + _pass("i", _A, "p0", "s1") + _pass("j", _B, "s1", "s2") + _pass("k", _C, "s2", "s3") + "found_maps AS MATERIALIZED (SELECT study_id, voxel_id, value FROM s3 JOIN mask USING (i, j, k)),\nmaps AS MATERIALIZED (SELECT * FROM found_maps UNION ALL SELECT DISTINCT study_id, (SELECT min(voxel_id) FROM mask), 0.0 FROM c WHERE study_id IS NOT NULL AND study_id NOT IN (SELECT study_id FROM found_maps)),\n"


def _coords(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    at = [((e * a) % b - c).cast("double") for a, b, c in ((37, 97, 48), (53, 113, 56), (71, 89, 44))]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("study_id"), *[v.alias(n) for v, n in zip(at, "xyz")])


@query(_VOXELS + "x AS (SELECT 1) SELECT event_id, study_id, i, j, k FROM vox")
def coords_to_voxels(spark, sf_dir):
    return space.coords_to_voxels(_coords(spark, sf_dir), GRID).select("event_id", "study_id", "i", "j", "k")


@query(_VOXELS + "x AS (SELECT 1) SELECT study_id, i, j, k, value FROM peaks")
def peak_histogram(spark, sf_dir):
    return space.peaks(_coords(spark, sf_dir).filter("study_id IS NOT NULL"), GRID)


@query(_VOXELS + "x AS (SELECT 1) SELECT study_id, voxel_id, value FROM peaks JOIN mask USING (i, j, k)")
def mask_project(spark, sf_dir):
    return space.masked(space.peaks(_coords(spark, sf_dir).filter("study_id IS NOT NULL"), GRID), space.ellipsoid_mask(spark, GRID))


@query(_VOXELS + "x AS (SELECT DISTINCT study_id FROM peaks) SELECT study_id, i, j, k, coalesce(value, 0) AS value FROM x CROSS JOIN mask LEFT JOIN peaks USING (study_id, i, j, k)")
def unmask_project(spark, sf_dir):
    mask = space.ellipsoid_mask(spark, GRID)
    peaks = space.peaks(_coords(spark, sf_dir).filter("study_id IS NOT NULL"), GRID)
    return space.unmasked(space.masked(peaks, mask), mask, peaks.select("study_id").distinct())


@query(_MAPS + "x AS (SELECT 1) SELECT study_id, voxel_id, round(value, 6) AS value FROM maps")
def smoothed_maps(spark, sf_dir):
    return _maps(spark, sf_dir, digits=6)


def _maps(spark, sf_dir, long: bool = True, digits: int | None = None) -> DataFrame:
    return space.coordinates_to_maps(_coords(spark, sf_dir), space.ellipsoid_mask(spark, GRID), GRID, FWHM, long, digits)


_TARGET = space.Grid.regular((14, 16, 14), 6.0, (-40.0, -48.0, -40.0))


@query(_VOXELS + f"""
t AS (SELECT i, j, k, ((i * 16 + j) * 14 + k)::BIGINT AS voxel_id, round(i * 1.5::DOUBLE)::INT AS oi, round(j * 1.5::DOUBLE)::INT AS oj, round(k * 1.5::DOUBLE)::INT AS ok
  FROM (SELECT unnest(range(0, 14))::INT AS i), (SELECT unnest(range(0, 16))::INT AS j), (SELECT unnest(range(0, 14))::INT AS k))
SELECT t.voxel_id, t.i, t.j, t.k FROM t WHERE EXISTS (SELECT 1 FROM mask m WHERE m.i = oi AND m.j = oj AND m.k = ok)""")
def resampled_mask(spark, sf_dir):
    return space.resampled_mask(space.ellipsoid_mask(spark, GRID), GRID, _TARGET)


# From maps to terms and studies: term maps are the maps of studies, named by number


def _studies(spark, sf_dir) -> DataFrame:
    """The studies that have a map: all that have points."""
    return _coords(spark, sf_dir).filter("study_id IS NOT NULL").select("study_id").distinct()


def _query_maps(spark, sf_dir) -> DataFrame:
    coords = _coords(spark, sf_dir).filter("study_id % 20 = 0")
    maps = space.coordinates_to_maps(coords, space.ellipsoid_mask(spark, GRID), GRID, FWHM, long=False)
    return maps.select(F.col("study_id").alias("query_id"), "voxel_id", F.transform("value", F.negative).alias("value"))


_Q = "q AS (SELECT study_id AS query_id, voxel_id, -value AS value FROM maps WHERE study_id % 20 = 0),\n"


@query(_MAPS + _Q + """
s AS (SELECT query_id, 'term' || study_id AS term, sum(abs(q.value) * m.value) * ln(1 + study_id) AS score FROM q JOIN maps m USING (voxel_id) GROUP BY query_id, study_id)
SELECT query_id, term, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) <= 20""")
def reverse_terms_topk(spark, sf_dir):
    maps = _maps(spark, sf_dir, long=False)
    terms = maps.select(F.concat(F.lit("term"), "study_id").alias("term"), "voxel_id", "value")
    df = _studies(spark, sf_dir).select(F.concat(F.lit("term"), "study_id").alias("term"), F.col("study_id").alias("n_documents"))
    q = _query_maps(spark, sf_dir)
    return _rounded(ranking.terms_of_map(q, terms, df), "score").select("query_id", "term", "score")


@query(_MAPS + _Q + """
n AS (SELECT study_id, voxel_id, value / sum(value) OVER (PARTITION BY study_id) AS value FROM maps),
s AS (SELECT query_id, study_id, sum(abs(q.value) * n.value) AS score FROM q JOIN n USING (voxel_id) GROUP BY 1, 2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, study_id) <= 10)
SELECT query_id, study_id, round(score, 6) AS score, 'study ' || study_id AS title FROM b WHERE study_id % 3 <> 0""")
def reverse_studies_topk(spark, sf_dir):
    known = _studies(spark, sf_dir).filter("study_id % 3 <> 0").withColumn("title", F.concat(F.lit("study "), "study_id"))
    q, maps = _query_maps(spark, sf_dir), _maps(spark, sf_dir, long=False)
    return _rounded(ranking.studies_of_map(q, maps, known), "score").select("query_id", "study_id", "score", "title")


@query(_MAPS + """
m AS (SELECT DISTINCT study_id FROM maps WHERE value <> 0), v AS (SELECT doc_id AS study_id, n_chars FROM documents), k AS (SELECT c_custkey AS study_id FROM customer)
SELECT study_id, n_chars FROM v WHERE study_id IN (SELECT study_id FROM m) AND study_id IN (SELECT study_id FROM k)""")
def corpus_alignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("study_id"), "n_chars")
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("study_id"))
    return ranking.aligned(_maps(spark, sf_dir, long=False), docs, known)[1]


# Regression: features are the 64 numbers of `embeddings`, targets four sums of them with the label


def _xy(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("study_id"), "embedding", "label")
    x = e.select("study_id", F.posexplode("embedding").alias("at", "value")).select("study_id", F.concat(F.lit("f"), F.lpad(F.col("at").cast("string"), 2, "0")).alias("term"), F.col("value").cast("double").alias("value"))
    y = e.select("study_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("target"), "embedding", "label")
    y = y.select("study_id", F.col("target").cast("long"), (F.get("embedding", F.col("target")).cast("double") * (F.col("target") + 1) + F.when(F.col("label") % 4 == F.col("target"), 1.0).otherwise(0.0)).alias("value"))
    return x, y, e.select("study_id")


_TERMS = [f"f{i:02d}" for i in range(64)]


def _moments(spark, sf_dir):
    return ridge.moments(*_xy(spark, sf_dir), _TERMS, [0, 1, 2, 3])


_XY = """
WITH x AS (SELECT vec_id AS study_id, 'f' || lpad((i - 1)::VARCHAR, 2, '0') AS term, embedding[i]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
y AS (SELECT vec_id AS study_id, t AS target, embedding[t + 1]::DOUBLE * (t + 1) + CASE WHEN label % 4 = t THEN 1.0 ELSE 0.0 END AS value FROM embeddings, (SELECT unnest(range(0, 4)) AS t)),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), mx AS (SELECT term, avg(value) AS m FROM x GROUP BY 1), my AS (SELECT target, avg(value) AS m FROM y GROUP BY 1),
"""


@query(_XY + "z AS (SELECT study_id, term, value - m AS value FROM x JOIN mx USING (term)) SELECT a.term AS term_i, b.term AS term_j, round(sum(a.value * b.value), 4) AS value FROM z a JOIN z b USING (study_id) GROUP BY 1, 2")
def gram_matrix(spark, sf_dir):
    m = _moments(spark, sf_dir)
    rows = [(a, b, round(float(m.gram[i, j]), 4)) for i, a in enumerate(_TERMS) for j, b in enumerate(_TERMS)]
    return spark.createDataFrame(rows, "term_i string, term_j string, value double")


@query(_XY + """
z AS (SELECT study_id, value - m AS x FROM x JOIN mx USING (term) WHERE term = 'f00'), w AS (SELECT study_id, target, value - m AS y FROM y JOIN my USING (target)),
s AS (SELECT sum(x * x) AS g FROM z), c AS (SELECT target, sum(x * y) AS c FROM z JOIN w USING (study_id) GROUP BY 1),
a(k, alpha) AS (VALUES """ + ", ".join(f"({i}, {float(a)!r}::DOUBLE)" for i, a in enumerate(ridge.ALPHAS)) + """),
e AS (SELECT k, alpha, study_id, sum(pow((y - x * c / (g + alpha)) / (1 - 1 / n - x * x / (g + alpha)), 2)) AS e FROM z JOIN w USING (study_id) JOIN c USING (target), s, n, a GROUP BY 1, 2, 3),
best AS (SELECT alpha FROM (SELECT k, alpha, avg(e) AS m FROM e GROUP BY 1, 2) ORDER BY round(m, 9), k LIMIT 1)
SELECT target, round(alpha, 6) AS alpha, round(c / (g + alpha), 6) AS coef, round(m - (SELECT m FROM mx WHERE term = 'f00') * c / (g + alpha), 6) AS intercept FROM c JOIN my USING (target), s, best""")
def ridge_one_feature(spark, sf_dir):
    fit = ridge.fit(_moments(spark, sf_dir), keep=[0])
    rows = [(t, round(fit.alpha, 6), round(float(fit.coef[0, i]), 6), round(float(fit.intercept[i]), 6)) for i, t in enumerate(fit.targets)]
    return spark.createDataFrame(rows, "target long, alpha double, coef double, intercept double")


@query()
def nmf_factor(spark, sf_dir):
    x, _, _ = _xy(spark, sf_dir)
    x = x.select(F.col("study_id").alias("doc_id"), "term", F.abs("value").alias("value"))
    # The rank must be below the 64 terms; the targets are four sums, so it is four. The tolerance ends the rounds.
    return smoothing.factor_table(spark, smoothing.factor(x, _TERMS, n_components=4), _TERMS)


# Serving a fixed model: coefficients 1 / (1 + term) for even targets, a banded filter gram

_MODEL = _XY + """
t AS (SELECT 'f' || lpad(i::VARCHAR, 2, '0') AS term, i FROM (SELECT unnest(range(0, 64)) AS i)),
coef AS (SELECT term, g AS target, 1.0::DOUBLE / (1 + i + g) AS c FROM t, (SELECT unnest(range(0, 4)) AS g)),
fg AS (SELECT a.term AS ti, b.term AS tj, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.25 END::DOUBLE AS g FROM t a JOIN t b ON abs(a.i - b.i) <= 1),
p AS (SELECT study_id, target, sum(value * c) AS value FROM x JOIN coef USING (term) GROUP BY 1, 2),
s AS (SELECT a.study_id, sum(a.value * g * b.value) AS scale FROM x a JOIN fg ON a.term = ti JOIN x b ON b.term = tj AND b.study_id = a.study_id GROUP BY 1),
"""


def _model(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    coef = spark.createDataFrame([(t, g, 1.0 / (1 + i + g)) for i, t in enumerate(_TERMS) for g in range(4)], "term string, target long, value double")
    gram = spark.createDataFrame([(_TERMS[i], _TERMS[j], 1.0 if i == j else 0.25) for i in range(64) for j in range(64) if abs(i - j) <= 1], "term_i string, term_j string, value double")
    return coef, gram, spark.createDataFrame([(g, 10.0 * g, 1.0 + g) for g in range(4)], "target long, intercept double, residual_var double")


@query(_MODEL + "z AS (SELECT 1) SELECT study_id, target, round(value + 10.0 * target, 5) AS value FROM p")
def linear_predict(spark, sf_dir):
    coef, _, targets = _model(spark)
    return _r5(ridge.predicted(_xy(spark, sf_dir)[0], coef, targets, "study_id"), "value")


def _r5(df, name):
    return df.withColumn(name, F.round(name, 5))


@query(_MODEL + "z AS (SELECT 1) SELECT study_id, target, round(scale * (1 + target), 5) AS variance FROM s, (SELECT unnest(range(0, 4)) AS target)")
def prediction_variance(spark, sf_dir):
    _, gram, targets = _model(spark)
    return _r5(ridge.prediction_variance(_xy(spark, sf_dir)[0], gram, targets, "study_id"), "variance")


@query(_MODEL + "z AS (SELECT 1) SELECT study_id, target, round(value / sqrt(scale * (1 + target)), 5) AS value FROM p JOIN s USING (study_id)")
def z_maps_of_rows(spark, sf_dir):
    coef, gram, targets = _model(spark)
    return _r5(ridge.z_maps_of(_xy(spark, sf_dir)[0], coef, gram, targets, "study_id"), "value")


@query(_MODEL + "z AS (SELECT 1) SELECT term, round(sqrt(sum(c * c)), 6) AS norm FROM coef GROUP BY 1")
def feature_norms(spark, sf_dir):
    return _rounded(vectors.feature_norms(_model(spark)[0]), "norm")


# Additions: events by windows, and the star schema


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    from textmap.streaming.encode import windowed_counts

    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("total", F.round("total", 4))


@query("""
SELECT n_name, r_name, count(*)::BIGINT AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def revenue_by_nation(spark, sf_dir):
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar documents of every twentieth document."""
    return similar_documents_topk(spark, sf_dir)
