"""Queries of fitted and composed models, and the same in SQL.

The ridge SQL is another way to the result than the library's: it inverts X^T X + alpha D
by Gauss-Jordan elimination for every alpha, where the library solves one eigenproblem.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.operators import encoder, ranking, ridge, smoothing, vectors
from textmap.plans import catalog as base
from textmap.plans.catalog import _docs, _pipeline, query
from textmap.sources import vocabulary

P, TARGETS = 64, 4
TERMS = [f"f{i:02d}" for i in range(P)]


def _moments(spark, sf_dir):
    return ridge.moments(*base._xy(spark, sf_dir), TERMS, list(range(TARGETS)))


# SQL of a fit: `d` (i, d, kept) are the features' penalties and which of them are used.

_DATA = f"""
WITH e AS MATERIALIZED (SELECT vec_id AS study_id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings),
n AS (SELECT count(*)::DOUBLE AS n FROM e),
y AS MATERIALIZED (SELECT study_id, t, x[t + 1] * (t + 1) + CASE WHEN label % 4 = t THEN 1.0 ELSE 0.0 END AS y FROM e, (SELECT unnest(range(0, {TARGETS})) AS t)),
my AS (SELECT t, avg(y) AS m FROM y GROUP BY 1),
mx AS MATERIALIZED (SELECT i, avg(x[i]) AS m FROM e, (SELECT unnest(range(1, {P + 1})) AS i) GROUP BY 1),
mean AS MATERIALIZED (SELECT list(m ORDER BY i) AS m FROM mx),
z AS MATERIALIZED (SELECT study_id, list_transform(list_zip(x, m), lambda p: p[1] - p[2]) AS z FROM e, mean),
zl AS MATERIALIZED (SELECT study_id, unnest(range(1, {P + 1})) AS i, unnest(z) AS v, z FROM z),
g AS MATERIALIZED (SELECT a.i, j, sum(a.v * a.z[j]) AS v FROM zl a, (SELECT unnest(range(1, {P + 1})) AS j) GROUP BY 1, 2),
c AS MATERIALIZED (SELECT i, y.t, sum(v * (y.y - m)) AS c FROM zl JOIN y USING (study_id) JOIN my ON my.t = y.t GROUP BY 1, 2),
alphas(k, alpha) AS (VALUES {", ".join(f"({k}, {float(a)!r}::DOUBLE)" for k, a in enumerate(ridge.ALPHAS))}),
"""


def _fit_sql(name: str, d: str) -> str:
    """CTEs <name>_coef (i, t, w), <name>_best (alpha), <name>_residual (t, r), <name>_filter (i, diagonal of the filter gram)."""
    f = name
    steps = [
        f"""{f}_d AS MATERIALIZED ({d}),
{f}_m0 AS MATERIALIZED (SELECT k, i, j, CASE WHEN j > {P} THEN CASE WHEN j - {P} = i THEN 1.0 ELSE 0.0 END
  WHEN di.kept AND dj.kept THEN g.v + CASE WHEN i = j THEN alpha * di.d ELSE 0.0 END WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS v
  FROM alphas CROSS JOIN (SELECT unnest(range(1, {P + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {2 * P + 1})) AS j) JOIN {f}_d di USING (i) LEFT JOIN {f}_d dj ON dj.i = j LEFT JOIN g USING (i, j))"""
    ]
    for k in range(1, P + 1):
        m = f"{f}_m{k - 1}"
        steps.append(
            f"""{f}_m{k} AS MATERIALIZED (SELECT a.k, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM {m} a
  JOIN (SELECT k, v FROM {m} WHERE i = {k} AND j = {k}) p ON p.k = a.k JOIN (SELECT k, j, v FROM {m} WHERE i = {k}) r ON r.k = a.k AND r.j = a.j
  JOIN (SELECT k, i, v FROM {m} WHERE j = {k}) c ON c.k = a.k AND c.i = a.i)"""
        )
    steps.append(
        f"""{f}_inv AS MATERIALIZED (SELECT k, i, list(CASE WHEN di.kept AND dj.kept THEN v ELSE 0.0 END ORDER BY j) AS r FROM {f}_m{P} JOIN {f}_d di USING (i) JOIN {f}_d dj ON dj.i = j - {P} WHERE j > {P} GROUP BY 1, 2),
{f}_cl AS MATERIALIZED (SELECT t, list(c ORDER BY i) AS c FROM c GROUP BY 1),
{f}_w AS MATERIALIZED (SELECT k, t, i, list_dot_product(r, c) AS w FROM {f}_inv, {f}_cl),
{f}_wl AS MATERIALIZED (SELECT k, t, list(w ORDER BY i) AS w FROM {f}_w GROUP BY 1, 2),
{f}_h AS MATERIALIZED (SELECT k, study_id, 1 / any_value(n) + sum(z[i] * list_dot_product(r, z)) AS h FROM z, {f}_inv, n GROUP BY 1, 2),
{f}_e AS (SELECT k, study_id, sum(pow((y.y - m - list_dot_product(w, z)) / (1 - h), 2)) AS e FROM z JOIN y USING (study_id) JOIN my ON my.t = y.t JOIN {f}_wl wl ON wl.t = y.t JOIN {f}_h h USING (k, study_id) GROUP BY 1, 2),
{f}_best AS MATERIALIZED (SELECT k, alpha FROM (SELECT k, avg(e) AS e FROM {f}_e GROUP BY 1) JOIN alphas USING (k) ORDER BY round(e, 9), k LIMIT 1),
{f}_coef AS MATERIALIZED (SELECT i, t, w FROM {f}_w JOIN {f}_best USING (k)),
{f}_residual AS MATERIALIZED (SELECT y.t, avg(pow(y.y - m - list_dot_product(w, z), 2)) AS r FROM z JOIN y USING (study_id) JOIN my ON my.t = y.t JOIN (SELECT * FROM {f}_wl JOIN {f}_best USING (k)) wl ON wl.t = y.t GROUP BY 1),
{f}_filter AS MATERIALIZED (SELECT a.i, sum(a.r[x.i] * g.v * a.r[x.j]) AS q FROM (SELECT * FROM {f}_inv JOIN {f}_best USING (k)) a, (SELECT i, j FROM g) x JOIN g ON g.i = x.i AND g.j = x.j GROUP BY 1),
"""
    )
    return ",\n".join(steps)


_PLAIN = _DATA + _fit_sql("f", f"SELECT unnest(range(1, {P + 1})) AS i, 1.0::DOUBLE AS d, true AS kept")
_PENALTY = _PLAIN + """
v AS (SELECT i, t, q * r AS v FROM f_filter CROSS JOIN f_residual), zz AS (SELECT i, t, greatest(w / sqrt(v + (SELECT avg(v) FROM v)), 0) AS z FROM f_coef JOIN v USING (i, t)),
energy AS MATERIALIZED (SELECT i, avg(z * z) AS e FROM zz GROUP BY 1),
raw AS (SELECT i, 1 / greatest(e - (SELECT avg(e) + 2 * stddev_pop(e) FROM energy), 0.001) AS d FROM energy), penalty AS MATERIALIZED (SELECT i, d / (SELECT min(d) FROM raw) AS d FROM raw),
"""
_SELECTIVE = _PENALTY + _fit_sql("s", "SELECT i, d, d < (SELECT max(d) FROM penalty) AS kept FROM penalty")
_TERM = "'f' || lpad((i - 1)::VARCHAR, 2, '0') AS term"


def _fit_rows(spark, fit: ridge.Ridge) -> DataFrame:
    rows = [(t, u, round(float(fit.coef[i, j]), 6), round(fit.alpha, 6), round(float(fit.intercept[j]), 6), round(float(fit.residual_var[j]), 6)) for i, t in enumerate(fit.terms) for j, u in enumerate(fit.targets)]
    return spark.createDataFrame(rows, "term string, target long, coef double, alpha double, intercept double, residual_var double")


def _fit_result(f: str, kept: str = "") -> str:
    return f"""{f}_icept AS (SELECT t, any_value(my.m) - sum(w * mx.m) AS b FROM {f}_coef JOIN mx USING (i) JOIN my USING (t) GROUP BY 1)
SELECT {_TERM}, t AS target, round(w, 6) AS coef, round(alpha, 6) AS alpha, round(b, 6) AS intercept, round(r, 6) AS residual_var FROM {f}_coef JOIN {f}_residual USING (t) JOIN {f}_icept USING (t) CROSS JOIN {f}_best {kept}"""


@query(_PLAIN + _fit_result("f"))
def ridge_fit(spark, sf_dir):
    return _fit_rows(spark, ridge.fit(_moments(spark, sf_dir)))


@query(_PENALTY + f"x AS (SELECT 1) SELECT {_TERM}, round(d, 6) AS penalty FROM penalty")
def adaptive_penalty(spark, sf_dir):
    d = ridge.adaptive_penalty(ridge.fit(_moments(spark, sf_dir)))
    return spark.createDataFrame([(t, round(float(p), 6)) for t, p in zip(TERMS, d)], "term string, penalty double")


@query(_PENALTY + _fit_sql("a", "SELECT i, d, true AS kept FROM penalty") + _fit_result("a"))
def adaptive_ridge(spark, sf_dir):
    return _fit_rows(spark, ridge.fit_adaptive(_moments(spark, sf_dir)))


@query(_SELECTIVE + _fit_result("s", "WHERE i IN (SELECT i FROM s_d WHERE kept)"))
def selective_ridge(spark, sf_dir):
    return _fit_rows(spark, ridge.fit_selective(_moments(spark, sf_dir)))


@query(_SELECTIVE + f"x AS (SELECT 1) SELECT {_TERM}, t AS target, round(coalesce(w / nullif(sqrt(q * r), 0), 0), 6) AS z FROM s_coef JOIN s_filter USING (i) JOIN s_residual USING (t)")
def ridge_z_maps(spark, sf_dir):
    z = ridge.fit_selective(_moments(spark, sf_dir)).z_maps()
    return spark.createDataFrame([(t, j, round(float(z[i, j]), 6)) for i, t in enumerate(TERMS) for j in range(TARGETS)], "term string, target long, z double")


@query(_PLAIN + f"v AS (SELECT i, t, q * r AS v FROM f_filter CROSS JOIN f_residual) SELECT {_TERM}, t AS target, round(v * 1e6, 4) AS variance, round(greatest(w / sqrt(v + (SELECT avg(v) FROM v)), 0), 5) AS z FROM v JOIN f_coef USING (i, t)")
def coefficient_variance(spark, sf_dir):
    """Variances (in millionths), and the z-scores whose squares are a feature's energy."""
    import numpy as np

    fit = ridge.fit(_moments(spark, sf_dir))
    v = fit.variance()
    z = np.maximum(fit.coef / np.sqrt(v + v.mean()), 0)
    return spark.createDataFrame([(t, j, round(float(v[i, j]) * 1e6, 4), round(float(z[i, j]), 5)) for i, t in enumerate(TERMS) for j in range(TARGETS)], "term string, target long, variance double, z double")


# The composed model with fixed tables: coefficients of the terms with an even number of characters, a banded filter gram.

_MODEL = base._WITH + base._SMOOTH + """
sel AS (SELECT term, row_number() OVER (ORDER BY term) AS r FROM voc WHERE length(term) % 2 = 0),
coef AS (SELECT term, t AS target, (1 + (length(term) + t) % 3) * CASE WHEN t = 1 THEN -1.0 ELSE 1.0 END AS w FROM sel, (SELECT unnest(range(0, 3)) AS t)),
band AS (SELECT a.term AS ti, b.term AS tj, CASE WHEN a.r = b.r THEN 1.0 ELSE 0.25 END::DOUBLE AS v FROM sel a JOIN sel b ON abs(a.r - b.r) <= 1),
qs AS MATERIALIZED (SELECT doc_id AS query_id, term, value FROM smooth WHERE doc_id % 20 = 0), qr AS MATERIALIZED (SELECT doc_id AS query_id, term, value FROM tfidf WHERE doc_id % 20 = 0),
pred AS MATERIALIZED (SELECT query_id, target, sum(value * w) AS value FROM qs JOIN coef USING (term) GROUP BY 1, 2),
scale AS MATERIALIZED (SELECT a.query_id, sum(a.value * v * b.value) AS s FROM qs a JOIN band ON a.term = ti JOIN qs b ON b.term = tj AND b.query_id = a.query_id GROUP BY 1),
unit AS MATERIALIZED (SELECT query_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY query_id)) AS value FROM qs),
"""


def _encoder(spark: SparkSession, sf_dir: str, to_z: bool = True) -> tuple[encoder.Encoder, DataFrame]:
    """The encoder, whose corpus are the documents, and the query texts: the documents whose id is divisible by 20."""
    v = vectors.Vectorizer(_pipeline(spark, sf_dir))
    voc = v.pipeline.vocabulary_table(spark)
    terms = [t for t in v.vocabulary() if len(t) % 2 == 0]
    coef = spark.createDataFrame([(t, j, (1.0 + (len(t) + j) % 3) * (-1.0 if j == 1 else 1.0)) for t in terms for j in range(3)], "term string, target long, value double")
    near = [(i, j) for i in range(len(terms)) for j in (i - 1, i, i + 1) if 0 <= j < len(terms)]
    gram = spark.createDataFrame([(terms[i], terms[j], 1.0 if i == j else 0.25) for i, j in near], "term_i string, term_j string, value double")
    targets = spark.createDataFrame([(j, 5.0 * j, 1.0 + j) for j in range(3)], "target long, intercept double, residual_var double")
    model = encoder.SmoothedModel(base._factor(spark, voc), smoothing.WEIGHT, encoder.LinearModel(coef, targets, gram if to_z else None), to_z)
    mask = spark.createDataFrame([(j, 0, 0, j) for j in range(4)], "voxel_id long, i int, j int, k int")
    queries = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return encoder.Encoder(v, model, mask, v.transform(_docs(spark, sf_dir)), None), queries


@query(_MODEL + "x AS (SELECT 1) SELECT query_id, target, round(value / greatest(sqrt(greatest(s, 0) * (1 + target)), 1e-24), 5) AS value FROM pred JOIN scale USING (query_id)")
def encode_z_maps(spark, sf_dir):
    e, queries = _encoder(spark, sf_dir)
    return e.transform(queries)["brain_map"].withColumn("value", F.round("value", 5))


@query(_MODEL + "m AS (SELECT query_id, v.k, v.k AS target FROM (SELECT DISTINCT query_id FROM pred), (SELECT unnest(range(0, 4)) AS k) v) SELECT query_id, 0 AS i, 0 AS j, k::INT AS k, round(coalesce(value, 0), 5) AS value FROM m LEFT JOIN pred USING (query_id, target)")
def encode_volumes(spark, sf_dir):
    """Without a filter gram the maps are predictions; on the mask's voxels."""
    e, queries = _encoder(spark, sf_dir, to_z=False)
    return e.volume(e.transform(queries)["brain_map"]).withColumn("value", F.round("value", 5))


@query(_MODEL + "x AS (SELECT 1) SELECT query_id, term, round(value, 5) AS value FROM unit WHERE value <> 0")
def encode_smoothed_tfidf(spark, sf_dir):
    e, queries = _encoder(spark, sf_dir)
    return e.transform(queries)["smoothed_tfidf"].withColumn("value", F.round("value", 5))


@query(_MODEL + """
norms AS (SELECT term, sqrt(sum(w * w)) AS norm FROM coef GROUP BY 1), df AS (SELECT term, count(*) AS n FROM tfidf WHERE value > 0 GROUP BY 1),
s AS (SELECT query_id, term, value FROM unit WHERE value > 0), r AS (SELECT query_id, term, value FROM qr WHERE value > 0)
SELECT coalesce(s.query_id, r.query_id) AS query_id, term, round(coalesce(s.value, 0), 5) AS similarity, round(coalesce(s.value * norm, 0), 5) AS weight_in_brain_map, round(coalesce(r.value, 0), 5) AS weight_in_query, coalesce(n, 0)::BIGINT AS n_documents
FROM s FULL JOIN r USING (query_id, term) LEFT JOIN norms USING (term) LEFT JOIN df USING (term)""")
def explain_similar_words(spark, sf_dir):
    e, queries = _encoder(spark, sf_dir)
    words = ranking.related_terms(*[e.transform(queries)[k] for k in ("raw_tfidf", "smoothed_tfidf")], vectors.feature_norms(e.model.regression.coef), e.document_frequencies())
    return words.withColumns({c: F.round(c, 5) for c in ("similarity", "weight_in_brain_map", "weight_in_query")})


_IN_MODEL = """'<extracted_phrase standardized_form="' || phrase || '" in_model="' || CASE WHEN length(phrase) % 2 = 0 THEN 'true' ELSE 'false' END || '">' || """


@query("SELECT doc_id AS query_id, highlighted AS highlighted_text FROM (" + base._highlight_sql("'<highlighted_text>'", base._ESC, _IN_MODEL + base._ESC.format('text[start + 1:"end"]') + " || '</extracted_phrase>'", "'</highlighted_text>'") + ") WHERE doc_id % 20 = 0")
def explain_highlights(spark, sf_dir):
    e, queries = _encoder(spark, sf_dir)
    return e.explain(queries)["highlighted_text"]


@query(base._WITH + base._TFIDF + "x AS (SELECT 1) SELECT doc_id AS query_id, t AS target, round(sum(value * (1 + (length(term) + t) % 3) * CASE WHEN t = 1 THEN -1.0 ELSE 1.0 END), 5) AS value FROM tfidf, (SELECT unnest(range(0, 3)) AS t) WHERE doc_id % 20 = 0 AND length(term) % 2 = 0 GROUP BY 1, 2")
def simple_encode(spark, sf_dir):
    e, queries = _encoder(spark, sf_dir, to_z=False)
    maps = encoder.SimpleEncoder(e.vectorizer, e.model.regression, e.mask).transform(queries)["brain_map"]
    return maps.withColumn("value", F.round("value", 5))


# Files: written to the shared folder and read again


def _folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or for a local session without one below /tmp."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(own or 'file:///tmp/checkpoints').rstrip('/')}/models-{uuid.uuid4().hex}"


@query(base._WITH + base._SYNONYMS + "x AS (SELECT 1) SELECT term, frequency, b AS mapped_to FROM voc LEFT JOIN syn ON term = a")
def vocabulary_files(spark, sf_dir):
    """The derived vocabulary and its synonyms through their files."""
    p, path = base._with_synonyms(spark, sf_dir), f"{_folder(spark)}/vocabulary.csv"
    vocabulary.write_pipeline(spark, p, path)
    mapping = vocabulary.read_mapping(spark, path)
    pairs = spark.createDataFrame(list(mapping.items()) or [("", "")], "a string, mapped_to string")
    rows = vocabulary.read_vocabulary(spark, path)
    return rows.join(pairs, rows.term == pairs.a, "left").select("term", "frequency", "mapped_to")


@query(_MODEL + "x AS (SELECT 1) SELECT query_id, target, round(value / greatest(sqrt(greatest(s, 0) * (1 + target)), 1e-24), 5) AS value FROM pred JOIN scale USING (query_id)")
def saved_encoder(spark, sf_dir):
    """The encoder written to its folder, read again and applied."""
    e, queries = _encoder(spark, sf_dir)
    path = _folder(spark)
    e.save(path)
    return encoder.Encoder.load(spark, path).transform(queries)["brain_map"].withColumn("value", F.round("value", 5))

