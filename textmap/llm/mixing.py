"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are counted into cells (source, language, topic); a cell's supply is
its number of tokens (words between ASCII white space). Raking scales the cells'
weights to the target marginals in turn. A weight never exceeds its cell's supply,
so weight over supply is a sampling probability. Each step is exact: the factor of
a value is the one at which its cells, those that reach their supply held there,
sum to the target. Rounds go on until every marginal is within TOLERANCE of its
target (or the error no longer falls, or MAX_ROUNDS are over; `marginals` reports what each value reached, and a
warning names the error left). A document is sampled if a number hashed from its
id is below its cell's probability: the sample is the same in every run, and
grows with the fraction.

Targets are shares per value of each dimension. By default they are the supplies'
shares, flattened by an exponent (temperature) below one: common values are
sampled less, rare ones more. All of a dimension's targets sum to FRACTION of all
tokens; a value whose share asks for more than its supply gets its supply, and the
rest of its share goes to the other values in proportion. Marginals that no cells
can meet together (a source that has one topic only, say) are met as far as the
rounds bring them.

A topic is a column of the documents, if `topic_col` names one. Without it (the
given tables have none) the form of the text stands for it, told by simple counts:
'table', 'symbols', 'shout', 'short', 'prose'.

Everything is DataFrame functions. A step is a few window sums over the cells; some
rounds make one plan, whose result is written to the shared folder. Up to
CELLS_IN_ONE_TASK cells need no exchange at all; more are dealt by value. Rows
meet the result in one join on the cell, which is broadcast below a checked size
and else salted by document.

Defined cases: nulls in a dimension are the value ''; a null text has no tokens
(its cell's probability is 0 if the cell has none); null ids hash as ''; repeated
rows are sampled together; with targets given, values that they don't name take
part at the fraction, and targets of values without supply are left out; an empty
table gives an empty sample; extra columns are kept.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import Tables, sized, table

DIMENSIONS = ("source", "lang", "topic")
FRACTION, TEMPERATURE, SEED = 0.5, 0.5, "mix-1"
#: Largest relative error of a marginal, rounds at most, and rounds per written table.
TOLERANCE, MAX_ROUNDS, ROUNDS_AT_ONCE = 1e-4, 100, 4
#: Cells up to this many (about 100 bytes each) are sent to all tasks.
BROADCAST_CELLS = 50_000
CELLS_IN_ONE_TASK = 500_000
SALT = 64
#: A factor that no marginal holds back ends at this multiple of the supply.
_CEILING = 1e12

_WORD = r"[^\x20\x09-\x0D]+"


def with_tokens_and_topic(docs: DataFrame, topic_col: str | None = None) -> DataFrame:
    """docs with mix_tokens and mix_topic."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"mix_tokens": F.regexp_count(text, F.lit(_WORD)).cast("long")})
    if topic_col is not None:
        return docs.withColumn("mix_topic", F.col(f"`{topic_col}`").cast("string"))
    n = F.col("mix_tokens")
    # Byte-wise replacements: a text without the character isn't copied.
    one = lambda c: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    count = lambda chars: sum((one(c) for c in chars[1:]), one(chars[0]))
    topic = (
        F.when(n < 50, "short").when(5 * count("|") > n, "table").when(5 * count("#*$%&") > n, "symbols").when(5 * count("!") > n, "shout").otherwise("prose")
    )
    return docs.withColumn("mix_topic", topic)


def _by_dimension(values: dict[str, float]) -> F.Column:
    return F.coalesce(*[F.when(F.col("dimension") == d, F.lit(float(v))) for d, v in values.items()])


def levels(values: DataFrame, totals: dict[str, float]) -> dict[str, float]:
    """Per dimension the level at which least(supply, level * share) sums to its total: capped values are taken out until none is left to cap."""
    at = dict.fromkeys(totals, 0.0)
    while True:
        over = F.col("supply") <= _by_dimension(at) * F.col("share")
        sums = values.groupBy("dimension").agg(F.sum(F.when(over, F.col("supply")).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("share"))).alias("rest"))
        up = {r["dimension"]: (totals[r["dimension"]] - r["capped"]) / r["rest"] if r["rest"] else math.inf for r in sums.collect()}
        up = {d: max(at[d], up.get(d, 0.0)) for d in at}
        if all(up[d] <= at[d] * (1 + 1e-15) for d in at):
            return at
        at = up


def target_tokens(cells: DataFrame, fraction: float, shares: dict[str, DataFrame], temperature: float, tables: Tables) -> DataFrame:
    """(dimension, value, tokens). shares: (value, share) in any scale, for dimensions that don't have flattened supplies."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    values = cells.select(pairs.alias("v"), "supply").groupBy("v.dimension", "v.value").agg(F.sum("supply").cast("double").alias("supply"))
    values = values.withColumn("share", F.pow("supply", F.lit(temperature)))
    for d, own in shares.items():
        own = own.groupBy(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("s_value")).agg(F.greatest(F.max("share").cast("double"), F.lit(0.0)).alias("s_share"))
        here = F.col("dimension") == d
        values = values.join(own, here & (F.col("value") == F.col("s_value")), "left").withColumn("share", F.when(here, F.col("s_share")).otherwise(F.col("share"))).drop("s_value", "s_share")
    values = tables.keep(values.filter("supply > 0"), "values")
    named = values.filter("share IS NOT NULL").groupBy("dimension").agg(F.sum("supply").alias("supply")).collect()
    at = levels(values.filter("share > 0"), {d: 0.0 for d in DIMENSIONS} | {r["dimension"]: fraction * r["supply"] for r in named})
    asked = F.when(F.col("share").isNull(), fraction * F.col("supply")).when(F.col("share") == 0, 0.0)
    return values.select("dimension", "value", asked.otherwise(F.least("supply", _by_dimension(at) * F.col("share"))).alias("tokens"))


#: The weight of a cell: what it is scaled to, or its supply.
_WEIGHT = "least(CAST(supply AS double), scaled)"


def _step(d: str, before: str) -> str:
    """One exact step over the cells `before`: those of each value of d are scaled until, capped at their supplies, they sum to the target.

    Of the cells in the order of supply over scaled weight the first ones are capped; the factor is the largest of what
    is left of the target over what is left of the weights.
    """
    order = f"PARTITION BY {d} ORDER BY coalesce(try_divide(CAST(supply AS double), scaled), double('inf')), {', '.join(x for x in DIMENSIONS if x != d)}"
    columns = ", ".join(["supply", *DIMENSIONS, *[f"t_{x}" for x in DIMENSIONS]])
    return f"""
SELECT {columns}, CASE WHEN t_{d} IS NULL THEN scaled ELSE least(scaled * coalesce(max(factor) OVER (PARTITION BY {d}), 1.0D), supply * {_CEILING}D) END AS scaled
FROM (SELECT *, try_divide(t_{d} - coalesce(sum(CAST(supply AS double)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0D),
  sum(scaled) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS factor FROM {before})"""


def _rounds(cells: DataFrame, n: int) -> DataFrame:
    """cells after n rounds, with the largest relative error of the marginals that a cell is in; one statement, so the plan is analysed once."""
    steps, last = [], "{cells}"
    for k in range(n):
        for d in DIMENSIONS:
            steps.append(f"{d}_{k} AS ({_step(d, last)})")
            last = f"{d}_{k}"
    errors = ", ".join(f"coalesce(abs(try_divide(sum({_WEIGHT}) OVER (PARTITION BY {d}), t_{d}) - 1), 0.0D)" for d in DIMENSIONS)
    return cells.sparkSession.sql(f"WITH {', '.join(steps)} SELECT *, greatest({errors}) AS error FROM {last}", cells=cells)


def raked(cells: DataFrame, targets: DataFrame, fraction: float, tables: Tables, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """cells (those with a supply) with t_<dimension>, the targets, and `weight`: tokens to take, at most the supply.

    targets: (dimension, value, tokens).
    """
    targets = sized(tables, targets, "targets", BROADCAST_CELLS)
    out = cells.filter("supply > 0").withColumn("scaled", F.col("supply") * F.lit(float(fraction)))
    for d in DIMENSIONS:
        own = targets.filter(F.col("dimension") == d).select(F.col("value").alias(f"v_{d}"), F.col("tokens").alias(f"t_{d}"))
        out = out.join(own, F.col(d) == F.col(f"v_{d}"), "left").drop(f"v_{d}")
    kept = tables.keep(out.select("supply", "scaled", *DIMENSIONS, *[f"t_{d}" for d in DIMENSIONS]), "cells")
    in_one = kept.count() <= CELLS_IN_ONE_TASK
    error, before, rounds = math.inf, math.inf, 0
    while error > tolerance and rounds < max_rounds and not error > 0.99 * before:
        new = tables.keep(_rounds(kept.coalesce(1) if in_one else kept, ROUNDS_AT_ONCE), "raked")
        tables.drop(kept)
        kept, rounds = new, rounds + ROUNDS_AT_ONCE
        error, before = new.agg(F.max("error")).first()[0] or 0.0, error
    if error > tolerance:
        logging.getLogger(__name__).warning("raking ended after %d rounds with a marginal off by %.3g of its target", rounds, error)
    return kept.select("supply", *DIMENSIONS, *[f"t_{d}" for d in DIMENSIONS], F.expr(_WEIGHT).alias("weight"))


def marginals(cells: DataFrame) -> DataFrame:
    """dimension, value, supply, target, reached, error (relative) of raked cells."""
    out = None
    for d in DIMENSIONS:
        part = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum("supply").alias("supply"), F.max(f"t_{d}").alias("target"), F.sum("weight").alias("reached"))
        out = part if out is None else out.union(part)
    return out.withColumn("error", F.coalesce(F.abs(F.try_divide("reached", "target") - 1), F.lit(0.0)))


def uniform(id_col: str = "doc_id", seed: str = SEED):
    """A number in [0, 1) from a document's id: 13 hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


_COLUMNS = {"source": "source", "lang": "lang", "topic": "mix_topic"}


def _keys() -> dict:
    return {d: F.coalesce(F.col(c).cast("string"), F.lit("")) for d, c in _COLUMNS.items()}


def raked_cells(rows: DataFrame, tables: Tables, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, temperature: float = TEMPERATURE) -> DataFrame:
    """The raked cells of rows with mix_tokens and mix_topic. targets: (value, share) of the dimensions that have their own."""
    cells = tables.keep(rows.groupBy(*[k.alias(d) for d, k in _keys().items()]).agg(F.sum("mix_tokens").alias("supply")), "supplies")
    return raked(cells, target_tokens(cells, fraction, targets or {}, temperature, tables), fraction, tables)


def calibrated(docs: DataFrame, topic_col: str | None = None, targets: dict[str, DataFrame] | None = None, fraction: float = FRACTION, temperature: float = TEMPERATURE) -> DataFrame:
    """docs with mix_tokens, mix_topic, mix_prob (the cell's probability) and mix_sampled."""
    rows, tables = with_tokens_and_topic(docs, topic_col), Tables(docs.sparkSession)
    return with_probabilities(rows, raked_cells(rows, tables, targets, fraction, temperature))


def with_probabilities(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows (with mix_tokens and mix_topic) with mix_prob and mix_sampled."""
    probs = cells.select(*[F.col(d).alias(f"mix_{d}_key") for d in DIMENSIONS], (F.col("weight") / F.col("supply")).alias("mix_prob"))
    on = [k == F.col(f"mix_{d}_key") for d, k in _keys().items()]
    if cells.count() <= BROADCAST_CELLS:
        probs = F.broadcast(probs)
    else:
        probs = probs.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        on.append(F.pmod(F.hash(F.col("doc_id")), F.lit(SALT)) == F.col("mix_salt"))
    joined = rows.join(probs, on, "left").withColumn("mix_prob", F.coalesce("mix_prob", F.lit(0.0)))
    return joined.withColumn("mix_sampled", uniform() < F.col("mix_prob")).drop("mix_salt", *[f"mix_{d}_key" for d in DIMENSIONS])


def sampled(docs: DataFrame, **settings) -> DataFrame:
    """The sampled rows, with docs' columns and mix_prob."""
    return calibrated(docs, **settings).filter("mix_sampled").select(*docs.columns, "mix_prob")


#: Rounds in the SQL: more than small tables take; it, too, stops where every marginal is within the tolerance.
_SQL_ROUNDS = 32


def _sql() -> str:
    parts = [
        rf"""
words AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n FROM documents),
rows_ AS MATERIALIZED (SELECT doc_id, source, lang, n, CASE WHEN n < 50 THEN 'short' WHEN 5 * (length(t) - length(replace(t, '|', ''))) > n THEN 'table'
  WHEN 5 * (length(t) - length(translate(t, '#*$%&', ''))) > n THEN 'symbols' WHEN 5 * (length(t) - length(replace(t, '!', ''))) > n THEN 'shout' ELSE 'prose' END AS topic FROM words),
supplies AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS s FROM rows_ GROUP BY 1, 2, 3 HAVING sum(n) > 0)"""
    ]
    for d in DIMENSIONS:
        parts.append(f"v_{d} AS (SELECT {d} AS v, sum(s) AS s, pow(sum(s), {TEMPERATURE}) AS h FROM supplies GROUP BY 1)")
        parts.append(
            f"""l_{d} AS (SELECT max(({FRACTION} * (SELECT sum(s) FROM supplies) - c) / r) AS l FROM (SELECT coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(h) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM v_{d} WINDOW o AS (ORDER BY s / h, v)))"""
        )
        parts.append(f"t_{d} AS MATERIALIZED (SELECT v, least(s, l * h) AS t FROM v_{d}, l_{d})")
    parts.append(
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, s, s * {FRACTION} AS u, x.t AS t_source, y.t AS t_lang, z.t AS t_topic FROM supplies JOIN t_source x ON source = x.v JOIN t_lang y ON lang = y.v JOIN t_topic z ON topic = z.v)"
    )
    k, ended = 0, []
    for _ in range(_SQL_ROUNDS):
        for d in DIMENSIONS:
            others = ", ".join(x for x in DIMENSIONS if x != d)
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, s, u * max((t_{d} - c) / r) OVER (PARTITION BY {d}) AS u, t_source, t_lang, t_topic FROM (
  SELECT *, coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(u) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
  FROM c{k} WINDOW o AS (PARTITION BY {d} ORDER BY s / u, {others})))"""
            )
            k += 1
        if (k // len(DIMENSIONS)) % ROUNDS_AT_ONCE == 0:
            ended.append(f"SELECT {k} AS k, source, lang, topic, s, u, greatest({', '.join(f'abs(sum(least(s, u)) OVER (PARTITION BY {d}) / t_{d} - 1)' for d in DIMENSIONS)}) AS error FROM c{k}")
    parts.append(f"ended AS MATERIALIZED ({' UNION ALL '.join(ended)})")
    parts.append(f"raked AS (SELECT * FROM ended WHERE k = (SELECT min(k) FROM (SELECT k, max(error) AS e FROM ended GROUP BY 1) WHERE e <= {TOLERANCE}))")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n AS n_tokens, round(coalesce(least(s, u) / s, 0), 6) AS prob,
  (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / {float(1 << 52)!r}) < coalesce(least(s, u) / s, 0) AS sampled
FROM rows_ LEFT JOIN raked USING (source, lang, topic)"""
    )


SQL = _sql()


def op7_raking(spark, sf_dir: str) -> DataFrame:
    tables = Tables(spark)
    rows = with_tokens_and_topic(table(spark, sf_dir, "documents"))
    # Counted once: the narrow table serves both the cells and the rows.
    rows = tables.keep(rows.select("doc_id", *[k.alias(_COLUMNS[d]) for d, k in _keys().items()], "mix_tokens"), "counted")
    return with_probabilities(rows, raked_cells(rows, tables)).select(
        "doc_id",
        "source",
        "lang",
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_prob", 6).alias("prob"),
        F.col("mix_sampled").alias("sampled"),
    )
