"""Risk-controlled quality rules.

Every text gets counts over all its words and lines (see `measured`), from
which five rules take a rate each: symbols, repeated words, repeated lines,
exclamation marks and words made of capitals. A rule rejects a text whose rate is
over the rule's cutoff for the text's stratum (its language).

Cutoffs come from labelled holdouts. A fixed ladder holds, from the mildest step to the
strictest, one cutoff per rule. For each stratum and step, k of the n labelled good
documents would be rejected by any of the rules. The step is safe if the exact
binomial tail P(X <= k | n, MAX_FALSE_REJECTION) is at most the error allowed: the
Clopper-Pearson upper bound of the false rejection rate of all rules together is
then at most that rate. Steps are tested in the ladder's order up to the first that isn't safe
(a fixed sequence, which needs no further correction), strata share the error
(1 - CONFIDENCE) evenly (Bonferroni), so with that confidence no stratum loses more
good documents than allowed. Of the steps before that one the one which rejects most
labelled bad documents is taken, of equal ones the mildest; if the first step isn't safe,
or no bad document is caught, nothing is rejected there. Strata with few labels (fewer than
about 90 good documents for four strata), and unlabelled strata, thus keep their texts.

Defined cases: a null text has no words and fails the base rule; a null
language is the stratum ''; a null id keeps its row; labels of one document that
differ count as bad; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import _SPACE, Tables, ngrams, sized, table, text_batches, with_columns_renamed_apart, word_codes

#: Largest share of a stratum's good documents that all rules together may reject, and the confidence.
MAX_FALSE_REJECTION, CONFIDENCE = 0.05, 0.95
RULES = ("symbols", "repeats", "dup_lines", "shouts", "capitals")
#: The ladder: each rule's cutoffs as rates, from the strictest step to the mildest.
GRIDS = {
    "symbols": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "repeats": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "dup_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.75),
    "shouts": (0.1, 0.2, 0.3, 0.5, 0.75, 1.0),
    "capitals": (0.2, 0.3, 0.4, 0.5, 0.6, 0.75),
}
STEPS = len(GRIDS["symbols"])
#: More strata with labels than this are joined by a shuffle; fewer are sent to all tasks (about 100 bytes each).
BROADCAST_STRATA = 10_000

_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_capitals"]


def _repeated_words(codes: np.ndarray, n: int = 8) -> int:
    """Words inside n-word windows that are found twice or more."""
    if len(codes) < n + 1:
        return 0
    _, inverse, counts = np.unique(ngrams(codes, n), return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + n, -1)
    return int((cover.cumsum()[:-1] > 0).sum())


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _counted(texts: list[bytes]) -> dict[str, list[int]]:
    rows = {c: [] for c in COUNTS}
    codes, bounds = word_codes(texts)
    for k, text in enumerate(texts):
        own = codes[bounds[k] : bounds[k + 1]]
        kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n_lines, n_dup = _lines(text)
        points = int(kinds.sum() - kinds[128:192].sum() - kinds[_SPACE].sum())
        for c, v in zip(COUNTS, (len(own), points, int(kinds @ _SYMBOLS), n_lines, n_dup, _repeated_words(own), int(kinds[33]), int(kinds @ _UPPER))):
            rows[c].append(v)
    return rows


def _counts(text: F.Column) -> F.Column:
    """The counts of a text as a struct, in Arrow batches; the row's other columns don't leave the JVM."""

    @F.arrow_udf(f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>")
    def count(texts: pa.Array) -> pa.Array:
        rows = {c: [] for c in COUNTS}
        for _, _, part in text_batches(texts):
            for c, own in _counted(part).items():
                rows[c] += own
        return pa.StructArray.from_arrays([pa.array(rows[c], pa.int64()) for c in COUNTS], COUNTS)

    return count(text)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """docs with a struct `q`: id, stratum, the counts, the rules' rates, base_failed."""
    rate = lambda x, of: F.coalesce(F.try_divide(F.col(f"q_counts.{x}"), F.col(f"q_counts.{of}")), F.lit(0.0)).cast("double")
    fields = {
        "id": F.col(f"`{id_col}`").cast("long"),
        "stratum": F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")),
        **{c: F.col(f"q_counts.{c}") for c in COUNTS},
        "symbols": rate("n_symbols", "word_chars"),
        "repeats": rate("n_repeat_words", "n_words"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "shouts": rate("n_shouts", "n_words"),
        "capitals": rate("n_capitals", "word_chars"),
        "base_failed": (F.col("q_counts.n_words") < 20) | (100 * F.col("q_counts.n_repeat_words") > 30 * F.col("q_counts.n_words")),
    }
    counted = docs.withColumn("q_counts", _counts(F.col(f"`{text_col}`").cast("string")))
    return counted.withColumn("q", F.struct(*[v.alias(k) for k, v in fields.items()])).drop("q_counts")


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, exactly summed; for the few rows of the table of steps."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(log - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


def _tails(frames):
    for f in frames:
        yield f.assign(tail=[_tail(k, n, MAX_FALSE_REJECTION) for k, n in zip(f["k"], f["n"])])


def _broken(rule: str, step) -> F.Column:
    """Whether a rule rejects at a step (null: at none); rates are those of the struct q."""
    return F.coalesce(F.col(f"q.{rule}") > F.get(F.array(*map(F.lit, GRIDS[rule])), step), F.lit(False))


def tested(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, step, n, k, caught, tail: for each step the good and bad labelled documents that it rejects. labels: doc_id, quality (1 good, 0 bad)."""
    known = with_columns_renamed_apart(labels, {"doc_id": "label_id", "quality": "quality"}).filter("label_id IS NOT NULL AND quality IS NOT NULL")
    known = known.groupBy(F.col("label_id").cast("long").alias("label_id")).agg(F.min("quality").alias("good"))
    # What the base rule rejects is gone before the rules: it isn't theirs to lose.
    holdout = measures.select("q").filter("NOT q.base_failed").join(known, F.col("q.id") == F.col("label_id"))
    rejected = [F.greatest(*[_broken(r, F.lit(i)) for r in RULES]) for i in range(STEPS)]
    counts = []
    for i, x in enumerate(rejected):
        counts += [F.sum((x & (F.col("good") == 1)).cast("int")).alias(f"good_{i}"), F.sum((x & (F.col("good") == 0)).cast("int")).alias(f"bad_{i}")]
    table = holdout.groupBy(F.col("q.stratum").alias("stratum")).agg(F.sum((F.col("good") == 1).cast("int")).alias("n"), *counts)
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"good_{i}").alias("k"), F.col(f"bad_{i}").alias("caught")) for i in range(STEPS)]))
    rows = table.select("stratum", "n", steps.alias("s")).select("stratum", "n", "s.*")
    return rows.mapInPandas(_tails, "stratum string, n long, step int, k long, caught long, tail double")


def cutoffs(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, step: the chosen step of the ladder."""
    table = Tables(measures.sparkSession).keep(tested(measures, labels), "tested")
    error = (1 - CONFIDENCE) / max(1, table.select("stratum").distinct().count())
    # The steps are milder the higher they are: those above the highest that isn't safe.
    unsafe = F.coalesce(F.max(F.when((F.col("n") == 0) | (F.col("tail") > error), F.col("step"))), F.lit(-1)).alias("unsafe")
    safe = table.join(table.groupBy("stratum").agg(unsafe), "stratum").filter("step > unsafe AND caught > 0")
    return safe.groupBy("stratum").agg(F.max(F.struct("caught", "step"))["step"].alias("step"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the struct q of `measured`, and q_rejected_by and q_kept."""
    # Only labelled documents are measured for the cutoffs.
    tables = Tables(docs.sparkSession)
    ids = sized(tables, labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("label_id")).distinct(), "labelled")
    labelled = docs.join(ids, F.col("doc_id") == F.col("label_id"), "left_semi")
    chosen = cutoffs(measured(labelled), labels).select(F.col("stratum").alias("q_stratum"), F.col("step").alias("q_step"))
    chosen = tables.keep(chosen, "cutoffs")
    measures, on = measured(docs), F.col("q.stratum") == F.col("q_stratum")
    if chosen.count() <= BROADCAST_STRATA:
        chosen = F.broadcast(chosen)
    else:  # the hot strata are spread over a salt
        chosen = chosen.withColumn("q_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        on &= F.pmod(F.hash("q.id"), F.lit(64)) == F.col("q_salt")
    broken = [F.when(_broken(r, F.col("q_step")), F.lit(r)) for r in RULES]
    out = measures.join(chosen, on, "left").withColumn("q_rejected_by", F.coalesce(F.concat_ws(",", *broken), F.lit("")))
    return out.withColumn("q_kept", ~F.col("q.base_failed") & (F.col("q_rejected_by") == "")).select(*docs.columns, "q", "q_rejected_by", "q_kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that a rule rejects; no row is shuffled for it."""
    return judged(docs, labels).filter("q_kept").select(*docs.columns)


_RATES = {
    "symbols": "n_symbols / nullif(word_chars, 0)",
    "repeats": "n_repeat_words / nullif(n_words, 0)",
    "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
    "shouts": "n_shouts / nullif(n_words, 0)",
    "capitals": "n_capitals / nullif(word_chars, 0)",
}
_LONG = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, coalesce({x}, 0)::DOUBLE AS rate FROM counts WHERE NOT base_failed" for r, x in _RATES.items())
SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) > 7)
), twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM twice, range(0, 8) AS r(j) GROUP BY 1),
counts AS (
  SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(n, 0) AS n_repeat_words, len(regexp_extract_all(t, '!')) AS n_shouts, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals,
    (len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w)) AS base_failed
  FROM words LEFT JOIN repeated USING (doc_id)
), rates AS ({_LONG}),
grid(rule, step, cutoff) AS (VALUES {', '.join(f"('{r}', {i}, {g}::DOUBLE)" for r in RULES for i, g in enumerate(GRIDS[r]))}),
known AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1),
held AS (SELECT stratum, doc_id, step, good, bool_or(rate > cutoff) AS rejected FROM rates JOIN known USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
tried AS (SELECT stratum, step, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND rejected) AS k, count(*) FILTER (good = 0 AND rejected) AS caught FROM held GROUP BY ALL),
tails AS (
  SELECT t.*, CASE WHEN k >= n THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_FALSE_REJECTION}) + (n - i) * ln({1 - MAX_FALSE_REJECTION}))) FROM range(0, 10000) AS r(i) WHERE i <= k) END AS tail FROM tried t
), unsafe AS (SELECT stratum, max(step) AS step FROM tails WHERE tail > {1 - CONFIDENCE} / (SELECT count(DISTINCT stratum) FROM tried) GROUP BY 1),
chosen AS (SELECT t.stratum, max_by(t.step, 100 * caught + t.step) AS step FROM tails t LEFT JOIN unsafe u ON u.stratum = t.stratum WHERE caught > 0 AND t.step > coalesce(u.step, -1) GROUP BY 1),
broken AS (
  SELECT DISTINCT doc_id, rule FROM ({_LONG.replace(' WHERE NOT base_failed', '')}) r JOIN chosen USING (stratum) JOIN grid USING (rule, step) WHERE rate > cutoff
), rejected AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({list(RULES)!r}, rule)) AS rules FROM broken GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by
FROM counts LEFT JOIN rejected USING (doc_id)
"""


def op3_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("q_kept").alias("kept"), F.col("q_rejected_by").alias("rejected_by"))
