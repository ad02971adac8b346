"""Ridge regression of maps on term vectors: leave-one-out selection, adaptive and selective forms, z-maps.

Inputs are long: x (study_id, term, value), y (study_id, target, value), and the
studies. Each study becomes one row of two sparse vectors. X^T X and X^T Y are sums
of products of dense blocks of rows, added up per task and then per feature by a
shuffle, so no pair of terms is ever a row; targets are gone through in blocks of a
fixed size. The p x p eigenproblem G = V diag(l) V^T is solved on the driver; all
penalties then cost one pass over the rows for the leave-one-out errors:

  coefficients   V diag(1 / (l + a)) V^T C
  leverage       1/n + sum_k (x_i . v_k)^2 / (l_k + a)
  filter gram    V diag(l / (l + a)^2) V^T     (stands for M M^T of the p x n filter M)

Feature penalties d scale G to D^-1/2 G D^-1/2, so X^T X is aggregated once for all fits.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.operators.blocks import dense, sparse_blocks

ALPHAS = tuple(np.logspace(-1, 3, 9))
#: Features at most: the eigenproblem is the driver's.
MAX_FEATURES = 6000
#: Numbers sent to every task at once, at most; more targets are gone through in blocks.
MAX_SENT = 20_000_000
FLOOR = 1e-24
#: Tasks that add up products, at most: each hands on a p x p matrix.
TASKS = 64


@dataclasses.dataclass
class Moments:
    """What the rows of X and Y add up to, and the rows for the passes."""

    rows: DataFrame  # study_id, and sparse vectors: x_at, x_value, y_at, y_value
    n: int
    terms: list
    targets: list
    x_mean: np.ndarray
    y_mean: np.ndarray
    gram: np.ndarray  # of centred X
    cross: np.ndarray  # of centred X and Y


def _index(spark: SparkSession, names: list, column: str) -> DataFrame:
    kind = "string" if names and isinstance(names[0], str) else "long"
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"at_{column} int, {column} {kind}")


def moments(x: DataFrame, y: DataFrame, studies: DataFrame, terms: list, targets: list) -> Moments:
    if len(terms) > MAX_FEATURES:
        raise ValueError(f"{len(terms)} features; the driver solves for {MAX_FEATURES} at most")
    spark = x.sparkSession
    ids = studies.select("study_id").distinct()
    xi = x.join(F.broadcast(_index(spark, terms, "term")), "term").join(ids, "study_id", "left_semi").select("study_id", F.col("at_term").alias("t"), "value")
    yi = y.join(_index(spark, targets, "target"), "target").join(ids, "study_id", "left_semi").select("study_id", F.col("at_target").alias("t"), "value")
    n, p, q = ids.count(), len(terms), len(targets)
    rows = ids
    for t, name in ((xi, "x"), (yi, "y")):
        lists = t.groupBy("study_id").agg(F.collect_list(F.struct(F.col("t").alias("at"), "value")).alias("own"))
        rows = rows.join(lists.select("study_id", F.col("own.at").alias(f"{name}_at"), F.col("own.value").alias(f"{name}_value")), "study_id", "left")
    gram, cross, mx, my = np.zeros((p, p)), np.zeros((p, q)), np.zeros(p), np.zeros(q)
    for m, t in ((mx, xi), (my, yi)):
        s = t.groupBy("t").agg(F.sum("value").alias("v")).toPandas()
        m[s["t"]] = s["v"] / max(n, 1)
    few = rows.coalesce(TASKS)
    for a, b in _blocks(p, q) or [(0, 0)]:
        sums = few.mapInPandas(_products(p, a, b, a == 0), _SUMS).groupBy("i").applyInPandas(_added, _SUMS)
        for r in sums.toLocalIterator():
            if a == 0:
                gram[r["i"]] = r["g"]
            cross[r["i"], a:b] = r["c"]
    return Moments(rows, n, list(terms), list(targets), mx, my, gram - n * np.outer(mx, mx), cross - n * np.outer(mx, my))


_SUMS = "i int, g array<double>, c array<double>"


def _products(p: int, a: int, b: int, with_gram: bool):
    """X^T X and X^T Y[a:b] of a task's rows, one row per feature."""

    def run(frames):
        gram, cross = np.zeros((p, p if with_gram else 0)), np.zeros((p, b - a))
        for frame in frames:
            for part in sparse_blocks(frame, p + b - a):
                x = dense(part["x_at"], part["x_value"], p)
                cross += x.T @ dense(part["y_at"], part["y_value"], b - a, a)
                if with_gram:
                    gram += x.T @ x
        yield pd.DataFrame({"i": np.arange(p, dtype=np.int32), "g": list(gram), "c": list(cross)})

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": frame["i"].iloc[:1], "g": [np.sum(frame["g"].to_list(), axis=0)], "c": [np.sum(frame["c"].to_list(), axis=0)]})


def _blocks(p: int, q: int):
    size = max(1, MAX_SENT // max(p, 1))
    return [(a, min(q, a + size)) for a in range(0, q, size)]


@dataclasses.dataclass
class Ridge:
    """A fit. coef: terms x targets. filter_gram: None if variances can't be estimated."""

    terms: list
    targets: list
    coef: np.ndarray
    intercept: np.ndarray
    filter_gram: np.ndarray | None = None
    residual_var: np.ndarray | None = None
    alpha: float | None = None
    loo_error: np.ndarray | None = None
    loo_std: np.ndarray | None = None
    penalty: np.ndarray | None = None
    #: terms of the data that the fit was selected from, in order
    all_terms: list | None = None

    def variance(self) -> np.ndarray:
        if self.filter_gram is None or self.residual_var is None:
            raise ValueError("this model cannot estimate the variance of its coefficients")
        return np.outer(np.diag(self.filter_gram), self.residual_var)

    def z_energy(self, use_positive_part=True, regularize_var=True, order=None) -> np.ndarray:
        var = self.variance()
        var = var + (var.mean() if regularize_var else FLOOR)
        z = self.coef / np.sqrt(var)
        if use_positive_part:
            z = np.maximum(z, 0)
        return (z**2).mean(axis=1) if order is None else np.linalg.norm(z, axis=1, ord=order)

    def z_maps(self, full: bool = True) -> np.ndarray:
        z = self.coef / np.maximum(np.sqrt(self.variance()), FLOOR)
        if not full or self.all_terms is None:
            return z
        out, at = np.zeros((len(self.all_terms), z.shape[1])), {t: i for i, t in enumerate(self.all_terms)}
        out[[at[t] for t in self.terms]] = z
        return out

    # Tables for scoring

    def coef_table(self, spark: SparkSession) -> DataFrame:
        """term, target, value."""
        i, j = np.nonzero(self.coef)
        kinds = ["string" if isinstance(n[0], str) else "long" for n in (self.terms, self.targets)] if self.terms and self.targets else ["string", "long"]
        frame = pd.DataFrame({"term": np.array(self.terms, object)[i], "target": np.array(self.targets, object)[j], "value": self.coef[i, j]})
        return spark.createDataFrame(frame, f"term {kinds[0]}, target {kinds[1]}, value double")

    def target_table(self, spark: SparkSession) -> DataFrame:
        """target, intercept, residual_var."""
        var = self.residual_var if self.residual_var is not None else [None] * len(self.targets)
        kind = "string" if self.targets and isinstance(self.targets[0], str) else "long"
        return spark.createDataFrame([(t, float(a), None if v is None else float(v)) for t, a, v in zip(self.targets, self.intercept, var)], f"target {kind}, intercept double, residual_var double")

    def gram_table(self, spark: SparkSession) -> DataFrame | None:
        """term_i, term_j, value of the filter gram."""
        if self.filter_gram is None:
            return None
        i, j = np.nonzero(self.filter_gram)
        names = np.array(self.terms, object)
        return spark.createDataFrame(pd.DataFrame({"term_i": names[i], "term_j": names[j], "value": self.filter_gram[i, j]}), "term_i string, term_j string, value double")


def predicted(x: DataFrame, coef: DataFrame, targets: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key, target, value: x . coef, plus the intercept where targets (target, intercept) are given. Rows of x without a term of the model have none, unless targets are given."""
    out = x.join(coef.withColumnRenamed("value", "c"), "term").groupBy(key, "target").agg(F.sum(F.col("value") * F.col("c")).alias("value"))
    if targets is None:
        return out
    every = x.select(key).distinct().crossJoin(targets.select("target", "intercept"))  # the dense result
    return every.join(out, [key, "target"], "left").select(key, "target", (F.coalesce("value", F.lit(0.0)) + F.col("intercept")).alias("value"))


def prediction_scale(x: DataFrame, filter_gram: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, scale: x M M^T x^T of each row (x isn't centred)."""
    half = x.join(filter_gram.withColumnRenamed("value", "g"), F.col("term") == F.col("term_i")).groupBy(key, "term_j").agg(F.sum(F.col("value") * F.col("g")).alias("h"))
    other = x.select(F.col(key).alias("other_key"), F.col("term").alias("other_term"), F.col("value").alias("other"))
    joined = half.join(other, (F.col(key) == F.col("other_key")) & (F.col("term_j") == F.col("other_term")))
    return joined.groupBy(key).agg(F.sum(F.col("h") * F.col("other")).alias("scale"))


def prediction_variance(x: DataFrame, filter_gram: DataFrame | None, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, target, variance: the scale times each target's residual variance."""
    if filter_gram is None:
        raise ValueError("this model cannot estimate the variance of its predictions")
    return prediction_scale(x, filter_gram, key).crossJoin(targets.select("target", "residual_var")).select(key, "target", (F.col("scale") * F.col("residual_var")).alias("variance"))


def z_maps_of(x: DataFrame, coef: DataFrame, filter_gram: DataFrame | None, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, target, value: x . coef (no intercept) over the standard deviation of the prediction."""
    if filter_gram is None:
        raise ValueError("this model cannot estimate the variance of its predictions")
    scale = prediction_scale(x, filter_gram, key).withColumnRenamed(key, "scale_key")
    out = predicted(x, coef, key=key).join(scale, F.col(key) == F.col("scale_key")).join(targets.select("target", "residual_var"), "target")
    deviation = F.sqrt(F.greatest(F.col("scale"), F.lit(0.0)) * F.col("residual_var"))
    return out.select(key, "target", (F.col("value") / F.greatest(deviation, F.lit(FLOOR))).alias("value"))


def fit(m: Moments, alphas=ALPHAS, penalty: np.ndarray | None = None, keep: np.ndarray | None = None) -> Ridge:
    """The ridge fit at the alpha of the smallest mean leave-one-out error (the first of equal ones). keep: features used."""
    keep = np.arange(len(m.terms)) if keep is None else np.asarray(keep)
    p, q, n = len(keep), len(m.targets), m.n
    terms = [m.terms[i] for i in keep]
    if not p:
        res = np.zeros(q)
        return Ridge(terms, m.targets, np.zeros((0, q)), m.y_mean.copy(), np.zeros((0, 0)), res, float(alphas[0]), all_terms=m.terms)
    root = np.ones(p) if penalty is None else np.sqrt(penalty)
    values, vectors = np.linalg.eigh(m.gram[np.ix_(keep, keep)] / np.outer(root, root))
    values = np.maximum(values, 0)
    basis = vectors / root[:, None]  # takes rows of centred x to the eigenbasis
    x_mean = m.x_mean[keep]
    alphas = np.asarray(alphas, float)
    spark = m.rows.sparkSession
    where = np.full(len(m.terms), -1)
    where[keep] = np.arange(p)
    errors = None
    for a, b in _blocks(p, q):
        sent = spark.sparkContext.broadcast((where, basis, x_mean, values, basis.T @ m.cross[keep, a:b], m.y_mean[a:b]))
        part = m.rows.mapInPandas(_loo_pass(sent, alphas, n, a, b), "study_id long, errors array<double>")
        own = part.select("study_id", F.posexplode("errors").alias("k", "e"))
        errors = own if errors is None else errors.union(own)
    per = errors.groupBy("study_id", "k").agg(F.sum("e").alias("e")).groupBy("k").agg(F.avg("e").alias("mean"), F.stddev_pop("e").alias("std"))
    stats = per.toPandas().sort_values("k")
    mean, std = stats["mean"].to_numpy(), stats["std"].to_numpy() / np.sqrt(n)
    alpha = float(alphas[int(np.argmin(mean))])
    coef = basis @ ((basis.T @ m.cross[keep]) / (values + alpha)[:, None])
    intercept = m.y_mean - x_mean @ coef
    residual = np.zeros(q)
    for a, b in _blocks(p, q):
        sent = spark.sparkContext.broadcast((where, coef[:, a:b], intercept[a:b]))
        for row in m.rows.mapInPandas(_residual_pass(sent, a, b), "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toLocalIterator():
            residual[row["at"]] = row["s"] / n
    gram = (basis * (values / (values + alpha) ** 2)) @ basis.T
    return Ridge(terms, m.targets, coef, intercept, gram, residual, alpha, mean, std, penalty, m.terms)


def _loo_pass(sent, alphas, n, a, b):
    def run(frames):
        where, basis, x_mean, values, d, y_mean = sent.value
        for frame in frames:
            for part in sparse_blocks(frame, len(x_mean) + b - a):
                z = (dense(part["x_at"], part["x_value"], len(x_mean), where=where) - x_mean) @ basis
                y = dense(part["y_at"], part["y_value"], b - a, a) - y_mean
                out = []
                for alpha in alphas:
                    h = 1 / n + (z**2 / (values + alpha)).sum(axis=1)
                    out.append((((y - (z / (values + alpha)) @ d) / (1 - h)[:, None]) ** 2).sum(axis=1))
                yield pd.DataFrame({"study_id": part["study_id"], "errors": list(np.array(out).T)})

    return run


def _residual_pass(sent, a, b):
    def run(frames):
        where, coef, intercept = sent.value
        total = np.zeros(b - a)
        for frame in frames:
            for part in sparse_blocks(frame, len(coef) + b - a):
                x = dense(part["x_at"], part["x_value"], len(coef), where=where)
                total += ((x @ coef + intercept - dense(part["y_at"], part["y_value"], b - a, a)) ** 2).sum(axis=0)
        yield pd.DataFrame({"at": np.arange(a, b), "s": total})

    return run


def adaptive_penalty(plain: Ridge, use_positive_part=True, regularize_var=True, order=None) -> np.ndarray:
    """A feature's penalty falls as its energy stands out (two deviations over the mean); the least is 1."""
    e = plain.z_energy(use_positive_part, regularize_var, order)
    d = 1 / np.maximum(e - (e.mean() + 2 * e.std()), 0.001)
    return d / d.min()


def fit_adaptive(m: Moments, alphas=ALPHAS, **energy) -> Ridge:
    return fit(m, alphas, adaptive_penalty(fit(m, alphas), **energy))


def fit_selective(m: Moments, alphas=ALPHAS, **energy) -> Ridge:
    """Only features whose penalty is below the largest; none, if no feature stands out: the model is then its intercept."""
    d = adaptive_penalty(fit(m, alphas), **energy)
    keep = np.flatnonzero(d < d.max())
    return fit(m, alphas, d[keep], keep)
