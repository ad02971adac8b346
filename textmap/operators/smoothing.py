"""Low-rank smoothing of term vectors by a nonnegative factor of the corpus.

X (documents x terms) is factored as U H with nonnegative U and H; V = H^T diag(|U_k|).
Vectors x are smoothed to w * x Vn V^T + (1 - w) * x, where row i of Vn is V_i over
the norm of row i of V V^T. The p x p product is never formed: that norm is
sqrt(v_i (V^T V) v_i^T).

The factors come from alternating coordinate descent: each pass sends H (k x p) to
the tasks, solves the rows of U there, and returns the sums U^T U and U^T X; H is
then updated on the driver. U is never kept. The penalty follows the convention
alpha * l1_ratio * sum + alpha * (1 - l1_ratio) / 2 * squares, on U scaled by the
number of terms and on H scaled by the number of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.operators.blocks import dense, sparse_blocks

N_COMPONENTS, WEIGHT, MAX_ROUNDS, ALPHA, L1_RATIO, SEED = 300, 0.1, 200, 0.1, 0.1, 0
#: Doubles of H sent to every task, at most.
MAX_FACTOR = 20_000_000


def _descend(gram: np.ndarray, cross: np.ndarray, w: np.ndarray, l1: float, l2: float, sweeps: int) -> np.ndarray:
    """Coordinate descent on the rows of w for |x - w h|^2 / 2 + l1 |w| + l2 |w|^2 / 2 with w >= 0; gram = h h^T, cross = x h^T."""
    for _ in range(sweeps):
        for c in range(gram.shape[0]):
            step = w @ gram[:, c] - cross[:, c] + l1 + l2 * w[:, c]
            hess = gram[c, c] + l2
            if hess > 0:
                w[:, c] = np.maximum(w[:, c] - step / hess, 0)
    return w


def factor(vectors: DataFrame, terms: list[str], n_components: int = N_COMPONENTS, max_rounds: int = MAX_ROUNDS, alpha: float = ALPHA, l1_ratio: float = L1_RATIO, tol: float = 1e-4, sweeps: int = 20) -> np.ndarray:
    """V (terms x components). vectors: doc_id, term, value."""
    p, k = len(terms), n_components
    if p * k > MAX_FACTOR:
        raise ValueError(f"a factor of {p} x {k} is larger than {MAX_FACTOR} numbers")
    spark = vectors.sparkSession
    index = spark.createDataFrame(list(enumerate(terms)), "at int, term string")
    lists = vectors.join(index, "term").groupBy("doc_id").agg(F.collect_list(F.struct("at", "value")).alias("x"))
    rows = lists.select(F.col("x.at").alias("at"), F.col("x.value").alias("value")).persist()
    n = rows.count()
    if not n:
        return np.zeros((p, k))
    mean = vectors.agg(F.sum("value")).first()[0] / (n * p)
    rng = np.random.default_rng(SEED)
    h = np.abs(rng.standard_normal((k, p))) * np.sqrt(mean / k)
    l1u, l2u, l1h, l2h = alpha * l1_ratio * p, alpha * (1 - l1_ratio) * p, alpha * l1_ratio * n, alpha * (1 - l1_ratio) * n
    l1u, l2u, l1h, l2h = (x / max(n, p) for x in (l1u, l2u, l1h, l2h))
    last = None
    for _ in range(max_rounds):
        sums = _pass(rows, spark.sparkContext.broadcast(h), p, k, l1u, l2u, sweeps)
        utu, utx = sums[:, :k], sums[:, k:]
        h = _descend(utu, utx.T, h.T.copy(), l1h, l2h, sweeps).T
        size = np.linalg.norm(h)
        if last is not None and abs(size - last) <= tol * max(size, 1e-12):
            break
        last = size
    sums = _pass(rows, spark.sparkContext.broadcast(h), p, k, l1u, l2u, sweeps)
    rows.unpersist()
    return h.T * np.sqrt(np.diag(sums[:, :k]))


def _pass(rows: DataFrame, sent, p: int, k: int, l1: float, l2: float, sweeps: int) -> np.ndarray:
    """[U^T U, U^T X] summed over the rows: one row per component and task, added up by a shuffle on the component."""

    def part(frames):
        h = sent.value
        gram, total = h @ h.T, np.zeros((k, k + p))
        for frame in frames:
            for own in sparse_blocks(frame, k + p):
                x = dense(own["at"], own["value"], p)
                u = _descend(gram, x @ h.T, np.full((len(x), k), 0.1), l1, l2, sweeps)
                total += u.T @ np.hstack([u, x])
        yield pd.DataFrame({"c": np.arange(k), "sums": list(total)})

    def add(frame):
        return pd.DataFrame({"c": [frame["c"].iloc[0]], "sums": [np.sum(frame["sums"].to_list(), axis=0)]})

    kind = "c long, sums array<double>"
    out = rows.mapInPandas(part, kind).groupBy("c").applyInPandas(add, kind).toPandas().sort_values("c")
    return np.array(out["sums"].to_list())


def factor_table(spark, v: np.ndarray, terms: list[str]) -> DataFrame:
    """term, component, value; zeros are absent rows."""
    at = np.argwhere(v != 0)
    return spark.createDataFrame(pd.DataFrame({"term": [terms[i] for i, _ in at], "component": at[:, 1], "value": v[at[:, 0], at[:, 1]]}), "term string, component int, value double")


def normalized_factor(v: DataFrame) -> DataFrame:
    """V's rows over the norms of the rows of V V^T, from the k x k product."""
    a, b = v.alias("a"), v.alias("b")
    gram = a.join(b, F.col("a.term") == F.col("b.term")).groupBy(F.col("a.component").alias("c1"), F.col("b.component").alias("c2")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("g"))
    through = v.join(gram, v.component == gram.c1).groupBy("term", "c2").agg(F.sum(F.col("value") * F.col("g")).alias("vg"))
    norm = through.join(v.select(F.col("term").alias("t2"), "component", "value"), (F.col("term") == F.col("t2")) & (F.col("c2") == F.col("component")))
    norm = norm.groupBy("term").agg(F.sqrt(F.sum(F.col("vg") * F.col("value"))).alias("norm"))
    return v.join(norm, "term").filter("norm > 0").select("term", "component", (F.col("value") / F.col("norm")).alias("value"))


def smoothed(vectors: DataFrame, v: DataFrame, weight: float = WEIGHT, key: str = "doc_id", v_normalized: DataFrame | None = None) -> DataFrame:
    """weight * x Vn V^T + (1 - weight) * x, in two joins: terms to components, components to terms."""
    vn = normalized_factor(v) if v_normalized is None else v_normalized
    inner = vectors.join(vn.withColumnRenamed("value", "f"), "term").groupBy(key, "component").agg(F.sum(F.col("value") * F.col("f")).alias("s"))
    moved = inner.join(v.withColumnRenamed("value", "f"), "component").select(key, "term", (F.col("s") * F.col("f") * weight).alias("value"))
    own = vectors.select(key, "term", (F.col("value") * (1 - weight)).alias("value"))
    return moved.unionByName(own).groupBy(key, "term").agg(F.sum("value").alias("value")).filter("value <> 0")
