"""The regressions and the composed model behind one protocol: parameters, fit, predict, z_maps.

x is (study_id, term, value), y (study_id, target, value); what a fit learned has names that end in an underscore.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.operators import encoder, ridge, smoothing


class Estimator:
    """Parameters are the dataclass's fields; `clone` has the same ones and nothing learned."""

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}

    def set_params(self, **params):
        unknown = set(params) - set(self.get_params())
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        for name, value in params.items():
            setattr(self, name, value)
        return self

    def clone(self):
        return type(self)(**self.get_params())

    def _fitted(self):
        if not hasattr(self, "model_"):
            raise ValueError("fit this model before it predicts")
        return self.model_

    def fit(self, x: DataFrame, y: DataFrame, terms: list[str], targets: list | None = None, studies: DataFrame | None = None):
        """terms: the columns of x; targets: those of y (by default all that occur, in order); studies: by default those of x and y."""
        if targets is None:
            targets = [r[0] for r in y.select("target").distinct().orderBy("target").collect()]
        if studies is None:
            studies = x.select("study_id").union(y.select("study_id")).distinct()
        self.model_ = self._fit(x, y, studies, list(terms), list(targets))
        return self

    def predict(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return self._fitted().predict(x, key=key)

    def z_maps(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return self._fitted().z_maps(x, key=key)

    def score(self, x: DataFrame, y: DataFrame) -> float:
        """The share of the variance of y that is predicted, averaged over the targets."""
        both = y.join(self.predict(x, "study_id").withColumnRenamed("value", "guess"), ["study_id", "target"])
        per = both.groupBy("target").agg((1 - F.sum((F.col("value") - F.col("guess")) ** 2) / F.nullif(F.var_pop("value") * F.count("*"), F.lit(0.0))).alias("r2"))
        return per.agg(F.avg("r2")).first()[0]


@dataclasses.dataclass
class RidgeEstimator(Estimator):
    """kind: 'plain', 'adaptive' or 'selective'."""

    kind: str = "plain"
    alphas: tuple = ridge.ALPHAS

    def _fit(self, x, y, studies, terms, targets):
        fit = {"plain": ridge.fit, "adaptive": ridge.fit_adaptive, "selective": ridge.fit_selective}[self.kind]
        self.fit_ = fit(ridge.moments(x, y, studies, terms, targets), self.alphas)
        return encoder.LinearModel.of(self.fit_, x.sparkSession)


@dataclasses.dataclass
class SmoothedEstimator(Estimator):
    """The selective regression, applied to vectors smoothed by a nonnegative factor."""

    n_components: int = smoothing.N_COMPONENTS
    weight: float = smoothing.WEIGHT
    alphas: tuple = ridge.ALPHAS
    to_z: bool = True

    def _fit(self, x, y, studies, terms, targets):
        return encoder.SmoothedModel.fit(x, y, studies, terms, targets, self.alphas, self.n_components, self.weight, self.to_z)
