"""Texts to maps: the composed model, its answers, and its folder of tables."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import render
from textmap.operators import ranking, ridge, smoothing, space, vectors
from textmap.operators.text import Pipeline


@dataclasses.dataclass
class LinearModel:
    """Frozen coefficients as tables: coef (term, target, value), targets (target, intercept, residual_var), filter_gram (term_i, term_j, value) or None."""

    coef: DataFrame
    targets: DataFrame
    filter_gram: DataFrame | None = None
    selected: DataFrame | None = None

    @classmethod
    def of(cls, fitted: ridge.Ridge, spark: SparkSession) -> LinearModel:
        selected = spark.createDataFrame([(t,) for t in fitted.terms], "term string")
        return cls(fitted.coef_table(spark), fitted.target_table(spark), fitted.gram_table(spark), selected)

    def predict(self, x: DataFrame, intercept: bool = True, key: str = "doc_id") -> DataFrame:
        return ridge.predicted(x, self.coef, self.targets if intercept else None, key)

    def prediction_variance(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return ridge.prediction_variance(x, self.filter_gram, self.targets, key)

    def z_maps(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return ridge.z_maps_of(x, self.coef, self.filter_gram, self.targets, key)

    def selected_terms(self) -> DataFrame:
        return self.selected if self.selected is not None else self.coef.select("term").distinct()

    def save(self, path: str, mode: str = "error") -> None:
        for name in ("coef", "targets", "filter_gram", "selected"):
            table = getattr(self, name)
            if table is not None:
                table.write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        return cls(*[_table(spark, f"{path}/{name}") for name in ("coef", "targets", "filter_gram", "selected")])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def import_arrays(spark: SparkSession, terms: list[str], targets: list, coef: np.ndarray, intercept, M=None, residual_var=None, selected_features=None) -> LinearModel:
    """A model from arrays as other tools keep them: coef is targets x selected terms, M selected terms x rows."""
    own = terms if selected_features is None else [terms[i] for i in np.asarray(selected_features)]
    fitted = ridge.Ridge(own, list(targets), np.asarray(coef, float).T, np.broadcast_to(np.asarray(intercept, float), (len(targets),)), None if M is None else np.asarray(M) @ np.asarray(M).T, None if residual_var is None else np.asarray(residual_var, float), all_terms=list(terms))
    return LinearModel.of(fitted, spark)


def load_arrays(spark: SparkSession, folder: str, terms: list[str], targets: list) -> LinearModel:
    """A model from a folder of .npy files: coef and intercept, and of M, residual_var and selected_features what is there."""
    import io

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content").collect()
    found = {r["path"].rsplit("/", 1)[-1].removesuffix(".npy"): np.load(io.BytesIO(bytes(r["content"]))) for r in files}
    own = {k: found[k] for k in ("coef", "intercept", "M", "residual_var", "selected_features") if k in found}
    return import_arrays(spark, terms, targets, **own)


@dataclasses.dataclass
class SmoothedModel:
    """Smoothing (factor v: term, component, value) and regression; smoothing is applied to what is predicted from, not to what was fitted."""

    v: DataFrame
    weight: float
    regression: LinearModel
    to_z: bool = True

    @classmethod
    def fit(cls, x: DataFrame, y: DataFrame, studies: DataFrame, terms: list[str], targets: list, alphas=ridge.ALPHAS, n_components=smoothing.N_COMPONENTS, weight=smoothing.WEIGHT, to_z=True, **nmf) -> SmoothedModel:
        spark = x.sparkSession
        v = smoothing.factor_table(spark, smoothing.factor(x.withColumnRenamed("study_id", "doc_id"), terms, n_components, **nmf), terms)
        fitted = ridge.fit_selective(ridge.moments(x, y, studies, terms, targets), alphas)
        return cls(v, weight, LinearModel.of(fitted, spark), to_z)

    def smooth(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return smoothing.smoothed(x, self.v, self.weight, key)

    def predict(self, x: DataFrame, intercept: bool = True, key: str = "doc_id") -> DataFrame:
        return self.regression.predict(self.smooth(x, key), intercept, key)

    def z_maps(self, x: DataFrame, key: str = "doc_id") -> DataFrame:
        return self.regression.z_maps(self.smooth(x, key), key)

    def maps(self, x: DataFrame, intercept: bool = True, key: str = "doc_id") -> DataFrame:
        """z-maps if asked for and the model can estimate variances, else predictions."""
        return self.z_maps(x, key) if self.to_z and self.regression.filter_gram is not None else self.predict(x, intercept, key)

    def save(self, path: str, mode: str = "error") -> None:
        self.v.write.mode(mode).parquet(f"{path}/smoothing/v")
        self.v.sparkSession.createDataFrame([(float(self.weight), bool(self.to_z))], "weight double, to_z boolean").coalesce(1).write.mode(mode).parquet(f"{path}/smoothing/settings")
        self.regression.save(f"{path}/regression", mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SmoothedModel:
        weight, to_z = spark.read.parquet(f"{path}/smoothing/settings").first()
        return cls(spark.read.parquet(f"{path}/smoothing/v"), weight, LinearModel.load(spark, f"{path}/regression"), to_z)


def unmasked_maps(maps: DataFrame, mask: DataFrame | None) -> DataFrame:
    if mask is None:
        raise ValueError("this model has no mask to put its maps on")
    own = maps.select(F.col("query_id").alias("study_id"), F.col("target").alias("voxel_id"), "value")
    return space.unmasked(own, mask, own.select("study_id")).withColumnRenamed("study_id", "query_id")


@dataclasses.dataclass
class Encoder:
    """Texts to maps, related terms, similar documents and highlighted text. corpus: doc_id, term, value; metadata: doc_id and anything."""

    vectorizer: vectors.Vectorizer
    model: SmoothedModel
    mask: DataFrame | None = None
    corpus: DataFrame | None = None
    metadata: DataFrame | None = None

    def full_vocabulary(self) -> list[str]:
        return self.vectorizer.vocabulary()

    def supervised_vocabulary(self, spark: SparkSession) -> DataFrame:
        return ranking.selected_vocabulary(self.vectorizer.pipeline.vocabulary_table(spark), self.model.regression.selected_terms())

    def document_frequencies(self) -> DataFrame | None:
        if self.corpus is None:
            return None
        return vectors.document_frequencies(self.corpus, self.vectorizer.pipeline.vocabulary_table(self.corpus.sparkSession))

    def transform(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> dict[str, DataFrame]:
        """raw_tfidf, smoothed_tfidf (query_id, term, value) and brain_map (query_id, target, value; intercepts left out)."""
        raw = vectors.normalized(self.vectorizer.transform(queries, id_col, text_col), "l2").withColumnRenamed("doc_id", "query_id")
        smooth = vectors.normalized(self.model.smooth(raw, "query_id"), "l2", "query_id")
        maps = self.model.maps(raw, intercept=False, key="query_id")
        return {"raw_tfidf": raw, "smoothed_tfidf": smooth, "brain_map": maps, "z_map": maps}

    def volume(self, maps: DataFrame) -> DataFrame:
        """query_id, i, j, k, value: maps (query_id, target, value) on the mask's voxels, 0 where a map has none."""
        return unmasked_maps(maps, self.mask)

    def explain(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> dict[str, DataFrame]:
        """transform, and similar_words, similar_documents (None without a corpus), highlighted_text."""
        spark = queries.sparkSession
        out = self.transform(queries, id_col, text_col)
        norms = vectors.feature_norms(self.model.regression.coef)
        words = ranking.related_terms(out["raw_tfidf"], out["smoothed_tfidf"], norms, self.document_frequencies())
        out["similar_words"] = words.orderBy("query_id", F.col("weight_in_brain_map").desc(), "term")
        out["similar_documents"] = None
        if self.corpus is not None:
            best = ranking.similar_documents(out["smoothed_tfidf"], self.corpus)
            out["similar_documents"] = (best if self.metadata is None else best.join(self.metadata, "doc_id")).orderBy("query_id", "rank")
        spans = self.vectorizer.pipeline.extract_spans(queries, id_col, text_col)
        inside = self.supervised_vocabulary(spark).select(F.col("term").alias("phrase"), F.lit(True).alias("inside"))
        spans = spans.join(inside, "phrase", "left")
        flag = F.create_map(F.lit("in_model"), F.when(F.col("inside"), "true").otherwise("false"))
        shown = render.with_spans(queries, spans, id_col, flag)
        out["highlighted_text"] = shown.select(F.col(id_col).alias("query_id"), render.highlight_xml(F.col(text_col), F.col("spans")).alias("highlighted_text"))
        return out

    def save(self, path: str, mode: str = "error") -> None:
        """A folder of tables, with the settings of the vectorizer (also whether unigrams are added)."""
        spark = self.model.v.sparkSession
        save_vectorizer(spark, self.vectorizer, f"{path}/vectorizer", mode)
        self.model.save(path, mode)
        for name in ("mask", "corpus", "metadata"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Encoder:
        corpus, metadata = _table(spark, f"{path}/corpus"), _table(spark, f"{path}/metadata")
        if corpus is None or metadata is None:
            corpus = metadata = None
        return cls(load_vectorizer(spark, f"{path}/vectorizer"), SmoothedModel.load(spark, path), _table(spark, f"{path}/mask"), corpus, metadata)


@dataclasses.dataclass
class SimpleEncoder:
    """TF-IDF and a linear prediction without intercept: no smoothing."""

    vectorizer: vectors.Vectorizer
    regression: LinearModel
    mask: DataFrame | None = None

    def transform(self, queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> dict[str, DataFrame]:
        tfidf = self.vectorizer.transform(queries, id_col, text_col).withColumnRenamed("doc_id", "query_id")
        spans = self.vectorizer.pipeline.spans_in(F.col(text_col))
        text = queries.select(F.col(id_col).alias("query_id"), render.highlight_xml(F.col(text_col), spans).alias("highlighted_text"))
        return {"brain_map": self.regression.predict(tfidf, intercept=False, key="query_id"), "highlighted_text": text}

    def volume(self, maps: DataFrame) -> DataFrame:
        """query_id, i, j, k, value of the maps on the mask's voxels."""
        return unmasked_maps(maps, self.mask)

    def full_vocabulary(self) -> list[str]:
        return self.vectorizer.vocabulary()

    def save(self, path: str, mode: str = "error") -> None:
        save_vectorizer(self.regression.coef.sparkSession, self.vectorizer, f"{path}/vectorizer", mode)
        self.regression.save(f"{path}/regression", mode)
        if self.mask is not None:
            self.mask.write.mode(mode).parquet(f"{path}/mask")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SimpleEncoder:
        return cls(load_vectorizer(spark, f"{path}/vectorizer"), LinearModel.load(spark, f"{path}/regression"), _table(spark, f"{path}/mask"))


def save_vectorizer(spark: SparkSession, vectorizer: vectors.Vectorizer, path: str, mode: str = "error") -> None:
    settings = dataclasses.asdict(vectorizer)
    settings["pipeline"]["phrases"] = sorted(vectorizer.pipeline.phrases)
    spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode(mode).parquet(path)


def load_vectorizer(spark: SparkSession, path: str) -> vectors.Vectorizer:
    settings = json.loads(spark.read.parquet(path).first()[0])
    p = settings.pop("pipeline")
    p["phrases"] = frozenset(p["phrases"])
    p["mapping"] = tuple(tuple(x) for x in p["mapping"])
    p["raw_vocabulary"] = tuple(tuple(x) for x in p["raw_vocabulary"])
    p["stop_words"] = tuple(p["stop_words"])
    return vectors.Vectorizer(Pipeline(**p), **settings)
