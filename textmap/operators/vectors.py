"""Term counts, unigrams, IDF and norms in long form: (doc_id, term, value). Zeros are absent rows."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.functions import tokens as T
from textmap.operators.text import Pipeline, counts_of_tokens, pipeline_from_vocabulary


def term_counts(phrases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, term, value: how often each vocabulary term occurs among a text's phrases."""
    counts = phrases.groupBy("doc_id", F.col("phrase").alias("term")).agg(F.count("*").cast("double").alias("value"))
    return counts.join(vocabulary.select("term"), "term", "left_semi").select("doc_id", "term", "value")


def unigram_operator(vocabulary: DataFrame) -> DataFrame:
    """term, unigram, weight: each term itself once, and for terms of several words each occurrence of a word that is a term."""
    terms = vocabulary.select("term")
    own = terms.select("term", F.col("term").alias("unigram"))
    words = terms.filter(F.col("term").contains(" ")).select("term", F.explode(F.split("term", " ")).alias("unigram"))
    words = words.join(terms.select(F.col("term").alias("unigram")), "unigram", "left_semi").select("term", "unigram")
    return own.union(words).groupBy("term", "unigram").agg(F.count("*").cast("double").alias("weight"))


def add_unigrams(counts: DataFrame, operator: DataFrame) -> DataFrame:
    """Counts times the operator."""
    moved = counts.join(operator, "term").select("doc_id", F.col("unigram").alias("term"), (F.col("value") * F.col("weight")).alias("value"))
    return moved.groupBy("doc_id", "term").agg(F.sum("value").alias("value"))


def idf_weighted(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """value * (1 - ln frequency). Frequencies come from the vocabulary, never from the texts; they must be positive."""
    freq = vocabulary.select("term", "frequency")
    idf = F.when(F.col("frequency") > 0, 1 - F.log("frequency")).otherwise(F.raise_error(F.concat(F.lit("no positive frequency: "), "term")).cast("double"))
    return counts.join(freq, "term").select("doc_id", "term", (F.col("value") * idf).alias("value"))


def normalized(vectors: DataFrame, norm: str | None = "l2", key: str = "doc_id") -> DataFrame:
    """Rows of unit norm; a vector of zeros stays one.

    Norms are summed with map-side combine and joined back, so no vector has to meet in one task.
    """
    if norm is None:
        return vectors
    if norm not in ("l1", "l2"):
        raise ValueError(f"unknown norm {norm!r}")
    size = F.sum(F.abs("value")) if norm == "l1" else F.sqrt(F.sum(F.col("value") * F.col("value")))
    sizes = vectors.groupBy(F.col(key).alias("norm_key")).agg(size.alias("norm"))
    joined = vectors.join(sizes, F.col(key) == F.col("norm_key"))
    return joined.withColumn("value", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.col("value"))).select(*vectors.columns)


def document_frequencies(vectors: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, n_documents: vectors with a positive value; 0 for terms that none has."""
    df = vectors.filter("value > 0").groupBy("term").agg(F.count("*").alias("n_documents"))
    return vocabulary.select("term").join(df, "term", "left").select("term", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def feature_norms(coef: DataFrame) -> DataFrame:
    """term, norm: the L2 norm of each term's coefficients. coef: term, target, value."""
    return coef.groupBy("term").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


def _summed(row: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the same row and place added up, in order."""
    keys, where = np.unique(row * width + at, return_inverse=True)
    return keys // width, keys % width, np.bincount(where, value, len(keys))


def _weigher(v: Vectorizer):
    """array<struct<at, n>> of counts -> array<struct<at, value>>: what `weighted` makes of them."""
    terms, freq = v.vocabulary(), v.pipeline.frequencies() if v.use_idf else {}
    number, width = {t: i for i, t in enumerate(terms)}, max(len(terms), 1)
    parts = [[i, *[number[w] for w in t.split(" ") if " " in t and w in number]] if v.add_unigrams else [i] for i, t in enumerate(terms)]
    sizes, to = np.array([len(x) for x in parts], np.int64), np.array([i for x in parts for i in x], np.int64)
    starts = np.cumsum(sizes) - sizes
    idf = np.array([1 - np.log(freq[t]) if freq[t] > 0 else np.nan for t in terms]) if v.use_idf else None
    if v.norm not in (None, "l1", "l2"):
        raise ValueError(f"unknown norm {v.norm!r}")

    @F.arrow_udf("array<struct<at:int,value:double>>")
    def weigh(counts: pa.Array) -> pa.Array:
        counts = counts.combine_chunks() if isinstance(counts, pa.ChunkedArray) else counts
        row = np.repeat(np.arange(len(counts)), pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False))
        own = counts.flatten()
        at, value = own.field("at").to_numpy().astype(np.int64), own.field("n").to_numpy()
        n = sizes[at]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, at, value = _summed(np.repeat(row, n), to[np.repeat(starts[at], n) + nth], np.repeat(value, n), width)
        if idf is not None:
            value = value * idf[at]
            if np.isnan(value).any():
                raise ValueError(f"no positive frequency: {terms[at[np.isnan(value)][0]]}")
        if v.norm:
            norm = np.bincount(row, np.abs(value) if v.norm == "l1" else value * value, len(counts))
            norm = norm if v.norm == "l1" else np.sqrt(norm)
            value = value / np.where(norm > 0, norm, 1.0)[row]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(value)], ["at", "value"]))

    return weigh


@dataclasses.dataclass(frozen=True)
class Vectorizer:
    """Counts, then unigrams, then IDF, then the norm: the order matters."""

    pipeline: Pipeline
    use_idf: bool = True
    norm: str | None = "l2"
    add_unigrams: bool = True

    @classmethod
    def from_vocabulary(cls, vocabulary, frequencies=None, use_idf=True, norm="l2", add_unigrams=True, **settings) -> Vectorizer:
        return cls(pipeline_from_vocabulary(vocabulary, frequencies, **settings), use_idf, norm, add_unigrams)

    @classmethod
    def from_vocabulary_file(cls, path: str, voc_mapping="auto", use_idf=True, norm="l2", add_unigrams=True, **settings) -> Vectorizer:
        from textmap.sources.vocabulary import pipeline_from_file

        return cls(pipeline_from_file(path, voc_mapping=voc_mapping, **settings), use_idf, norm, add_unigrams)

    def vocabulary(self) -> list[str]:
        return self.pipeline.vocabulary()

    feature_names = vocabulary

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, term, value of each text."""
        voc = self.pipeline.vocabulary_table(docs.sparkSession)
        return self.weighted(term_counts(self.pipeline.extract(docs, id_col, text_col), voc), voc)

    def gathered(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, term, value: the vector of each id as one row, with arrays of terms (by number in the vocabulary) and values.

        Only counts are shuffled, one row per text; ids without terms have no row.
        """
        tokens = T.standardize(T.tokenize(F.col(text_col), self.pipeline.token_pattern), self.pipeline.stemming)
        counts = docs.select(F.col(id_col).alias("doc_id"), counts_of_tokens(self.pipeline)(tokens).alias("x")).filter(F.size("x") > 0)
        counts = counts.groupBy("doc_id").agg(F.flatten(F.collect_list("x")).alias("x"))
        return counts.select("doc_id", _weigher(self)("x").alias("x")).select("doc_id", F.col("x.at").alias("term"), F.col("x.value").alias("value"))

    def weighted(self, counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
        if self.add_unigrams:
            counts = add_unigrams(counts, unigram_operator(vocabulary))
        if self.use_idf:
            counts = idf_weighted(counts, vocabulary)
        return normalized(counts, self.norm)
