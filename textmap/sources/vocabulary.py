"""Vocabulary, synonym and stop-word files.

A vocabulary is a CSV without header (term, frequency; or terms alone), or, under
any other name than .csv, a text of one term per line. Its synonyms are a JSON
object beside it. Words such as "nan" and "null" are words.
"""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmap.functions import tokens as T
from textmap.operators.text import Pipeline, pipeline_from_vocabulary


def read_vocabulary(spark: SparkSession, path: str, token_pattern: str = T.WORD_PATTERN) -> DataFrame:
    """term (its tokens joined by spaces, case kept), frequency; in the file's order by `line`. Terms without tokens go."""
    if path.endswith(".csv"):
        raw = spark.read.option("quote", '"').option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
        freq = F.col("_c1").cast("double") if len(raw.columns) > 1 else F.lit(1.0)
        raw = raw.select(F.coalesce("_c0", F.lit("")).alias("raw"), freq.alias("frequency"))
    else:
        raw = spark.read.text(path).select(F.col("value").alias("raw"), F.lit(1.0).alias("frequency"))
    rows = raw.withColumn("line", F.monotonically_increasing_id()).withColumn("tokens", T.tokenize(F.col("raw"), token_pattern))
    return rows.filter(F.size("tokens") > 0).select("line", T.join_phrase(F.col("tokens")).alias("term"), "frequency")


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """A CSV folder of (term, frequency), without header."""
    terms.select("term", "frequency").write.mode("error").option("header", False).option("emptyValue", "").csv(path)


def mapping_path(vocabulary_path: str, stemming: str = "identity") -> str:
    return f"{vocabulary_path}_voc_mapping_{stemming}.json"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_mapping(spark: SparkSession, vocabulary_path: str, stemming: str = "identity") -> dict[str, str]:
    """Synonyms of a vocabulary; none, with a warning, if it has no such file."""
    path = mapping_path(vocabulary_path, stemming)
    fs, at = _hadoop(spark, path)
    if not fs.exists(at):
        warnings.warn(f"no synonyms at {path}; none are used")
        return {}
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def write_mapping(spark: SparkSession, vocabulary_path: str, mapping, stemming: str = "identity") -> str:
    path = mapping_path(vocabulary_path, stemming)
    fs, at = _hadoop(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(json.dumps({T.phrase_to_string(a): T.phrase_to_string(b) for a, b in dict(mapping).items()}).encode()))
    out.close()
    return path


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word per line; empty lines go."""
    return sorted({r[0].strip() for r in spark.read.text(path).collect()} - {""})


def pipeline_from_file(path: str, voc_mapping=None, stemming="identity", token_pattern=T.WORD_PATTERN, spark: SparkSession | None = None, **settings) -> Pipeline:
    """A pipeline of a vocabulary file; voc_mapping="auto" reads the synonyms beside it."""
    spark = spark or SparkSession.getActiveSession()
    rows = read_vocabulary(spark, path, token_pattern).orderBy("line").collect()
    mapping = read_mapping(spark, path, stemming) if voc_mapping == "auto" else voc_mapping
    return pipeline_from_vocabulary([r["term"] for r in rows], [r["frequency"] for r in rows], voc_mapping=mapping or {}, stemming=stemming, token_pattern=token_pattern, **settings)


def write_pipeline(spark: SparkSession, pipeline: Pipeline, path: str) -> None:
    """The raw vocabulary with its frequencies as one CSV file, and the synonyms beside it."""
    import csv
    import io

    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows((t, repr(float(f))) for t, f in pipeline.raw_vocabulary)
    fs, at = _hadoop(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.getvalue().encode()))
    out.close()
    write_mapping(spark, path, dict(pipeline.mapping), pipeline.stemming)
