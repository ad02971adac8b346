"""Streams of texts through the stateless operators, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.operators.text import Pipeline


def phrase_stream(texts: DataFrame, pipeline: Pipeline, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases of each arriving text. Stateless: the plan is that of a batch."""
    return pipeline.extract(texts, id_col, text_col)


def scored_stream(texts: DataFrame, pipeline: Pipeline, coef: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, target, part: each phrase's share of each target, by a join with static coefficients (term, target, value)."""
    phrases = pipeline.extract(texts, id_col, text_col)
    return phrases.join(coef, phrases.phrase == coef.term).select("doc_id", "term", "target", F.col("value").alias("part"))


def windowed_counts(events: DataFrame, time_col: str = "ts", key_col: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are dropped once their window is closed."""
    rows = events.withWatermark(time_col, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time_col, window).alias("w"), key_col).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), key_col, "n", "total")
