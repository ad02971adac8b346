"""The registered queries against their SQL on the smallest tables, and streams against batches."""

import os

import pytest
from pyspark.sql import functions as F

from textmap.operators import text
from textmap.plans import catalog, model_catalog  # noqa: F401  the second adds queries to the first's
from textmap.streaming import encode

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: One of each kind; the others differ in a parameter.
CHOSEN = ("token_positions", "oov_bracket", "phrase_spans", "highlight_xml", "synonym_mapped_counts", "tfidf_l2", "similar_documents_topk", "related_terms", "smoothed_maps", "reverse_studies_topk", "ridge_one_feature", "z_maps_of_rows", "events_windowed", "phrase_longest_match", "selective_ridge", "encode_volumes", "explain_highlights", "saved_encoder", "vocabulary_files")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        frame[c] = frame[c].round(5) + 0.0 if frame[c].dtype.kind == "f" else frame[c].astype(str)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (2, "three one")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    p = text.pipeline_from_vocabulary(["one", "three"])
    stream = encode.phrase_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), p)
    q = stream.writeStream.format("memory").queryName("phrases_of_stream").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.doc_id, r.pos, r.phrase) for r in df.collect())
    assert key(spark.table("phrases_of_stream")) == key(p.extract(docs))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.event_type, r.n, r.total) for r in encode.windowed_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
