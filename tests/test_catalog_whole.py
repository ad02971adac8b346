"""Queries that must take in every row, on small tables where each row shows."""

import duckdb
import numpy as np
import pytest

from textmap.plans import catalog

STUDIES = 45


def plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        frame[c] = frame[c].round(5) + 0.0 if frame[c].dtype.kind == "f" else frame[c].astype(str)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Studies 0 to 44 and one null, four points each; documents of the same ids; customers 0 to 29."""
    folder = str(tmp_path_factory.mktemp("small"))
    words = "amber birch cedar delta ember flint grove heron inlet jetty".split()
    events = [(n, None if n % (STUDIES + 1) == STUDIES else n % (STUDIES + 1)) for n in range(4 * (STUDIES + 1))]
    documents = [(n, " ".join(words[(n * k + k) % 10] for k in range(1, 4 + n % 5)), n) for n in range(STUDIES)]
    tables = {
        "events": spark.createDataFrame(events, "event_id long, user_id long"),
        "documents": spark.createDataFrame(documents, "doc_id long, text string, n_chars long"),
        "customer": spark.createDataFrame([(n,) for n in range(30)], "c_custkey long"),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["smoothed_maps", "reverse_terms_topk", "reverse_studies_topk", "corpus_alignment"])
def test_maps_of_all_studies(spark, small, name):
    folder, con = small
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert plain(got) == plain(want)
    ids = {"reverse_terms_topk": "term"}.get(name, "study_id")
    assert got[ids].nunique() > 10


def test_all_documents_are_smoothed(spark, small):
    folder, con = small
    got, want = catalog.QUERIES["smooth_vectors"](spark, folder).toPandas(), con.execute(catalog.ORACLES["smooth_vectors"]).df()
    assert plain(got) == plain(want) and got["doc_id"].nunique() == STUDIES


def test_all_studies_are_unmasked(spark, small):
    folder, con = small
    got, want = catalog.QUERIES["unmask_project"](spark, folder).toPandas(), con.execute(catalog.ORACLES["unmask_project"]).df()
    assert plain(got) == plain(want) and got["study_id"].nunique() > 40


def test_codecs_of_all_tokens(spark, small):
    folder, con = small
    got, want = catalog.QUERIES["phrase_codecs"](spark, folder).toPandas(), con.execute(catalog.ORACLES["phrase_codecs"]).df()
    assert plain(got) == plain(want) and (got["head"].str.count("[|]") >= 2).all()


def test_the_tolerance_ends_the_factorisation(spark, monkeypatch):
    x = spark.createDataFrame([(0, "f00", -1.0)], "study_id long, term string, value double")
    monkeypatch.setattr(catalog, "_xy", lambda spark, sf_dir: (x, None, None))
    asked = {}
    monkeypatch.setattr(catalog.smoothing, "factor", lambda vectors, terms, **settings: asked.update(settings) or np.ones((len(terms), 1)))
    catalog.nmf_factor(spark, "")
    assert asked.get("max_rounds", catalog.smoothing.MAX_ROUNDS) == catalog.smoothing.MAX_ROUNDS
