"""Vocabularies and vectors that aren't shuffled number by number."""

import collections

import pytest
from pyspark.sql import functions as F

from textmap.operators import ranking, text, vectors


@pytest.mark.parametrize("n_hashes", [1, 7, 1 << 16])
def test_vocabulary_by_hashes_is_exact(spark, n_hashes):
    """Few hashes have many terms each, so those beyond the first are counted too; ties go to the smaller term."""
    texts = [" ".join(f"w{(i * j) % (5 + j)}x" for j in range(1, 3 + i % 40)) for i in range(300)] + [None, "", "solo", "été été œuvre"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    words, pairs = collections.Counter(), collections.Counter()
    for x in texts:
        t = (x or "").split()
        words.update(set(t))
        pairs.update({f"{a} {b}" for a, b in zip(t, t[1:])})
    best = lambda c, n: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:n]
    got = text.derived_vocabulary(docs, 12, 9, n_hashes=n_hashes).collect()
    assert [(r["term"], r["df"]) for r in got] == best(words, 12) + best(pairs, 9)
    assert got[0]["frequency"] == got[0]["df"] / len(texts)
    assert text.derived_vocabulary(docs.limit(0), 12, 9).count() == 0


@pytest.mark.parametrize("norm", ["l1", "l2", None])
def test_gathered_vectors_equal_long_ones(spark, norm):
    rows = [(1, "alpha beta beta gamma"), (2, "beta"), (2, "alpha beta delta"), (3, None), (4, "nothing here"), (None, "alpha gamma gamma")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    v = vectors.Vectorizer.from_vocabulary(["alpha", "beta", "alpha beta", "gamma"], [0.5, 0.25, 0.125, 0.75], norm=norm)
    names = v.vocabulary()
    got = {(r["doc_id"], names[a]): x for r in v.gathered(docs).collect() for a, x in zip(r["term"], r["value"])}
    want = {(r["doc_id"], r["term"]): r["value"] for r in v.transform(docs.fillna(-1, ["doc_id"])).collect()}
    assert got == pytest.approx({(None if d == -1 else d, t): x for (d, t), x in want.items()})
    no = vectors.Vectorizer.from_vocabulary(["alpha"], [0.0])
    with pytest.raises(Exception, match="no positive frequency: alpha"):
        no.gathered(docs).collect()


def test_a_document_without_an_id_is_found(spark):
    """A null id is an id as any other (its vector got lost where norms were joined by it), and vectors meet in one shuffle, of a row per text."""
    docs = spark.createDataFrame([(20, "alpha beta"), (None, "alpha")], "doc_id long, text string")
    v = vectors.Vectorizer.from_vocabulary(["alpha", "beta"], [0.5, 0.5])
    corpus = v.gathered(docs)
    best = ranking.similar_documents(corpus.filter("doc_id = 20").withColumnRenamed("doc_id", "query_id"), corpus, digits=6)
    assert [(r["doc_id"], r["similarity"]) for r in best.orderBy(F.desc("similarity")).collect()] == [(20, 1.0), (None, 0.707107)]
    assert corpus._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
