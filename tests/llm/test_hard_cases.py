"""Results don't depend on partitions, batches or the order of rows; long and odd inputs take linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_components, brute_cover, documents, prose
from test_pipeline import plain_passages

from textmap.llm import licenses, near_dedup, suffix_dedup, url_filter, warc
from textmap.llm.shared import Tables


def seconds(f, *args):
    start = time.perf_counter()
    f(*args)
    return time.perf_counter() - start


@pytest.fixture
def conf(spark):
    """Sets session settings for one test."""
    was = {}

    def set_(key, value):
        was.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_
    for key, value in was.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


# 4 repeated passages


@pytest.mark.parametrize("partitions, batch", [(1, 10000), (32, 10), (7, 10000)])
def test_passages_for_any_partitions_and_batches(spark, conf, partitions, batch):
    rng = random.Random(11)
    passage, rare = prose(rng, 60), [prose(rng, 55) for _ in range(12)]
    texts = [(i, f"{prose(rng, 40)} {passage} {rare[i % 12] if i < 40 else ''} {prose(rng, 20)}") for i in range(120)]
    conf("spark.sql.shuffle.partitions", str(partitions))
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    docs = documents(spark, texts).repartition(partitions)
    spans = suffix_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, j) for r in spans for j in range(r.start_word, r.end_word)} == brute_cover(texts)
    left = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs).collect()}
    assert left == {d["doc_id"]: d["text"] for d in plain_passages([{"doc_id": i, "text": t} for i, t in texts])}


@pytest.mark.parametrize("order", [1, -1])
def test_ids_with_several_texts(spark, order):
    rng = random.Random(12)
    long, other = prose(rng, 70), prose(rng, 70)
    texts = [(1, None), (1, long), (2, long), (3, other), (3, other), (4, prose(rng, 60)), (4, prose(rng, 60)), (5, None), (5, None)][::order]
    spans = suffix_dedup.repeated_passages(documents(spark, texts)).collect()
    found = {r.doc_id for r in spans}
    assert found in ({1, 2}, set())  # which of the texts of id 1 stands for it is a matter of hashes alone
    rows = suffix_dedup.cut_repeats(documents(spark, texts)).collect()
    assert len(rows) == len(texts) and sorted(r.text or "" for r in rows if r.doc_id in (3, 4, 5)) == sorted(t or "" for i, t in texts if i in (3, 4, 5))
    taken = {r.text for r in rows if r.doc_id == 1}
    assert taken == {None, long}


# 9 near duplicates


def test_family_whose_members_share_edits(spark):
    """Edits come from a small set, so many pairs share some that the centre lacks; links are those of brute force."""
    rng = random.Random(13)
    base = prose(rng, 90).split()
    edits = [(k, f"e{k}") for k in rng.sample(range(90), 25)]
    texts = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for k, new in rng.sample(edits, rng.randrange(1, 9)):
            w[k] = new
        texts.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_components(documents(spark, texts)).collect()}
    assert got == brute_components(texts, 85)


def test_components_by_rounds_are_those_of_one_task(spark, monkeypatch):
    rng = random.Random(16)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long")
    one = sorted(map(tuple, near_dedup.components(df, Tables(spark)).collect()))
    monkeypatch.setattr(near_dedup, "LINKS_IN_ONE_TASK", 0)
    assert sorted(map(tuple, near_dedup.components(df, Tables(spark)).collect())) == one and (1040, 1000) in one


@pytest.mark.parametrize("order", [1, -1])
def test_rows_of_one_id_with_different_texts(spark, order):
    rng = random.Random(14)
    a, b, c = (prose(rng, 40) for _ in range(3))
    texts = [(1, a), (5, a), (5, b), (6, b), (7, c), (7, c), (8, None)][::order]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.link_components(documents(spark, texts)).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (6, 5, False), (7, 7, True), (7, 7, True), (8, 8, True)]
    kept = near_dedup.keep_one_of_each(documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 5, 5, 7, 7, 8]


# 2, 5, 8: long inputs and odd ones


def test_urls_survive_the_archive(spark):
    urls = ["http://a/100%", "http://a/%41 b", "é\t%", None, ""]
    df = spark.createDataFrame([(i, u, "x" * (2000 if i < 2 else 3)) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert {r.page_id: r.url for r in warc.read_records(warc.write_archives(df, Tables(spark))).collect()} == dict(enumerate(urls))


def test_very_long_payload(spark):
    df = spark.createDataFrame([(1, "u", "ab" * 3_000_000), (2, "v", "ab" * 3_000_000)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_records(warc.write_archives(df, Tables(spark))).collect()}
    assert got == {1: (6_000_000, "revisit", 2), 2: (6_000_000, "response", None)}


def test_long_hosts(spark):
    host = "a." * 100_000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, f"http://{host}./es/"), (3, "http://org/"), (4, "http://..org/")], "page_id long, url string")
    took = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df, url_filter.rule_table(spark)).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "allow"), 3: ("org/", "allow"), 4: ("org/", "allow")}
    assert time.perf_counter() - took < 30


def test_licenses_take_linear_time():
    licenses.scanned(b"mit license " * 100)
    short, long = (min(seconds(licenses.scanned, b"mit license " * n) for _ in range(2)) for n in (10_000, 80_000))
    assert long < 24 * short  # eight times the text
    n, *_, spans = licenses.scanned(b"mit license " * 10_000)
    assert n == 20_000 and spans[-1][1:3] == (19_998, 20_000)


def test_license_suppression_is_that_of_the_rule():
    """Kept are those that lie in none of a higher priority, or of the same and longer (or equal and earlier) that is kept."""
    rng = random.Random(15)
    words = "gnu lesser general public license version 3 mit apache software bsd 2 clause cc by nc 4 0 creative commons attribution under the spdx identifier".split()
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))).encode()
        found = [(m.start(), m.end(), p, label, c) for p, label, _, regex, c in licenses.SIGNATURES for m in regex.finditer(text)]
        kept = []
        for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.detections(text) == sorted(kept)


def test_odd_rows_through_every_scan(spark):
    docs = documents(spark, ODD + ODD, extra=True)
    assert near_dedup.link_components(docs).count() == suffix_dedup.cut_repeats(docs).count() == licenses.license_scan(docs).count() == 2 * len(ODD)
    assert docs.select(F.lit(1)).count() == 2 * len(ODD)


@pytest.mark.parametrize("percent", [80, 85])
def test_edits_of_one_text_bring_few_pairs(spark, monkeypatch, percent):
    """Copies with a few edits each of one text: links are those of brute force, and pairs that share only edits don't meet by the square."""
    rng, texts = random.Random(12), []
    for i in range(160):
        own = [f"w{k}" for k in range(150)]
        for at in rng.sample(range(150), rng.randrange(4, 8)):
            own[at] = f"e{at % 5}"
        texts.append((i, " ".join(own)))
    asked, keep = [], Tables.keep
    monkeypatch.setattr(Tables, "keep", lambda self, df, name="t": asked.append((name, keep(self, df, name))) or asked[-1][1])
    monkeypatch.setattr(Tables, "only", lambda self, *used: None)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.link_components(documents(spark, texts), percent=percent).collect()}
    assert got == brute_components(texts, percent)
    assert [name for name, _ in asked].count("asked") and sum(df.count() for name, df in asked if name == "asked") < len(texts) * (len(texts) - 1) // 8  # a quarter of all pairs


def test_differing_shingles_are_counted_without_a_join(spark):
    """Each text's rarest differences in one order for all, at 85 of 100; those of one text only have no row but keep their place."""
    apart = {1: [100, 101, 102, 103, 7, 8], 2: [100, 101, 102, 103, 9], 3: [100, 101, 11], 4: [100, 12]}
    rows = [(0, i, i, True, 20, 20, 3, x) for i, x in apart.items()]
    found = near_dedup._rarest(spark.createDataFrame(rows, "centre long, id long, comp long, out boolean, n long, c int, a int, apart array<long>"), 0.85)
    assert {(r["id"], r["g"], r["rest"]) for r in found.collect()} == {(1, 102, 4), (1, 101, 2), (2, 102, 4), (2, 101, 2), (3, 101, 2)}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
