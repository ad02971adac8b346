"""Tokens, phrases, vocabularies, highlights: literal cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textmap.functions import porter, render
from textmap.functions import tokens as T
from textmap.operators import text, vectors
from textmap.sources import vocabulary


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def phrases(pipeline, spark, value):
    return [r.phrase for r in pipeline.extract(texts(spark, value)).orderBy("pos").collect()]


def test_tokens_and_spans(spark):
    import regex

    values = ["The mαchine-learning. algo 123xb;a\nbc", None, "", "x " * 700 + "\U0001f600 end", "a" * 5000]
    rows = texts(spark, *values).select("text", T.tokenize(F.col("text")).alias("t"), T.token_spans(F.col("text")).alias("s")).collect()
    assert rows[0].t == ["The", "mαchine", "learning", "algo", "123xb", "bc"]
    for r in rows:
        want = [(m.group(), *m.span()) for m in regex.finditer(T.WORD_PATTERN, r.text or "")]
        assert [tuple(x) for x in r.s] == want and r.t == [w for w, _, _ in want]
    with pytest.raises(ValueError):
        T.check_pattern("a*")


def test_standard_forms():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 153
    assert T.standard_words(["Running", "Flies"], "porter_stemmer") == ["run", "fli"]
    with pytest.raises(ValueError):
        T.standardize(F.lit(None), "other")
    with pytest.raises(ImportError):
        T.standardize(F.lit(None), "wordnet_lemmatizer")
    with pytest.raises(ImportError):
        T.stop_word_list("sklearn")
    assert T.stop_word_list(["b", "a", "b"]) == ["a", "b"]


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("probate", "probat"), ("controll", "control"), ("yourselves", "yourselv")],
)
def test_porter(word, want):
    assert porter.stem(word) == want


def test_standardize_text(spark):
    value = "One a the Word abcd-eft: --\nhello\t 1240"
    out = texts(spark, value, None).select(T.standardize_text(F.col("text")).alias("s")).collect()
    assert [r.s for r in out] == ["one word abcd eft hello 1240", ""]
    stemmed = texts(spark, "The Flies running").select(T.standardize_text(F.col("text"), stemming="porter_stemmer").alias("s")).first().s
    assert stemmed == "fli run"


@pytest.mark.parametrize(
    "policy, want",
    [("ignore", ["machine learning", "algorithm"]), ("keep", ["new", "machine learning", "algorithm"]), ("[]", ["[new]", "machine learning", "algorithm"]), ("{}", ["{new}", "machine learning", "algorithm"]), ("oov", ["oov", "machine learning", "algorithm"])],
)
def test_out_of_vocabulary(spark, policy, want):
    p = text.pipeline_from_vocabulary(["machine", "machine learning", "algorithm"], out_of_voc=policy)
    assert phrases(p, spark, "the new machine learning algorithm") == want


def test_longest_match_equals_a_trie_walk():
    rng = random.Random(0)

    def walk(tokens, voc):
        out, at = [], 0
        while at < len(tokens):
            best = max((n for n in range(1, len(tokens) - at + 1) if " ".join(tokens[at : at + n]) in voc), default=0)
            out.append((at, best or 1, bool(best)))
            at += best or 1
        return out

    for _ in range(500):
        voc = frozenset(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(5))
        tokens = [rng.choice("abc") for _ in range(rng.randrange(12))]
        find = text._phrase_finder(text.Pipeline(phrases=voc, out_of_voc="keep"))
        assert [(a, n, k) for a, n, _, k in find(tokens)] == walk(tokens, voc)


def test_pipeline_with_synonyms_and_malformed_vocabulary(spark):
    p = text.pipeline_from_vocabulary(["working memory", "group", "groups"], [0.1, 0.2, 0.3], voc_mapping={"groups": "group"})
    assert phrases(p, spark, "the working memory group xyzzzz groups") == ["working memory", "group", "group"]
    assert p.vocabulary() == ["group", "working memory"] and p.full_vocabulary() == ["group", "groups", "working memory"]
    assert p.frequencies() == pytest.approx({"group": 0.5, "working memory": 0.1})
    odd = text.pipeline_from_vocabulary(["", "big ben", "London", ",+", "a ; M", "one ... three", ". of"], range(7))
    assert odd.vocabulary() == ["big ben", "london", "one three"] and [odd.frequencies()[t] for t in odd.vocabulary()] == [1, 2, 5]
    with pytest.warns(UserWarning):
        text.pipeline_from_vocabulary(["a"], voc_mapping="auto")


def test_highlights(spark):
    p = text.pipeline_from_vocabulary(["one", "twenty three"])
    docs = texts(spark, "The One twenty plus TWENTY-three <numbers>", ".+ --", None)
    spans = render.with_spans(docs, p.extract_spans(docs), attributes=F.create_map(F.lit("in_model"), F.lit("true")))
    t, s = F.col("text"), F.col("spans")
    rows = spans.orderBy("doc_id").select(render.highlight_xml(t, s).alias("xml"), render.highlight_terminal(t, s).alias("term"), render.highlight_terminal(t, s, True).alias("rep"), render.highlight_html(t, s).alias("html"), render.highlight_html(t, s, True).alias("page")).collect()
    xml = 'The <extracted_phrase standardized_form="one" in_model="true">One</extracted_phrase> twenty plus <extracted_phrase standardized_form="twenty three" in_model="true">TWENTY-three</extracted_phrase> &lt;numbers&gt;'
    assert rows[0].xml == f"<highlighted_text>{xml}</highlighted_text>" and rows[1].xml == "<highlighted_text>.+ --</highlighted_text>"
    assert rows[0].term == "The \033[94m[One]\033[0m twenty plus \033[94m[TWENTY-three]\033[0m <numbers>" == render.printable(rows[0].xml)
    assert rows[0].rep == "The \033[92m[one]\033[0m twenty plus \033[92m[twenty three]\033[0m <numbers>" == render.printable(rows[0].xml, True)
    assert rows[0].html == render.html_of(rows[0].xml) and '<span style="background-color: LightBlue;">One</span>' in rows[0].html
    assert rows[0].page == render.html_of(rows[0].xml, True) and rows[2].xml == "<highlighted_text></highlighted_text>"


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text("working memory,0.5\nnan,0.25\nnull,0.125\n,0.1\nGroups,0.2\n")
    (tmp_path / "w.csv").write_text("one\ntwo words\n")
    (tmp_path / "v.txt").write_text("One\n..\nbig ben\n")
    rows = vocabulary.read_vocabulary(spark, str(tmp_path / "v.csv")).orderBy("line").collect()
    assert [(r.term, r.frequency) for r in rows] == [("working memory", 0.5), ("nan", 0.25), ("null", 0.125), ("Groups", 0.2)]
    assert [(r.term, r.frequency) for r in vocabulary.read_vocabulary(spark, str(tmp_path / "w.csv")).orderBy("line").collect()] == [("one", 1.0), ("two words", 1.0)]
    assert [r.term for r in vocabulary.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("line").collect()] == ["One", "big ben"]
    with pytest.warns(UserWarning):
        assert vocabulary.read_mapping(spark, str(tmp_path / "v.csv")) == {}
    p = text.pipeline_from_vocabulary(["working memory", "group", "groups"], [0.1, 0.2, 0.3], voc_mapping={"groups": "group"})
    vocabulary.write_pipeline(spark, p, str(tmp_path / "out.csv"))
    assert json.loads((tmp_path / "out.csv_voc_mapping_identity.json").read_text()) == {"groups": "group"}
    assert vocabulary.pipeline_from_file(str(tmp_path / "out.csv"), "auto", spark=spark) == p
    vocabulary.write_vocabulary(vocabulary.read_vocabulary(spark, str(tmp_path / "v.csv")), str(tmp_path / "again"))
    assert spark.read.csv(str(tmp_path / "again")).count() == 4


def test_codecs():
    assert T.phrases_to_strings([("a", "b"), "c d"]) == ["a b", "c d"]
    assert T.strings_to_phrases(["a b", ("c",)]) == [("a", "b"), ("c",)]


def test_unigrams_and_tfidf(spark):
    voc = spark.createDataFrame([("brain",), ("memory",), ("working memory",)], "term string")
    op = {(r.term, r.unigram): r.weight for r in vectors.unigram_operator(voc).collect()}
    assert op == {("brain", "brain"): 1, ("memory", "memory"): 1, ("working memory", "working memory"): 1, ("working memory", "memory"): 1}
    counts = spark.createDataFrame([(1, t, 1.0) for t in ("brain", "memory", "working memory")], "doc_id long, term string, value double")
    assert {r.term: r.value for r in vectors.add_unigrams(counts, vectors.unigram_operator(voc)).collect()} == {"brain": 1, "memory": 2, "working memory": 1}
    v = vectors.Vectorizer.from_vocabulary(["action", "ab"], [0.2, 0.5])
    got = {r.term: r.value for r in v.transform(texts(spark, "ab and action")).collect()}
    import math

    a, b = 1 - math.log(0.5), 1 - math.log(0.2)
    assert got == pytest.approx({"ab": a / math.hypot(a, b), "action": b / math.hypot(a, b)})
    l1 = vectors.Vectorizer.from_vocabulary(["action", "ab"], [0.2, 0.5], use_idf=False, norm="l1")
    assert {r.term: r.value for r in l1.transform(texts(spark, "ab and action", None, "nothing")).collect()} == {"ab": 0.5, "action": 0.5}
    own = vectors.Vectorizer.from_vocabulary(["z >", "one two"], token_pattern=r"\S+", stop_words=[], use_idf=False, norm=None, add_unigrams=False)
    assert {r.term: r.value for r in own.transform(texts(spark, "z > one two one two z")).collect()} == {"z >": 1.0, "one two": 2.0}


def test_standardizing_inverse(spark):
    terms = spark.createDataFrame([("Runs", 3.0), ("runs", 5.0), ("RUNS", 5.0)], "term string, frequency double")
    assert text.standardizing_inverse(terms, F.lower("term")).first().original_phrase == "RUNS"
