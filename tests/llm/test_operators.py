"""Each training-data operator against brute force on small tables, and its defined cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmap.llm import chat, decontaminate, html_text, licenses, mixing, near_dedup, quality, suffix_dedup, url_filter, warc
from textmap.llm.shared import Tables, word_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, extra=False):
    rows = [(i, t, ("en", "de", None)[(i or 0) % 3], f"s{(i or 0) % 2}", len(t) if t is not None else None) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"id": F.lit("x"), "n": F.lit(1), "q": F.lit(0), "run": F.lit(None).cast("int"), "key": F.lit(2)}) if extra else df


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "one"), (None, "two words here"), (105, "é ß x " * 30)]


# Words


def test_word_codes_depend_on_words_alone():
    texts = ["a bb  ccc\n", "", "ccc a", "x" * 70000 + " bb", " "]
    codes, bounds = word_codes([t.encode() for t in texts])
    words = [w for t in texts for w in WORD.findall(t)]
    assert np.diff(bounds).tolist() == [3, 0, 2, 2, 0]
    by = collections.defaultdict(set)
    for w, c in zip(words, codes.tolist()):
        by[w].add(c)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# 1 chat


def test_rotation_renders_each_perspective(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello\nthere"), (1, 3, "ann", None), (1, 5000, "bob", "bye"), (None, 1, None, "x"), (2, None, "ann", "first"), (2, 1, "cy", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    got = {(r.conv_id, r.perspective): r for r in chat.rendered(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, ""), (2, "ann"), (2, "cy")}
    ann = got[1, "ann"]
    assert ann.text == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nhello\nthere<|end|>\n<|assistant|>\n<|end|>\n<|user name=bob|>\nbye<|end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi<|end|>", "<|end|>"]
    assert got[2, "cy"].text.startswith("<|user name=ann|>\nfirst")
    assert chat.rotated(df.limit(0)).count() == 0


# 2 WARC


def test_warc_round_trip(spark):
    big = "<p>" + "ab c" * 400
    rows = [(1, "http://a/x y", big), (7, "http://b", big), (3, None, big), (4, "http://c", "small"), (5, "http://d", "small"), (6, "u", None), (None, "n", big), (8, "é", "ü" * 600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    index = warc.write_archives(df, Tables(spark))
    assert index.count() == len(rows) and index.agg(F.sum("length")).first()[0] > 0
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    for page, _, html in rows:
        payload = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = html == big and page != 7
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 7) if revisit else ("response", None))
    some = warc.read_records(index.filter("page_id = 8")).collect()
    assert [r.payload_bytes for r in some] == [1200]
    assert warc.read_records(warc.write_archives(df.limit(0), Tables(spark))).count() == 0


def test_ranges_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.MAX_GAP + 1, 5), ("b", 0, warc.MAX_READ * 2), ("b", warc.MAX_READ * 2, 1)]
    assert [x[:2] for x in warc.coalesced(rows)] == [(0, 2), (2, 3), (3, 4), (4, 5)]


# 3 quality


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(1)
    texts = ODD + [(1, "a b c d e f g h i " * 9), (2, "x| y& é\n" * 40), (3, "a\nb\na\n \n \nb")]
    good = [(i, prose(rng, 60)) for i in range(200, 1100)]
    bad = [(i, "### ".join(prose(rng, 60).split())) for i in range(2000, 2060)]
    docs = documents(spark, texts + good + bad, extra=True).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (3, None)], "doc_id long, quality int").withColumn("lang", F.lit("zz"))
    rows = quality.judged(docs, labels).select("doc_id", "text", "q.*", "q_kept").collect()
    assert len(rows) == len(texts) + len(good) + len(bad)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(r.q_kept for r in rows if 200 <= (r.doc_id or 0) < 2000) and not any(r.q_kept for r in rows if (r.doc_id or 0) >= 2000)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(good)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    few = quality.judged(docs, labels.limit(20)).filter("doc_id >= 2000").select("q_kept").collect()
    assert all(r.q_kept for r in few)  # too few labels for any cutoff


def test_tail_is_the_binomial_tail():
    assert quality._tail(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality._tail(1, 3, 0.5) == pytest.approx(0.5)


# 4 repeated passages


def brute_cover(texts, n=suffix_dedup.MIN_WORDS):
    words = {i: WORD.findall((t or "").lower()) for i, t in texts if i is not None}
    places = collections.defaultdict(list)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            places[tuple(w[k : k + n])].append((i, k))
    return {(i, j) for p in places.values() if len(p) > 1 for i, k in p for j in range(k, k + n)}


def test_passages_match_brute_force(spark):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (50, 51, 60, 75, 140, 49)]
    texts = list(ODD)
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 60))]
        texts.append((i, " ".join(parts)))
    texts += [(70, texts[20][1]), (71, texts[20][1].upper()), (72, ("loop of ten words that comes again and again " * 30))]
    spans = suffix_dedup.repeated_passages(documents(spark, texts, extra=True)).collect()
    got = {(r.doc_id, j) for r in spans for j in range(r.start_word, r.end_word)}
    want = brute_cover(texts)
    assert {d for d, _ in got} == {d for d, _ in want}
    assert got == want


def test_cut_repeats_keeps_first_copies_only(spark):
    rng = random.Random(6)
    passage = prose(rng, 70)
    texts = ODD + [(i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}") for i in range(8)] + [(20, passage)]
    docs = documents(spark, texts, extra=True)
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(texts) and [r.doc_id for r in rows if r.text and passage in r.text] == [0]
    assert {r.doc_id: r.text for r in rows}[20] == "" and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
    assert not brute_cover([(r.doc_id, r.text) for r in rows])
    assert suffix_dedup.cut_repeats(docs.limit(0)).count() == 0


def test_passages_that_end_in_common_text(spark):
    """Pairs that share 55 words, of which the last 40 or 45 are in many other documents too."""
    rng = random.Random(7)
    texts = []
    for common in (40, 45):
        shared = prose(rng, common)
        for k in range(40):
            own = prose(rng, 55 - common)
            texts += [(len(texts) + n, f"{prose(rng, 20)} {own} {shared} {prose(rng, 30)}") for n in range(2)]
    rng.shuffle(texts)
    docs = documents(spark, texts)
    spans = suffix_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, j) for r in spans for j in range(r.start_word, r.end_word)} == brute_cover(texts)
    assert {r.doc_id for r in spans} == {i for i, _ in texts}
    assert not brute_cover([(r.doc_id, r.text) for r in suffix_dedup.cut_repeats(docs).collect()])


# 5 URL filters


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.EXAMPLE.org/es/x", "https://a.example.org/en/12?x#y", "http://org/", "http://x.org", "http://x.com/fr/", "http://x.com/de/a", "http://notexample.org/es/", "http://b.com#/de/", "http://example.org./es/", "http://u:p@h.com:80/de/?q=/fr/", "a\nb://x.com/de/\nz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://x.com/de/"), (1, "")], "page_id long, url string").withColumn("host", F.lit("clash"))

    def brute(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    rows = url_filter.judged(df, url_filter.rule_table(spark)).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        u = urls[r.page_id] if r.page_id is not None else "http://x.com/de/"
        assert (r.host, r.path, r.rule, r.verdict) == brute(u), u
    assert url_filter.judged(df.limit(0), url_filter.rule_table(spark)).count() == 0


# 6 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header><nav><ul><li>one</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
 text&nbsp;here<br>next.<p>Unclosed &eacute; <script>var a = "<p>no</p>";</script>para.<div class="ad">Buy</div><ul><li>point</li><li>other</li></ul></article>
<aside>See also this and that and more of it</aside><section id="comments"><article><p>Nice post, really nice post of yours</p></article></section><footer>Copyright</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\n\nFirst bold text here next.\n\nUnclosed é para.\n\npoint\n\nother"
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "plain words"), (5, "x", "<script>a</script>"), (6, "y", "<p>" + "long words " * 30000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(df).collect()}
    assert got[1] == (want, len(want)) and got[2] == got[3] == got[5] == ("", 0) and got[None][0] == "plain words"
    assert got[6][0] == ("long words " * 30000).strip()
    assert html_text.extracted(df.limit(0)).count() == 0


def test_best_region_is_the_largest_sum():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randrange(-5, 6) for _ in range(rng.randrange(1, 12))]
        a, b = html_text.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


# 7 mixing


def test_raking_meets_targets_within_supply(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(60, 200)), ("en", "en", "en", "de")[i % 4], ("a", "a", "b")[i % 3], 1) for i in range(1200)] + [(5000, None, None, None, None), (None, "x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"supply": F.lit(0), "weight": F.lit(0)})
    out = mixing.calibrated(docs, fraction=0.4)
    table = out.toPandas()
    assert len(table) == len(rows) and table["mix_prob"].between(0, 1).all()
    expected = (table["mix_tokens"] * table["mix_prob"]).groupby(table["lang"]).sum()
    supply = table.groupby("lang")["mix_tokens"].sum()
    ratio = expected["en"] / expected["de"]
    assert ratio == pytest.approx((supply["en"] / supply["de"]) ** 0.5, rel=0.02)
    kept = mixing.sampled(docs, fraction=0.4)
    assert kept.columns == [*docs.columns, "mix_prob"]
    assert kept.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == pytest.approx(0.4 * table["mix_tokens"].sum(), rel=0.1)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in mixing.sampled(docs.repartition(7), fraction=0.4).collect())
    assert mixing.sampled(docs.limit(0)).count() == 0


# 8 licenses


def test_license_scan(spark):
    texts = ODD + [
        (1, "Under the MIT License! under the mit\nlicense; Apache License, Version 2.0"),
        (2, "cc-by-nc 4.0"),
        (3, "SPDX-License-Identifier: LGPL-2.1-or-later"),
        (4, "the GNU Lesser General Public License version 3 and nothing else"),
        (5, "understandably the mit licenses"),
    ]
    rows = {r.doc_id: r for r in licenses.license_scan(documents(spark, texts, extra=True)).collect()}
    for i, t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[3].labels == "lgpl-2.1" and rows[4].labels == "lgpl-3" and rows[5].labels == ""
    assert len(licenses.SIGNATURES) >= 200
    assert licenses.license_scan(documents(spark, ODD).limit(0)).count() == 0


def test_gated_signatures_lose_nothing():
    samples = ["released under the terms of the boost software license version 1 0", "creative commons zero v1 0 universal", "do what the fuck you want to public license", "cc by sa 3 0", "bsd 3 clause license", "all rights reserved", "gnu affero general public license v3"]
    for text in samples:
        plain = {label for _, label, _, regex, _ in licenses.SIGNATURES if regex.search(text.encode())}
        gated = {label for _, label, word, regex, _ in licenses.SIGNATURES if word in text.encode() and regex.search(text.encode())}
        assert plain == gated and licenses.detections(text.encode())


# 9 near duplicates


def brute_components(texts, percent):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    a, b = sorted((top(x), top(y)))
                    low[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(spark, percent):
    rng = random.Random(percent)
    base = [prose(rng, n) for n in (5, 12, 40, 120, 120)]
    texts = [(i, t) for i, t in ODD if i is not None]
    for i in range(90):  # one large family, of every degree of change
        w = base[3].split()
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(3000)}"
        texts.append((i, " ".join(w)))
    for i in range(200, 240):
        w = base[rng.choice((0, 1, 2, 4))].split()
        del w[rng.randrange(len(w)) :: 97]
        texts.append((i, " ".join(w).upper() if i % 2 else " ".join(w)))
    docs = documents(spark, texts + [(None, base[2])], extra=True)
    rows = near_dedup.link_components(docs, percent=percent).collect()
    assert len(rows) == len(texts) + 1
    want = brute_components(texts, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    kept = near_dedup.keep_one_of_each(docs, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i} | {None}
    if percent == 80:
        assert near_dedup.link_components(docs.limit(0)).count() == 0


def test_estimate_is_close(spark):
    a, b = (near_dedup.shingle_sets([" ".join(f"w{k}" for k in range(lo, lo + 2000)).encode()])[0] for lo in (0, 300))
    regs = near_dedup.registers([a, b]).view(np.int64)
    df = spark.createDataFrame([(regs[0].tolist(), regs[1].tolist(), len(a), len(b))], "x array<long>, y array<long>, n long, m long")
    got = df.select(near_dedup.estimate("x", "y", "n", "m")[0].alias("j")).first().j
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert got == pytest.approx(true, abs=0.15)


# 10 decontamination


def brute_leaks(texts, items):
    """Best run of every diagonal, without seeds."""
    block = decontaminate.Block([i for i, _ in items], [t.encode() for _, t in items])
    out = set()
    for d, t in texts:
        codes, _ = decontaminate.tokens([(t or "").encode()])
        for k in range(len(items)):
            item = block.codes[block.bounds[k] : block.bounds[k + 1]]
            for shift in range(-len(item) + 1, len(codes)):
                ats = [p for p in range(max(0, shift), min(len(codes), shift + len(item))) if codes[p] == item[p - shift]]
                if len(ats) >= 5 and any((i, a, b, e) for i, a, b, e in decontaminate.overlaps(codes, block, [(p, k, p - shift) for p in ats])):
                    out.add((d, items[k][0]))
    return out


def test_leaks_match_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((6, 8, 20, 40, 60))] + [(9, ""), (10, "a b")]
    texts = list(ODD)
    for i in range(40):
        w = items[rng.randrange(5)][1].split()
        if i % 3 == 1 and len(w) > 13:
            for k in range(4, len(w), 9):
                w[k] = "other"
        if i % 3 == 2:
            w = w[: len(w) // 3]
        texts.append((i, f"{prose(rng, 40)}. {', '.join(w).upper()}! {prose(rng, 20)}"))
    bench = spark.createDataFrame([*items, (11, None), (None, items[3][1])], "item_id long, text string").withColumn("id", F.lit(3))
    docs = documents(spark, texts, extra=True)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_spans(docs, bench).collect() if r.item_id is not None}
    assert got == brute_leaks(texts, items)
    left = decontaminate.without_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {d for d, _ in got}
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).count() == 0 and decontaminate.without_contaminated(docs.limit(0), bench).count() == 0


def test_substitutions_at_any_place_are_found(spark):
    """Against every window of every diagonal, which is judged by the rule alone."""
    rng = random.Random(21)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 20, 25, 40)]
    texts = []
    for _ in range(30):
        for n, t in items:
            w = t.split()
            for k in rng.sample(range(n), rng.choice((n // 5, n // 5 + 1))):
                w[k] = "other"
            texts.append((len(texts), " ".join(["before"] * rng.randrange(4) + w + ["after"] * rng.randrange(4))))
    want = set()
    for d, t in texts:
        own = t.split()
        for n, item in items:
            it, least = item.split(), min(n, 13)
            for shift in range(-n + 1, len(own)):
                equal = [own[p] == it[p - shift] for p in range(max(0, shift), min(len(own), shift + n))]
                if any(5 * sum(equal[a:b]) >= 4 * (b - a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1)):
                    want.add((d, n))
    rows = decontaminate.contaminated_spans(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > len(texts) / 2
    assert all(5 * r.n_equal >= 4 * (r.end_token - r.start_token) and r.end_token - r.start_token >= min(13, r.item_tokens) for r in rows)
