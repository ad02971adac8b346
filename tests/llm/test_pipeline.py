"""The corpus pipeline against a plain-Python one that shares nothing with the operators but their stated constants."""

import collections
import hashlib
import math
import random
import re

import pytest
from test_mixing import plain_raking
from test_operators import DOCS, brute_components, brute_counts, prose

from textmap.llm import decontaminate, mixing, quality, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


# Plain stages: lists of dicts to lists of dicts


def rates(text):
    n, chars, symbols, dups, repeats = brute_counts(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    share = lambda a, b: a / b if b else 0.0
    own = {"symbols": share(symbols, chars), "repeats": share(repeats, n), "dup_lines": share(dups, lines), "shouts": share((text or "").count("!"), n), "capitals": share(len(re.findall("[A-Z]", text or "")), chars)}
    return n < 20 or 100 * repeats > 30 * n, own


def plain_quality(docs, labels):
    measured = [(d, d["lang"] or "", *rates(d["text"])) for d in docs]
    rejects = lambda own, step: any(own[r] > quality.GRIDS[r][step] for r in own)
    strata = collections.defaultdict(list)
    for d, stratum, base, own in measured:
        if not base and d["doc_id"] in labels:
            strata[stratum].append((labels[d["doc_id"]], own))
    chosen = {}
    for stratum, rows in strata.items():
        n, best = sum(q for q, _ in rows), (0, None)
        for step in range(quality.STEPS - 1, -1, -1):
            k = sum(rejects(own, step) for q, own in rows if q)
            p = quality.MAX_FALSE_REJECTION
            tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            if not n or tail > (1 - quality.CONFIDENCE) / len(strata):
                break
            caught = sum(rejects(own, step) for q, own in rows if not q)
            if caught > best[0]:
                best = (caught, step)
        chosen[stratum] = best[1]
    return [d for d, stratum, base, own in measured if not base and (chosen.get(stratum) is None or not rejects(own, chosen[stratum]))]


def plain_near_dedup(docs):
    comps = brute_components([(d["doc_id"], d["text"]) for d in docs], 80)
    return [d for d in docs if comps[d["doc_id"]][1] == d["doc_id"]]


def plain_passages(docs):
    n, places, cut = suffix_dedup.MIN_WORDS, {}, collections.defaultdict(set)
    words = {d["doc_id"]: WORD.findall(lower(d["text"])) for d in docs}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - n + 1):
            window = tuple(w[k : k + n])
            if window in places:
                cut[i].update(range(k, k + n))
            places.setdefault(window, (i, k))
    out = []
    for d in docs:
        spans = [(m.start(), m.end()) for m in WORD.finditer(d["text"])]
        text, last = "", 0
        for j, (a, _) in enumerate(spans):
            if j in cut[d["doc_id"]]:
                text += d["text"][last:a]
                last = spans[j + 1][0] if j + 1 < len(spans) else len(d["text"])
        text += d["text"][last:]
        out.append(d | {"text": text, "n_chars": len(text)})
    return out


def overlaps(text, item):
    least = min(decontaminate.MIN_OVERLAP, len(item))
    if len(item) < decontaminate.MIN_ITEM:
        return False
    for shift in range(-len(item) + 1, len(text)):
        equal = [text[shift + k] == item[k] if 0 <= shift + k < len(text) else None for k in range(len(item))]
        equal = [e for e in equal if e is not None]
        for a in range(len(equal) - least + 1):
            for b in range(a + least, min(len(equal), a + 2 * least) + 1):
                if sum(equal[a:b]) >= decontaminate.MIN_EQUAL * (b - a):
                    return True
    return False


def plain_decontamination(docs, benchmark):
    items = [TOKEN.findall(lower(t)) for t in benchmark]
    return [d for d in docs if not any(overlaps(TOKEN.findall(lower(d["text"])), i) for i in items)]


def topic(text, n):
    count = lambda chars: sum(text.count(c) for c in chars)
    return "short" if n < 50 else "table" if 5 * count("|") > n else "symbols" if 5 * count("#*$%&") > n else "shout" if 5 * count("!") > n else "prose"


def plain_mixing(docs):
    cells, keys = collections.Counter(), []
    for d in docs:
        n = len(WORD.findall(d["text"]))
        keys.append((d["source"] or "", d["lang"] or "", topic(d["text"], n)))
        cells[keys[-1]] += n
    cells = {k: s for k, s in cells.items() if s}
    _, weights = plain_raking(cells, mixing.FRACTION, mixing.TEMPERATURE, rounds=2000)
    out = {}
    for d, key in zip(docs, keys):
        number = int(hashlib.md5(f"{mixing.SEED}:{d['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[d["doc_id"]] = (d["text"], weights[key] / cells[key] if key in cells else 0.0, number)
    return out


def tables(spark, folder, docs, labels, benchmark):
    rows = [tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    passage, benchmark = prose(rng, 60), [prose(rng, n) for n in (18, 30, 8)]
    texts = [prose(rng, rng.randrange(25, 60)) for _ in range(260)]
    texts += [texts[k] for k in (3, 3, 5)] + [texts[k].replace("w1", "v1", 1) for k in range(10, 16)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 25)}" for _ in range(8)]
    for k in range(6):
        words = benchmark[k % 3].split()
        words[1 if k < 3 else -1] = "other"
        texts.append(f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 20)}")
    bad = ["### ".join(prose(rng, 40).split()) for _ in range(12)] + ["a b c d e f g h i " * 9, "", None, "few words", "| ".join(prose(rng, 60).split())]
    texts += bad
    docs = [{"doc_id": i, "text": t, "lang": "en" if i % 9 else None, "source": f"s{i % 3}", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    labels = {i: int(texts[i] not in bad) for i in range(len(texts)) if i < 240 or texts[i] in bad[:12]}
    tables(spark, str(tmp_path), docs, labels, benchmark)

    want, sizes = docs, [len(docs)]
    for stage in (lambda d: plain_quality(d, labels), plain_near_dedup, plain_passages, lambda d: plain_decontamination(d, benchmark)):
        want = stage(want)
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] and sum(d["n_chars"] for d in want) < sum(len(texts[d["doc_id"]]) for d in want)
    want = plain_mixing(want)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.text, r.mix_prob) for r in rows}
    assert len(got) == len(rows) and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "mix_prob"}
    for i, (text, prob) in got.items():
        assert text == want[i][0] and prob == pytest.approx(want[i][1], rel=2e-3) and want[i][2] < prob
    assert all(number >= prob * 0.998 for i, (_, prob, number) in want.items() if i not in got)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    tables(spark, str(tmp_path), [], {}, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[-1] == "mix_prob"
