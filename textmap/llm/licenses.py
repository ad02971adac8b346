"""License scans by ordered signature rules.

A text becomes its words (runs of letters, digits and non-ASCII characters, ASCII
lower-cased) joined by single spaces; signatures are regexes over that form, so
punctuation and line breaks don't matter. They are tried in order of priority;
a signature runs only if its keyword occurs in the text. Detections are then
suppressed: one whose words lie inside those of a kept detection of a higher
priority, or of the same priority and more words, is dropped (so 'the gnu lesser
general public license version 3' doesn't also report a bare 'license').

The base phrases (see BASE) are detections of their own that no rule suppresses.

Defined cases: a null or empty text has no words, no labels and score 0;
null ids keep their rows; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import table, text_batches, with_columns_renamed_apart

# Phrases and labels that every scan reports.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_KEEP = bytearray(b" " * 256)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_c] = _c
for _c in range(65, 91):
    _KEEP[_c] = _c + 32
_KEEP = bytes(_KEEP)

#: (label, names as they read in prose, identifiers as they read in tags); digits in names may be followed by '0' as in 'version 2 0'.
FAMILIES = (
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd"),
    ("academic-free", r"academic free licen[sc]e(?: (?:version|v) ?[123](?: \d)?)?", r"afl(?: [123] \d)?"),
    ("agpl-1", r"affero general public licen[sc]e(?: version)? (?:v ?)?1(?: 0)?", r"agpl 1 0(?: only| or later)?"),
    ("agpl-3", r"(?:gnu )?affero general public licen[sc]e(?: version)?(?: v)? ?3(?: 0)?", r"agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("apache-1", r"apache (?:software )?licen[sc]e(?: version)? 1 [01]", r"apache 1 [01]"),
    ("apache-2", r"apache (?:software )?licen[sc]e(?: version)?(?: v)? ?2(?: 0)?", r"apache 2 0"),
    ("apple-source", r"apple public source licen[sc]e", r"apsl [12] \d"),
    ("artistic-1", r"(?:the )?artistic licen[sc]e(?: version)? 1(?: 0)?", r"artistic 1 0(?: perl| cl8)?"),
    ("artistic-2", r"(?:the )?artistic licen[sc]e(?: version)? 2(?: 0)?", r"artistic 2 0"),
    ("beerware", r"(?:the )?beer ?ware licen[sc]e", "beerware"),
    ("bsd-2", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", "bsd 2 clause(?: patent| views)?"),
    ("bsd-3", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", "bsd 3 clause(?: clear| lbnl)?"),
    ("bsd-4", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[sc]e)?", "bsd 4 clause(?: uc)?"),
    ("bsl-1", r"boost software licen[sc]e(?: version)?(?: 1(?: 0)?)?", "bsl 1 0"),
    ("busl", r"business source licen[sc]e(?: 1 1)?", "busl 1 1"),
    ("bzip2", r"bzip2 licen[sc]e", r"bzip2 1 0 [56]"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cddl-1", r"common development and distribution licen[sc]e(?: version)?(?: 1 [01])?", r"cddl 1 [01]"),
    ("cecill", r"cecill(?: [bc])?(?: free software)? licen[sc]e(?: agreement)?", r"cecill(?: [bc]| [12] \d)"),
    ("cpl-1", r"common public licen[sc]e(?: version)?(?: 1(?: 0)?)?", "cpl 1 0"),
    ("ecl-2", r"educational community licen[sc]e(?: version)?(?: [12](?: 0)?)?", r"ecl [12] 0"),
    ("efl-2", r"eiffel forum licen[sc]e", r"efl [12] 0"),
    ("epl-1", r"eclipse public licen[sc]e(?: version)?(?: v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2", r"eclipse public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?", "epl 2 0"),
    ("eupl", r"european union public licen[sc]e(?: version)?(?: 1 [012])?", r"eupl 1 [012]"),
    ("fdl-1", r"(?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("gpl-1", r"(?:gnu )?general public licen[sc]e(?: version)?(?: v)? ?1(?: 0)?", r"gpl ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2", r"(?:gnu )?general public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?", r"gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", r"(?:gnu )?general public licen[sc]e(?: version)?(?: v)? ?3(?: 0)?", r"gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("hpnd", r"historical permission notice and disclaimer", "hpnd"),
    ("icu", r"icu licen[sc]e", "icu"),
    ("ijg", r"independent jpeg group(?: licen[sc]e)?", "ijg"),
    ("intel-oss", r"intel open source licen[sc]e", "intel"),
    ("ipl-1", r"ibm public licen[sc]e(?: version)?(?: 1(?: 0)?)?", "ipl 1 0"),
    ("isc", r"(?:the )?isc licen[sc]e", "isc"),
    ("lgpl-2", r"(?:gnu )?library general public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?", r"lgpl ?v?2 0(?: only| or later)?"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[sc]e(?: version)?(?: v)? ?2 1", r"lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-3", r"(?:gnu )?lesser general public licen[sc]e(?: version)?(?: v)? ?3(?: 0)?", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("libpng", r"libpng licen[sc]e", r"libpng(?: 2 0)?"),
    ("lppl", r"latex project public licen[sc]e", r"lppl 1 [0-3][ac]?"),
    ("mit", r"(?:the )?(?:mit|expat) licen[sc]e", "mit"),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("mpl-1", r"mozilla public licen[sc]e(?: version)?(?: v)? ?1(?: [01])?", r"mpl 1 [01]"),
    ("mpl-2", r"mozilla public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?", r"mpl 2 0"),
    ("ms-pl", r"microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("mulan", r"mulan (?:permissive software|psl)(?: licen[sc]e)?", r"mulanpsl [12] 0"),
    ("nasa-1", r"nasa open source agreement", "nasa 1 3"),
    ("ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[sc]e", "ncsa"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("odc-by", r"open data commons attribution licen[sc]e", "odc by 1 0"),
    ("ofl-1", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 [01])?", r"ofl 1 [01]"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("osl-3", r"open software licen[sc]e(?: version)?(?: [123] \d)?", r"osl [123] \d"),
    ("pddl", r"open data commons public domain dedication", "pddl 1 0"),
    ("php-3", r"php licen[sc]e(?: version)?(?: 3(?: 0?1)?)?", r"php 3 0 ?1?"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("psf-2", r"python (?:software foundation )?licen[sc]e(?: version)?(?: 2(?: 0)?)?", r"(?:psf|python) 2 0"),
    ("qpl-1", r"q public licen[sc]e", "qpl 1 0"),
    ("rpl-1.5", r"reciprocal public licen[sc]e", r"rpl 1 [15]"),
    ("ruby", r"ruby licen[sc]e", "ruby"),
    ("sspl", r"server side public licen[sc]e", "sspl 1 0"),
    ("unicode", r"unicode (?:data files and software )?licen[sc]e", r"unicode (?:dfs 201[56]|3 0|tou)"),
    ("unlicense", r"(?:the )?unlicen[sc]e", "unlicense"),
    ("upl-1", r"universal permissive licen[sc]e", "upl 1 0"),
    ("vim", r"vim licen[sc]e", "vim"),
    ("w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", r"w3c(?: 19980720| 20150513)?"),
    ("wtfpl", r"do what the f ?u ?c ?k you want to public licen[sc]e", "wtfpl"),
    ("x11", r"x11 licen[sc]e", "x11"),
    ("zlib", r"zlib (?:libpng )?licen[sc]e", r"zlib(?: acknowledgement)?"),
    ("zpl-2", r"zope public licen[sc]e(?: version)?(?: 2(?: [01])?)?", r"zpl [12] [01]"),
)
_CC = (("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("by-nc", "attribution non ?commercial"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
#: Sentences of license texts, and general notices: (label, keyword, pattern, priority).
SENTENCES = (
    ("mit", b"hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("mit", b"substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 1),
    ("isc", b"with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 1),
    ("bsd-3", b"endorse or promote", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", 1),
    ("bsd-4", b"advertising materials", r"all advertising materials mentioning features or use of this software must display", 1),
    ("bsd-2", b"source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted", 2),
    ("apache-2", b"apache org", r"(?:http www )?apache org licenses license 2 0", 1),
    ("gpl", b"free software foundation", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation", 2),
    ("gpl", b"general public", r"gnu general public licen[sc]e", 4),
    ("lgpl", b"lesser general public", r"gnu lesser general public licen[sc]e", 4),
    ("agpl", b"affero", r"affero general public licen[sc]e", 4),
    ("unlicense", b"public domain", r"this is free and unencumbered software released into the public domain", 1),
    ("public-domain", b"public domain", r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain", 3),
    ("zlib", b"as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 1),
    ("bsl-1", b"boost", r"distributed under the boost software licen[sc]e", 2),
    ("cc", b"creative commons", r"(?:licen[sc]ed under a |a )?creative commons (?:public )?licen[sc]e", 4),
    ("cc0", b"creative commons zero", r"creative commons zero(?: v?1 0)?(?: universal)?", 3),
    ("proprietary", b"proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 3),
    ("all-rights-reserved", b"all rights reserved", r"all rights reserved", 5),
    ("bsd", b"bsd", r"bsd (?:style )?licen[sc]e", 4),
    ("apache", b"apache", r"apache (?:software )?licen[sc]e", 4),
    ("mpl", b"mozilla", r"mozilla public licen[sc]e", 4),
    ("artistic", b"artistic", r"artistic licen[sc]e", 4),
)


def _signatures() -> list[tuple[int, str, bytes, re.Pattern, float]]:
    """(priority, label, keyword, regex, confidence) in the order of trial: 1 texts, 2 tags, 3 notices, 4 names, 5 hints."""
    out = [(p, label, word, text, {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.6, 5: 0.3}[p]) for label, word, text, p in SENTENCES]
    for label, name, tag in FAMILIES:
        word = max(re.findall(r"[a-z0-9]+", re.sub(r"\(\?:.*?\)\??|\[.*?\]\??|\\.", " ", name)) or [tag.split()[0]], key=lambda w: (w not in ("public", "licen", "license"), len(w))).encode()
        if label in ("0bsd", "bsd-2", "bsd-3", "bsd-4"):
            word = b"bsd"
        elif label in ("mit", "gpl-1", "gpl-2", "gpl-3"):
            word = b"licen" if label == "mit" else b"general public"
        out.append((2, label, b"spdx", rf"spdx license identifier {tag}", 1.0))
        out.append((3, label, word, rf"(?:licen[sc]ed|released|distributed|available|provided|published|covered) (?:only )?(?:under|by|with) (?:the terms of )?(?:the |a |an )?{name}", 0.9))
        out.append((4, label, word, name, 0.7))
    for kind, words in _CC:
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((2, f"cc-{kind}-{version.replace(' ', '.')}", b"cc by", rf"cc {kind.replace('-', ' ')} {version}", 0.95))
            out.append((3, f"cc-{kind}-{version.replace(' ', '.')}", b"creative commons", rf"creative commons {words} {version}", 0.9))
        out.append((3, f"cc-{kind}", b"creativecommons", rf"creativecommons org licenses {kind.replace('-', ' ')}(?: \d \d)?", 0.9))
        out.append((4, f"cc-{kind}", b"cc by", rf"cc {kind.replace('-', ' ')}", 0.7))
        out.append((4, f"cc-{kind}", b"attribution", rf"creative commons {words}", 0.7))
    order = sorted(range(len(out)), key=lambda i: (out[i][0], i))
    return [(out[i][0], out[i][1], out[i][2], re.compile(rb"(?<![^ ])" + out[i][3].encode() + rb"(?![^ ])"), out[i][4]) for i in order]


SIGNATURES = _signatures()
_BASE = [(re.compile(rb"(?<![^ ])(?=" + p.encode() + rb"(?![^ ]))"), label) for p, label in BASE]
#: A text without any of these has no detection at all, whatever the signatures.
_GATE = sorted({w for _, _, w, _, _ in SIGNATURES} | {b"under the mit license", b"apache license version 2", b"cc by nc"})
_GATE = [w for w in _GATE if not any(o != w and o in w for o in _GATE)]


def detections(text: bytes) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, confidence) over a text of words joined by single spaces, after suppression."""
    found = []
    for priority, label, word, regex, confidence in SIGNATURES:
        if word in text:
            found += [(m.start(), m.end(), priority, label, confidence) for m in regex.finditer(text)]
    starts = sorted({d[0] for d in found})
    rank = {x: k for k, x in enumerate(starts, 1)}
    reach = [0] * (len(starts) + 1)  # a tree of the largest kept end among starts up to a rank
    kept: list[tuple[int, int, int, str, float]] = []
    for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[3])):
        k, end = rank[d[0]], 0
        while k:
            end = max(end, reach[k])
            k &= k - 1
        if end < d[1]:
            kept.append(d)
            k = rank[d[0]]
            while k <= len(starts):
                reach[k] = max(reach[k], d[1])
                k += k & -k
    return sorted(kept)


def scanned(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one text."""
    words = text.translate(_KEEP).split()
    n = len(words)
    if not n:
        return 0, 0, None, None, "", "", 0.0, []
    clean = b" ".join(words)
    if not any(w in clean for w in _GATE):
        return n, 0, None, None, "", "", 0.0, []
    places, base = [], set()
    for regex, label in _BASE:
        at = [m.start() for m in regex.finditer(clean)]
        places += at
        if at:
            base.add(label)
    found = detections(clean)
    gaps = np.flatnonzero(np.frombuffer(clean, np.uint8) == 32)
    word_at = lambda x: int(np.searchsorted(gaps, x))
    score = max([d[4] for d in found] + [0.9] * bool(base), default=0.0)
    labels = sorted(base | {d[3] for d in found})
    spans = [(d[3], word_at(d[0]), word_at(d[1]) + 1, d[4]) for d in found]
    return (n, len(places), word_at(min(places)) if places else None, word_at(max(places)) if places else None, ",".join(sorted(base)), ",".join(labels), score, spans)


_COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _scan(stream):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    spans_kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("confidence", pa.float64())]))
    for batch in stream:
        for a, b, texts in text_batches(batch.column(1)):
            rows = [scanned(t) for t in texts]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            spans = pa.array([[dict(zip(("label", "start_word", "end_word", "confidence"), s)) for s in r[7]] for r in rows], spans_kind)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns, spans], names=["doc_id", *_COLUMNS, "spans"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word counts, base places, labels, score and the kept detections in word positions (spans)."""
    rows = with_columns_renamed_apart(docs, {id_col: "id", text_col: "text"}).select(F.col("id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(_scan, kinds + ", spans array<struct<label: string, start_word: long, end_word: long, confidence: double>>")


def op8_signature_rules(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
