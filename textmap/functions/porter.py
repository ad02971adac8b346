"""The Porter stemming algorithm (M. F. Porter, 1980) with the common later exceptions.

Written from the published description: five groups of suffix rules over the
measure m, the number of vowel-consonant sequences of a stem.
"""

from __future__ import annotations

import functools

import pandas as pd

_STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Irregular forms.
_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(stem: str) -> int:
    c = _consonants(stem)
    return sum(not a and b for a, b in zip(c, c[1:]))


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    c = _consonants(word)
    if len(word) == 2:
        return not c[0] and c[1]
    return len(word) > 2 and c[-3] and not c[-2] and c[-1] and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            return w[: len(w) - len(end)] + new
    return w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for end in ("ed", "ing"):
        if w.endswith(end):
            s = w[: -len(end)]
            if not _has_vowel(s):
                return w
            if s.endswith(("at", "bl", "iz")):
                return s + "e"
            if _double(s):
                return s if s[-1] in "lsz" else s[:-1]
            return s + "e" if _measure(s) == 1 and _cvc(s) else s
    return w


def _y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and _consonants(w[:-1])[-1] else w


def _swap(w: str, rules) -> str:
    for end, new in rules:
        if w.endswith(end):
            s = w[: -len(end)]
            return s + new if _measure(s) > 0 else w
    return w


def _step_2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step_2(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _swap(w, sorted(_STEP_2, key=lambda r: -len(r[0])))


def _step_4(w: str) -> str:
    for end in sorted(_STEP_4, key=len, reverse=True):
        if w.endswith(end):
            s = w[: -len(end)]
            return s if _measure(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")) else w
    return w


def _step_5(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = _y(_past(_plural(word)))
    return _step_5(_step_4(_swap(_step_2(w), _STEP_3)))


def stem_udf():
    """array<string> -> array<string>, in Arrow batches."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<string>")
    def stems(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])

    return stems
