"""Tokens, standard forms, stop words and phrase codecs as column expressions.

Null texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two or more letters or digits, or one Roman or decimal digit. A character class, for the
#: alternation inside a repetition overflows the regex engine's stack on long tokens.
WORD_PATTERN = r"(?:[\p{L}\p{N}]{2,}|[IVXivx0-9])"

# The English stop words that vocabularies are built with.
STOP_WORDS = tuple(
    """
a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d
did didn do does doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself
his how i if in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only or other
our ours ourselves out over own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they
this those through to too under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn y you your
yours yourself yourselves
""".split()
)

STEMMERS = ("identity", "porter_stemmer", "wordnet_lemmatizer")


def stop_word_list(stop_words: str | Iterable[str] = "nltk") -> list[str]:
    """The words of a named list, or those given. The list 'sklearn' is that of the scikit-learn package, and needs it."""
    if isinstance(stop_words, str):
        if stop_words == "nltk":
            return sorted(STOP_WORDS)
        if stop_words == "sklearn":
            try:
                from sklearn.feature_extraction.text import ENGLISH_STOP_WORDS
            except ImportError as e:
                raise ImportError("the stop word list 'sklearn' comes with scikit-learn, which isn't installed: pass the words themselves") from e
            return sorted(ENGLISH_STOP_WORDS)
        raise ValueError(f"unknown stop word list {stop_words!r}: pass the words themselves")
    return sorted(set(stop_words))


def check_pattern(pattern: str) -> str:
    """The pattern, unless it matches the empty string (such tokens would stand for nothing)."""
    import regex

    if regex.fullmatch(pattern, "") is not None:
        raise ValueError("a token pattern must not match the empty string")
    return pattern


def tokenize(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """The pattern's matches, in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, though body names it more than once."""
    return F.transform(F.array(value), body)[0]


_CHUNK = 256
_SPANS = "array<struct<token:string,start:int,end:int>>"


def token_spans(text: Column, pattern: str = WORD_PATTERN) -> Column:
    """array<struct<token, start, end>>: matches with code-point offsets, end exclusive.

    Offsets are running sums over the gaps between matches and the matches, taken by
    chunks of tokens and inside each chunk, so long texts take linear time.
    """

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["token"])
        span = F.struct(x["token"].alias("token"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def chunk(rows, c):
        return F.slice(rows, c * _CHUNK + 1, F.lit(_CHUNK))

    def size(rows, c):
        return F.aggregate(chunk(rows, c), F.lit(0), lambda n, x: n + x["gap"] + F.length(x["token"]))

    def spans_of(rows, starts, c):
        zero = F.struct(F.get(starts, c).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(chunk(rows, c), zero, step)["spans"]

    def placed(rows):
        chunks = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _CHUNK).cast("int"))
        sizes = F.transform(chunks, lambda c: size(rows, c))
        starts = let(sizes, lambda s: F.transform(chunks, lambda c: F.aggregate(F.slice(s, F.lit(1), c), F.lit(0), lambda n, x: n + x)))
        return let(starts, lambda at: F.flatten(F.transform(chunks, lambda c: spans_of(rows, at, c))))

    tokens = tokenize(text, pattern)
    gaps = F.split(text, pattern, -1)
    rows = let(tokens, lambda ts: F.zip_with(F.slice(gaps, F.lit(1), F.size(ts)), ts, lambda g, t: F.struct(F.length(g).alias("gap"), t.alias("token"))))
    return F.coalesce(let(rows, lambda r: F.when(F.size(r) > 0, placed(r)).otherwise(F.array().cast(_SPANS))), F.array().cast(_SPANS))


def standardize(tokens: Column, stemming: str = "identity") -> Column:
    """Lower-cased, stemmed tokens."""
    lowered = F.transform(tokens, lambda t: F.lower(t))
    if stemming == "identity":
        return lowered
    if stemming == "porter_stemmer":
        from textmap.functions.porter import stem_udf

        return stem_udf()(lowered)
    if stemming == "wordnet_lemmatizer":
        raise ImportError("the WordNet data that this lemmatizer looks words up in is not part of this library")
    raise ValueError(f"unknown stemming {stemming!r}; it is one of {', '.join(STEMMERS)}")


def standard_words(words: Iterable[str], stemming: str = "identity") -> list[str]:
    """The same on the driver, for lists."""
    if stemming == "identity":
        return [w.lower() for w in words]
    if stemming == "porter_stemmer":
        from textmap.functions.porter import stem

        return [stem(w.lower()) for w in words]
    standardize(F.lit(None), stemming)
    return []


def without_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    stops = sorted(set(stop_words))
    if not stops:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(stops))


def join_phrase(tokens: Column, delimiter: str = " ") -> Column:
    return F.concat_ws(delimiter, tokens)


def split_phrase(phrase: Column, delimiter: str = " ") -> Column:
    import re

    return F.split(phrase, re.escape(delimiter) if delimiter != " " else " ")


def phrase_to_string(phrase, delimiter: str = " "):
    """A tuple of words as a string; a string stays as it is."""
    return delimiter.join(phrase) if isinstance(phrase, tuple) else phrase


def string_to_phrase(phrase, delimiter: str = " "):
    """A string as a tuple of words; a tuple stays as it is."""
    return tuple(phrase.split(delimiter)) if isinstance(phrase, str) else phrase


def phrases_to_strings(phrases, delimiter: str = " ") -> list:
    return [phrase_to_string(p, delimiter) for p in phrases]


def strings_to_phrases(phrases, delimiter: str = " ") -> list:
    return [string_to_phrase(p, delimiter) for p in phrases]


def standardize_text(text: Column, stop_words="nltk", stemming: str = "identity") -> Column:
    """The standard tokens of a text that aren't stop words, joined by spaces.

    Stop words are taken as they are, not stemmed.
    """
    stops = [w.lower() for w in stop_word_list(stop_words)]
    return join_phrase(without_stop_words(standardize(tokenize(text), stemming), stops))
