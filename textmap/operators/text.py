"""The tokenizing pipeline: tokens -> standard forms -> stop words -> phrases -> synonyms.

A `Pipeline` is a frozen description; its methods turn a DataFrame of texts into
a DataFrame of phrases with their spans. Nothing is kept between calls.
"""

from __future__ import annotations

import dataclasses
import itertools
import zlib
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.functions import tokens as T

#: What stands for a token outside the vocabulary: nothing, itself, or itself in brackets; any other string stands for itself.
OUT_OF_VOC = ("ignore", "keep", "[]", "{}")
#: Vocabularies are sent to every task; a larger one is refused rather than sent.
MAX_PHRASES = 2_000_000
#: Terms are first counted by this many hashes of each kind; a hash's count is as large as that of any of its terms, at least.
HASHES = 1 << 16
#: Texts looked at together.
TEXTS = 1000

def out_of_voc_form(token: str, policy: str) -> str | None:
    """The phrase that stands for a token outside the vocabulary; None: none."""
    if policy == "ignore":
        return None
    if policy == "keep":
        return token
    return policy[0] + token + policy[1] if policy in ("[]", "{}") else policy


_PHRASES = "array<struct<pos:int,phrase:string,known:boolean>>"
_SPANS = "array<struct<pos:int,start:int,end:int,phrase:string,known:boolean>>"


def _list_values(column: pa.Array) -> tuple[list[int], list]:
    """Where each row's list ends, and all values; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
    return list(itertools.accumulate(sizes)), column.flatten().to_pylist()


def _phrase_finder(pipeline: Pipeline):
    """(standard tokens) -> (first token, tokens, phrase, known) from left to right; at each place the longest phrase, else one unknown token (None: it stands for nothing)."""
    phrases, mapping, policy = pipeline._sent(), dict(pipeline.mapping), pipeline.out_of_voc
    longest: dict[str, int] = {}
    for phrase in phrases:
        words = phrase.split(" ")
        longest[words[0]] = max(longest.get(words[0], 0), len(words))

    def find(tokens: list[str]):
        at, n_tokens = 0, len(tokens)
        while at < n_tokens:
            token = tokens[at]
            for n in range(min(longest.get(token, 0), n_tokens - at), 0, -1):
                phrase = token if n == 1 else " ".join(tokens[at : at + n])
                if phrase in phrases:
                    yield at, n, mapping.get(phrase, phrase), True
                    break
            else:
                n, phrase = 1, out_of_voc_form(token, policy)
                yield at, 1, mapping.get(phrase, phrase), False
            at += n

    return find


def phrases_of_tokens(pipeline: Pipeline):
    """array<string> of standard tokens -> array<struct<pos, phrase, known>>, in Arrow batches; time is linear in the tokens."""
    find, stops = _phrase_finder(pipeline), frozenset(pipeline.stop_words)

    @F.arrow_udf(_PHRASES)
    def match(tokens: pa.Array) -> pa.Array:
        ends, words = _list_values(tokens)
        offsets, pos, phrase, known, at = [0], [], [], [], 0
        for end in ends:
            for i, (_, _, p, k) in enumerate(find([w for w in words[at:end] if w not in stops])):
                if p is not None:
                    pos.append(i)
                    phrase.append(p)
                    known.append(k)
            offsets.append(len(phrase))
            at = end
        values = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(phrase, pa.string()), pa.array(known, pa.bool_())], ["pos", "phrase", "known"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return match


def counts_of_tokens(pipeline: Pipeline):
    """array<string> of standard tokens -> array<struct<at, n>>: the terms that occur among the phrases, by number in the vocabulary, with their counts."""
    find, stops = _phrase_finder(pipeline), frozenset(pipeline.stop_words)
    number = {t: i for i, t in enumerate(pipeline.vocabulary())}

    @F.arrow_udf("array<struct<at:int,n:double>>")
    def match(tokens: pa.Array) -> pa.Array:
        offsets, at, n = [0], [], []
        for first in range(0, len(tokens), TEXTS):
            ends, words = _list_values(tokens.slice(first, TEXTS))
            start = 0
            for end in ends:
                own = Counter(phrase for _, _, phrase, _ in find([w for w in words[start:end] if w not in stops]) if phrase in number)
                at += [number[t] for t in own]
                n += own.values()
                offsets.append(len(at))
                start = end
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.float64())], ["at", "n"]))

    return match


def spans_of_tokens(pipeline: Pipeline):
    """(standard tokens, their lengths in the text, the gaps before them) -> array<struct<pos, start, end, phrase, known>>."""
    find, stops = _phrase_finder(pipeline), frozenset(pipeline.stop_words)

    @F.arrow_udf(_SPANS)
    def match(tokens: pa.Array, sizes: pa.Array, gaps: pa.Array) -> pa.Array:
        ends, words = _list_values(tokens)
        (_, sizes), (gap_ends, gaps) = _list_values(sizes), _list_values(gaps)
        offsets, rows, at, gap_at = [0], ([], [], [], [], []), 0, 0
        for end, gap_end in zip(ends, gap_ends):
            kept, place = [], 0
            for word, size, gap in zip(words[at:end], sizes[at:end], gaps[gap_at:gap_end]):
                place += gap
                if word not in stops:
                    kept.append((word, place, place + size))
                place += size
            for pos, (first, n, phrase, known) in enumerate(find([w for w, _, _ in kept])):
                if phrase is not None:
                    for column, value in zip(rows, (pos, kept[first][1], kept[first + n - 1][2], phrase, known)):
                        column.append(value)
            offsets.append(len(rows[0]))
            at, gap_at = end, gap_end
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["pos", "start", "end", "phrase", "known"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    return match


@dataclasses.dataclass(frozen=True)
class Pipeline:
    """phrases: standard vocabulary phrases, words joined by spaces. mapping: synonyms, one step."""

    phrases: frozenset[str] = frozenset()
    mapping: tuple[tuple[str, str], ...] = ()
    stop_words: tuple[str, ...] = tuple(sorted(T.STOP_WORDS))
    stemming: str = "identity"
    out_of_voc: str = "ignore"
    token_pattern: str = T.WORD_PATTERN
    #: (raw term, frequency) as read
    raw_vocabulary: tuple[tuple[str, float], ...] = ()

    # Columns of one text

    def standard_tokens(self, text: Column) -> Column:
        """Standard tokens without stop words."""
        return T.without_stop_words(T.standardize(T.tokenize(text, self.token_pattern), self.stemming), self.stop_words)

    def phrases_in(self, text: Column) -> Column:
        """array<struct<pos, phrase, known>> of a text; pos counts unknown tokens too."""
        return phrases_of_tokens(self)(T.standardize(T.tokenize(text, self.token_pattern), self.stemming))

    def spans_in(self, text: Column) -> Column:
        """array<struct<pos, start, end, phrase, known>>: a span reaches from its first token's start to its last token's end (code points)."""
        tokens = T.tokenize(text, self.token_pattern)
        gaps = F.transform(F.split(text, self.token_pattern, -1), F.length)
        return spans_of_tokens(self)(T.standardize(tokens, self.stemming), F.transform(tokens, F.length), gaps)

    # Tables

    def extract(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, pos, phrase, known: the phrases of each text in order. Texts without any have no rows."""
        if not self.phrases and self.out_of_voc == "keep":
            rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(self.standard_tokens(F.col(text_col))).alias("pos", "phrase"))
            pairs = [F.lit(x) for pair in self.mapping for x in pair]
            phrase = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("phrase")), F.col("phrase")) if pairs else F.col("phrase")
            return rows.select("doc_id", "pos", phrase.alias("phrase"), F.lit(False).alias("known"))
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(self.phrases_in(F.col(text_col))).alias("p"))
        return rows.select("doc_id", "p.pos", "p.phrase", "p.known")

    def extract_spans(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, pos, phrase, known, start, end of the phrases of each text in order."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(self.spans_in(F.col(text_col))).alias("s"))
        return rows.select("doc_id", "s.pos", "s.phrase", "s.known", "s.start", "s.end")

    def _sent(self) -> frozenset[str]:
        if len(self.phrases) > MAX_PHRASES:
            raise ValueError(f"{len(self.phrases)} phrases; at most {MAX_PHRASES} are sent to the tasks")
        return self.phrases

    # The vocabulary

    def full_vocabulary(self) -> list[str]:
        return sorted(self.phrases)

    def vocabulary(self) -> list[str]:
        """All phrases but those that map to others, in code-point order."""
        return sorted(self.phrases - {a for a, _ in self.mapping})

    def vocabulary_table(self, spark) -> DataFrame:
        """term_id, term, frequency of the vocabulary."""
        freq = self.frequencies()
        return spark.createDataFrame([(i, t, float(freq[t])) for i, t in enumerate(self.vocabulary())], "term_id int, term string, frequency double")

    def phrases_of(self, term: str, find=None) -> list[str]:
        """What a raw term becomes, on the driver: its phrases after stop words and synonyms."""
        import regex

        words = [w for w in T.standard_words(regex.findall(self.token_pattern, term), self.stemming) if w not in set(self.stop_words)]
        return [phrase for _, _, phrase, _ in (find or _phrase_finder(self))(words) if phrase is not None]

    def frequencies(self) -> dict[str, float]:
        """Frequency of each vocabulary term; those of raw terms that become the same add up. 1 for all without any."""
        if not self.raw_vocabulary:
            return dict.fromkeys(self.vocabulary(), 1.0)
        sums: dict[str, float] = {}
        find = _phrase_finder(self)
        for term, freq in self.raw_vocabulary:
            phrase = (self.phrases_of(term, find) or [""])[0]
            sums[phrase] = sums.get(phrase, 0.0) + float(freq)
        missing = [t for t in self.vocabulary() if t not in sums]
        if missing:
            raise KeyError(f"terms without a frequency: {missing[:5]}")
        return {t: sums[t] for t in self.vocabulary()}


def pipeline_from_vocabulary(
    vocabulary, frequencies=None, stemming="identity", stop_words="nltk", out_of_voc="ignore", voc_mapping: Mapping[str, str] | None = None, token_pattern=T.WORD_PATTERN
) -> Pipeline:
    """Terms (strings or tuples) are tokenized, standardized and freed of stop words themselves; empty ones go."""
    import regex

    T.check_pattern(token_pattern)
    if voc_mapping == "auto":
        import warnings

        warnings.warn("no vocabulary mapping can be made from a vocabulary alone; an empty one is used")
        voc_mapping = {}
    terms = T.phrases_to_strings(list(vocabulary))
    stops = tuple(sorted(set(T.standard_words(T.stop_word_list(stop_words), stemming))))
    standard = (" ".join(w for w in T.standard_words(regex.findall(token_pattern, t), stemming) if w not in stops) for t in terms)
    mapping = tuple((T.phrase_to_string(a), T.phrase_to_string(b)) for a, b in (voc_mapping or {}).items())
    freq = [1.0] * len(terms) if frequencies is None else [float(f) for f in frequencies]
    return Pipeline(frozenset(standard) - {""}, mapping, stops, stemming, out_of_voc, token_pattern, tuple(zip(terms, freq)))


def merged_frequencies(terms: DataFrame) -> DataFrame:
    """term, frequency from (standard_term, frequency): what becomes the same term adds up."""
    return terms.groupBy(F.col("standard_term").alias("term")).agg(F.sum("frequency").alias("frequency"))


def standardizing_inverse(terms: DataFrame, standard: Column) -> DataFrame:
    """standard_phrase -> the original phrase of the largest frequency (ties: the smaller phrase). terms: term, frequency."""
    ranked = terms.withColumn("standard_phrase", standard)
    first = F.row_number().over(W.partitionBy("standard_phrase").orderBy(F.col("frequency").desc(), F.col("term").asc()))
    return ranked.withColumn("rank", first).filter("rank = 1").select("standard_phrase", F.col("term").alias("original_phrase"))


def _distinct_terms(batches, pairs: bool, n_hashes: int):
    """Of lists of words, TEXTS at a time: the distinct words and pairs of each list, as (all words, pair?, numbers of the words, hashes)."""
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield from _distinct_of(batch.column(0).slice(at, TEXTS), pairs, n_hashes)


def _distinct_of(column: pa.Array, pairs: bool, n_hashes: int):
    words = column.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    at, size = words.indices.to_numpy().astype(np.int64), max(len(names), 1)
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
    hashed = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in names], np.uint64)
    own = np.unique(row * size + at) % size
    yield names, False, (own,), (hashed[own] % np.uint64(n_hashes)).astype(np.int64)
    if pairs:
        next_ = np.flatnonzero(row[1:] == row[:-1])
        r, a, b = row[next_], at[next_], at[next_ + 1]
        if len(column) * size * size < 1 << 63:
            keys = np.unique((r * size + a) * size + b) % (size * size)
            a, b = keys // size, keys % size
        else:
            _, a, b = np.unique(np.stack([r, a, b]), axis=1)
        mixed = (hashed[a] * np.uint64(0x9E3779B97F4A7C15) + hashed[b]) * np.uint64(0xBF58476D1CE4E5B9)
        yield names, True, (a, b), (mixed >> np.uint64(40)).astype(np.int64) % n_hashes


def _hash_counts(pairs: bool, n_hashes: int):
    def run(batches):
        counts = np.zeros((2, n_hashes), np.int64)
        for _, pair, _, hashes in _distinct_terms(batches, pairs, n_hashes):
            counts[int(pair)] += np.bincount(hashes, minlength=n_hashes)
        kind, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(kind == 1), pa.array(at), pa.array(counts[kind, at])], names=["pair", "hash", "n"])

    return run


def _exact_counts(pairs: bool, n_hashes: int, wanted: dict[bool, list[int]]):
    """The document frequencies, in each task, of all terms of the wanted hashes."""
    take = {pair: np.isin(np.arange(n_hashes), hashes) for pair, hashes in wanted.items()}

    def run(batches):
        counts: dict[tuple[bool, str], int] = {}
        for names, pair, numbers, hashes in _distinct_terms(batches, pairs, n_hashes):
            if pair in take:
                there = take[pair][hashes]
                for own in zip(*[x[there].tolist() for x in numbers]):
                    key = pair, " ".join([names[i] for i in own])
                    counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in counts], pa.bool_()), pa.array([t for _, t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "term", "df"])

    return run


def derived_vocabulary(docs: DataFrame, n_words: int, n_pairs: int = 0, text_col: str = "text", stop_words="nltk", n_hashes: int = HASHES) -> DataFrame:
    """term, df, frequency: the words, and the pairs of neighbouring words, of the largest document frequency (ties: the smaller term).

    The texts are read twice, and few terms are shuffled: first documents are counted by hashes of their terms, then by the terms of the largest
    hashes. No term of another hash can be among the best if that hash's count is below the last of them; those that aren't are counted as well.
    """
    base = Pipeline(stop_words=tuple(T.stop_word_list(stop_words)))
    n = docs.count()
    words = docs.select(base.standard_tokens(F.col(text_col)).alias("k"))
    by_hash = words.mapInArrow(_hash_counts(n_pairs > 0, n_hashes), "pair boolean, hash long, n long").groupBy("pair", "hash").agg(F.sum("n").alias("n")).toArrow()
    kinds = {False: n_words, True: n_pairs}
    sums = {pair: by_hash.filter(pc.equal(by_hash["pair"], pair)).sort_by([("n", "descending"), ("hash", "ascending")]) for pair, size in kinds.items() if size > 0}
    hashes = {pair: (own["hash"].to_pylist(), own["n"].to_pylist()) for pair, own in sums.items()}
    done, found = dict.fromkeys(hashes, 0), {pair: [] for pair in hashes}
    upto = {pair: min(len(own), 2 * kinds[pair] + 20) for pair, (own, _) in hashes.items()}
    while any(upto[pair] > done[pair] for pair in hashes):
        wanted = {pair: own[done[pair] : upto[pair]] for pair, (own, _) in hashes.items() if upto[pair] > done[pair]}
        counted = words.mapInArrow(_exact_counts(n_pairs > 0, n_hashes, wanted), "pair boolean, term string, df long").groupBy("pair", "term").agg(F.sum("df").alias("df"))
        for pair in wanted:
            best = counted.filter(F.col("pair") == pair).orderBy(F.col("df").desc(), F.col("term").asc()).limit(kinds[pair])
            found[pair] += [(r["df"], r["term"]) for r in best.collect()]
            found[pair] = sorted(found[pair], key=lambda x: (-x[0], x[1].encode()))[: kinds[pair]]
            least = found[pair][-1][0] if len(found[pair]) == kinds[pair] else 1
            done[pair], upto[pair] = upto[pair], sum(c >= least for c in hashes[pair][1])
    rows = [(t, df, df / float(max(n, 1))) for pair in found for df, t in found[pair]]
    return docs.sparkSession.createDataFrame(rows, "term string, df long, frequency double")
