"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits (and non-ASCII characters) of ASCII
lower-cased text. A seed is a hash of the tokens at the set positions of a fixed
mask; the other positions are ignored, so a substituted token there still lets
the seed match. Each mask is hashed at every position of every test item and of
every training text; equal hashes are hits. Around a hit the two texts are
compared token by token along the hit's diagonal. An overlap is a run of at least
13 tokens, or a whole shorter item of at least 5, with at least 80 % equal tokens.

No overlap lacks a hit: one of 26 tokens or more holds one of 13 to 25, and of those
each has four equal tokens in a row or three on both sides of one (all placements
were counted). Items below 13 tokens are cut into one piece more than may be
substituted, so one is whole; those of 5 have a mask for each token left out.

Spans: of each diagonal first the runs with the best score around the hits (+1 for
an equal token, -3 for a substitution, given up 9 below its best) as far as they
are overlaps, then, in what is left of it, the longest overlaps, without differing
tokens at their ends where the length allows it.

The test items are gone through in blocks whose hashes have a fixed bound
(BLOCK_TOKENS tokens, two hashes each), so what is sent to the tasks doesn't
grow with the benchmark; training rows are never shuffled.

Defined cases: null or empty texts and items overlap with nothing; null ids are
kept as null; repeated rows are reported once each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import Tables, U, mix, sized, table, text_batches, with_columns_renamed_apart, word_codes

#: The first two are for items of MIN_OVERLAP tokens or more, the others for shorter ones.
MASKS = ("1111", "1110111", "111", "10111", "11011", "11101")
LONG_MASKS = 2
WEIGHT_EQUAL, WEIGHT_OTHER, GIVE_UP = 1, 3, 9
MIN_OVERLAP, MIN_ITEM, MIN_EQUAL = 13, 5, 0.8
BLOCK_TOKENS = 500_000
_FILTER_BITS = 22
#: Overlaps of this length or more hold a shorter one.
TWICE = 2 * MIN_OVERLAP
HITS_AT_ONCE = 50_000

_KEEP = bytearray(b" " * 256)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _KEEP[_c] = _c
for _c in range(65, 91):
    _KEEP[_c] = _c + 32
_KEEP = bytes(_KEEP)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_codes([t.translate(_KEEP) for t in texts])


def seeds(codes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The mask's hash at each position (those near the end of a text run into the next one)."""
    m = len(codes) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(m, U(number + 1))
        for k, bit in enumerate(mask):
            if bit == "1":
                out = out * U(0x9E3779B97F4A7C15) + codes[k : k + m]
        return mix(out)


def short_seeds(n: int) -> list[tuple[str, int]]:
    """Masks and their places in an item of n tokens, of which one meets any whole copy with at most a fifth substituted."""
    if n == MIN_ITEM:
        return [("1111", 0), ("1111", 1), ("10111", 0), ("11011", 0), ("11101", 0)]
    cuts = [k * n // (n // 5 + 1) for k in range(n // 5 + 2)]
    return [("1" * min(b - a, 4), a) for a, b in zip(cuts[:-1], cuts[1:])]


class Block:
    """Test items in memory: their tokens, and the sorted seeds with the item and position of each."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        self.codes, self.bounds = tokens(texts)
        sizes = np.diff(self.bounds)
        ends, size_at = np.repeat(self.bounds[1:], sizes), np.repeat(sizes, sizes)
        self.needed = np.ceil(MIN_EQUAL * np.minimum(sizes, MIN_OVERLAP) - 1e-9).astype(np.int64)
        short: dict[str, list[int]] = {}
        for i in np.flatnonzero((sizes >= MIN_ITEM) & (sizes < MIN_OVERLAP)):
            for mask, on in short_seeds(int(sizes[i])):
                short.setdefault(mask, []).append(int(self.bounds[i]) + on)
        keys, places = [], []
        self.masks = [(n, m) for n, m in enumerate(MASKS) if n < LONG_MASKS or m in short]
        for number, mask in self.masks:
            s = seeds(self.codes, mask, number)
            at = np.zeros(0, np.int64)
            if number < LONG_MASKS:
                at = np.flatnonzero((np.arange(len(s)) + len(mask) <= ends[: len(s)]) & (size_at[: len(s)] >= MIN_OVERLAP))
            at = np.concatenate([at, np.array(sorted(set(short.get(mask, ()))), np.int64)])
            keys.append(s[at])
            places.append(at)
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.keys, self.places = key[order], place[order]
        self.items = np.searchsorted(self.bounds, self.places, side="right") - 1
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def likely(self, codes: np.ndarray, bounds: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of the hits (places in codes and numbers of seeds), and which of them have enough equal tokens around for an overlap."""
        doc, i, on = np.searchsorted(bounds, at, side="right") - 1, self.items[k], self.places[k]
        low = np.minimum(at - bounds[doc], on - self.bounds[i])
        high = np.minimum(bounds[doc + 1] - at, self.bounds[i + 1] - on)
        near = np.arange(4 - TWICE, TWICE)
        inside = (near >= -low[:, None]) & (near < high[:, None])
        place = lambda x, n: np.clip(x[:, None] + near, 0, n - 1)
        equal = (codes[place(at, len(codes))] == self.codes[place(on, len(self.codes))]) & inside
        return doc, equal.sum(axis=1) >= self.needed[i]


def extend(text: np.ndarray, item: np.ndarray, at: int, on: int) -> tuple[int, int, int]:
    """The best-scoring run of the diagonal through text[at] and item[on]: start and end in the text, equal tokens."""

    def one_way(equal: np.ndarray) -> int:
        score = np.where(equal, WEIGHT_EQUAL, -WEIGHT_OTHER).cumsum()
        if not len(score):
            return 0
        given_up = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > GIVE_UP)
        score = score[: given_up[0]] if len(given_up) else score
        best = int(score.argmax()) if len(score) else 0
        return best + 1 if len(score) and score[best] > 0 else 0

    n = min(len(text) - at, len(item) - on)
    right = one_way(text[at : at + n] == item[on : on + n])
    n = min(at, on)
    left = one_way((text[at - n : at] == item[on - n : on])[::-1])
    a, b = at - left, at + right
    return a, b, int((text[a:b] == item[on - left : on + right]).sum())


def longest(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest run of at least `least` tokens with MIN_EQUAL of them equal, and no differing ends beyond that length."""
    value = np.concatenate([[0], np.where(equal, 1, -4).cumsum()])  # 0 or more over a run: 80 % or more
    highest = np.maximum.accumulate(value[::-1])[::-1]
    end = np.searchsorted(-highest, -value, side="right") - 1
    a = int((end - np.arange(len(value))).argmax())
    b = int(end[a])
    if b - a < least:
        return None
    while b - a > least and not (equal[a] and equal[b - 1]):
        a, b = (a, b - 1) if not equal[b - 1] else (a + 1, b)
    return a, b


def overlaps(text: np.ndarray, block: Block, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, equal tokens) of a text's verified overlaps; hits: position, item number, position in the item."""
    out, diagonals = [], {}
    for at, i, on in sorted(hits):
        diagonals.setdefault((i, at - on), []).append(at)
    for (i, shift), ats in diagonals.items():
        item = block.codes[block.bounds[i] : block.bounds[i + 1]]
        least, first, last = min(MIN_OVERLAP, len(item)), max(0, shift), min(len(text), shift + len(item))
        if len(item) < MIN_ITEM or last - first < least:
            continue
        equal = text[first:last] == item[first - shift : last - shift]
        found, reached = set(), -1
        for at in ats:
            if reached > at:
                continue
            a, b, n = extend(text, item, at, at - shift)
            reached = max(b, at + 1)
            if b - a >= least and n >= MIN_EQUAL * (b - a):
                found.add((a - first, b - first))
        cuts = [0, *(x for span in sorted(found) for x in span), len(equal)]
        left = list(zip(cuts[0::2], cuts[1::2]))
        while left:
            a, b = left.pop()
            best = longest(equal[a:b], least) if b - a >= least else None
            if best:
                x, y = a + best[0], a + best[1]
                found.add((x, y))
                left += [(a, x), (y, b)]
        out += [(i, first + a, first + b, int(equal[a:b].sum())) for a, b in found]
    return sorted(out)


def _finder(block_data):
    def run(stream):
        block = Block(*block_data.value)
        for batch in stream:
            ids = batch.column(0).to_pylist()
            for a, b, texts in text_batches(batch.column(1)):
                codes, bounds = tokens(texts)
                ends = np.repeat(bounds[1:], np.diff(bounds))
                hits: dict[int, list] = {}
                for number, mask in block.masks:
                    s = seeds(codes, mask, number)
                    at = np.flatnonzero(block.filter[(s >> U(64 - _FILTER_BITS)).astype(np.int64)] & (np.arange(len(s)) + len(mask) <= ends[: len(s)]))
                    low, high = np.searchsorted(block.keys, s[at], "left"), np.searchsorted(block.keys, s[at], "right")
                    upto = np.concatenate([[0], (high - low).cumsum()])
                    for x in range(0, int(upto[-1]), HITS_AT_ONCE):
                        flat = np.arange(x, min(x + HITS_AT_ONCE, int(upto[-1])))
                        own = np.searchsorted(upto, flat, side="right") - 1
                        p, k = at[own], low[own] + flat - upto[own]
                        doc, good = block.likely(codes, bounds, p, k)
                        for d, q, k in zip(doc[good].tolist(), p[good].tolist(), k[good].tolist()):
                            i = int(block.items[k])
                            hits.setdefault(d, []).append((q - int(bounds[d]), i, int(block.places[k] - block.bounds[i])))
                rows = [(ids[a + d], block.ids[i], x, y, e, len_) for d, h in sorted(hits.items()) for i, x, y, e in overlaps(codes[bounds[d] : bounds[d + 1]], block, h) for len_ in [int(block.bounds[i + 1] - block.bounds[i])]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "item_id", "start_token", "end_token", "n_equal", "item_tokens"])

    return run


def _blocks(items: DataFrame):
    """Test items in order, in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col("id").cast("long"), F.col("text").cast("string")).orderBy("id", "text").toLocalIterator():
        data = (row[1] or "").encode()
        ids.append(row[0])
        texts.append(data)
        size += data.count(b" ") + 1
        if size >= BLOCK_TOKENS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_token, end_token, n_equal, item_tokens: one row per overlap of a text with a test item."""
    spark = docs.sparkSession
    rows = with_columns_renamed_apart(docs, {id_col: "id", text_col: "text"}).select(F.col("id").cast("long"), F.col("text").cast("string"))
    kinds = "doc_id long, item_id long, start_token long, end_token long, n_equal long, item_tokens long"
    out = None
    for block in _blocks(with_columns_renamed_apart(benchmark, {item_col: "id", item_text: "text"})):
        part = rows.mapInArrow(_finder(spark.sparkContext.broadcast(block)), kinds)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], kinds)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that overlap with a test item. Rows with a null id are judged by nothing and stay."""
    found = sized(Tables(docs.sparkSession), contaminated_spans(docs, benchmark).select(F.col("doc_id").alias("leak_id")).distinct(), "leaks")
    return docs.join(found, F.col("doc_id") == F.col("leak_id"), "left_anti").select(*docs.columns)


def op10_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
