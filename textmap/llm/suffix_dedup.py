"""Repeated passages by a sparse suffix array.

Text is ASCII lower-cased words between ASCII white space. Of all suffixes only
those at minimisers are retained: word positions whose 8-gram has the smallest
hash in some window of 24. Any two equal passages of at least 50 words retain a
suffix at the same place among their first 24 words, so at least 27 words of
the passage follow it.

1. Retained suffixes whose first 27 words occur once can't repeat; they go.
2. A run of more than five suffixes is matched by windows: each way to have 50
   words with the run among them (0 to 23 words left of it, the rest right) is a
   hash. Hashes are counted, with their first (document, position), by partial
   aggregation, so one very common passage stays small; those of more than one
   suffix are matches of 50 words. This compares every suffix with all others.
3. The suffixes of other runs are sorted by their words (27 as one hash, then 23
   more as 32-bit codes), with the words before them, read backwards, as the next
   key. Each meets its four predecessors in that order, so all of its run, whatever
   the partitions and batches: the last rows of a batch are carried on, and rows at
   the edges of a range meet those of the next range in a second, small pass. The
   common prefix extends the match right, the common words before it extend it
   left; matches of at least 50 words in all count. Longer passages are the
   union of the matches of their suffixes.
4. The copy with the smallest (document, position) stays. Of any other copy those
   words go that a run has in a smaller place, and those around it that a smaller
   copy was seen to have too: whatever goes is left in some smaller place.

Defined cases: null or short texts have no passages; rows with a null id take no
part; repeated rows of one id don't count as copies of each other; of one id's
different texts that with the largest hash takes part, and rows with the others have
no passages and aren't cut; passages repeated inside one document count; an empty
table has no passages. Extra columns are ignored (find) or kept (cut).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.llm.shared import PIECE, Tables, U, _P, _PINV, _powers_of, mix, ngrams, signed, sized, table, text_batches, with_columns_renamed_apart, word_codes

MIN_WORDS, GRAM, WINDOW = 50, 8, 24
RUN = MIN_WORDS - WINDOW + 1
SIDE = WINDOW - 1  # words carried on either side of the run
LOOK_BACK = 4


def _windowed(x: np.ndarray, f) -> np.ndarray:
    """f (minimum or maximum) over each WINDOW neighbours."""
    step = x
    for k in (1, 2, 4, 8):
        step = f(step[:-k], step[k:])
    return f(step[:-8], step[8:])


def minimisers(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Retained positions among all words, and a hash of the RUN words from each."""
    n = len(codes)
    h = ngrams(codes, GRAM)
    if len(h) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h |= U(1)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    long_enough = np.repeat(np.diff(bounds) >= MIN_WORDS, np.diff(bounds))
    low = _windowed(h, np.minimum)
    inside = np.arange(len(low)) + WINDOW + GRAM - 1 <= ends[: len(low)]
    low = np.where(inside & long_enough[: len(low)], low, U(0))
    edge = np.zeros(WINDOW - 1, np.uint64)
    high = _windowed(np.concatenate([edge, low, edge]), np.maximum)
    at = np.flatnonzero(high == h)
    at = at[at + RUN <= ends[at]]
    up, down = _powers_of(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up[:n], out=total[1:])
        return at, mix((total[at + RUN] - total[at]) * down[at])


def _suffixes(stream):
    for batch in stream:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, texts in text_batches(batch.column(1)):
            codes, bounds = word_codes([t.lower() for t in texts])
            at, run = minimisers(codes, bounds)
            doc = np.searchsorted(bounds, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(run)), pa.array(ids[a:b][doc].astype(np.int64)), pa.array((at - bounds[doc]).astype(np.int32))], names=["run", "id", "pos"]
            )


def _contexts(stream):
    """The words around each suffix that is still of interest, as binary sort keys."""
    for batch in stream:
        ids, found = batch.column(0).to_pylist(), batch.column(2)
        rows = ((a + k, text) for a, _, texts in text_batches(batch.column(1)) for k, text in enumerate(texts))
        for k, text in rows:
            codes, _ = word_codes([text.lower()])
            own = found[k].values
            pos, n = own.field("pos").to_numpy().astype(np.int64), len(codes)
            code = (codes >> U(32)).astype(">u4")
            side = np.arange(SIDE)
            right, left = code[np.minimum(pos[:, None] + RUN + side, n - 1)], code[np.maximum(pos[:, None] - 1 - side, 0)]
            n_right, n_left = np.minimum(SIDE, n - pos - RUN), np.minimum(SIDE, pos)
            yield pa.RecordBatch.from_arrays(
                [
                    own.field("run"),
                    pa.array([r[:m].tobytes() for r, m in zip(right, n_right)], pa.binary()),
                    pa.array([r[:m].tobytes() for r, m in zip(left, n_left)], pa.binary()),
                    pa.array([ids[k]] * len(pos), pa.int64()),
                    own.field("pos"),
                    own.field("first_id"),
                    own.field("first_pos"),
                    own.field("many"),
                ],
                names=["run", "right", "left", "id", "pos", "first_id", "first_pos", "many"],
            )


def _matrix(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = SIDE * 4
    sizes = np.array([len(v) for v in values]) // 4
    data = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), ">u4").reshape(-1, SIDE)
    return data, sizes


def _common(a, b) -> np.ndarray:
    (x, nx), (y, ny) = a, b
    differs = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return np.minimum(differs.argmax(axis=1), np.minimum(nx, ny))


def _hashes_of_sides(batch) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Hashes of the run with its first 0 to SIDE words right of it, and with those left of it, and how many each suffix has."""
    (right, n_right), (left, n_left) = (_matrix(batch.column(k).to_pylist()) for k in (1, 2))
    run = batch.column(0).to_numpy().view(np.uint64)
    after, before = [mix(run)], [mix(run + U(1))]
    with np.errstate(over="ignore"):
        for out, words in ((after, right), (before, left)):
            for k in range(SIDE):
                out.append(mix(out[-1] * _P + words[:, k].astype(np.uint64) + U(1)))
    return after, before, n_right, n_left


def _whole_contexts(stream):
    """Each suffix with a hash of all that is held of the words around it, and the span of those."""
    for batch in stream:
        if batch.num_rows:
            after, before, n_right, n_left = _hashes_of_sides(batch)
            row = np.arange(batch.num_rows)
            with np.errstate(over="ignore"):
                key = mix(np.array(before)[n_left, row] * _PINV + np.array(after)[n_right, row] + (n_left * 64 + n_right).astype(np.uint64))
            ints = [pa.array(x.astype(np.int32)) for x in (n_left, n_right)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *[batch.column(c) for c in (3, 4, 5, 6)], *ints], names=["context", "id", "pos", "first_id", "first_pos", "n_left", "n_right"])


def _windows(stream):
    """The hashes of the windows of MIN_WORDS words around each run, with the words that each has left of it."""
    for batch in stream:
        if not batch.num_rows:
            continue
        after, before, n_right, n_left = _hashes_of_sides(batch)
        for j in range(SIDE + 1):
            at = np.flatnonzero((n_left >= j) & (n_right >= SIDE - j))
            with np.errstate(over="ignore"):
                key = mix(before[j][at] * _PINV + after[SIDE - j][at] + U(j))
            columns = [pa.array(signed(key)), *[batch.column(c).take(pa.array(at)) for c in (3, 4)], pa.array(np.full(len(at), j, np.int8))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "pos", "left"])


def _place() -> Column:
    """(id, pos) as one number, so that their minimum is a hash aggregate."""
    return (F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")).cast("decimal(38,0)")


def _matches_of_windows(keyed: DataFrame, tables: Tables) -> DataFrame:
    """The spans of the windows that more than one suffix has; keyed: suffixes of runs that many have.

    Suffixes with equal words on both sides have equal windows: the first of them stands for all.
    """
    at = ["id", "pos", "first_id", "first_pos"]
    whole = keyed.select(*_KEYS).mapInArrow(_whole_contexts, "context long, id long, pos int, first_id long, first_pos int, n_left int, n_right int").withColumn("place", _place())
    firsts = whole.groupBy("context").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    repeated = sized(tables, firsts.filter("n > 1").select("context", "first_place"), "contexts")
    start, end = F.col("pos") - F.col("n_left"), F.col("pos") + RUN + F.col("n_right")
    copies = whole.filter(F.col("n_left") + F.col("n_right") >= SIDE).join(repeated, "context")
    later = F.col("place") > F.col("first_place")
    spans = (start, end, F.when(later, start).otherwise(F.col("pos")), F.when(later, end).otherwise(F.col("pos") + RUN))
    copies = tables.keep(copies.select(*at, *[x.cast("int").alias(c) for x, c in zip(spans, _NAMES[-4:])], later.alias("later")), "copies")
    alone = keyed.join(copies.filter("later").select("id", "pos"), ["id", "pos"], "left_anti")
    alone = tables.keep(alone.select(*_KEYS), "distinct")
    windows = alone.mapInArrow(_windows, "key long, id long, pos int, left byte")
    shared = windows.withColumn("place", _place()).groupBy("key").agg(F.count("*").alias("n"), F.min("place").alias("first_place")).filter("n > 1").select("key", "first_place")
    found = windows.join(sized(tables, shared, "windows"), "key")
    start, later = F.col("pos") - F.col("left"), _place() > F.col("first_place")
    spans = (start, start + MIN_WORDS, F.when(later, start).otherwise(F.col("pos")), F.when(later, start + MIN_WORDS).otherwise(F.col("pos") + RUN))
    found = found.select("id", "pos", *[x.cast("int").alias(c) for x, c in zip(spans, _NAMES[-4:])]).groupBy("id", "pos").agg(*_widest())
    found = found.join(alone.select(*at), ["id", "pos"]).select(*at, *_NAMES[-4:])
    return found.union(copies.drop("later"))


class Matches:
    """For each sorted suffix the words left of it and right of its run that its best matches reach (-1: none).

    `any_*` are those with any copy, `cut_*` those with a copy before it in (document, position).
    """

    def __init__(self, n: int):
        self.any_left, self.any_right, self.cut_left, self.cut_right = (np.full(n, -1) for _ in range(4))

    def add(self, at, ok: np.ndarray, left: np.ndarray, right: np.ndarray, earlier: np.ndarray) -> None:
        for name, keep in (("any", ok), ("cut", ok & earlier)):
            for side, reach in (("left", left), ("right", right)):
                own = getattr(self, f"{name}_{side}")
                own[at] = np.maximum(own[at], np.where(keep, reach, -1))


def _matches(rows: pa.Table) -> Matches:
    """Each suffix with the LOOK_BACK before it; its run has no more, so with all that share its run."""
    n = rows.num_rows
    right, left = _matrix(rows["right"].to_pylist()), _matrix(rows["left"].to_pylist())
    run, id_, pos = (rows[c].to_numpy() for c in ("run", "id", "pos"))
    out = Matches(n)
    part = lambda m, s: (m[0][s], m[1][s])
    for d in range(1, min(LOOK_BACK, n - 1) + 1):
        before, here = slice(0, n - d), slice(d, n)
        r, l = _common(part(right, before), part(right, here)), _common(part(left, before), part(left, here))
        other = (id_[before] != id_[here]) | (pos[before] != pos[here])
        ok = (run[before] == run[here]) & other & (l + RUN + r >= MIN_WORDS)
        first = (id_[before] < id_[here]) | ((id_[before] == id_[here]) & (pos[before] < pos[here]))
        out.add(before, ok, l, r, ~first)
        out.add(here, ok, l, r, first)
    return out


_KEYS = ["run", "right", "left", "id", "pos", "first_id", "first_pos"]


_KINDS = "run long, right binary, left binary, id long, pos int, first_id long, first_pos int"
_SPAN_KINDS = ", start int, end int, cut_start int, cut_end int"
_NAMES = [*_KEYS, "start", "end", "cut_start", "cut_end"]


def _compared(rows: pa.Table) -> pa.RecordBatch:
    m = _matches(rows)
    hit = np.flatnonzero(m.any_left >= 0)
    found = rows.take(pa.array(hit))
    pos = found["pos"].to_numpy().astype(np.int64)
    blank = pa.nulls(len(hit), pa.binary())
    ends = (pos - m.any_left[hit], pos + RUN + m.any_right[hit], pos - np.maximum(m.cut_left[hit], 0), pos + RUN + np.maximum(m.cut_right[hit], 0))
    columns = [found[c].combine_chunks() if c not in ("right", "left") else blank for c in _KEYS]
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int32)) for x in ends]], names=_NAMES)


def _edge(rows: pa.Table):
    for b in rows.combine_chunks().to_batches():
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in _KEYS], *[pa.nulls(b.num_rows, pa.int32())] * 4], names=_NAMES)


def _neighbours(stream):
    """Matches of a sorted range; its first and last rows come too, without a span, for the pass over edges."""
    held, first, seen = None, None, 0
    for batch in stream:
        new = pa.Table.from_batches([batch])
        if not new.num_rows:
            continue
        seen += new.num_rows
        rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if first is None or first.num_rows < LOOK_BACK:
            first = rows.slice(0, LOOK_BACK)
        yield _compared(rows)
        held = rows.slice(max(0, rows.num_rows - LOOK_BACK))
    if held is not None:
        yield from _edge(pa.concat_tables([first, held.slice(max(0, first.num_rows + held.num_rows - seen))]))


def _neighbours_of_edges(stream):
    held = None
    for batch in stream:
        new = pa.Table.from_batches([batch])
        rows = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if rows.num_rows:
            yield _compared(rows)
            held = rows.slice(max(0, rows.num_rows - LOOK_BACK))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(spans: list[list[int]], kept: list[list[int]]) -> list[list[int]]:
    out = []
    for a, b in spans:
        for x, y in kept:
            if y <= a or x >= b:
                continue
            if x > a:
                out.append([a, x])
            a = max(a, y)
            if a >= b:
                break
        if a < b:
            out.append([a, b])
    return out


def _spans(stream):
    """One row per repeated passage of a document: what stays here, and what goes because a copy comes before it."""
    for batch in stream:
        rows = {"id": [], "start_word": [], "end_word": [], "first_doc_id": [], "repeat": []}
        for id_, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cut = _merged([(x["cut_start"], x["cut_end"]) for x in own if not x["is_first"]])
            here = _without(_merged([(x["start"], x["end"]) for x in own]), cut)
            for spans, repeat in ((here, False), (cut, True)):
                for a, b in spans:
                    at = min((x["first_id"] for x in own if x["start"] < b and x["end"] > a), default=id_)
                    for k, v in zip(rows, (id_, a, b, at, repeat)):
                        rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[k], t) for k, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", *list(rows)[1:]]
        )


def _widest():
    return [f(c).alias(c) for f, c in zip((F.min, F.max, F.min, F.max), _NAMES[-4:])]


def _one_text_per_id(docs: DataFrame, tables: Tables, id_col: str, text_col: str) -> DataFrame:
    """docs with `sa_taken`: whether a row's text is the one that stands for its id (of different ones that with the largest hash)."""
    hashes = docs.select(F.col(f"`{id_col}`").cast("long").alias("sa_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("sa_hash"))
    several = hashes.groupBy("sa_id").agg(F.min("sa_hash").alias("low"), F.max("sa_hash").alias("sa_hash")).filter("low <> sa_hash").select("sa_id", "sa_hash")
    joined = docs.join(sized(tables, several, "several"), F.col(f"`{id_col}`").cast("long") == F.col("sa_id"), "left")
    taken = F.col("sa_hash").isNull() | (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("sa_hash"))
    return joined.withColumn("sa_taken", taken).drop("sa_id", "sa_hash")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, first_doc_id, repeat: passages of 50 words or more that occur more than once.

    repeat is false for the copy that stays and true for the others.
    """
    tables = Tables(docs.sparkSession)
    taken = _one_text_per_id(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), tables, "id", "text").filter("sa_taken AND id IS NOT NULL")
    rows = taken.select(F.col("id").cast("long"), F.col("text").cast("string"))
    suffixes = tables.keep(rows.mapInArrow(_suffixes, "run long, id long, pos int"), "suffixes")
    # A run's suffixes, and its first copy as one number: both are sums of parts.
    runs = suffixes.groupBy("run").agg(F.count("*").alias("m"), F.min(_place()).alias("first")).filter("m > 1")
    at = F.pmod("first", F.lit(1 << 31).cast("decimal(10,0)"))
    first_id = ((F.col("first") - at) / F.lit(1 << 31).cast("decimal(10,0)")).cast("long")
    runs = sized(tables, runs.select("run", first_id.alias("first_id"), at.cast("int").alias("first_pos"), (F.col("m") > LOOK_BACK + 1).alias("many")), "runs")
    per_doc = suffixes.join(runs, "run").groupBy("id").agg(F.collect_set(F.struct("run", "pos", "first_id", "first_pos", "many")).alias("found"))
    keyed = tables.keep(rows.dropDuplicates(["id"]).join(per_doc, "id").select("id", "text", "found").mapInArrow(_contexts, _KINDS + ", many boolean"), "contexts")
    order = ["run", "right", "left", "id", "pos"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = ["id", "pos", "first_id", "first_pos", *_NAMES[-4:]]
    of_windows = tables.keep(_matches_of_windows(keyed.filter("many"), tables).groupBy(*spans[:4]).agg(*_widest()), "windows")
    compared = tables.keep(keyed.filter("NOT many").select(*_KEYS).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _KINDS + _SPAN_KINDS), "compared")
    tables.only(of_windows, compared)
    edges = compared.filter("start IS NULL").select(*_KEYS)
    edges = edges.coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours_of_edges, _KINDS + _SPAN_KINDS)
    hits = compared.filter("start IS NOT NULL").union(edges).select(*spans).union(of_windows.select(*spans)).groupBy(*spans[:4]).agg(*_widest())
    own = F.struct("start", "end", "cut_start", "cut_end", "first_id", ((F.col("id") == F.col("first_id")) & (F.col("pos") == F.col("first_pos"))).alias("is_first"))
    return hits.groupBy("id").agg(F.collect_list(own).alias("own")).mapInArrow(_spans, "doc_id long, start_word long, end_word long, first_doc_id long, repeat boolean")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    if not spans:
        return text
    at = [m.start() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in sorted(spans):
        if a >= len(at):
            break
        out.append(text[last : at[a]])
        last = at[b] if b < len(at) else len(text)
    return "".join(out) + text[last:]


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeat of a passage cut out of text but for its first copy; n_chars follows. No row goes."""
    tables = Tables(docs.sparkSession)
    spans = repeated_passages(docs).filter("repeat").groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("cut_spans"))
    spans = sized(tables, spans, "cuts", rows=100_000)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        own = ((a + k, text) for a, _, part in text_batches(texts) for k, text in enumerate(part))
        return pa.array([cut_words(t.decode(), [(x["start_word"], x["end_word"]) for x in spans[k].as_py()]) if spans[k].is_valid else None for k, t in own], pa.string())

    joined = _one_text_per_id(docs, tables, "doc_id", "text").join(spans, (F.col("doc_id") == F.col("cut_id")) & F.col("sa_taken"), "left")
    # Only texts that lose words go to Python.
    lost = F.when(F.col("cut_spans").isNotNull(), F.col("text"))
    joined = joined.withColumn("text", F.when(F.col("cut_spans").isNull(), F.col("text")).otherwise(cut(lost, "cut_spans")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("cut_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(*docs.columns)


def op4_sparse_suffix_array(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
