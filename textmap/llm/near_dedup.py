"""MinHash near-duplicate detection on HyperMinHash sketches.

A document's set holds its distinct five-word shingles (of ASCII lower-cased
text, words between ASCII white space; a shorter text is one shingle of all its
words; a null or wordless text has none and links with nothing).

1. Sketch. Each shingle hash picks one of 96 buckets; a bucket keeps its
   smallest value as a 16-bit register: leading-zero count plus ten mantissa
   bits, 0 if empty. Rows with equal sets are one node.
2. Band. Four compressed registers are one 64-bit key; a pair at similarity
   0.85 misses all 24 bands with a probability of 2e-8.
3. Candidates. In each bucket every member first meets the bucket's hub, the
   first of its nodes. Verified links are folded to components, and only pairs of one
   bucket that could still join two components are looked at from then on: all of
   them in buckets of at most SMALL members; in larger ones the members meet the
   member with the fewest private shingles (those that no other member of such
   buckets has), the centre. Those outside the bucket's largest component then
   meet the others where what both share with the centre, less what either lacks of
   it, leaves room for the similarity. Any other pair must differ from the centre
   alike in a certain number of shingles; it meets if it does in one of the rarest
   of those, all but that number less one (the prefix filter), with enough of them
   left behind it (the positional filter). No other pair can reach the similarity,
   and no bucket and no number of partners is capped.
4. Estimate. Matching registers, corrected for collisions of registers that
   hold different values, give a Jaccard estimate; pairs five standard errors
   below the threshold go.
5. Verify. Intersections of the full sets decide.

The result is the components of the verified links. Links whose ends are
connected already aren't all listed: components are the result.

Defined cases: rows with a null id link nothing and keep their row
(component null, kept true); repeated rows share a component; rows of one id
with different texts are judged each by its own text, in any order of rows; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textmap.llm.shared import Tables, U, mix, ngrams, signed, sized, table, text_batches, with_columns_renamed_apart, word_codes

BUCKETS, ROWS, MANTISSA = 96, 4, 10
SHINGLE = 5
#: Expected register collisions per bucket are this, times 2^-MANTISSA, times 4ab/(a+b)^2: the published estimate.
COLLISION = 0.169919487159739093975315012348
#: Buckets of at most this many members are compared in full.
SMALL = 32
#: Links up to this many (16 bytes each) are joined in one task.
LINKS_IN_ONE_TASK = 1_000_000
#: Candidate ids up to this many are sent to all tasks (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
MASK52 = U((1 << 52) - 1)


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, bounds = word_codes([x.lower() for x in texts])
    grams = ngrams(codes, n)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(codes[a:b], b - a) + U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, one row of uint16 per set."""
    low = np.full(len(sets) * BUCKETS, MASK52 + U(1))
    sizes = np.array([len(s) for s in sets])
    if sizes.sum():
        h = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets)), sizes) * BUCKETS + ((h >> U(32)) % U(BUCKETS)).astype(np.int64)
        np.minimum.at(low, at, mix(h ^ U(0x5851F42D4C957F2D)) & MASK52)
    empty = low > MASK52
    _, exponent = np.frexp(np.where(empty, U(1), np.maximum(low, U(1))).astype(np.float64))
    zeros = (52 - exponent).astype(np.uint64)
    mantissa = ((low << (zeros + U(1))) & MASK52) >> U(52 - MANTISSA)
    reg = ((zeros + U(1)) << U(MANTISSA)) | mantissa
    return np.where(empty, U(0), reg).astype(np.uint16).reshape(len(sets), BUCKETS)


def _list(rows: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * width + 1, width), pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _fingerprints(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit sums over a set's shingles: with the size they stand for the set."""
    with np.errstate(over="ignore"):
        f1 = np.array([mix(s).sum() if len(s) else U(0) for s in sets], np.uint64)
        f2 = np.array([mix(s + U(77)).sum() if len(s) else U(0) for s in sets], np.uint64)
    return pa.array(signed(f1)), pa.array(signed(f2))


def _sketch(stream):
    for batch in stream:
        for a, b, texts in text_batches(batch.column(1)):
            sets = shingle_sets(texts)
            packed = registers(sets).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes, *_fingerprints(sets), _list(packed, BUCKETS // ROWS)], names=["id", "n", "f1", "f2", "sketch"])


def _sets(stream):
    for batch in stream:
        for _, _, texts in text_batches(batch.column(0)):
            sets = shingle_sets(texts)
            f1, f2 = _fingerprints(sets)
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat)))
            yield pa.RecordBatch.from_arrays([f1, f2, pa.array([len(s) for s in sets], pa.int64()), lists], names=["f1", "f2", "n", "set"])


def _fold(bits: int, mask: int):
    return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, bits)).bitwiseAND(F.lit(mask))


def _filled(words: F.Column) -> F.Column:
    """How many 16-bit registers of an array of 64-bit numbers aren't zero."""
    for bits, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x000F000F000F000F), (2, 0x0003000300030003), (1, 0x0001000100010001)):
        words = F.transform(words, _fold(bits, mask))
    return F.aggregate(words, F.lit(0), lambda s, x: s + F.bit_count(x))


def estimate(sketch_a: str, sketch_b: str, n_a: str, n_b: str) -> tuple[F.Column, F.Column]:
    """The collision-corrected Jaccard estimate, and the number of registers it rests on."""
    a, b = F.col(sketch_a), F.col(sketch_b)
    used = _filled(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    same = used - _filled(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    na, nb = F.col(n_a).cast("double"), F.col(n_b).cast("double")
    chance = used * (COLLISION * 4 / 2**MANTISSA) * na * nb / ((na + nb) * (na + nb))
    return (same - chance) / (used - chance), used


def _plausible(threshold: float) -> F.Column:
    j, used = estimate("a.sketch", "b.sketch", "a.n", "b.n")
    smaller = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * (threshold - 1e-9)
    return smaller & (j >= threshold - 5 * F.sqrt(threshold * (1 - threshold) / used))


def _joined(stream):
    """Union-find over the links of one task: (id, the smallest id of its component)."""
    low: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while low[root] != root:
            root = low[root]
        while low[x] != root:
            low[x], x = root, low[x]
        return root

    for batch in stream:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for x in (a, b):
                low.setdefault(x, x)
            a, b = top(a), top(b)
            low[max(a, b)] = min(a, b)
    ids = list(low)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], names=["id", "comp"])


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id that a link (a, b) names.

    Up to LINKS_IN_ONE_TASK links are joined by one task of an executor. More are joined by
    rounds: labels fall to the smallest label among neighbours, then to their label's
    own label, until none changes; long chains shrink by halves.
    """
    spark = links.sparkSession
    links = tables.keep(links.select("a", "b"), "pairs")
    if links.count() <= LINKS_IN_ONE_TASK:
        return tables.keep(links.coalesce(1).mapInArrow(_joined, "id long, comp long"), "joined")
    both = tables.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = tables.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("low"))
        next_ = labels.join(near, labels.id == near.a).select("id", F.least("comp", "low").alias("comp"), F.col("comp").alias("was"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        next_ = next_.join(up, "comp", "left").select("id", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "was")
        next_ = tables.keep(next_, "labels")
        tables.drop(labels)
        if next_.filter("comp < was").isEmpty():
            tables.drop(both)
            return tables.keep(next_.select("id", "comp"), "joined")
        labels = next_.select("id", "comp")
        labels._table_path = next_._table_path


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _share(t: float) -> float:
    """Two sets of the similarity have at least so much of the sum of their sizes in common."""
    return (t - 1e-9) / (1 + t)


def _rarest(left: DataFrame, t: float) -> DataFrame:
    """centre, id, comp, out, n, c, a, rest, g: the shingles g in one of which a text must differ from its centre as any partner does.

    left: centre, id, comp, out, n, c, a, apart. Partners differ alike in `least` shingles at least, whoever they are (the one asking least is of
    a size near the centre's). So one of the rarest that leave out least - 1 of them is alike, in one order for all around a centre; and at the first
    that is, as many as they must share still follow in both: rest. Every row is dealt once to those that differ alike, and rows of shingles that no
    other text has or lacks go there: they come first in the order, so their number is enough.
    """
    near = F.least(F.greatest(F.col("c").cast("double"), F.col("n") * (t - 1e-9)), F.col("n") / (t - 1e-9))
    least = (F.col("n") + near) * _share(t) - F.col("c") + F.col("a") + F.greatest(F.lit(0.0), F.col("c") - near)
    least = F.greatest(F.lit(1), F.ceil(least - 1e-6)).cast("int")
    grams = left.withColumn("n_apart", F.size("apart")).withColumn("rarest", F.col("n_apart") - least + 1).filter("rarest > 0")
    grams = grams.select("centre", "id", "comp", "out", "n", "c", "a", "n_apart", "rarest", F.explode("apart").alias("g"))
    alike, own = W.partitionBy("centre", "g"), W.partitionBy("centre", "id")
    holders = {"m": F.count("*"), "h1": F.bit_xor(F.xxhash64("id")), "h2": F.bit_xor(F.xxhash64("id", F.lit(1)))}
    grams = grams.withColumns({k: v.over(alike) for k, v in holders.items()}).filter("m > 1")
    order = own.orderBy("m", "h1", "h2", "g")
    grams = grams.withColumn("at", F.col("n_apart") - F.count("*").over(own) + F.row_number().over(order)).filter("at <= rarest")
    # Shingles that the very same texts have or lack (those of one edit, say) bring the same pairs: the first of them does.
    same = W.partitionBy("centre", "id", "m", "h1", "h2").orderBy("g")
    grams = grams.withColumn("nth", F.row_number().over(same)).filter("nth = 1")
    return grams.select("centre", "id", "comp", "out", "n", "c", "a", (F.col("n_apart") - F.col("at") + 1).alias("rest"), "g")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links at 100 * intersection >= percent * union."""
    spark, tables, t = docs.sparkSession, Tables(docs.sparkSession), percent / 100
    rows = with_columns_renamed_apart(docs, {id_col: "id", text_col: "text"}).select(F.col("id").cast("long"), F.col("text").cast("string"))
    sketched = tables.keep(rows.mapInArrow(_sketch, "id long, n long, f1 long, f2 long, sketch array<long>"), "sketch")
    keys = ["f1", "f2", "n"]
    # A node is a distinct set, whatever the ids of its rows; `id` from here on is a node's hash, `rep` the smallest id of its rows.
    node = F.xxhash64(*keys).alias("id")
    folded = tables.keep(sketched.filter("n > 0 AND id IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("rep")).select(node, *keys, "rep"), "nodes")
    reps = sketched.withColumnRenamed("id", "rep").join(folded.select("rep", *keys), ["rep", *keys], "left_semi").select(node, "n", "sketch").dropDuplicates(["id"])
    # One key for band and registers; empty bands stand for nothing and make no bucket.
    bands = reps.select("id", F.posexplode("sketch").alias("band", "key")).filter("key <> 0").select("id", F.xxhash64("band", "key").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("hub")).filter("m > 1")
    members = tables.keep(bands.join(full, "key").select("key", "id", "m", "hub"), "members")
    shared = tables.keep(members.select("id").distinct(), "ids")
    small = shared.count() <= BROADCAST_IDS
    of_shared = lambda df: df.join(F.broadcast(shared) if small else shared, "id", "left_semi")
    holders = tables.keep(of_shared(folded).select(F.col("rep").alias("id")).distinct(), "holders")
    texts = rows.join(F.broadcast(holders) if small else holders, "id", "left_semi").select("text")
    sets = tables.keep(of_shared(texts.mapInArrow(_sets, "f1 long, f2 long, n long, set array<long>").select(node, "set")).dropDuplicates(["id"]), "sets")
    sketches = tables.keep(of_shared(reps), "sketches")
    comps = spark.createDataFrame([], "id long, comp long")

    def linked(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Components of the links so far (comps) and those of the pairs; only links between components are followed."""
        a, b = sketches.alias("a"), sketches.alias("b")
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().alias("p")
        pairs = pairs.join(a, F.col("p.x") == F.col("a.id")).join(b, F.col("p.y") == F.col("b.id")).filter(_plausible(t))
        found = _verified(pairs.select(F.col("p.x").alias("a"), F.col("p.y").alias("b")), sets, percent)
        of_a, of_b = (comps.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
        found = found.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
        joined = components(found.filter("a <> b").distinct(), tables)
        if joined.isEmpty():
            return comps
        top = joined.select(F.col("id").alias("was"), F.col("comp").alias("top"))
        new = top.join(comps, F.col("was") == F.col("comp"), "left_anti").select(F.col("was").alias("id"), F.col("top").alias("comp"))
        return tables.keep(comps.join(top, F.col("comp") == F.col("was"), "left").select("id", F.coalesce("top", "comp").alias("comp")).union(new), "comps")

    def still_open(of: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of buckets in more than one component, with the component most members are in."""
        now = of.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        per = now.groupBy("key", "comp").agg(F.count("*").alias("m"))
        most = per.groupBy("key").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")
        return now.join(most, "key")

    def crossing(now: DataFrame, more=True) -> DataFrame:
        """Pairs of different components, one outside the main one, each once per bucket."""
        o, w = now.filter("comp <> main").alias("o"), now.alias("w")
        once = (F.col("w.comp") == F.col("w.main")) | (F.col("o.id") < F.col("w.id"))
        pairs = o.join(w, (F.col("o.key") == F.col("w.key")) & (F.col("o.comp") != F.col("w.comp")) & once & more)
        return pairs.select(F.col("o.id").alias("x"), F.col("w.id").alias("y"))

    fits = F.least("o.n", "w.n") >= F.greatest("o.n", "w.n") * (t - 1e-9)
    sizes = sketches.select("id", "n")
    comps = linked(members.filter("id <> hub").select(F.col("hub").alias("x"), F.col("id").alias("y")), comps)
    comps = linked(crossing(still_open(members.filter(f"m <= {SMALL}"), comps).join(sizes, "id"), fits), comps)
    large = members.filter(f"m > {SMALL}")
    now = tables.keep(still_open(large, comps), "open")
    if not now.isEmpty():
        ids = now.select("id").distinct()
        held = sets.join(ids, "id", "left_semi").select("id", F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("m"), F.min("id").alias("id"))
        private = held.filter("m = 1").groupBy("id").agg(F.count("*").alias("own"))
        traits = tables.keep(ids.join(sizes, "id").join(private, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own")), "traits")
        # Nothing outside its private shingles is left that could reach the similarity: such a text links with none here.
        traits = traits.filter(F.col("n") - F.col("own") >= F.col("n") * (t - 1e-9))
        hubs = tables.keep(now.join(traits, "id").groupBy("key").agg(F.min_by("id", F.struct(F.col("own") / F.col("n"), "id")).alias("centre")), "hubs")
        of_hub = tables.keep(now.join(hubs, "key").join(traits, "id").filter("id <> centre").select("centre", "id", "n").distinct(), "of_hub")
        comps = linked(of_hub.select(F.col("centre").alias("x"), F.col("id").alias("y")), comps)
        # Where each differs from its centre: what it lacks (a) and what it has beside it. Two texts share what the centre has, less what
        # either lacks: |c| - a - a', and where they differ from it alike. So they must differ alike in `must` shingles at least.
        own_set, centre_set = sets.withColumnRenamed("set", "own_set"), sets.select(F.col("id").alias("centre"), F.col("set").alias("centre_set"))
        lacks = F.array_except("centre_set", "own_set")
        apart = of_hub.join(own_set, "id").join(centre_set, "centre")
        apart = apart.select("centre", "id", "n", F.size("centre_set").alias("c"), F.size(lacks).alias("a"), F.concat(F.array_except("own_set", "centre_set"), lacks).alias("apart"))
        left = still_open(large, comps).join(hubs, "key").groupBy("centre", "id", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("out"))
        left = tables.keep(left.join(apart, ["centre", "id"]), "apart")
        o, w = left.filter("out").alias("o"), left.alias("w")
        differ = (F.col("o.comp") != F.col("w.comp")) & (~F.col("w.out") | (F.col("o.id") < F.col("w.id"))) & fits
        must = (F.col("o.n") + F.col("w.n")) * _share(t) - F.col("o.c") + F.col("o.a") + F.col("w.a")
        ends = [F.col("o.id").alias("x"), F.col("w.id").alias("y")]
        with_room = o.join(w, (F.col("o.centre") == F.col("w.centre")) & differ & (must <= 0)).select(*ends)
        # The rest differ alike somewhere.
        grams = tables.keep(_rarest(left, t), "rarest")
        o, w = grams.filter("out").alias("o"), grams.alias("w")
        beside_it = o.join(w, (F.col("o.centre") == F.col("w.centre")) & (F.col("o.g") == F.col("w.g")) & differ & (F.least("o.rest", "w.rest") >= must)).select(*ends)
        comps = linked(tables.keep(with_room.union(beside_it).distinct(), "asked"), comps)
    tables.only(sketched, folded, comps)
    # A component is named by the smallest id of its rows.
    named = folded.join(comps, "id").groupBy("comp").agg(F.min("rep").alias("low"))
    comp_of = folded.join(comps, "id", "left").join(named, "comp", "left").select(*[F.col(k).alias(f"k_{k}") for k in keys], F.coalesce("low", "rep").alias("low"))
    return sketched.join(comp_of, [sketched[k] == F.col(f"k_{k}") for k in keys], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("low", "id") == F.col("id"))).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without the rows whose component holds a smaller doc_id; repeated rows of a kept id stay, and so do all rows of an id of which one is kept."""
    judged = link_components(docs, percent=percent).groupBy("doc_id").agg(F.max("kept").alias("any_kept"))
    gone = sized(Tables(docs.sparkSession), judged.filter("NOT any_kept").select(F.col("doc_id").alias("gone_id")), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(*docs.columns)


#: The same result by joining all shingles, for small inputs.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared_n >= 85 * (x.n + y.n - shared_n)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN low USING (doc_id)
"""


def op9_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"), percent=85)
