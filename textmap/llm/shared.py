"""Helpers of the training-data operators: word hashes and shared tables.

Words are runs without ASCII white space. A word's code is a 64-bit hash that
depends on its bytes alone, so equal words have equal codes in every document
and every task. Codes come from prefix sums over whole buffers of text, so a
batch costs a few passes of numpy and no Python loop over words.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
PIECE = 1 << 19  # bytes hashed at once; what a task holds for this is about 40 times as much

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_P = U(0x9E3779B97F4A7C15)
_PINV = U(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, PIECE + (1 << 16))
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = U(1)
        with np.errstate(over="ignore"):
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        if size > 4 * PIECE:  # a huge word: not kept
            return up, down
        _powers.update(p=up, q=down)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _piece_codes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and start bytes of the words of one buffer."""
    a = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[a], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _powers_of(len(a))
    with np.errstate(over="ignore"):
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(data: bytes):
    """Parts of a long text, cut at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end] not in b" \t\n\r\v\f":
            end += 1
        yield data[at:end]
        at = end


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, and where each text's words begin (one more entry ends the last)."""
    codes, counts, at = [], [], 0
    while at < len(texts):
        if len(texts[at]) > PIECE:
            own = [_piece_codes(x)[0] for x in _pieces(texts[at])]
            codes += own
            counts.append([sum(map(len, own))])
            at += 1
            continue
        end, size = at, 0
        while end < len(texts) and (size := size + len(texts[end]) + 1) <= PIECE + 1:
            end += 1
        c, start = _piece_codes(b"\n".join(texts[at:end]))
        first = np.cumsum([0] + [len(x) + 1 for x in texts[at:end]])
        counts.append(np.diff(np.searchsorted(start, first)))
        codes.append(c)
        at = end
    bounds = np.concatenate([[0], *counts]).cumsum()
    return np.concatenate(codes) if codes else np.zeros(0, np.uint64), bounds


def ngrams(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words (runs may cross the ends of texts; the caller keeps those inside one)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = codes[:m].copy()
        for k in range(1, n):
            out = out * _P + codes[k : k + m]
    return mix(out)


def text_batches(column: pa.Array, size: int = PIECE):
    """(first row, end, texts as bytes) of a column of strings, in parts of at most about `size` bytes: only one part is held as Python objects."""
    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + size, side="right")) - 1)
        yield at, end, [x or b"" for x in column.slice(at, end - at).to_pylist()]
        at = end
    pa.default_memory_pool().release_unused()  # workers live on: they give back what batches took


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def workspace(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares (spark.checkpoint.dir).

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    elif base.startswith("/") and spark.sparkContext.master.startswith("local"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/textmap-{uuid.uuid4().hex}"


#: Rows of an Arrow batch of texts at most: what the JVM and a Python worker hold of them at once, some copies each.
BATCH_ROWS = 1000


def with_small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS; its own setting stays if that is smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Tables:
    """Intermediate tables in the shared folder: they cut lineage and outlive executors.

    Without a folder of the caller's they are temporary: they go when the driver ends, or before
    that where `drop` and `only` say so.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.base, self.n = spark, folder.rstrip("/") if folder else workspace(spark), 0
        self.kept: list[str] = []
        with_small_batches(spark)
        if not folder:
            fs, at = self._at(self.base)
            fs.mkdirs(at)
            fs.deleteOnExit(at)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        self.kept.append(path)
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later step reads."""
        self._free(df._table_path)

    def only(self, *used: DataFrame) -> None:
        """Frees all tables but these."""
        held = {getattr(df, "_table_path", None) for df in used}
        for path in [p for p in self.kept if p not in held]:
            self._free(path)

    def _free(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)
        self.kept.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; dealt to all cores if its files have fewer parts than those (a single small file, say)."""
    with_small_batches(spark)
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of ids and small values that are sent to all tasks at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sized(tables: Tables, df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df as a kept table, to be broadcast if it has at most so many rows."""
    from pyspark.sql import functions as F

    kept = tables.keep(df, name)
    return F.broadcast(kept) if kept.count() <= rows else kept


def with_columns_renamed_apart(df: DataFrame, keep: dict[str, str]) -> DataFrame:
    """Only the wanted columns, under the operator's own names; others can't clash with them."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in keep.items()])
