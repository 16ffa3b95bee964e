"""Helpers that the training-data operators share.

Word hashing works on the UTF-8 bytes of a whole Arrow string column at once, so no Python object is made per
word.  Everything here runs inside tasks; nothing is gathered on the driver.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 20


#: Rows in an Arrow batch: with texts of some KB a task then holds a few MB of them at a time.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so batches have fewer rows than Spark's usual 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a local master (tests) gets a
    temporary one; a cluster has none that would do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenclip-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes what ``materialize`` has written, once nothing that is still to run reads it."""
    for df in written:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


# ---------------------------------------------------------------------------------------------------- word hashes

_MULT = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _separators(codes: set[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: Words ``[^\x20\x09-\x0D]+``.
SPACE_SEPARATORS = _separators({32, *range(9, 14)})

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 16)
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * STEP_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a few documents: ``hash``, ``doc`` (row in the step), ``start``/``end`` (bytes), ``first``
    (index of each document's first word, one more at the end)."""

    __slots__ = ("data", "doc", "end", "first", "hash", "offsets", "sep", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool) -> None:
        n = len(data)
        self.data, self.offsets, self.sep = data, offsets, separators[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = self.sep[:-1]
        before |= edge[:n]
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = self.sep[1:]
        after |= edge[1 : n + 1]
        word = ~self.sep
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        value = _BYTES[_LOWER[data] if lower else data]
        value *= _power(_BASE, n, "up")
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        raw = (total[self.end] - total[self.start]) * _power(pow(_BASE, -1, 1 << 64), n, "down")[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(_MULT))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def shingles(self, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words and its document; in word order."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(_MULT) + self.hash[i : i + n])
        same = self.doc[:n] == self.doc[k - 1 :]
        return out[same], self.doc[:n][same]


def steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a string column with their bytes and offsets, about STEP_BYTES at a time; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: What empties the caches that this worker process holds.
held_caches: list = []


def words_of(column: pa.Array, lower: bool, separators: np.ndarray = SPACE_SEPARATORS) -> Iterator[tuple[int, int, Words]]:
    while held_caches:  # of tokenizers: a worker that goes on to other work gives them back
        held_caches.pop()()
    for a, b, data, offsets in steps(column):
        yield a, b, Words(data, offsets, separators, lower)


def label_fold(folds: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % F.lit(folds)


def quiet_threads() -> None:
    """One thread for each task: Spark already runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


#: Bits of the filter in ``may_be_among``: 4,096 rows of 4 KiB, whatever the input.
FILTER_BITS = 1 << 27


def may_be_among(df: DataFrame, key, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``key`` (a long expression) may be in the one column of ``wanted``, and the others.

    A bitmap of a fixed size says so, and is all that is broadcast: rows that it lets through still have to be joined,
    rows that it doesn't need no shuffle.  With very many wanted keys it lets more through, never less.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = wanted.select(F.pmod(F.xxhash64(wanted.columns[0]), F.lit(FILTER_BITS)).alias("p"))
    bits = bits.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.expr("bitmap_construct_agg(p & 32767)").alias("bitmap"))
    # As longs, most significant byte first, which a bit is quickly read from.
    words = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(bitmap, i * 8 + 1, 8)), 16, -10) AS bigint))")
    words = materialize(materialize(bits).select("bucket", words.alias("words")))
    # The caller's columns stay in a struct of their own, so that none can clash.
    marked = df.select(F.struct("*").alias("row"), F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(32767).cast("int").alias("bit"))
    marked = marked.join(F.broadcast(words), "bucket", "left")
    here = F.coalesce(F.expr("bit_get(words[bit div 64], (7 - bit div 8 % 8) * 8 + bit % 8)") == 1, F.lit(False))
    return marked.where(here).select("row.*"), marked.where(~here).select("row.*")
