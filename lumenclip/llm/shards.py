"""Token-id shards with keyed access (5).

Documents are encoded where they are read, their ids range-partitioned by doc_id and cut into blocks of about
``block_ids`` ids.  A block is one record
of the file format: its ids as raw little-endian unsigned 16-bit integers, and an index of its documents.  The index
is a minimal perfect hash (hash and displace: keys fall into small buckets, and each bucket gets the first seed that
sends its keys to free slots), with a 32-bit fingerprint, an offset and a length in each slot, so a lookup takes
constant time and knows a key that isn't there.  Records lie in Parquet files that Spark writes and commits, so a lost
executor's half-written shard never counts, and any store that Spark can write to will do.

Null and empty texts have the end id alone.  A very long text is encoded whole, and a block of its own if need be.
Repeated doc_ids keep all their rows, in any order, told apart by their number within a shard; rows without an id come
first.  Other columns are not looked at, whatever their names.  An empty table writes no blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.llm.common import blocks_for, discard, documents, materialize, mix, shared_dir
from lumenclip.llm.tokens import library_encoder, text_steps, with_end

BLOCK = "shard int, block int, first_key long, last_key long, n_docs long, n_ids long, keys binary, repeats binary, payload binary, displacements binary, fingerprints binary, offsets binary"
READ = "shard int, block int, doc_id long, local_start long, n_tokens long, ids_crc32 long"
#: Stands for a missing doc_id among the keys.
NO_KEY = np.int64(np.iinfo(np.int64).min)


def _key_hash(keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    return mix(mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ repeats.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _slots(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes + seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over the (distinct) hashes of a block's keys."""

    BUCKET = 4

    def __init__(self, displacements: np.ndarray, n: int) -> None:
        self.displacements, self.n = displacements, n

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = -(-n // cls.BUCKET)
        displacements, taken = np.zeros(buckets, np.uint32), np.zeros(n, bool)
        bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket.astype(np.int64), minlength=buckets)
        first = np.cumsum(count) - count
        for b in np.argsort(-count, kind="stable"):
            if not count[b]:
                break
            own = hashes[order[first[b] : first[b] + count[b]]]
            base = 0
            while True:  # a stretch of seeds at a time
                seeds = np.arange(base, base + 256, dtype=np.uint64)
                slots = (mix(own[None, :] + seeds[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                good = ~taken[slots].any(1)
                if len(own) > 1:
                    ordered = np.sort(slots, 1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    displacements[b] = base + k
                    taken[slots[k]] = True
                    break
                base += 256
        return cls(displacements, n)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        bucket = ((hashes >> np.uint64(32)) % np.uint64(len(self.displacements))).astype(np.int64)
        return _slots(hashes, self.displacements[bucket], self.n)


def _record(shard: int, block: int, key: np.ndarray, repeat: np.ndarray, lengths: np.ndarray, payload: bytes) -> tuple:
    starts = np.cumsum(lengths) - lengths
    hashes = _key_hash(key, repeat)
    index = PerfectHash.build(hashes)
    slot = index.slot(hashes)
    fingerprints, offsets = np.zeros(len(key), "<u4"), np.zeros((len(key), 2), "<i8")
    fingerprints[slot] = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    offsets[slot, 0], offsets[slot, 1] = starts, lengths
    return (shard, block, int(key[0]), int(key[-1]), len(key), int(lengths.sum()), key.tobytes(), repeat.astype("<u4").tobytes(), payload, index.displacements.astype("<u4").tobytes(), fingerprints.tobytes(), offsets.tobytes())


class BlockReader:
    """Keyed access to one record."""

    def __init__(self, record: dict) -> None:
        self.ids = np.frombuffer(record["payload"], "<u2")
        self.keys = np.frombuffer(record["keys"], "<i8")
        self.repeats = np.frombuffer(record["repeats"], "<u4")
        self.hash = PerfectHash(np.frombuffer(record["displacements"], "<u4"), int(record["n_docs"]))
        self.fingerprints = np.frombuffer(record["fingerprints"], "<u4")
        self.offsets = np.frombuffer(record["offsets"], "<i8").reshape(-1, 2)

    def locate(self, keys: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length for each key; -1 and 0 where the fingerprint says that it isn't here."""
        hashes = _key_hash(keys, repeats)
        slot = self.hash.slot(hashes)
        here = self.fingerprints[slot] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return np.where(here, self.offsets[slot, 0], -1), np.where(here, self.offsets[slot, 1], 0)

    def get(self, key: int, repeat: int = 0) -> np.ndarray | None:
        (start,), (length,) = self.locate(np.array([key], np.int64), np.array([repeat], np.uint32))
        return None if start < 0 else self.ids[start : start + length]


def encoded(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit), encoded where the texts are read."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, keeps_space)
        for batch in batches:
            for a, b, texts in text_steps(batch, "text"):
                ids, offsets = with_end(*encoder.encode(texts), end_id)
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((offsets * 2).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids.astype("<u2")))])
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")).slice(a, b - a), raw.cast(pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_ids: int = 1 << 18, per_shard: int = 20_000, keeps_space: bool = False) -> None:
    """Writes the ids of ``docs`` in ascending doc_id order under ``path``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, last, held, size = TaskContext.get().partitionId(), 0, (None, 0), [], 0

        def full() -> pa.RecordBatch:
            key, repeat, length = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = _record(shard, block, key, repeat, length, b"".join([x for h in held for x in h[3]]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            key = batch.column(batch.schema.get_field_index("doc_id")).fill_null(int(NO_KEY)).to_numpy()
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            length = np.array([len(x) // 2 for x in ids], np.int64)
            at = np.arange(len(key))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(new, at, 0))
            repeat = at - first
            if len(key) and last[0] == key[0]:
                repeat[first == 0] += last[1] + 1
            if len(key):
                last = (key[-1], int(repeat[-1]))
            ends, a = np.cumsum(length), 0
            while a < len(key):
                before = ends[a - 1] if a else 0
                b = int(np.searchsorted(ends, before + block_ids - size, "right"))
                if b == a and not held:
                    b = a + 1  # longer than a block
                if b > a:
                    held.append((key[a:b], repeat[a:b], length[a:b], ids[a:b]))
                    size += int(ends[b - 1] - before)
                if b < len(key):
                    yield full()
                    block, held, size = block + 1, [], 0
                a = b
        if held:
            yield full()

    # The places by chance are written, so they stay what they are; they spread the rows of one id, or without one.
    rows = materialize(encoded(docs, tokenizer, end_id, keeps_space).withColumn("deal", F.rand(5)))
    order = (F.asc_nulls_first("doc_id"), F.asc("deal"))
    dealt = rows.repartitionByRange(blocks_for(rows.count(), per_shard), *order).sortWithinPartitions(*order).select("doc_id", "ids")
    dealt.mapInArrow(write, BLOCK).write.option("compression", "zstd").mode("overwrite").parquet(path)
    discard(rows)


_BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_BLOCK_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in BLOCK.split(", ")]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.  Each is looked up through the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = BlockReader(row)
                start, length = block.locate(block.keys, block.repeats)
                crc = [zlib.crc32(block.ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                n = len(block.keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(block.keys, mask=block.keys == NO_KEY), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[x.split()[0] for x in READ.split(", ")],
                )

    blocks = spark.read.schema(BLOCK).parquet(path)
    # Prefix sums over the blocks: within each shard by a window, over shards by one more over a row for each shard.
    per_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    inner = blocks.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("block_base"))
    places = inner.join(base, "shard").select("shard", "block", (F.col("shard_base") + F.col("block_base")).alias("base"))
    found = blocks.mapInArrow(read, READ)
    return found.join(places, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, repeat, n_tokens, ids of those of ``keys`` (doc_id) that the files have.

    The blocks' key ranges name the blocks that may hold a key (equi-joined by coarse ranges of keys); within a block
    the perfect hash says where, and the fingerprint whether.
    """
    blocks = spark.read.schema(BLOCK).parquet(path)
    span = blocks.where(F.col("first_key") > int(NO_KEY)).agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"), F.count("*").alias("n")).first()
    if not span.n:
        return spark.createDataFrame([], "doc_id long, repeat int, n_tokens long, ids array<int>")
    width = max(1, (span.hi - span.lo) // span.n + 1)
    part = lambda c: F.floor((F.greatest(F.col(c), F.lit(span.lo)) - span.lo) / width)
    ranges = blocks.select("shard", "block", "first_key", "last_key", F.explode(F.sequence(part("first_key"), part("last_key"))).alias("part"))
    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").distinct().withColumn("part", part("key"))
    per_block = wanted.join(ranges, "part").where("key BETWEEN first_key AND last_key").groupBy("shard", "block").agg(F.collect_list("key").alias("wanted"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, key = BlockReader(row), np.array(row["wanted"], np.int64)
                # A key's rows have numbers in a row; all that may be here are asked for, in turn.
                low, high = int(block.repeats.min()), int(block.repeats.max())
                for repeat in range(low, high + 1):
                    start, length = block.locate(key, np.full(len(key), repeat, np.uint32))
                    here = np.flatnonzero(start >= 0)
                    own = [block.ids[a : a + n].astype(np.int32) for a, n in zip(start[here].tolist(), length[here].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[here]), pa.array(np.full(len(here), repeat, np.int32)), pa.array(length[here]), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "repeat", "n_tokens", "ids"])

    return blocks.join(per_block, ["shard", "block"]).mapInArrow(find, "doc_id long, repeat int, n_tokens long, ids array<int>")


def op5_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_shards(spark, path)
