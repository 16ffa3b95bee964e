"""Best-fit packing (8): bounded-space online best-fit of tokenized documents into fixed-length sequences.

Each document's ids and an end id are cut into pieces (only where longer than a sequence; the first piece takes the
remainder).  Pieces are dealt by chance over blocks of about ``per_block`` pieces, and each block is packed by one task
with a fixed number of open bins, kept in a bitset keyed by free space; when a bin has to be closed, the fullest is.
The packer is online and takes pieces in any order; a block is sorted in front of it, longest first, as best-fit wastes
least that way.  Blocks share nothing, so work and waste grow with the data and no task sees more than a block.

Null and empty texts give one piece that holds the end id alone.  Very long texts give as many pieces as they need,
and are encoded whole.  Repeated rows, and rows without a doc_id, are packed as often as they occur.  Among pieces of
one length, and bins with one free space, any order will do.  Other columns are not looked at, whatever their names.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import blocks_for, documents
from lumenclip.llm.tokens import library_encoder, text_steps, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, keeps_space=True)
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, texts in text_steps(batch, "text"):
                ids, offsets = with_end(*encoder.encode(texts), end_id)
                length = np.diff(offsets)
                pieces = -(-length // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                end = (length - 1)[doc] % capacity + 1 + piece * capacity
                start = np.where(piece == 0, 0, end - capacity)
                raw = memoryview(ids.astype("<u4")).cast("B")
                cuts = np.stack([offsets[doc] + start, offsets[doc] + end], 1) * 4
                crc = [zlib.crc32(raw[x:y]) for x, y in cuts.tolist()]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


class OpenBins:
    """At most ``most`` open bins.  ``bits`` has a bit for each free space that some open bin has, so the tightest
    bin that still takes a piece is the lowest set bit at or above the piece's length."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        self.open -= 1
        if not own:
            self.bits ^= 1 << free
        return number


def pack(pieces: DataFrame, rows: int, capacity: int = 1024, open_bins: int = 4096, per_block: int = 40_000, longest_first: bool = True) -> DataFrame:
    """``pieces`` with sequence_id and offset.  ``rows`` is about their number and only sets the number of blocks.

    ``longest_first`` sorts each block in front of the packer, which itself is online: best-fit wastes least that way.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, block = OpenBins(capacity, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            placed = np.array([bins.place(n) for n in lengths], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0] + (block << 36)), pa.array(placed[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])

    # A place by chance, not by key: repeated rows, and those without an id, spread over all blocks.
    order = (F.desc("length"), "doc_id", "piece", "start") if longest_first else (F.col("_deal"),)
    dealt = pieces.withColumn("_deal", F.rand(8)).repartition(blocks_for(rows, per_block), "_deal").sortWithinPartitions(*order)
    return dealt.select(pieces.columns).mapInArrow(fill, PACKED)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, open_bins: int = 4096) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, capacity, end_id), docs.count(), capacity, open_bins)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
