"""Byte-level BPE encoding and decoding (4) by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Each adjacent pair that is in the vocabulary waits in the bucket of its
merge rank; a three-level bitmap over the ranks has a bit for each bucket with entries, and find-first-set on the
levels gives the lowest rank.  Entries are not removed when a merge changes their pair: a popped entry whose pair no
longer has that rank is skipped.  A bucket is a heap of positions, as equal ranks merge from the left and later entries
may lie before earlier ones: a merge costs the logarithm of its bucket's size, so very long pre-tokens take little more
time than in proportion to their bytes.

Null and empty texts have no tokens.  Very long texts are encoded whole.  Repeated rows are encoded as often as they
occur.  Of equal ranks the leftmost merges first.  Other columns are not looked at, whatever their names.  An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenclip.llm.common import documents
from lumenclip.llm.tokens import ENTRY_BYTES, KEPT_PIECE, TextEncoder, text_steps

#: Bytes of pre-tokens and their ids that a worker keeps; long pre-tokens aren't kept.
KEPT_BYTES = 128 << 20
_BIT = [1 << i for i in range(64)]

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairs:
    """Encodes pre-tokens; the queue is empty between them, so its bitmap is made once.

    Two levels of the bitmap are lists of 64-bit words and the third, ``top``, is one word: 64 ** 3 ranks at most.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        words = (max(ranks.values()) >> 6) + 1
        assert words <= 1 << 12
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.low, self.high = [0] * words, [0] * ((words + 63) >> 6)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the lowest rank merges first, the leftmost of equal ones."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, low, high, top = len(piece), ranks.get, self.low, self.high, 0
        buckets: dict[int, list[int]] = {}
        end = list(range(1, n + 1))  # where the token that starts here ends; the next token starts there
        before = list(range(-1, n - 1))
        pair = [get(piece[i : i + 2]) for i in range(n - 1)]  # the rank of this token joined with the next
        pair.append(None)
        fresh = [i for i in range(n) if pair[i] is not None]
        while True:
            for i in fresh:
                rank = pair[i]
                own = buckets.get(rank)
                if own is not None:
                    heappush(own, i)
                    continue
                buckets[rank] = [i]
                w = rank >> 6
                x = low[w]
                low[w] = x | _BIT[rank & 63]
                if not x:
                    v = w >> 6
                    x = high[v]
                    high[v] = x | _BIT[w & 63]
                    if not x:
                        top |= _BIT[v]
            if not top:
                break
            v = (top & -top).bit_length() - 1
            x = high[v]
            w = (v << 6) + (x & -x).bit_length() - 1
            x = low[w]
            bit = x & -x
            rank = (w << 6) + bit.bit_length() - 1
            own = buckets[rank]
            i = heappop(own)
            if not own:
                del buckets[rank]
                low[w] = x = x ^ bit
                if not x:
                    high[v] = x = high[v] ^ _BIT[w & 63]
                    if not x:
                        top ^= _BIT[v]
            fresh = []
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            stop = end[i] = end[j]
            pair[i] = pair[j] = None
            if stop < n:
                before[stop] = i
                pair[i] = rank = get(piece[i : end[stop]])
                if rank is not None:
                    fresh.append(i)
            h = before[i]
            if h >= 0:
                pair[h] = rank = get(piece[h:stop])
                if rank is not None:
                    fresh.append(h)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class PieceEncoder:
    """Ids of chunks: each match of the pattern separately, distinct matches once in a while."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        assert max(ranks.values()) < 1 << 16
        self.pairs, self.find, self.known = BytePairs(ranks), regex.compile(pattern).findall, {}

    def piece(self, piece: str) -> bytes:
        ids = array("H", self.pairs.encode(piece.encode())).tobytes()
        if len(piece) <= KEPT_PIECE:
            self.known[piece] = ids
        return ids

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) * ENTRY_BYTES > KEPT_BYTES:
            self.known = {}
        known, find, piece = self.known, self.find, self.piece
        return [b"".join([known.get(p) or piece(p) for p in find(c)]) for c in chunks]


_encoders: dict[tuple[str, str], tuple[TextEncoder, BytePairs]] = {}


def rank_encoder(path: str, pattern: str) -> tuple[TextEncoder, BytePairs]:
    have = _encoders.get((path, pattern))
    if have is None:
        encoder = PieceEncoder(read_ranks(path), pattern)
        have = _encoders[path, pattern] = TextEncoder(encoder, encoder, keeps_space=True), encoder.pairs
    return have


def byte_level_bpe(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of the ids and of the bytes decoded from them."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pairs = rank_encoder(rank_file, pattern)
        size = max(pairs.token) + 1
        shown = [str(i) for i in range(size)]
        token = [pairs.token.get(i, b"") for i in range(size)]
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, _, texts in text_steps(batch, "text"):
                every, offsets = encoder.encode(texts)
                n += np.diff(offsets).tolist()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ids = every[a:b].tolist()
                    of_ids.append(hashlib.sha256(" ".join([shown[i] for i in ids]).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(b"".join([token[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(code, ENCODED)


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_level_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
