"""Whole-text token ids by space-separated chunks, each distinct chunk encoded once in a while.

A byte-level or word-level BPE never merges over a space that starts a chunk, so the ids of a text are the ids of
its chunks in order.  Two kinds of text go to the library whole: those with runs of white space that reach over a
chunk's start, and those that hold the literal of one of the tokenizer's added tokens, which the library looks for
before anything else.

Arrow splits a column of texts and numbers its distinct chunks; Python sees only those, and NumPy puts the ids of all
chunks in order.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenclip.llm.common import held_caches, quiet_threads

#: Bytes of chunks and ids that a worker keeps, and the longest piece that is worth keeping.
CACHE_BYTES, KEPT_PIECE = 128 << 20, 64
#: Bytes of text that are encoded at once.
TEXT_BYTES = 4 << 20
#: What a dictionary entry takes besides its text and ids.
ENTRY_BYTES = 200
#: How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: Of white space beyond ASCII, all has one of these bytes before its last.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Pool:
    """Ids of the chunks seen so far, one after another, and each chunk's number, start and length."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.size = 0

    def numbers(self, chunks: list[str]) -> np.ndarray:
        get = self.number.get
        out = [get(c, -1) for c in chunks]
        missing = [c for c, n in zip(chunks, out, strict=True) if n < 0]
        if missing:
            self._add(list(dict.fromkeys(missing)))
            get = self.number.get
            out = [get(c) for c in chunks]
        return np.array(out, np.int64)

    def _add(self, chunks: list[str]) -> None:
        if not self.number:
            held_caches.append(self.clear)
        raw = self.encode(chunks)
        n, first = len(chunks), len(self.number)
        new = np.frombuffer(b"".join(raw), "<u2")
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        length = np.array([len(x) for x in raw], np.int64) // 2
        self.ids[self.used : self.used + len(new)] = new
        self.length[first : first + n] = length
        self.start[first : first + n] = self.used + np.cumsum(length) - length
        self.used += len(new)
        self.number.update(zip(chunks, range(first, first + n), strict=True))
        self.size += sum(map(len, chunks)) + 2 * len(new) + ENTRY_BYTES * n

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these chunks in order, and where each chunk's begin (one more at the end)."""
        length = self.length[numbers]
        ends = np.concatenate([[0], np.cumsum(length)])
        return self.ids[np.repeat(self.start[numbers] - ends[:-1], length) + np.arange(ends[-1])], ends


class TextEncoder:
    """``encode(texts)`` gives the ids of a column's whole texts, one after another, and their offsets."""

    def __init__(self, chunks: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], keeps_space: bool, literals: list[str] | None = None) -> None:
        self.pool, self.whole, self.keeps_space, self.literals = Pool(chunks), whole, keeps_space, literals or []

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if self.pool.size > CACHE_BYTES:
            self.pool.clear()
        alone = np.zeros(len(texts), bool)
        for literal in self.literals:
            alone |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        if self.keeps_space:
            alone |= _spanning(texts)
        rest = pc.if_else(pa.array(alone), pa.scalar("", pa.large_string()), texts) if alone.any() else texts
        if not self.keeps_space:
            rest = pc.replace_substring(rest, "\n", " ")
        split = pc.split_pattern(rest, " ")
        places = split.offsets.to_numpy()
        places = places - places[0]
        coded = split.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if self.keeps_space:
            numbers = self.pool.numbers([" " + c for c in distinct])[index] if len(index) else np.zeros(0, np.int64)
            heads = index[places[:-1]]
            numbers[places[:-1]] = self.pool.numbers([distinct[i] for i in heads])
        else:
            numbers = self.pool.numbers(distinct)[index]
        ids, ends = self.pool.gather(numbers)
        offsets = ends[places]
        return self._with_whole(texts, alone, ids, offsets) if alone.any() else (ids, offsets)

    def _with_whole(self, texts: pa.LargeStringArray, alone: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(alone)
        found = [np.frombuffer(x, "<u2") for x in self.whole(texts.take(pa.array(at)).to_pylist())]
        parts, a = [], 0
        for i, own in zip(at, found, strict=True):
            parts += [ids[a : offsets[i]], own]
            a = offsets[i + 1]
        length = np.diff(offsets)
        length[at] = [len(x) for x in found]
        return np.concatenate([*parts, ids[a:]]), np.concatenate([[0], np.cumsum(length)])


def _spanning(texts: pa.LargeStringArray) -> np.ndarray:
    """Texts where a match may span a chunk's start: with white space on both sides of a space, or a text's end or start
    for one.  White space beyond ASCII counts by its first bytes, so some more texts are found."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    out = np.zeros(n, bool)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(data):
        return out
    offsets = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    space, wide = _SPACE[data], _WIDE_SPACE[data]
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    before[2:] |= wide[:-2]
    before[3:] |= wide[:-3]
    after = edge[1:].copy()
    after[:-1] |= space[1:] | wide[1:]
    hit = np.flatnonzero((data == 32) & before & after)
    out[np.searchsorted(offsets, hit, "right") - 1] = True
    return out


class LibraryPieces:
    """Ids of chunks by a tokenizer's own normalizer, pre-tokenizer and model.

    Many chunks go through the first two in one joined text, and its pieces fall back to their chunks by offset;
    the model sees each distinct piece once in a while, as pieces are cached too.
    """

    def __init__(self, path: str, keeps_space: bool) -> None:
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        assert tokenizer.get_vocab_size() <= 1 << 16
        self.literals = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.model, self.keeps_space = tokenizer.model, keeps_space
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else None
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()
        if len(piece) <= KEPT_PIECE:
            self.pieces[piece] = ids
        return ids

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library itself."""
        return [array("H", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]

    def alone(self, text: str) -> bytes:
        text = self.normalize(text) if self.normalize else text
        have = self.pieces
        return b"".join([have.get(p) or self.piece(p) for p, _ in self.split(text)])

    def word(self, chunk: str) -> bytes | None:
        """A word of letters (behind a space where spaces are kept), with or without one plain mark behind them: the pieces are clear without a regex."""
        w = chunk[1:] if self.keeps_space else chunk
        if w.isalpha():
            mark = ""
        elif w[:-1].isalpha() and w[-1] in ".,;:!?":
            w, mark = w[:-1], w[-1]
        else:
            return None
        if self.normalize:
            if not w.isascii() and ("\u03a3" in w or not is_normalized("NFC", w)):
                return None
            w = w.lower()
            if not w.isalpha():
                return None
        p = w if w.isascii() else w.encode().decode("latin-1").translate(_VISIBLE)
        p = "\u0120" + p if self.keeps_space else p
        have = self.pieces
        ids = have.get(p) or self.piece(p)
        return ids + (have.get(mark) or self.piece(mark)) if mark else ids

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if len(self.pieces) * ENTRY_BYTES > CACHE_BYTES // 8:
            self.pieces = {}
        quick = {c: ids for c in chunks if (c[:1] == " " or not self.keeps_space) and (ids := self.word(c)) is not None}
        rest = [c for c in chunks if c not in quick]
        quick.update(zip(rest, self.joined(rest), strict=True))
        return [quick[c] for c in chunks]

    def joined(self, chunks: list[str]) -> list[bytes]:
        if self.keeps_space:
            joins = [c for c in chunks if c[:1] == " " and not c[-1].isspace()]
            glue, parts = "", joins
        else:
            joins = [c for c in chunks if c and c.split() == [c]]
            glue, parts = " ", joins
            if joins:
                parts = self.normalize(" ".join(joins)).split(" ") if self.normalize else joins
                if len(parts) != len(joins):
                    joins, parts = [], []
        known: dict[str, bytes] = {}
        if joins:
            have, n = self.pieces, len(glue)
            out: list[list[bytes]] = [[] for _ in joins]
            i, end, own = 0, len(parts[0]), out[0]
            for p, (at, _) in self.split(glue.join(parts)):
                while at >= end + n:
                    i += 1
                    end += n + len(parts[i])
                    own = out[i]
                own.append(have.get(p) or self.piece(p))
            known = dict(zip(joins, map(b"".join, out), strict=True))
        return [known[c] if c in known else self.alone(c) for c in chunks]


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def library_encoder(path: str, keeps_space: bool) -> TextEncoder:
    """One for each worker process; the vocabulary must have at most 65,536 ids."""
    have = _encoders.get((path, keeps_space))
    if have is None:
        pieces = LibraryPieces(path, keeps_space)
        have = _encoders[path, keeps_space] = TextEncoder(pieces, pieces.whole, keeps_space, pieces.literals)
    return have


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at least TEXT_BYTES: the more text is worked on at once, the more often its chunks repeat."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TEXT_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def text_steps(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, pa.LargeStringArray]]:
    """Rows ``[a, b)`` and their texts, about TEXT_BYTES at a time; a longer text is a step of its own, null is empty."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
    a = 0
    while a < len(column):
        b = min(len(column), max(a + 1, int(np.searchsorted(ends, ends[a] + TEXT_BYTES, "right")) - 1))
        yield a, b, column.slice(a, b - a)
        a = b


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` behind each text's, and the new offsets."""
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))
