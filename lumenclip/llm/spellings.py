"""Spelling variant grouping (11): words one edit apart, by tiles of padded code-point matrices.

Runs of Latin letters are counted over all documents; frequent ones are words.  Two words are near if one code point put
in, taken out or replaced turns one into the other: then, with the longer one's length m, their common prefix and
suffix have m - 1 code points or more together.

1. Each task sums up a text's runs before anything is shuffled.  (A run may first lose a code point, by a hash: the
   errors that the operator is to find are planted so.)
2. Which words to compare: the m places of the longer word are dealt into windows of a few places.  The edit lies in one
   window, and what stands before and behind it is equal, so a word has a row for each window with a hash of the rest,
   once for pairs in which it is as long as the longer one and once for those in which it is the shorter.  Words that
   share such a row differ within the window's places only: of WIDTH = 2 places and the 90 letters there are at most
   90 * 90 + 90, however large the table, so no group grows with the data.  Words of over 2 * WINDOWS code points have
   wider windows, WINDOWS of them, so that their rows stay few.
3. Rows are sorted by that key within partitions and cut into blocks; a block is a padded matrix of code points.  A
   block is compared with itself and with those behind it as long as keys run on: equality of all its words with all of
   the other's, place by place, gives common prefixes; from the ends, common suffixes.  Each near pair is kept in the
   one window that holds the end of its common prefix, so it comes out once.
4. A word's form is its near word with the most occurrences, if that has ``times`` as many; forms are followed to the
   last by doubling: counts grow ``times``-fold with every step, so there are few.

A missing doc_id counts as the empty text in that hash.  Null and empty texts have no words.  Very long texts are worked
on alone; a very long word is in a tile of its own.  Repeated rows count as often as they occur.  Ties go to the first
word in code-point order.  Other columns are not looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import discard, documents, materialize, mix

#: Places in a window, and the most windows that a word has.
WIDTH, WINDOWS = 2, 32
#: Rows of a block of words, and code points that a tile compares at a time.
BLOCK, CELLS = 64, 1 << 22
#: Distinct words that a task counts before it gives them back.
KEEP = 200_000

#: Letters stay, A-Z in lower case; all else separates.
_LETTERS = bytes(32 if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 192) else b + 32 if b <= 90 else b for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str) -> Counter[bytes]:
    """The runs of letters of a text, lower-cased, in Latin-1, with their counts."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())


def planted(run: bytes, seed: int, modulus: int) -> bytes:
    """``run`` without one code point where its hash says so; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % modulus:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = 6, modulus: int | None = 199) -> DataFrame:
    """word, n: the runs of at least ``least_letters`` code points, after the planted losses (none, if no modulus)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, n in runs(text or "").items():
                    if len(run) >= least_letters:
                        word = planted(run, seed, modulus) if modulus else run
                        if len(word) >= least_letters:
                            total[word] += n
            if len(total) > KEEP:
                yield from _counted(total)
                total.clear()
        yield from _counted(total)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[bytes]) -> Iterator[pa.RecordBatch]:
    words = list(total)
    for i in range(0, len(words), 20_000):
        part = words[i : i + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([total[w] for w in part], pa.int64())], names=["word", "n"])


def window_width(m: int) -> int:
    return max(WIDTH, -(-m // WINDOWS))


def _hashes(words: np.ndarray) -> np.ndarray:
    """A hash of each row of code points, of one length."""
    h = np.full(len(words), words.shape[1], np.uint64)
    for c in range(words.shape[1]):
        h = mix(h * _MULT + words[:, c].astype(np.uint64))
    return h


def window_keys(words: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray]]:
    """For words of one length (rows of code points), m or m - 1: each window's first place and the hash of the rest."""
    width, n = window_width(m), words.shape[1]
    for at in range(0, m, width):
        behind = max(0, m - at - width)  # code points behind the window, as many in the shorter word
        yield at, mix(_hashes(words[:, :at]) * _MULT + _hashes(words[:, n - behind :]) + np.uint64(m * 65536 + at))


def windows(words: DataFrame) -> DataFrame:
    """key, longer (as long as the longer word of its pairs), at (its window's first place), word, n."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            length, number = np.array([len(w) for w in word], int), np.asarray(batch.column("n"))
            parts = []
            for n in np.unique(length).tolist():
                of = np.flatnonzero(length == n)
                points = np.frombuffer(b"".join(word[i] for i in of), np.uint8).reshape(-1, n)
                parts += [(key.view(np.int64), np.full(len(of), m == n), np.full(len(of), at, np.int32), of) for m in (n, n + 1) for at, key in window_keys(points, m)]
            if parts:
                key, longer, at, of = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(longer), pa.array(at), pa.array(word, pa.binary()).take(pa.array(of)), pa.array(number[of])], names=["key", "longer", "at", "word", "n"])

    return words.mapInArrow(emit, "key long, longer boolean, at int, word binary, n long")


class _Block:
    """Some words as padded matrices, from their beginnings and from their ends."""

    def __init__(self, key: np.ndarray, longer: np.ndarray, at: np.ndarray, word: list[bytes], n: np.ndarray) -> None:
        self.key, self.longer, self.at, self.word, self.n = key, longer, at, word, n
        self.length = np.array([len(w) for w in word])
        wide = int(self.length.max())
        self.head = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in word), np.uint8).reshape(-1, wide)
        self.tail = np.frombuffer(b"".join(w[::-1].ljust(wide, b"\0") for w in word), np.uint8).reshape(-1, wide)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading code points each row of ``a`` shares with each of ``b``; padding differs from all letters, and
    is not counted as callers take the lesser of this and the words' lengths."""
    wide = min(a.shape[1], b.shape[1])
    same = a[:, None, :wide] == b[None, :, :wide]
    return np.where(same.all(2), wide, same.argmin(2))


def compared(x: _Block, y: _Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near pairs of the two blocks that belong to a shared key; each pair once."""
    rows = max(1, CELLS // (len(y.word) * min(x.head.shape[1], y.head.shape[1])))
    left, right = [], []
    for a in range(0, len(x.word), rows):
        part = slice(a, a + rows)
        shorter = np.minimum(x.length[part, None], y.length[None])
        longer = np.maximum(x.length[part, None], y.length[None])
        prefix = np.minimum(_common(x.head[part], y.head), shorter)
        suffix = np.minimum(_common(x.tail[part], y.tail), shorter)
        near = (longer - shorter <= 1) & (prefix + suffix >= longer - 1) & (prefix < longer)
        near &= (x.key[part, None] == y.key[None]) & (x.at[part, None] == y.at[None]) & (x.longer[part, None] | y.longer[None])
        width = np.array([window_width(m) for m in range(int(longer.max()) + 1)])[longer]
        near &= prefix // width * width == x.at[part, None]
        if same:
            near &= np.arange(len(x.word))[part, None] < np.arange(len(y.word))[None]
        i, j = np.nonzero(near)
        left.append(i + a)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: each near pair both ways round, once."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[_Block] = []
        for block in _blocks(batches):
            open_ = [b for b in open_ if b.key[-1] == block.key[0]]
            for b in [*open_, block]:
                i, j = compared(b, block, b is block)
                if len(i):
                    p, q = [b.word[k].decode("latin-1") for k in i], [block.word[k].decode("latin-1") for k in j]
                    yield pa.RecordBatch.from_arrays([pa.array(p + q, pa.string()), pa.array(q + p, pa.string()), pa.array(np.concatenate([block.n[j], b.n[i]]))], names=["word", "near", "near_n"])
            open_.append(block)

    return windows(words).repartition("key").sortWithinPartitions("key").mapInArrow(tiles, "word string, near string, near_n long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Sorted rows in blocks of at most BLOCK; a row whose key no other row has is left out."""
    last, paired_before = None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch] if last is None else [*last.to_batches(), batch])
        key = np.asarray(rows["key"])
        again = key[1:] == key[:-1]
        paired = np.concatenate([again, [False]]) | np.concatenate([[paired_before], again])
        # The last row waits for what follows it.
        yield from _cut(rows.slice(0, len(key) - 1), paired[:-1])
        last, paired_before = rows.slice(len(key) - 1), bool(paired[-1])
    if last is not None:
        yield from _cut(last, np.array([paired_before]))


def _cut(rows: pa.Table, wanted: np.ndarray) -> Iterator[_Block]:
    rows = rows.filter(pa.array(wanted))
    for a in range(0, len(rows), BLOCK):
        part = rows.slice(a, BLOCK)
        yield _Block(*(part[c].to_numpy() for c in ("key", "longer", "at")), part["word"].to_pylist(), part["n"].to_numpy())


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words (word, form) that have a form."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, now = now, materialize(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(last)
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_groups(docs: DataFrame, least_letters: int = 6, least: int = 5, times: int = 5, modulus: int | None = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` (doc_id, text)."""
    words = materialize(word_counts(docs, least_letters, modulus).where(F.col("n") >= least))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    named = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    known = materialize(named.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    discard(words)
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE k AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
r AS (
  SELECT doc_id, run, count(*)::BIGINT AS n
  FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM r),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(range(length(b) // 2), lambda c, i: xor(c >> 8, t[xor(c & 255, ('0x' || b[2 * i + 1:2 * i + 2])::BIGINT) + 1]), 4294967295)) AS h FROM x, k),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(generate_series(1, length(word))) AS s(i)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
g AS (SELECT word, count(*)::BIGINT AS n_near, min((-near_n, near)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n FROM w LEFT JOIN g USING (word)),
o AS (SELECT word, word AS root, form AS further FROM f UNION ALL SELECT o.word, f.word, f.form FROM o JOIN f ON f.word = o.further)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN o ON o.word = f.word AND o.further IS NULL
"""
