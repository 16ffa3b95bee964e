"""Phrase collocation mining (13): pairs of frequency-ranked ids counted in tiles, frequent pairs ranked again.

Words are what blanks and tabs separate within pieces, lower-cased (A-Z only); everything is counted for each language.

1. Words are counted, each task's repeats summed up before the shuffle.  Those with ``least`` occurrences are units.
2. The HEAD most frequent units get their rank as an id, the others keep a 63-bit hash.  That table has a fixed size, as
   has the bitmap that tells which other hashes may be units, and both are all that tasks are sent.
3. Tasks turn every text into ids and count pairs of neighbours.  Pairs of low ranks fall into dense tiles, SIDE x SIDE
   arrays that ``bincount`` fills; all other tiles are sparse and kept as sorted coordinates with counts.  Tiles are given
   back as rows, which Spark sums up; a pair with ``least`` occurrences is a frequent phrase.
4. Two neighbouring units that overlap in all words but one make a phrase that is one word longer, so the frequent pairs
   are the next round's units, ranked anew, up to ``longest`` words.  A phrase that reaches ``least`` has only parts that
   do, so nothing is lost by leaving out the others.

Each round reads the texts once; what is shuffled are distinct pairs of units in a task.  Scores are exact decimals.
A hot language costs nothing: pairs are dealt by their ids, and of a ranking only each task's first ``top`` are shuffled.

Null and empty texts have no words; a null language is ``und``.  A very long text is worked on alone, whole.  Repeated
rows count as often as they occur.  Ties are resolved by the ranking's order, which is total.  Other columns are not
looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.llm.common import Words, _separators, discard, documents, materialize, mix, steps

#: Units that have a rank for an id, and the bits of the map of all others: both whatever the input.
HEAD, MAP_BITS = 1 << 16, 1 << 26
#: A tile's side in ranks, and the dense tiles: those of tile numbers that add up to less than DENSE.
SIDE, DENSE = 1024, 4
#: Coordinates that a task keeps before it gives them back.
KEEP = 1 << 20

_BREAKS = _separators(set(b".,;:!?\n\x0b\x0c\r"))
_OUTSIDE = _BREAKS | _separators({9, 32})
_MULT, _SIGN = np.uint64(0x9E3779B97F4A7C15), np.uint64(1 << 63)
_HASHES = np.frombuffer(np.random.default_rng(13).bytes(2048), np.uint64)

UNITS = "lang string, phrase string, h long, f long"


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash, with its sign bit set, of the phrase that two neighbouring units make."""
    return mix(a.astype(np.uint64) * _MULT + b.astype(np.uint64)) | _SIGN


def _lang_hash(lang: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for byte in lang.encode():
        h = mix(h * _MULT + _HASHES[byte])
    return h[0]


class _Text:
    """The words of some documents: ``h``, hashes that tell languages apart, and ``piece``, the piece of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str], known: dict[str, np.uint64]) -> None:
        self.words = w = Words(data, offsets, _OUTSIDE, lower=True)
        for lang in set(langs) - set(known):
            known[lang] = _lang_hash(lang)
        own = np.array([known[x] for x in langs], np.uint64)
        self.h = mix(w.hash + own[w.doc]) | _SIGN
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_BREAKS[data], out=breaks[1:])
        self.piece = breaks[w.start] + w.doc

    def units(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words and, for each, whether the next run and it lie in one piece."""
        h, n = self.h, len(self.h) - k
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        for _ in range(k - 1):
            h = combined(h[:-1], h[1:])
        return h, self.piece[:n] == self.piece[k:]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Text, list[str]]]:
    known: dict[str, np.uint64] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, b, data, offsets in steps(batch.column("text")):
            yield _Text(data, offsets, langs[a:b], known), langs[a:b]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, h, f of all words; a row without a phrase has a language's number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, langs in _texts(batches):
            w = text.words
            h, first, n = np.unique(text.h, return_index=True, return_counts=True)
            low = bytes(np.where((w.data >= 65) & (w.data <= 90), w.data + 32, w.data).astype(np.uint8))
            phrases = [low[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
            of = [langs[d] for d in w.doc[first].tolist()]
            total = np.diff(w.first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of + langs, pa.string()), pa.array(phrases + [None] * len(langs), pa.string()), pa.array(np.concatenate([h.view(np.int64), np.zeros(len(langs), np.int64)])), pa.array(np.concatenate([n, total]).astype(np.int64))],
                names=["lang", "phrase", "h", "f"],
            )

    return docs.mapInArrow(count, UNITS).groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


class _Tiles:
    """Counts of pairs of ids: dense tiles of low ranks, sorted coordinates for the others."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        low = (a >= 0) & (b >= 0) & (a // SIDE + b // SIDE < DENSE)
        x, y = a[low], b[low]
        tile = x // SIDE * DENSE + y // SIDE
        for t in np.unique(tile).tolist():
            at = tile == t
            n = np.bincount(x[at] % SIDE * SIDE + y[at] % SIDE, minlength=SIDE * SIDE)
            if t not in self.dense:
                self.dense[t] = np.zeros(SIDE * SIDE, np.int64)
            self.dense[t] += n
        a, b = a[~low], b[~low]
        self.kept.append(self._sorted(a, b, np.ones(len(a), np.int64)))
        self.size += len(self.kept[-1][0])
        if self.size > KEEP:
            self.kept = [self._sorted(*(np.concatenate(c) for c in zip(*self.kept, strict=True)))]
            self.size = len(self.kept[0][0])
            if self.size > KEEP // 2:
                yield from self.sparse()

    @staticmethod
    def _sorted(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(a):
            return a, b, n
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[new], b[new], np.add.reduceat(n, new)

    def sparse(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            a, b, n = self._sorted(*(np.concatenate(c) for c in zip(*self.kept, strict=True)))
            yield from _pairs(a, b, n)
        self.kept, self.size = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            yield from _pairs(t // DENSE * SIDE + at // SIDE, t % DENSE * SIDE + at % SIDE, counts[at])
        yield from self.sparse()


def _pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000].astype(np.int64)) for c in (a, b, n)], names=["a", "b", "n"])


def _ranked(units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent units, the rank of each, and a bitmap of all units' hashes."""
    head = np.array([r.h for r in units.orderBy(F.desc("f"), "h").select("h").limit(HEAD).collect()], np.int64).view(np.uint64)
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    place = F.pmod("h", F.lit(MAP_BITS))
    parts = units.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(pmod(h, {MAP_BITS}) & 32767)").alias("bitmap"))
    for r in parts.toLocalIterator():
        bits[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bitmap, np.uint8)
    order = np.argsort(head)
    return head[order], order, bits


def _ids(h: np.ndarray, head: np.ndarray, rank: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's id, a rank or the hash itself (negative), and whether it may be a unit's."""
    at = np.minimum(np.searchsorted(head, h), len(head) - 1)
    ranked = head[at] == h
    place = (h & np.uint64(MAP_BITS - 1)).astype(np.int64)
    return np.where(ranked, rank[at], h.view(np.int64)), ranked | ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0)


def longer_units(docs: DataFrame, units: DataFrame, k: int, least: int) -> DataFrame:
    """UNITS of ``k`` + 1 words from those of ``k`` words."""
    sent = docs.sparkSession.sparkContext.broadcast(_ranked(units))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _Tiles()
        for text, _ in _texts(batches):
            h, joined = text.units(k)
            ids, may = _ids(h, *sent.value)
            at = np.flatnonzero(joined & may[:-1] & may[1:]) if len(h) else np.zeros(0, np.int64)
            yield from tiles.add(ids[at], ids[at + 1])
        yield from tiles.rest()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranks back to hashes, and the hash of what the two make."""
        head, order, _ = sent.value
        by_rank = np.zeros_like(head)
        by_rank[order] = head
        for batch in batches:
            a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
            x, y = (np.where(c >= 0, by_rank[np.maximum(c, 0)], c.view(np.uint64)) for c in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (x, y, combined(x, y))] + [batch.column("n")], names=["a", "b", "h", "f"])

    pairs = docs.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = pairs.mapInArrow(named, "a long, b long, h long, f long")
    first = units.select(F.col("h").alias("a"), "lang", "phrase")
    last = units.select(F.col("h").alias("b"), F.substring_index("phrase", " ", -1).alias("word"))
    return pairs.join(first, "a").join(last, "b").select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "h", "f")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """lang, phrase, k, f of all phrases of up to ``longest`` words with ``least`` occurrences; lang, n: each language's
    words; and what was written for both."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts = materialize(word_counts(docs).where((F.col("f") >= least) | F.col("phrase").isNull()))
    totals, units, written = counts.where("phrase IS NULL").select("lang", F.col("f").alias("n")), counts.where("phrase IS NOT NULL"), [counts]
    levels = [units.withColumn("k", F.lit(1))]
    for k in range(1, longest):
        if units.isEmpty():
            break
        units = materialize(longer_units(docs, units, k, least))
        written.append(units)
        levels.append(units.withColumn("k", F.lit(k + 1)))
    return reduce(DataFrame.unionByName, levels).select("lang", "phrase", "k", "f"), totals, written


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    The score is floor(1000 a n / (l r)) at the cut that makes it lowest, the first of equal ones; a phrase that always
    stands within one longer phrase is left out.
    """
    phrases, totals, written = frequent_phrases(docs, least, longest)
    found = phrases.where("k > 1").withColumn("w", F.split("phrase", " ", -1))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    big = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"_up": big("a", 15) * big("n", 18) * F.lit(1000).cast("decimal(4,0)"), "_down": big("l", 15) * big("r", 15)})
    cuts = cuts.withColumn("score", F.expr("_up div _down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("c"))
    # A phrase within a longer one: its words from each place on, for each number of words from two on.
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    within = found.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where("longer IS NULL OR longer < c.a")
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("c.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "c.a", "c.l", "c.r", "c.n", "c.score"))
    discard(*written)
    return out


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
q AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM q GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM q, unnest(generate_series(1, len(w))) AS s(i), (VALUES (1), (2), (3), (4), (5)) AS z(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, i, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c, unnest(generate_series(1, k - 1)) AS s(i), f x, f y, t
  WHERE x.lang = c.lang AND x.phrase = array_to_string(w[:i], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(w[i + 1:], ' ') AND t.lang = c.lang),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
m AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM c, unnest(generate_series(1, k)) AS s(i), unnest(generate_series(2, k - 1)) AS z(m) WHERE i + m - 1 <= k),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.lang = b.lang AND m.phrase = b.phrase AND m.a >= b.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
