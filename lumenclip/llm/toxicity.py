"""Toxicity (9): class-conditional Kneser-Ney models and their length-normalised log-likelihood ratio.

Two models of order five over bytes, one of toxic and one of ordinary text, back off to one continuation distribution
that both share: in how many texts a byte follows a history of four, over all documents and without their labels
(each text is a context of its own).  For a byte u after a history h

    P_class(u | h) = (max(c(hu) - D, 0) + D * t(h) * P_shared(u | h)) / c(h)

with occurrences c and followers t of the class.  Histories tell languages and word forms apart, so a class's mix of
languages cancels, and parts of words speak for forms never seen.  Keys are the five bytes themselves, so no two
expressions share a count, and every expression of every labelled row that may be learned from is in the model.

Most expressions differ between the classes by chance alone.  Each is therefore an average of two models, one in which
the classes differ and one in which both have the shared probability

    P'_class(u | h) = w * P_class(u | h) + (1 - w) * P_shared(u | h)

where w is how likely it is that the classes differ: from the Bayes factor of u's shares among the texts with h in
either class against one share (Jeffreys' prior on each), and from how many of all expressions differ, which is
estimated from them (EM).  w is never 0: nothing is pruned.

The model grows with the different expressions of the labelled rows (24 bytes each), which are collected and broadcast:
0.09 million of 2,161 rows, 0.13 million of 10,787.  A logistic curve from the ratio to a score, two numbers, is fitted
on other labelled rows (``sample_rows`` bounds these alone), or on those that were counted where these are of one class.

A text is read as one space, and each of its words (runs of ASCII letters and digits and of all other characters, A-Z
lower-cased) with one space behind it.  Null and empty texts have no words, a ratio of 0 and the curve's score there.
A very long text is worked on alone, whole.  Repeated rows are scored each on its own; among those that are counted,
copies count once.  Equal scores are what they are.  Other columns are not looked at, whatever their names.  Without
labelled rows of both classes every score is 0.  A null doc_id has no fold and isn't held out.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import _LOWER, _separators, discard, documents, held_caches, label_fold, materialize, may_be_among, mix, steps, words_of

WORD_SEPARATORS = _separators({*range(48), *range(58, 65), *range(91, 97), *range(123, 128)})
_MULT = np.uint64(0x9E3779B97F4A7C15)
ORDER, DISCOUNT = 5, 0.75
#: The least log-likelihood ratio statistic, over texts, of an expression that isn't pruned: none is.
SIGNIFICANT = float("-inf")
#: Bits of the table that passes over most bytes of a text before keys are looked up.
_GATE_BITS = 22


def grams_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` with each five bytes as a number (the first one highest), their text, and all texts' word bytes."""
    while held_caches:  # of tokenizers, as in words_of
        held_caches.pop()()
    for a, b, data, offsets in steps(column):
        sep = WORD_SEPARATORS[data]
        new = ~sep
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        new[1:] &= sep[:-1] | edge[1 : len(data)]
        at = np.flatnonzero(~sep)
        word = np.cumsum(new)[at]  # words up to and with the byte's own
        doc = np.repeat(np.arange(b - a), np.diff(offsets))
        size = np.bincount(doc[at], minlength=b - a)
        words = np.bincount(doc[new], minlength=b - a)
        out = np.full(len(at) + int(words.sum()) + b - a, 32, np.uint64)
        out[np.arange(len(at)) + word + doc[at]] = _LOWER[data[at]]
        of = np.repeat(np.arange(b - a), size + words + 1)
        n = max(0, len(out) - ORDER + 1)
        key = np.zeros(n, np.uint64)
        for j in range(ORDER):
            key = (key << np.uint64(8)) | out[j : n + j]
        whole = of[:n] == of[len(of) - n :]
        yield a, b, key[whole].view(np.int64), of[:n][whole], size


def _gate(values: np.ndarray) -> np.ndarray:
    return ((values.view(np.uint64) * _MULT) >> np.uint64(64 - _GATE_BITS)).astype(np.int64)


class Among:
    """Tells which numbers are among some sorted ones, and at which place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys

    @cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash the place of one key, -1 for none, and whether there are more."""
        gate = _gate(self.keys)
        place = np.full(1 << _GATE_BITS, -1, np.int32)
        place[gate] = np.arange(len(gate), dtype=np.int32)
        more = np.zeros(1 << _GATE_BITS, bool)
        more[gate[place[gate] != np.arange(len(gate))]] = True
        return place, more

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the values that are among the keys, and the keys' places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        (place, more), gate = self.slots, _gate(values)
        at = place[gate].astype(np.int64)
        same = (at >= 0) & (self.keys[at] == values)
        others = np.flatnonzero(~same & more[gate])
        at[others] = np.minimum(np.searchsorted(self.keys, values[others]), len(self.keys) - 1)
        same[others] = self.keys[at[others]] == values[others]
        i = np.flatnonzero(same)
        return i, at[i]

    def __getstate__(self) -> dict:
        return {"keys": self.keys}  # each process makes its own slots


class KneserNey:
    """Expressions (sorted keys) with the log probabilities that the classes (0 ordinary, 1 toxic) give them; all
    others have their shared probability in both.  ``shared`` has the expressions' shared probabilities and
    ``weights`` how likely it is that the classes differ in them."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray, shared: np.ndarray | None = None, weights: np.ndarray | None = None) -> None:
        self.among, self.logs, self.shared, self.weights = Among(keys), logs, shared, weights

    def averaged(self) -> KneserNey:
        """The average with the shared model, each expression by its own weight."""
        return KneserNey(self.among.keys, np.log(self.weights * np.exp(self.logs) + (1 - self.weights) * self.shared))

    def ratios(self, column: pa.Array) -> np.ndarray:
        """For each text, log P(toxic) - log P(ordinary) for each byte of its words, on a log scale."""
        gain, out = self.logs[1] - self.logs[0], [np.zeros(0)]
        for a, b, key, of, size in grams_of(column):
            i, at = self.among.find(key)
            mean = np.bincount(of[i], weights=gain[at], minlength=b - a) / np.maximum(size, 1)
            out.append(np.sign(mean) * np.log1p(1000 * np.abs(mean)))
        return np.concatenate(out)


def differing(odds: np.ndarray) -> np.ndarray:
    """How likely it is of each expression that the classes differ, with the share of all that do estimated by EM (flat prior)."""
    share, w = 0.01, np.zeros(len(odds))
    for _ in range(200 if len(odds) else 0):
        w = 1 / (1 + np.exp(-np.clip(odds + np.log(share / (1 - share)), -500, 500)))
        last, share = share, (float(w.sum()) + 1) / (len(w) + 2)
        if abs(share - last) < 1e-12:
            break
    return w


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, seven places on; x is 1/2 at least."""
    y, product = x + 7, np.prod([x + i for i in range(7)], axis=0)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y - np.log(product)


def bayes_factor(a0: np.ndarray, n0: np.ndarray, a1: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log evidence for two shares, a0 of n0 and a1 of n1, against one, under Jeffreys' prior."""
    of = lambda a, n: log_gamma(a + 0.5) + log_gamma(n - a + 0.5) - log_gamma(n + 1.0) - np.log(np.pi)
    return of(a0, n0) + of(a1, n1) - of(a0 + a1, n0 + n1)


def _by_text(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys (of 40 bits), how often each occurs and in how many texts; ``of`` ascends."""
    # Texts of a step that have a key: fewer than 2^24, as each has some bytes.
    text = np.concatenate([np.zeros(min(1, len(of)), np.uint64), np.cumsum(np.diff(of) != 0).astype(np.uint64)])
    both = np.sort((keys.view(np.uint64) << np.uint64(24)) | text)
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    key = (both >> np.uint64(24)).view(np.int64)
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    n = np.diff(np.append(begin, len(key)))
    return key[begin], n, np.add.reduceat(first, begin, dtype=np.int64) if len(begin) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each expression, and (level 4) of each history, how often it occurs and in how many texts, by class."""
    for batch in batches:
        y = np.array(batch.column(batch.schema.get_field_index("y")).to_pylist(), np.int64)
        for a, _, key, of, _ in grams_of(batch.column(batch.schema.get_field_index("text"))):
            for c in (0, 1):
                own = y[a + of] == c
                for level in (ORDER, ORDER - 1):
                    keys, n, t = _by_text((key if level == ORDER else key >> 8)[own], of[own])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), x), pa.int32()) for x in (level, c)] + [pa.array(x, pa.int64()) for x in (keys, n, t)],
                        names=["level", "y", "key", "n", "texts"],
                    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each expression its shared and its classes' probabilities, and the log Bayes factor that the latter differ."""
    for batch in batches:
        x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in batch.schema.names if c != "key"}
        p = np.minimum(x["shared"] / x["total"], 1)
        own = []
        for c in "01":
            seen = x["hn" + c]
            of = (np.maximum(x["n" + c] - DISCOUNT, 0) + DISCOUNT * x["types" + c] * p) / np.maximum(seen, 1)
            own.append(np.where(seen > 0, of, p))
        odds = bayes_factor(x["texts0"], x["htexts0"], x["texts1"], x["htexts1"])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), *map(pa.array, (p, *own, odds))], names=["key", "p", "p0", "p1", "odds"])


def fit_counts(labelled: DataFrame, docs: DataFrame) -> KneserNey:
    """``labelled`` has text and y (1 toxic), all of which is counted.  ``docs`` has the texts of the corpus."""
    rows = labelled.select("text", "y").mapInArrow(_count, "level int, y int, key long, n long, texts long")
    of = lambda what, c: F.coalesce(F.sum(F.when(F.col("y") == c, F.col(what))), F.lit(0))
    counts = materialize(rows.groupBy("level", "key").agg(*[of(x, c).alias(f"{x}{c}") for x in ("n", "texts") for c in (0, 1)]))
    grams = counts.where(F.col("level") == ORDER).select("key", F.shiftright("key", 8).alias("h"), "n0", "n1", "texts0", "texts1")
    followers = grams.groupBy("h").agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"types{c}") for c in (0, 1)])
    histories = counts.where(F.col("level") == ORDER - 1).select(F.col("key").alias("h"), *[F.col(f"{x}{c}").alias(f"h{x}{c}") for x in ("n", "texts") for c in (0, 1)])

    # The shared distribution after each history, over all documents.
    after = docs.sparkSession.sparkContext.broadcast(Among(np.sort(followers.select("h").toArrow().column(0).to_numpy())))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, of, _ in grams_of(batch.column(batch.schema.get_field_index("text"))):
                i, _ = after.value.find(keys >> 8)
                found, _, n = _by_text(keys[i], of[i])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], names=["key", "n"])

    # At most 256 followers of each history.
    shared = materialize(docs.select("text").mapInArrow(follow, "key long, n long").groupBy("key").agg(F.sum("n").alias("shared")))
    heads = shared.groupBy(F.shiftright("key", 8).alias("h")).agg(F.sum("shared").alias("total"))
    # Half a text where the documents lack them.
    told = grams.join(histories.join(followers, "h").join(heads, "h", "left"), "h").join(shared, "key", "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.5)) for c in ("shared", "total")})
    kept = told.drop("h").mapInArrow(_judge, "key long, p double, p0 double, p1 double, odds double").toArrow().sort_by("key")
    key, p, *own, odds = (kept.column(c).to_numpy() for c in kept.column_names)
    logs = np.log(np.array(own).reshape(2, -1))
    # Those of equal probability in both classes add nothing.
    unlike = logs[0] != logs[1]
    discard(counts, shared)
    return KneserNey(key[unlike], logs[:, unlike], p[unlike], differing(odds)[unlike])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge, on standardised values."""
    if not len(x) or y.min() == y.max():
        return 0.0, -35.0
    m, s = x.mean(), x.std() or 1.0
    z, w = np.stack([(x - m) / s, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / s, w[1] - w[0] * m / s


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least of each text's shingle hashes under three mixings: equal for most copies, near ones too."""
    for batch in batches:
        keys: list[list[int]] = [[], [], []]
        for a, b, w in words_of(batch.column(batch.schema.get_field_index("text")), True, WORD_SEPARATORS):
            shingles, of = w.shingles(5)
            edges = np.searchsorted(of, np.arange(b - a + 1))
            for j, own in enumerate(keys):
                mixed = mix(shingles + np.uint64((j + 1) * int(_MULT) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                for i in range(b - a):
                    part = mixed[edges[i] : edges[i + 1]]
                    own.append(int(part.min()) if len(part) else int(w.hash[w.first[i]].view(np.int64)) if w.first[i] < w.first[i + 1] else j)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "same")), *(pa.array(k, pa.int64()) for k in keys)], names=["doc_id", "same", "s0", "s1", "s2"])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the documents that may be among ``wanted``; a join must follow."""
    return may_be_among(docs.select("doc_id", "text"), F.col("doc_id"), wanted.select("doc_id"))[0]


def without_copies(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, y, text of ``labelled`` (doc_id, y), one row of each group of copies, as far as three sketches show: copies
    would make a text's words look common.  Sketches are made where texts are read, and only the texts that stay move."""
    named = _texts(docs, labelled).withColumn("same", F.md5(F.coalesce("text", F.lit(""))))
    rows = named.mapInArrow(_sketch, "doc_id long, same string, s0 long, s1 long, s2 long").join(labelled, "doc_id")
    for s in ("s0", "s1", "s2"):
        rows = rows.groupBy(s, "y").agg(F.min(F.struct("doc_id", "same", "s0", "s1", "s2")).alias("r")).select("y", "r.*")
    # Merged at any size: a broadcast would end somewhere as labels grow.
    return named.join(rows.select("doc_id", "same", "y").hint("merge"), ["doc_id", "same"]).dropDuplicates(["doc_id", "same", "y"]).select("doc_id", "y", "text")


def _ratios(docs: DataFrame, model, *others: str) -> DataFrame:
    """doc_id, others and the ratio; ``model`` is a broadcast KneserNey."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.ratios(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", *others)), pa.array(x)], names=["doc_id", *others, "ratio"])

    return docs.select("doc_id", *others, "text").mapInArrow(rate, "doc_id long, " + "".join(f"{c} int, " for c in others) + "ratio double")


class ToxicityModel:
    """Broadcast counts and the curve; without labelled rows of both classes it scores 0."""

    def __init__(self, counts=None, slope: float = 0.0, intercept: float = -35.0) -> None:
        self.counts, self.slope, self.intercept = counts, slope, intercept

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.counts is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.counts.value.ratios(texts) + self.intercept, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = 8_000) -> ToxicityModel:
    """Labelled rows of the fold after ``held_out`` fit the curve, at most about four times ``sample_rows``; all others that
    are not held out are counted."""
    spark, fold = docs.sparkSession, label_fold(folds)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y"), fold.cast("int").alias("fold")).where(F.col("y").isin(0, 1) & (fold != held_out))
    rows = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(rows) < 2:
        return ToxicityModel()
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    curve = (held_out + 1) % folds
    to_count = known.where(F.col("fold") != curve)
    to_fit = known.where(F.col("fold") == curve).where(place < min(1.0, 4 * sample_rows / (rows[0] + rows[1])))
    counts = spark.sparkContext.broadcast(fit_counts(without_copies(docs, to_count.select("doc_id", "y")), docs).averaged())
    rated = lambda rows: _ratios(_texts(docs, rows).join(rows, "doc_id"), counts, "y").select("y", "ratio").toArrow()  # noqa: E731  bounded by sample_rows
    sample = rated(to_fit)
    if len(sample.column(0).unique()) < 2:
        few = place < F.when(F.col("y") == 1, sample_rows / rows[1]).otherwise(sample_rows / rows[0])
        sample = pa.concat_tables([sample, rated(to_count.where(few))])
    return ToxicityModel(counts, *_logistic(sample.column(1).to_numpy(), sample.column(0).to_numpy().astype(float)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rate, "doc_id long, score double, predicted int")


def keep_ordinary(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(batch.schema.get_field_index("text"))) < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = 8_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, folds, held_out, sample_rows)
    return score(docs, model).select("doc_id", F.coalesce(label_fold(folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
