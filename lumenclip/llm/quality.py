"""Quality classifier (3): a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk toward the pooled one and its diagonal.  A score is the logistic
of the difference of the two log-densities, each from a Mahalanobis distance through a Cholesky factor that is made
once and goes to the tasks with the code.  The fit needs only sums over the labelled rows (counts, first and second
moments for each class), added up in tasks before the shuffle, so it covers all of them and sends a fixed number of
values to the driver.

Null and empty texts have zeros as statistics and get a score like any other.  A very long text is worked on alone,
whole.  Rows that are labelled twice count twice, and repeated rows are scored each on its own; a score of just 0.5
counts as good.  Other columns are not looked at, whatever their names.  Without labelled rows of both classes every
score is 0.5.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import documents, label_fold, materialize, words_of
from lumenclip.llm.rules import _sums, duplicate_lines, repeated_words

FEATURES = ("words", "word_length", "symbols", "upper", "repeats", "stutter", "variety", "dup_lines", "shouts", "pipes", "digits", "points", "line_words")
D = len(FEATURES)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = {"symbols": _table(b"#*$%&<>@^~{}[]\\"), "shouts": _table(b"!?"), "pipes": _table(b"|"), "digits": _table(b"0123456789"), "points": _table(b".,;:"), "upper": _table(bytes(range(65, 91))), "lower": _table(bytes(range(97, 123))), "lines": _table(b"\n")}


def features(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = [np.zeros((0, D))]
    plain = texts.to_pylist()
    for a, b, w in words_of(texts, lower=False):
        n = np.diff(w.first).astype(float)
        some = np.maximum(n, 1)
        count = {k: _sums(t[w.data], w.offsets) for k, t in _CLASSES.items()}
        size = _sums((~w.sep).astype(np.int64), w.offsets)
        same = np.zeros(len(w.hash), np.int64)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        stutter = _sums(same, w.first)
        shingles, of = w.shingles(3)
        edges = np.searchsorted(of, np.arange(b - a + 1))
        repeats = np.array([repeated_words(shingles[edges[i] : edges[i + 1]]) for i in range(b - a)])
        distinct = np.array([len(np.unique(w.hash[w.first[i] : w.first[i + 1]])) for i in range(b - a)])
        lines = count["lines"] + 1
        again = np.array([duplicate_lines(t) if t and "\n" in t else 0 for t in plain[a:b]])
        root = lambda x: np.sqrt(np.maximum(x, 0))
        out.append(
            np.stack(
                [
                    np.log1p(n), np.log1p(size / some), root(count["symbols"] / some), root(count["upper"] / np.maximum(count["upper"] + count["lower"], 1)), root(repeats / some), root(stutter / some), distinct / some**0.9,
                    root(again / lines), root(count["shouts"] / some), root(count["pipes"] / some), root(count["digits"] / some), root(count["points"] / some), np.log1p(n / lines),
                ],
                axis=1,
            )
        )
    return np.concatenate(out)


class QuadraticDiscriminant:
    """Class means, covariances shrunk by ``toward_pooled`` and then ``toward_diagonal``, cached factors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, toward_pooled: float, toward_diagonal: float, soften: float) -> None:
        self.usable, self.soften = bool((n > 1).all()), soften
        if not self.usable:
            return
        d = sums.shape[1]
        self.mean = sums / n[:, None]
        scatter = squares - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(0) / n.sum()
        floor = np.diag(np.maximum(np.diag(pooled), 1e-4))
        self.prior = np.log(n / n.sum())
        self.inverse, self.log_det = [], []
        for k in range(2):
            cov = (1 - toward_pooled) * scatter[k] / n[k] + toward_pooled * pooled
            cov = (1 - toward_diagonal) * cov + toward_diagonal * floor
            factor = np.linalg.cholesky(cov)
            self.inverse.append(np.linalg.solve(factor, np.eye(d)))
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable or not len(x):
            return np.full(len(x), 0.5)
        density = [-0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.log_det[k] + self.prior[k] for k in range(2)]
        return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / self.soften, -35, 35)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: each document's transformed statistics."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(batch.schema.get_field_index("text")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * D), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), rows], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def fit(labelled: DataFrame, label: str = "quality", toward_pooled: float = 0.1, toward_diagonal: float = 0.05, soften: float = 2.0) -> QuadraticDiscriminant:
    """``labelled`` has x and a 0/1 label."""
    width = 1 + D + D * D

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            x = _matrix(batch)
            y = np.array(batch.column(batch.schema.get_field_index("y")).to_pylist(), int)
            for k in range(2):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k, i = np.divmod(np.arange(2 * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(total.ravel())], names=["k", "i", "v"])

    rows = labelled.select("x", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    total = np.zeros((2, width))
    for r in rows.mapInArrow(sums, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # 2 * width rows, whatever the input
        total[r.k, r.i] = r.v
    return QuadraticDiscriminant(total[:, 0], total[:, 1 : 1 + D], total[:, 1 + D :].reshape(2, D, D), toward_pooled, toward_diagonal, soften)


def score(measured: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """doc_id, score, predicted of rows of ``statistics``."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.select("doc_id", "x").mapInArrow(rate, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: QuadraticDiscriminant) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(batch.column(batch.schema.get_field_index("text")))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def fit_on_fold(measured: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> QuadraticDiscriminant:
    """Fitted on the labelled rows of ``statistics`` that aren't held out; statistics, not texts, meet the labels."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & (label_fold(folds) != held_out))
    return fit(measured.join(known, "doc_id"))


def quality_classifier(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    measured = materialize(statistics(docs))
    return score(measured, fit_on_fold(measured, labels, folds, held_out)).select("doc_id", (label_fold(folds) == held_out).alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
