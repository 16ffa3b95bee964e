"""Detectors, extractors and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.functions.vectors import doubles, mlp_score
from lumenclip.operators.ranking import positions

DETECTOR = "name string, media_type string, w1 array<array<double>>, b1 array<double>, w2 array<double>, b2 double, threshold double"

#: Bytes of weights that are sent to the clips at once.
BLOCK_BYTES = 16 << 20


def synthetic_detectors(spark: SparkSession, width: int = 64, hidden: int = 64) -> DataFrame:
    """Two detectors whose weights any engine computes exactly alike."""
    row = lambda shift: ([[((i * 37 + (j + shift) * 17) % 101 - 50) / 500.0 for j in range(width)] for i in range(hidden)], [((i * 13) % 11 - 5) / 50.0 for i in range(hidden)], [((i * 29) % 23 - 11) / 100.0 for i in range(hidden)], 0.05)
    return spark.createDataFrame([("d1", "vector", *row(0), 0.51), ("d2", "vector", *row(7), 0.512)], DETECTOR)


def detector_scores(clips: DataFrame, detectors: DataFrame) -> DataFrame:
    """Every clip by every detector of its media type.

    Detectors are sent to the clips in blocks of at most BLOCK_BYTES of weights, so embeddings are never shuffled.
    """
    clips = clips.select("id", "media_type", doubles(F.col("embedding")).alias("v"))
    weights = 8 * (F.size("w1") * F.size(F.col("w1")[0]) + 2 * F.size("b1"))
    n, most = detectors.agg(F.count("*"), F.max(weights)).first()
    each = max(1, BLOCK_BYTES // max(1, most or 1))
    # A registry of detectors is a small table of its own, so one window numbers it.
    numbered = detectors.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("name")) - 1) / each))
    blocks = [numbered.where(F.col("_block") == i).drop("_block") for i in range(-(-n // each))] or [detectors]
    pairs = reduce(DataFrame.unionByName, [clips.join(F.broadcast(b), "media_type") for b in blocks])
    return pairs.select("id", "name", "threshold", mlp_score(F.col("v"), F.col("w1"), F.col("b1"), F.col("w2"), F.col("b2")).alias("score"))


def hits(scores: DataFrame) -> DataFrame:
    """The raw score decides; the rounded one is shown."""
    return scores.where(F.col("score") >= F.col("threshold")).select("name", "id", F.round("score", 4).alias("score"))


def extractions(clips: DataFrame, pattern: str, label: str) -> DataFrame:
    """A row for each match of a text pattern: id, label, n (from 0), match."""
    found = clips.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("n", "match"))
    return found.select("id", F.lit(label).alias("label"), F.col("n").cast("long").alias("n"), "match")


def boxes_above(detections: Column, wanted: str, threshold: float) -> Column:
    """Of an array of (confidence, bbox, label), the wanted ones: rounded, most confident first."""
    kept = F.filter(detections, lambda d: (d["label"] == wanted) & (d["confidence"] >= threshold))
    shown = F.transform(kept, lambda d: F.struct(F.round(d["confidence"], 4).alias("confidence"), F.transform(d["bbox"], lambda x: F.round(x, 2)).alias("bbox"), d["label"].alias("label")))
    return F.array_sort(shown, lambda a, b: (b["confidence"] > a["confidence"]).cast("int") - (b["confidence"] < a["confidence"]).cast("int"))


def result_rows(scores: DataFrame, clips: DataFrame) -> DataFrame:
    """What results are written from, a row for each hit: detector, threshold, media_type, id, md5, filename, category,
    score (rounded), origin, origin_name, and pos, the hit's place in its detector: best rounded score first, then id."""
    found = scores.where(F.col("score") >= F.col("threshold")).select(F.col("name").alias("detector"), "threshold", "id", F.round("score", 4).alias("score"))
    placed = positions(found, partition="detector")
    return placed.join(clips.select("id", "media_type", "md5", "filename", "category", "origin", "origin_name"), "id").select(
        "detector", "threshold", "media_type", "id", "md5", "filename", "category", "score", "origin", "origin_name", "pos"
    )
