"""Sinks: datasets, results and labels."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a results file, in order.
RESULT_COLUMNS = ["detector", "threshold", "filename", "category", "score", "origin", "origin_name"]


def write_dataset(clips: DataFrame, path: str) -> None:
    clips.write.mode("overwrite").parquet(path)


def result_lines(rows: DataFrame, detectors: DataFrame, media_type: str) -> DataFrame:
    """section, detector, pos, line: a results document, line by line, of ``detect.result_rows`` and all detectors (name,
    threshold).

    A detector has a line that opens it (pos 0), one for each hit, and one that closes it.  Each line brings the comma that
    it owes, told from its place, its detector's hits and the last detector's name, so no row holds more than a hit.
    """
    options = {"ignoreNullFields": "false"}
    totals = rows.groupBy("detector").agg(F.count("*").alias("total"))
    all_ = detectors.select(F.col("name").alias("detector"), "threshold").join(totals, "detector", "left").select("detector", "threshold", F.coalesce("total", F.lit(0)).alias("total"))
    whole = all_.agg(F.count("*").alias("run"), F.max("detector").alias("last"))
    name = F.to_json(F.struct(F.col("detector").alias("n")))
    name = F.substring(name, F.lit(6), F.length(name) - 6)  # the text as JSON has it, of {"n":...}
    opened = F.concat(name, F.lit(':{"detector_name":'), name, F.lit(',"threshold":'), F.col("threshold").cast("string"), F.lit(',"total_hits":'), F.col("total").cast("string"), F.lit(',"hits":['))
    closed = F.concat(F.lit("]}"), F.when(F.col("detector") < F.col("last"), ",").otherwise(""))
    edges = all_.crossJoin(F.broadcast(whole))
    number = lambda c: c.cast("long").alias("pos")
    hit = F.concat(F.to_json(F.struct("id", "md5", "filename", "category", "score", "origin", "origin_name"), options), F.when(F.col("pos") < F.col("total"), ",").otherwise(""))
    head = F.concat(F.lit('{"media_type":'), F.lit(json.dumps(media_type)), F.lit(',"detectors_run":'), F.col("run").cast("string"), F.lit(',"results":{'))
    section = lambda n: F.lit(n).alias("section")
    parts = [
        whole.select(section(0), F.lit("").alias("detector"), number(F.lit(0)), head.alias("line")),
        edges.select(section(1), "detector", number(F.lit(0)), opened.alias("line")),
        rows.join(totals, "detector").select(section(1), "detector", number(F.col("pos")), hit.alias("line")),
        edges.select(section(1), "detector", number(F.col("total") + 1), closed.alias("line")),
        whole.select(section(2), F.lit("").alias("detector"), number(F.lit(0)), F.lit("}}").alias("line")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_results_json(rows: DataFrame, detectors: DataFrame, media_type: str, path: str) -> None:
    """The document in files whose names' order is the document's: each task writes its range of the lines."""
    if not path.strip():
        raise ValueError("a result file needs a path")
    lines = result_lines(rows, detectors, media_type)
    order = ["section", "detector", "pos"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def write_results_csv(hits: DataFrame, path: str) -> None:
    """``hits`` are rows of ``detect.result_rows``."""
    hits.select(RESULT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_labels(labelset: DataFrame, path: str) -> None:
    """One JSON object for each element; what is missing is left out."""
    labelset.select(F.to_json(F.struct("*")).alias("element")).write.mode("overwrite").text(path)


def report_lines(hits: DataFrame) -> DataFrame:
    """line: what a plain-text report says of each hit."""
    return hits.select(F.format_string("%s  %s  %.4f", F.col("name"), F.col("id").cast("string"), F.col("score")).alias("line"))
