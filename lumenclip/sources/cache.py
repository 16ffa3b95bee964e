"""A read-through cache of datasets: what is built once from the same inputs and parameters is read from then on."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenclip.functions.scratch import exists, remove


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of the files below a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, out = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def cache_key(spark: SparkSession, parameters: dict, sources: list[str]) -> str:
    """Equal for equal parameters, in whatever order they are given, and unchanged sources."""
    told = json.dumps([parameters, [listing(spark, s) for s in sorted(sources)]], sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def read_through(spark: SparkSession, folder: str, parameters: dict, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The dataset that ``build`` makes of ``sources``, from the cache below ``folder`` where it has one.

    A dataset is written beside the cache and moved to its place as a whole, so a place either has all of it, marker
    included, or doesn't exist.  Of several writers the first to move stays; the others drop theirs and read that.
    """
    place = f"{folder}/{cache_key(spark, parameters, sources)}"
    if not exists(spark, f"{place}/_SUCCESS"):
        own = f"{folder}/_writing-{uuid.uuid4().hex}"
        build().write.parquet(own)
        paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (own, place)]
        system = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
        # A move onto an existing folder would go into it.
        if exists(spark, place) or not system.rename(*paths):
            remove(spark, own)
    return spark.read.parquet(place)
