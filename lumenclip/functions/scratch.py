"""Intermediate tables: written below the folder that driver and executors share, one folder for a session's work."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local master (tests) without one gets a temporary folder, a cluster has none
    that would do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This session's folder, deleted when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = spark, f"{shared_dir(spark)}/scratch-{app}-{uuid.uuid4().hex[:8]}"
    return _folders[app][1]


def written(df: DataFrame) -> DataFrame:
    """``df`` written once and read back: its plan ends there, and lost executors lose nothing of it."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    for spark, folder in _folders.values():
        with contextlib.suppress(Exception):  # the session may be gone, and its folder then is the cluster's to clear
            remove(spark, folder)
