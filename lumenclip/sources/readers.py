"""Sources: media folders, label files, detectors, feeds, archives, synthetic tones, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.functions.vectors import stripped
from lumenclip.operators.ranking import positions

#: Extensions of each media type.
EXTENSIONS = {"audio": ["wav", "mp3", "flac", "ogg", "m4a"], "image": ["jpg", "jpeg", "png", "gif", "bmp", "webp"], "video": ["mp4", "avi", "mov", "webm", "mkv"], "paragraph": ["txt", "md"]}


def read_folder(spark: SparkSession, path: str, media_type: str, recursive: bool = False) -> DataFrame:
    """Clips of a folder's files of one type: id by path, md5, size, name, content (pruned where it isn't used)."""
    if media_type not in EXTENSIONS:
        raise ValueError(f"unknown media type: {media_type}")
    glob = "*.{" + ",".join(EXTENSIONS[media_type]) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    # Numbers come from the paths alone, so no content is moved for them.
    numbers = positions(files.select("path", F.col("path").alias("id")), "path", ascending=True).select("path", F.col("pos").alias("id"))
    name, params = F.element_at(F.split("path", "/"), -1), F.array(F.struct(F.lit("path").alias("k"), F.lit(path).alias("v")))
    return files.join(numbers, "path").select(
        "id", F.lit(media_type).alias("type"), F.md5("content").alias("md5"), F.col("length").alias("file_size"), name.alias("filename"),
        F.lit("custom").alias("category"), F.lit("folder").alias("importer"), params.alias("params"), name.alias("origin_name"), "content",
    )


def read_category_folders(spark: SparkSession, path: str, media_type: str, categories: list[str]) -> DataFrame:
    """filename, category, path of files in folders named by category; of equal names the last path stays."""
    glob = "*.{" + ",".join(EXTENSIONS[media_type]) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path")
    parts = F.split("path", "/")
    found = files.select(F.element_at(parts, -1).alias("filename"), F.element_at(parts, -2).alias("category"), "path").where(F.col("category").isin(categories))
    return found.groupBy("filename").agg(F.max_by("category", "path").alias("category"), F.max("path").alias("path"))


def read_json_labels(spark: SparkSession, path: str) -> DataFrame:
    """Entries of {"labels": [...]} files, in order."""
    entry = "array<struct<md5: string, label: string, origin: struct<importer: string, params: map<string, string>>, origin_name: string, filename: string, category: string, path: string, file: string>>"
    return spark.read.schema(f"labels {entry}").json(path, multiLine=True).select(F.posexplode("labels").alias("pos", "e")).where("e IS NOT NULL").select("pos", "e.*")


def read_csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """md5, label of CSV files: header names and values stripped, labels in lower case, blanks dropped."""
    rows = spark.read.option("header", True).csv(path)
    named = rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])
    if not {"md5", "label"} <= set(named.columns):
        raise ValueError("a label file needs the columns md5 and label")
    return named.select(F.trim("md5").alias("md5"), F.lower(F.trim("label")).alias("label")).where("md5 <> '' AND label <> ''")


def read_detectors(spark: SparkSession, path: str) -> DataFrame:
    """Detector files: two layers' weights, with 0.5 and audio where threshold and media type are missing."""
    schema = "name string, media_type string, threshold double, weights struct<`0.weight`: array<array<double>>, `0.bias`: array<double>, `2.weight`: array<array<double>>, `2.bias`: array<double>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).where("weights IS NOT NULL")
    w = lambda k: F.col(f"weights.`{k}`")
    return raw.select("name", F.coalesce("media_type", F.lit("audio")).alias("media_type"), w("0.weight").alias("w1"), w("0.bias").alias("b1"), w("2.weight")[0].alias("w2"), w("2.bias")[0].alias("b2"), F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def read_feed(spark: SparkSession, path: str, most: int) -> DataFrame:
    """url, name of a feed's enclosures, the first ``most``: 8 digits of the url's md5, then its file name."""
    items = spark.read.format("xml").option("rowTag", "item").schema("enclosure struct<_url: string>").load(path)
    url = F.col("enclosure._url")
    return items.where(url.isNotNull()).limit(most).select(url.alias("url"), feed_name(url).alias("name"))


def feed_name(url: Column) -> Column:
    return F.concat(F.substring(F.md5(url), 1, 8), F.lit("_"), F.element_at(F.split(F.split(url, r"[?#]")[0], "/"), -1))


def tones(spark: SparkSession) -> DataFrame:
    """The synthetic data set: twenty tones."""
    i = F.col("id")
    return spark.range(1, 21).select("id", (200 + 50 * (i - 1)).alias("frequency"), (1.0 + 0.5 * (i % 5)).cast("double").alias("duration"))


def first_per_category(clips: DataFrame, most: int) -> DataFrame:
    return clips.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy("filename"))).where(F.col("_n") <= most).drop("_n")


def truncated(texts: DataFrame, most: int = 1000) -> DataFrame:
    return texts.withColumn("text", stripped(F.substring("text", 1, most))).where("text <> ''")


def split(clips: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``clips`` with part (train, test): a share of each category, at least one on either side of two or more."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    sizes = clips.groupBy("category").agg(F.count("*").alias("_n"))
    test = F.bround(F.col("_n") * fraction).cast("long")
    sizes = sizes.withColumn("_t", F.when(F.col("_n") >= 2, F.greatest(F.least(test, F.col("_n") - 1), F.lit(1))).otherwise(test))
    # Ids alone are put in order, so texts and embeddings move only if the caller wants them.
    chance = F.md5(F.concat_ws(":", F.lit(seed), "category", "id")).alias("_chance")
    placed = positions(clips.select("id", "category", chance), "_chance", "category", ascending=True)
    marked = placed.join(sizes, "category").select("id", F.when(F.col("pos") <= F.col("_t"), "test").otherwise("train").alias("part"))
    return clips.join(marked, "id").select(*clips.columns, "part")


def usable_labels(entries: DataFrame) -> DataFrame:
    """Entries (pos, label, path, file, filename) with a valid label, a path and the first such entry's media type."""
    path = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("path", "file", "filename")])
    table = F.create_map(*[F.lit(x) for kind, ext in EXTENSIONS.items() for e in ext for x in (e, kind)])
    typed = entries.where(F.col("label").isin("good", "bad")).withColumn("place", path).withColumn("media_type", F.try_element_at(table, F.lower(F.regexp_extract("place", r"\.([^.]+)$", 1)))).where("media_type IS NOT NULL")
    first = typed.agg(F.min_by("media_type", "pos").alias("first_type"))
    return typed.crossJoin(F.broadcast(first)).where("media_type = first_type").select("pos", "label", "place", "media_type")


def label_file_counts(entries: DataFrame, files: DataFrame) -> DataFrame:
    """media_type, loaded, skipped, num_good, num_bad of a label file: what there is to train from among ``files`` (place)."""
    here = entries.withColumn("_place", F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("path", "file", "filename")]))
    here = here.join(files.select(F.col("place").alias("_place")).distinct(), "_place", "left_semi")
    used = usable_labels(here.select(entries.columns))
    n = used.agg(F.first("media_type").alias("media_type"), F.count("*").alias("loaded"), F.count_if(F.col("label") == "good").alias("num_good"), F.count_if(F.col("label") == "bad").alias("num_bad"))
    return n.crossJoin(F.broadcast(entries.agg(F.count("*").alias("_all")))).select("media_type", "loaded", (F.col("_all") - F.col("loaded")).alias("skipped"), "num_good", "num_bad")
