"""The data model over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.functions.scratch import written
from lumenclip.functions.vectors import cosine, doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vec_clips(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("cat_"), F.col("label")).alias("category"), "label", F.lit("vector").alias("media_type"), "embedding")


def query_vec(spark: SparkSession, d: str, vec_id: int = 0) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def text_clips(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id"), F.lit(".txt"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.md5("text").alias("md5"), name.alias("filename"), F.col("lang").alias("category"), "source", F.concat_ws("|", F.lit("folder"), "source", name).alias("origin_key"))


def label_entries(spark: SparkSession, d: str) -> DataFrame:
    docs = text_clips(spark, d).withColumnRenamed("id", "doc_id")
    e = table(spark, d, "labels").join(docs, "doc_id")
    kind = F.col("doc_id") % 4
    label = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), "meh").when(F.col("quality") == 1, "good").otherwise("bad")
    md5 = F.when(kind == 1, "").when(kind == 3, F.concat(F.lit("missing"), F.col("doc_id"))).otherwise(F.col("md5"))
    return e.select(F.col("doc_id").alias("pos"), label.alias("label"), md5.alias("md5"), F.when(kind.isin(1, 2), F.col("origin_key")).alias("origin_key"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))


def vec_votes(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    good, bad = (F.col("label") == 0) & (F.col("id") % 2 == 0), (F.col("label") != 0) & (F.col("id") % 5 == 0)
    return v.where(good | bad).select("id", F.when(good, "good").otherwise("bad").alias("label"))


def vote_events(spark: SparkSession, d: str) -> DataFrame:
    vote = F.when(F.col("event_type").isin("purchase", "signup"), "good").when(F.col("event_type") == "error", "bad")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("clip_id"), vote.alias("vote"), "ts").where("vote IS NOT NULL")


def label_queries(spark: SparkSession, d: str, block: int = 1000) -> DataFrame:
    """query, id, score, relevant: the first vector of each label against all vectors, ``block`` queries at a time, so
    what is broadcast is bounded however many labels there are."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    first = written(first.select(F.col("label").alias("query"), doubles(F.col("q")).alias("q")))
    blocks = -(-first.count() // block)
    dealt = first if blocks <= 1 else written(first.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("query")) - 1) / block)))
    vectors = e.select(F.col("vec_id").alias("id"), "label", doubles(F.col("embedding")).alias("v"))
    some = [first] if blocks <= 1 else [dealt.where(F.col("_block") == i).drop("_block") for i in range(blocks)]
    pairs = reduce(DataFrame.unionByName, [vectors.crossJoin(F.broadcast(q)) for q in some])
    return pairs.select("query", "id", cosine(F.col("v"), F.col("q")).alias("score"), (F.col("label") == F.col("query")).alias("relevant"))
