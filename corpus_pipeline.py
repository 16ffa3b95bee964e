"""A training corpus from the documents table, in stages: each is written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects go.
2. toxicity: documents that the toxicity model rejects go.
3. line_dedup: lines that repeat an earlier line, or nearly, go; documents stay, with what is left of them.
4. near_dedup: of each group of documents that n-gram Jaccard links (five words, 0.8 or more) join, the one with the
   least doc_id stays.
   Documents without words are linked with nothing and stay.  So do rows without a doc_id.
5. packing: sequences of at most 1024 tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm import jaccard, lines, packing, quality, toxicity
from lumenclip.llm.common import documents, shared_dir, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs, quality.fit_on_fold(quality.statistics(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lines.line_dedup(docs).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    first = jaccard.jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
