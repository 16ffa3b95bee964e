"""Similarity ranking, positions, thresholds' places and the choice of the next clip to label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenclip.functions.embedding import text_similarity
from lumenclip.functions.scratch import written
from lumenclip.functions.vectors import cosine, doubles

def similarity(clips: DataFrame, query: DataFrame) -> DataFrame:
    """id and cosine to the one row of ``query`` (column q)."""
    one = query.select(doubles(F.col("q")).alias("q")).limit(1)
    return clips.select("id", doubles(F.col("embedding")).alias("v")).crossJoin(F.broadcast(one)).select("id", cosine(F.col("v"), F.col("q")).alias("score"))


def positions(scored: DataFrame, by: str = "score", partition: str | None = None, ascending: bool = False, counting: str | list[str] | None = None) -> DataFrame:
    """``scored`` with pos, from 1, by descending (or ascending) ``by`` and ascending id; with ``partition`` the positions
    are of each of its values.  With ``counting``, a boolean column, hits is the number of rows up to there that have it; with
    several, hits_<name> of each.

    The rows are evaluated once and written, then dealt by ranges of the order and sorted within them, so no task orders
    all of them, however they are spread, and equal values are cut by id.  A row's position is its place in its range
    plus the rows of the ranges before, of which there are as many as partitions.  Rows whose value is null or NaN come
    last.
    """
    keys = [partition] if partition else []
    rows = written(scored)
    kind = dict(rows.dtypes)[by]
    value = F.when(~F.isnan(by), F.col(by)) if kind in ("double", "float") else F.col(by)
    order = [*keys, F.col("_by").asc_nulls_last() if ascending else F.col("_by").desc_nulls_last(), "id"]
    # Spark numbers rows as the partition's number times 2^33 plus the row's place in it.
    dealt = rows.withColumn("_by", value).repartitionByRange(*order).sortWithinPartitions(*order).drop("_by")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    flags = [counting] if isinstance(counting, str) else counting or []
    ranges = dealt.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *[F.count_if(c).alias(f"_c{i}") for i, c in enumerate(flags)])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(k).alias("_key") for k in keys], "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"), *[F.coalesce(F.sum(f"_c{i}").over(before), F.lit(0)).alias(f"_had{i}") for i in range(len(flags))])
    at = dealt.withColumn("_of", part)
    same = F.col("_of") == F.col("_part")
    out = at.join(ranges, same & F.col(partition).eqNullSafe(F.col("_key")) if partition else same)
    out = out.withColumn("pos", (F.col("_at") + F.col("_add")).cast("long"))
    own = Window.partitionBy("_of", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for i, c in enumerate(flags):
        out = out.withColumn("hits" if isinstance(counting, str) else f"hits_{c}", F.count_if(c).over(own) + F.col(f"_had{i}"))
    return out.drop("_at", "_of", "_part", "_key", "_add", *[f"_had{i}" for i in range(len(flags))])


def sort_by_similarity(clips: DataFrame, query: DataFrame, digits: int = 4) -> DataFrame:
    """Text or example sort: ranked by the rounded similarity, ties by id."""
    return positions(similarity(clips, query).select("id", F.round("score", digits).alias("score"))).withColumnRenamed("score", "similarity")


def text_sort(texts: DataFrame, query: str, digits: int = 4) -> DataFrame:
    """id, similarity, pos of texts (id, text) by a query's text, both through the hashing embedder; ties by id."""
    return positions(text_similarity(texts, query).select("id", F.round("score", digits).alias("score"))).withColumnRenamed("score", "similarity")


def threshold_index(ranked: DataFrame, threshold: float | Column) -> DataFrame:
    """threshold_index: clips before the first whose score is below the threshold (all, if none is), and total."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return ranked.agg(F.coalesce(F.min(F.when(F.col("score") < thr, F.col("pos") - 1)), F.count("*")).cast("long").alias("threshold_index"), F.count("*").alias("total"))


def next_clips(ranked: DataFrame, labelled: DataFrame, threshold: float) -> DataFrame:
    """mode, id: the first unlabelled clip (top), and the one nearest to the threshold's place (hard)."""
    index = threshold_index(ranked, threshold)
    free = ranked.join(labelled.select("id"), "id", "left_anti").crossJoin(F.broadcast(index))
    top = free.orderBy("pos").limit(1).select(F.lit("top").alias("mode"), "id")
    hard = free.orderBy(F.abs(F.col("pos") - 1 - F.col("threshold_index")), F.abs(F.col("score") - threshold), "pos").limit(1)
    return top.unionByName(hard.select(F.lit("hard").alias("mode"), "id"))


def stripe_index(ranked: DataFrame, threshold: float) -> DataFrame:
    """threshold_index and total as a stripe shows them: 0, not all, where no score is below the threshold."""
    return ranked.agg(F.coalesce(F.min(F.when(F.col("score") < threshold, F.col("pos") - 1)), F.lit(0)).cast("long").alias("threshold_index"), F.count("*").alias("total"))


def stripe(ranked: DataFrame, labelled: DataFrame) -> DataFrame:
    """id, label, rank from 0 to 1 of each labelled clip in the ranking."""
    total = ranked.agg(F.count("*").alias("total"))
    return labelled.join(ranked, "id").crossJoin(F.broadcast(total)).select("id", "label", ((F.col("pos") - 1) / F.col("total")).alias("rank"))
