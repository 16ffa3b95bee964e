"""Retrieval and classification metrics, threshold search and error costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenclip.operators.ranking import positions


def inclusion_weights(inclusion: int) -> tuple[float, float]:
    """Weights of false positives and of false negatives."""
    return (1.0, 2.0**inclusion) if inclusion >= 0 else (2.0**-inclusion, 1.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def average_precision(scored: DataFrame) -> DataFrame:
    """query, ap of rankings (query, id, score, relevant); 0 where nothing is relevant."""
    ranked = positions(scored, partition="query", counting="relevant")
    hit = F.when(F.col("relevant"), F.col("hits") / F.col("pos"))
    return ranked.groupBy("query").agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("ap"))


def precision_recall_at(scored: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """query, k, precision, recall."""
    ranked = positions(scored, partition="query")
    total = ranked.groupBy("query").agg(F.count_if("relevant").alias("total"))
    top = ranked.where(F.col("pos") <= max(ks))
    hits = top.crossJoin(F.broadcast(scored.sparkSession.createDataFrame([(k,) for k in ks], "k int"))).groupBy("query", "k").agg(F.count_if(F.col("relevant") & (F.col("pos") <= F.col("k"))).alias("hits"))
    return hits.join(total, "query").select("query", "k", (F.col("hits") / F.col("k")).alias("precision"), ratio(F.col("hits"), F.col("total")).alias("recall"))


def confusion(predicted: DataFrame) -> DataFrame:
    """One row of counts and rates from (predicted, actual) booleans."""
    p, a = F.col("predicted"), F.col("actual")
    c = predicted.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def optimal_threshold(scored: DataFrame, inclusion: int = 0, key: str | None = None) -> DataFrame:
    """threshold, cost (of each ``key``, if given): the score with the least weighted cost, the highest of equal ones.
    0.5 in one row without rows and key.  Rows without a score don't count.

    False positives are the negatives down to a score, misses the positives below it, both from positions.
    """
    wp, wn = inclusion_weights(inclusion)
    keys = [key] if key else []
    usable = scored.where("score IS NOT NULL AND NOT isnan(score)").select(*keys, "score", "positive", F.lit(0).alias("id"))
    ranked = positions(usable, partition=key, counting="positive")
    n = ranked.groupBy(*keys).agg(F.max("hits").alias("p"), (F.max("pos") - F.max("hits")).alias("n"))
    swept = ranked.groupBy(*keys, "score").agg(F.max("hits").alias("tp"), (F.max("pos") - F.max("hits")).alias("fp"))
    swept = swept.join(n, keys) if key else swept.crossJoin(F.broadcast(n))
    cost = wp * ratio(F.col("fp"), F.col("n")) + wn * ratio(F.col("p") - F.col("tp"), F.col("p"))
    best = swept.withColumn("cost", cost).groupBy(*keys).agg(F.min(F.struct("cost", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*keys, F.coalesce(-F.col("b.s"), F.lit(0.5)).alias("threshold"), F.col("b.cost").alias("cost"))


def error_cost(judged: DataFrame, keys: list[str], inclusion: int = 0, digits: int = 6) -> DataFrame:
    """fpr, fnr and weighted cost of (predicted, actual) by ``keys``; 0 where a class is missing, NaN without any rows."""
    wp, wn = inclusion_weights(inclusion)
    p, a = F.col("predicted"), F.col("actual")
    c = judged.groupBy(*keys).agg(ratio(F.count_if(p & ~a), F.count_if(~a)).alias("fpr"), ratio(F.count_if(~p & a), F.count_if(a)).alias("fnr"), F.count("*").alias("_n"))
    c = c.withColumns({x: F.when(F.col("_n") == 0, F.lit(float("nan"))).otherwise(F.col(x)) for x in ("fpr", "fnr")})
    return c.select(*keys, F.round(F.col("fpr"), digits).alias("fpr"), F.round(F.col("fnr"), digits).alias("fnr"), F.round(wp * F.col("fpr") + wn * F.col("fnr"), digits).alias("cost"))


def voting_summary(runs: DataFrame) -> DataFrame:
    """Mean and sample deviation of cost, fpr and fnr by dataset, category and t."""
    return runs.groupBy("dataset", "category", "t").agg(*[f for c in ("cost", "fpr", "fnr") for f in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))])


def labeling_status(counts: DataFrame, steps: DataFrame) -> DataFrame:
    """status, slope from totals (good, bad) and steps (step, error_cost): red, yellow or green."""
    last = steps.orderBy(F.desc("step")).limit(10)
    first = last.agg(F.min("step").alias("s0"))
    fit = last.crossJoin(F.broadcast(first)).agg(F.count("*").alias("n"), F.regr_slope(F.col("error_cost"), F.col("step") - F.col("s0")).alias("slope"), F.avg("error_cost").alias("mean"))
    both = counts.crossJoin(F.broadcast(fit))
    relative = F.when(F.col("mean") > 0, F.col("slope") / F.col("mean")).otherwise(F.col("slope"))
    status = F.when((F.col("good") + F.col("bad") < 20) | (F.col("good") < 5) | (F.col("bad") < 5), "red").when(F.col("n") < 3, "yellow").when(relative < -0.015, "yellow").otherwise("green")
    return both.select("good", "bad", status.alias("status"), F.round("slope", 4).alias("slope"))


def with_default_score(wanted: DataFrame, scored: DataFrame) -> DataFrame:
    """id, score of the wanted ids; 0 where there is none."""
    return wanted.select("id").join(scored.select("id", "score"), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def stability_by_step(predictions: DataFrame, labelled: DataFrame) -> DataFrame:
    """step, num_labels, num_flips, num_unlabeled from predictions (step, id, predicted) and labels (id, step: since when)."""
    by = labelled.select("id", F.col("step").alias("since"))
    return stability(predictions.join(by, "id", "left").withColumn("has", F.coalesce(F.col("since") <= F.col("step"), F.lit(False))))


def stability(predictions: DataFrame) -> DataFrame:
    """step, num_labels, num_flips, num_unlabeled from predictions (step, id, predicted, has: a label as of the step)."""
    counts = predictions.groupBy("step").agg(F.count_if("has").alias("num_labels"), F.count_if(~F.col("has")).alias("num_unlabeled"))
    free = predictions.where(~F.col("has")).select("step", "id", "predicted")
    return counts.join(prediction_flips(free).select("step", F.col("flips").alias("num_flips")), "step", "left").select("step", "num_labels", F.coalesce("num_flips", F.lit(0)).alias("num_flips"), "num_unlabeled")


def progress_by_step(predictions: DataFrame, labels: DataFrame, inclusion: int = 0) -> DataFrame:
    """step, error_cost (against the labels as they are now), num_labels, num_flips, num_unlabeled."""
    judged = predictions.join(labels.select("id", F.col("good").alias("actual")), "id")
    cost = error_cost(judged, ["step"], inclusion, 4).select("step", F.col("cost").alias("error_cost"))
    return stability_by_step(predictions, labels).join(cost, "step", "left").select("step", "error_cost", "num_labels", "num_flips", "num_unlabeled")


def prediction_flips(predictions: DataFrame) -> DataFrame:
    """step, flips: clips whose prediction differs from the step before it, and clips that both have."""
    before = F.lag(F.struct("step", "predicted")).over(Window.partitionBy("id").orderBy("step"))
    steps = predictions.select("step").distinct()
    prior = steps.withColumn("prior", F.lag("step").over(Window.orderBy("step")))
    p = predictions.withColumn("b", before).join(prior, "step")
    both = F.col("b.step") == F.col("prior")
    return p.groupBy("step").agg(F.count_if(both & (F.col("b.predicted") != F.col("predicted"))).alias("flips"), F.count_if(both).alias("common"))


def stopping_advice(progress: DataFrame) -> DataFrame:
    """One row: advice (keep, stop, consider, stable) from the last steps (step, error_cost, num_flips): three at least,
    or the last three tenths.  Steps are one row for each trained model, so the tail is small next to any table."""
    n = progress.agg(F.count("*").alias("n"))
    tail = progress.crossJoin(F.broadcast(n)).withColumn("back", F.row_number().over(Window.orderBy(F.desc("step"))))
    tail = tail.where(F.col("back") <= F.greatest(F.lit(3), F.floor(F.col("n") * 0.3)))
    t = tail.agg(F.first("n").alias("n"), (F.max("error_cost") - F.min("error_cost")).alias("range"), F.avg("error_cost").alias("mean"), F.avg("num_flips").alias("flips"))
    spread = F.col("range") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    advice = F.when(F.coalesce("n", F.lit(0)) < 5, "keep").when((spread < 0.1) & (F.col("flips") < 5), "stop").when(spread < 0.15, "consider").when(F.col("flips") < 3, "stable").otherwise("keep")
    return t.select(advice.alias("advice"))


def evaluation_report(scored: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """level, dataset, query, ap, num_relevant, num_queries and precision_<k>, recall_<k> of rankings (dataset, query, id,
    score, relevant): a row for each query, each data set (means of its queries) and all (means of all queries).

    One ranking serves all of them; the levels are grouping sets of the queries' rows.
    """
    of = F.struct("dataset", "query")
    ranked = positions(scored.withColumn("of", of), partition="of", counting="relevant")
    hit = F.when(F.col("relevant"), F.col("hits") / F.col("pos"))
    at = lambda k: F.count_if(F.col("relevant") & (F.col("pos") <= k))
    queries = ranked.groupBy("of").agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("ap"), F.count_if("relevant").alias("n"), *[at(k).alias(f"h{k}") for k in ks])
    rates = {f"precision_{k}": F.col(f"h{k}") / k for k in ks} | {f"recall_{k}": ratio(F.col(f"h{k}"), F.col("n")) for k in ks}
    queries = queries.select("of.dataset", "of.query", "ap", "n", *[c.alias(name) for name, c in rates.items()])
    level = F.when(F.grouping_id() == 0, "query").when(F.grouping_id() == 1, "dataset").otherwise("all")
    sets = queries.groupingSets([["dataset", "query"], ["dataset"], []], "dataset", "query")
    return sets.agg(level.alias("level"), F.avg("ap").alias("ap"), F.sum("n").alias("num_relevant"), F.count("*").alias("num_queries"), *[F.avg(c).alias(c) for c in rates])


def report_json(report: DataFrame, media_type: str, ks: tuple[int, ...] = (5, 10, 20), digits: int = 4) -> DataFrame:
    """dataset, report: a JSON object for each data set, with its mean and its queries (of which a user states a few)."""
    shown = lambda c: F.round(c, digits)
    rates = lambda what: F.struct(*[shown(F.col(f"{what}_{k}")).alias(str(k)) for k in ks])
    entry = F.struct("query", shown(F.col("ap")).alias("AP"), "num_relevant", rates("precision").alias("precision_at_k"), rates("recall").alias("recall_at_k"))
    per_query = report.where("level = 'query'").groupBy("dataset").agg(F.sort_array(F.collect_list(entry)).alias("per_query"))
    means = report.where("level = 'dataset'").select("dataset", shown(F.col("ap")).alias("mAP"))
    text_sort = F.struct("mAP", "per_query").alias("text_sort")
    return per_query.join(means, "dataset").select("dataset", F.to_json(F.struct(F.col("dataset").alias("dataset_id"), F.lit(media_type).alias("media_type"), text_sort)).alias("report"))
