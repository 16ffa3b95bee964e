"""Exact values on small inputs, and random ones against plain versions."""

import json
import math
import random

import numpy as np
import pytest
from lumenclip.functions import vectors
from lumenclip.operators import detect, evaluate, labels, ranking, training
from lumenclip.sources import readers, sinks
from lumenclip.streaming import votes as stream
from pyspark.sql import functions as F


def rankings(seed):
    """Random rankings of a few queries, with ties, nulls and queries without a relevant row."""
    rng, out = random.Random(seed), []
    for q in range(4):
        for i in range(rng.randrange(1, 60)):
            score = rng.choice([None, float("nan"), 0.5, rng.random(), round(rng.random(), 1)])
            out.append((f"q{q}", rng.randrange(10**6) * 10 + i % 10, score, q > 0 and rng.random() < 0.3))
    return list({(r[0], r[1]): r for r in out}.values())


def best_first(rows, query):
    known = lambda s: s is not None and s == s
    return sorted((r for r in rows if r[0] == query), key=lambda r: (not known(r[2]), -r[2] if known(r[2]) else 0, r[1]))


@pytest.mark.parametrize("seed", range(3))
def test_rankings_by_brute_force(spark, seed):
    rows = rankings(seed)
    df = spark.createDataFrame(rows, "query string, id long, score double, relevant boolean").repartition(5)
    ap = {r.query: r.ap for r in evaluate.average_precision(df).collect()}
    pr = {(r.query, r.k): (r.precision, r.recall) for r in evaluate.precision_recall_at(df, (1, 7, 30)).collect()}
    for q in {r[0] for r in rows}:
        rel = [r[3] for r in best_first(rows, q)]
        precisions = [sum(rel[: i + 1]) / (i + 1) for i, x in enumerate(rel) if x]
        assert ap[q] == pytest.approx(np.mean(precisions) if precisions else 0.0)
        for k in (1, 7, 30):
            if (q, k) in pr:
                assert pr[q, k] == pytest.approx((sum(rel[:k]) / k, sum(rel[:k]) / sum(rel) if any(rel) else 0.0))


@pytest.mark.parametrize("seed", range(2))
def test_confusion_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.3, rng.random() < 0.6) for _ in range(rng.randrange(1, 80))]
    c = evaluate.confusion(spark.createDataFrame(rows, "predicted boolean, actual boolean")).first()
    both, said, real = sum(p and a for p, a in rows), sum(p for p, _ in rows), sum(a for _, a in rows)
    assert (c.tp, c.fp, c.fn, c.tn) == (both, said - both, real - both, len(rows) - said - real + both)
    assert c.accuracy == pytest.approx(sum(p == a for p, a in rows) / len(rows))
    assert c.f1 == pytest.approx(2 * both / (said + real) if said + real else 0.0)
    assert evaluate.confusion(spark.createDataFrame([], "predicted boolean, actual boolean")).first().accuracy == 0.0


def test_cosine(spark):
    rng = np.random.default_rng(4)
    pairs = [(rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for _ in range(20)] + [([0.0] * 9, [1.0] * 9), ([0.0] * 9, [0.0] * 9)]
    got = [r.c for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").coalesce(1).select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    want = [np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300) for a, b in pairs]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("k", range(0, 9, 4))
def test_inclusion_weights(k):
    fp, fn = evaluate.inclusion_weights(k)
    assert fp == 1 and math.log2(fn) == k and evaluate.inclusion_weights(-k) == ((fn, 1) if k else (1, 1))


@pytest.mark.parametrize("inclusion", [-3, 0, 2])
def test_optimal_threshold(spark, inclusion):
    rng = random.Random(inclusion)
    rows = [(rng.randrange(30) / 30, rng.random() < 0.4) for _ in range(300)]
    got = evaluate.optimal_threshold(spark.createDataFrame(rows, "score double, positive boolean"), inclusion).first().threshold
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]).astype(int)
    assert got == training.best_threshold(s, y, inclusion)
    assert evaluate.optimal_threshold(spark.createDataFrame([], "score double, positive boolean")).first().threshold == 0.5


@pytest.mark.parametrize("kind", ["ties", "skewed", "odd"])
def test_positions_by_brute_force(spark, kind):
    rng = random.Random(kind)
    score = {"ties": lambda: rng.choice([0.1, 0.2]), "skewed": lambda: 1 - 10.0 ** -rng.randrange(1, 15), "odd": lambda: rng.choice([None, float("nan"), 0.0, -1.0, float("inf"), rng.random()])}[kind]
    rows = [(rng.choice(["a", "b", None]), i, score(), rng.random() < 0.4) for i in range(700)]
    df = spark.createDataFrame(rows, "query string, id long, score double, flag boolean").repartition(7)
    got = {r.id: (r.pos, r.hits) for r in ranking.positions(df, partition="query", counting="flag").collect()}
    assert len(got) == 700
    for q in ("a", "b", None):
        order = best_first(rows, q)
        for i, r in enumerate(order):
            assert got[r[1]] == (i + 1, sum(x[3] for x in order[: i + 1]))
    whole = [("all", *r[1:]) for r in rows]
    assert {r.id: r.pos for r in ranking.positions(df).collect()} == {r[1]: i + 1 for i, r in enumerate(best_first(whole, "all"))}
    up = ranking.positions(df.select("id", F.md5(F.col("id").cast("string")).alias("h")), "h", ascending=True).orderBy("pos").collect()
    assert [r.h for r in up] == sorted(r.h for r in up)


def test_positions_read_their_rows_once(spark, tmp_path):
    spark.range(1000).selectExpr("id", "rand(1) AS score").write.parquet(str(tmp_path / "s"))
    ranked = ranking.positions(spark.read.parquet(str(tmp_path / "s")))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    # What is left reads the dealt rows alone, and its one window is over their ranges.
    assert str(tmp_path / "s") not in ranked._jdf.queryExecution().executedPlan().toString() and plan.count("Window") == 1 and "sum(_n#" in plan
    assert ranking.positions(spark.createDataFrame([], "id long, score double")).count() == 0


def test_toggle(spark):
    v = spark.createDataFrame([(1, 1, "good"), (2, 1, "good"), (3, 1, "bad")], "seq long, clip_id long, vote string")
    log = labels.toggled(v)
    assert [r.label for r in log.orderBy("seq").collect()] == ["good", "unlabel", "bad"]
    assert [tuple(r) for r in labels.label_state(log).collect()] == [(1, "bad")]


def test_toggle_stream(spark, tmp_path):
    v = spark.createDataFrame([(i, i % 3, random.Random(i).choice(["good", "bad"])) for i in range(200)], "seq long, clip_id long, vote string")
    v.write.parquet(str(tmp_path / "in"))
    q = stream.toggle_stream(spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("toggled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("toggled").collect())) == sorted(map(tuple, labels.toggled(v).select("seq", "clip_id", "label").collect()))


def test_resolution_by_brute_force(spark):
    rng = random.Random(11)
    some = lambda letter: rng.choice([None, "", *(f"{letter}{i}" for i in range(12))])
    clip_rows = [(i, some("h"), some("o")) for i in range(40)]
    entry_rows = [(i, rng.choice(["good", "bad", "meh"]), some("h"), some("o")) for i in range(40)]
    clips = spark.createDataFrame(clip_rows, "id long, md5 string, origin_key string")
    entries = spark.createDataFrame(entry_rows, "pos long, label string, md5 string, origin_key string")
    want = {(p, i) for p, _, h, o in entry_rows for i, md5, key in clip_rows if (h and h == md5) or (o and o == key)}
    assert sorted(map(tuple, labels.resolve(entries, clips).collect())) == sorted(want)
    found = {p for p, _ in want}
    assert sorted(r.pos for r in labels.missing(entries, clips).collect()) == [p for p, label, _, _ in entry_rows if label != "meh" and p not in found]
    plan = labels.resolve(entries, clips)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_split_sizes(spark):
    clips = spark.createDataFrame([(i, f"c{i % 3}") for i in range(31)] + [(99, "lone")], "id long, category string")
    got = {(r.category, r.part): r["count"] for r in readers.split(clips, 0.25, 1).groupBy("category", "part").count().collect()}
    assert got[("c0", "test")] == round(11 * 0.25) and ("lone", "test") not in got
    with pytest.raises(ValueError):
        readers.split(clips, 1.0, 1)


def test_learned_sort_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(0, 0.3, 16) + (1 if i % 2 else -1)).tolist()) for i in range(60)]
    clips = spark.createDataFrame(rows, "id long, embedding array<double>")
    votes = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(20)], "id long, label string")
    top = training.learned_sort(clips, votes).orderBy("pos").limit(30).collect()
    assert all(r.id % 2 for r in top)


def test_mixture_threshold(spark):
    rng = np.random.default_rng(1)
    s = spark.createDataFrame([(float(x),) for x in np.concatenate([rng.normal(0, 0.1, 500), rng.normal(1, 0.1, 200)])], "score double")
    assert 0.4 < training.mixture_threshold(s) < 0.6
    assert training.mixture_threshold(s.limit(1)) == 0.5


def test_boxes(spark):
    d = spark.createDataFrame([([(0.3, [1.234, 2.0, 3.0, 4.0], "cat"), (0.9, [1.0, 2.0, 3.0, 4.0], "cat"), (0.95, [1.0, 2.0, 3.0, 4.0], "dog")],)], "d array<struct<confidence: double, bbox: array<double>, label: string>>")
    assert [x.confidence for x in d.select(detect.boxes_above(F.col("d"), "cat", 0.25).alias("b")).first().b] == [0.9, 0.3]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/hello.txt").write_text("hello")
    (tmp_path / "t/bye.md").write_text("bye")
    clips = readers.read_folder(spark, str(tmp_path / "t"), "paragraph")
    assert sorted(r.filename for r in clips.select("filename").collect()) == ["bye.md", "hello.txt"]
    with pytest.raises(ValueError):
        readers.read_folder(spark, str(tmp_path), "smell")
    (tmp_path / "l.json").write_text(json.dumps({"labels": [{"md5": "a", "label": "good"}, {"md5": "b", "label": "Bad"}]}))
    assert [(r.pos, r.label) for r in readers.read_json_labels(spark, str(tmp_path / "l.json")).collect()] == [(0, "good"), (1, "Bad")]
    (tmp_path / "l.csv").write_text(" MD5 ,Label,x\n a ,GOOD,1\nb,,2\n")
    assert [tuple(r) for r in readers.read_csv_labels(spark, str(tmp_path / "l.csv")).collect()] == [("a", "good")]
    (tmp_path / "d.json").write_text(json.dumps({"weights": {"0.weight": [[1.0]], "0.bias": [0.0], "2.weight": [[1.0]], "2.bias": [0.0]}}))
    assert tuple(readers.read_detectors(spark, str(tmp_path / "d.json")).select("threshold", "media_type").first()) == (0.5, "audio")
    sinks.write_dataset(clips, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert readers.tones(spark).agg(F.max("frequency")).first()[0] == 1150


def test_usable_labels(spark):
    e = spark.createDataFrame([(0, "meh", "a.wav", None, None), (1, "good", "", "b.PNG", None), (2, "bad", None, None, "c.png"), (3, "bad", "d.wav", None, None), (4, "good", None, None, None)], "pos long, label string, path string, file string, filename string")
    assert [(r.pos, r.place) for r in readers.usable_labels(e).orderBy("pos").collect()] == [(1, "b.PNG"), (2, "c.png")]


def test_no_row_caps(spark, tmp_path):
    from lumenclip.operators import detect, evaluate
    from lumenclip.plans import model

    vectors = [(i, i, [float(i), 1.0]) for i in range(1003)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert model.label_queries(spark, str(tmp_path)).select("query").distinct().count() == 1003
    detectors = spark.createDataFrame([(f"d{i}", "vector", [[1.0, 0.0]], [0.0], [1.0], 0.0, 0.5) for i in range(1003)], detect.DETECTOR)
    clips = spark.createDataFrame([(i, "vector", [1.0, 2.0]) for i in range(3)], "id long, media_type string, embedding array<float>")
    assert detect.detector_scores(clips, detectors).count() == 3 * 1003
    steps = spark.range(100_003).selectExpr("id AS step", "1L AS id", "id % 2 = 0 AS predicted")
    assert evaluate.prediction_flips(steps).count() == 100_003


def samples(spark, n=60, d=8):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(i, (rng.normal(0, 1, d) + (0.7 if i % 3 else -0.7)).tolist()) for i in range(n)], "id long, embedding array<double>")


def test_gradients_of_all_tasks_fit_the_same_network(spark):
    known = samples(spark).withColumn("positive", F.col("id") % 3 > 0).withColumn("model", F.explode(F.array(F.lit(5).cast("long"), F.col("id") % 2)))
    one, many = (training.fit_models(known.repartition(3), 1, 0, epochs=4, one_task=most) for most in (1000, 10))
    assert set(one) == set(many) == {0, 1, 5}
    for k in one:
        assert np.allclose(one[k].flat(), many[k].flat(), atol=1e-9)


def test_threshold_of_each_key(spark):
    rng = random.Random(9)
    rows = [(i % 3, rng.randrange(40) / 40, rng.random() < 0.4) for i in range(400)]
    got = {r.k: r.threshold for r in evaluate.optimal_threshold(spark.createDataFrame(rows, "k int, score double, positive boolean"), 1, "k").collect()}
    for k in range(3):
        own = [r for r in rows if r[0] == k]
        assert got[k] == training.best_threshold(np.array([r[1] for r in own]), np.array([r[2] for r in own]).astype(int), 1)


def test_picked_clips_are_numbered_over_blocks(spark):
    source = spark.range(5, 60_005, 7).selectExpr("id", "concat('n', id) AS filename", "md5(string(id)) AS md5")
    got = labels.cherry_pick(source, source.select("filename"), source.select("md5").limit(0), spark.range(100)).orderBy("id").collect()
    assert [r.new_id for r in got] == list(range(100, 100 + len(got))) and len(got) == source.count()
