"""Models along votes and logs, against networks that are fitted one by one; the hashing embedder against plain Python."""

import math
import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from lumenclip.functions import embedding, scratch
from lumenclip.operators import ranking, stacked, steps, training, voting


def clip_rows(n=60, d=8, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, "a" if i % 3 else "b", (rng.normal(0, 1, d) + (0.7 if i % 3 else -0.7)).tolist()) for i in range(n)]


@pytest.mark.parametrize("inclusion", [-1, 0, 2])
def test_stacked_networks_equal_single_ones(inclusion):
    rng = np.random.default_rng(inclusion + 5)
    x, y = rng.normal(size=(50, 6)), rng.integers(-1, 2, (90, 50)).astype(np.int8)
    y[3], y[4] = -1, 1
    y[3, :2] = 0
    flat = stacked.fit_stacked(x, y, inclusion, 7, 30)
    for f, row in zip(flat, y, strict=True):
        assert np.allclose(f, training.Network.fitted(x[row >= 0], row[row >= 0], inclusion, 7, 30).flat(), atol=1e-8)
    assert np.array_equal(stacked.score_stacked(x, flat[:2])[:, 1], training.Network.of(flat[1]).score(x))


def test_models_of_few_rows_work_on_their_own(monkeypatch):
    """Halves of the votes once took part in products over all of them."""
    rng, width, plain = np.random.default_rng(4), set(), np.matmul
    x, y = rng.normal(size=(40, 6)), np.full((9, 40), -1, np.int8)
    for row in y[:8]:
        seen = rng.permutation(40)[:20]
        row[seen] = rng.integers(0, 2, 20)
    with monkeypatch.context() as patch:
        patch.setattr(np, "matmul", lambda a, b, **k: (width.add(b.shape[-1]), plain(a, b, **k))[1])
        flat = stacked.fit_stacked(x, y, 1, 3, 20)
    assert width <= {20, 7, 0}
    for f, row in zip(flat[:8], y, strict=False):
        assert np.allclose(f, training.Network.fitted(x[row >= 0], row[row >= 0], 1, 3, 20).flat(), atol=1e-8)


def test_few_models_are_stacked_at_once(monkeypatch):
    """More than these leave a core's cache: many small models took twice as long."""
    sizes, plain = [], stacked._fit
    monkeypatch.setattr(stacked, "_fit", lambda x, y, *a: (sizes.append(len(y)), plain(x, y, *a))[1])
    stacked.fit_stacked(np.ones((20, 3)), np.tile([0, 1], (40, 10)).astype(np.int8), epochs=1)
    assert sum(sizes) == 40 and max(sizes) <= 16


def test_simulated_voting_by_brute_force(spark):
    rows = [("one", *r) for r in clip_rows(150)] + [("two", *r) for r in clip_rows(30, seed=8)] + [("lone", 0, "a", [0.0] * 8)]
    clips = spark.createDataFrame(rows, "dataset string, id long, category string, embedding array<double>")
    got = {(r.dataset, r.seed, r.category, r.t): (r.cost, r.fpr, r.fnr) for r in voting.simulate_voting(clips, [1, 2], 1, epochs=6).collect()}
    chance = lambda seed, target, i, what: int(md5(f"{seed}:{target}:{i}:{what}".encode()).hexdigest()[:12], 16) / 2**48
    want = {}
    for name in ("one", "two", "lone"):
        for seed in (1, 2):
            for target in {r[2] for r in rows if r[0] == name}:
                own = [r for r in rows if r[0] == name]
                test = [r for r in own if chance(seed, target, r[1], "part") < 0.5]
                vote = sorted((r for r in own if r not in test), key=lambda r: (chance(seed, target, r[1], "order"), r[1]))
                x, y = np.array([r[3] for r in vote]), np.array([r[2] == target for r in vote]).astype(int)
                xt, yt = np.array([r[3] for r in test]), np.array([r[2] == target for r in test])
                if not len(yt) or yt.all() or not yt.any():
                    continue
                for t in range(2, len(vote) + 1):
                    if 0 < y[:t].sum() < t:
                        said = training.Network.fitted(x[:t], y[:t], 1, seed, 6).score(xt) >= training.cross_calibrated(x[:t], y[:t], 1, seed, 6)
                        fpr, fnr = said[~yt].mean(), (~said[yt]).mean()
                        want[name, seed, target, t] = (fpr + 2 * fnr, fpr, fnr)
    assert got.keys() == want.keys() and len({k[:3] for k in want}) == 8 and max(k[3] for k in want) > voting.CHUNK
    # Scores that differ in their last digit may tip a clip over a threshold.
    assert sum(not np.allclose(got[k], want[k], atol=1e-5) for k in want) <= len(want) // 100
    votes, _ = voting.dealt_votes(clips, [1], spark.createDataFrame([("one", "a")], "dataset string, target string"))
    assert {tuple(r) for r in votes.select("dataset", "seed", "target").distinct().collect()} == {("one", 1, "a")}


def replay(votes, start=None, epoch=0):
    """epoch, seq, labels after each vote but ``clear``."""
    state, out = dict(start or {}), []
    for seq, clip, vote in votes:
        if vote == "clear":
            state, epoch = {}, epoch + 1
            continue
        if state.get(clip) == vote:
            del state[clip]
        else:
            state[clip] = vote
        out.append((epoch, seq, dict(state)))
    return out, state, epoch


def log_votes(n, seed=5):
    rng = random.Random(seed)
    return [(i, None, "clear") if i in (70, 71, n - 40) else (i, rng.randrange(33), rng.choice(["good", "bad"])) for i in range(n)]


VOTE = "seq long, clip_id long, vote string"


def test_every_step_of_a_log(spark, monkeypatch, tmp_path):
    """Two chunks and blocks of models, three epochs, labels of clips that aren't there."""
    monkeypatch.setattr(steps, "AT_ONCE", 50)
    rows = [(i, e) for i, _, e in clip_rows(30)]
    clips, x = spark.createDataFrame(rows, "id long, embedding array<double>"), {i: np.array(e) for i, e in rows}
    votes = log_votes(220)
    log = steps.Log(steps.vote_log(spark.createDataFrame(votes, VOTE).repartition(3)))
    told, _, _ = replay(votes)
    count = lambda state, v: sum(s == v for s in state.values())
    assert sorted(map(tuple, log.counts.collect())) == sorted((e, s, count(st, "good"), count(st, "bad")) for e, s, st in told)
    ends = {e: st for e, _, st in told}
    models = steps.step_models(log, clips, 1).persist()
    got = {(r.epoch, r.step): r for r in models.collect()}
    want = {(e, s): st for e, s, st in told if count(st, "good") and count(st, "bad") and len(st.keys() & x.keys()) > 1}
    assert got.keys() == want.keys() and len(got) > 150
    said = {}
    for key, r in got.items():
        ids = sorted(want[key].keys() & x.keys())
        own, y = np.stack([x[i] for i in ids]), np.array([want[key][i] == "good" for i in ids]).astype(int)
        if key[1] % 20 == 0:
            net = training.Network.fitted(own, y, 1)
            assert np.allclose(net.flat(), r.p, atol=1e-6)
            assert r.threshold == pytest.approx(training.best_threshold(net.score(own), y, 1), abs=1e-5)
        scores = training.Network.of(np.array(r.p)).score(np.stack([x[i] for i in sorted(x)]))
        said[key] = dict(zip(sorted(x), scores >= r.threshold, strict=True))
    numbers = {(r.epoch, r.m): (r.epoch, r.step) for r in got.values()}
    result = {(r.epoch, r.step): r for r in steps.progress(log, clips, models, 1).collect()}
    assert result.keys() == got.keys()
    for key, r in result.items():
        end, before = ends[key[0]], numbers.get((key[0], got[key].m - 1))
        rate = lambda v, wrong: np.mean([said[key][i] == wrong for i, s in end.items() if s == v and i in x] or [0])  # noqa: B023, E731
        assert r.error_cost == pytest.approx(rate("bad", True) + 2 * rate("good", False), abs=1e-4)
        free = x.keys() - want[key].keys()
        assert (r.num_labels, r.num_unlabeled) == (len(want[key]), len(free))
        assert r.num_flips == (sum(said[key][i] != said[before][i] for i in free - want[before].keys()) if before else 0)
    models.unpersist()
    # A table of steps is only added to; another data set or inclusion has a table of its own.
    path, part = str(tmp_path / "steps"), spark.createDataFrame(votes[:100], VOTE)
    folder = steps.update_steps(path, part, clips, 1)
    first = {(r.epoch, r.m, r.threshold) for r in steps.read_steps(spark, folder).collect()}
    assert steps.update_steps(path, spark.createDataFrame(votes, VOTE), clips, 1) == folder
    table = spark.read.schema(steps.STEPS).parquet(f"{folder}/steps")
    assert table.count() == len(got) and first <= {(r.epoch, r.m, r.threshold) for r in table.collect()}
    assert len({folder, steps.steps_folder(path, clips, 0), steps.steps_folder(path, clips.limit(29), 1)}) == 3


def test_progress_keeps_models_off_the_driver(spark, monkeypatch):
    clips = spark.createDataFrame([(i, e) for i, _, e in clip_rows(30)], "id long, embedding array<double>")
    log = steps.Log(steps.vote_log(spark.createDataFrame(log_votes(120), VOTE)))
    models = scratch.written(steps.step_models(log, clips))
    with monkeypatch.context() as patch:
        for way in ("collect", "toLocalIterator", "toPandas"):
            patch.setattr(type(models), way, lambda *_: pytest.fail("models came to the driver"))
        told = steps.progress(log, clips, models)
    assert told.count() == models.count() > 50


def test_steps_of_a_stream(spark, tmp_path):
    rows = [(i, e) for i, _, e in clip_rows(30)]
    clips = spark.createDataFrame(rows, "id long, embedding array<double>")
    votes = log_votes(150)
    for k in range(0, 150, 50):
        spark.createDataFrame(votes[k : k + 50], VOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VOTE).parquet(str(tmp_path / "in"))
        assert (q := steps.steps_stream(stream, clips, str(tmp_path / "live")).trigger(availableNow=True).start()).awaitTermination(200) and not q.exception()
    folder = steps.steps_folder(str(tmp_path / "live"), clips, 0)
    got = {(r.epoch, r.step): (r.num_good, r.num_bad, r.threshold) for r in spark.read.parquet(f"{folder}/steps").collect()}
    whole = steps.step_models(steps.Log(steps.vote_log(spark.createDataFrame(votes, VOTE))), clips)
    want = {(r.epoch, r.step): (r.num_good, r.num_bad, r.threshold) for r in whole.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    _, state, epoch = replay(votes)
    left = [r for r in spark.read.parquet(f"{folder}/state/batch=2").collect() if r.clip_id is not None]
    assert {r.clip_id: r.label for r in left} == state and {r.epoch for r in left} <= {epoch}


TEXTS = ["", None, " .,; ", "one two two", "Été ÉTÉ été 42", "word " * 500, "one two two", "\n日本語 text"]


def hashed(text, buckets):
    v = np.zeros(buckets)
    for w, n in Counter(re.findall(r"[^\W_]+", (text or "").lower())).items():
        code = int(md5(w.encode()).hexdigest()[:12], 16)
        v[code % buckets] += n * (1 - 2 * (code // buckets % 2))
    return v / np.linalg.norm(v) if v.any() else v


@pytest.mark.parametrize("buckets", [2, 256])
def test_embedder_and_text_sort(spark, buckets):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r.id: r.embedding for r in embedding.embed_texts(texts, buckets).collect()}
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[i], hashed(t, buckets), atol=1e-12)
    for q in ("two words", "été", "?"):
        score = {r.id: r.score for r in embedding.text_similarity(texts, q, buckets).collect()}
        assert all(math.isclose(score[i], hashed(t, buckets) @ hashed(q, buckets), abs_tol=1e-12) for i, t in enumerate(TEXTS))
    ranked = ranking.text_sort(texts, "two words").orderBy("pos").collect()
    assert [r.id for r in ranked][:2] == [3, 6] and len(ranked) == len(TEXTS)
    with pytest.raises(ValueError):
        embedding.text_similarity(texts, " ")


def test_only_clips_without_a_vector_are_embedded(spark, monkeypatch):
    clips = spark.createDataFrame([(1, "x/a.txt", "alpha"), (2, "b.txt", "beta"), (3, "c.txt", None), (4, "y/a.txt", "delta")], "id long, filename string, text string")
    vectors = spark.createDataFrame([("q/a.txt", [2.0]), ("a.txt", [1.0]), ("b.txt", None), ("none", [3.0])], "name string, embedding array<float>")
    seen, plain = [], embedding.embed_texts
    monkeypatch.setattr(embedding, "embed_texts", lambda t, b: (seen.extend(r.id for r in t.collect()), plain(t, b))[1])
    got = {r.id: r for r in embedding.with_vectors(clips, vectors).collect()}
    assert sorted(seen) == [2, 3] and {i: r.precomputed for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True}
    assert got[1].embedding == got[4].embedding == [1.0] and np.allclose(got[2].embedding, hashed("beta", 256)) and not any(got[3].embedding)
    assert all(len(r) == 3 for r in got.values())


def test_embedding_gathers_nothing(spark, monkeypatch):
    """Sums of all of a task's texts grew with the input; now rows stand alone, a few at a time."""
    monkeypatch.setattr(embedding, "AT_ONCE", 3)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    for df in (embedding.embed_texts(texts, 8), embedding.text_similarity(texts, "two words", 8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan
    got = embedding.embed_texts(texts, 8).collect()
    assert [r.id for r in got] == list(range(len(TEXTS))) and all(np.allclose(r.embedding, hashed(TEXTS[r.id], 8)) for r in got)
