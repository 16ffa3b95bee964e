"""The subpackage's queries against their SQL, and the pipeline from end to end."""

import random

import corpus_pipeline
import pytest
from conftest import DATA
from lumenclip.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_dedup_stage_by_brute_force(spark, seed):
    rng, texts = random.Random(seed), []
    bases = [[str(rng.randrange(500)) for _ in range(n)] for n in (9, 20, 50, 50, 150, 150)]
    for i in range(240):
        w = list(bases[i % 6])
        for _ in range(rng.randrange(len(w) // 25 + 2)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        if i % 5 == 0:
            w += [str(rng.randrange(10**6)) for _ in range(len(w) // 7)]
        texts.append(" ".join(w))
    # One changed word of 50: 41/51 on five words, 45/51 on three.  15 words more than 100: about 0.87 on both.
    one, two = ([f"{x}{j}" for j in range(n)] for x, n in (("p", 50), ("q", 100)))
    planted = [one, one[:25] + ["other"] + one[26:], two, [*two, *(f"r{j}" for j in range(15))]]
    texts += [" ".join(w) for w in planted]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, DATA).collect()}
    assert kept == {i for i in range(len(sets)) if find(i) == i}
    assert not kept & {241, 243}
