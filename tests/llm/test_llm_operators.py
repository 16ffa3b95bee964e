"""The training-data operators on small and odd inputs, against brute force where SQL has no say."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from lumenclip.llm import bpe, components, jaccard, licenses, lines, media, packing, quality, rules, shards, toxicity
from lumenclip.llm.common import small_batches
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
TEXTS = {
    1: None, 2: "", 3: " \n\t ", 4: "one two", 5: "Under the MIT License. Under the MIT license!", 6: "a  b   c\n \n d ", 7: "İstanbul Σς é 日本語 it's 12,345 <|endoftext|>", 8: "x" * 9000,
    9: "word " * 6000, 10: "one two", 11: " ".join(f"w{i}" for i in range(60)), 12: " ".join(f"w{i}" for i in range(59)) + " other", 13: "\n".join(["the same line again and again and again here"] * 5),
    14: "Apache License, Version 2.0 and CC BY-NC 4.0",
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, n int, plain string, line string, host string, _doc string"


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark)
    rows = [(i, t, None, None if i % 2 else "s", 0, "k", 1, "p", "l", "h", "d") for i, t in TEXTS.items()]
    return spark.createDataFrame([*rows, rows[3], (None, "a row without an id", None, "s", 0, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_licenses(docs, empty):
    got = by_id(licenses.license_scan(docs))
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].last_word, got[5].base_labels) == (8, 2, 0, 4, "mit")
    assert got[14].base_labels == "apache-2,cc-by-nc" and (got[1].n_words, got[1].labels, got[1].score) == (0, "", 0.0)
    assert licenses.license_scan(empty).count() == 0 and len({n[2] for n in licenses.NOTICES}) == len(licenses.NOTICES) > 200


def plainest(phrase):
    """A phrase without what may lack, and with the first of its alternatives."""
    while (less := re.sub(r"\(([^()|]*)\|[^()]*\)(?!\?)", r"\1", re.sub(r"\([^()|]*\)\?", "", phrase))) != phrase:
        phrase = less
    return phrase.replace(" ?", " ")


def test_licenses_without_gate(spark):
    names = [n for _, _, names in licenses.LICENSES for n in names]
    texts = [t.format(n) for n in names for t in ("spdx license identifier {}", "licensed under the terms of the {}", "license is {}", "under the {} license", "the {} licence", "licence {}", "{}")]
    texts += [plainest(n[2]) for n in licenses.NOTICES] + ["the public domain", "SPDX-License-Identifier: LGPLv3", "FreeBSD License", "licensed under GPLv2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.rule) for r in licenses.detections(docs).where("rule IS NOT NULL").select("doc_id", "rule").collect()}
    plain = ["".join(f" {w} " for w in re.findall(r"[a-z0-9]+", t.lower())) for t in texts]
    assert got == {(i, r[0]) for r in licenses.rules() for i, t in enumerate(plain) if re.search(r[3], t)}
    assert all(r[2] in licenses.needed(r[3]) for r in licenses.gated_rules())
    assert all(re.search(licenses.gate(), plain[i]) for i, _ in got) and {r[0] for r in licenses.rules()} == {r for _, r in got}
    labels = {r.doc_id: r.labels for r in licenses.license_scan(docs).where(f"doc_id >= {len(texts) - 3}").collect()}
    assert [labels[i] for i in sorted(labels)] == ["lgpl-3.0", "bsd-2-clause", "gpl-2.0"]


def test_licenses_priority_containment_and_ties(spark):
    texts = ["licensed under the GNU General Public License version 2", "This code is under the MIT License and under the Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "CC BY-NC-SA 4.0 license", "under the mit license under the mit license"]
    got = by_id(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    # A longer detection holds the shorter ones (gpl) back; base labels stay even within another's place; repeats tie.
    assert [got[i].labels for i in range(5)] == ["gpl-2.0", "apache-2,mit", "mit", "cc-by-nc,cc-by-nc-sa", "mit"]
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 4)


def test_lines(docs, empty):
    got = {r.row.doc_id: r for r in lines.kept_lines(docs).collect()}
    assert (got[13].n_lines, got[13].n_equal, got[13].row.text) == (5, 4, "the same line again and again and again here")
    assert (got[12].n_near, got[12].row.text, got[10].row.text) == (1, "", "")
    assert got[1].row.text is None and got[None].row.text == "a row without an id"
    assert lines.line_dedup(empty).count() == 0


def test_lines_of_repeated_rows(spark):
    rows = [(1, "shared line", "keep me", 7), (5, "unique alpha text", "b", 8), (5, "shared line", "c", 9), (6, "other\n \nother", "d", 1), (6, "other\n \nother", "e", 2), (None, "no id here", "f", 3), (None, "no id here", "g", 4), (None, "nor here", "h", 5), (8, None, "i", 6), (8, None, "j", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _doc string, n_lines int").withColumns({"_bucket": F.col("n_lines"), "row": F.col("_doc"), "_text": F.lit("x"), "gone": F.lit(1)})
    got = lines.line_dedup(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    by = {r._doc: r for r in got.collect()}
    assert all((by[x].n_lines, by[x]._bucket, by[x].row, by[x]._text, by[x].gone) == (n, n, x, "x", 1) for _, _, x, n in rows)
    assert (by["keep me"].text, by["b"].text, by["c"].text, by["h"].text, by["i"].text) == ("shared line", "unique alpha text", "", "nor here", None)
    assert sorted((by["d"].text, by["e"].text)) == [" ", "other\n "] and sorted((by["f"].text, by["g"].text)) == ["", "no id here"]


@pytest.mark.parametrize("seed", range(2))
def test_near_lines_by_brute_force(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(60):
        w = [rng.choice("abcdefg") for _ in range(rng.randrange(7, 14))] if i % 3 == 0 else list(rows[-1][1].split())
        if i % 3:
            for _ in range(rng.randrange(3)):
                j, kind = rng.randrange(len(w)), rng.randrange(3)
                w[j : j + (kind < 2)] = [] if kind == 0 else [rng.choice("xyz")]
        rows.append((i, " ".join(w)))

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        s, t = sorted((a, b), key=len)
        return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))

    want = {i for i, t in rows if any(u == t or (min(len(t.split()), len(u.split())) >= 8 and near(t.split(), u.split())) for j, u in rows if j < i)}
    got = {r.row.doc_id for r in lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_equal + n_near > 0").collect()}
    assert got == want


def test_tokens(docs, empty):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in by_id(bpe.byte_level_bpe(docs, RANKS, public_tokenizers.PATTERN)).items():
        ids = own.encode_ordinary(TEXTS.get(i, "a row without an id") or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((TEXTS.get(i, "a row without an id") or "").encode()).hexdigest()
    t = Tokenizer.from_file(BYTE)
    pieces = packing.best_fit_packing(docs, BYTE).collect()
    for i, text in TEXTS.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in pieces if p.doc_id == i})
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine) and sum(n for _, _, n, _ in mine) == len(ids)
        assert all(n == 1024 for k, _, n, _ in mine if k)
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert filled.get(p.sequence_id, 0) == p.offset
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 1024 and packing.best_fit_packing(empty, BYTE).count() == 0


def test_packing_unsorted_and_repeated(spark):
    rows = [(None if i % 3 else 5, "a b c " * (i % 40)) for i in range(600)]
    pieces = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), BYTE)
    got = packing.pack(pieces, 600, per_block=100, longest_first=False).collect()
    assert len(got) == pieces.count() and len({p.sequence_id >> 36 for p in got}) == 6
    filled = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert filled.get(p.sequence_id, 0) == p.offset
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 1024


def test_texts_longer_than_a_step(spark):
    from tokenizers import Tokenizer

    long = " ".join(f"w{i} the end," for i in range(800_000))
    df = spark.createDataFrame([(1, "a b"), (2, long), (3, "x" * 300_000), (4, "a <|endoftext|> b")], "doc_id long, text string")
    t = Tokenizer.from_file(WORD)
    got = {r.doc_id: r.ids for r in shards.encoded(df, WORD, 2, False).collect()}
    for i, text in ((1, "a b"), (2, long), (4, "a <|endoftext|> b")):
        assert np.frombuffer(got[i], "<u2").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]
    assert by_id(rules.quality_rules(df.withColumn("source", F.lit("s"))))[2].n_words == 2_400_000
    assert by_id(jaccard.jaccard_components(df))[2].component_id == 2


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.OpenBins(10, 1)
    assert [bins.place(n)[0] for n in (6, 7, 4)] == [0, 1, 2]


def test_shards(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    shards.write_shards(docs, WORD, str(tmp_path / "s"), block_ids=500, per_shard=5)
    got = shards.read_shards(spark, str(tmp_path / "s")).orderBy("start").collect()
    t, at = Tokenizer.from_file(WORD), 0
    assert [r.doc_id for r in got] == [None, *sorted([*TEXTS, 4])]
    for r in got:
        ids = np.array([*t.encode(TEXTS.get(r.doc_id, "a row without an id") or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    record = spark.read.parquet(str(tmp_path / "s")).where("n_docs > 1").first().asDict()
    block = shards.BlockReader(record)
    assert block.get(987654321) is None and len(block.get(int(block.keys[0]), int(block.repeats[0]))) > 0
    found = shards.lookup(spark, str(tmp_path / "s"), spark.createDataFrame([(9,), (4,), (987654321,), (2,)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.repeat) for r in found) == [(2, 0), (4, 0), (4, 1), (9, 0)]
    assert all(list(r.ids) == [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2] for r in found)
    shards.write_shards(empty, WORD, str(tmp_path / "e"))
    assert shards.read_shards(spark, str(tmp_path / "e")).count() == 0


def test_rules(docs, empty):
    got = by_id(rules.quality_rules(docs))
    assert got[9].n_repeat_words == 6000 and got[9].base_failed and not got[11].base_failed
    assert (got[13].n_dup_lines, got[1].n_words, got[14].n_symbols) == (4, 0, 0)
    assert rules.quality_rules(empty).count() == 0


def test_a_bad_host(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(i, bad if i % 10 == 0 else good, f"h{i % 30}") for i in range(3000) if i % 30 != 7] + [(9000 + i, bad if i % 3 else good, "planted") for i in range(300)]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), times=2.0)
    assert {r.source for r in got.where("host_failed").select("source").distinct().collect()} == {"planted", "h0", "h10", "h20"}
    assert got.where("host_failed AND NOT base_failed").count() == 100 and got.where("kept AND (base_failed OR host_failed)").count() == 0


def test_host_verdicts_change_what_is_kept(spark):
    """Each rule has hosts of its own: one fails symbols, one lines; one is trusted on symbols; the others are usual."""
    good = " ".join(f"w{i}" for i in range(60))
    signs, same = good + " ######## ****", good + "\nx\nx\nx"
    rows = []
    for h in range(20):  # 1 of 20 fails symbols, 1 of 20 lines
        rows += [(f"h{h}", signs if i % 20 == 0 else same if i % 20 == 1 else good) for i in range(200)]
    rows += [("signs", signs if i % 2 else good) for i in range(200)] + [("lines", same if i % 2 else good) for i in range(200)] + [("fine", signs if i == 0 else good) for i in range(4000)]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = rules.quality_rules(df).collect()
    assert {r.source for r in got if r.host_failed} == {"signs", "lines"} and not any(r.base_failed for r in got)
    # Clean documents go with their host; a failure on a trusted host stays; elsewhere it goes.
    assert not any(r.kept for r in got if r.source in ("signs", "lines"))
    assert all(r.kept for r in got if r.source == "fine") and [r.excused for r in got if r.source == "fine" and r.n_symbols > 6] == [True]
    usual = [r for r in got if r.source.startswith("h")]
    assert all(r.kept == (10 * r.n_symbols <= r.n_words and 10 * r.n_dup_lines <= 3 * r.n_lines) for r in usual) and sum(not r.kept for r in usual) == 400


def test_no_significant_expression_is_left_out(spark, monkeypatch):
    """A number of expressions once cut the rest off."""
    monkeypatch.setattr(toxicity, "CELLS", 1, raising=False)
    rows = [(f"common words {'vile nasty' if i % 2 else 'kind gentle'}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "text string, y int")
    keys = {int(k).to_bytes(5, "big") for k in toxicity.fit_counts(df, df.select("text")).among.keys}
    assert {b"rds v", b"rds k"} <= keys


def test_kneser_ney_by_dictionaries(spark):
    """Every expression's ratio from plain dictionaries over bytes, on class texts and more documents without a label."""
    rng, parts = random.Random(5), ["ka", "lo", "mi", "tu", "ré", "Zz9"]
    word = lambda y: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) + ("vile" if y and rng.random() < 0.3 else "")
    rows = [(i, rng.choice([" ", "... "]).join(word(i % 2) for _ in range(rng.randrange(0, 30))), i % 2) for i in range(120)]
    more = [(1000 + i, " ".join(word(i % 9 == 0) for _ in range(20)), None) for i in range(60)] + [(2000, None, None), (2001, "--", None)]
    df, docs = spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame(rows + more, "doc_id long, text string, y int")
    model = toxicity.fit_counts(df, docs.select("doc_id", "text"))

    def grams(text):
        runs = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        stream = b" " + b"".join(r + b" " for r in runs)
        return [stream[i : i + 5] for i in range(len(stream) - 4)], sum(map(len, runs))

    counts, texts, shared = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], collections.Counter()
    for _, t, y in rows:
        g, _ = grams(t)
        counts[y].update(g)
        texts[y].update({*g, *(x[:4] for x in g)})
    for _, t, _ in rows + more:
        shared.update(set(grams(t)[0]))

    def gain(g):
        h, stat = g[:4], 0.0
        a, n = [texts[k][g] for k in (0, 1)], [texts[k][h] for k in (0, 1)]
        p = sum(a) / max(sum(n), 1)
        for k in (0, 1):
            stat += 2 * sum(x * np.log(x / e) for x, e in ((a[k], n[k] * p), (n[k] - a[k], n[k] * (1 - p))) if x)
        if stat < toxicity.SIGNIFICANT:
            return 0.0
        back, logs = shared[g] / sum(v for x, v in shared.items() if x[:4] == h), []
        for c in counts:
            seen, types = sum(v for x, v in c.items() if x[:4] == h), sum(x[:4] == h for x in c)
            logs.append(np.log((max(c[g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types * back) / seen if seen else back))
        return logs[1] - logs[0]

    told = {g: gain(g) for g in {*counts[0], *counts[1]}}
    assert sum(v != 0 for v in told.values()) == len(model.logs[0]) > 3

    def ratio(text):
        g, size = grams(text)
        mean = sum(told.get(x, 0.0) for x in g) / max(size, 1)
        return np.sign(mean) * np.log1p(1000 * abs(mean))

    import pyarrow as pa

    every = [t for _, t, _ in rows + more]
    assert np.allclose(model.ratios(pa.array(every)), [ratio(t) for t in every], rtol=1e-9, atol=1e-9)
    mean = [np.mean([ratio(t) for _, t, y in rows if y == k]) for k in (0, 1)]
    assert mean[1] > mean[0]


def test_every_expression_of_every_labelled_row_counts(spark):
    """Expressions that differ by little were pruned, and rows beyond a sample weren't counted."""
    rng = random.Random(8)
    rows = [(i, " ".join([f"w{rng.randrange(9)}{rng.randrange(9)}x" for _ in range(12)] + ["so", "vile" if i % 4 == 0 else "kind"]), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample_rows=20).counts.value
    counted = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 > 1]
    grams = lambda t: [f" {t} ".encode()[i : i + 5] for i in range(len(t) - 2)]
    texts = [collections.Counter(x for t, y in counted if y == k for x in {*grams(t), *(g[:4] for g in grams(t))}) for k in (0, 1)]
    lg = lambda a, n: math.lgamma(a + 0.5) + math.lgamma(n - a + 0.5) - math.lgamma(n + 1) - math.log(math.pi)
    every = sorted(g for g in {*texts[0], *texts[1]} if len(g) == 5)
    odds = [lg(texts[0][g], texts[0][g[:4]]) + lg(texts[1][g], texts[1][g[:4]]) - lg(texts[0][g] + texts[1][g], texts[0][g[:4]] + texts[1][g[:4]]) for g in every]
    weights = dict(zip(every, toxicity.differing(np.array(odds)), strict=True))
    plain = toxicity.fit_counts(spark.createDataFrame(counted, "text string, y int"), df.select("text"))
    keys = [int(k).to_bytes(5, "big") for k in plain.among.keys]
    assert np.array_equal(model.among.keys, plain.among.keys) and {g for g in every if 0 < texts[0][g] < texts[0][g[:4]] and b"w" in g} <= {*keys}
    assert np.allclose(plain.weights, [weights[g] for g in keys], rtol=1e-6) and 0 < min(plain.weights) < 0.01 and max(plain.weights) > 0.9
    w = plain.weights
    assert np.allclose(np.exp(model.logs), w * np.exp(plain.logs) + (1 - w) * plain.shared, rtol=1e-9)
    # A key that shares its slot with others is found, and one that isn't there is not.
    many = toxicity.Among(np.arange(0, 1 << 23, 3))
    i, at = many.find(np.array([0, 1, 3, 2999997, 5, 1 << 24]))
    assert i.tolist() == [0, 2, 3] and many.keys[at].tolist() == [0, 3, 2999997]


def test_a_curve_of_one_class_falls_back(spark):
    rows = [(i, " ".join([f"c{i % 9}", "plain", *(["vile"] * 3 if i % 3 == 0 else ["fine"] * 3), f"x{i}"])) for i in range(400)]
    labels = [(i, 1 if i % 3 == 0 else 0) for i, _ in rows if not (zlib.crc32(str(i).encode()) % 5 == 1 and i % 3 == 0)]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id for r in got.where("predicted = 1").collect()} == {i for i, _ in rows if i % 3 == 0}


def test_quadratic_discriminant_by_numpy(spark):
    data = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r.doc_id: r.score for r in quality.quality_classifier(docs, labels).collect()}
    x = {r.doc_id: np.array(r.x) for r in quality.statistics(docs).collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    own = [np.array([x[i] for i, q in known if q == k]) for k in (0, 1)]
    pooled = sum(np.cov(o.T, bias=True) * len(o) for o in own) / len(known)
    log = []
    for o in own:
        cov = 0.9 * np.cov(o.T, bias=True) + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.maximum(np.diag(pooled), 1e-4))
        log.append(lambda v, m=o.mean(0), inv=np.linalg.inv(cov), det=np.linalg.slogdet(cov)[1], p=len(o) / len(known): -0.5 * (v - m) @ inv @ (v - m) - 0.5 * det + np.log(p))
    want = {i: 1 / (1 + np.exp(np.clip((log[0](v) - log[1](v)) / 2, -35, 35))) for i, v in x.items()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in want)


@pytest.mark.parametrize("op,label", [(quality.quality_classifier, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers(spark, docs, empty, op, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op(docs, none)
    assert got.count() == docs.count() and op(empty, none).count() == 0
    data = "/root/testdata/sf0.01"
    full = op(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    held = full.where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert ((held.predicted == held[label]).mean()) > 0.93 and held.score.between(0, 1).all()


def test_jaccard(docs, empty):
    got = by_id(jaccard.jaccard_components(docs))
    assert got[10].component_id == 4 and got[1].n_shingles == 0 and got[1].component_id == 1 and got[4].n_shingles == 1
    assert got[11].component_id == got[12].component_id == 11 and got[None].component_id is None
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_by_brute_force(spark, seed):
    rng, texts = random.Random(seed), []
    bases = [[str(rng.randrange(500)) for _ in range(n)] for n in (12, 40, 150, 150)]
    for i in range(160):
        w = list(bases[i % 4])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = str(rng.randrange(10**6))
        texts.append(" ".join(w))
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (re.findall(r"\S+", t) for t in texts)]
    root = list(range(len(sets)))

    def find(a):
        return a if root[a] == a else find(root[a])

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i].component_id for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_jaccard_of_texts_that_quote_the_same_passages(spark, monkeypatch):
    """Passages that ever more texts quote bring no text further than their copies: no clusters of all that quote."""
    rng, texts = random.Random(5), []
    passages = [[f"p{i}w{j}" for j in range(90)] for i in range(3)]
    for i in range(90):
        texts.append(" ".join([*passages[i % 3], *(f"own{i}x{j}" for j in range(45)), *passages[(i + 1) % 3][:45]]))
    for i in range(0, 12, 4):  # near copies: one word of 180 is another
        w = texts[i].split(" ")
        w[rng.randrange(90, 135)] = "other"
        texts.append(" ".join(w))
    seen, rare = [], jaccard._rare_tokens
    monkeypatch.setattr(jaccard, "_rare_tokens", lambda texts, *a: (seen.extend(r.rep for r in texts.collect()), rare(texts, *a))[1])
    rows = list(enumerate(texts))
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80))
    assert [got[i].component_id for i in range(len(texts))] == [*range(90), 0, 4, 8]
    assert set(seen) <= {0, 4, 8, 90, 91, 92}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 150: 100, 200: 100}


def test_media(spark):
    rng, t, rows = np.random.default_rng(0), (np.arange(120) + 0.5) / 120, []
    wave = np.cos(np.pi * np.outer(t, 2 * np.arange(1, 9)))
    for k in range(6):
        light = wave @ rng.normal(size=(8, 8)) @ wave.T
        image = (128 + 42 * light / light.std()).clip(0, 255)
        for j, x in enumerate((image, np.rot90(image), (image * 0.8 + 20 + rng.normal(0, 3, image.shape)).clip(0, 255), image[6:, 4:])):
            rows.append((100 * j + k, x.shape[1], x.shape[0], x.astype(np.uint8).tobytes()))
    rows += [(900, 4, 4, None), (901, 9, 9, b"short"), (None, 1, 1, b"x")]
    got = {r.image_id: r for r in media.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    right = [got[100 * j + k].class_id == k for j in range(4) for k in range(6)]
    assert sum(right) >= 22 and all(got[k].class_id == k for k in range(6))
    assert got[900].class_id == 900 and got[901].n_corners == 0 and got[None].class_id is None


def test_media_crops_and_a_crowd(spark):
    rng, t, rows, of = np.random.default_rng(1), (np.arange(120) + 0.5) / 120, [], {}
    wave = np.cos(np.pi * np.outer(t, 2 * np.arange(1, 9)))

    def image():
        light = wave @ rng.normal(size=(8, 8)) @ wave.T
        return (128 + 42 * light / light.std()).clip(0, 255)

    def add(i, x, first):
        rows.append((i, x.shape[1], x.shape[0], x.astype(np.uint8).tobytes()))
        of[i] = first

    crowd = image()
    add(0, crowd, 0)
    for i in range(1, 40):
        x = (crowd * rng.uniform(0.7, 1) + rng.uniform(0, 30) + rng.normal(0, rng.uniform(1, 4), crowd.shape)).clip(0, 255)
        y, x0 = rng.integers(0, 13, 2)
        add(i, x[y : y + 104, x0 : x0 + 104], 0)
    for i in range(1000, 1200, 10):
        x = image()
        y, x0 = rng.integers(0, 40, 2)
        add(i, x, i)
        add(i + 1, x[y : y + 80, x0 : x0 + 80], i)
    got = {r.image_id: r.class_id for r in media.image_copies(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary").repartition(4)).collect()}
    crops = [i for i in of if i % 10 == 1 and i > 1000]
    assert sum(got[i] == of[i] for i in crops) >= 0.9 * len(crops)
    assert sum(got[i] == 0 for i in range(1, 40)) >= 36 and all(got[i] in (i, of[i]) for i in of)


def test_media_repeated_ids_and_empty(spark):
    rng, t = np.random.default_rng(2), (np.arange(120) + 0.5) / 120
    wave, shape = np.cos(np.pi * np.outer(t, 2 * np.arange(1, 9))), "image_id long, width int, height int, pixels binary, same string, n int, bits string"

    def image():
        light = wave @ rng.normal(size=(8, 8)) @ wave.T
        return (128 + 42 * light / light.std()).clip(0, 255).astype(np.uint8)

    one, two, three = image(), image(), image()
    rows = [(i, x.shape[1], x.shape[0], x.tobytes(), "s", 1, "b") for i, x in ((1, one), (2, two), (2, two), (5, three), (5, one), (9, np.rot90(three)))]
    got = media.image_copies(spark.createDataFrame(rows, shape)).collect()
    # (5, one) is a copy of 1; the other row of 5 has corners of its own, which its turned copy meets.
    assert sorted((r.image_id, r.class_id) for r in got) == [(1, 1), (2, 2), (2, 2), (5, 1), (5, 5), (9, 5)]
    # Which of two contents an id's corners are from doesn't depend on the rows' order.
    rows = [(i, x.shape[1], x.shape[0], x.tobytes(), "s", 1, "b") for i, x in ((3, one), (3, two), (4, np.rot90(one)), (6, np.rot90(two)))]
    first, second = (sorted(tuple(r) for r in media.image_copies(spark.createDataFrame(r, shape)).collect()) for r in (rows, rows[::-1]))
    assert first == second and sum(r[1] == 3 for r in first) == 3
    assert media.image_copies(spark.createDataFrame([], shape)).count() == 0


def test_media_index_by_brute_force(spark):
    """Links of the index against all pairs, over images like the query's (whose corners look alike) and a crowd."""
    rng, rows, of = np.random.default_rng(3), [], {}
    for k in range(12):
        v = rng.normal(size=64)
        for j in range(30 if k == 0 else 4):
            rows.append((100 * k + j, (v + rng.normal(0, 0.1 * (j > 0), 64)).tolist()))
            of[100 * k + j] = 100 * k
    images = media.images_from_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    features = media.local_features(images).cache()
    ids = features.select("image_id")
    pairs = ids.select(F.col("image_id").alias("a")).crossJoin(ids.select(F.col("image_id").alias("b"))).where("a < b")
    want = {(r.a, r.b) for r in media.agreeing(features, pairs).collect()}
    got = {(r.a, r.b) for r in media.image_links(features).collect()}
    few = {p for p in want if p[0] >= 100}
    assert got <= want and len(few) >= 50 and len(got & few) >= 0.9 * len(few)
    # In the crowd copies meet pivots: it stays one class without all its pairs.
    classes = {r.node: r.component for r in components.connected_components(spark.createDataFrame(sorted(got), "a long, b long")).collect()}
    assert sum(classes.get(i, i) == of[i] for i in of) >= 0.9 * len(of) and all(of[a] == of[b] for a, b in got)
    # No corner is written more than once for each table and neighbour.
    n = features.selectExpr("sum(size(x))").first()[0]
    assert media._pair_keys(features, 0).count() <= media.TABLES * media.NEAREST * n


def test_media_index_on_disk(spark):
    """Votes of a pair aren't written again for each count, and images give the same keys together as alone."""
    rng = np.random.default_rng(4)
    images = media.images_from_embeddings(spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(3)], "vec_id long, embedding array<double>"))
    features = media.local_features(images).cache()
    links = media.agreeing(features, spark.createDataFrame([(0, 1)], "a long, b long"))
    assert "Expand" not in links._jdf.queryExecution().optimizedPlan().toString()
    together = {tuple(r) for r in media._pair_keys(features.coalesce(1), 0).collect()}
    alone = {tuple(r) for i in range(3) for r in media._pair_keys(features.where(F.col("image_id") == i), 0).collect()}
    assert together == alone and len({r[-1] for r in together}) > 300
    assert media.first_bits(100) < media.first_bits(50_000) <= media.first_bits(10**9)


def test_a_crowds_links_are_read_once(spark, monkeypatch):
    """All links of a crowd, turned round too, went into every round of the components: the square of its size."""
    rng = random.Random(6)
    crowd = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    chain = [(100 + i, 101 + i) for i in range(20)] + [(39, 500), (500, 501)]
    links = [(a, b) for a, b in crowd + chain]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    fewer = media.least_neighbours(df)
    nodes = {n for e in links for n in e}
    assert fewer.count() < 2 * len(nodes) < len(links) / 3
    plain, less = ({r.node: r.component for r in components.connected_components(x).collect()} for x in (df, fewer))
    assert plain == less and set(plain.values()) == {0, 100}
    v = np.random.default_rng(9).normal(size=64)
    rows = [(i, (v + np.random.default_rng(i).normal(0, 0.02 * (i > 0), 64)).tolist()) for i in range(12)]
    seen = []
    monkeypatch.setattr(media, "connected_components", lambda e: (seen.append(e.count()), components.connected_components(e))[1])
    got = media.image_copies(media.images_from_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert {r.class_id for r in got} == {0} and seen[0] <= 12 < sum(r.n_links for r in got) / 2
