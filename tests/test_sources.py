"""Archives, caches, tones, extractors, results documents and reports, on files and small tables."""

import io
import json
import math
import random
import struct
import tarfile
import wave
import zipfile
from hashlib import md5

import numpy as np
import pytest
from lumenclip.functions import audio
from lumenclip.operators import detect, evaluate, extract, training
from lumenclip.sources import archives, cache, datasets, readers, sinks
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan


@pytest.fixture(scope="module")
def packed(tmp_path_factory):
    """A folder with one set of files as they are, and the same in archives of three kinds."""
    root, rng = tmp_path_factory.mktemp("packed"), random.Random(1)
    (root / "plain").mkdir()
    (root / "archives").mkdir()
    files = {f"{i:04}.{rng.choice(['txt', 'md', 'wav'])}": bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for i in range(1000)}
    for n, content in files.items():
        (root / "plain" / n).write_bytes(content)
    with zipfile.ZipFile(root / "archives/a.zip", "w", zipfile.ZIP_DEFLATED) as z, tarfile.open(root / "archives/b.tar", "w") as t, tarfile.open(root / "archives/c.tar.gz", "w:gz") as g:
        z.mkdir("in")
        for n, content in files.items():
            z.writestr(f"in/{n}", content)
            for tar in (t, g):
                info = tarfile.TarInfo(f"in/{n}")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
    (root / "archives/readme.txt").write_text("not an archive")
    return root, files


def test_archives_equal_the_folder(spark, packed):
    root, files = packed
    got = archives.read_archive(spark, str(root / "archives"), 20_000).withColumn("part", F.spark_partition_id())
    by = got.groupBy(F.element_at(F.split("archive", "/"), -1).alias("archive")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.count_distinct("part").alias("tasks"))
    assert {r.archive: (r.n, r.size) for r in by.collect()} == dict.fromkeys(["a.zip", "b.tar", "c.tar.gz"], (1000, sum(map(len, files.values()))))
    tasks = {r.archive: r.tasks for r in by.collect()}
    assert tasks["a.zip"] > 5 and tasks["b.tar"] > 5 and tasks["c.tar.gz"] == 1
    plain = spark.read.format("binaryFile").load(str(root / "plain")).select(F.concat(F.lit("in/"), F.element_at(F.split("path", "/"), -1)).alias("name"), F.md5("content").alias("m"))
    for name in ("a.zip", "b.tar", "c.tar.gz"):
        one = archives.read_archive(spark, str(root / "archives" / name)).select("name", F.md5("content").alias("m"))
        assert one.exceptAll(plain).isEmpty() and plain.exceptAll(one).isEmpty()
    with pytest.raises(Exception, match="not an archive"):
        archives.read_archive(spark, str(root / "archives/readme.txt")).count()


def test_archive_members_are_pruned_in_the_plan(spark, packed):
    root, files = packed
    got = archives.read_archive(spark, str(root / "archives")).where("name LIKE '%.md' AND size > 100")
    want = sum(n.endswith(".md") and len(c) > 100 for n, c in files.items())
    assert got.count() == 3 * want
    reader = archives.ArchiveReader({"path": str(root / "archives"), "taskBytes": "20000"})
    kept = list(reader.pushFilters([archives.StringEndsWith(("name",), ".md"), GreaterThan(("size",), 100)]))
    assert [type(f) for f in kept] == [GreaterThan]
    members = [m for p in reader.partitions() if p.members for m in p.members]
    assert len(members) == 2 * sum(n.endswith(".md") for n in files)


def test_cache(spark, tmp_path):
    source, folder, built = str(tmp_path / "source"), str(tmp_path / "cache"), []
    spark.range(5).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source).selectExpr("id", "id * 2 AS twice")

    ask = lambda p: cache.read_through(spark, folder, p, [source], build)
    first, second = ask({"a": 1, "b": [2]}), ask({"b": [2], "a": 1})
    assert len(built) == 1 and first.count() == second.count() == 5
    assert "/cache/" in second._jdf.queryExecution().executedPlan().toString() and source not in second._jdf.queryExecution().executedPlan().toString()
    ask({"a": 2, "b": [2]})
    spark.range(3).write.mode("append").parquet(source)
    assert ask({"a": 1, "b": [2]}).count() == 8 and len(built) == 3

    def slow():
        """Another writer is done while this one builds."""
        cache.read_through(spark, folder, {"a": 9}, [source], build)
        return spark.range(1)

    assert cache.read_through(spark, folder, {"a": 9}, [source], slow).columns == ["id", "twice"]
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 4


@pytest.mark.parametrize("frequency,seconds", [(440, 0.01), (1150, 0.0), (200, 0.1234), (23_999.5, 0.002)])
def test_tones_equal_a_plain_writer(spark, frequency, seconds):
    samples = [int(32767 * 0.5 * math.sin(2 * math.pi * frequency * (i / 48000))) for i in range(int(48000 * seconds))]
    plain = io.BytesIO()
    with wave.open(plain, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(48000)
        w.writeframes(b"".join(struct.pack("<h", s) for s in samples))
    row = spark.createDataFrame([(float(frequency), seconds)], "f double, d double").select(audio.tone_samples(F.col("f"), F.col("d")).alias("s"))
    row = row.withColumn("w", audio.wav(F.col("s"))).withColumn("back", audio.wav_samples(F.col("w"))).first()
    assert row.s == row.back == samples and bytes(row.w) == plain.getvalue()


def test_extractors(spark):
    texts = [(1, "paragraph", "a1 b22, c333"), (2, "paragraph", "nothing"), (3, "paragraph", None), (4, "paragraph", ""), (5, "paragraph", "z9 z9")]
    clips = spark.createDataFrame(texts, "id long, media_type string, text string")
    numbers = extract.build("numbers", "pattern", {"pattern": r"(?P<letter>[a-z])(?P<digits>\d+)"})
    got = extract.extract(clips, numbers)
    assert got.columns == ["id", "n", "start", "match", "letter", "digits"]
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "a1", "a", "1"), (1, 1, 3, "b22", "b", "22"), (1, 2, 8, "c333", "c", "333"), (5, 0, 0, "z9", "z", "9"), (5, 1, 3, "z9", "z", "9")]
    windows = extract.extract(clips, extract.build("w", "window", '{"size": 2, "step": 1}'))
    assert windows.columns == ["id", "n", "first_word", "words"] and windows.where("id = 1").count() == 3
    with pytest.raises(ValueError, match="for clips of type"):
        extract.extract(clips.unionByName(clips.withColumn("media_type", F.lit("audio"))), numbers)
    for kind, config in (("pattern", {"pattern": "("}), ("pattern", {}), ("window", '{"size": 0}'), ("window", "no JSON"), ("smell", {})):
        with pytest.raises(ValueError):
            extract.build("x", kind, config)
    table = extract.registry(spark, [("n", "paragraph", "pattern", r'{"pattern": "[0-9]+"}'), ("bad", "paragraph", "pattern", "{"), ("other", "audio", "pattern", '{"pattern": "."}')])
    found = extract.auto_extract(clips, table)
    by = {(r.extractor, r.id): [json.loads(x)["match"] for x in r.extractions] for r in extract.grouped(found).collect()}
    assert by == {("n", 1): ["1", "22", "333"], ("n", 5): ["9", "9"]}
    assert [tuple(r) for r in extract.hit_totals(found).collect()] == [("n", 2, 5)]
    assert extract.auto_extract(clips, table.where("name = 'bad'")).count() == 0
    assert extract.auto_extract(clips.limit(0), table).count() == 0


def test_results_document(spark, tmp_path):
    rng = random.Random(2)
    names = ['plain', 'quo"te\\', "é 中", "none"]
    rows = [(d, 0.5, "vector", i, None if i % 4 else "m", f"f{i}.npy", "c", rng.random(), None, "n", p + 1) for d in names[:3] for p, i in enumerate(rng.sample(range(500), 90))]
    hits = spark.createDataFrame(rows, "detector string, threshold double, media_type string, id long, md5 string, filename string, category string, score double, origin string, origin_name string, pos long")
    detectors = spark.createDataFrame([(n, 0.5) for n in names], "name string, threshold double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.write_results_json(hits.repartition(7), detectors, "vector", str(tmp_path / "r"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "r").glob("part-*"))
    told = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 1 and (told["media_type"], told["detectors_run"]) == ("vector", 4)
    assert list(told["results"]) == sorted(names, key=str.encode)
    for d in names:
        own = [r for r in rows if r[0] == d]
        assert told["results"][d]["detector_name"] == d and told["results"][d]["total_hits"] == len(own)
        assert [(h["id"], h["md5"], h["score"], h["origin"]) for h in told["results"][d]["hits"]] == [(r[3], r[4], r[7], r[8]) for r in own]
    with pytest.raises(ValueError):
        sinks.write_results_json(hits, detectors, "vector", " ")
    nothing = sinks.result_lines(hits.limit(0), detectors.limit(0), "audio").orderBy("section").collect()
    assert json.loads("".join(r.line for r in nothing)) == {"media_type": "audio", "detectors_run": 0, "results": {}}


def test_evaluation_report(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", f"q{q}", i, rng.random(), q < 2 and rng.random() < 0.3) for d in range(2) for q in range(3) for i in range(40)]
    scored = spark.createDataFrame(rows, "dataset string, query string, id long, score double, relevant boolean")
    told = evaluate.evaluation_report(scored, (5, 50)).collect()
    assert len(told) == 6 + 2 + 1
    want = {}
    for d in ("d0", "d1"):
        for q in ("q0", "q1", "q2"):
            rel = [r[4] for r in sorted((r for r in rows if r[:2] == (d, q)), key=lambda r: -r[3])]
            hits = [sum(rel[: i + 1]) / (i + 1) for i, x in enumerate(rel) if x]
            want[d, q] = (np.mean(hits) if hits else 0.0, sum(rel), sum(rel[:5]) / 5, sum(rel[:5]) / sum(rel) if any(rel) else 0.0)
    for r in told:
        own = [v for k, v in want.items() if r.dataset in (None, k[0]) and r.query in (None, k[1])]
        assert (r.level, r.num_queries) == ({None: {None: "all"}}.get(r.dataset, {None: "dataset"}).get(r.query, "query"), len(own))
        assert (r.ap, r.num_relevant, r.precision_5, r.recall_5) == pytest.approx((np.mean([v[0] for v in own]), sum(v[1] for v in own), np.mean([v[2] for v in own]), np.mean([v[3] for v in own])))
    report = json.loads(evaluate.report_json(evaluate.evaluation_report(scored), "audio").where("dataset = 'd1'").first().report)
    assert report["dataset_id"] == "d1" and report["media_type"] == "audio" and [q["query"] for q in report["text_sort"]["per_query"]] == ["q0", "q1", "q2"]
    assert report["text_sort"]["mAP"] == pytest.approx(np.mean([want["d1", q][0] for q in ("q0", "q1", "q2")]), abs=1e-4)
    assert report["text_sort"]["per_query"][0]["precision_at_k"]["5"] == pytest.approx(want["d1", "q0"][2], abs=1e-4)


def test_folder_types(spark, tmp_path):
    for i, end in enumerate(["mkv", "avi", "MOV", "txt", "mp4"]):
        (tmp_path / f"{9 - i}.{end}").write_bytes(bytes(i + 1))
    got = readers.read_folder(spark, str(tmp_path), "video").orderBy("id").collect()
    assert [(r.id, r.filename, r.file_size) for r in got] == [(1, "5.mp4", 5), (2, "8.avi", 2), (3, "9.mkv", 1)]
    with pytest.raises(ValueError):
        readers.read_folder(spark, str(tmp_path), "smell")


def test_saved_data_sets(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "paragraph", "hällo", None, "x"), (3, "image", None, b"px", None), (4, "audio", None, None, "a.wav"), (5, "audio", None, None, "lost.wav"), (6, "paragraph", "", None, None)]
    spark.createDataFrame(rows, "id long, type string, text string, content binary, filename string").write.parquet(str(tmp_path / "s"))
    files = spark.createDataFrame([("a.wav", b"wave"), ("other", b"o")], "filename string, content binary")
    got = {r.id: r for r in datasets.read_saved(spark, str(tmp_path / "s"), files, "folder(/x)").collect()}
    assert sorted(got) == [2, 3, 4]
    assert (got[2].file_size, got[2].filename, got[2].category, got[2].origin, got[2].origin_name, got[2].duration, got[2].width) == (6, "x", "unknown", "folder(/x)", "x", 0.0, None)
    assert (got[3].filename, got[3].md5) == ("clip_3.image", md5(b"px").hexdigest()) and bytes(got[4].content) == b"wave"
    (tmp_path / "l.jsonl").write_text('{"id": 7, "text": "t", "category": "c", "embedding": [1, 2]}\n')
    one = datasets.read_saved(spark, str(tmp_path / "l.jsonl")).first()
    assert (one.id, one.type, one.category, one.origin, one.embedding) == (7, "audio", "c", None, [1.0, 2.0])


def test_sound_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filename,fold,target,category,esc10,more\n1-a.wav,1,0,dog,True,x\n2-b.wav,2,7,rain,False,y\n2-b.wav,3,7,rain,true,y\n")
    assert sorted(map(tuple, datasets.read_sound_metadata(spark, str(tmp_path / "m.csv")).collect())) == [("1-a.wav", "dog", True, 0, 1), ("2-b.wav", "rain", False, 7, 3)]
    (tmp_path / "n.csv").write_text("filename,fold\nx,1\n")
    with pytest.raises(ValueError, match="category"):
        datasets.read_sound_metadata(spark, str(tmp_path / "n.csv"))


def test_registries(spark, tmp_path):
    all_ = datasets.registries()
    assert all_["importer"].names() == ["archive", "feed", "folder", "saved"] and set(all_) == {"importer", "label importer", "detector importer", "exporter"}
    (tmp_path / "a.md").write_text("x")
    assert all_["importer"].run("folder", spark, path=str(tmp_path), media_type="paragraph").count() == 1
    for name, values in (("folder", {"path": " ", "media_type": "audio"}), ("folder", {"path": "/x"}), ("smell", {})):
        with pytest.raises(ValueError):
            all_["importer"].run(name, spark, **values)
    with pytest.raises(ValueError):
        all_["exporter"].add("csv", print)


def test_detector_of_a_label_file(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 16) + (0.3 if i % 2 else -0.3)).tolist() if i else None, "good" if i % 2 else "bad") for i in range(41)] + [(99, [0.0] * 16, "meh")]
    known = spark.createDataFrame(rows, "id long, embedding array<double>, label string")
    detector = training.trained_detector("ours", "vector", known)
    clips = known.where("embedding IS NOT NULL").withColumn("media_type", F.lit("vector"))
    said = {r.id for r in detect.hits(detect.detector_scores(clips, detector)).collect()}
    assert sum((i in said) == (i % 2 == 1) for i in range(1, 41)) > 32 and detector.first().threshold == round(detector.first().threshold, 4)
    with pytest.raises(ValueError):
        training.trained_detector("x", "vector", known.where("label = 'good'"))
