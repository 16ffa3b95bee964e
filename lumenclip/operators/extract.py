"""Extractors as vectorised table functions: each makes rows of its own schema from whole Arrow batches of clips.

An extractor has a name, a media type, a kind and a configuration.  The kind says what rows it gives and checks the
configuration; several extractors of one media type run side by side, and what can't be built is skipped, not fatal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extractor:
    """What a configuration has become: the columns of its rows (a schema), and the rows of one text."""

    name: str
    media_type: str
    columns: str
    rows: Callable[[str], Iterator[tuple]]


def _pattern(config: dict) -> tuple[str, Callable[[str], Iterator[tuple]]]:
    """Matches of a regular expression: n, start, match, and a column for each named group."""
    rule = re.compile(config["pattern"])
    groups = sorted(rule.groupindex, key=rule.groupindex.get)

    def rows(text: str) -> Iterator[tuple]:
        for n, m in enumerate(rule.finditer(text)):
            yield (n, m.start(), m[0], *(m[g] for g in groups))

    return ", ".join(["n long", "start long", "match string", *(f"`{g}` string" for g in groups)]), rows


def _window(config: dict) -> tuple[str, Callable[[str], Iterator[tuple]]]:
    """Windows of ``size`` words, every ``step`` words: n, first_word, words."""
    size, step = int(config["size"]), int(config.get("step", config["size"]))
    if size < 1 or step < 1:
        raise ValueError("a window needs a size and a step of one word or more")

    def rows(text: str) -> Iterator[tuple]:
        words = text.split()
        for n, a in enumerate(range(0, len(words), step)):
            yield n, a, " ".join(words[a : a + size])

    return "n long, first_word long, words string", rows


KINDS: dict[str, Callable[[dict], tuple[str, Callable[[str], Iterator[tuple]]]]] = {"pattern": _pattern, "window": _window}


def build(name: str, kind: str, config: str | dict, media_type: str = "paragraph") -> Extractor:
    """An extractor, or ValueError where the kind is unknown or the configuration isn't one."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of extractor: {kind}")
    try:
        return Extractor(name, media_type, *KINDS[kind](json.loads(config) if isinstance(config, str) else config))
    except (KeyError, TypeError, ValueError, re.error) as e:
        raise ValueError(f"not a configuration of {kind}: {config}") from e


def extract(clips: DataFrame, extractor: Extractor) -> DataFrame:
    """id and the extractor's columns, a row for each find; clips without one give none.

    ``clips`` have id, media_type, text; those of another media type are an error if there are any.
    """
    wrong = clips.where(~F.col("media_type").eqNullSafe(extractor.media_type))
    if not wrong.isEmpty():
        raise ValueError(f"{extractor.name} is for clips of type {extractor.media_type}")
    return _rows(clips, extractor)


def _rows(clips: DataFrame, extractor: Extractor) -> DataFrame:
    found, schema = extractor.rows, f"id long, {extractor.columns}"
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    types = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]

    @F.arrow_udtf(returnType=schema)
    class Rows:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out = [(i, *row) for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for row in found(text)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return Rows(clips.select("id", "text").asTable())


def registry(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """A table of extractors: name, media_type, kind, config."""
    return spark.createDataFrame(rows, "name string, media_type string, kind string, config string")


def auto_extract(clips: DataFrame, extractors: DataFrame) -> DataFrame:
    """extractor, id, n, extraction (a row's columns as JSON) of every extractor of the registry on the clips of its type.

    A configuration that can't be built is skipped.  A registry is what users have named, a row each.
    """
    runs = []
    for r in extractors.orderBy("name").toLocalIterator():
        try:
            e = build(r.name, r.kind, r.config, r.media_type)
        except ValueError:
            continue
        rows = _rows(clips.where(F.col("media_type") == e.media_type), e)
        runs.append(rows.select(F.lit(e.name).alias("extractor"), "id", "n", F.to_json(F.struct(*[c for c in rows.columns if c not in ("id", "n")]), {"ignoreNullFields": "false"}).alias("extraction")))
    if not runs:
        return clips.sparkSession.createDataFrame([], "extractor string, id long, n long, extraction string")
    return reduce(DataFrame.unionByName, runs)


def grouped(extractions: DataFrame) -> DataFrame:
    """extractor, id, extractions (a clip's finds in order): one row for each clip with a find."""
    by = extractions.groupBy("extractor", "id").agg(F.sort_array(F.collect_list(F.struct("n", "extraction"))).alias("e"))
    return by.select("extractor", "id", F.transform("e", lambda x: x["extraction"]).alias("extractions"))


def hit_totals(extractions: DataFrame) -> DataFrame:
    """extractor, total_clips_with_hits, total_extractions."""
    return extractions.groupBy("extractor").agg(F.count_distinct("id").alias("total_clips_with_hits"), F.count("*").alias("total_extractions"))
