"""Quality rules with host verdicts (6).

Each document is judged by four rules: short (under 50 words), repeats (over half of its words lie in repeated windows),
symbols (over a tenth as many as words) and lines (over three tenths of its lines repeat an earlier one).  The first two
are base rules.  Each host (the source column) is judged on each rule by its rate of failures, shrunk toward a beta
prior of that rule which is fitted to all hosts by moments.  A host fails a rule where its rate is with near certainty
(by ``sure`` of the posterior's deviations) over ``times`` the prior's mean and over ``least``; it is trusted on a rule
where its rate is with near certainty under the prior's mean.  A document isn't kept if it fails a base rule, if its host
fails any rule, or if it fails symbols or lines and its host isn't trusted on that rule: on a host that hardly ever
fails it, such a document is taken for an exception.  Hosts that differ by chance alone all shrink to the common rates:
none fails or is trusted.  Failures are summed before the shuffle, so a host with a third of all rows costs one row for
each task; verdicts are one row for each host and join back by whichever way suits their measured size.

Null and empty texts have no words and are short.  A very long text is worked on alone, whole.  A missing source is a
host of its own.  Repeated rows count as often as they occur; ties don't matter.  Other columns are not looked at,
whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import documents, materialize, words_of

COUNTS = "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BLANK = " \t\n\x0b\x0c\r"


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[edges])


def repeated_words(shingles: np.ndarray, k: int = 3) -> int:
    """Words in k-word windows that occur twice or more, each word once; ``shingles`` in word order."""
    n = len(shingles)
    if n < 2:
        return 0
    _, inverse, count = np.unique(shingles, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    again = count[inverse] > 1
    covered = np.zeros(n + k, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + k, -1)
    return int(np.count_nonzero(np.cumsum(covered)))


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(_BLANK)]


def duplicate_lines(text: str) -> int:
    lines = _lines(text)
    return len(lines) - len(set(lines))


def line_counts(text: str | None) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = _lines(text or "")
    return len(lines), len(lines) - len(set(lines))


def text_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            words, chars, symbols, lines, repeats = [], [], [], [], []
            for a, b, w in words_of(texts, lower=False):
                words.append(np.diff(w.first))
                chars.append(_sums(~w.sep & ((w.data & 0xC0) != 0x80), w.offsets))
                symbols.append(_sums(_SYMBOL[w.data], w.offsets))
                shingles, of = w.shingles(3)
                edges = np.searchsorted(of, np.arange(b - a + 1))
                repeats += [repeated_words(shingles[edges[i] : edges[i + 1]]) for i in range(b - a)]
            lines = [line_counts(t.as_py()) for t in texts]
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("host")), join(words), join(chars), join(symbols), pa.array([d for _, d in lines], pa.int64()), pa.array(repeats, pa.int64()), pa.array([n for n, _ in lines], pa.int64())],
                names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
            )

    return docs.select("doc_id", F.col(host).alias("host"), "text").mapInArrow(count, COUNTS)


#: Base rules first.  As SQL, which Spark and other engines read alike.
BASE_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words"}
RULES = BASE_RULES | {"symbols": "10 * n_symbols > n_words", "lines": "10 * n_dup_lines > 3 * n_lines"}


def base_failed():
    return F.expr(" OR ".join(f"({r})" for r in BASE_RULES.values()))


def host_verdicts(judged: DataFrame, times: float = 2.0, sure: float = 2.33, least: float = 0.2) -> DataFrame:
    """source, host_rows and for each rule r rate_r (shrunk), bad_r, trusted_r.  ``judged`` has source and fails_r.

    A prior's mean and strength come from the hosts' rates by moments; with no spread beyond chance the strength is
    at its largest, and all hosts shrink to the common rate.
    """
    hosts = judged.groupBy("source").agg(F.count("*").alias("host_rows"), *[F.count_if(f"fails_{r}").alias(f"n_{r}") for r in RULES])
    prior = hosts.agg(
        F.avg(1 / F.col("host_rows")).alias("per_row"),
        *[(F.sum(f"n_{r}") / F.sum("host_rows")).alias(f"mean_{r}") for r in RULES],
        *[F.coalesce(F.var_samp(F.col(f"n_{r}") / F.col("host_rows")), F.lit(0.0)).alias(f"spread_{r}") for r in RULES],
    )

    def strength(r: str):
        chance = F.col(f"mean_{r}") * (1 - F.col(f"mean_{r}"))
        beyond = F.greatest(F.col(f"spread_{r}") - chance * F.col("per_row"), chance / 10_001)
        return F.when(chance > 0, F.least(F.greatest(F.lit(1.0), chance / beyond - 1), F.lit(10_000.0))).otherwise(F.lit(1.0))

    prior = prior.select(*[c for r in RULES for c in (F.col(f"mean_{r}"), strength(r).alias(f"strength_{r}"))])
    # The prior is one row by construction (an ungrouped aggregate), so its broadcast has a proven size.
    shrunk = hosts.crossJoin(F.broadcast(prior))
    out = ["source", "host_rows"]
    for r in RULES:
        mean, weight, rows = F.col(f"mean_{r}"), F.col(f"strength_{r}"), F.col("host_rows")
        rate = (mean * weight + F.col(f"n_{r}")) / (weight + rows)
        away = sure * F.sqrt(rate * (1 - rate) / (weight + rows + 1))
        out += [rate.alias(f"rate_{r}"), (rate - away > F.greatest(times * mean, F.lit(least))).alias(f"bad_{r}"), (rate + away < mean).alias(f"trusted_{r}")]
    return shrunk.select(*out)


def quality_rules(docs: DataFrame, times: float = 2.0, sure: float = 2.33, least: float = 0.2, host: str = "source") -> DataFrame:
    """The documents' counts, base_failed, host_rows, each rule's rate_r of the host, host_failed (any rule), excused (a
    failure that counts for nothing as the host is trusted on its rule) and kept."""
    judged = text_counts(docs, host).withColumn("base_failed", base_failed()).withColumns({f"fails_{r}": F.expr(c) for r, c in RULES.items()})
    judged = materialize(judged)
    verdicts = host_verdicts(judged, times, sure, least).withColumnRenamed("source", "host")
    joined = judged.join(verdicts, judged["source"].eqNullSafe(verdicts["host"]), "left")
    any_of = lambda cs: F.expr(" OR ".join(f"({c})" for c in cs))
    softly = [r for r in RULES if r not in BASE_RULES]
    joined = joined.withColumns({
        "host_failed": any_of(f"bad_{r}" for r in RULES),
        "excused": any_of(f"fails_{r} AND trusted_{r}" for r in softly),
        "refused": any_of(f"fails_{r} AND NOT trusted_{r}" for r in softly),
    })
    kept = ~F.col("base_failed") & ~F.col("host_failed") & ~F.col("refused")
    counts = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "host_rows"]
    return joined.select(*counts, *[F.round(f"rate_{r}", 6).alias(f"rate_{r}") for r in RULES], "host_failed", "excused", kept.alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def _each(form: str, join: str = ", ", rules=RULES) -> str:
    """``form`` for each rule, $R and $C standing for its name and condition."""
    return join.join(form.replace("$R", r).replace("$C", RULES[r]) for r in rules)


_SOFT = [r for r in RULES if r not in BASE_RULES]
OP6_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(generate_series(1, len(ws) - 2)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
j AS (SELECT *, {_each("($C)", " OR ", BASE_RULES)} AS base_failed, {_each("($C) AS fails_$R")} FROM c),
h AS (SELECT source, count(*)::BIGINT AS host_rows, {_each("sum(fails_$R::INT)::BIGINT AS n_$R")} FROM j GROUP BY source),
p AS (SELECT avg(1 / host_rows) AS q, {_each("sum(n_$R) / sum(host_rows) AS m_$R, coalesce(var_samp(n_$R / host_rows), 0) AS s_$R")} FROM h),
k AS (SELECT {_each("m_$R, CASE WHEN m_$R * (1 - m_$R) > 0 THEN least(greatest(1.0::DOUBLE, m_$R * (1 - m_$R) / greatest(s_$R - m_$R * (1 - m_$R) * q, m_$R * (1 - m_$R) / 10001) - 1), 10000.0::DOUBLE) ELSE 1.0 END AS k_$R")} FROM p),
u AS (SELECT source, host_rows, {_each("m_$R, k_$R, (m_$R * k_$R + n_$R) / (k_$R + host_rows) AS rate_$R")} FROM h, k),
a AS (SELECT *, {_each("2.33 * sqrt(rate_$R * (1 - rate_$R) / (k_$R + host_rows + 1)) AS a_$R")} FROM u),
v AS (SELECT source, host_rows, {_each("rate_$R, rate_$R - a_$R > greatest(2 * m_$R, 0.2) AS bad_$R, rate_$R + a_$R < m_$R AS trusted_$R")} FROM a)
SELECT j.doc_id, j.source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, v.host_rows,
  {_each("round(rate_$R, 6) AS rate_$R")}, {_each("bad_$R", " OR ")} AS host_failed,
  {_each("(fails_$R AND trusted_$R)", " OR ", _SOFT)} AS excused,
  NOT base_failed AND NOT ({_each("bad_$R", " OR ")}) AND NOT ({_each("(fails_$R AND NOT trusted_$R)", " OR ", _SOFT)}) AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""
