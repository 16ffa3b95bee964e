"""Registered queries of the media engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.functions import audio, embedding, vectors
from lumenclip.functions.scratch import scratch_dir, written
from lumenclip.operators import detect, evaluate, extract, labels, ranking, steps, training, voting
from lumenclip.plans import model as m
from lumenclip.sources import cache, datasets, readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ------------------------------------------------------------------------------------------- shared parts of the SQL
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.q::DOUBLE[])"
_SIM = f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, label, {_COS} AS score FROM embeddings e, q)"
_EVAL = f"WITH f AS (SELECT label AS query, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label), s AS (SELECT query, vec_id AS id, {_COS.replace('q.q', 'f.q')} AS score, e.label = query AS relevant FROM embeddings e, f), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS pos FROM s)"
_NAME = "source || '_' || doc_id || '.txt'"
_TEXT = f"SELECT doc_id AS id, text, md5(text) AS md5, {_NAME} AS filename, lang AS category, source, 'folder|' || source || '|' || {_NAME} AS origin_key FROM documents"
_ENTRIES = f"""WITH c AS ({_TEXT}), e AS (
  SELECT id AS pos, CASE WHEN toxic = 1 AND id % 2 = 0 THEN 'meh' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label,
    CASE WHEN id % 4 = 1 THEN '' WHEN id % 4 = 3 THEN 'missing' || id ELSE md5 END AS md5, CASE WHEN id % 4 IN (1, 2) THEN origin_key END AS origin_key
  FROM labels JOIN c ON c.id = labels.doc_id),
m AS (SELECT pos, c.id, e.label FROM e JOIN c ON e.origin_key = c.origin_key UNION SELECT pos, c.id, e.label FROM e JOIN c ON e.md5 = c.md5 WHERE e.md5 <> '')"""
_LOG = """WITH v AS (SELECT event_id AS seq, user_id AS clip_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'good' WHEN event_type = 'error' THEN 'bad' END AS vote FROM events),
a AS (SELECT *, CASE WHEN vote = lag(vote) OVER (PARTITION BY clip_id ORDER BY seq) THEN 0 ELSE 1 END AS c FROM v WHERE vote IS NOT NULL),
b AS (SELECT *, sum(c) OVER (PARTITION BY clip_id ORDER BY seq) AS run FROM a),
log AS (SELECT seq, clip_id, vote, CASE WHEN row_number() OVER (PARTITION BY clip_id, run ORDER BY seq) % 2 = 1 THEN vote ELSE 'unlabel' END AS label FROM b)"""
_MLP = """WITH k AS (SELECT unnest([0, 7]) AS shift), w AS (SELECT CASE shift WHEN 0 THEN 'd1' ELSE 'd2' END AS name, CASE shift WHEN 0 THEN 0.51 ELSE 0.512 END AS threshold,
  list_transform(range(64), lambda i: list_transform(range(64), lambda j: (((i * 37 + (j + shift) * 17) % 101) - 50) / 500.0::DOUBLE)) AS w1,
  list_transform(range(64), lambda i: ((i * 13) % 11 - 5) / 50.0::DOUBLE) AS b1, list_transform(range(64), lambda i: ((i * 29) % 23 - 11) / 100.0::DOUBLE) AS w2 FROM k),
s AS (SELECT vec_id AS id, name, threshold, 1 / (1 + exp(-(list_dot_product(list_transform(range(1, 65), lambda i: greatest(list_dot_product(w1[i], embedding::DOUBLE[]) + b1[i], 0)), w2) + 0.05))) AS score FROM embeddings, w)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Words' buckets and signs, and the sums by text, as the hashing embedder has them.
_HASHED = r"""w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM texts),
c AS (SELECT id, ('0x' || md5(word)[1:12])::BIGINT AS code FROM w),
b AS (SELECT id, code % 256 AS bucket, sum(1 - 2 * ((code // 256) % 2))::BIGINT AS v FROM c GROUP BY ALL HAVING sum(1 - 2 * ((code // 256) % 2)) <> 0)"""


# ------------------------------------------------------------------------------------------------ ranking (Q1 - Q4)
@query(
    "q1_text_sort",
    f"""WITH texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1, arg_min(text, item_id) FROM benchmark), {_HASHED},
    n AS (SELECT id, sqrt(sum(v * v)::DOUBLE) AS n FROM b GROUP BY id),
    d AS (SELECT x.id, sum(x.v * y.v)::DOUBLE AS dot FROM b x JOIN b y ON x.bucket = y.bucket AND y.id = -1 GROUP BY x.id),
    s AS (SELECT doc_id AS id, round(coalesce(dot / (n.n * (SELECT n FROM n WHERE id = -1)), 0), 4) AS similarity FROM documents LEFT JOIN n ON n.id = doc_id LEFT JOIN d ON d.id = doc_id)
    SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS pos FROM s""",
)
def _(spark, d):
    asked = m.table(spark, d, "benchmark").agg(F.min_by("text", "item_id")).first()[0]
    return ranking.text_sort(m.text_clips(spark, d).select("id", "text"), asked)


@query(
    "vectors_x11_or_embedder",
    f"""WITH t AS ({_TEXT}), k AS (SELECT t.id, embedding FROM t JOIN embeddings ON vec_id = id AND id % 2 = 0), texts AS (SELECT id, text FROM t WHERE id NOT IN (SELECT id FROM k)), {_HASHED},
    n AS (SELECT id, sqrt(sum(v * v)::DOUBLE) AS n FROM b GROUP BY id), m AS (SELECT id, sum(v * (bucket + 1)) / any_value(n) AS s FROM b JOIN n USING (id) GROUP BY id)
    SELECT id, true AS precomputed, 64 AS width, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * i)), 3) AS checksum FROM k
    UNION ALL SELECT texts.id, false, 256, round(coalesce(s, 0), 3) FROM texts LEFT JOIN m USING (id)""",
)
def _(spark, d):
    clips = m.text_clips(spark, d)
    names = clips.where("id % 2 = 0").select("id", F.concat(F.lit("store/"), "filename").alias("name"))
    vectors = m.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id").join(names, "id").select("name", "embedding")
    both = embedding.with_vectors(clips.select("id", "filename", "text"), vectors)
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return both.select("id", "precomputed", F.size("embedding").alias("width"), F.round(weighted, 3).alias("checksum"))


@query("q2_example_sort", _SIM + " SELECT id, round(score, 4) AS similarity, row_number() OVER (ORDER BY round(score, 4) DESC, id) AS pos FROM s")
def _(spark, d):
    return ranking.sort_by_similarity(m.vec_clips(spark, d), m.query_vec(spark, d))


@query("q3_learned_sort")
def _(spark, d):
    return training.learned_sort(m.vec_clips(spark, d), m.vec_votes(spark, d))


@query("a2_mixture_threshold")
def _(spark, d):
    scored = ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d))
    return scored.agg(F.lit(training.mixture_threshold(scored)).alias("threshold"), F.count("*").alias("n"))


@query("q4_detector_hits", _MLP + " SELECT name, id, round(score, 4) AS score FROM s WHERE score >= threshold")
def _(spark, d):
    return detect.hits(detect.detector_scores(m.vec_clips(spark, d), detect.synthetic_detectors(spark)))


@query("a20_total_hits", _MLP + " SELECT name, count(*) AS total_hits FROM s WHERE score >= threshold GROUP BY name")
def _(spark, d):
    return QUERIES["q4_detector_hits"](spark, d).groupBy("name").agg(F.count("*").alias("total_hits"))


@query("q5_extract_numbers", r"SELECT doc_id AS id, 'number' AS label, i - 1 AS n, h[i] AS match FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS h FROM documents), unnest(generate_series(1, len(h))) AS t(i)")
def _(spark, d):
    return detect.extractions(m.text_clips(spark, d), "[0-9]+", "number")


@query(
    "x4_auto_extract",
    r"""WITH l AS (SELECT page_id AS id, i - 1 AS n, regexp_extract_all(html, 'href="(/[^"]*)"', 1)[i] AS target FROM pages, unnest(generate_series(1, len(regexp_extract_all(html, 'href="(/[^"]*)"')))) AS t(i)),
    w AS (SELECT page_id AS id, list_filter(regexp_split_to_array(url, '/'), lambda x: x <> '') AS w FROM pages)
    SELECT 'links' AS extractor, id, count(*) AS n_found, min(target) AS least, max(target) AS most FROM l GROUP BY id
    UNION ALL SELECT 'charset', page_id, 1, 'utf-8', 'utf-8' FROM pages WHERE html LIKE '%charset="utf-8"%'""",
)
def _(spark, d):
    """Two extractors on pages, one for another type, and two that can't be built."""
    clips = m.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("paragraph").alias("media_type"), F.col("html").alias("text"))
    rows = [("links", "paragraph", "pattern", '{"pattern": "href=\\"(?P<found>/[^\\"]*)\\""}'), ("charset", "paragraph", "pattern", '{"pattern": "charset=\\"(?P<found>utf-8)\\""}'), ("sounds", "audio", "pattern", '{"pattern": "x"}'), ("broken", "paragraph", "pattern", '{"pattern": "("}'), ("unknown", "paragraph", "smell", "{}")]
    found = extract.auto_extract(clips, extract.registry(spark, rows)).withColumn("found", F.get_json_object("extraction", "$.found"))
    return found.groupBy("extractor", "id").agg(F.count("*").alias("n_found"), F.min("found").alias("least"), F.max("found").alias("most"))


@query("w5_threshold_index", _SIM + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s) SELECT coalesce(min(pos - 1) FILTER (score < 0.1), count(*)) AS threshold_index, count(*) AS total FROM r")
def _(spark, d):
    return ranking.threshold_index(ranking.positions(ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d))), 0.1)


@query("w5_stripe_index", _SIM + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s) SELECT 'some' AS below, coalesce(min(pos - 1) FILTER (score < 0.1), 0) AS threshold_index, count(*) AS total FROM r UNION ALL SELECT 'none', coalesce(min(pos - 1) FILTER (score < -2), 0), count(*) FROM r")
def _(spark, d):
    ranked = ranking.positions(ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d)))
    return ranking.stripe_index(ranked, 0.1).select(F.lit("some").alias("below"), "*").unionByName(ranking.stripe_index(ranked, -2.0).select(F.lit("none").alias("below"), "*"))


@query(
    "w6_w7_next_clips",
    _SIM + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM s), t AS (SELECT coalesce(min(pos - 1) FILTER (score < 0.1), count(*)) AS i FROM r),
    u AS (SELECT r.*, i FROM r, t WHERE NOT ((label = 0 AND id % 2 = 0) OR (label <> 0 AND id % 5 = 0)))
    (SELECT 'top' AS mode, id FROM u ORDER BY pos LIMIT 1) UNION ALL (SELECT 'hard', id FROM u ORDER BY abs(pos - 1 - i), abs(score - 0.1), pos LIMIT 1)""",
)
def _(spark, d):
    return ranking.next_clips(ranking.positions(ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d))), m.vec_votes(spark, d), 0.1)


@query("w8_stripe", _SIM + ", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos, count(*) OVER () AS n FROM s) SELECT id, CASE label WHEN 0 THEN 'good' ELSE 'bad' END AS label, (pos - 1) / n AS rank FROM r WHERE (label = 0 AND id % 2 = 0) OR (label <> 0 AND id % 5 = 0)")
def _(spark, d):
    return ranking.stripe(ranking.positions(ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d))), m.vec_votes(spark, d))


# --------------------------------------------------------------------------------------------------- evaluation (Q8)
@query("a9_average_precision", _EVAL + ", h AS (SELECT query, pos, row_number() OVER (PARTITION BY query ORDER BY pos) AS hit FROM r WHERE relevant) SELECT query, round(sum(hit / pos) / count(*), 6) AS ap FROM h GROUP BY query")
def _(spark, d):
    return evaluate.average_precision(m.label_queries(spark, d)).select("query", F.round("ap", 6).alias("ap"))


@query("a10_precision_recall", _EVAL + ", n AS (SELECT query, count(*) FILTER (relevant) AS total FROM r GROUP BY query) SELECT r.query, k::INT AS k, round(count(*) FILTER (relevant AND pos <= k) / k, 6) AS precision, round(count(*) FILTER (relevant AND pos <= k) / any_value(total), 6) AS recall FROM r JOIN n ON r.query = n.query, (VALUES (5), (10), (20)) AS t(k) GROUP BY r.query, k")
def _(spark, d):
    return evaluate.precision_recall_at(m.label_queries(spark, d)).select("query", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("a12_mean_average_precision", _EVAL + ", h AS (SELECT query, pos, row_number() OVER (PARTITION BY query ORDER BY pos) AS hit FROM r WHERE relevant), a AS (SELECT query, sum(hit / pos) / count(*) AS ap FROM h GROUP BY query) SELECT round(coalesce(avg(ap), 0), 6) AS map FROM a")
def _(spark, d):
    return evaluate.average_precision(m.label_queries(spark, d)).agg(F.round(F.coalesce(F.avg("ap"), F.lit(0.0)), 6).alias("map"))


@query(
    "k8_evaluation_report",
    f"""WITH c AS (SELECT 'set' || (vec_id // 250) AS dataset, vec_id AS id, label, embedding FROM embeddings),
    f AS (SELECT dataset, label AS query, arg_min(embedding, id) AS q FROM c GROUP BY ALL),
    s AS (SELECT f.dataset, query, id, {_COS.replace('q.q', 'f.q').replace('e.embedding', 'c.embedding')} AS score, c.label = query AS relevant FROM c JOIN f USING (dataset)),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset, query ORDER BY score DESC, id) AS pos FROM s),
    h AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY dataset, query ORDER BY pos) AS hits FROM r),
    q AS (SELECT dataset, query, coalesce(avg(hits / pos) FILTER (relevant), 0) AS ap, count(*) FILTER (relevant) AS n, count(*) FILTER (relevant AND pos <= 5) AS h5, count(*) FILTER (relevant AND pos <= 10) AS h10, count(*) FILTER (relevant AND pos <= 20) AS h20 FROM h GROUP BY ALL)
    SELECT CASE WHEN grouping(dataset) = 1 THEN 'all' WHEN grouping(query) = 1 THEN 'dataset' ELSE 'query' END AS level, dataset, query, round(avg(ap), 6) AS ap, sum(n)::BIGINT AS num_relevant, count(*) AS num_queries,
      round(avg(h5 / 5), 6) AS precision_5, round(avg(h10 / 10), 6) AS precision_10, round(avg(h20 / 20), 6) AS precision_20, round(avg(h5 / n), 6) AS recall_5, round(avg(h10 / n), 6) AS recall_10, round(avg(h20 / n), 6) AS recall_20
    FROM q GROUP BY GROUPING SETS ((dataset, query), (dataset), ())""",
)
def _(spark, d):
    clips = _collections(spark, d).withColumn("label", F.expr("cast(substring(category, 5) AS int)"))
    vectors_of = clips.select("dataset", "id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    first = clips.groupBy("dataset", F.col("label").alias("query")).agg(F.min_by("embedding", "id").alias("q")).select("dataset", "query", vectors.doubles(F.col("q")).alias("q"))
    scored = vectors_of.join(first, "dataset").select("dataset", "query", "id", vectors.cosine(F.col("v"), F.col("q")).alias("score"), (F.col("label") == F.col("query")).alias("relevant"))
    told = evaluate.evaluation_report(scored)
    return told.select(*[F.round(c, 6).alias(c) if c.startswith(("ap", "precision", "recall")) else c for c in told.columns])


def _judged(spark, d):
    """Vectors of label 0 by the threshold 0.1 of similarity to vector 0."""
    scored = ranking.similarity(m.vec_clips(spark, d), m.query_vec(spark, d))
    return scored.join(m.vec_clips(spark, d).select("id", "label"), "id").select("id", F.round("score", 4).alias("score"), (F.col("score") >= 0.1).alias("predicted"), (F.col("label") == 0).alias("actual"))


_CONF = _SIM + ", c AS (SELECT count(*) FILTER (score >= 0.1 AND label = 0) AS tp, count(*) FILTER (score >= 0.1 AND label <> 0) AS fp, count(*) FILTER (score < 0.1 AND label = 0) AS fn, count(*) FILTER (score < 0.1 AND label <> 0) AS tn FROM s)"


@query("a11_confusion", _CONF + " SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(spark, d):
    c = evaluate.confusion(_judged(spark, d))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@query("a5_optimal_threshold", _SIM + ", b AS (SELECT round(score, 4) AS score, count(*) FILTER (label = 0) AS p, count(*) FILTER (label <> 0) AS n FROM s GROUP BY 1), w AS (SELECT score, round(sum(n) OVER o / sum(n) OVER () + 4 * (sum(p) OVER () - sum(p) OVER o) / sum(p) OVER (), 9) AS cost FROM b WINDOW o AS (ORDER BY score DESC)) SELECT score AS threshold, round(cost, 6) AS cost FROM w ORDER BY w.cost, score DESC LIMIT 1")
def _(spark, d):
    return evaluate.optimal_threshold(_judged(spark, d).select("score", F.col("actual").alias("positive")), 2).select("threshold", F.round("cost", 6).alias("cost"))


@query("a14_error_cost", _CONF + " SELECT round(fp / (fp + tn), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr, round(4 * fp / (fp + tn) + fn / (tp + fn), 6) AS cost FROM c")
def _(spark, d):
    return evaluate.error_cost(_judged(spark, d), [], -2)


@query("a13_voting_summary", "WITH r AS (SELECT user_id % 3 AS seed, 'events' AS dataset, event_type AS category, (event_id % 10)::INT AS t, value AS cost, value / 2 AS fpr, value / 4 AS fnr FROM events) SELECT dataset, category, t, round(avg(cost), 2) AS cost_mean, round(coalesce(stddev_samp(cost), 0), 2) AS cost_std, round(avg(fpr), 2) AS fpr_mean, round(coalesce(stddev_samp(fpr), 0), 2) AS fpr_std, round(avg(fnr), 2) AS fnr_mean, round(coalesce(stddev_samp(fnr), 0), 2) AS fnr_std FROM r GROUP BY dataset, category, t")
def _(spark, d):
    v = F.col("value")
    runs = m.table(spark, d, "events").select(F.lit("events").alias("dataset"), F.col("event_type").alias("category"), (F.col("event_id") % 10).cast("int").alias("t"), v.alias("cost"), (v / 2).alias("fpr"), (v / 4).alias("fnr"))
    s = evaluate.voting_summary(runs)
    return s.select("dataset", "category", "t", *[F.round(c, 2).alias(c) for c in s.columns[3:]])


def _collections(spark, d):
    """Data sets of 250 vectors each, together all of them."""
    return m.vec_clips(spark, d).select(F.concat(F.lit("set"), F.expr("id div 250")).alias("dataset"), "id", "category", "embedding")


_VOTES = """WITH c AS (SELECT 'set' || (vec_id // 250) AS dataset, vec_id AS id, 'cat_' || label AS category FROM embeddings),
w AS (SELECT DISTINCT c.dataset, category AS target, seed FROM c, (VALUES (1), (2)) AS s(seed)),
x AS (SELECT w.dataset, seed, target, id, category = target AS positive, ('0x' || md5(seed || ':' || target || ':' || id || ':part')[1:12])::BIGINT / 2.0::DOUBLE ** 48 < 0.5 AS test,
  ('0x' || md5(seed || ':' || target || ':' || id || ':order')[1:12])::BIGINT AS place FROM w JOIN c USING (dataset)),
v AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed, target ORDER BY place, id) AS n FROM x WHERE NOT test),
g AS (SELECT dataset, seed, target, n::INT AS t, sum(positive::INT) OVER (PARTITION BY dataset, seed, target ORDER BY n)::BIGINT AS num_good FROM v),
p AS (SELECT *, t - num_good AS num_bad FROM g WHERE num_good > 0 AND t > num_good)"""


@query("w11_voting_steps", _VOTES + " SELECT dataset, seed::INT AS seed, target, t, num_good, num_bad FROM p")
def _(spark, d):
    return voting.voting_steps(voting.dealt_votes(_collections(spark, d), [1, 2])[0])


@query("w10_simulated_voting")
def _(spark, d):
    return voting.simulate_voting(_collections(spark, d), [1])


# ------------------------------------------------------------------------------------------------ label algebra (Q6)
@query("j2_resolved_labels", _ENTRIES + " SELECT pos, id FROM m")
def _(spark, d):
    return labels.resolve(m.label_entries(spark, d), m.text_clips(spark, d))


@query("j3_missing_entries", _ENTRIES + " SELECT pos FROM e WHERE label IN ('good', 'bad') AND pos NOT IN (SELECT pos FROM m)")
def _(spark, d):
    return labels.missing(m.label_entries(spark, d), m.text_clips(spark, d)).select("pos")


@query("j4_applied_labels", _ENTRIES + ", n AS (SELECT id, arg_max(label, pos) AS label FROM m WHERE label <> 'meh' GROUP BY id) SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label FROM labels WHERE doc_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, label FROM n")
def _(spark, d):
    return labels.apply_labels(m.label_entries(spark, d), m.text_clips(spark, d), m.votes(spark, d))


@query("j4_import_counts", _ENTRIES + " SELECT count(*) FILTER (label <> 'meh' AND pos IN (SELECT pos FROM m)) AS applied, count(*) FILTER (label = 'meh') AS skipped, count(*) FILTER (label <> 'meh' AND pos NOT IN (SELECT pos FROM m)) AS missing FROM e")
def _(spark, d):
    return labels.import_counts(m.label_entries(spark, d), m.text_clips(spark, d))


@query("j6_labelset", f"WITH c AS ({_TEXT}) SELECT c.id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label, md5, filename, category FROM c JOIN labels ON c.id = doc_id")
def _(spark, d):
    return labels.labelset(m.votes(spark, d), m.text_clips(spark, d))


@query("j11_unlabelled", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return m.text_clips(spark, d).select("id").join(m.votes(spark, d), "id", "left_anti")


@query("a23_entries_by_origin", f"WITH c AS ({_TEXT}) SELECT source, count(*) AS n_entries, count(DISTINCT md5) AS n_hashes, min(filename) AS first_name FROM c GROUP BY source")
def _(spark, d):
    return m.text_clips(spark, d).groupBy("source").agg(F.count("*").alias("n_entries"), F.count_distinct("md5").alias("n_hashes"), F.min("filename").alias("first_name"))


@query("a24_duplicate_groups", "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def _(spark, d):
    return m.text_clips(spark, d).groupBy("md5").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


# ------------------------------------------------------------------------------------------------ vote log (Q6, Q7)
@query("w1_toggled_votes", _LOG + " SELECT seq, clip_id, label FROM log")
def _(spark, d):
    return labels.toggled(m.vote_events(spark, d)).select("seq", "clip_id", "label")


@query("w2_running_sets", _LOG + ", x AS (SELECT seq, label, coalesce(lag(label) OVER (PARTITION BY clip_id ORDER BY seq), 'unlabel') AS b FROM log) SELECT seq, sum((label = 'good')::INT - (b = 'good')::INT) OVER (ORDER BY seq)::BIGINT AS num_good, sum((label = 'bad')::INT - (b = 'bad')::INT) OVER (ORDER BY seq)::BIGINT AS num_bad FROM x")
def _(spark, d):
    return labels.running_sets(labels.toggled(m.vote_events(spark, d)))


@query("w4_labels_as_of", _LOG + " SELECT clip_id, arg_max(label, seq) AS label FROM log WHERE seq <= 5000 GROUP BY clip_id HAVING arg_max(label, seq) <> 'unlabel'")
def _(spark, d):
    return labels.label_state(labels.toggled(m.vote_events(spark, d)), 5000)


@query("a17_labeling_status", "WITH t AS (SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels), s AS (SELECT l_linenumber AS step, round(avg(l_discount), 6) AS e FROM lineitem GROUP BY 1), f AS (SELECT count(*) AS n, regr_slope(e, step) AS k, avg(e) AS a FROM s) SELECT good, bad, CASE WHEN good + bad < 20 OR good < 5 OR bad < 5 THEN 'red' WHEN n < 3 THEN 'yellow' WHEN k / a < -0.015 THEN 'yellow' ELSE 'green' END AS status, round(k, 4) AS slope FROM t, f")
def _(spark, d):
    counts = m.votes(spark, d).agg(F.count_if(F.col("label") == "good").alias("good"), F.count_if(F.col("label") == "bad").alias("bad"))
    steps = m.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.round(F.avg("l_discount"), 6).alias("error_cost"))
    return evaluate.labeling_status(counts, steps)


@query("j10_prediction_flips", "WITH p AS (SELECT l_orderkey AS id, l_linenumber AS step, max(l_quantity) > 25 AS p FROM lineitem GROUP BY ALL), s AS (SELECT DISTINCT step FROM p) SELECT a.step, count(*) FILTER (b.p IS NOT NULL AND a.p <> b.p) AS flips, count(b.p) AS common FROM p a LEFT JOIN p b ON a.id = b.id AND b.step = (SELECT max(step) FROM s WHERE s.step < a.step) GROUP BY a.step")
def _(spark, d):
    p = m.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("step")).agg((F.max("l_quantity") > 25).alias("predicted"))
    return evaluate.prediction_flips(p)


# ------------------------------------------------------------------------------------------------ sources, ETL (Q9)
@query("p1_list_clips", f"SELECT doc_id AS id, 'paragraph' AS type, 0.0::DOUBLE AS duration, strlen(text) AS file_size, md5(text) AS md5, {_NAME} AS filename, lang AS category FROM documents")
def _(spark, d):
    return m.text_clips(spark, d).select("id", F.lit("paragraph").alias("type"), F.lit(0.0).alias("duration"), F.octet_length("text").cast("long").alias("file_size"), "md5", "filename", "category")


@query("s2_text_stats", r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''))::INT AS word_count, length(text)::INT AS character_count FROM documents")
def _(spark, d):
    return m.text_clips(spark, d).select("id", vectors.word_count(F.col("text")).alias("word_count"), F.length("text").alias("character_count"))


@query("p4_mime_types", f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'image/png' END AS mime FROM documents")
def _(spark, d):
    name = F.when(F.col("id") % 2 == 0, F.col("filename")).otherwise(F.regexp_replace("filename", r"\.txt$", ".PNG"))
    return m.text_clips(spark, d).select("id", vectors.mime_type(name).alias("mime"))


@query(
    "p4_media_mime",
    """WITH c AS (SELECT doc_id AS id, ['image', 'video', 'audio', 'paragraph'][doc_id % 4 + 1] AS media_type, ['.png', '.BMP', '.mov', '.avi', '.mkv', '.webm', '.m4a', '.gif', '', '.md', '.xyz'][doc_id % 11 + 1] AS e FROM documents)
    SELECT id, CASE media_type WHEN 'image' THEN CASE e WHEN '.png' THEN 'image/png' WHEN '.BMP' THEN 'image/bmp' WHEN '.gif' THEN 'image/gif' ELSE 'image/jpeg' END
      WHEN 'video' THEN CASE e WHEN '.mov' THEN 'video/quicktime' WHEN '.avi' THEN 'video/x-msvideo' WHEN '.webm' THEN 'video/webm' ELSE 'video/mp4' END
      WHEN 'audio' THEN CASE e WHEN '.m4a' THEN 'audio/mp4' ELSE 'audio/wav' END ELSE CASE e WHEN '.md' THEN 'text/markdown' ELSE 'text/plain' END END AS mime FROM c""",
)
def _(spark, d):
    of = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % n + 1).cast("int"))
    kind, end = of(["image", "video", "audio", "paragraph"], 4), of([".png", ".BMP", ".mov", ".avi", ".mkv", ".webm", ".m4a", ".gif", "", ".md", ".xyz"], 11)
    return m.text_clips(spark, d).select("id", vectors.mime_type(F.concat(F.lit("file"), end), kind).alias("mime"))


@query("p13_demo_sizes", "SELECT lang AS name, count(DISTINCT source) * CASE lang WHEN 'en' THEN 80 WHEN 'fr' THEN 100 WHEN 'de' THEN 10 ELSE 50 END AS num_files FROM documents GROUP BY lang")
def _(spark, d):
    by = m.table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count_distinct("source").alias("n"))
    kind = F.when(F.col("name").isin("en", "fr"), "image").when(F.col("name") == "de", "video").otherwise("paragraph")
    return by.select("name", datasets.demo_size(kind, F.when(F.col("name") == "en", "caltech101"), F.col("n")).alias("num_files"))


@query("s14_newsgroups", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'sci.space' WHEN n_nationkey % 3 = 1 THEN 'rec.autos' ELSE n_name END AS newsgroup, CASE WHEN n_nationkey % 3 = 0 THEN 'science' WHEN n_nationkey % 3 = 1 THEN 'cars' ELSE n_name END AS category FROM nation")
def _(spark, d):
    given = F.when(F.col("n_nationkey") % 3 == 0, "science").when(F.col("n_nationkey") % 3 == 1, "rec.autos").otherwise(F.col("n_name"))
    return m.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), datasets.newsgroup(given).alias("newsgroup")).withColumn("category", datasets.newsgroup_alias(F.col("newsgroup")))


@query(
    "s2_normalised",
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'paragraph' ELSE 'audio' END AS type, 0.0::DOUBLE AS duration, CASE WHEN id % 5 = 0 THEN 7 ELSE strlen(text) END AS file_size, md5,
      CASE WHEN id % 3 = 0 THEN 'clip_' || id || CASE WHEN id % 2 = 0 THEN '.paragraph' ELSE '.audio' END ELSE filename END AS filename, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE category END AS category, 'saved' AS origin
    FROM ({_TEXT}) WHERE (id % 2 = 0 OR id % 3 <> 0) AND text <> ''""",
)
def _(spark, d):
    """Texts of even ids are in the table, those of odd ids in files of their names; every third row has lost its name."""
    clips = m.text_clips(spark, d)
    only = lambda c, when: F.when(when, F.col(c)).alias(c)
    saved = clips.select("id", F.when(F.col("id") % 2 == 0, "paragraph").alias("type"), only("text", F.col("id") % 2 == 0), only("filename", F.col("id") % 3 != 0), only("category", F.col("id") % 4 != 0), F.when(F.col("id") % 5 == 0, 7).alias("file_size"), F.lit("stale").alias("md5"))
    files = clips.where("id % 2 = 1").select("filename", F.encode("text", "UTF-8").alias("content"))
    return datasets.normalised(saved, files, "saved").select("id", "type", "duration", "file_size", "md5", "filename", "category", "origin")


@query(
    "s22_label_file",
    """WITH e AS (SELECT doc_id AS pos, CASE WHEN toxic = 1 THEN 'meh' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN doc_id % 7 = 0 THEN 'png' WHEN doc_id % 11 = 0 THEN 'xyz' ELSE 'wav' END AS e, doc_id % 5 <> 0 AS here FROM labels),
    u AS (SELECT *, CASE e WHEN 'png' THEN 'image' ELSE 'audio' END AS t FROM e WHERE label <> 'meh' AND e <> 'xyz' AND here), f AS (SELECT arg_min(t, pos) AS first FROM u), k AS (SELECT * FROM u, f WHERE t = first)
    SELECT any_value(t) AS media_type, count(*) AS loaded, (SELECT count(*) FROM e) - count(*) AS skipped, count(*) FILTER (label = 'good') AS num_good, count(*) FILTER (label = 'bad') AS num_bad FROM k""",
)
def _(spark, d):
    i = F.col("doc_id")
    label = F.when(F.col("toxic") == 1, "meh").when(F.col("quality") == 1, "good").otherwise("bad")
    name = F.concat(i, F.lit("."), F.when(i % 7 == 0, "PNG").when(i % 11 == 0, "xyz").otherwise("wav"))
    e = m.table(spark, d, "labels").select(i.alias("pos"), label.alias("label"), F.when(i % 2 == 0, name).otherwise("").alias("path"), F.when(i % 2 == 1, name).alias("file"), F.lit("never").alias("filename"))
    files = m.table(spark, d, "labels").where("doc_id % 5 <> 0").select(name.alias("place"))
    return readers.label_file_counts(e, files)


@query("p14_origin_display", "SELECT doc_id AS id, 'folder(' || source || ')' AS origin FROM documents")
def _(spark, d):
    params = F.array(F.struct(F.lit("path").alias("k"), F.col("source").alias("v")))
    return m.text_clips(spark, d).select("id", vectors.origin_display(F.lit("folder"), params).alias("origin"))


@query("p10_inclusion", "SELECT event_id, trunc(greatest(-10, least(10, value)))::INT AS inclusion FROM events")
def _(spark, d):
    return m.table(spark, d, "events").select("event_id", F.greatest(F.lit(-10), F.least(F.lit(10), F.col("value"))).cast("int").alias("inclusion"))


@query("s6a_first_per_category", f"SELECT id, category, filename FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY filename) AS n FROM ({_TEXT})) WHERE n <= 50")
def _(spark, d):
    return readers.first_per_category(m.text_clips(spark, d), 50).select("id", "category", "filename")


@query("s6b_truncated_texts", r"SELECT doc_id AS id, md5(regexp_replace(substr(text, 1, 1000), '^\s+|\s+$', '', 'g')) AS md5 FROM documents WHERE regexp_replace(substr(text, 1, 1000), '^\s+|\s+$', '', 'g') <> ''")
def _(spark, d):
    return readers.truncated(m.text_clips(spark, d).select("id", "text")).select("id", F.md5("text").alias("md5"))


@query("s6_cached_dataset", f"SELECT id, category, filename FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY filename) AS n FROM ({_TEXT})) WHERE n <= 20")
def _(spark, d):
    """The first twenty of each category, built once for a state of the table."""
    build = lambda: readers.first_per_category(m.text_clips(spark, d), 20).select("id", "category", "filename")
    return cache.read_through(spark, f"{scratch_dir(spark)}/cache", {"dataset": "texts", "per_category": 20}, [f"{d}/documents.parquet"], build)


@query(
    "s19_tones",
    """WITH t AS (SELECT n_nationkey AS id, 200 + 50 * n_nationkey AS frequency, 0.02 * (1 + n_regionkey) AS duration FROM nation),
    s AS (SELECT id, unnest(list_transform(range(floor(duration * 48000)::BIGINT), lambda i: trunc(32767 * 0.5::DOUBLE * sin(2 * pi() * frequency * (i / 48000)))::BIGINT)) AS s FROM t)
    SELECT id, count(*) AS n_samples, sum(s)::BIGINT AS total, sum(s * s)::BIGINT AS square, max(s)::BIGINT AS most, 44 + 2 * count(*) AS n_bytes FROM s GROUP BY id""",
)
def _(spark, d):
    """Tones of the nations' numbers, written as WAV files and read back."""
    t = m.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (200 + 50 * F.col("n_nationkey")).alias("frequency"), (F.lit(0.02) * (1 + F.col("n_regionkey"))).alias("duration"))
    files = t.select("id", audio.wav(audio.tone_samples(F.col("frequency"), F.col("duration"))).alias("content"))
    s = files.select("id", F.octet_length("content").cast("long").alias("n_bytes"), F.explode(audio.wav_samples(F.col("content")).cast("array<bigint>")).alias("s"))
    return s.groupBy("id", "n_bytes").agg(F.count("*").alias("n_samples"), F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("square"), F.max("s").alias("most")).select("id", "n_samples", "total", "square", "most", "n_bytes")


@query("s21_split", f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || category || ':' || id), id) AS r FROM ({_TEXT})) SELECT id, category, CASE WHEN r <= CASE WHEN n >= 2 THEN greatest(least(round_even(n * 0.3::DOUBLE, 0)::BIGINT, n - 1), 1) ELSE round_even(n * 0.3::DOUBLE, 0)::BIGINT END THEN 'test' ELSE 'train' END AS part FROM c")
def _(spark, d):
    return readers.split(m.text_clips(spark, d), 0.3, 42).select("id", "category", "part")


@query("j12_cherry_picked", f"WITH c AS ({_TEXT}), w AS (SELECT * FROM c WHERE category = 'en' AND (filename LIKE '%7.txt' OR md5 IN (SELECT md5 FROM c WHERE source = 'src3'))) SELECT id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY id) AS new_id FROM w")
def _(spark, d):
    clips = m.text_clips(spark, d)
    source = clips.where("category = 'en'")
    return labels.cherry_pick(source.select("id", "filename", "md5"), source.where("filename LIKE '%7.txt'").select("filename"), clips.where("source = 'src3'").select("md5"), clips).select("id", "new_id")


# --------------------------------------------------------------------------------- results, lookups, registries, steps
_HITS = f"{_MLP}, g AS (SELECT s.name AS detector, threshold, id, round(score, 4) AS score FROM s WHERE score >= threshold), r AS (SELECT g.*, 'vector' AS media_type, md5('v' || id) AS md5, 'v' || id || '.npy' AS filename, 'cat_' || label AS category, CASE WHEN id % 3 = 0 THEN NULL ELSE 'folder(' || label || ')' END AS origin, CASE WHEN id % 3 = 0 THEN '' ELSE 'v' || id END AS origin_name, row_number() OVER (PARTITION BY detector ORDER BY g.score DESC, id) AS pos FROM g JOIN embeddings ON vec_id = id)"


def _with_origin(spark, d):
    some = F.col("id") % 3 != 0
    name = F.concat(F.lit("v"), F.col("id"))
    return m.vec_clips(spark, d).select("id", "media_type", F.md5(name).alias("md5"), F.concat(name, F.lit(".npy")).alias("filename"), "category", F.when(some, F.concat(F.lit("folder("), F.col("label"), F.lit(")"))).alias("origin"), F.when(some, name).otherwise("").alias("origin_name"))


def _result_rows(spark, d):
    return detect.result_rows(detect.detector_scores(m.vec_clips(spark, d), detect.synthetic_detectors(spark)), _with_origin(spark, d))


@query("k3_result_rows", _HITS + " SELECT detector, threshold::DOUBLE AS threshold, media_type, id, md5, filename, category, score, origin, origin_name, pos FROM r")
def _(spark, d):
    return _result_rows(spark, d)


@query(
    "k2_result_lines",
    _HITS + """, d AS (SELECT name AS detector, threshold, (SELECT count(*) FROM r WHERE r.detector = w.name) AS total FROM w UNION ALL SELECT 'd3', 2.0, 0),
    j AS (SELECT r.*, total FROM r JOIN d USING (detector))
    SELECT 0 AS section, '' AS detector, 0::BIGINT AS pos, '{"media_type":"vector","detectors_run":' || count(*) || ',"results":{' AS line FROM d
    UNION ALL SELECT 1, detector, 0, '"' || detector || '":{"detector_name":"' || detector || '","threshold":' || threshold::DOUBLE || ',"total_hits":' || total || ',"hits":[' FROM d
    UNION ALL SELECT 1, detector, pos, to_json({'id': id, 'md5': md5, 'filename': filename, 'category': category, 'score': score::DOUBLE, 'origin': origin, 'origin_name': origin_name})::VARCHAR || CASE WHEN pos < total THEN ',' ELSE '' END FROM j
    UNION ALL SELECT 1, detector, total + 1, ']}' || CASE WHEN detector < 'd3' THEN ',' ELSE '' END FROM d
    UNION ALL SELECT 2, '', 0, '}}'""",
)
def _(spark, d):
    """A third detector finds nothing."""
    names = detect.synthetic_detectors(spark).select("name", "threshold")
    return sinks.result_lines(_result_rows(spark, d), names.unionByName(spark.createDataFrame([("d3", 2.0)], "name string, threshold double")), "vector")


@query("j7_labelset_from_results", _HITS + " SELECT detector, id, 'good' AS label, md5, coalesce(origin, 'clip(' || id || ')') AS origin, CASE WHEN origin IS NULL THEN 'c' || id ELSE origin_name END AS origin_name, filename, category FROM r")
def _(spark, d):
    clips = _with_origin(spark, d).withColumns({"origin": F.concat(F.lit("clip("), F.col("id"), F.lit(")")), "origin_name": F.concat(F.lit("c"), F.col("id"))})
    return labels.labelset_from_results(_result_rows(spark, d), clips)


@query("j13_test_scores", _SIM + ", t AS (SELECT doc_id AS id FROM labels) SELECT t.id, coalesce(round(score, 4), 0.0) AS score FROM t LEFT JOIN s ON t.id = s.id AND s.id % 2 = 0")
def _(spark, d):
    scored = ranking.similarity(m.vec_clips(spark, d).where("id % 2 = 0"), m.query_vec(spark, d)).select("id", F.round("score", 4).alias("score"))
    return evaluate.with_default_score(m.votes(spark, d), scored)


@query("j14_sorted_with_metadata", _SIM + f", c AS ({_TEXT}), r AS (SELECT id, row_number() OVER (ORDER BY round(score, 4) DESC, id) AS pos FROM s) SELECT pos, id, filename, category FROM r JOIN c USING (id)")
def _(spark, d):
    order = ranking.sort_by_similarity(m.vec_clips(spark, d), m.query_vec(spark, d)).select("id", "pos")
    return order.join(m.text_clips(spark, d).select("id", "filename", "category"), "id").select("pos", "id", "filename", "category")


@query("p2_light_hits", _HITS + " SELECT detector, id, filename, score FROM r")
def _(spark, d):
    return _result_rows(spark, d).select("detector", "id", "filename", "score")


@query("p3_clip_by_id", f"SELECT id, filename, category, md5 FROM ({_TEXT}) WHERE id = 7")
def _(spark, d):
    return m.text_clips(spark, d).where("id = 7").select("id", "filename", "category", "md5")


@query("p11_volume", "SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value::DOUBLE / 100)) AS volume FROM events")
def _(spark, d):
    return m.table(spark, d, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value").cast("double") / 100)).alias("volume"))


@query("p12_dataset_status", "SELECT count(*) > 0 AS loaded, count(*) AS num_clips, (SELECT count(*) > 0 FROM labels) AS has_votes, 'paragraph' AS media_type FROM documents")
def _(spark, d):
    votes = m.votes(spark, d).agg((F.count("*") > 0).alias("has_votes"))
    status = m.text_clips(spark, d).agg((F.count("*") > 0).alias("loaded"), F.count("*").alias("num_clips"))
    return status.crossJoin(F.broadcast(votes)).select("loaded", "num_clips", "has_votes", F.lit("paragraph").alias("media_type"))


@query("a21_categories", f"SELECT DISTINCT category FROM ({_TEXT})")
def _(spark, d):
    return m.text_clips(spark, d).select("category").distinct()


@query("a23_entries_of_origin", f"SELECT origin_key, filename, md5, count(*) AS n FROM ({_TEXT}) WHERE origin_key IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return m.text_clips(spark, d).where("origin_key IS NOT NULL").groupBy("origin_key", "filename", "md5").agg(F.count("*").alias("n"))


@query("a24_duplicate_ids", f"SELECT md5, id FROM (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM ({_TEXT})) WHERE n > 1")
def _(spark, d):
    clips = m.text_clips(spark, d).select("md5", "id")
    return clips.join(clips.groupBy("md5").agg(F.count("*").alias("n")).where("n > 1").select("md5"), "md5")


@query("t8_votes_by_id", "SELECT id, label, row_number() OVER (ORDER BY id) AS pos FROM (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label FROM labels)")
def _(spark, d):
    v = m.votes(spark, d).withColumn("score", -F.col("id"))
    return ranking.positions(v).select("id", "label", "pos")


@query("u5_registry", "SELECT p_brand AS name, max(p_size) AS size FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 45) GROUP BY 1 UNION ALL SELECT p_brand, -max(p_size) FROM part WHERE p_size > 45 GROUP BY 1")
def _(spark, d):
    brand = m.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("size"))
    return labels.upserted(brand.groupBy("name").agg(F.max("size").alias("size")), brand.where("size > 45").groupBy("name").agg((-F.max("size")).alias("size")))


_BRANDS = "WITH b AS (SELECT p_brand AS name, max(p_size) AS size FROM part GROUP BY 1)"


def _brands(spark, d):
    return m.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.max("p_size").alias("size"))


@query("u5_removed", _BRANDS + " SELECT * FROM b WHERE name NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def _(spark, d):
    return labels.removed(_brands(spark, d), m.table(spark, d, "part").where("p_size = 50").select(F.col("p_brand").alias("name")))


@query("u5_renamed", _BRANDS + ", f AS (SELECT min(name) AS f, max(name) AS l FROM b) SELECT 'done' AS step, CASE WHEN name = f THEN 'new' ELSE name END AS name, size FROM b, f UNION ALL SELECT 'taken', name, size FROM b UNION ALL SELECT 'missing', name, size FROM b")
def _(spark, d):
    """A rename, one to a name that is taken, and one of a name that isn't there: the last two change nothing."""
    b = _brands(spark, d)
    first, last = b.agg(F.min("name"), F.max("name")).first()
    runs = {"done": (first, "new"), "taken": (first, last), "missing": ("absent", "new")}
    return reduce(DataFrame.unionByName, [labels.renamed(b, *names).select(F.lit(step).alias("step"), "name", "size") for step, names in runs.items()])


@query("a23_entry_lists", f"SELECT source AS origin_key, row_number() OVER (PARTITION BY source ORDER BY id) AS pos, id, md5, filename, count(*) OVER (PARTITION BY source) AS n_entries, n_hashes FROM ({_TEXT}) JOIN (SELECT source, count(DISTINCT md5) AS n_hashes FROM ({_TEXT}) GROUP BY source) USING (source) WHERE source <> 'src1'")
def _(spark, d):
    """Entries of one source have lost their origin."""
    e = m.text_clips(spark, d).select("id", "md5", "filename", F.when(F.col("source") != "src1", F.col("source")).alias("origin_key"))
    return labels.entries_by_origin(e).select("origin_key", "pos", "id", "md5", "filename", "n_entries", "n_hashes")


@query("u6_concatenated", f"WITH c AS (SELECT id, filename FROM ({_TEXT})), x AS (SELECT * FROM c WHERE id % 2 = 0), y AS (SELECT * FROM c WHERE id % 2 = 1) SELECT * FROM x UNION ALL SELECT id - (SELECT min(id) FROM y) + (SELECT max(id) FROM x) + 1, filename FROM y")
def _(spark, d):
    clips = m.text_clips(spark, d).select("id", "filename")
    return labels.concatenated(clips.where("id % 2 = 0"), clips.where("id % 2 = 1"))


@query("w9_vote_sequence", f"SELECT row_number() OVER (ORDER BY md5('3:en:' || id), id) AS t, id, CASE category WHEN 'en' THEN 'good' ELSE 'bad' END AS label FROM ({_TEXT})")
def _(spark, d):
    return labels.vote_sequence(m.text_clips(spark, d), "en", 3)


_STEPS = "WITH p AS (SELECT l_linenumber::BIGINT AS step, l_orderkey AS id, max(l_quantity) > 25 AS p FROM lineitem GROUP BY ALL), l AS (SELECT o_orderkey AS id, o_orderkey % 9 AS step, o_totalprice > 150000 AS good FROM orders WHERE o_orderkey % 9 < 8), j AS (SELECT p.*, coalesce(l.step <= p.step, false) AS has, good FROM p LEFT JOIN l USING (id)), s AS (SELECT step, count(*) FILTER (has) AS num_labels, count(*) FILTER (NOT has) AS num_unlabeled FROM j GROUP BY step), f AS (SELECT a.step, count(*) AS num_flips FROM j a JOIN j b ON a.id = b.id AND b.step = a.step - 1 AND NOT a.has AND NOT b.has AND a.p <> b.p GROUP BY a.step)"


def _steps(spark, d):
    """Predictions by step (here: an order's lines stand for the models of a vote log) and labels with their steps."""
    p = m.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("step")).agg((F.max("l_quantity") > 25).alias("predicted"))
    return p, m.table(spark, d, "orders").where("o_orderkey % 9 < 8").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).alias("step"), (F.col("o_totalprice") > 150000).alias("good"))


@query("a16_stability_by_step", _STEPS + " SELECT step, num_labels, coalesce(num_flips, 0) AS num_flips, num_unlabeled FROM s LEFT JOIN f USING (step)")
def _(spark, d):
    return evaluate.stability_by_step(*_steps(spark, d))


@query("a18_progress_by_step", _STEPS + ", e AS (SELECT step, round(coalesce(count(*) FILTER (p AND NOT good) / nullif(count(*) FILTER (NOT good), 0), 0) + coalesce(count(*) FILTER (NOT p AND good) / nullif(count(*) FILTER (good), 0), 0), 4) AS error_cost FROM j WHERE good IS NOT NULL GROUP BY step) SELECT step, error_cost, num_labels, coalesce(num_flips, 0) AS num_flips, num_unlabeled FROM s LEFT JOIN f USING (step) LEFT JOIN e USING (step)")
def _(spark, d):
    return evaluate.progress_by_step(*_steps(spark, d))


@query("a19_stopping_advice", "WITH p AS (SELECT l_linenumber AS step, round(avg(l_discount), 4) AS e, count(*) % 7 AS f FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM p), t AS (SELECT * FROM p, n QUALIFY row_number() OVER (ORDER BY step DESC) <= greatest(3, floor(n * 0.3))), a AS (SELECT any_value(n) AS n, (max(e) - min(e)) / CASE avg(e) WHEN 0 THEN 1 ELSE avg(e) END AS s, avg(f) AS f FROM t) SELECT CASE WHEN coalesce(n, 0) < 5 THEN 'keep' WHEN s < 0.1 AND f < 5 THEN 'stop' WHEN s < 0.15 THEN 'consider' WHEN f < 3 THEN 'stable' ELSE 'keep' END AS advice FROM a")
def _(spark, d):
    steps = m.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.round(F.avg("l_discount"), 4).alias("error_cost"), (F.count("*") % 7).alias("num_flips"))
    return evaluate.stopping_advice(steps)


def _cleared_votes(spark, d):
    """Votes on vectors (an event's user stands for the clip); a view whose number 1,500 divides clears all labels."""
    vote = F.when(F.col("event_type").isin("purchase", "signup"), "good").when(F.col("event_type") == "error", "bad").when((F.col("event_type") == "view") & (F.col("event_id") % 1500 == 0), "clear")
    return m.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("clip_id"), vote.alias("vote")).where("vote IS NOT NULL")


_EPOCHS = """WITH v AS (SELECT event_id AS seq, user_id AS clip_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'good' WHEN event_type = 'error' THEN 'bad' WHEN event_type = 'view' AND event_id % 1500 = 0 THEN 'clear' END AS vote FROM events),
y AS (SELECT *, count(*) FILTER (vote = 'clear') OVER (ORDER BY seq) AS epoch FROM v WHERE vote IS NOT NULL),
a AS (SELECT *, CASE WHEN vote = lag(vote) OVER (PARTITION BY epoch, clip_id ORDER BY seq) THEN 0 ELSE 1 END AS c FROM y WHERE vote <> 'clear'),
b AS (SELECT *, sum(c) OVER (PARTITION BY epoch, clip_id ORDER BY seq) AS run FROM a),
log AS (SELECT epoch, seq, clip_id, CASE WHEN row_number() OVER (PARTITION BY epoch, clip_id, run ORDER BY seq) % 2 = 1 THEN vote ELSE 'unlabel' END AS label FROM b),
x AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY epoch, clip_id ORDER BY seq), 'unlabel') AS b FROM log),
n AS (SELECT epoch, seq AS step, sum((label = 'good')::INT - (b = 'good')::INT) OVER (PARTITION BY epoch ORDER BY seq)::BIGINT AS num_good, sum((label = 'bad')::INT - (b = 'bad')::INT) OVER (PARTITION BY epoch ORDER BY seq)::BIGINT AS num_bad FROM x)"""


def _log(spark, d):
    return steps.Log(steps.vote_log(_cleared_votes(spark, d)))


@query("w3_step_labels", _EPOCHS + " SELECT epoch, step, num_good, num_bad FROM n")
def _(spark, d):
    return _log(spark, d).counts


@query("w3_label_spans", _EPOCHS + ", k AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY step) - 1 AS m FROM n WHERE num_good > 0 AND num_bad > 0) SELECT epoch, step, m, num_good, num_bad, (SELECT count(*) FROM (SELECT arg_max(label, seq) AS l FROM log WHERE log.epoch = k.epoch AND seq <= step GROUP BY clip_id) WHERE l <> 'unlabel') AS held FROM k")
def _(spark, d):
    log = _log(spark, d)
    ends = log.spans.select("epoch", F.col("since").alias("m"), F.lit(1).alias("change")).unionByName(log.spans.select("epoch", F.col("until").alias("m"), F.lit(-1).alias("change")))
    # Of the epoch's model steps only, so a running sum of changes by their numbers.
    sums = ends.groupBy("epoch", "m").agg(F.sum("change").alias("change"))
    both = log.steps.join(sums, ["epoch", "m"], "left")
    held = F.sum(F.coalesce("change", F.lit(0))).over(Window.partitionBy("epoch").orderBy("m"))
    return both.select("epoch", "step", "m", "num_good", "num_bad", held.alias("held"))


@query("w3_step_models")
def _(spark, d):
    return steps.step_models(_log(spark, d), m.vec_clips(spark, d)).select("epoch", "step", "num_good", "num_bad", F.round("threshold", 4).alias("threshold"))


def _progress(spark, d):
    log, clips = _log(spark, d), m.vec_clips(spark, d)
    return log, steps.progress(log, clips, written(steps.step_models(log, clips)))


@query("w3_progress")
def _(spark, d):
    return _progress(spark, d)[1]


@query("w3_status_and_advice")
def _(spark, d):
    """Of the last epoch: what labelling has come to."""
    log, told = _progress(spark, d)
    told = written(told)
    last = log.counts.agg(F.max("epoch").alias("epoch"))
    told = told.join(F.broadcast(last), "epoch")
    counts = log.labels().join(F.broadcast(last), "epoch").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    return evaluate.labeling_status(counts, told.select("step", "error_cost")).crossJoin(F.broadcast(evaluate.stopping_advice(told)))
