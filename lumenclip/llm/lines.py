"""Line dedup (2): a deletion-neighbourhood join over the lines of all documents, keeping the earliest.

A line is what newlines separate, without white space at its ends; its words are what single spaces separate.  Two
lines are near when one edit (a word put in, taken out or changed) turns one into the other and both have at least
``min_words`` words.  A line goes when an equal or a near line stands before it, by (doc_id, line number); blank lines
stay.  Edits are counted in words: a changed character, number or name is one edit.  Where rows share a doc_id, the
hash of their texts says which is first; of equal rows any one is.

1. Equal lines meet by a 128-bit hash; each distinct line keeps its first place (summed before the shuffle, so a line
   that a third of all documents have costs a row for each task).
2. Distinct lines that could have a near one are found by two keys each: with one edit, either the first or the last
   half stays as it is.  Lines that share a half with another are looked at more closely: words are dealt into 8 to 15
   blocks from either end, and one edit leaves all blocks but one as they are.  Only lines that share the rest of
   their blocks with another go on.
3. Those emit their deletion variants (the line itself and the line without each word) as hashed keys; equal variants
   join.  Lines that share a variant at one position are all near each other, and a line that equals another's
   variant is near it, so each row of a group is paired with the group's first only: pairs are linear in the rows.
4. Pairs are verified by word edit distance; a line with an earlier neighbour goes.

A variant's key is the exclusive-or of hashes of its words with their places in the variant: running sums over the
words where they are and over the words moved up by one give all keys of a line.

Native: DataFrame functions only.  Null and empty texts have no lines and stay as they are.  A very long text is one
row like any other.  Rows without a doc_id come first.  Of rows that are equal in doc_id and text all but one lose
their lines.  Whatever other columns there are, they stay, under any name; n_chars, if there, becomes the new text's
length.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenclip.llm.common import documents, materialize, may_be_among

#: Stands for a missing doc_id, so that places can be compared and joined.
_NO_ID = -(2**63)
_BLANK = " \t\r\f\v"
PLACE = ["_doc", "_text", "_line"]


def _row_key() -> list[Column]:
    """Tells rows apart and orders them; only rows that are equal in doc_id and text have one key."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_doc"), F.xxhash64("text").alias("_text")]


def _lines(docs: DataFrame) -> DataFrame:
    """_doc, _text, _line, line: the lines that aren't blank."""
    split = docs.select(*_row_key(), F.posexplode(F.split("text", "\n")).alias("_line", "line"))
    return split.withColumn("line", F.btrim("line", F.lit(_BLANK))).where("line <> ''")


def _half(words: Column) -> Column:
    """The greatest power of two that is at most half of ``words``."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.floor(words / 2).cast("double")) + 1e-9)).cast("int")


def _ends(words: Column) -> Column:
    """For a pair whose shorter line has ``words``: for each block that the edit may be in, the number of words before
    it and behind it, whole blocks each, that it leaves as they are.  A line has 8 to 15 whole blocks."""
    q = F.pow(F.lit(2.0), F.floor(F.log2(F.floor(words / 8).cast("double")) + 1e-9)).cast("int")
    m = F.floor(words / q).cast("int")
    return F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct((j * q).alias("head"), ((m - 1 - j) * q).alias("tail")))


def _signatures(docs: DataFrame, min_words: int) -> DataFrame:
    """For each line: its place, two hashes, and the keys of its first and last words where a near line can exist."""
    lines = _lines(docs).withColumn("n", F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)
    lines = lines.withColumns({"k1": _half(F.greatest(F.col("n"), F.lit(3))), "k2": _half(F.greatest(F.col("n") - 1, F.lit(2)))})
    ends = [F.expr(f"xxhash64({side}, {k}, substring_index(line, ' ', {sign}{k}))") for k in ("k1", "k2") for side, sign in ((0, ""), (1, "-"))]
    keys = F.when(F.col("n") < min_words, F.array().cast("array<bigint>")).when(F.col("k1") == F.col("k2"), F.array(*ends[:2])).otherwise(F.array(*ends))
    return lines.select("_doc", "_text", "_line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), keys.alias("keys"))


def _line_count(text: Column) -> Column:
    """Lines of text that aren't blank."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"[^{_BLANK}\n][^\n]*"))


def _distinct(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("h1", "h2").agg(F.min(F.struct("_doc", "_text", "_line")).alias("first"), F.first("keys").alias("keys"))


def _with_company(distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines that share a key with another line."""
    keyed = distinct.select("first", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key").select("first._doc", "first._text", "first._line").distinct()


def _close_company(lines: DataFrame) -> DataFrame:
    """Of lines (PLACE, words), those that share all blocks but one with another."""
    size = F.size("words")
    keyed = lines.withColumn("line", F.array_join("words", " ")).withColumn("ends", F.array_union(_ends(F.greatest(size, F.lit(8))), _ends(F.greatest(size - 1, F.lit(8)))))
    keyed = keyed.select("_doc", "_text", "_line", F.explode(F.expr("array_distinct(transform(ends, e -> xxhash64(e.head, substring_index(line, ' ', e.head), e.tail, substring_index(line, ' ', -e.tail))))")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return lines.join(keyed.join(shared, "key").select(*PLACE).distinct(), PLACE)


def _variants(lines: DataFrame) -> DataFrame:
    """PLACE, n (words of the variant), at (the word left out, -1: none) and key."""
    hashed = lines.select(*PLACE, F.transform("words", lambda w, j: F.xxhash64(w, j)).alias("here"), F.transform("words", lambda w, j: F.xxhash64(w, j - 1)).alias("left"))
    start = F.array(F.lit(0).cast("long"))
    running = lambda c: F.aggregate(c, start, lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1).bitwiseXOR(x))))  # noqa: E731
    hashed = hashed.select(*PLACE, running("here").alias("here"), running("left").alias("left")).withColumn("n", F.size("here") - 1)

    def without(i: Column) -> Column:
        behind = F.element_at("left", -1).bitwiseXOR(F.element_at("left", i + 2))
        return F.struct((F.col("n") - 1).alias("n"), i.alias("at"), F.xxhash64(F.element_at("here", i + 1).bitwiseXOR(behind)).alias("key"))

    whole = F.struct(F.col("n").alias("n"), F.lit(-1).alias("at"), F.xxhash64(F.element_at("here", -1)).alias("key"))
    every = F.concat(F.array(whole), F.transform(F.sequence(F.lit(0), F.col("n") - 1), without))
    return hashed.select(*PLACE, F.explode(every).alias("v")).select(*PLACE, "v.*")


def near_lines(docs: DataFrame, signatures: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines that have a near line before them."""
    company = materialize(_with_company(distinct).groupBy("_doc", "_text").agg(F.collect_set("_line").alias("wanted")))
    texts = docs.select(*_row_key(), "text")
    texts, _ = may_be_among(texts, F.xxhash64("_doc", "_text"), company.select(F.xxhash64("_doc", "_text").alias("key")))
    # Split ahead of the join: behind it, the lines are a column, not an expression that each use works out again.
    texts = texts.select("_doc", "_text", F.split("text", "\n").alias("all")).join(company, ["_doc", "_text"])
    line = lambda i: F.struct(i.alias("_line"), F.split(F.btrim(F.get("all", i), F.lit(_BLANK)), " ").alias("words"))  # noqa: E731
    lines = materialize(texts.select("_doc", "_text", F.explode(F.transform("wanted", line)).alias("l")).select("_doc", "_text", "l.*").dropDuplicates(PLACE))
    lines = materialize(_close_company(lines))
    every = _variants(lines)
    shared = every.groupBy("key", "n").agg(F.count("*").alias("rows")).where("rows > 1").select("key", "n")
    variants = materialize(every.join(shared, ["key", "n"]))
    place = F.struct(*PLACE)
    firsts = variants.groupBy("key", "n", "at").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    # By key and length: the line that is the whole variant, and for each position the first line that it is left of.
    groups = firsts.groupBy("key", "n").agg(F.sum("rows").alias("rows"), F.max(F.when(F.col("at") == -1, F.col("first"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("longer")).where("rows > 1")
    # The least of several shorter partners is enough: a line goes if any of them stands before it.
    changed = firsts.where((F.col("rows") > 1) & (F.col("at") >= 0)).select("key", "n", "at", F.col("first").alias("other"))
    same_place = variants.join(changed, ["key", "n", "at"]).where(place > F.col("other")).select(*PLACE, "at", "other")
    longer = variants.where("at >= 0").join(groups.where("whole IS NOT NULL AND longer IS NOT NULL").select("key", "n", "whole"), ["key", "n"]).where(place > F.col("whole")).select(*PLACE, "at", F.col("whole").alias("other"))
    whole = groups.where("whole IS NOT NULL AND longer < whole").select("whole._doc", "whole._text", "whole._line", F.lit(-1).alias("at"), F.col("longer").alias("other"))
    pairs = same_place.unionByName(longer).unionByName(whole).distinct()
    a = lines.select(*PLACE, F.col("words").alias("a"))
    b = lines.select(F.struct(*PLACE).alias("other"), F.col("words").alias("b"))
    return pairs.join(a, PLACE).join(b, "other").where(within_one_edit(F.col("a"), F.col("b"))).select(*PLACE).distinct()


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether word arrays differ by one word put in, taken out or changed (or not at all)."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    # The first place where they differ; behind it the rest must be equal, with or without the word there.
    differs = F.array_position(F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x != y), True).cast("int")
    p = F.when(differs == 0, F.size(short) + 1).otherwise(differs)
    behind = lambda c, i: F.slice(c, i, F.greatest(F.size(c), F.lit(1)))  # noqa: E731
    changed = (F.size(a) == F.size(b)) & ((differs == 0) | (behind(short, p + 1) == behind(long, p + 1)))
    longer = (F.size(long) == F.size(short) + 1) & (behind(short, p) == behind(long, p + 1))
    return changed | longer


def kept_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """row (a struct of ``docs``' columns, text replaced by its kept lines) and n_lines, n_equal, n_near: lines that
    aren't blank, and those that went as equal to or near an earlier one.  A line that is both counts as equal."""
    signatures = materialize(_signatures(docs, min_words))
    distinct = materialize(_distinct(signatures))
    near = near_lines(docs, signatures, distinct).select(F.struct(*PLACE).alias("first"), F.lit(True).alias("near"))
    lines = distinct.select("h1", "h2", "first").join(near, "first", "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    equal = F.struct(*PLACE) != F.col("first")
    verdict = signatures.select(*PLACE, "h1", "h2").join(lines, ["h1", "h2"]).select(*PLACE, equal.alias("equal"), "near").where("equal OR near")
    gone = verdict.groupBy("_doc", "_text").agg(F.collect_set("_line").alias("gone"), F.collect_set(F.when(F.col("equal"), F.col("_line"))).alias("as_equal"))
    gone = materialize(gone.select("_doc", "_text", "gone", F.size("as_equal").alias("n_equal")))
    copies = materialize(docs.where("text IS NOT NULL").select(*_row_key()).groupBy("_doc", "_text").agg(F.count("*").alias("rows")).where("rows > 1").select("_doc", "_text"))

    own = docs.select(*_row_key(), F.struct("*").alias("row"))
    key = F.xxhash64("_doc", "_text")
    touched, whole = may_be_among(own, key, gone.select("_doc", "_text").union(copies).select(key.alias("key")))
    touched = touched.withColumn("all", F.split("row.text", "\n"))
    # Equal rows get numbers, which are written and so stay what they are.
    some, touched = may_be_among(touched, key, copies.select(key.alias("key")))
    some = materialize(some.withColumn("number", F.monotonically_increasing_id()))
    first = some.join(copies, ["_doc", "_text"]).groupBy("_doc", "_text").agg(F.min("number").alias("first"))
    some = some.join(first, ["_doc", "_text"], "left").withColumn("again", F.coalesce(F.col("number") != F.col("first"), F.lit(False)))
    touched = some.drop("number", "first").unionByName(touched.withColumn("again", F.lit(False))).join(gone, ["_doc", "_text"], "left")

    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"), lambda i: F.get("all", i))
    blank = F.filter("all", lambda x: F.btrim(x, F.lit(_BLANK)) == "")
    n_lines, text = _line_count(F.col("row.text")), F.array_join(F.when(F.col("again"), blank).otherwise(left), "\n")
    text = F.when(F.col("again") | F.col("gone").isNotNull(), text).otherwise(F.col("row.text"))
    n_equal = F.when(F.col("again"), n_lines).otherwise(F.coalesce("n_equal", F.lit(0)))
    n_near = F.when(F.col("again"), 0).otherwise(F.coalesce(F.size("gone") - F.col("n_equal"), F.lit(0)))
    touched = touched.select(_with_text(docs, text).alias("row"), n_lines.alias("n_lines"), n_equal.alias("n_equal"), n_near.alias("n_near"))
    whole = whole.select("row", n_lines.alias("n_lines"), F.lit(0).alias("n_equal"), F.lit(0).alias("n_near"))
    return touched.unionByName(whole).select("row", *[F.col(c).cast("long").alias(c) for c in ("n_lines", "n_equal", "n_near")])


def _with_text(docs: DataFrame, text: Column) -> Column:
    """The struct ``row`` of ``docs``' columns with another text."""
    fields = []
    for f in docs.schema.fields:
        value = F.col("row").getField(f.name)
        if f.name == "text":
            value = text
        elif f.name == "n_chars":
            value = F.length(text).cast(f.dataType)
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def line_dedup(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs``, columns and all, with each text replaced by its kept lines."""
    return kept_lines(docs, min_words).select("row.*")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_lines(documents(spark, sf_dir))
    return kept.select("row.doc_id", "n_lines", "n_equal", "n_near", F.md5(F.coalesce("row.text", F.lit(""))).alias("kept_md5"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, trim(ls[i], E' 	
') AS line, ls[i] AS raw
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS t(i)),
b AS (SELECT * FROM l WHERE line <> ''),
d AS (SELECT line, min((doc_id, i)) AS f, string_split(line, ' ') AS w FROM b GROUP BY line),
v AS (
  SELECT line, f, len(w) - 1 AS n, k, list_concat(w[1:k - 1], w[k + 1:]) AS key FROM d, unnest(generate_series(1, len(w))) AS t(k) WHERE len(w) >= 8
  UNION ALL SELECT line, f, len(w), 0, w FROM d WHERE len(w) >= 8),
near AS (
  SELECT DISTINCT x.line FROM v x JOIN v y ON x.n = y.n AND x.key = y.key AND (x.k = y.k OR x.k = 0 OR y.k = 0)
  WHERE y.f < x.f),
r AS (
  SELECT b.doc_id, b.i, (b.doc_id, b.i) <> d.f AS eq, b.line IN (SELECT line FROM near) AS nr FROM b JOIN d ON b.line = d.line)
SELECT l.doc_id, count(r.i)::BIGINT AS n_lines, count(*) FILTER (eq)::BIGINT AS n_equal, count(*) FILTER (NOT eq AND nr)::BIGINT AS n_near,
  md5(coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (NOT coalesce(eq OR nr, false)), '')) AS kept_md5
FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i GROUP BY l.doc_id
"""
