"""Label algebra: matching external labels to clips, votes, and the vote log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenclip.operators.ranking import positions

VALID = ("good", "bad")


def resolve(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """pos, id of each match of an entry (pos, md5, origin_key) by origin or by content.

    A join on either of two keys would compare all with all; two hash joins and a distinct don't.
    """
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    by = [entries.where(some(k)).select("pos", k).join(clips.where(some(k)).select("id", k), k).select("pos", "id") for k in ("origin_key", "md5")]
    return by[0].union(by[1]).distinct()


def missing(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """Entries with a valid label that match no clip."""
    return entries.where(F.col("label").isin(*VALID)).join(resolve(entries, clips), "pos", "left_anti")


def apply_labels(entries: DataFrame, clips: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes (id, label) after all entries in order; the last one of a clip wins."""
    valid = entries.where(F.col("label").isin(*VALID))
    new = resolve(valid, clips).join(valid.select("pos", "label"), "pos").groupBy("id").agg(F.max_by("label", "pos").alias("label"))
    return votes.join(new, "id", "left_anti").select("id", "label").unionByName(new)


def import_counts(entries: DataFrame, clips: DataFrame) -> DataFrame:
    """One row: applied, skipped (invalid label) and missing entries."""
    hit = resolve(entries, clips).select("pos").distinct().withColumn("hit", F.lit(True))
    e = entries.join(hit, "pos", "left")
    valid = F.col("label").isin(*VALID)
    return e.agg(F.count_if(valid & F.col("hit").isNotNull()).alias("applied"), F.count_if(~valid).alias("skipped"), F.count_if(valid & F.col("hit").isNull()).alias("missing"))


def labelset(votes: DataFrame, clips: DataFrame) -> DataFrame:
    """Voted clips, with what a label export carries."""
    return clips.join(votes, "id").select("id", "label", "md5", "filename", "category")


def labelset_from_results(hits: DataFrame, clips: DataFrame) -> DataFrame:
    """A good label for each hit of each detector; an origin that a hit lacks is its clip's."""
    own = clips.select("id", F.col("origin").alias("_origin"), F.coalesce("origin_name", "filename").alias("_name"))
    lacks = F.col("origin").isNull()
    name = F.when(lacks, F.coalesce(F.when(F.col("origin_name") != "", F.col("origin_name")), "_name")).otherwise(F.col("origin_name"))
    return hits.join(own, "id", "left").select("detector", "id", F.lit("good").alias("label"), F.coalesce("md5", F.lit("")).alias("md5"), F.coalesce("origin", "_origin").alias("origin"), name.alias("origin_name"), "filename", "category")


def concatenated(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both datasets' clips, the new ones with ids behind the existing ones (their own order by id kept)."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    least = new.agg(F.min("id").alias("_least"))
    moved = new.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(least)).withColumn("id", F.col("id") - F.col("_least") + F.col("_last") + 1)
    return existing.unionByName(moved.select(existing.columns))


def upserted(registry: DataFrame, entries: DataFrame, key: str = "name") -> DataFrame:
    """A registry with entries put in, in place of those of the same name."""
    return registry.join(entries, key, "left_anti").select(registry.columns).unionByName(entries.select(registry.columns))


def renamed(registry: DataFrame, old: str, new: str, key: str = "name") -> DataFrame:
    """A registry with one entry renamed; as it is if there is none of the old name or one of the new."""
    state = registry.agg(F.count_if(F.col(key) == old).alias("_old"), F.count_if(F.col(key) == new).alias("_new"))
    may = (F.col("_old") > 0) & (F.col("_new") == 0) & (F.col(key) == old)
    return registry.crossJoin(F.broadcast(state)).withColumn(key, F.when(may, F.lit(new)).otherwise(F.col(key))).select(registry.columns)


def removed(registry: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """A registry without the entries of some names; names that it doesn't have change nothing."""
    return registry.join(names.select(key), key, "left_anti").select(registry.columns)


def entries_by_origin(entries: DataFrame, by: str = "id") -> DataFrame:
    """Entries of an origin_key with their place in their origin's list, by ascending ``by``, and the list's length.

    The lists are rows, not arrays: an origin may have any share of all entries.  Entries without an origin are left out.
    """
    known = entries.where("origin_key IS NOT NULL")
    placed = positions(known, by, "origin_key", ascending=True)
    return placed.join(placed.groupBy("origin_key").agg(F.count("*").alias("n_entries"), F.count_distinct("md5").alias("n_hashes")), "origin_key")


def vote_sequence(clips: DataFrame, target: str, seed: int) -> DataFrame:
    """t, id, label: every clip voted by its category, in an order by chance (a hash's).

    The hash's first three digits deal clips into parts, whose sizes are summed up; places are told within a part.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(target), F.col("id").cast("string")))
    dealt = clips.select("id", F.when(F.col("category") == target, "good").otherwise("bad").alias("label"), h.alias("h"))
    dealt = dealt.withColumn("part", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # 4,096 rows at most
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("h", "id"))
    return dealt.join(F.broadcast(ahead), "part").select((F.col("ahead") + place).alias("t"), "id", "label")


def cherry_pick(source: DataFrame, names: DataFrame, hashes: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``source`` whose name or md5 is wanted, with new ids behind the existing ones."""
    wanted = source.join(names, "filename", "left_semi").select(source.columns).union(source.join(hashes, "md5", "left_semi").select(source.columns)).distinct()
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # Ids are dealt into blocks, whose sizes are summed up; places are told within a block.
    dealt = wanted.withColumn("block", F.floor(F.col("id") / 10_000))
    ahead = dealt.groupBy("block").agg(F.count("*").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("id"))
    numbered = dealt.join(ahead, "block").crossJoin(F.broadcast(last))
    return numbered.withColumn("new_id", (F.col("last") + F.col("ahead") + place).cast("long")).drop("last", "block", "ahead")


def toggled(votes: DataFrame) -> DataFrame:
    """The log that votes leave: a vote equal to the clip's label takes it back.

    A run of equal votes of a clip sets and takes back in turn, so a vote's place in its run says which.  With a column
    epoch, each epoch's votes start anew.
    """
    keys = ["epoch", "clip_id"] if "epoch" in votes.columns else ["clip_id"]
    clip = Window.partitionBy(*keys).orderBy("seq")
    changed = F.when(F.col("vote") == F.lag("vote").over(clip), 0).otherwise(1)
    runs = votes.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(clip))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("seq"))
    return runs.withColumn("label", F.when(place % 2 == 1, F.col("vote")).otherwise("unlabel")).drop("_c", "_run")


def label_state(log: DataFrame, until: int | None = None) -> DataFrame:
    """clip_id, label as of a step of the log (its end, by default)."""
    log = log if until is None else log.where(F.col("seq") <= until)
    return log.groupBy("clip_id").agg(F.max_by("label", "seq").alias("label")).where("label <> 'unlabel'")


def running_sets(log: DataFrame) -> DataFrame:
    """seq, num_good, num_bad after each event of the log.

    Each event's change comes from its clip's window; the sums run in blocks of ``seq`` plus the blocks before.
    """
    before = F.coalesce(F.lag("label").over(Window.partitionBy("clip_id").orderBy("seq")), F.lit("unlabel"))
    delta = lambda v: F.when(F.col("label") == v, 1).otherwise(0) - F.when(before == v, 1).otherwise(0)
    d = log.select("seq", delta("good").alias("g"), delta("bad").alias("b")).withColumn("block", F.floor(F.col("seq") / 10_000))
    sums = d.groupBy("block").agg(F.sum("g").alias("sg"), F.sum("b").alias("sb"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("sg").over(ahead), F.lit(0)).alias("sg"), F.coalesce(F.sum("sb").over(ahead), F.lit(0)).alias("sb"))
    own = Window.partitionBy("block").orderBy("seq")
    return d.join(sums, "block").select("seq", (F.col("sg") + F.sum("g").over(own)).alias("num_good"), (F.col("sb") + F.sum("b").over(own)).alias("num_bad"))
