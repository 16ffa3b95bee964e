"""N-gram Jaccard join (10): universe-partition pigeonhole over distinct word shingles, exactly verified.

1. Documents with equal sets are one class; a class goes on as its least doc_id.
2. Sizes fall into bands.  Sets that link differ by at most H tokens.  Hashing deals the universe into m segments; of
   these, k also count with one difference, so each of them takes two differences to spoil and any other one.  Then
   segments of a weight of m + k - H agree at least: exactly, or, for the k, up to one token.  Each of the k gives a key
   and one for each of its tokens left out (the one-deletion neighbourhood).  Of the others, those that are empty agree
   with all and sundry; where more must agree than are empty in a set, it gives keys for the filled ones alone, in
   order, and for so many fewer that one that agrees is still among them: H - 2 k + 1.  ``allocate`` chooses m and k for
   each band by the expected cost: keys to shuffle against meetings of sets that aren't alike.
3. Of all classes that share a key with another, those go on whose sets have tokens enough that another of these has, too:
   two that link share ``percent`` of either's.  That is told from a part of the universe (its tokens counted exactly, the
   shared ones in a bitmap): where too many tokens of that part are a class's own, it links with nothing.  Of those that
   are left all tokens are counted in the same way.  So texts that only quote the same passages stay out of what follows, however many quote them.
   A key that two of the rest share gives their pair, which is verified on the whole sets.
4. A key that more than FEW share (near copies by the thousand, or a common passage) must not give all pairs.  The
   classes of such keys meet by the rarest tokens of their sets instead: so many that two that link share one of them.
   Where few share such a token they are pairs as in step 3.  How rare a token is, is told by a table of fixed size that
   counts all tokens of these classes: any order that is the same for all serves, so only the chosen tokens are shuffled.
5. Classes that share a crowded token form clusters, and each is written as its difference D from what most of its
   cluster have.  With weight w = size - 19 * |D|, x and y link (at 0.9) exactly if w_x + w_y + 38 * |D_x & D_y| >= 0.  So
   all with w_x + w_c >= 0 link with the centre c (the largest w), and any other class can only link where it shares
   tokens of D, which is what the rest of the copies don't do: those meet by their rarest shared tokens, as far as the
   tokens behind these still suffice, and are counted exactly.
6. Components of the links; a document's is the least doc_id that it reaches.

Null and empty texts and those without words have an empty set and are components of their own.  With fewer words than
a shingle has, the whole sequence is the one shingle.  A very long text is worked on alone, whole.  Repeated doc_ids
keep all their rows; rows without a doc_id have no component and link nothing.  Equal sets are one class, so ties need
no order.  Other columns are not looked at, whatever their names.  An empty table gives no rows.

What most of a cluster have is told from a bounded sample of it; the links don't depend on it, only how few classes
have to meet beyond the centre.  Texts, not sets, go to where pairs are verified: they are smaller.
Tokens are 64-bit hashes of shingles: two different shingles of a pair agree with a chance of about 1e-13.
"""


from collections.abc import Iterator
from math import ceil, erfc, exp, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.llm.common import discard, documents, materialize, may_be_among, mix, words_of
from lumenclip.llm.components import connected_components

#: Ratio of a band's sizes.
BAND = 2.0
#: How much of a set a passage that others have is taken to be, in the cost of keys.
PASSAGE = 0.3
#: Classes of a cluster from which what most of it have is told: any choice gives the same links, a good one sooner.
SAMPLE = 24
#: A key that more classes share goes by step 4, a token by step 5.
FEW = 4
#: Buckets (2**ORDER_BITS, in SLICES parts) of the table that orders tokens by how many sets have them, in step 4.
ORDER_BITS, SLICES = 20, 16
#: Groups that the tasks' tables of a part are added up in, before these are.
SUMS = 1024
#: Of the universe, a part this many times what two sets that link may lack of each other is counted first in step 3, in
#: PARTS parts.  Bits of the bitmap for each class, at most so many; tokens that a task holds before it hands them on.
COUNTED, PARTS, BITS_A_CLASS, MOST_BITS, HELD = 2.5, 1024, 256, 1 << 29, 1 << 21
_ORDER = np.uint64((1 << ORDER_BITS) - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for a, b, w in words_of(texts, lower=True):
        shingles, of = w.shingles(k)
        edges = np.searchsorted(of, np.arange(b - a + 1))
        for i in range(b - a):
            own = shingles[edges[i] : edges[i + 1]]
            if len(own):
                yield np.unique(own)
                continue
            few = w.hash[w.first[i] : w.first[i + 1]]
            out = np.full(1 if len(few) else 0, len(few), np.uint64)
            for h in few:
                out = mix(out * _MULT + h)
            yield out


class Bands:
    """Size bands and each one's (segments, of which with one deletion)."""

    def __init__(self, threshold: float, documents: int) -> None:
        # Sizes below this link only as equal sets.
        self.least = ceil(threshold / (1 - threshold) - 1e-9)
        self.threshold, self.documents = threshold, documents
        self.ratio = (1 - threshold) / (1 + threshold)
        self.lower, self.plan = [self.least], []

    def band(self, size: int) -> int:
        while self.lower[-1] <= size:
            self.plan.append(self.allocate(self.lower[-1], next_ := max(self.lower[-1] + 1, ceil(self.lower[-1] * BAND))))
            self.lower.append(next_)
        return int(np.searchsorted(self.lower, size, "right")) - 1

    def allocate(self, least: int, beyond: int) -> tuple[int, int]:
        """The cheapest m and k for sizes from ``least`` up to ``beyond`` - 1.

        A set costs its keys and the meetings of sets that aren't alike: by segments that are empty in both, where
        those have keys, and by segments that hold nothing but a passage that one in a thousand sets has, too.
        """
        most, best = floor(2 * (beyond - 1) * self.ratio + 1e-9), None
        for k in range(0, most // 2 + 1, max(1, most // 40)):
            for more in (1, 1.1, 1.25, 1.5, 2):
                m = max(ceil((most + 1 - k) * more), 2 * k)
                tokens = least / m
                exact, near = max(most - 2 * k + 1, 0), k * (1 + tokens)
                empty = (m - k) * exp(-tokens)
                short = 0.5 * erfc((m + k - most - 1 - empty) / sqrt(2 * empty + 1e-9))
                by_empty = self.documents * exp(-2 * tokens) * (short * (m - k) + near)
                by_passage = self.documents / 1000 * (exact * PASSAGE**tokens + near * PASSAGE ** max(tokens - 1, 0))
                cost = exact + near + by_empty + by_passage
                if best is None or cost < best[0]:
                    best = cost, m, k
        return best[1], best[2]

    def of(self, size: int) -> list[int]:
        """The bands that a set is indexed in: its own, and the next if a larger partner can lie there."""
        if size < self.least:
            return []
        own = self.band(size)
        beyond = self.lower[own + 1]
        self.band(beyond)
        return [own, own + 1] if size >= self.threshold * beyond - 1e-9 else [own]

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        out, n = [], len(tokens)
        for band in self.of(n):
            m, k = self.plan[band]
            largest = min(self.lower[band + 1] - 1, floor(n / self.threshold + 1e-9))
            apart = floor((n + largest) * self.ratio + 1e-9)
            salt = mix(np.array([band + 1], np.uint64) * _MULT)[0]
            mixed = mix(tokens ^ salt)
            segment = (mixed % np.uint64(m)).astype(np.int64)
            value = mix(mixed + salt)
            total = np.zeros(m, np.uint64)
            np.add.at(total, segment, value)
            place = mix(np.arange(m, dtype=np.uint64) * _MULT + salt)
            exact = mix(total[k:] ^ place[k:])
            filled = np.bincount(segment, minlength=m)[k:] > 0
            shared = m + k - apart - int((~filled).sum())  # exact segments, not empty, that any partner shares at least
            if shared > 0:
                exact = exact[filled]
                exact = exact[: len(exact) - shared + 1]
            out.append(exact)
            if k:
                out.append(mix(total[:k] ^ place[:k]))
                near = segment < k
                out.append(mix((total[segment[near]] - value[near]) ^ place[segment[near]]))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def signatures(docs: DataFrame, k: int, threshold: float, rows: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and its keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(threshold, rows)
        for batch in batches:
            n, hashes, keys = [], [], []
            for s in sets_of(batch.column(batch.schema.get_field_index("text")), k):
                n.append(len(s))
                hashes.append((mix(s + _MULT).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ _MULT)) if len(s) else np.uint64(0)))
                keys.append(bands.keys(s))
            h = np.array(hashes, np.uint64).reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), _signed(h[:, 0].copy()), _signed(h[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))], names=["doc_id", "n", "h1", "h2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, keys array<long>")


def _texts_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, crowded, text for each row of ``wanted`` (rep: a doc_id, crowded)."""
    texts, _ = may_be_among(docs.select("doc_id", "text"), F.col("doc_id"), wanted.select("rep"))
    return texts.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select(F.col("doc_id").alias("rep"), "crowded", "text").dropDuplicates(["rep"])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _counted(tokens: np.ndarray, share: float) -> np.ndarray:
    """Of a set's tokens those of a share of the universe, as 42 bits: part, then the place in it."""
    mixed = mix(tokens ^ _MULT)
    return mixed[(mixed & np.uint64(1023)) < np.uint64(ceil(share * 1024))] >> np.uint64(22)


def _bit(place: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each place, of ``bits`` that a part has (a power of two)."""
    return (mix(place.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _shared_tokens(texts: DataFrame, k: int, share: float, bits: int) -> np.ndarray:
    """By part, a bitmap of the counted tokens that more than one of the texts has.

    A task hands its tokens on by part, four bytes each; a part's are counted together.
    """

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # Two of a token tell as much as all.
            tokens = np.sort(np.concatenate(held))
            tokens = tokens[np.r_[True, True, tokens[2:] != tokens[:-2]][: len(tokens)]]
            edges = np.searchsorted(tokens, np.arange(PARTS + 1, dtype=np.uint64) << np.uint64(32))
            places = tokens.astype(np.uint32)
            some = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([places[edges[i] : edges[i + 1]].tobytes() for i in some], pa.binary())], names=["part", "tokens"])

        for batch in batches:
            for s in sets_of(_column(batch, "text"), k):
                own = _counted(s, share)
                held.append(own)
                size += len(own)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        places = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("tokens")]))
        shared, out = np.unique(places[1:][places[1:] == places[:-1]]), np.zeros(bits, np.uint8)
        out[_bit(shared, bits)] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bitmap": pa.array([np.packbits(out).tobytes()], pa.binary())})

    parts = texts.select("text").mapInArrow(hand_on, "part int, tokens binary").groupBy("part").applyInArrow(count, "part int, bitmap binary").toArrow()
    bitmap = np.zeros((PARTS, bits // 8), np.uint8)
    for i, x in zip(parts.column("part").to_pylist(), parts.column("bitmap"), strict=True):
        bitmap[i] = np.frombuffer(x.as_buffer(), np.uint8)
    return bitmap


def _may_link(docs: DataFrame, reps: DataFrame, k: int, percent: int, share: float) -> DataFrame:
    """rep: of ``reps`` those whose texts have so many tokens that others of them have, too, that they may link, by a
    share of the universe."""
    texts, _ = may_be_among(docs.select("doc_id", "text"), F.col("doc_id"), reps)
    bits = 8
    while bits * PARTS < min(reps.count() * BITS_A_CLASS, MOST_BITS):
        bits *= 2
    shared = reps.sparkSession.sparkContext.broadcast(_shared_tokens(texts, k, share, bits))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s in sets_of(_column(batch, "text"), k):
                own = _counted(s, share)
                bit = _bit(own & np.uint64(0xFFFFFFFF), bits)
                alone = ((shared.value[(own >> np.uint64(32)).astype(np.int64), bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1) == 0
                good.append(100 * (len(s) - int(alone.sum())) >= percent * len(s))
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id")], names=["rep"]).filter(pa.array(good, pa.bool_()))

    return texts.mapInArrow(judge, "rep long").distinct().join(reps, "rep")


def _few_pairs(members: DataFrame, group: list[str], percent: int) -> DataFrame:
    """a, b: classes (rep, n) that share a group of at most FEW and whose sizes let them link."""
    groups = members.where(F.col("many") <= FEW).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("g")).select("g").distinct()
    first = groups.select("g", F.posexplode("g").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("g", F.col("i") + 2, FEW)).alias("b"))
    return pairs.where(100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def _few_links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(sets_of(_column(batch, "x"), k), sets_of(_column(batch, "y"), k), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([_column(batch, "a"), _column(batch, "b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _token_sets(rows: DataFrame, k: int) -> DataFrame:
    """cluster, d: the distinct shingle hashes of each row's text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = [x.view(np.int64) for x in sets_of(_column(batch, "text"), k)]
            yield pa.RecordBatch.from_arrays([_column(batch, "cluster"), pa.array(d, pa.list_(pa.int64()))], names=["cluster", "d"])

    return rows.select("cluster", "text").mapInArrow(hashed, "cluster long, d array<long>")


def _token_counts(texts: DataFrame, k: int) -> np.ndarray:
    """For each bucket of tokens, how many it has in all texts.

    A task adds up its own; tables of tasks are added in groups of a bounded size, part by part.
    """
    part = (1 << ORDER_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(1 << ORDER_BITS, np.int64), 0
        for batch in batches:
            if len(batch):
                salt = _column(batch, "salt")[0].as_py()
            for s in sets_of(_column(batch, "text"), k):
                at, n = np.unique(s & _ORDER, return_counts=True)
                total[at.astype(np.int64)] += n
        if total.any():
            counts = pa.array([total[i * part : (i + 1) * part].tobytes() for i in range(SLICES)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), counts], names=["slice", "salt", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": table.column("slice")[:1], "salt": table.column("salt")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, salt int, counts binary"
    salted = texts.select("text", (F.spark_partition_id() % SUMS).alias("salt"))
    sums = salted.mapInArrow(count, schema).groupBy("slice", "salt").applyInArrow(add, schema).groupBy("slice").applyInArrow(add, schema).toArrow()
    out = np.zeros(1 << ORDER_BITS, np.int64)
    for i, x in zip(sums.column("slice").to_pylist(), sums.column("counts"), strict=True):
        out[i * part : (i + 1) * part] = np.frombuffer(x.as_buffer(), np.int64)
    return out


def _rare_tokens(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """rep, n, token, many: the rarest of each text's tokens, so many that any two texts that link share one of them,
    where more than one text has it; ``many`` of them do."""
    counts = texts.sparkSession.sparkContext.broadcast(_token_counts(texts, k))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kept = [], [np.zeros(0, np.uint64)]
            for s in sets_of(_column(batch, "text"), k):
                order = np.lexsort((s, counts.value[(s & _ORDER).astype(np.int64)]))
                n.append(len(s))
                kept.append(s[order[: len(s) + 1 + -len(s) * percent // 100]])
            times = [len(x) for x in kept[1:]]
            rep = np.repeat(_column(batch, "rep").to_numpy(zero_copy_only=False).astype(np.int64), times)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.repeat(np.array(n, np.int32), times)), _signed(np.concatenate(kept))], names=["rep", "n", "token"])

    token = materialize(texts.select("rep", "text").mapInArrow(rare, "rep long, n int, token long"))
    many = token.groupBy("token").agg(F.count("*").alias("many")).where("many > 1")
    members = materialize(token.join(many, "token"))
    discard(token)
    return members


def _prefixes(rows: DataFrame) -> DataFrame:
    """Of each row (cluster, rep, w, need, active, d) the rarest of the tokens that it shares with others of its
    cluster, so many that one of any ``need`` shared ones is among them: token (hashed with its cluster), r (how many it
    shares), place.  Only tokens that may be shared are shuffled with their rows, and alone."""
    of = F.xxhash64("cluster", "token").alias("token")
    token = rows.select("cluster", "rep", "active", F.explode("d").alias("token")).select("rep", "active", of)
    shared = materialize(token.groupBy("token").agg(F.count("*").alias("df"), F.count_if("active").alias("actives")).where("df > 1 AND actives > 0").select("token", "df"))
    some, _ = may_be_among(token.select("rep", "token"), F.col("token"), shared.select("token"))
    own = Window.partitionBy("rep")
    placed = some.join(shared, "token").withColumn("r", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("df", "token")))
    placed = placed.join(rows.select("cluster", "rep", "w", "need", "active"), "rep")
    token = materialize(placed.where("r >= need AND place <= r - need + 1").drop("df", "need"))
    discard(shared)
    many = token.groupBy("token").agg(F.count("*").alias("many"), F.count_if("active").alias("actives")).where("many > 1 AND actives > 0").select("token", "many")
    return token.join(many, "token")


def _clusters(members: DataFrame) -> DataFrame:
    """rep, cluster for the classes that share a token with more than FEW."""
    crowded = members.where(F.col("many") > FEW)
    pivot = crowded.groupBy("token").agg(F.min("rep").alias("b"))
    clusters = connected_components(crowded.join(pivot, "token").select(F.col("rep").alias("a"), "b"))
    clusters = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    return materialize(clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct()))


def _differences(clusters: DataFrame, members: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """cluster, rep, n, d: each class's difference from what most of a sample of its cluster have.

    The sample is of those with the cluster's most crowded token.  A token of d that is left out is told from one that
    is put in by nothing: common tokens are never put in.
    """

    def most(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        token, count = np.unique(table.column("d").combine_chunks().flatten().to_numpy(zero_copy_only=False), return_counts=True)
        return pa.table({"cluster": pa.array([key[0].as_py()], pa.int64()), "common": pa.array([token[2 * count > len(table)]], pa.list_(pa.int64()))})

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d = [], []
            for own, common in zip(sets_of(_column(batch, "text"), k), _column(batch, "common"), strict=True):
                n.append(len(own))
                d.append(np.setxor1d(own.view(np.int64), common.values.to_numpy(zero_copy_only=False), assume_unique=True))
            yield pa.RecordBatch.from_arrays([_column(batch, "cluster"), _column(batch, "rep"), pa.array(n, pa.int32()), pa.array(d, pa.list_(pa.int64()))], names=["cluster", "rep", "n", "d"])

    crowded = members.where(F.col("many") > FEW).select("token", "rep", "many").join(clusters, "rep")
    top = crowded.groupBy("cluster").agg(F.max(F.struct("many", "token")).alias("t")).select("cluster", F.col("t.token").alias("token"))
    by_chance = Window.partitionBy("cluster").orderBy(F.xxhash64("rep"), "rep")
    sample = crowded.join(top, ["cluster", "token"]).withColumn("i", F.row_number().over(by_chance)).where(F.col("i") <= SAMPLE).select("rep", "cluster")
    common = _token_sets(sample.join(texts, "rep"), k).groupBy("cluster").applyInArrow(most, "cluster long, common array<long>")
    return clusters.join(texts, "rep").join(materialize(common), "cluster").select("cluster", "rep", "text", "common").mapInArrow(differ, "cluster long, rep long, n int, d array<long>")


def _cluster_links(clusters: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b that join the same components as all links within the clusters."""
    # In hundredths of a token: 100 * I >= p * U, with I = (S - D) / 2 and U = (S + D) / 2, is (100 - p) S >= (100 + p) D.
    less, more = 100 - percent, 100 + percent
    differ = materialize(_differences(clusters, members, texts, k).withColumn("w", less * F.col("n") - more * F.size("d")))
    narrow = differ.select("cluster", "rep", "n", "w", F.size("d").alias("nd"))
    centre = narrow.groupBy("cluster").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("c")).select("cluster", F.col("c.w").alias("cw"), (-F.col("c.r")).alias("centre"))
    placed = materialize(narrow.join(centre, "cluster").withColumn("active", (F.col("w") + F.col("cw") < 0) & (F.col("rep") != F.col("centre"))))
    sure = placed.where("NOT active AND rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b"))

    # The others can only link where they share tokens of d with another, and the rest of the cluster only with them.
    far = placed.where("active").groupBy("cluster").agg(F.max("w").alias("aw"))
    best = F.when(F.col("active"), F.col("cw")).otherwise(F.col("aw"))
    rows = placed.join(far, "cluster").withColumn("need", F.ceil(-(F.col("w") + best) / (2 * more))).where("nd >= need").select("rep", "w", "need", "active")
    token = materialize(_prefixes(rows.join(differ.select("cluster", "rep", "d"), "rep")))
    side = lambda x: [F.col("rep").alias(x), F.col("w").alias("w" + x), (F.col("r") - F.col("place")).alias("behind" + x)]
    x, y = token.where("active").select("cluster", "token", *side("a")), token.select("cluster", "token", *side("b"), "active")
    # The first token that two share leaves at most so many more.
    meet = x.join(y, ["cluster", "token"]).where((F.col("a") != F.col("b")) & (~F.col("active") | (F.col("a") < F.col("b"))) & (F.col("wa") + F.col("wb") + 2 * more * (1 + F.least("behinda", "behindb")) >= 0))
    pairs = meet.select("a", "b", "wa", "wb").distinct()
    d = differ.select("rep", "d")
    both = pairs.join(d.select(F.col("rep").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("rep").alias("b"), F.col("d").alias("db")), "b")
    found = both.where(F.col("wa") + F.col("wb") + 2 * more * F.size(F.array_intersect("da", "db")) >= 0).select("a", "b")
    return sure.unionByName(found)


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    signed = materialize(signatures(docs, k, percent / 100, docs.count()))
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(some.select("h1", "h2", "n", "doc_id").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    # Classes go on as their least rows; few rows are anything else, so only those that may be need a join.
    rows = some.select("doc_id", "h1", "h2", "n").join(classes, ["h1", "h2", "n"])
    twice = some.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    other = materialize(rows.where("doc_id <> rep").select("doc_id").union(twice).distinct())
    unsure, sure = may_be_among(some.select("doc_id", "n", "h1", "h2", "keys"), F.col("doc_id"), other)
    unsure = unsure.join(classes, ["h1", "h2", "n"]).where("doc_id = rep").dropDuplicates(["doc_id"]).select("doc_id", "n", "keys")
    least = sure.select("doc_id", "n", "keys").unionByName(unsure)
    keyed = least.select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    again, _ = may_be_among(keyed, F.col("key"), shared.select("key"))
    members = materialize(again.join(shared, "key"))
    company = materialize(members.groupBy("rep").agg((F.max("many") > FEW).alias("crowded")))
    once = materialize(_may_link(docs, company.select("rep"), k, percent, min(1.0, COUNTED * (100 - percent) / 100)))
    left = materialize(_may_link(docs, once, k, percent, 1.0))
    crowd = company.where("crowded").join(left, "rep").select("rep")
    pairs = _few_pairs(members, ["key"], percent)
    pairs = materialize(pairs.join(left.select(F.col("rep").alias("a")), "a").join(left.select(F.col("rep").alias("b")), "b").select("a", "b"))
    wanted = pairs.select(F.col("a").alias("rep"), F.lit(False).alias("crowded")).union(pairs.select("b", F.lit(False))).union(crowd.select("rep", F.lit(True)))
    texts = materialize(_texts_for(docs, materialize(wanted.groupBy("rep").agg(F.max("crowded").alias("crowded")))))
    discard(members, shared, other, company, once, left)

    crowded = texts.where("crowded").select("rep", "text")
    tokens = _rare_tokens(crowded, k, percent)
    more = _few_pairs(tokens, ["token"], percent)
    clusters = _clusters(tokens)
    found = _few_links(pairs.unionByName(more).distinct(), texts, k, percent)
    links = materialize(found.unionByName(_cluster_links(clusters, tokens, crowded, k, percent)))
    discard(pairs, texts, tokens, clusters)

    components = connected_components(links)
    named = classes.select("h1", "h2", "n", "rep").join(components.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component_id"))
    linked = some.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
