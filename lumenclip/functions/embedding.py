"""A hashing embedder for texts: signed feature hashing of words into a fixed number of buckets.

Words are runs of letters and digits, lower-cased.  A word's md5 gives its bucket and its sign; a text's vector has the
sums of its words' signs, scaled to length 1.  Texts and queries get their vectors from the same sums, so they compare.
Words become numbers in the JVM; a row's numbers are summed where the row is.  Null and empty texts, and those without a word, have no length: their vector is all zeros, their similarity 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenclip.functions.scratch import written

BUCKETS = 256
#: Texts whose sums are worked on at a time.
AT_ONCE = 1000
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bucket_codes(text: Column, buckets: int = BUCKETS) -> Column:
    """An array with a number for each word: its bucket, from 1, with the word's sign."""
    code = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 12), 16, 10).cast("long"))
    sign = lambda c: F.lit(1) - F.lit(2) * F.pmod(F.floor(c / buckets), F.lit(2))
    signed = F.transform(code, lambda c: (sign(c) * (F.pmod(c, F.lit(buckets)) + 1)).cast("int"))
    return F.coalesce(signed, F.array().cast("array<int>"))


def bucket_sums(codes: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Rows ``[a, b)`` and the sums of their words, a column for each bucket; some rows at a time."""
    offsets = codes.offsets.to_numpy()
    code = codes.flatten().to_numpy()
    for a in range(0, len(codes), AT_ONCE):
        b = min(a + AT_ONCE, len(codes))
        some = code[offsets[a] - offsets[0] : offsets[b] - offsets[0]]
        of = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])) * buckets + np.abs(some) - 1
        yield a, b, np.bincount(of, np.sign(some), (b - a) * buckets).reshape(b - a, buckets)


def embed_texts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, embedding of texts (id, text), row by row: nothing is shuffled or gathered, whatever the number of texts."""
    rows = texts.select("id", bucket_codes(F.col("text"), buckets).alias("codes"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sums in bucket_sums(batch.column("codes"), buckets):
                length = np.sqrt((sums * sums).sum(1))
                flat = (sums / np.where(length > 0, length, 1)[:, None]).ravel()
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * buckets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), vectors], names=["id", "embedding"])

    return rows.mapInArrow(embed, f"id {dict(rows.dtypes)['id']}, embedding array<double>")


def text_similarity(texts: DataFrame, query: str, buckets: int = BUCKETS) -> DataFrame:
    """id, score: the cosine of each text to a query's text, row by row; the query's sums go with the function."""
    spark = texts.sparkSession
    if not query.strip():
        raise ValueError("a query needs a text")
    asked = spark.createDataFrame([(query,)], "text string").select(bucket_codes(F.col("text"), buckets)).first()[0]
    q = np.bincount(np.abs(np.array(asked, int)) - 1, np.sign(asked), buckets) if asked else np.zeros(buckets)
    rows = texts.select("id", bucket_codes(F.col("text"), buckets).alias("codes"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sums in bucket_sums(batch.column("codes"), buckets):
                norm = np.sqrt((sums * sums).sum(1)) * np.sqrt(q @ q)
                score = np.where(norm > 0, sums @ q / np.where(norm > 0, norm, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(score)], names=["id", "score"])

    return rows.mapInArrow(compare, f"id {dict(rows.dtypes)['id']}, score double")


def with_vectors(clips: DataFrame, vectors: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, embedding, precomputed of ``clips`` (id, filename, text): the vector that ``vectors`` (name, embedding) has for the
    file's base name, and for the other clips, only, what the embedder makes of the text.

    Of vectors with one name the first in order counts; vectors of null are none.  Names are compared without folders.
    Names and ids meet first, so texts move once, to those that lack a vector, and pass by a table of ids: none is sorted.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    known = vectors.where("embedding IS NOT NULL").groupBy(base(F.col("name")).alias("_base")).agg(F.min("embedding").alias("_vector"))
    marked = written(clips.select("id", base(F.col("filename")).alias("_base")).join(known, "_base", "left").select("id", "_vector"))
    misses = clips.select("id", "text").join(marked.where("_vector IS NULL").select("id").hint("shuffle_hash"), "id", "left_semi")
    have = marked.where("_vector IS NOT NULL").select("id", F.col("_vector").cast("array<double>").alias("embedding"), F.lit(True).alias("precomputed"))
    return have.unionByName(embed_texts(misses, buckets).withColumn("precomputed", F.lit(False)))
