"""HTML extraction (12): a page's main text, by its structure and by what pages at the nearest URLs share with it.

1. Markup is cut into blocks of text, each with its place in the page: within an article, within the main part, elsewhere
   (open), or within what is never main text: menus, headers and footers of the page, sidebars, notices, adverts, forms,
   scripts, styles, reader comments.  Tags, roles and class names say so.
2. Pages are paired by URL path within each host: paths (without a closing slash or .html) are put in order, and a page
   meets the first page of the path before its own, of the path behind it, and of its own path.  Only hashes of lines are
   shuffled for that.  A host with a third of all pages is cut like any other: the order is dealt by ranges of (host,
   path), and the rows at their borders are joined by themselves.
3. The lines of a pair are aligned by their longest common subsequence.  Lines of a page that such a neighbour has too are
   the site's, not the page's, and are deleted.  A pair that has all lines of a page in common is two copies and deletes
   nothing.  Lines within an article or main part are never deleted so: there, neighbours share a line where articles
   quote or copy each other, and their text is wanted whole.
4. What is left is the text: of the articles, if the page has one; else of the main part, if there is one; else of the open
   blocks.  Character references are decoded, white space becomes one space, blocks are joined by newlines.

Null and empty html has no text.  A page without a host meets none.  Repeated rows come out as often as they occur, and
rows with one page_id but other contents are pages of their own.  Ties (pages of one path) go to the least page_id, then
hash.  Very long pages are worked on alone; the alignment takes linear memory beyond a set size.  Other columns are not
looked at, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenclip.llm.common import discard, materialize, may_be_among, small_batches

#: Where a block stands.
ARTICLE, MAIN, OPEN, NEVER = range(4)

# Names of tags, roles and parts of class names.
_BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split())
_SPACE_TAGS = set("br td th option wbr".split())
_VOID_TAGS = set("area base br col embed hr img input link meta source track wbr".split())
_RAW_TAGS = set("script style textarea title noscript template iframe svg select canvas object".split())
_NEVER_TAGS = set("nav footer aside form button dialog menu head".split())
_NEVER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_NEVER_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond disqus share sharing social related recommended pagination pager widget toolbar copyright disclaimer".split()
)
_SAME_CLOSES = set("li dd dt tr option".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _place(tag: str, attributes: str, around: int) -> int:
    """Where a tag's contents stand, given where the tag does."""
    if around == NEVER or tag in _NEVER_TAGS or (tag == "header" and around > MAIN):
        return NEVER
    role = names = ""
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return NEVER
            if name == "role":
                role = value
            elif name in ("class", "id"):
                names += " " + value
    if role in _NEVER_ROLES or (tag not in ("body", "html", "main") and names and not _NEVER_NAMES.isdisjoint(re.split(r"[^a-z]+", names))):
        return NEVER
    if tag == "article" or role == "article":
        return ARTICLE
    return min(around, MAIN) if tag == "main" or role == "main" else around


def blocks(html: str) -> tuple[list[str], list[int], int]:
    """The blocks of a page, the place of each, and the innermost place that the page has (ARTICLE, MAIN or OPEN)."""
    lines, places, best = [], [], OPEN
    stack: list[tuple[str, int]] = [("", OPEN)]
    text: list[str] = []

    def end_block() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            lines.append(line)
            places.append(stack[-1][1])

    at = 0
    while m := _TAG.search(html, at):
        if m.start() > at:
            text.append(unescape(html[at : m.start()]))
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in _BLOCK_TAGS:
                end_block()
            elif tag in _SPACE_TAGS:
                text.append(" ")
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                if tag not in _BLOCK_TAGS and stack[-1][1] != stack[depth - 1][1]:
                    end_block()
                del stack[depth:]
            continue
        if tag in _RAW_TAGS:
            if tag == "title":
                end_block()
            close = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            at = close.end() if close else len(html)
            continue
        if tag in _BLOCK_TAGS:
            end_block()
            if stack[-1][0] == "p" or (tag in _SAME_CLOSES and stack[-1][0] == tag):
                stack.pop()
        elif tag in _SPACE_TAGS:
            text.append(" ")
        if tag in _VOID_TAGS or m[3].endswith("/"):
            continue
        around = stack[-1][1]
        place = _place(tag, m[3], around)
        if tag in _BLOCK_TAGS or place != around:
            if place != around:
                end_block()
                best = min(best, place)
            stack.append((tag, place))
    text.append(unescape(html[at:]))
    end_block()
    return lines, places, best


#: Bits of the table that an alignment keeps; a larger one is halved first.
TABLE_BITS = 1 << 28


def _rows(a: list, b: list) -> Iterator[int]:
    """For each prefix of ``a`` a number whose bit j is 0 where b[: j + 1] has a longer common subsequence with it than
    b[:j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with all prefixes of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)], [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    shared = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    x, y = ([i for i in range(head, len(s) - tail) if s[i] in shared] for s in (a, b))
    return ends[0] + [(x[i], y[j]) for i, j in _aligned([a[i] for i in x], [b[j] for j in y])] + ends[1]


def _aligned(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in common(a[half:], b[cut:])]
    table, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not table[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def shared_lines(lines: list[int], others: list[list[int]]) -> list[int]:
    """Places of the lines that another page has too; a page that has all of them is a copy and says nothing."""
    found: set[int] = set()
    for other in others:
        at = [i for i, _ in common(lines, other)]
        if len(at) < len(lines):
            found.update(at)
    return sorted(found)


def _number(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, r"(?:/|\.html?)+$", "")


def outlines(pages: DataFrame) -> DataFrame:
    """key, page_id, host, path, lines (a hash of each) of the pages that have a host."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [[_number(x) for x in blocks(h)[0]] for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "page_id", "host", "path")] + [pa.array(lines, pa.list_(pa.int64()))], names=["key", "page_id", "host", "path", "lines"])

    named = pages.select("key", "page_id", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    return named.where("host <> ''").mapInArrow(outline, "key long, page_id long, host string, path string, lines array<long>")


def nearest(outlined: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """host, path, others: the first page (key, lines) of the path itself, the one before and the one behind; and what was
    written for it."""
    first = outlined.groupBy("host", "path").agg(F.min(F.struct("page_id", "key", "lines")).alias("f"))
    first = first.select("host", "path", F.struct("host", F.col("f.key").alias("key"), F.col("f.lines").alias("lines")).alias("page"))
    dealt = materialize(first.repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("host", "path")
    sides = dealt.withColumns({"before": F.lag("page").over(own), "behind": F.lead("page").over(own)})
    # The border rows of each range: as many as there are partitions, so one window puts them in order.
    ends = dealt.groupBy("part").agg(F.min_by("page", F.struct("host", "path")).alias("least"), F.max_by("page", F.struct("host", "path")).alias("most"))
    order = Window.orderBy("part")
    ends = ends.select("part", F.lag("most").over(order).alias("over_before"), F.lead("least").over(order).alias("over_behind"))
    sides = sides.join(ends, "part").select("host", "path", "page", F.coalesce("before", "over_before").alias("before"), F.coalesce("behind", "over_behind").alias("behind"))
    same = lambda c: F.when(F.col(f"{c}.host") == F.col("host"), F.col(c))
    return sides.select("host", "path", F.filter(F.array("page", same("before"), same("behind")), lambda p: p.isNotNull()).alias("others")), [dealt]


def deletions(pages: DataFrame) -> DataFrame:
    """key, gone: places of the lines that a page shares with a neighbour; pages without any are left out."""
    outlined = materialize(outlines(pages))
    others, written = nearest(outlined)
    pairs = outlined.join(others, ["host", "path"]).select("key", "lines", F.transform(F.filter("others", lambda p: p["key"] != F.col("key")), lambda p: p["lines"]).alias("others"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [shared_lines(a, b) for a, b in zip(batch.column("lines").to_pylist(), batch.column("others").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])
            yield out.filter(pa.array([bool(g) for g in gone]))

    found = materialize(pairs.where(F.size("others") > 0).mapInArrow(align, "key long, gone array<int>").dropDuplicates(["key"]))
    discard(outlined, *written)
    return found


def main_text(html: str, gone: list[int]) -> tuple[str, int]:
    """A page's main text, and how many lines outside of it neighbours share."""
    lines, places, best = blocks(html)
    shared = set(gone)
    kept = [x for i, (x, p) in enumerate(zip(lines, places, strict=True)) if p == best and (best < OPEN or i not in shared)]
    return "\n".join(kept), sum(places[i] >= OPEN for i in shared)


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines outside of article and main part that a neighbour has too)."""
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    found = deletions(keyed)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h or "", g or []) for h, g in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_shared"],
            )

    some, none = may_be_among(keyed, F.col("key"), found.select("key"))
    both = some.join(found, "key", "left").unionByName(none.withColumn("gone", F.lit(None).cast("array<int>")))
    return both.select("page_id", "url", "html", "gone").mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_shared long")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return html_extraction(spark.read.parquet(f"{sf_dir}/pages.parquet"))
