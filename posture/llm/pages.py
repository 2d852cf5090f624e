"""Main text of web pages by nearest-URL page differencing.

1. Each page becomes its list of text lines (blocks) with the part of the page they stand in.
2. Within a host pages are ordered by URL path; equal pages in a row count as one. A page's
   partners are the neighbours before and after, the nearer one (whose path shares more
   leading characters) first; at the end of a host the second stands behind the first.
3. The lines of a page and a partner are aligned by longest common subsequence. Lines that
   the nearest partner shares are the site's frame and are deleted, unshared ones stay. If
   it leaves less than a ``COPY``-th of the page it may be a copy: the other partner decides
   then, and if that one leaves as little, the one which leaves more. Where neither leaves
   anything of a page without an article element, it stays as it is. Lines of an article
   element go if every partner shares them that is not a copy of the article (most of its
   lines and most of its characters shared).
4. Unshared lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
   comments go by their element, role or class.

Only line hashes meet for the alignment, keyed by page; the range partitions of (host, path)
split a host of any size. The html is joined once with the few line numbers found.

Defined results: NULL and empty html give an empty text; pages without host or partner
are judged by step 4 alone; NULL urls count as one host without a name;
repeated rows share their answer; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import os.path
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posture.llm.common import durable, slices, table

FRAME, OPEN, ARTICLE = 0, 1, 2
#: Cells of an alignment that is solved in one piece; larger ones are halved first.
CELLS = 1 << 25
#: A partner that leaves less than one part in so many of a page unshared may be a copy of it.
COPY = 10
#: Attributes of fewer characters are remembered once judged.
REMEMBERED = 500
#: Compression level of pages that are sent to their line numbers.
PACKED = 6

#: Elements by their role on a page.
RAW = ("script", "style")
FRAMES = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select",
          "textarea", "noscript", "template", "svg", "math", "iframe", "object", "canvas",
          "video", "audio"}
ARTICLES = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd",
          "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
          "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
          "tfoot", "thead", "tr", "ul"}
FRAME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb",
               "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disclaimer",
               "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar",
               "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted",
               "related", "replies", "share", "sharing", "sidebar", "skip", "social", "sponsor",
               "sponsored", "subscribe", "toolbar", "widget"}
#: Name the head of an article as well as that of a page.
HEAD_WORDS = {"banner", "header", "masthead"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form",
               "dialog", "alertdialog", "menu", "menubar"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*?"
    r"(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>?|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>=]|=(?!\s*[\"'])|=\s*(?:\"[^\"]*\"|'[^']*'))*)/?>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(
    r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I
)
PARTS = re.compile(r"[^a-z]+")


def _is_frame(rest: str, in_article: bool) -> bool:
    """Whether the attributes name a part of the frame, or hide the element."""
    return (_known if len(rest) < REMEMBERED else _judge)(rest, in_article)


def _judge(rest: str, in_article: bool) -> bool:
    words = FRAME_WORDS - HEAD_WORDS if in_article else FRAME_WORDS
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and words & set(PARTS.split(value)):
            return True
        if name == "role" and value in FRAME_ROLES:
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


_known = cache(_judge)


def blocks(page: str) -> list[tuple[str, int]]:
    """The text lines of a page and the part they stand in."""
    found: list[tuple[str, int]] = []
    gathered: list[str] = []
    stack: list[tuple[str, int]] = []
    part = OPEN

    def close_line() -> None:
        if gathered:
            line = " ".join(entities.unescape("".join(gathered)).split())
            gathered.clear()
            if line:
                found.append((line, part))

    at = 0
    for token in TOKEN.finditer(page):
        begin, end = token.span()
        if begin > at:
            gathered.append(page[at:begin])
        at = end
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            close_line()
            if stack and stack[-1][0] == "p" and not token["end"]:
                part = stack.pop()[1]  # a block ends a paragraph that was left open
        elif name in ("br", "td", "th"):
            gathered.append(" ")
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close_line()
                    part = stack[depth][1]
                    del stack[depth:]
                    break
            continue
        rest = token["rest"]
        if name in VOID or rest.endswith("/"):
            continue
        judged = rest and name not in ("html", "body")
        framed = bool(judged) and _is_frame(rest, part == ARTICLE)
        if name in ARTICLES:
            inner = FRAME if framed else ARTICLE
        elif name in FRAMES or framed or (name == "header" and part != ARTICLE):
            inner = FRAME
        elif name in BLOCKS and name != "p":
            inner = part
        else:
            continue
        if inner != part:
            close_line()
        stack.append((name, part))
        part = inner
    if at < len(page):
        gathered.append(page[at:])
    close_line()
    return found


def _lengths(a: list, masks: dict, width: int) -> np.ndarray:
    """LCS length of ``a`` with every prefix of the other side, by bit-parallel steps."""
    row = (1 << width) - 1
    whole = row
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    raw = np.frombuffer(row.to_bytes(-(-width // 8) or 1, "little"), dtype=np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[:width]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _masks(b: list) -> dict:
    masks: dict = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    return masks


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; memory stays bounded."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    middle, other = a[begin : len(a) - end], b[begin : len(b) - end]
    known = set(other)
    picked = [i for i, x in enumerate(middle) if x in known]
    inner = _align([middle[i] for i in picked], other)
    return [
        *range(begin),
        *(begin + picked[i] for i in inner),
        *range(len(a) - end, len(a)),
    ]


def _align(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > CELLS:
        half = len(a) // 2
        left = _lengths(a[:half], _masks(b), len(b))
        right = _lengths(a[half:][::-1], _masks(b[::-1]), len(b))[::-1]
        cut = int(np.argmax(left + right))
        return _align(a[:half], b[:cut]) + [half + i for i in _align(a[half:], b[cut:])]
    masks, width = _masks(b), len(b)
    whole = row = (1 << width) - 1
    rows = [row]
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
        rows.append(row)
    found, j = [], width
    for i in range(len(a), 0, -1):
        # Drop columns that add nothing, then see whether row i was needed for this length.
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if not j:
            break
        if rows[i - 1] >> (j - 1) & 1:
            now = (rows[i] & ((1 << j) - 1)).bit_count()
            before = (rows[i - 1] & ((1 << j) - 1)).bit_count()
            if now < before:
                found.append(i - 1)
                j -= 1
    return found[::-1]


def main_text(page: str, *shared: Iterable[int]) -> str:
    """The main text, given the lines shared with each partner page, the nearest first."""
    lines = blocks(page)
    partners = [set(places) for places in shared]
    body = [i for i, (_, kind) in enumerate(lines) if kind != FRAME]
    own = [i for i in body if lines[i][1] == ARTICLE]

    def size(places: Iterable[int]) -> int:
        return sum(len(lines[i][0]) for i in places)

    def copies_article(gone: set[int]) -> bool:
        both = [i for i in own if i in gone]
        return 2 * len(both) > len(own) and 2 * size(both) > size(own)

    rests = [size(i for i in body if i not in gone) for gone in partners]
    told = [k for k, rest in enumerate(rests) if COPY * rest >= size(body)]
    best = told[0] if told else max(range(len(rests)), key=rests.__getitem__, default=None)
    frame = set() if best is None or not (rests[best] or own) else partners[best]
    others = [gone for gone in partners if not copies_article(gone)]
    inside = set.intersection(*others) if others else set()
    return "\n\n".join(
        lines[i][0] for i in body if i not in (inside if lines[i][1] == ARTICLE else frame)
    )


def _host(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def row_key(pages: DataFrame) -> Column:
    return F.xxhash64(*(F.col(c).cast("string") for c in ("page_id", "url", "html")))


def line_hashes(pages: DataFrame) -> DataFrame:
    """(key, host, path, lines) of pages with text, with a 64-bit hash per line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "html"):
            lines = [
                np.array(
                    [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _ in blocks(p or "")],
                    dtype=np.uint64,
                ).view(np.int64)
                for p in batch.column("html").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("key", "host", "path")),
                    pa.array(lines, pa.list_(pa.int64())),
                ],
                names=["key", "host", "path", "lines"],
            )

    url = F.col("url").cast("string")
    narrow = pages.select(
        row_key(pages).alias("key"), _host(url).alias("host"), _path(url).alias("path"), "html"
    )
    scanned = narrow.mapInArrow(scan, "key bigint, host string, path string, lines array<bigint>")
    return scanned.filter(F.size("lines") > 0).dropDuplicates(["key"])


def numbered(lines: DataFrame) -> DataFrame:
    """(key, host, path, content, run) by host and path; equal pages in a row share a run.

    Runs count up by one: each range partition counts its own, and takes the last page and
    the number of runs of those before it.
    """
    order = ("host", "path", "content", "key")
    ranged = durable(
        lines.select("key", "host", "path", F.xxhash64("lines").alias("content"))
        .repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
    )
    parts = Window.orderBy("part")
    within = Window.partitionBy("part").orderBy(*order)
    tails = ranged.groupBy("part").agg(F.max(F.struct(*order)).alias("tail"))
    before = tails.select("part", F.lag("tail").over(parts).alias("tail"))
    tail = F.when(
        F.col("tail").isNotNull(), F.struct(F.col("tail")["host"], F.col("tail")["content"])
    )
    page = F.struct("host", "content")
    begun = durable(
        ranged.withColumn("last", F.lag(page).over(within))
        .join(before, "part")
        .select(
            "part", *order,
            (~page.eqNullSafe(F.coalesce("last", tail))).cast("bigint").alias("begins"),
        )
    )
    earlier = begun.groupBy("part").agg(F.sum("begins").alias("n")).select(
        "part",
        F.coalesce(
            F.sum("n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("earlier"),
    )
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        begun.withColumn("inside", F.sum("begins").over(so_far))
        .join(earlier, "part")
        .select(*order, (F.col("earlier") + F.col("inside")).alias("run"))
    )


def partners(runs: DataFrame) -> DataFrame:
    """(key, rank, partner) for the first page of each run: the two nearest different pages.

    They are the neighbours by path within the host, the nearer one first; at the end of a
    host the second one stands behind the first.
    """

    @F.pandas_udf("int")
    def common(a, b):
        pairs = zip(a, b, strict=True)
        return a.__class__([len(os.path.commonprefix(list(p))) for p in pairs], dtype="int32")

    after = runs.select(
        (F.col("run") - 1).alias("run"), F.col("host").alias("next_host"),
        F.col("begin").alias("next_begin"),
        F.col("key").alias("next_key"), F.col("content").alias("next_content"),
    )
    near = durable(
        runs.join(after, "run")
        .filter(F.col("host") == F.col("next_host"))
        .select(
            "run", "key", "content", "next_key", "next_content",
            common("end", "next_begin").alias("near"),
        )
    )
    onward = near.select(
        (F.col("run") - 1).alias("run"), F.col("next_key").alias("far_key"),
        F.col("next_content").alias("far_content"), F.col("near").alias("far_near"),
    )
    # In order of paths, what is two steps away shares no more than either step.
    farther = near.join(onward, "run").filter(F.col("content") != F.col("far_content"))
    links = near.select("key", F.col("next_key").alias("other"), "near", F.lit(1).alias("steps")).union(
        farther.select("key", "far_key", F.least("near", "far_near"), F.lit(2))
    )

    def choice(own: str, other: str, later: int) -> DataFrame:
        # The page before wins where both are as near.
        rank = F.struct(
            (-F.col("near")).alias("far"), "steps", F.lit(later).alias("later"),
            F.col(other).alias("partner"),
        )
        return links.select(F.col(own).alias("key"), rank.alias("c"))

    return (
        choice("key", "other", 1)
        .union(choice("other", "key", 0))
        .groupBy("key")
        .agg(F.slice(F.sort_array(F.collect_list("c")), 1, 2).alias("c"))
        .select("key", F.posexplode("c").alias("rank", "c"))
        .select("key", "rank", F.col("c")["partner"].alias("partner"))
    )


def differences(pages: DataFrame) -> DataFrame:
    """(key, shared): line numbers of a page that each partner shares, by alignment."""
    lines = durable(line_hashes(pages))
    places = durable(numbered(lines))
    runs = durable(
        places.groupBy("run").agg(
            F.min("host").alias("host"), F.min("path").alias("begin"), F.max("path").alias("end"),
            F.min("content").alias("content"), F.min("key").alias("key"),
        )
    )
    theirs = lines.select(F.col("key").alias("partner"), F.col("lines").alias("theirs"))
    mine = lines.select("key", "lines")
    met = partners(runs).join(theirs, "partner").join(mine, "key")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("lines").to_pylist(), batch.column("theirs").to_pylist()
            found = [shared_lines(x, y) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("rank"), pa.array(found, pa.list_(pa.int32()))],
                names=["key", "rank", "shared"],
            )

    aligned = met.select("key", "rank", "lines", "theirs").mapInArrow(
        align, "key bigint, rank int, shared array<int>"
    )
    by_first = aligned.groupBy(F.col("key").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "shared")))["shared"].alias("shared")
    )
    firsts = runs.select("run", F.col("key").alias("first")).join(by_first, "first")
    return places.select("key", "run").join(firsts, "run").select("key", "shared")


def extracted(pages: DataFrame) -> DataFrame:
    """The pages with ``__text`` in place of ``html``, which is compressed on its way."""

    @F.pandas_udf("binary")
    def pack(html):
        import zstandard

        packer = zstandard.ZstdCompressor(level=PACKED)
        return html.map(lambda h: packer.compress((h or "").encode("utf-8", "surrogatepass")))

    @F.pandas_udf("string")
    def extract(packed, shared):
        import zstandard

        texts = []
        for page, lines in zip(packed, shared, strict=True):
            html = zstandard.ZstdDecompressor().decompress(page).decode("utf-8", "surrogatepass")
            texts.append(main_text(html, *(() if lines is None else lines)))
        return shared.__class__(texts, dtype=object)

    shared = durable(differences(pages)).select(
        F.col("key").alias("__key"), F.col("shared").alias("__shared")
    )
    keyed = pages.withColumn("__key", row_key(pages)).withColumn("__packed", pack("html"))
    # The join that a large table takes is taken at any size.
    found = keyed.drop("html").join(shared.hint("merge"), "__key", "left")
    return found.withColumn("__text", extract("__packed", "__shared")).drop(
        "__key", "__packed", "__shared"
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select(
        "page_id", "url", F.col("__text").alias("text"),
        F.length("__text").cast("bigint").alias("n_chars"),
    )
