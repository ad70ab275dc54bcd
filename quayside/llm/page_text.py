"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in order of their URL path.  Every page is compared
with the nearest pages of other content, up to ``SIDE`` on either side: both
are cut into text lines (one for each block), the lines are aligned by longest
common subsequence, and lines that both share are the site's own (menus,
notices, footers).  A line that at least half of the neighbours share is deleted.

Two things differencing cannot tell are settled by the page's structure
afterwards: a line inside the page's article stays although neighbours share it
(a licence line, a quotation, an article published twice), and a line inside a
menu, header, footer, sidebar, notice, advert, form or reader comment goes
although no neighbour shares it (comments and adverts differ from page to page).

Alignment needs hashes of lines only, so no page text moves for it.  Pages of
one host with the same lines count once; the others, in their order, are cut
into blocks of ``BLOCK`` pages, to which the ``SIDE`` pages before and after are
copied.  A host with a third of all pages is thus spread over many tasks, and
the result does not depend on how pages are dealt to tasks.

Defined results: null and empty pages have an empty text; pages cut off in the
middle are read as far as they go; a page without a neighbour loses no line by
differencing; two pages alone on a host that share over ``COPIES`` of their
characters count as copies and delete nothing; repeated rows give the same text
each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import stored
from quayside.llm.url_filter import host_of, path_of

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements whose content is no text of the page.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|noframes|xmp"
DROPPED = frozenset("nav header footer aside form button select option datalist fieldset dialog menu head label input audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th img".split())
#: Words of class, id and role that name a part which is not the article.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager sidebar aside widget widgets rail "
    "header masthead topbar footer footnav bottombar colophon copyright "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast "
    "comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations teaser teasers newsletter subscribe subscription signup login search searchbox "
    "form contentinfo complementary".split()
)
WHOLE = frozenset("html body main article".split())
#: With one of these beside it, "header" names a part of the article.
ARTICLE_WORDS = frozenset("article post entry story".split())
ARTICLE_NAMES = frozenset({"articlebody", "article-body", "article-content", "article-text", "post-content", "post-body", "entry-content", "entry-body", "story-body", "main-content", "main-text", "maincontent", "content", "article", "post", "entry", "story"})
#: Pages compared on either side, and pages of one block of the order.
SIDE, BLOCK = 2, 256
#: Share of characters in common over which a page's only neighbour counts as its copy.
COPIES = 0.8
#: Most bits that an alignment keeps at once; larger ones are halved first.
TABLE_BITS = 1 << 26
#: What a new element of a kind closes, unless one of the latter stands in between.
P_ENDS = (("p",), ("div", "article", "section", "main", "td", "th", "li", "aside", "nav", "body", "blockquote", "form", "header", "footer", "button"))
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*?(?:(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)|/>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s|/)(?:[^>\"']|\"[^\"]*\"|'[^']*')*)?(?P<end>>|\Z)"
    r"|</[^a-zA-Z][^>]*(?:>|\Z)|<[a-zA-Z/][^<>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_WHITE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Line:
    text: str
    #: "in" the article, "out" of it for sure, or "open" to differencing.
    place: str


def part_of(tag: str, attrs: str | None) -> str:
    """What an element is: "out" (no article), "in" (an article), "main" (its likely surroundings) or ""."""
    if tag in DROPPED:
        return "out"
    out = "in" if tag == "article" else "main" if tag == "main" else ""
    if attrs and "=" in attrs:
        for m in _ATTR.finditer(attrs):
            value = m[2] or m[3] or m[4] or ""
            for name in value.split():
                flat = _CAMEL.sub("-", name).lower()
                words = {w for w in _SPLIT.split(flat) if w}
                named = words & PARTS
                if tag in WHOLE:  # their class names often tell of other parts: "has-sidebar", "comments-open"
                    named = named if flat in PARTS and tag not in ("html", "body") else set()
                if named and not flat.startswith(("has-", "with-", "no-", "is-")) and not (named == {"header"} and words & ARTICLE_WORDS):
                    return "out"
                if flat in ("main", "maincontent", "main-content") and not out:
                    out = "main"
                elif flat in ARTICLE_NAMES and not out and tag in ("div", "section", "td"):
                    out = "main"
    return out


def lines_of(page: str | None) -> list[Line]:
    """The text blocks of a page, in order, with their places."""
    out: list[tuple[str, bool, bool, bool]] = []
    stack: list[tuple[str, str]] = []
    at_of: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of each open tag
    depth = {"out": 0, "in": 0, "main": 0}
    pieces: list[str] = []
    seen_in = seen_main = False

    def flush() -> None:
        if pieces:
            text = _WHITE.sub(" ", htmllib.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                out.append((text, depth["out"] > 0, depth["in"] > 0, depth["main"] > 0))

    def pop_to(n: int) -> None:
        while len(stack) > n:
            name, part = stack.pop()
            at_of[name].pop()
            if part:
                depth[part] -= 1

    def last(tags: tuple[str, ...]) -> int:
        return max((at_of[t][-1] for t in tags if at_of[t]), default=-1)

    def close(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        n = last(tags)
        if n >= 0 and n > last(stops):
            pop_to(n)

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if not m["end"] and at == len(page):  # cut off inside the tag
            continue
        block = tag in BLOCKS
        if block:
            flush()
        elif tag in SPACED:
            pieces.append(" ")
        if m["close"]:
            if n_open := at_of[tag]:
                if not block and any(part for _, part in stack[n_open[-1] :]):
                    flush()
                pop_to(n_open[-1])
            continue
        if tag in VOID:
            continue
        if block and tag not in ("html", "body"):
            close(*P_ENDS)
        if tag in CLOSES:
            close(*CLOSES[tag])
        part = part_of(tag, m["attrs"])
        if part and not block:
            flush()
        if part:
            depth[part] += 1
            seen_in |= part == "in" and not depth["out"]
            seen_main |= part == "main" and not depth["out"]
        if not (m["attrs"] or "").rstrip().endswith("/") or block:
            at_of[tag].append(len(stack))
            stack.append((tag, part))
        elif part:
            depth[part] -= 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    if seen_in:
        return [Line(t, "in" if inside and not gone else "out") for t, gone, inside, _ in out]
    if seen_main:
        return [Line(t, "out" if gone or not main else "open") for t, gone, _, main in out]
    return [Line(t, "out" if gone else "open") for t, gone, _, _ in out]


def _rows(x: list, y: list) -> list[int]:
    """Bit j of row i is 0 where one more line of ``y`` lengthens the longest common subsequence with x[:i]."""
    masks: defaultdict = defaultdict(int)
    for j, line in enumerate(y):
        masks[line] |= 1 << j
    every = (1 << len(y)) - 1
    rows = [every]
    for line in x:
        v = rows[-1]
        met = v & masks.get(line, 0)
        rows.append(((v + met) | (v - met)) & every)
    return rows


def _lengths(x: list, y: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with every prefix of ``y``."""
    masks: defaultdict = defaultdict(int)
    for j, line in enumerate(y):
        masks[line] |= 1 << j
    every = v = (1 << len(y)) - 1
    for line in x:
        met = v & masks.get(line, 0)
        v = ((v + met) | (v - met)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(x: list, y: list, first: int) -> Iterator[int]:
    """Places (from ``first``) of ``x`` in a longest common subsequence with ``y``; large pairs are halved, which needs rows of one pass only."""
    if not x or not y:
        return
    if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
        yield from _aligned(x[:half], y[:cut], first)
        yield from _aligned(x[half:], y[cut:], first + half)
        return
    rows, r, c = _rows(x, y), len(x), len(y)
    while r and c:
        if rows[r] >> (c - 1) & 1:
            c -= 1
        elif rows[r - 1] >> (c - 1) & 1:
            r, c = r - 1, c - 1
            yield first + r
        else:
            r -= 1


def shared_lines(a: list, b: list) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``."""
    first = 0
    while first < len(a) and first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(a) - first and last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ends = set(range(first)) | set(range(len(a) - last, len(a)))
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    common = set(x) & set(y)
    at = [i for i, line in enumerate(x) if line in common]
    ends.update(first + at[k] for k in _aligned([x[i] for i in at], [line for line in y if line in common], 0))
    return ends


def site_lines(own: list, sizes: list[int], neighbours: list[list]) -> list[int]:
    """Places of the lines that at least half of the neighbours share."""
    votes = [0] * len(own)
    for other in neighbours:
        shared = shared_lines(own, other)
        if len(neighbours) == 1 and sum(sizes[i] for i in shared) > COPIES * sum(sizes):
            return []
        for i in shared:
            votes[i] += 1
    return [i for i, v in enumerate(votes) if v and 2 * v >= len(neighbours)]


def main_text(lines: list[Line], shared: list[int] | tuple[int, ...] = ()) -> str:
    """The lines left by differencing, without surroundings and with the article's own, joined by empty lines."""
    gone = set(shared)
    return "\n\n".join(line.text for i, line in enumerate(lines) if line.place == "in" or line.place == "open" and i not in gone)


def line_codes(lines: list[Line]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(line.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for line in lines]


def digest_of(codes: list[int]) -> bytes:
    """Names a page's content: equal for equal lists of lines."""
    return hashlib.md5(np.array(codes, dtype="<i8").tobytes(), usedforsecurity=False).digest()


def _contents(pages: DataFrame) -> DataFrame:
    """(host, digest, path, codes, sizes): each content of a host once, at its first path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(h.as_py()) for h in batch.column(2)]
            codes = [line_codes(f) for f in found]
            sizes = [[len(x.text) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(digest_of, codes), pa.binary()), pa.array(codes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
                names=["host", "path", "digest", "codes", "sizes"],
            )

    lists = pages.where(F.col("host") != "").select("host", "path", "html").mapInArrow(run, "host string, path string, digest binary, codes array<bigint>, sizes array<int>")
    return lists.groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("codes").alias("codes"), F.first("sizes").alias("sizes"))


def site_lines_of_pages(pages: DataFrame) -> DataFrame:
    """(host, digest, shared) of every content that shares lines with its neighbours; pages: host, path, html."""
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = stored(_contents(pages), "page-contents")
    # Written in order: the place of a row is then its file part's number and its place in it.
    listed = once.repartitionByRange(parts, "host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    listed = stored(listed.withColumn("at", F.monotonically_increasing_id()), "page-order")
    part = F.shiftrightunsigned("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = listed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each part
    ranked = listed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    around = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-SIDE, 0, SIDE)]), lambda d: F.floor((F.col("rank") + d) / BLOCK)))
    blocks = ranked.select("host", "digest", "codes", "sizes", "rank", F.explode(around).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of the block at hand, in order

        def told() -> Iterator[pa.RecordBatch]:
            out = []
            for k, (host, digest, codes, sizes, rank, block) in enumerate(held):
                if rank // BLOCK != block:
                    continue
                near = held[max(0, k - SIDE) : k] + held[k + 1 : k + 1 + SIDE]
                shared = site_lines(codes, sizes, [r[2] for r in near if r[0] == host])
                if shared:
                    out.append((host, digest, shared))
            held.clear()
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int32()))], names=["host", "digest", "shared"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held and held[-1][5] != row[5]:
                    yield from told()
                held.append(row)
        yield from told()

    return stored(blocks.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(run, "host string, digest binary, shared array<int>"), "page-shared")


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_lines, n_shared) of every page: its main text, its lines and how many of them differencing found shared."""
    id_type = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    shared = site_lines_of_pages(rows)
    line = pa.struct([("text", pa.string()), ("place", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines_of(h.as_py()) for h in batch.column(3)]
            lines = pa.array([[{"text": x.text, "place": x.place} for x in f] for f in found], pa.list_(line))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([digest_of(line_codes(f)) for f in found], pa.binary()), lines], names=["page_id", "url", "host", "digest", "lines"])

    lines = rows.select("page_id", "url", "host", "html").mapInArrow(cut, f"page_id {id_type}, url string, host string, digest binary, lines array<struct<text:string,place:string>>")
    out = lines.join(shared, ["host", "digest"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    stays = lambda x, i: (x["place"] == "in") | ((x["place"] == "open") & ~F.array_contains("shared", i))
    text = F.array_join(F.transform(F.filter("lines", stays), lambda x: x["text"]), "\n\n")
    return out.select("page_id", "url", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("shared").cast("long").alias("n_shared"))
