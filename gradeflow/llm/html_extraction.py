"""HTML extraction: pages are parsed to text blocks, each is paired with its neighbours by URL path within its host, their lines
are aligned by longest common subsequence, and shared lines are deleted.

1. A task parses each page to blocks, with what their markup says of them: the container that holds the article, and parts that
   are none (menus, forms, adverts, comments ...).
2. Only the digests of the blocks go on to be ordered by (host, path): ranges with a number in their order, so a host with a third
   of all pages is many tasks. Neighbours meet by number, and their blocks are aligned.
3. The pages, parsed once more to the blocks that markup leaves in, meet what they share, and the other blocks are their text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import shuffle_partitions, written

# Element names of HTML, and words of class, id and role by which authors name parts of a page.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select option object audio video canvas datalist head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr td th", "table"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th tbody", "table")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_OTHER = frozenset("nav aside footer form button dialog menu search label fieldset legend".split())
_OTHER_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist banner".split())
_OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social sidebar aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar footer footnav comment comments commentlist reply replies respond discussion disqus related recommended recommendations widget widgets masthead skip search".split()
)
_HEADER_NAMES = frozenset("header topbar".split())
_ARTICLE_NAMES = frozenset("articlebody article story entry post content".split())
_WALLS = frozenset("td th caption button article aside form div section li blockquote object".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption td th dd dt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""")
_PLAIN = re.compile(r"<(?P<comment>!--)?(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)?(?P<attrs>[^>]*)>")
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_STATE = re.compile(r"(has|no|with|without|is)[-_]", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Block(NamedTuple):
    text: str
    tag: str  # the block element that it stands in
    holders: tuple[int, ...]  # the open elements that may hold the article
    other: int  # the innermost open element that is no part of an article, 0 if none
    header: int  # the innermost open header


class Page(NamedTuple):
    blocks: list[Block]
    containers: dict[int, int]  # element: its rank among containers, the least is best; 10 more for each open part that is no article


def _names(attrs: str) -> dict[str, frozenset[str]]:
    found: dict[str, frozenset[str]] = {}
    for key, value in _ATTR.findall(attrs):
        named = [x for x in value.strip("\"'").split() if not _STATE.match(x)]
        found[key.lower()] = frozenset(w.lower() for x in named for w in (*_WORD.findall(x), x))
    return found


def parse(html: str) -> Page:
    """The visible blocks of a page in order, white space within a block as one blank.

    Time grows with the length: after a tag whose quotes nothing closes, tags end at the next ``>``.
    """
    blocks: list[Block] = []
    containers: dict[int, int] = {}
    stack: list[tuple[str, int, int, int, bool]] = []  # name; other, number of others and header that were open before; holder or not
    open_names: dict[str, int] = {}
    holders: list[int] = []
    other = others = header = element = 0
    held: list[str] = []
    tag, at, pattern, raw_ends = "", 0, _TAG, {}

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(Block(text, tag, tuple(holders), other, header))

    def pop() -> None:
        nonlocal other, others, header
        name, other, others, header, holds = stack.pop()
        open_names[name] -= 1
        if holds:
            holders.pop()

    def leave(names: frozenset[str] | tuple[str, ...], stop: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of these names, if none of ``stop`` is nearer."""
        if not any(open_names.get(x) for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in stop:
                return
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return

    while True:
        mark = html.find("<", at)
        if mark < 0:
            held.append(unescape(html[at:]))
            break
        held.append(unescape(html[at:mark]))
        found = pattern.match(html, mark)
        if not found:
            following = html[mark + 1 : mark + 3]
            if not re.match(r"[a-zA-Z!?]|/[a-zA-Z]", following):
                held.append("<")
                at = mark + 1
                continue
            if pattern is _TAG:
                pattern = _PLAIN
                found = pattern.match(html, mark)
            if not found:  # a tag that the page's end cuts off
                break
        at = found.end()
        if found["comment"] is not None:
            close = html.find("-->", mark + 4)
            if close < 0:
                break
            at = close + 3
            continue
        if not found["name"]:
            continue
        name, attrs = found["name"].lower(), found["attrs"]
        if found["end"]:
            if name in _BLOCKS:
                flush()
            leave((name,), frozenset() if name in _BLOCKS else _WALLS)
            if name in _BLOCKS:
                tag = next((x[0] for x in reversed(stack[-8:]) if x[0] in _BLOCKS), "")
            continue
        if name in _RAW and not attrs.endswith("/"):
            if name in _BLOCKS:
                flush()
            close = raw_ends.get(name)
            if close is None or 0 <= close < at:
                ending = re.compile(rf"</{name}(?=[\s/>])|<body[\s>]" if name == "head" else rf"</{name}(?=[\s/>])", re.I).search(html, at)
                close = raw_ends[name] = ending.start() if ending else -1
            if close < 0:
                if name in ("head", "option", "object", "noscript", "template", "audio", "video", "canvas"):
                    continue
                break
            at = close
            continue
        if name == "br":
            held.append(" ")
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _BLOCKS:
            flush()
            leave(("p",), _WALLS)
            if name in _CLOSES:
                leave(*_CLOSES[name])
        element += 1
        marks = _names(attrs) if "=" in attrs else {}
        words = marks.get("class", frozenset()) | marks.get("id", frozenset())
        outside = name not in ("html", "body", "main") and bool(name in _OTHER or marks.get("role", frozenset()) & _OTHER_ROLES or words & _OTHER_NAMES)
        kind = None
        if name == "article":
            kind = 0
        elif "articlebody" in marks.get("itemprop", ()):
            kind = 1
        elif name == "main" or "main" in marks.get("role", ()):
            kind = 2
        elif name in ("div", "section") and words & _ARTICLE_NAMES and not words & _HEADER_NAMES:
            kind = 3
        holds = kind is not None and not outside
        stack.append((name, other, others, header, holds))
        open_names[name] = open_names.get(name, 0) + 1
        if holds:
            containers[element] = kind + 10 * others
            holders.append(element)
        if outside:
            other, others = element, others + 1
        elif name == "header" or (words & _HEADER_NAMES and name not in ("html", "body", "main")):
            header = element
        if name in _BLOCKS:
            tag = name
    flush()
    return Page(blocks, containers)


def article(page: Page) -> tuple[list[bool], bool]:
    """Which blocks may be of the article by markup, and whether an element says which part it is.

    Of the elements that hold articles the best kind counts, and of those the one with most text; parts within it that are named
    menus, forms, comments and so on are out, headings of its header in.
    """

    def within(block: Block, holder: int) -> bool:
        if block.other > holder:
            return False
        return block.header <= holder or (holder > 0 and block.tag in _HEADINGS)

    size: dict[int, int] = {}
    for block in page.blocks:
        for holder in block.holders:
            if within(block, holder):
                size[holder] = size.get(holder, 0) + len(block.text)
    best = max((h for h in size), key=lambda h: (-page.containers[h], size[h], -h), default=0)
    return [within(b, best) and (not best or best in b.holders) for b in page.blocks], best > 0


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions of a longest common subsequence in a and in b: equal ends first, then the rest without lines that only one side
    has, by rows of bits, of which every so-many-th is kept and the others are made again on the way back."""
    left, n = [], min(len(a), len(b))
    k = 0
    while k < n and a[k] == b[k]:
        left.append((k, k))
        k += 1
    right = []
    e = 0
    while e < n - k and a[-1 - e] == b[-1 - e]:
        right.append((len(a) - 1 - e, len(b) - 1 - e))
        e += 1
    mid_a, mid_b = range(k, len(a) - e), range(k, len(b) - e)
    both = {a[i] for i in mid_a} & {b[j] for j in mid_b}
    rows, columns = [i for i in mid_a if a[i] in both], [j for j in mid_b if b[j] in both]
    where: dict[int, int] = {}
    for bit, j in enumerate(columns):
        where[b[j]] = where.get(b[j], 0) | 1 << bit
    full = (1 << len(columns)) - 1
    step = max(1, int(len(rows) ** 0.5))
    kept, v = [], full  # a zero bit of v: the length grows at this column

    def down(v: int, i: int) -> int:
        u = v & where[a[rows[i]]]
        return ((v + u) | (v - u)) & full

    for i in range(len(rows)):
        if i % step == 0:
            kept.append(v)
        v = down(v, i)
    middle, j, part, first = [], len(columns) - 1, [], len(rows)
    for i in range(len(rows) - 1, -1, -1):
        if i < first:
            first = i // step * step
            part = [kept[first // step]]
            for r in range(first, min(first + step, len(rows))):
                part.append(down(part[-1], r))
        until = (1 << (j + 1)) - 1
        above, row = ~part[i - first] & until, ~part[i - first + 1] & until
        if row.bit_count() > above.bit_count():  # line i adds one up to column j; at the last column where its row grows
            j = row.bit_length() - 1
            middle.append((rows[i], columns[j]))
            j -= 1
    pairs = left + middle[::-1] + right[::-1]
    return [x for x, _ in pairs], [y for _, y in pairs]


def _key_columns() -> list[Column]:
    """Host, path and the page's digest: equal rows of a table are one page."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    html = F.coalesce(F.col("html"), F.lit(""))
    return [host.alias("host"), path.alias("path"), F.unhex(F.sha2(F.concat(F.octet_length(url).cast("string"), F.lit(":"), url, html).cast("binary"), 256)).alias("key")]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's block digests, and their characters as far as markup leaves them in."""
    for batch in batches:
        lines, sizes = [], []
        for html in batch.column("html").to_pylist():
            page = parse(html or "")
            lines.append([xxhash.xxh3_64_intdigest(b.text) - (1 << 63) for b in page.blocks])
            sizes.append([len(b.text) if k else 0 for b, k in zip(page.blocks, article(page)[0], strict=True)])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "path", "key", "url")), pa.array(lines, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], names=["host", "path", "key", "url", "lines", "sizes"])


def _aligned(copies: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, shared): the positions of the lines that the pages of a pair share, a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shared = [], []
            for ka, kb, a, b, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("key", "key_b", "lines", "lines_b", "sizes", "sizes_b")), strict=True):
                xs, ys = common_lines(a, b)
                if sum(sa[x] for x in xs) >= copies * max(sum(sa), 1) or sum(sb[y] for y in ys) >= copies * max(sum(sb), 1):
                    continue
                keys += [ka, kb]
                shared += [xs, ys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shared, pa.list_(pa.int32()))], names=["key", "shared"])

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's blocks that markup leaves in, with their places, and which of them a neighbour may take away."""
    for batch in batches:
        places, texts, loose, marks = [], [], [], []
        for html in batch.column("html").to_pylist():
            page = parse(html or "")
            inside, marked = article(page)
            own = [i for i, k in enumerate(inside) if k]
            places.append(own)
            texts.append([page.blocks[i].text for i in own])
            loose.append([not marked or page.blocks[i].tag not in _FLOW for i in own])
            marks.append(marked)
        kinds = pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.bool_()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "page_id", "url")), *map(pa.array, (places, texts, loose, marks), kinds)], names=["key", "page_id", "url", "places", "texts", "loose", "marked"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for places, own, loose, gone in zip(*(batch.column(c).to_pylist() for c in ("places", "texts", "loose", "gone")), strict=True):
            shared = set(gone or ())
            texts.append("\n\n".join(t for i, t, k in zip(places, own, loose, strict=True) if not (k and i in shared)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def shared_lines(pages: DataFrame, copies: float = 0.5) -> DataFrame:
    """(key, either, twice): of pages (host, path, key, url, html) the positions of blocks that one of the two neighbours by path
    has as well, and of those that both have. Pairs that share ``copies`` of either one's article are copies and don't count."""
    spark = pages.sparkSession
    order = ["host", "path", "url", "key"]
    lines = written(pages.where("host <> ''").mapInArrow(_lines, "host string, path string, key binary, url string, lines array<long>, sizes array<int>"))
    ranged = lines.repartitionByRange(shuffle_partitions(spark), *order).dropDuplicates(order).sortWithinPartitions(*order)  # equal rows are in one range
    ranged = written(ranged.select("host", "key", "lines", "sizes", F.monotonically_increasing_id().alias("id")))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # a number for each range
    before = spark.createDataFrame(list(zip([p for p, _ in counts], accumulate([0, *(n for _, n in counts)]), strict=False)), "part long, before long")
    numbered = ranged.withColumn("part", part).join(F.broadcast(before), "part").select("host", "key", "lines", "sizes", (place + F.col("before")).alias("number"))
    after = numbered.select("host", (F.col("number") - 1).alias("number"), *(F.col(c).alias(f"{c}_b") for c in ("key", "lines", "sizes")))
    pairs = numbered.join(after, ["number", "host"]).select("key", "key_b", "lines", "lines_b", "sizes", "sizes_b")
    found = pairs.mapInArrow(_aligned(copies), "key binary, shared array<int>").where(F.size("shared") > 0)
    both = F.collect_list("shared").alias("both")  # two lists at most
    return found.groupBy("key").agg(both).select("key", F.array_distinct(F.flatten("both")).alias("either"), F.when(F.size("both") > 1, F.array_intersect(F.get("both", F.lit(0)), F.get("both", F.lit(1)))).alias("twice"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", copies: float = 0.5) -> DataFrame:
    """The main text of each page: (page_id, url, text, n_chars).

    A text is the page's blocks in order, joined by two line ends; white space within a block is one blank and character references
    are decoded. Out go elements that markup names as no part of the article, all outside the element that holds it where there is
    one, and lines that neighbours by URL share: without such an element, lines shared with one of them; within it, lines that are
    no running text and that both share. Copies of one article are no template for each other.

    A null html has an empty text, a page without host (or url) has no neighbours, repeated rows are one page for pairing and each
    have their result, an empty table gives no rows; other columns are not read. Pages are compared as wholes at any length.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    keyed = rows.select(*_key_columns(), "page_id", "url", "html")
    shared = shared_lines(keyed.select("host", "path", "key", F.coalesce("url", F.lit("")).alias("url"), "html"), copies)
    schema = StructType([StructField("key", BinaryType()), rows.schema["page_id"], *StructType.fromDDL("url string, places array<int>, texts array<string>, loose array<boolean>, marked boolean")])
    blocks = keyed.select("key", "page_id", "url", "html").mapInArrow(_candidates, schema).join(shared, "key", "left")
    gone = F.when(F.col("marked"), F.col("twice")).otherwise(F.col("either"))
    out = StructType([rows.schema["page_id"], *StructType.fromDDL("url string, text string")])
    return blocks.select("page_id", "url", "places", "texts", "loose", gone.alias("gone")).mapInArrow(_texts, out).withColumn("n_chars", F.length("text").cast("long"))
