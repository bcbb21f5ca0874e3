"""Main text of web pages, by structure and by differencing with the page of the nearest URL."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle
from .url_filter import host_of, path_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>
    |<(?P<raw>script|style|noscript|template|textarea|iframe|svg|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>
    |<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>
    |(?P<text>[^<]+|<)""",
    re.I | re.S | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")

# Element names, and words of class, id and role that mark what isn't main text.
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search
    section select summary table tbody td tfoot th thead title tr ul
    """.split()
)
OUTSIDE = frozenset("aside button dialog footer form head menu nav search select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    """
    ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
    promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget
    complementary contentinfo search alert
    """.split()
)
WHOLE = frozenset("html body main article".split())


REST, CORE, PLAIN = 0, 1, 2

# Which open elements a start tag ends by itself, and the elements beyond which it ends none.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("caption thead tbody tfoot tr td th", "table"), "tbody": ("caption thead tbody tfoot tr td th", "table"), "tfoot": ("caption thead tbody tfoot tr td th", "table"),
}
CLOSES = {tag: (frozenset(ended.split()), frozenset(within.split())) for tag, (ended, within) in CLOSES.items()}
#: An open paragraph ends where another block begins, but not beyond one of these.
AROUND_P = frozenset("button caption table td th".split())


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of every block: CORE within an article or main element, REST in menus, forms, adverts and the like, else PLAIN.

    One pass over the tags with a stack of open elements. End tags that HTML lets authors leave out are supplied; an
    end tag ends what was opened within its element, and is ignored without one. An element that OUTSIDE or MARKS names
    is REST, and so is a header outside an article. Scripts, styles and the head have no text. White space becomes one
    space; a block ends where a block element begins or ends.
    """
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # element, and its zone or PLAIN
    core = rest = head = 0

    def flush() -> None:
        if parts:
            if not head and (text := " ".join(html.unescape("".join(parts)).split())):
                out.append((text, REST if rest else CORE if core else PLAIN))
            parts.clear()

    def end(at: int) -> None:
        nonlocal core, rest, head
        flush()
        for tag, zone in stack[at:]:
            core -= zone == CORE
            rest -= zone == REST
            head -= tag == "head"
        del stack[at:]

    def find(ended: frozenset[str], within: frozenset[str]) -> int:
        """Where on the stack the outermost element of ``ended`` is, looked for up to one of ``within``; else its height."""
        found = len(stack)
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in ended:
                found = at
            elif stack[at][0] in within:
                break
        return found

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            parts.append(text)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if m["close"] or m["close2"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    end(at) if block or stack[at][1] != PLAIN else stack.pop(at)
                    break
                if not block and stack[at][0] in BLOCKS:
                    break  # an inline element ends within its block
            continue
        if tag in CLOSES:
            if (at := find(*CLOSES[tag])) < len(stack):
                end(at)
        elif block and tag != "option" and (at := find(_P, AROUND_P)) < len(stack):
            end(at)
        if tag == "body" and head:
            end(find(_HEAD, frozenset()))
        attributes = m["rest"] or m["rest2"] or ""
        if attributes.endswith("/") and not block:
            continue
        zone = PLAIN
        if tag in OUTSIDE or tag == "header" and not core or attributes and tag not in WHOLE and _marked(attributes, core):
            zone = REST
            flush()
        elif tag in ("article", "main"):
            zone = CORE
        stack.append((tag, zone))
        core += zone == CORE
        rest += zone == REST
        head += tag == "head"
    flush()
    return out


_P, _HEAD = frozenset(["p"]), frozenset(["head"])


def _marked(attributes: str, inside: int) -> bool:
    for name, value in _ATTR.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower():
            return True
        if name != "aria-hidden" and not MARKS.isdisjoint(_WORD.findall(value.lower())):
            return True
    return False


def shared_lines(mine: list[int], other: list[int]) -> list[tuple[int, int]]:
    """(place in ``mine``, place in ``other``) of a longest common subsequence, by Hunt and Szymanski.

    What both begin or end with is always part of one; only what lies between is searched.
    """
    first, last = 0, 0
    while first < min(len(mine), len(other)) and mine[first] == other[first]:
        first += 1
    while last < min(len(mine), len(other)) - first and mine[-1 - last] == other[-1 - last]:
        last += 1
    places: dict[int, list[int]] = {}
    for j in range(len(other) - last - 1, first - 1, -1):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(first, len(mine) - last):
        for j in places.get(mine[i], ()):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    between, link = [], links[-1] if links else None
    while link:
        between.append(link[:2])
        link = link[2]
    return [(i, i) for i in range(first)] + between[::-1] + [(len(mine) - k, len(other) - k) for k in range(last, 0, -1)]


def deletions(article: bool, mine: list[int], own: list[bool], other: list[int], others: list[bool]) -> tuple[int, int, list[int]]:
    """(shared lines, deleted ones, deleted ones among the page's own), the last as places in its own lines.

    ``own`` tells which lines structure takes for the page's own: those of its article or, without one, those outside
    menus and the like. A shared line is the site's, and deleted, with one exception: a line of an article stays, since
    pages may well tell the same, unless both the page and the other one have it in a menu, advert or the like.
    """
    shared = shared_lines(mine, other)
    around = {line for line, x in zip(mine, own, strict=True) if not x}
    place = [0]
    for x in own:
        place.append(place[-1] + x)
    gone = [(i, own[i]) for i, j in shared if not (article and own[i] and (others[j] or mine[i] not in around))]
    return len(shared), len(gone), [place[i] for i, x in gone if x]


_PARSED = "row long, page_id {kind}, url string, host string, path string, article boolean, lines array<string>, hashes array<long>, own array<boolean>"


def _parse(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                article, lines, hashes, own = [], [], [], []
                for page in part.column(4).to_pylist():
                    found = blocks(page)
                    article.append(any(zone == CORE for _, zone in found))
                    mine = CORE if article[-1] else PLAIN
                    own.append([zone == mine for _, zone in found])
                    lines.append([t for t, zone in found if zone == mine])
                    hashes.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found])
                ids = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [ids, *(part.column(k) for k in range(4)), pa.array(article, pa.bool_()), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.bool_()))],
                    names=["row", "page_id", "url", "host", "path", "article", "lines", "hashes", "own"],
                )

    return run


_PAIRED = "row long, host string, path string, before long, before_near int, after long, after_near int, part int, edge int"


def _near(a: tuple, b: tuple) -> int:
    """Leading path segments that two pages of one host share; -1 for different hosts."""
    if a[1] != b[1]:
        return -1
    x, y = a[2].split("/"), b[2].split("/")
    n = 0
    while n < len(x) and n < len(y) and x[n] == y[n]:
        n += 1
    return n


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (host, path): the neighbours of each, of the partition's first and last row as far as known."""
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _PAIRED.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    out: list[tuple] = []
    prev = now = None

    def emit(now: tuple, prev: tuple | None, following: tuple | None) -> None:
        edge = (prev is None) + 2 * (following is None)
        out.append((*now, prev and prev[0], _near(now, prev) if prev else -1, following and following[0], _near(now, following) if following else -1, part, edge))

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None:
                emit(now, prev, r)
            prev, now = now, r
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)
            out.clear()
    if now is not None:
        emit(now, prev, None)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)


def nearest_pages(parsed: DataFrame) -> DataFrame:
    """(row, partner): for each page the one of its host whose path is nearest.

    Pages are range-partitioned by (host, path), so that a large host is dealt over many tasks, and a page's nearest is
    the neighbour with which it shares more leading path segments, the one before on a tie. The first and last row of
    each partition, two a partition, go over the driver, which knows their neighbours across the border.
    """
    spark = parsed.sparkSession
    keys = parsed.select("row", "host", "path")
    ordered = keys.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    paired = settle(ordered.mapInArrow(_pair, _PAIRED), "page-pairs")
    edges = sorted(paired.where("edge > 0").select("host", "path", "row", "part", "edge").collect(), key=lambda r: (r["part"], -(r["edge"] & 1)))
    fixes = []
    for a, b in zip(edges, edges[1:]):
        if a["part"] != b["part"]:
            near = _near((0, a["host"], a["path"]), (0, b["host"], b["path"]))
            fixes += [(a["row"], None, None, b["row"], near), (b["row"], a["row"], near, None, None)]
    fix = spark.createDataFrame(fixes, "row long, b long, bn int, a long, an int").groupBy("row").agg(*(F.max(c).alias(c) for c in ("b", "bn", "a", "an")))
    joined = paired.join(F.broadcast(fix), "row", "left").select(
        "row", F.coalesce("b", "before").alias("before"), F.coalesce("bn", "before_near").alias("bn"), F.coalesce("a", "after").alias("after"), F.coalesce("an", "after_near").alias("an")
    )
    partner = F.when((F.col("bn") < 0) & (F.col("an") < 0), None).when(F.col("bn") >= F.col("an"), F.col("before")).otherwise(F.col("after"))
    return joined.select("row", partner.alias("partner")).where("partner is not null")


def nearest_others(parsed: DataFrame) -> DataFrame:
    """(row, partner): as ``nearest_pages``, but of pages of one host with the same lines the first stands for all.

    So a page's partner always differs from it, and a page that is there a million times is paired once.
    """
    rows = parsed.select("row", F.xxhash64("host", "hashes", "own").alias("kin"))
    first = parsed.groupBy(F.xxhash64("host", "hashes", "own").alias("kin")).agg(F.min(F.struct("host", "path", "row")).alias("x"), F.count("*").alias("many"))
    first = settle(first.select("kin", "many", "x.*"), "page-kin")
    table = settle(first.join(nearest_pages(first), "row").select("kin", "many", "partner"), "page-partners")
    return lookup(rows, table, "kin", "many", rows.count()).where("partner is not null").select("row", "partner")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_shared, n_deleted.

    Each page becomes lines of text, one a block. It is paired with the page of its host whose path is nearest, the two
    line sequences are aligned by their longest common subsequence (``n_shared`` is its length), and shared lines are
    deleted (``n_deleted`` counts those of the page's own lines alone), as ``deletions`` says: all of them on a page without an article or main element; on one
    that has it, all but those of the article, unless both pages have them in a menu or advert, since pages may well
    tell the same: in the test tables paragraphs of an article occur again on its host. What is left outside the article, or in a menu, form,
    advert or the like, and differs from page to page, goes by the structure of the page.

    Null html counts as empty and gives an empty text. A null URL has an empty host like all URLs without ``://``.
    Repeated rows, and all pages of a host with the same lines, have the same partner, which differs from them. Lines are compared by a hash of 64 bits. An
    empty table gives an empty result.
    """
    rows = pages.select(
        pages[id_col].alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"),
        F.coalesce(pages[html_col], F.lit("")).alias("html"),
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = settle(rows.mapInArrow(_parse(kind), _PARSED.format(kind=kind)), "page-lines")
    pairs = nearest_others(parsed)
    others = parsed.select(F.col("row").alias("partner"), F.col("hashes").alias("other"), F.col("own").alias("others"))
    # both sides grow with the pages: neither is broadcast
    both = parsed.select("row", "article", "hashes", "own").join(pairs.hint("merge"), "row").join(others.hint("merge"), "partner")
    both = both.select("row", "article", "hashes", "own", "other", "others")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deletions(*page) for page in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True)]
            counts = [pa.array(c, pa.int32()) for c in ([f[0] for f in found], [len(f[2]) for f in found])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["row", "n_shared", "n_deleted", "drop"])

    aligned = settle(both.mapInArrow(align, "row long, n_shared int, n_deleted int, drop array<int>"), "page-shared")
    joined = parsed.select("row", "page_id", "url", "lines").join(aligned, "row", "left")
    kept = F.when(F.coalesce(F.size("drop"), F.lit(0)) == 0, F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.array_contains("drop", i)))
    text = F.array_join(kept, "\n")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_shared", "n_deleted")]
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), *counts)
