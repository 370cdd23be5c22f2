"""Main text of web pages: markup, then differencing against the page with the nearest URL.

A page is cut into lines, one for each block. Markup says of some that they are menus, notices, scripts and so on,
and of others that they are the article. Every page is compared with the page of the same host whose path is nearest:
lines on a longest common subsequence of both belong to the site, the others are the page's own. Article and main
elements that hold own lines are the main text, as a whole; on a page without such elements the own lines are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.common import materialise, narrow, only, slices

# Fixed values of HTML: elements without content, elements that are blocks of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody tfoot thead title tr ul".split()
)
CELLS = {"td", "th"}
#: What a start tag ends if it is still open, and the elements beyond which it is not looked for.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that an end tag outside them does not close.
SCOPES = {"table", "td", "th", "caption", "template", "object", "html"}

# Elements and roles that are never the main text.
NOISE = set(
    "head title script style noscript template nav footer aside form button select datalist textarea input iframe svg"
    " canvas object audio video map dialog menu search".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in the names of classes and ids that say the same.
NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead topbar toolbar footer copyright sidebar rail widget"
    " widgets ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies"
    " consent gdpr notice notices disclaimer alert popup modal overlay dialog newsletter subscribe subscription signup"
    " login search social share sharing related recommended recommendations comment comments disqus respond reply"
    " replies pagination pager skip hidden".split()
)
#: First words of names that say what an element goes along with, not what it is.
BESIDE = {"has", "with", "without", "no", "not", "is", "can"}
#: Names of elements that hold the article where no element says so.
CONTENT = {
    "content", "main", "main-content", "maincontent", "page-content", "article", "article-body", "article-content",
    "post", "post-body", "post-content", "entry", "entry-content", "story", "story-body",
}

DROPPED, OPEN, NAMED, MAIN, ARTICLE = range(5)  # what markup says of a line
#: Shared lines with this part of the characters of the shorter page make a page a copy, which tells nothing.
COPY = 0.8


def words_of(name: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1-\2", name).lower()) if w]


def is_noise(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether an element is something else than main text; ``inside`` an article a header is the article's own."""
    if tag in NOISE or tag == "header" and not inside:
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True
    if (attrs.get("role") or "").lower() in ROLES and tag != "body":
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = words_of(name)
        if not words or words[0] in BESIDE:
            continue
        if tag == "article":
            words = words[:1]
        if not NAMES.isdisjoint(words) or "header" in words and not inside:
            return True
    return False


class Lines(HTMLParser):
    """Cuts a page into ``found``: (line, what markup says of it), in page order, white space as one blank."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, noise, best zone, number of the element that gave it
        self.found: list[tuple[str, int]] = []
        self.parts: list[int] = []  # for each line the article or main element around it; 0 without one
        self.said: list[str] = []
        self.zone = OPEN
        self.part = self.last = 0

    def end_line(self) -> None:
        if self.said:
            line = " ".join("".join(self.said).split())
            if line:
                self.found.append((line, self.zone))
                self.parts.append(self.part)
            self.said = []

    def settle(self) -> None:
        """A line ends where what markup says changes."""
        _, noise, zone, part = self.open[-1] if self.open else ("", False, OPEN, 0)
        now = DROPPED if noise else zone
        if now != self.zone or part != self.part:
            self.end_line()
            self.zone, self.part = now, part

    def pop_to(self, place: int) -> None:
        del self.open[place:]
        self.settle()

    def close_open(self, tags: set[str], barriers: set[str]) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            tag = self.open[place][0]
            if tag in tags:
                return self.pop_to(place)
            if tag in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            if any(t[0] == "p" for t in self.open[-8:]):
                self.close_open({"p"}, SCOPES | {"button"})
        elif tag in CELLS or tag == "br":
            self.said.append(" ")
        if tag in ENDS:
            self.close_open(*ENDS[tag])
        if tag in VOID:
            return
        known = dict(attrs)
        _, noise, around, part = self.open[-1] if self.open else ("", False, OPEN, 0)
        zone = around
        if not noise:
            noise = is_noise(tag, known, zone >= MAIN)
        if tag == "article":
            zone = ARTICLE
        elif tag == "main" or (known.get("role") or "").lower() == "main" or known.get("itemprop") == "articleBody":
            zone = max(zone, MAIN)
        elif tag not in ("html", "body") and not CONTENT.isdisjoint(
            f"{known.get('class') or ''} {known.get('id') or ''}".lower().split()
        ):
            zone = max(zone, NAMED)
        if zone > around and zone >= MAIN:
            self.last = part = self.last + 1
        self.open.append((tag, noise, zone, part))
        self.settle()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        elif tag in CELLS:
            self.said.append(" ")
        if tag in ("html", "body", "br"):
            return
        block = tag in BLOCKS or tag in CELLS
        for place in range(len(self.open) - 1, -1, -1):
            at = self.open[place][0]
            if at == tag:
                return self.pop_to(place)
            if at in SCOPES or not block and (at in BLOCKS or at in CELLS):
                return

    def handle_data(self, data):
        self.said.append(data)

    def parse_html_declaration(self, i):
        """Marked sections are comments in HTML; the parser would refuse unknown ones."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def page_parts(html: str) -> tuple[list[tuple[str, int]], list[int]]:
    """The lines with what markup says of them, and for each the number of the article or main element around it."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.found, parser.parts


def page_lines(html: str) -> list[tuple[str, int]]:
    return page_parts(html)[0]


def main_lines(found: list[tuple[str, int]]) -> tuple[list[int], bool]:
    """Places of the lines that may be main text as far as one page tells, and whether they are in article or main elements.

    These are the lines of article elements, or else of main elements, of elements named like content, or else all
    lines that are not noise. Which of them are the page's own the nearest page tells (``own_lines``).
    """
    best = max((zone for _, zone in found), default=DROPPED)
    return [i for i, (_, zone) in enumerate(found) if zone == best and zone != DROPPED], best >= MAIN


def compared_lines(found: list[tuple[str, int]]) -> list[int]:
    """Places of the lines that differencing decides on: those of all article and main elements, or else ``main_lines``."""
    places, elements = main_lines(found)
    return [i for i, (_, zone) in enumerate(found) if zone >= MAIN] if elements else places


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit j of row i is 0 where the common subsequence of a[:i] and b[:j + 1] is longer than that of b[:j]."""
    everything = (1 << len(b)) - 1
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    rows = [everything]
    for x in a:
        v = rows[-1]
        u = v & at.get(x, 0)
        rows.append(((v + u) | (v - u)) & everything)
    return rows


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    everything = v = (1 << len(b)) - 1
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & everything
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int], room: int = 1 << 28) -> list[int]:
    """Places in ``a`` of one longest common subsequence of ``a`` and ``b``; exact, in about ``room`` bits of memory."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    places = [i for i in range(start, len(a) - end) if a[i] in both]
    x, y = [a[i] for i in places], [v for v in b[start : len(b) - end] if v in both]
    if not x or not y:
        inner = []
    elif len(x) * len(y) <= room:
        rows, inner = _rows(x, y), []
        i, j = len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i] >> (j - 1) & 1:
                inner.append(i)
                j -= 1
        inner.reverse()
    elif len(x) == 1:
        inner = [0]
    else:  # the middle of x meets y where both halves together are longest
        half = len(x) // 2
        total = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(total.argmax())
        inner = common(x[:half], y[:cut], room) + [half + i for i in common(x[half:], y[cut:], room)]
    return [*range(start), *(places[i] for i in inner), *range(len(a) - end, len(a))]


def nearness(path: str, other: str) -> tuple[int, int]:
    """Leading parts that two paths share, then leading characters."""
    a, b = path.split("/"), other.split("/")
    parts = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return parts, next((i for i, (x, y) in enumerate(zip(path, other)) if x != y), min(len(path), len(other)))


def site_lines(page: dict, neighbours: list[dict]) -> list[bool]:
    """For each open line of ``page`` whether it stays, after the nearest page that is no copy of it.

    Pages are dicts with path, hashes and widths (of all lines) and places (of the open ones).
    """
    stays = [True] * len(page["places"])
    near = sorted((n for n in neighbours if n), key=lambda n: nearness(page["path"], n["path"]), reverse=True)
    for other in near:
        shared = common(page["hashes"], other["hashes"])
        own = set(page["places"])
        weight = sum(page["widths"][i] for i in shared if i in own)
        size = min(sum(page["widths"][i] for i in own), sum(other["widths"][i] for i in other["places"]))
        if weight < COPY * size:
            gone = set(shared)
            return [place not in gone for place in page["places"]]
    return stays


def own_lines(page: dict, neighbours: list[dict]) -> list[bool]:
    """For each compared line of ``page`` whether it is main text.

    Without article and main elements the lines that differencing leaves are. Otherwise a page is told by whole
    elements, so that a passage which two articles share stays in both: the article elements that differencing leaves
    a line of, or else such main elements; where it leaves nothing, the best elements of the page. The page has zones
    and parts of the compared lines besides what ``site_lines`` takes.
    """
    stays, zones, parts = site_lines(page, neighbours), page["zones"], page["parts"]
    if not zones or max(zones) < MAIN:
        return stays
    for zone in (ARTICLE, MAIN):
        own = {part for part, z, left in zip(parts, zones, stays) if left and z == zone}
        if own:
            return [z == zone and part in own for part, z in zip(parts, zones)]
    return [z == max(zones) for z in zones]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, hashes and widths of all lines, places of the compared ones among them, their lines,
    zones and parts, and ``content``, which is equal for pages with the same lines and markup."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            lines, hashes, widths, places, zones, parts = [], [], [], [], [], []
            for html in batch.column("html").to_pylist():
                found, part_of = page_parts((html or b"").decode("utf-8", "replace"))
                compared = compared_lines(found)
                lines.append([found[i][0] for i in compared])
                zones.append([found[i][1] for i in compared])
                parts.append([part_of[i] for i in compared])
                places.append(compared)
                hashes.append([xxhash.xxh64_intdigest(line.encode()) - (1 << 63) for line, _ in found])
                widths.append([len(line) for line, _ in found])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("page_id", "url", "host", "path")),
                    pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())),
                    *(pa.array(x, pa.list_(pa.int32())) for x in (widths, places, zones, parts)),
                ],
                ["page_id", "url", "host", "path", "lines", "hashes", "widths", "places", "zones", "parts"],
            )

    site = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
    located = pages.select(
        "page_id", "url", F.nullif(F.lower(F.regexp_extract("url", site + "([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.regexp_extract("url", site + "[^/?#]*([^?#]*)", 1).alias("path"), F.col("html").cast("binary").alias("html"),
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    made = narrow(located).mapInArrow(
        run,
        f"page_id {kind}, url string, host string, path string, lines array<string>, hashes array<long>, widths array<int>, "
        "places array<int>, zones array<int>, parts array<int>",
    )
    said = F.concat_ws(";", *(F.array_join(c, ",") for c in ("hashes", "places", "zones", "parts")))
    return made.withColumn("content", F.unhex(F.md5(said.cast("binary"))))


def with_neighbours(df: DataFrame, host: str, order: list[str], carried: list[str]) -> DataFrame:
    """Adds ``before`` and ``after``: structs of the carried columns of the rows next to each in its host, by order.

    Rows are dealt by ranges of the order, so a host with most rows is many tasks; the first and last row of each
    range are lent to the ranges next to it.
    """
    by = [host, *order]
    ranged = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id())
    dealt = materialise(ranged, "ranges")
    row = F.struct(*by)
    ends = dealt.groupBy("_range").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    along = Window.orderBy("_range")  # one row for each partition
    ends = ends.select("_range", "first", "last", F.lag("_range").over(along).alias("_left"), F.lead("_range").over(along).alias("_right"))
    lent = ends.select(F.col("_right").alias("_to"), F.col("last").alias("_row")).unionByName(
        ends.select(F.col("_left").alias("_to"), F.col("first").alias("_row"))
    ).where("_to IS NOT NULL")
    same = [dealt[c].eqNullSafe(F.col("_row")[c]) for c in by]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    guests = dealt.join(lent, condition).select(*df.columns, F.col("_to").alias("_range"), F.lit(True).alias("_guest"))
    rows = dealt.withColumn("_guest", F.lit(False)).unionByName(guests)
    w = Window.partitionBy("_range").orderBy(*by)
    own = F.struct(*carried)
    beside = {name: F.when(f(host).over(w) == F.col(host), f(own).over(w)) for name, f in (("before", F.lag), ("after", F.lead))}
    return rows.withColumns(beside).where(~F.col("_guest")).drop("_range", "_guest")


def kept_lines(pages: DataFrame) -> DataFrame:
    """host, content and ``stays`` (for each compared line) of every different page with compared lines.

    Pages with the same lines are one page here, so that copies are not compared with each other; pages without
    lines are none.
    """
    different = pages.where(F.size("hashes") > 0).groupBy("host", "content").agg(
        F.min("path").alias("path"), *(F.first(c).alias(c) for c in ("hashes", "widths", "places", "zones", "parts"))
    )
    beside = with_neighbours(different, "host", ["path", "content"], ["path", "hashes", "widths", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                stays = [own_lines(r, [r["before"], r["after"]]) for r in rows.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("host"), rows.column("content"), pa.array(stays, pa.list_(pa.bool_()))],
                    ["host", "content", "stays"],
                )

    return beside.where(F.size("places") > 0).mapInArrow(run, "host string, content binary, stays array<boolean>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page, from its whole html.

    Returns page_id, url, text and n_lines, one row per input row: the blocks in page order, white space in each as
    one blank, joined by an empty line; '' if there is none. Elements, roles and names of menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out. Every page is compared with the page
    next to it by path in its host, or the one after that if it is a copy; lines that both share in order are the
    site's. Article elements with lines of the page's own are the text, each as a whole, or else such main elements;
    on pages without either the own lines are. A page alone in its host, or without a URL that names one, or whose
    neighbours are copies, keeps the lines that markup leaves. A NULL html is empty; NULL and repeated ids and
    repeated rows give a row each; further columns are not read. Hashes of lines are compared and written to the shared
    folder; the lines themselves are cut a second time and travel once, to meet what was decided.
    """
    rows = only(pages, page_id=page_id, url=url, html=html)
    cut = parsed(rows)
    stays = kept_lines(cut.where("host IS NOT NULL")).select(F.col("host").alias("_host"), F.col("content").alias("_content"), "stays")
    alone = F.transform("zones", lambda zone: zone == F.array_max("zones"))
    asked = cut.select("page_id", "url", "host", "content", "lines", alone.alias("alone"))
    joined = asked.join(stays, (F.col("host") == F.col("_host")) & (F.col("content") == F.col("_content")), "left")
    left = F.filter("lines", lambda line, i: F.get(F.coalesce("stays", "alone"), i))
    return joined.withColumn("lines", left).select(
        "page_id", "url", F.array_join("lines", "\n\n").alias("text"), F.size("lines").alias("n_lines")
    )
