"""HTML extraction by nearest-URL page differencing.

A page is read into text lines, one for each block. Pages of a host are sorted by URL path, each is paired with the ones before
and after it, and the lines of a pair are aligned by a longest common subsequence. What two neighbours share is template, not
text, and is deleted. What elements say weighs with that (``weigh``):

- on a page without ``article`` or ``main``, differencing decides: lines that a neighbour shares go, lines that are the
  page's own stay, but for those in elements that never hold the text (nav, footer, aside, form and so on);
- on a page that marks its article, the text is in there, and a line that neighbours share may be a quotation or a licence. In
  there differencing deletes whole named blocks (with a class or an id) if a neighbour shares all of their lines;
- a class or id that is, as a whole word, one of ``NAMES`` speaks against a line, unless most of the page stands under such
  names. Names of elements around an article say nothing about it.

A neighbour that shares all lines that could be a page's text is a copy of it and deletes nothing.

A host may have a third of all pages, so pages are dealt by ranges of (host, path without trailing slashes, page_id), as many
as there are shuffle partitions. The pages at the ends of a range go to the range next to it as well, so that each page meets
both of its neighbours, wherever it stands. A range is read in order, two pages at a time. Only the first and last key of
each range are collected and broadcast.

Cases: null or empty html gives an empty text; broken markup is read as far as it goes, unclosed blocks end where the next
begins; a page alone on its host, or without a host, is compared with none and loses no plain line; pages of any length are read
whole; pages with equal paths are in order of page_id; repeated rows are pages of their own and copies of each other; empty
tables give no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoked.llm.common import table
from evoked.llm.url_tree import host_and_path

_SKIPPED = frozenset("script style noscript template iframe object svg math head title select textarea button canvas audio video".split())
#: Elements that HTML defines as other than a page's text, and the ARIA roles that say the same.
_CHROME = frozenset("nav header footer aside form menu dialog".split())
_ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alertdialog": -1, "main": 1, "article": 1}
_CONTENT = frozenset("article main".split())
#: Evidence, as whole classes or ids only.
NAMES = frozenset("ad ads advert adverts advertisement sponsored comment comments cookie cookies newsletter sidebar".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by a block that begins inside them.
_LEAFY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Room for the lines that leave a Python worker at a time.
BATCH_CHARS = 8_000_000


@dataclass
class Line:
    """place: 1 inside the article, -1 in other elements, 0 else. named: under one of ``NAMES``. block: the number of the
    innermost element with a class or an id, 0 if none, counted from inside the article."""

    text: str
    place: int
    named: bool
    block: int


def lines_of(page: str | None) -> list[Line]:
    """The blocks with text, in page order."""
    page, out, buffer = page or "", [], []
    stack: list[tuple] = []  # open elements, and what holds inside them
    outside = inside = (0, False, 0, False)  # place, named, block, whether in an article
    at = blocks = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append(Line(text, *inside[:3]))

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # inside a script or style
        if m.start() > at:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:  # an end tag closes up to its own element, if that is open
            if name in _BLOCKS or name in _SKIPPED:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            inside = stack[-1][1] if stack else outside
            continue
        if name == "br":
            buffer.append(" ")
        if name in _BLOCKS:
            flush()
            if stack and (stack[-1][0] in _LEAFY and name not in ("li", "dt", "dd") or stack[-1][0] == name and name in _LEAFY):
                while stack and stack[-1][0] in _LEAFY:  # unclosed paragraphs end here
                    stack.pop()
                inside = stack[-1][1] if stack else outside
        if name in _SKIPPED:
            if name == "head":
                continue
            flush()
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        place, named, block, article = inside
        attrs, role = m[3] or m[6] or "", 0
        if attrs and name not in ("html", "body"):
            for key, *values in _NAMED.findall(attrs):
                words = "".join(values).lower().split()
                if key.lower() == "role":
                    role = role or next((_ROLES[w] for w in words if w in _ROLES), 0)
                elif name in _BLOCKS:
                    blocks += 1
                    block, named = blocks, named or not NAMES.isdisjoint(words)
        own_name = named and not inside[1]
        if role > 0 or name in _CONTENT and role == 0:
            if article and name != "main" and any(x == name for x, _ in stack):
                place = -1  # an article in an article is a comment on it, or a teaser
            elif place >= 0 or not article:
                place, article, block = 1, True, 0
                named = own_name
        elif role < 0 or name in _CHROME and not (name == "header" and place == 1):
            place = -1
        then = (place, named, block, article)
        if name in _BLOCKS or then != inside:
            if then != inside:
                flush()
            stack.append((name, then))
            inside = then
    buffer.append(page[at:])
    flush()
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places in ``a`` and ``b`` of one longest common subsequence: rows of bits, one machine word for many columns."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    ends = [(i, i) for i in range(lo)] + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    mid, known = b[lo : len(b) - hi], {}
    for j, x in enumerate(mid):
        known[x] = known.get(x, 0) | 1 << j
    places = [i for i in range(lo, len(a) - hi) if a[i] in known]
    full, row, rows = (1 << len(mid)) - 1, (1 << len(mid)) - 1, []
    for i in places:
        u = row & known[a[i]]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    # A zero bit in a row is a column where the subsequence grows; go back from the last.
    j, found = len(mid) - 1, []
    for k in range(len(places) - 1, -1, -1):
        before = rows[k - 1] if k else full
        while j >= 0 and rows[k] >> j & 1:
            j -= 1
        if j < 0:
            break
        if before >> j & 1 and known[a[places[k]]] >> j & 1:
            found.append((places[k], lo + j))
            j -= 1
    return ends + found


@dataclass
class Page:
    meta: tuple
    lines: list[Line]
    #: Lines that a neighbour shares which is no copy, and whether there is such a neighbour.
    shared: set = field(default_factory=set)
    compared: bool = False
    #: Named blocks inside the article that a neighbour shares as a whole.
    template: set = field(default_factory=set)

    def meet(self, places: list[int]) -> None:
        """``places``: the lines that a neighbour has as well."""
        both = set(places)
        if not any(x.place >= 0 and i not in both for i, x in enumerate(self.lines)):
            return
        self.compared = True
        self.shared |= both
        if any(x.place == 1 and i not in both for i, x in enumerate(self.lines)):
            own = {x.block for i, x in enumerate(self.lines) if x.place == 1 and i not in both}
            self.template |= {x.block for i, x in enumerate(self.lines) if x.place == 1 and x.block and i in both} - own

    def weigh(self) -> list[bool]:
        """For each line whether the evidence speaks for it. Signs are what matters: an element that never holds the text
        outweighs that a line is the page's own, and a name outweighs both that and the article."""
        marked = any(x.place == 1 for x in self.lines)
        may_be = [x for x in self.lines if x.place >= marked]
        misnamed = 2 * sum(len(x.text) for x in may_be if x.named) > sum(len(x.text) for x in may_be)
        out = []
        for i, x in enumerate(self.lines):
            e = {1: 2, 0: -1 if marked else 0, -1: -2}[x.place]
            if x.named and not misnamed:
                e -= 3
            if x.place == 1:
                e -= 3 * (x.block in self.template)
            elif self.compared:
                e += -2 if i in self.shared else 0 if marked else 1
            out.append(e >= 0)
        return out

    def text(self) -> tuple[str, int]:
        """The text, and how many lines differencing took from it."""
        keep = self.weigh()
        alone = Page(self.meta, self.lines).weigh()
        return "\n\n".join(x.text for x, k in zip(self.lines, keep, strict=True) if k), sum(a and not k for a, k in zip(alone, keep, strict=True))


def compare(a: Page, b: Page) -> None:
    pairs = aligned([x.text for x in a.lines], [x.text for x in b.lines])
    a.meet([i for i, _ in pairs])
    b.meet([j for _, j in pairs])


_KEY = ("host", "path", "id")


def _keyed(pages: DataFrame, *columns: str) -> DataFrame:
    """page_id, ``columns``, and host, path (less trailing slashes) and id, which pages are sorted by."""
    host, path = host_and_path(F.col("url"))
    page_id = F.col("page_id").cast("long")
    return pages.select(
        page_id.alias("page_id"), *columns, F.coalesce(host, F.lit("")).alias("host"), F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "").alias("path"),
        F.coalesce(page_id, F.lit(-(1 << 63))).alias("id"),
    )


def _ends(pages: DataFrame, ranges: int) -> tuple[list[tuple], list[tuple]]:
    """The first and the last key of each range of pages, in order."""
    keys = _keyed(pages).select(*_KEY).distinct().repartitionByRange(ranges, *_KEY)
    ends = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*_KEY)).alias("a"), F.max(F.struct(*_KEY)).alias("b")).collect()
    return sorted(tuple(r.a) for r in ends), sorted(tuple(r.b) for r in ends)


_LINES = "texts array<string>, places array<tinyint>, named array<boolean>, blocks array<int>"


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url, text and n_shared (lines deleted because a page near by has them)."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast(_ends(pages, ranges))

    def read(batches):
        """A page's lines for its range, and again for the range next to it if the page stands at an end."""
        starts, ends = held.value
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", *_KEY)), strict=True):
                page_id, url, page, *key = (x.as_py() for x in row)
                lines = lines_of(page)
                parts = [[x.text for x in lines], [x.place for x in lines], [x.named for x in lines], [x.block for x in lines]]
                at = bisect_right(starts, tuple(key)) - 1
                rows.append((at, True, page_id, url, *key, *parts))
                for other, edge in ((at - 1, starts[at]), (at + 1, ends[at])):
                    if key[0] and tuple(key) == edge and 0 <= other < len(starts) and key[0] in (starts[other][0], ends[other][0]):
                        rows.append((other, False, page_id, url, *key, *parts))
                size += len(page or "")
                if size > BATCH_CHARS:
                    yield _batch(rows, READ)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, READ)

    def difference(batches):
        held: Page | None = None
        out, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c] for c in ("block", "own", "page_id", "url", "host", "texts", "places", "named", "blocks")), strict=True):
                block, own, page_id, url, host, *parts = (x.as_py() for x in row)
                page = Page((block, host, own, page_id, url), [Line(*x) for x in zip(*parts, strict=True)])
                if held is not None:
                    if host and held.meta[:2] == (block, host):
                        compare(held, page)
                    if held.meta[2]:
                        out.append((*held.meta[3:], *held.text()))
                        size += len(out[-1][2])
                    if size > BATCH_CHARS:
                        yield _batch(out, DIFFERED)
                        out, size = [], 0
                held = page
        if held is not None and held.meta[2]:
            out.append((*held.meta[3:], *held.text()))
        if out:
            yield _batch(out, DIFFERED)

    rows = _keyed(pages, "url", "html").mapInArrow(read, f"block int, own boolean, page_id long, url string, host string, path string, id long, {_LINES}")
    rows = rows.repartitionById(ranges, F.col("block")).sortWithinPartitions("block", *_KEY)
    return rows.mapInArrow(difference, "page_id long, url string, text string, n_shared int")


READ = (pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
DIFFERED = (pa.int64(), pa.string(), pa.string(), pa.int32())
_NAMES_OF = {READ: ["block", "own", "page_id", "url", *_KEY, "texts", "places", "named", "blocks"], DIFFERED: ["page_id", "url", "text", "n_shared"]}


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES_OF[kinds])


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
