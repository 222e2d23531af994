"""Text of web pages as a reader would see it laid out.

A tree is built from the page's tags, with the end tags that HTML lets authors leave out. Walking it, hidden parts are
passed over, blocks stand on lines of their own, list items get their bullets or numbers, and table cells are padded
into columns. The walk keeps its own stack, so depth is no limit.

Padding is bounded, so that a page's text is at most some times as long as the page: by default a cell's line of over WIDEST
characters does not widen its column, and a table row that would be padded to over PADDING times its own text stands with its cells
one below another. Both bounds are options, and with None in their place every table is laid out in full.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from functools import partial
from heapq import heappop, heappush
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.llm.common import field, slices

VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style template noscript title meta link datalist object iframe canvas audio video".split())
#: Parts of drawings and formulas that are not drawn where they stand, or at all.
UNDRAWN = set("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCKS = SPACED | set("address article aside body dialog div dd dt details fieldset figcaption footer form header html legend li main menu nav option section summary tr caption thead tbody tfoot".split())
#: A start tag of the key ends open elements of these kinds, up to the nearest of the stops.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p", "li"}, {"tr", "table"}),
    "th": ({"td", "th", "p", "li"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "p"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, {"html"}),
}
ENDS_P = (SPACED | {"address", "article", "aside", "div", "footer", "form", "header", "main", "nav", "section", "fieldset"}) - {"hr"} | {"hr"}
CELLS = ("td", "th", "table")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
WIDEST, PADDING = 60, 8


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag, attrs=()):
        self.tag, self.attrs, self.items = tag, dict(attrs), []

    def visible(self) -> bool:
        return not (self.tag in HIDDEN or (self.tag == "dialog" and "open" not in self.attrs) or "hidden" in self.attrs or UNSEEN.search(self.attrs.get("style") or "") or (self.tag == "input" and self.attrs.get("type") == "hidden"))


    def shows(self, inherited: bool) -> bool:
        """Whether text is drawn here; unlike a part that is taken out, one that is only not drawn may hold parts that are."""
        found = VISIBILITY.search(self.attrs.get("style") or "")
        return inherited if found is None else found[1].lower() == "visible"

    def span(self, name: str, most: int) -> int:
        given = (self.attrs.get(name) or "1").strip()
        return max(1, min(int(given), most)) if given.isascii() and given.isdigit() and len(given) < 9 else 1


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each tag's open elements

    def parse_html_declaration(self, i):
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known kind is a comment up to the next >
            return self.parse_bogus_comment(i)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def close_from(self, place: int) -> None:
        for node in reversed(self.open[place:]):
            self.at[node.tag].pop()
        del self.open[place:]

    def handle_starttag(self, tag, attrs):
        ends, stops = IMPLIED.get(tag, ({"p"}, {"td", "th", "li", "table", "div", "section", "article", "body", "button"}) if tag in ENDS_P else ((), ()))
        stop = self.last(stops)
        inside = [places[bisect_right(places, stop)] for places in map(self.at.__getitem__, ends) if places and places[-1] > stop]
        if inside:
            self.close_from(min(inside))
        if tag in BLOCKS and tag not in ("html", "head", "body") and self.open[-1].tag == "head":
            self.close_from(len(self.open) - 1)  # a block cannot stand in the head, so the body has begun
        node = Node(tag, attrs)
        if tag in UNDRAWN and (self.at["svg"] or self.at["math"]):
            node.attrs["hidden"] = ""
        self.open[-1].items.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.close_from(len(self.open) - 1)

    def handle_endtag(self, tag):
        place = self.last((tag,))
        if not place or place < self.last(CELLS) and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
            return  # a stray end tag does not reach out of its cell
        self.close_from(place)

    def handle_data(self, data):
        self.open[-1].items.append(data)


class Page:
    """Lines of laid out text; gap is how many line ends must come before the next text."""

    def __init__(self):
        self.parts, self.gap, self.space = [], 0, False

    def text(self, data: str, keep: bool = False) -> None:
        words = data.split()
        if not words and not keep:
            self.space = self.space or bool(data)
            return
        if self.gap and self.parts:
            self.parts.append("\n" * self.gap)
        elif self.parts and (self.space or (data[:1].isspace() and not keep)):
            self.parts.append(" ")
        self.parts.append(data if keep else " ".join(words))
        self.gap, self.space = 0, not keep and data[-1:].isspace()

    def end(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def line(self) -> None:
        """One more line end, for each time that it is asked for."""
        self.gap, self.space = self.gap + 1, False

    def trim(self) -> None:
        """The line end at the end of preformatted text opens no line of its own."""
        if self.parts and not self.gap and self.parts[-1].endswith("\n"):
            self.parts[-1] = self.parts[-1][:-1]

    def done(self) -> str:
        return "".join(self.parts).strip("\n")


class Columns:
    """The columns that no cell of an earlier row reaches down into, as (first, one after the last) in order; the last one has no end."""

    def __init__(self):
        self.free: list[tuple[int, float]] = [(0, float("inf"))]
        self.taken: list[tuple[int, int, int]] = []  # (row from which on it is free again, first column, column after the last)
        self.shared: list[tuple[int, int, int]] = []  # of cells that lie over earlier ones, as wide cells may

    def next_row(self, row: int) -> None:
        if self._give_back(row) and self.shared:
            self.shared = [x for x in self.shared if x[0] > row]
            for until, a, b in self.shared:
                self._take(a, b, until)

    def _give_back(self, row: int) -> bool:
        some = False
        while self.taken and self.taken[0][0] <= row:
            some = True
            _, a, b = heappop(self.taken)
            at = bisect_right(self.free, (a, b))
            if at and self.free[at - 1][1] == a:
                at -= 1
                a = self.free.pop(at)[0]
            if self.free[at][0] == b:
                b = self.free.pop(at)[1]
            insort(self.free, (a, b))
        return some

    def take(self, first: int, after: int, until: int) -> None:
        """These columns go to a cell until a row."""
        if self._take(first, after, until) < after - first:
            self.shared.append((until, first, after))

    def _take(self, first: int, after: int, until: int) -> int:
        """How many of the columns were free; only these are taken."""
        got = 0
        at = max(0, bisect_right(self.free, (first, float("inf"))) - 1)
        while at < len(self.free) and self.free[at][0] < after:
            a, b = self.free[at]
            low, high = max(a, first), min(b, after)
            if low >= high:
                at += 1
                continue
            heappush(self.taken, (until, low, high))
            got += high - low
            rest = [x for x in ((a, low), (high, b)) if x[0] < x[1]]
            self.free[at : at + 1] = rest
            at += len(rest)
        return got


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """Cells (text, columns, rows) as (column, columns, text); a cell that spans rows keeps its columns in those below."""
    out, columns = [], Columns()
    for number, row in enumerate(rows):
        columns.next_row(number)
        at, i, cells, new = columns.free[0][0], 0, [], []
        for text, wide, tall in row:
            cells.append((at, wide, text))
            if tall > 1:
                new.append((at, at + wide, number + tall))
            at += wide
            while at >= columns.free[i][1]:
                i += 1
            at = max(at, columns.free[i][0])
        for a, b, until in new:
            columns.take(a, b, until)
        out.append(cells)
    return out


def _grid(rows: list[list[tuple[str, int, int]]], widest: int | None = WIDEST, padding: int | None = PADDING) -> str:
    """Cells in columns; a cell of several lines makes its row as tall."""
    placed = [[(at, wide, text.split("\n")) for at, wide, text in r] for r in _placed(rows)]
    widths: dict[int, int] = {}  # of columns in which a cell starts
    for r in placed:
        for at, wide, lines in r:
            widths[at] = max([widths.get(at, 0), *(len(x) for x in lines if wide == 1 and (widest is None or len(x) <= widest))])
    starts, end = {}, 0
    for at in sorted(widths):
        starts[at] = end
        end += widths[at] + 2 if widths[at] else 0
    lines = []
    for r in placed:
        cells = [(starts[at], x) for at, _, x in r if any(x)]
        tall = max((len(x) for _, x in cells), default=0)
        text = sum(len(y) for _, x in cells for y in x)
        if cells and padding is not None and tall * (cells[-1][0] + len(cells)) > padding * text + 8 * WIDEST:
            lines += [y for _, x in cells for y in x]
            continue
        for k in range(tall):
            line = ""
            for start, x in cells:
                if k < len(x) and x[k]:
                    line = (line.ljust(max(start, len(line) + 2)) if line else " " * start) + x[k]
            lines.append(line)
    return "\n".join(lines)


def _numbers(item: Node) -> list[int] | None:
    """[number of the next item, step] of an ordered list."""
    if item.tag != "ol":
        return None
    step = -1 if "reversed" in item.attrs else 1
    items = sum(not isinstance(x, str) and x.tag == "li" for x in item.items)
    return [_whole(item.attrs.get("start"), items if step < 0 else 1), step]


def _whole(text: str | None, default: int) -> int:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else default


def _shown(item: Node) -> list:
    """The parts of an element that are laid out: of closed details only the summary, of preformatted text all but a first line end."""
    if item.tag == "details" and "open" not in item.attrs:
        return [x for x in item.items if not isinstance(x, str) and x.tag == "summary"][:1]
    if item.tag == "pre" and item.items and isinstance(item.items[0], str) and item.items[0].startswith("\n"):
        return [item.items[0][1:], *item.items[1:]]
    return item.items


def render(root: Node, widest: int | None = WIDEST, padding: int | None = PADDING) -> str:
    pages, tables, lists = [Page()], [], []
    stack: list = [(root, False, True)]
    pre = 0
    while stack:
        item, leaving, drawn = stack.pop()
        page = pages[-1]
        if isinstance(item, str):
            if drawn and item:
                page.text(item, bool(pre))
            continue
        tag = item.tag
        if not leaving:
            if not item.visible():
                continue
            drawn = item.shows(drawn)
            if tag == "br":
                page.line()
                continue
            if tag == "img":
                if drawn:
                    page.text(item.attrs.get("alt") or "")
                continue
            if tag in BLOCKS:
                page.end(2 if tag in SPACED and not lists and not tables else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append(_numbers(item))
            elif tag == "li":
                numbers = lists[-1] if lists else None
                if numbers:
                    numbers[0] = _whole(item.attrs.get("value"), numbers[0])
                if drawn:
                    page.text(("  " * (len(lists) - 1) if lists else "") + (f"{numbers[0]}." if numbers else "-"), keep=True)
                    page.space = True
                if numbers:
                    numbers[0] += numbers[1]
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                pages.append(Page())
            pre += tag == "pre"
            stack.append((item, True, drawn))
            stack.extend((x, False, drawn) for x in reversed(_shown(item)))
            continue
        if tag == "pre":
            pre -= 1
            page.trim()
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag in ("td", "th") and tables and len(pages) > 1:
            cell = pages.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, item.span("colspan", 1000), item.span("rowspan", 65534)))
            page = pages[-1]
        elif tag == "table" and tables:
            grid = _grid(tables.pop(), widest, padding)
            if grid:
                page.text(grid, keep=True)
        if tag in BLOCKS:
            page.end(2 if tag in SPACED and not lists and not tables else 1)
    return pages[0].done()


def extract(html: str | None, widest: int | None = WIDEST, padding: int | None = PADDING) -> str:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return render(tree.root, widest, padding)


def _extract(batches, widest, padding):
    for batch in slices(batches):
        texts = [extract(x, widest, padding) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], ["id", "url", "text"])


def visible_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", widest: int | None = WIDEST, padding: int | None = PADDING) -> DataFrame:
    """(id, url, text) per page; null and empty pages have empty text, repeated rows stay. Other columns are not read.

    widest and padding bound how far tables are padded (see above); None for both lays out every table in full.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([field("id", base.schema["id"].dataType), field("url", base.schema["url"].dataType), field("text", "string")])
    return base.mapInArrow(partial(_extract, widest=widest, padding=padding), schema)
