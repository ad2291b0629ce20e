"""HTML extraction by layout-aware rendering.

A tree builder with implied tags takes any markup; visibility rules drop what a browser would not show, style sheets with
plain selectors included; the renderer then emits all visible text: blocks on lines of their own, a blank line around
paragraphs and headings, marked and indented lists, preformatted text as it is, and table cells padded to the width of
their columns, over which cells may span.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.shipping import map_arrow

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title meta link iframe object canvas audio video datalist annotation annotation-xml".split())
#: Elements whose content isn't markup; in those of the second set character references count.
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes".split()), frozenset("title textarea".split())
#: Parts of a formula's element that stand apart.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mtr mtable".split())
#: Elements of SVG that are drawn only where others name them, or never.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker desc metadata lineargradient radialgradient filter".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset hr article section".split())
BLOCK = SPACED | frozenset(
    "html body div main header footer nav aside address center details summary dialog figcaption hgroup legend li dt dd option optgroup select textarea "
    "caption thead tbody tfoot tr td th".split()
)
#: Start tags that end an open drawing.
BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Levels of a browser's tree: what is deeper is a child of the last level, with all its text. Most columns a cell spans, and rows.
DEEPEST, COLUMNS, ROWS = 512, 1000, 65_534
_space = re.compile(r"[ \t\n\r\f]+")
_name = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_attr = re.compile(r"""[ \t\n\r\f/]*([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\r\f>]*)))?""")
_close = re.compile(r"[ \t\n\r\f/]*>")
_comment = re.compile(r"--!?>")
_whole = re.compile(r"[ \t\n\r\f]*([+-]?)([0-9]+)")


def whole(s: str, least: int, most: int, default: int) -> int:
    """The number a value begins with, however long, within limits."""
    m = _whole.match(s)
    if not m:
        return default
    digits = m[2].lstrip("0") or "0"
    n = int(digits) if len(digits) < 12 else 10**12
    return max(least, min(most, -n if m[1] == "-" else n))


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class Builder:
    """The tree of any markup; no input fails. Time is linear in the markup's length."""

    def __init__(self, html: str):
        self.root = Node("html", {})
        self.open = [self.root]
        self.title, self.drawn = "", False
        self.sheets: list[str] = []
        self._parse(html)

    def _parse(self, s: str) -> None:
        i, n = 0, len(s)
        while i < n:
            j = s.find("<", i)
            j = n if j < 0 else j
            if j > i:
                self.text(unescape(s[i:j]))
            if j == n:
                return
            i = self._markup(s, j)

    def _markup(self, s: str, i: int) -> int:
        """Takes what begins with "<" at ``i``; where it ends."""
        n = len(s)
        if m := _name.match(s, i + 1):
            at, attrs = m.end(), {}
            while not (end := _close.match(s, at)):
                a = _attr.match(s, at)
                if not a or a.end() == at:
                    return n  # a tag that never ends
                attrs.setdefault(a[1].lower(), unescape(next((v for v in a.group(2, 3, 4) if v is not None), "")))
                at = a.end()
            tag = m[0].lower()
            return self._content(s, end.end(), tag, self.start(tag, attrs, "/" in end[0]))
        if s.startswith("</", i) and (m := _name.match(s, i + 2)):
            self.end(m[0].lower())
            at = m.end()
            while not (end := _close.match(s, at)):
                a = _attr.match(s, at)
                if not a or a.end() == at:
                    return n
                at = a.end()
            return end.end()
        if s.startswith("<!--", i):
            if s.startswith((">", "->"), i + 4):
                return s.index(">", i) + 1
            end = _comment.search(s, i + 4)
            return end.end() if end else n
        if s.startswith("<![CDATA[", i) and self._foreign():
            end = s.find("]]>", i)
            self.text(s[i + 9 : n if end < 0 else end])
            return n if end < 0 else end + 3
        if s.startswith(("<!", "<?", "</"), i):
            end = s.find(">", i)
            return n if end < 0 else end + 1
        self.text("<")
        return i + 1

    def _content(self, s: str, i: int, tag: str, node: Node | None) -> int:
        """Takes the content of an element in which nothing is markup; where it ends."""
        if node is None or self._foreign():
            return i
        if tag == "plaintext":
            self.text(s[i:])
            return len(s)
        if tag not in RAW and tag not in ESCAPABLE:
            return i
        m = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.IGNORECASE).search(s, i)
        end = m.start() if m else len(s)
        content = s[i:end]
        if tag == "style":
            self.sheets.append(content)
        if content:
            node.kids.append(unescape(content) if tag in ESCAPABLE else content)
        if tag == "title" and not self.title:
            self.title = _space.sub(" ", unescape(content)).strip(" ")
        return end

    def start(self, tag: str, attrs: dict, empty: bool) -> Node | None:
        """Adds an element; returns it if it stays open."""
        if tag == "html":
            self.root.attrs |= attrs
            return None
        if tag in BREAKS and self._foreign() == "svg":
            del self.open[max(k for k, n in enumerate(self.open) if n.tag == "svg") :]
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in until:
                    break
                if self.open[k].tag in closed:
                    del self.open[k:]
                    break
        if tag in BLOCK:  # a block ends an open paragraph
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    del self.open[k:]
                    break
                if self.open[k].tag in BLOCK or self.open[k].tag == "foreignobject":
                    break
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot") and len(self.open) < DEEPEST:
            row = Node("tr", {})
            self.open[-1].kids.append(row)
            self.open.append(row)
        node = Node(tag, attrs)
        self.drawn |= tag in ("svg", "math")
        self.open[-1].kids.append(node)
        if tag in VOID or len(self.open) >= DEEPEST:
            return node if tag in RAW or tag in ESCAPABLE else None
        if empty and (tag in ("svg", "math") or self._foreign()):
            return None
        self.open.append(node)
        return node

    def _foreign(self) -> str:
        """The drawing or formula that is open, but for HTML inside of it."""
        for n in reversed(self.open if self.drawn else ()):
            if n.tag in ("svg", "math"):
                return n.tag
            if n.tag in ("foreignobject", "table", "div", "p", "body"):
                return ""
        return ""

    def end(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open):
            self.open[-1].kids.append(Node("p", {}))
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if tag not in BLOCK and self.open[k].tag in ("td", "th", "table"):
                return  # an inline end tag doesn't reach out of its cell

    def text(self, data: str) -> None:
        self.open[-1].kids.append(data)


# Style: display, visibility and white-space, from rules with plain selectors and style attributes.
_rule = re.compile(r"([^{}]*)\{([^{}]*)\}")
_simple = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][a-z_-][a-z0-9_-]*)*)\Z", re.IGNORECASE)
STYLED = ("display", "visibility", "white-space")


def declared(s: str) -> dict[str, str]:
    found = {}
    for d in s.split(";"):
        k, colon, v = d.partition(":")
        if colon and (k := k.strip().lower()) in STYLED:
            found[k] = v.lower().replace("!important", "").strip()
    return found


def _screen(sheet: str) -> str:
    """A sheet without comments and at-rules; what is asked for screens or all media stays."""
    sheet = re.sub(r"/\*.*?(\*/|\Z)", "", sheet, flags=re.DOTALL)
    out, i = [], 0
    for m in re.finditer(r"@[^{};]*([{;]|\Z)", sheet):
        if m.start() < i:
            continue
        out.append(sheet[i : m.start()])
        i, inside = m.end(), m.end()
        if m[1] == "{":
            depth = 1
            while depth and (b := re.compile(r"[{}]").search(sheet, i)):
                depth += 1 if b[0] == "{" else -1
                i = b.end()
            i = i if depth == 0 else len(sheet)
            if re.fullmatch(r"@media\s+(screen|all)\s*\{", m[0], re.IGNORECASE):
                out.append(_screen(sheet[inside : i - 1]))
    return "".join([*out, sheet[i:]])


class Style:
    """Rules whose selectors name a tag, classes and an id at most; others are left out."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, list] = {}
        for m in (m for sheet in sheets for m in _rule.finditer(_screen(sheet))):
            if not (found := declared(m[2])):
                continue
            for selector in m[1].split(","):
                s = _simple.match(selector.strip())
                if not s or not s[0]:
                    continue
                tag = "" if s[1] in (None, "*") else s[1].lower()
                marks = re.findall(r"[.#][^.#]+", s[2])
                ids, classes = {x[1:] for x in marks if x[0] == "#"}, {x[1:] for x in marks if x[0] == "."}
                key = next((x for x in marks if x[0] == "#"), next(iter(marks), tag))
                rank = (len(ids), len(classes), bool(tag), sum(map(len, self.by.values())))
                self.by.setdefault(key, []).append((rank, tag, ids, classes, found))

    def of(self, node: Node) -> dict[str, str]:
        found: dict[str, str] = {}
        if self.by:
            classes, name = set(node.attrs.get("class", "").split()), node.attrs.get("id", "")
            hits = [
                r for key in {"", node.tag, "#" + name, *("." + c for c in classes)} for r in self.by.get(key, ())
                if (not r[1] or r[1] == node.tag) and r[2] <= {name} and r[3] <= classes
            ]
            for r in sorted(hits, key=lambda r: r[0]):
                found |= r[4]
        if "style" in node.attrs:
            found |= declared(node.attrs["style"])
        return found


class Layout:
    """Lines so far; an empty line, None, is written when text comes after one was asked for."""

    def __init__(self):
        self.lines: list[str | None] = []
        self.now: list[str] = []
        self.gap = False

    def text(self, s: str) -> None:
        s = _space.sub(" ", s)
        if s == " " and not self.now or not s:
            return
        if not self.now or self.now[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.now.append(s)

    def end(self) -> None:
        line = "".join(self.now).strip(" ")
        self.now = []
        if line:
            self.put([line])

    def put(self, lines: list) -> None:
        if self.gap and self.lines:
            self.lines.append(None)
        self.gap = False
        self.lines += lines

    def space(self) -> None:
        self.end()
        self.gap = True


class Renderer:
    def __init__(self, style: Style):
        self.style = style

    def seen(self, node: Node, shown: bool) -> tuple[dict[str, str] | None, bool]:
        """(style, whether its own text shows); no style where the element and all in it is left out."""
        if node.tag in HIDDEN:
            return None, False
        style = self.style.of(node) if self.style.by or "style" in node.attrs else {}
        display = style.get("display", "")
        if display == "none" or (not display and "hidden" in node.attrs) or (node.tag == "dialog" and "open" not in node.attrs):
            return None, False
        if node.tag == "input":
            return ({}, shown) if node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value") else (None, False)
        visibility = style.get("visibility")
        return style, shown if visibility in (None, "inherit", "") else visibility not in ("hidden", "collapse")

    def lines(self, kids: list, shown: bool) -> list[str | None]:
        out = Layout()
        self.render(kids, out, shown)
        out.end()
        return out.lines

    def render(self, kids: list, out: Layout, shown: bool) -> None:
        for kid in kids:
            if isinstance(kid, str):
                if shown:
                    out.text(kid)
                continue
            style, here = self.seen(kid, shown)
            if style is None:
                continue
            tag, display = kid.tag, style.get("display", "")
            if tag == "br":
                if out.now:
                    out.end()
                elif out.lines:
                    out.gap = True
            elif tag == "hr":
                out.space()
            elif tag in ("pre", "textarea", "xmp", "listing", "plaintext") or style.get("white-space", "").startswith("pre"):
                out.space()
                raw = self.raw(kid.kids, here).strip("\n")
                if raw.strip():
                    out.put([x.rstrip() for x in raw.split("\n")])
                out.space()
            elif tag in ("ul", "ol", "menu", "dir"):
                self.listing(kid, out, here)
            elif tag == "svg":
                self.svg(kid, out, here)
            elif tag in APART:
                for k in kid.kids:
                    self.render([k], out, here)
                    out.text(" ")
            elif tag == "input":
                if here:
                    out.text(" " + kid.attrs["value"] + " ")
            elif tag == "table":
                out.space()
                if rows := self.table(kid, here):
                    out.put(rows)
                out.space()
            elif tag == "details" and "open" not in kid.attrs:
                out.end()
                self.render([k for k in kid.kids if isinstance(k, Node) and k.tag == "summary"][:1], out, here)
                out.end()
            elif tag == "dd":
                out.end()
                if inner := self.lines(kid.kids, here):
                    out.put(["  " + x if x else x for x in inner])
            elif (tag in BLOCK and not display.startswith("inline") and display != "contents") or display in ("block", "flex", "grid", "list-item", "table"):
                out.space() if tag in SPACED else out.end()
                self.render(kid.kids, out, here)
                out.space() if tag in SPACED else out.end()
            else:
                self.render(kid.kids, out, here)

    def svg(self, node: Node, out: Layout, shown: bool) -> None:
        """Text elements that are drawn, and HTML inside; other characters of a drawing are not shown."""
        for kid in node.kids:
            if isinstance(kid, str) or kid.tag in UNDRAWN or kid.attrs.get("display") == "none":
                continue
            style, here = self.seen(kid, shown)
            if style is None:
                continue
            if "visibility" in kid.attrs and "visibility" not in style:
                here = kid.attrs["visibility"] not in ("hidden", "collapse")
            if kid.tag in ("text", "foreignobject"):
                out.text(" ")
                self.render(kid.kids, out, here)
                out.text(" ")
            else:
                self.svg(kid, out, here)

    def raw(self, kids: list, shown: bool) -> str:
        parts = []
        for k in kids:
            if isinstance(k, str):
                parts.append(k if shown else "")
            elif k.tag == "br":
                parts.append("\n")
            else:
                style, here = self.seen(k, shown)
                if style is not None:
                    parts.append(self.raw(k.kids, here))
        return "".join(parts)

    def listing(self, node: Node, out: Layout, shown: bool) -> None:
        """Items behind "- " or their number; what is inside is indented under the mark."""
        out.space()
        ordered = node.tag == "ol"
        number = whole(node.attrs.get("start", ""), -(10**9), 10**9, 1)
        items: list[str] = []
        for kid in node.kids:
            if isinstance(kid, str):
                if shown and kid.strip():
                    items.append(_space.sub(" ", kid).strip(" "))
                continue
            style, here = self.seen(kid, shown)
            if style is None:
                continue
            if kid.tag == "li":
                number = whole(kid.attrs.get("value", ""), -(10**9), 10**9, number)
            mark = (f"{number}. " if ordered else "- ") if kid.tag == "li" else ""
            number += kid.tag == "li"
            inner = [x for x in (self.lines(kid.kids, here) if kid.tag == "li" else self.lines([kid], shown)) if x is not None]
            items += [((mark if k == 0 else " " * len(mark)) + x) if x else x for k, x in enumerate(inner)]
        if items:
            out.put(items)
        out.space()

    def rows(self, node: Node, shown: bool, found: dict[str, list], rest: list, part: str = "tbody") -> None:
        """The rows of a table by part, and what else stands in it; rows stay rows inside of sections, forms and the like."""
        todo = [(kid, shown, part) for kid in reversed(node.kids)]
        while todo:
            kid, shown, part = todo.pop()
            if isinstance(kid, str):
                rest.append((kid, shown))
                continue
            style, here = self.seen(kid, shown)
            if style is None:
                continue
            if kid.tag == "tr":
                found[part].append((kid, here))
            elif kid.tag in ("thead", "tbody", "tfoot", "colgroup") or (kid.tag not in ("table", "caption") and _has_row(kid)):
                inner = kid.tag if kid.tag in ("thead", "tfoot") and not found[kid.tag] else "tbody" if kid.tag in ("thead", "tfoot", "tbody") else part
                todo += [(k, here, inner) for k in reversed(kid.kids)]
            else:
                rest.append((kid, shown))

    def table(self, node: Node, shown: bool) -> list[str]:
        """Rows of cells, each padded to its columns; a cell may have several lines; other content comes before the rows."""
        found: dict[str, list] = {"thead": [], "tbody": [], "tfoot": []}
        others: list = []
        self.rows(node, shown, found, others)
        rest = Layout()
        for kid, here in others:
            self.render([kid], rest, here)
        rest.end()
        grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, columns, lines)
        taken: list[list[int]] = []  # [column, end, rows to come] of cells that reach down
        for row, here in found["thead"] + found["tbody"] + found["tfoot"]:
            cells, down, at = [], [], 0
            for kid in row.kids:
                columns = reach = 1
                if isinstance(kid, str):
                    if not here or not kid.strip():
                        continue
                    lines = [_space.sub(" ", kid).strip(" ")]
                else:
                    style, in_cell = self.seen(kid, here)
                    if style is None:
                        continue
                    if kid.tag in ("td", "th"):
                        lines = self.lines(kid.kids, in_cell)
                        columns = whole(kid.attrs.get("colspan", ""), 1, COLUMNS, 1)
                        reach = whole(kid.attrs.get("rowspan", ""), 0, ROWS, 1) or ROWS
                    else:
                        lines = self.lines([kid], here)
                for start, end, _ in taken:
                    if start < at + 1 and at < end:
                        at = end
                cells.append((at, columns, [x for x in lines if x is not None]))
                if reach > 1:
                    down.append([at, at + columns, reach])
                at += columns
            taken = sorted([start, end, n - 1] for start, end, n in taken + down if n > 1)
            if any(lines for _, _, lines in cells):
                grid.append(cells)
        width: dict[int, int] = {}
        for cells in grid:
            for at, columns, lines in cells:
                if columns == 1:
                    width[at] = max([width.get(at, 0), *map(len, lines)])
        wide = sorted((columns, at, max(map(len, lines))) for cells in grid for at, columns, lines in cells if columns > 1 and lines)
        there = sorted(k for k, n in width.items() if n)
        for columns, at, n in wide:
            inside = there[bisect_left(there, at) : bisect_left(there, at + columns)]
            have = sum(width[k] + 2 for k in inside) - 2
            if not inside:
                width[at] = n
                there.insert(bisect_left(there, at), at)
            elif n > have:
                width[inside[-1]] += n - have
        begin, x = {}, 0
        for k in there:
            begin[k] = x
            x += width[k] + 2
        out = rest.lines
        for cells in grid:
            placed = [(begin[there[bisect_left(there, at)]], lines) for at, _, lines in cells if lines]
            for n in range(max(len(lines) for _, lines in placed)):
                line = ""
                for at, lines in placed:
                    if n < len(lines) and lines[n]:
                        line = (line.ljust(at) if len(line) <= at else line + "  ") + lines[n]
                out.append(line)
        return ["" if x is None else x for x in out]


def _has_row(node: Node) -> bool:
    todo = [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, Node) and k.tag != "table":
                if k.tag == "tr":
                    return True
                todo.append(k)
    return False


def extract(html: str | None) -> tuple[str, str]:
    """(title, text) of a page; both empty for a null or empty one."""
    if not html:
        return "", ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 16 * DEEPEST))
    b = Builder(html)
    view = Renderer(Style(b.sheets))
    style, shown = view.seen(b.root, True)
    return b.title, "" if style is None else "\n".join(x or "" for x in view.lines(b.root.kids, shown))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [extract(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())],
            ["page_id", "url", "title", "text"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, title, text, n_lines, n_chars.

    A null or empty page has an empty title and text and no line. Any markup is taken, broken or not, however long; elements
    deeper than DEEPEST keep their text and lose their own layout. Pages are independent, so nothing is shuffled; repeated
    rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = map_arrow(rows, _extracted, "page_id long, url string, title string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return found.select("page_id", "url", "title", "text", lines.cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))
