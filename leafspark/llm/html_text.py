"""HTML extraction: layout-aware text of pages.

A tree builder supplies implied tags (head and body, ends of p, li, dt, dd, option, cells, rows and row
groups), visibility rules drop what a browser doesn't show, and the rest is rendered with blank lines
around paragraphs, headings and lists, markers and indents for list items, and table cells in columns.
Tokenising, building and rendering are linear in the page, without recursion over elements.

Hidden: head, script, style, template, noscript, iframe, media and the like; the ``hidden`` attribute;
inline display:none, and visibility:hidden but for descendants that are visible again; closed dialogs and
the body of closed details; inputs that show no value; of graphics all but their texts, and the
annotations of formulas. In a table, text wraps at 80 characters and a column is as wide as its widest
line up to that; single words, preformatted lines and inner tables beyond it overflow. Elements nested
deeper than 512 are put beside each other at that depth, as browsers do. Nothing visible is left out.

Defined results: null and empty pages give an empty text; unclosed tags, comments and quotes run to the
end as in a browser; repeated rows are rendered alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafspark.llm.common import short_batches, table


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes")
RCDATA = _set("textarea title")
HIDDEN = _set("head script style template noscript iframe noembed noframes title datalist audio video canvas annotation annotation-xml")
#: Inside graphics, what shows its text; elsewhere everything does.
DRAWN = _set("text foreignobject")
#: Inputs that show their value.
VALUED = _set("text search url tel email number date month week time datetime-local submit button reset")
#: A blank line stands around these, a line break around the blocks.
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table hr fieldset figure menu article section main header footer nav aside address details")
BLOCKS = SPACED | _set("html body div li dt dd form center dir figcaption legend summary tr td th thead tbody tfoot caption option optgroup hgroup search dialog")
CLOSES_P = SPACED | _set("div li dt dd form center dir figcaption summary search")
#: A start tag ends the open elements on the left, up to those on the right.
IMPLIED = {
    "li": (_set("li"), _set("ul ol menu dir table td th")),
    "dt": (_set("dt dd"), _set("dl table td th")),
    "dd": (_set("dt dd"), _set("dl table td th")),
    "option": (_set("option"), _set("select datalist")),
    "optgroup": (_set("option optgroup"), _set("select")),
    "td": (_set("td th"), _set("table")),
    "th": (_set("td th"), _set("table")),
    "tr": (_set("tr td th caption colgroup"), _set("table")),
    "thead": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tbody": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
    "tfoot": (_set("thead tbody tfoot tr td th caption colgroup"), _set("table")),
}
SCOPE = _set("td th table caption button html body")
WIDEST, DEEPEST = 80, 512

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)
_QUOTE = re.compile(r"=\s*([\"'])")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | RCDATA}


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag; quotes count only after an equals sign."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quote = _QUOTE.search(page, at, end)
        if not quote:
            return end
        close = page.find(quote[1], quote.end())
        if close < 0:
            return end
        at = close + 1


def tokens(page: str):
    """(kind, value, attributes) of texts, start tags and end tags."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", html.unescape(page[at:]), None
            return
        if lt > at:
            yield "text", html.unescape(page[at:lt]), None
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/" and page[lt + 2 : lt + 3].isalpha():
            end = page.find(">", lt)
            yield "end", _NAME.match(page, lt + 2)[0].lower(), None
            at = n if end < 0 else end + 1
        elif after.isalpha() and after.isascii():
            name = _NAME.match(page, lt + 1)
            tag = name[0].lower()
            end = _tag_end(page, name.end())
            inside = page[name.end() : end]
            found = {}
            for m in _ATTRIBUTE.finditer(inside) if inside.strip(" /\n\t") else ():
                found.setdefault(m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
            yield "start", tag, found
            at = end + 1
            if tag in _ENDS:
                close = _ENDS[tag].search(page, at)
                stop = close.start() if close else n
                raw = page[at:stop]
                yield "text", html.unescape(raw) if tag in RCDATA else raw, None
                yield "end", tag, None
                end = page.find(">", stop)
                at = n if end < 0 else end + 1
        else:
            yield "text", "<", None
            at = lt + 1


def tree(page: str) -> Node:
    """The page's elements under a root, with the tags that the standard implies."""
    root = Node("html", {})
    stack, places = [root], {"html": [0]}

    def push(name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes)
        stack[min(len(stack), DEEPEST) - 1].children.append(node)
        places.setdefault(name, []).append(len(stack))
        stack.append(node)

    def pop_to(size: int) -> None:
        while len(stack) > size:
            places[stack.pop().name].pop()

    def innermost(names) -> int:
        """The place of the innermost open element of ``names``, 0 if there is none."""
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def close(names, barriers) -> None:
        """Ends the outermost open element of ``names`` inside the nearest barrier."""
        inside = innermost(names)
        if inside:
            barrier = innermost(barriers)
            found = [own[at] for x in names if (own := places.get(x)) and (at := bisect_right(own, barrier)) < len(own)]
            if found:
                pop_to(min(found))

    for kind, value, attributes in tokens(page):
        if kind == "text":
            if places.get("head") and stack[-1].name == "head" and value.strip():
                close(("head",), ())
            stack[-1].children.append(value)
        elif kind == "end":
            if value == "br":
                stack[-1].children.append(Node("br", {}))
            elif value not in ("html", "body") and places.get(value):
                barriers = SCOPE - {value} if value not in ("table", "tr", "thead", "tbody", "tfoot") else ()
                if (own := places[value][-1]) > innermost(barriers):
                    pop_to(own)
            elif value == "p":
                stack[-1].children.append(Node("p", {}))
        else:
            if value == "html":
                root.attributes = {**attributes, **root.attributes}
                continue
            if value == "body" or (stack[-1].name == "head" and value not in ("title", "style", "script", "meta", "link", "base", "noscript", "template")):
                close(("head",), ())
            if value == "body" and places.get("body"):
                continue
            if value in CLOSES_P:
                close(("p",), SCOPE)
            if value in IMPLIED:
                close(*IMPLIED[value])
            if value in ("td", "th") and places.get("table") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
                push("tr", {})
            push(value, attributes)
            if value in VOID:
                pop_to(len(stack) - 1)
    return root


def displayed(node: Node) -> bool:
    a = node.attributes
    if node.name in HIDDEN or "hidden" in a or (node.name == "dialog" and "open" not in a):
        return False
    return not (a and "style" in a and _GONE.search(a["style"]))


def shown(node: Node, inherited: bool) -> bool:
    """Whether the element's own text is seen; descendants may differ."""
    found = _VISIBILITY.findall(node.attributes.get("style", ""))
    return found[-1].lower() not in ("hidden", "collapse") if found else inherited


class Page:
    """Text with pending breaks, indents and list markers; a break comes out when text follows it."""

    def __init__(self, wrap: int = 0):
        self.out: list[str] = []
        self.wrap = wrap  # the length of lines of running text, 0 for any
        self.used = 0
        self.breaks = 0
        self.space = False
        self.fresh = True  # at the start of a line
        self.indents: list[str] = []
        self.markers: list[str] = []

    def break_line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def line_break(self) -> None:
        """A break that counts each time, as <br> does."""
        self.breaks, self.space = self.breaks + 1, False

    def _open(self) -> None:
        if self.breaks and self.out:
            self.out.append("\n" * self.breaks)
            self.fresh = True
        self.breaks = 0
        if self.fresh:
            # A waiting marker stands where its item's own indent would.
            self.out.append("".join(self.indents[: len(self.indents) - len(self.markers)] + self.markers))
            self.used = len(self.out[-1])
            self.markers.clear()
            self.fresh = self.space = False

    def text(self, value: str) -> None:
        words = _SPACE.sub(" ", value)
        if words in ("", " "):
            self.space = self.space or bool(words)
            return
        self.space = self.space or words[0] == " "
        fresh = self.fresh or (self.breaks and self.out)
        self._open()
        for k, word in enumerate(words.strip(" ").split(" ") if self.wrap else (words.strip(" "),)):
            size = _width(word) if self.wrap else 0
            if (k or self.space) and not (fresh and not k):
                if self.wrap and self.used + 1 + size > self.wrap:
                    self.breaks = max(self.breaks, 1)
                    self._open()
                else:
                    self.out.append(" ")
                    self.used += 1
            self.out.append(word)
            self.used += size
        self.space = words[-1] == " "

    def lines(self, value: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(value.expandtabs(8).replace("\r\n", "\n").split("\n")):
            if k:
                self.line_break()
            if line:
                self._open()
                self.out.append(line)

    def result(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.out).split("\n")).strip("\n")


def _number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


def render(root: Node, seen: bool = True, wrap: int = 0) -> str:
    """The visible text of the elements in ``root``."""
    page = Page(wrap)
    # An element stands on the stack once to be entered and once to be left; text in graphics is not drawn.
    stack: list = [(child, False, False, seen, True) for child in reversed(root.children)]
    lists: list[list[int]] = []
    while stack:
        node, left, pre, seen, drawn = stack.pop()
        if isinstance(node, str):
            if seen and drawn:
                page.lines(node) if pre else page.text(node)
            continue
        name = node.name
        if left:
            if name == "li":
                page.indents.pop()
                del page.markers[len(page.indents) :]
            elif name in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif name in ("blockquote", "dd"):
                page.indents.pop()
            elif name == "q" and seen:
                page.text("”")
            page.break_line(2 if name in SPACED and not (name in ("ul", "ol", "menu") and lists) else 1) if name in BLOCKS else None
            continue
        if not displayed(node):
            continue
        seen = shown(node, seen)
        if name == "br":
            page.line_break()
            continue
        if name == "input":
            if seen and node.attributes.get("type", "text").lower() in VALUED and node.attributes.get("value"):
                page.text(node.attributes["value"])
            continue
        if name in BLOCKS:
            page.break_line(2 if name in SPACED and not (name in ("ul", "ol", "menu") and lists) else 1)
        if name in VOID:
            continue
        if name == "table":
            page.break_line(2)
            page.lines(_table(node, seen))
            page.break_line(2)
            continue
        if name in ("td", "th"):
            page.space = True
        elif name == "svg":
            drawn = False
        elif name in DRAWN:
            page.space = page.space or not drawn
            drawn = True
        children = node.children
        if name == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
        if name in ("ul", "menu", "dir"):
            lists.append([0, 0])
        elif name == "ol":
            lists.append([1, _number(node.attributes.get("start"), 1)])
        elif name == "li":
            marker = "- "
            if lists and lists[-1][0]:
                number = _number(node.attributes.get("value"), lists[-1][1])
                marker, lists[-1][1] = f"{number}. ", number + 1
            page.markers.append(marker if seen else "  ")
            page.indents.append("  ")
        elif name in ("blockquote", "dd"):
            page.indents.append("  ")
        elif name == "q" and seen:
            page.text("“")
        elif name == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        stack.append((node, True, pre, seen, drawn))
        inner = pre or name in ("pre", "textarea", "xmp")
        stack.extend((c, False, inner, seen, drawn) for c in reversed(children))
    return page.result()


def _width(line: str) -> int:
    return len(line) if line.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in line)


def _table(node: Node, seen: bool) -> str:
    """A table's caption and other loose content, then its rows with their cells in columns."""
    rows, loose, stack = [], Node("div", {}), [(c, seen) for c in reversed(node.children)]
    while stack:
        child, inherited = stack.pop()
        if isinstance(child, str):
            if child.strip():
                loose.children.append(child)
        elif not displayed(child):
            continue
        elif child.name == "tr":
            own = shown(child, inherited)
            rows.append([(c, own) for c in child.children if isinstance(c, Node) and c.name in ("td", "th") and displayed(c)])
            loose.children.extend(c for c in child.children if (c.strip() if isinstance(c, str) else c.name not in ("td", "th")))
        elif child.name in ("thead", "tbody", "tfoot"):
            stack.extend((c, shown(child, inherited)) for c in reversed(child.children))
        elif child.name not in ("colgroup", "col"):
            loose.children.append(child)
    grid: list[list[tuple[int, list[str]]]] = []
    # Cells of earlier rows that reach down: at their first column, the column after them and the row after them.
    down: dict[int, tuple[int, int]] = {}
    widths: dict[int, int] = {}
    for number, cells in enumerate(rows):
        line, column = [], 0
        for cell, inherited in cells:
            while column in down and down[column][1] > number:
                column = down[column][0]
            text = render(cell, shown(cell, inherited), WIDEST).split("\n")
            across = max(1, min(_number(cell.attributes.get("colspan"), 1), 1000))
            high = max(1, min(_number(cell.attributes.get("rowspan"), 1), 65534))
            line.append((column, text))
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(max(map(_width, text)), WIDEST))
            if high > 1:
                down[column] = column + across, number + high
            column += across
        grid.append(line)
    out = [render(loose, seen)] if loose.children else []
    starts: dict[int, int] = {}
    place = 0
    for c in sorted({x[0] for line in grid for x in line} | widths.keys()):
        starts[c] = place
        place += widths[c] + 2 if c in widths else 0
    for line in grid:
        for k in range(max((len(text) for _, text in line), default=0)):
            made, at = [], 0
            for column, text in line:
                part = text[k] if k < len(text) else ""
                if part:
                    gap = max(starts[column] - at, 2 if made else 0)
                    made.append(" " * gap + part)
                    at += gap + _width(part)
            out.append("".join(made))
    return "\n".join(out)


def page_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: its id and its visible text."""
    short_batches(pages.sparkSession)
    run = F.pandas_udf(lambda s: pd.Series([page_text(x) for x in s], dtype=object), StringType())
    return pages.select(F.col(id_col), run(F.col(html_col)).alias("text"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op1_html_text": op1_html_text}
SQL: dict[str, str] = {}
