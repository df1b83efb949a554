"""Layout-aware rendering of HTML as text (operator 8).

A tokenizer that passes over a page once and a tree builder with implied end tags feed a renderer that keeps all visible
text, with blank lines between blocks, marks for list items and columns for table cells.

Visible is what a browser with scripts draws before anyone clicks, going by elements, attributes and their own style;
style sheets aren't applied, and closed details are shown. As in browsers, a tag or comment that never ends takes the rest
of the page with it, colspan counts to 1000 and rowspan to 65534, the latter in the first thousand columns. Elements more
than DEEPEST deep are built as siblings, and a table that would be nearly all blanks isn't aligned: their text stays.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, and isn't shown.
RAW = frozenset("script style noscript iframe noframes noembed".split())
#: Their content is text up to their own end tag, with references but without tags; title isn't shown in the page.
TEXT_ONLY = frozenset("textarea title".split())
#: Their content is text as it stands, without tags or references, and is shown; plaintext has no end tag.
SHOWN_RAW = frozenset("xmp plaintext".split())
#: Never shown. Title is shown by browsers in their frame, not in the page.
HIDDEN = RAW | frozenset("head title template datalist area audio video canvas object".split())
#: Within svg and math: not drawn, but names, definitions and other notations.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option xmp plaintext".split()
)
#: Blocks with a blank line before and after them.
SPACED = frozenset("xmp plaintext p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure fieldset hr".split())
#: A start tag of the first kind ends an open element of the second, up to one of the third.
_P_ENDS = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "dialog"}
_P, _HEADINGS = frozenset(["p"]), frozenset("h1 h2 h3 h4 h5 h6".split())
_SCOPE = frozenset("table td th caption html button object template".split())
_LIST = frozenset("ul ol menu dir".split()) | _SCOPE
CLOSES = {
    "li": (frozenset(["li"]), _LIST),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    **{g: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])) for g in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Deeper elements are built as children of the last one that fits.
DEEPEST = 400
#: The most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A table that would have more blanks than this for a character isn't aligned. Blanks before the lines of lists in lists, at
#: two a level: what lies deeper stands under the last of these.
MOST_BLANKS, MOST_INDENT = 16, 24

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | TEXT_ONLY | {"xmp"}}


def _number(s: str | None, default: int) -> int:
    """The whole number that an attribute begins with."""
    m = _INTEGER.match(s or "")
    return int(m.group(1)) if m else default


class Element:
    """display: whether it takes part in the page at all; visible: whether its own text is seen, None as its parent's."""

    __slots__ = ("tag", "attrs", "children", "display", "visible")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.display, self.visible = tag not in HIDDEN and tag not in UNDRAWN, None
        if tag == "object" and "data" not in self.attrs:
            self.display = True  # there is nothing to draw but what stands in its place
        if tag == "dialog" and "open" not in self.attrs or "hidden" in self.attrs:
            self.display = False
        if "style" in self.attrs:
            for rule in self.attrs["style"].lower().split(";"):
                name, _, value = rule.partition(":")
                name, value = name.strip(), value.replace("!important", "").strip()
                if name == "display" and value:
                    self.display = self.display and value != "none"
                elif name == "visibility" and value in ("visible", "hidden", "collapse"):
                    self.visible = value == "visible"


def _attributes(html: str, at: int) -> tuple[dict[str, str], int, bool]:
    """(attributes, place after the tag, whether it closes itself) of a tag whose name ends at ``at``; the place is
    -1 if the tag never ends. Of equal names the first counts."""
    out: dict[str, str] = {}
    n = len(html)
    while True:
        m = _ATTR.match(html, at)
        at, name = m.end(), m.group(1)
        if at >= n:
            return out, -1, False
        if name is None:  # at the end of the tag
            return out, at + 1, html[at - 1] == "/"
        m = _EQUALS.match(html, at)
        value = ""
        if m:
            at = m.end()
            quote = html[at : at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return out, -1, False
                value, at = html[at + 1 : end], end + 1
            else:
                m = _BARE.match(html, at)
                value, at = m.group(), m.end()
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)


def build(html: str) -> Element:
    """The tree of a page. Missing end tags are implied, stray end tags ignored, unclosed elements end with the page."""
    root = Element("html")
    stack, opened, at, n = [root], Counter(), 0, len(html)

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def close(kinds: frozenset, scope: frozenset) -> None:
        """End the outermost open element of the kinds within the scope, and all in it."""
        if not any(opened[k] for k in kinds):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in kinds:
                found = i
        if found:
            cut(found)

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip():
            cut(len(stack) - 1)
        stack[-1].children.append(unescape(s) if "&" in s else s)

    while at < n:
        i = html.find("<", at)
        # A sign that opens nothing is text.
        while i >= 0 and not (html[i + 1 : i + 2].isalpha() and html[i + 1].isascii() or html[i + 1 : i + 2] in ("/", "!", "?") and i + 1 < n):
            i = html.find("<", i + 1)
        if i < 0:
            text(html[at:])
            break
        if i > at:
            text(html[at:i])
        kind = html[i + 1]
        if html.startswith("<!--", i):
            if html.startswith((">", "->"), i + 4):
                end = html.find(">", i)
            else:
                a, b = html.find("-->", i + 4), html.find("--!>", i + 4)
                end = min(x + y for x, y in ((a, 2), (b, 3)) if x >= 0) if max(a, b) >= 0 else -1
            at = end + 1 if end >= 0 else n
            continue
        if kind in "!?" or kind == "/" and not (html[i + 2 : i + 3].isalpha() and html[i + 2].isascii()):
            if kind == "/" and i + 2 >= n:
                text("</")
                break
            end = html.find(">", i + 1)
            at = end + 1 if end >= 0 else n
            continue
        ending = kind == "/"
        m = _NAME.match(html, i + 1 + ending)
        tag = m.group().lower()
        attrs, at, closed = _attributes(html, m.end())
        if at < 0:
            break
        if ending:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            # The nearest open element of this name ends; a table's parts stop the search.
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in ("tr", "table", "thead", "tbody", "tfoot"):
                        break
            continue
        if tag in ("html", "body"):
            if tag == "body" and stack[-1].tag == "head":
                cut(len(stack) - 1)
            continue
        if tag in _P_ENDS:
            close(_P, _SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in _HEADINGS and stack[-1].tag in _HEADINGS:
            cut(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            cut(len(stack) - 1)
        element = Element(tag, attrs)
        stack[-1].children.append(element)
        if tag in _ENDS:
            m = _ENDS[tag].search(html, at)
            inside = html[at : m.start() if m else n]
            if tag not in RAW:
                element.children.append(unescape(inside) if tag in TEXT_ONLY and "&" in inside else inside)
            at = _attributes(html, m.end())[1] if m else n
            at = n if at < 0 else at
        elif tag == "plaintext":
            element.children.append(html[at:])
            at = n
        elif tag not in VOID and not closed and len(stack) < DEEPEST:
            stack.append(element)
            opened[tag] += 1
    return root


class _Writer:
    """Lines of text under the white-space rules of a page."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = 0  # blank lines asked for before the next text
        self.space = False
        self.indent = ""
        self.mark = ""

    def end(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append(self.indent + "".join(self.line).rstrip(" "))
            self.line, self.space = [], False
        if spaced and self.lines:
            self.blank = 1

    def _open(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            if self.mark:
                self.line.append(self.mark)
                self.mark = ""

    def text(self, s: str) -> None:
        words = _BLANK.split(s)
        if words == ["", ""]:
            self.space = bool(self.line)
            return
        if not words[0]:
            self.space = bool(self.line)
            words = words[1:]
        ends = not words[-1]
        if ends:
            words = words[:-1]
        self._open()
        if self.space:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = ends

    def break_line(self) -> None:
        if self.line:
            self.lines.append(self.indent + "".join(self.line).rstrip(" "))
            self.line, self.space = [], False
        elif self.lines and not self.blank:
            self.lines.append("")

    def verbatim(self, s: str) -> None:
        parts = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for i, p in enumerate(parts):
            if i:
                self.lines.append(self.indent + "".join(self.line).rstrip(" ")) if self.line else self.lines.append("")
                self.line = []
            if p:
                self._open()
                self.line.append(p)

    def rows(self, rows: list[str]) -> None:
        self.end()
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = 0
        self.lines += [self.indent + r for r in rows]

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def width(s: str) -> int:
    """Columns of a terminal: wide characters take two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _seen(e: Element, above: bool) -> bool:
    return above if e.visible is None else e.visible


def _table(element: Element, seen: bool) -> list[str]:
    """The rows of a table, cells in columns as wide as their widest one. A cell of several lines takes as many; one that
    spans columns may use the room of all, one that spans rows keeps its columns free below it."""
    rows: list[list[tuple[int, int, list[str]]]] = []  # of cells: first column, columns, lines
    captions: list[str] = []

    def cells(tr: Element, busy: list[tuple[int, int, int]], seen: bool) -> None:
        row, at, now = [], 0, len(rows)
        busy[:] = [x for x in busy if x[2] > now]
        taken = deque(sorted(busy))
        for d in tr.children:
            if isinstance(d, str):
                lines, wide, high = ([" ".join(d.split())], 1, 1) if seen and d.strip() else ([], 0, 0)
            elif d.display:
                lines = render(d, seen=_seen(d, seen)).split("\n")
                wide = min(max(1, _number(d.attrs.get("colspan"), 1)), MOST_COLUMNS)
                high = min(_number(d.attrs.get("rowspan"), 1), MOST_ROWS)
            else:
                continue
            if not lines:
                continue
            while taken and taken[0][0] <= at:
                at = max(at, taken.popleft()[1])
            row.append((at, wide, lines))
            if (high > 1 or high == 0) and at < MOST_COLUMNS:
                busy.append((at, at + wide, now + high if high else 1 << 62))
            at += wide
        rows.append(row)

    def find(e: Element, busy: list, seen: bool) -> None:
        for c in e.children:
            if isinstance(c, str):
                if seen and c.strip():
                    captions.append(" ".join(c.split()))
            elif c.display:
                if c.tag == "tr":
                    cells(c, busy, _seen(c, seen))
                elif c.tag in ("thead", "tbody", "tfoot"):
                    find(c, [], _seen(c, seen))
                elif text := render(c, seen=_seen(c, seen)):
                    captions.extend(text.split("\n"))

    find(element, [], seen)
    starts = sorted({at for r in rows for at, _, _ in r})
    wide = [0] * len(starts)
    placed = [[(bisect_left(starts, at), bisect_left(starts, at + n), lines) for at, n, lines in r] for r in rows]
    # Columns with nothing in them take no room; of those that a cell spans the last one is widened for it.
    for i, j, lines in sorted((c for r in placed for c in r), key=lambda c: c[1] - c[0]):
        used = [w for w in wide[i:j] if w]
        more = max(map(width, lines)) - sum(used) - 2 * max(0, len(used) - 1)
        if more > 0:
            wide[j - 1] += more if wide[j - 1] or not used else max(1, more - 2)
    left, out = [0], captions
    for w in wide:
        left.append(left[-1] + (w + 2 if w else 0))
    # Blanks that would be many times the text aren't worth their room.
    blanks = sum(left[c[0]] for r in placed for c in r[-1:] for _ in c[2])
    if blanks > MOST_BLANKS * sum(len(line) for r in placed for c in r for line in c[2]):
        placed = [[(0, 0, ["  ".join(line for c in r for line in c[2] if line)])] if r else [] for r in placed]
    for r in placed:
        for k in range(max((len(c[2]) for c in r), default=0)):
            line, at = "", 0
            for i, _, lines in r:
                if k < len(lines) and lines[k]:
                    line += " " * (left[i] - at) + lines[k]
                    at = left[i] + width(lines[k])
            if line or k == 0 and any(c[2][0] for c in r):
                out.append(line.rstrip())
    return out


def _options(select: Element) -> list[Element]:
    """The options that a select shows: of a list (multiple, or a size over 1) all, else the last selected one, or
    the first that isn't disabled."""
    every: list[Element] = []

    def find(e: Element) -> None:
        for c in e.children:
            if not isinstance(c, str) and c.display:
                every.append(c) if c.tag == "option" else find(c)

    find(select)
    if "multiple" in select.attrs or _number(select.attrs.get("size"), 1) > 1:
        return every
    chosen = [o for o in every if "selected" in o.attrs] or [o for o in every if "disabled" not in o.attrs][:1]
    return chosen[-1:]


#: Kinds of input that show no text of their own.
_TEXTLESS = frozenset("hidden password checkbox radio file range color image".split())


def _marker(n: int, kind: str) -> str:
    """The number of an item in a list of a type: letters and Roman numerals as far as there are some."""
    out, m = "", n
    if kind in ("a", "A") and n > 0:
        while m:
            m, letter = divmod(m - 1, 26)
            out = chr(97 + letter) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, m = out + sign * (m // value), m % value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def render(element: Element, w: _Writer | None = None, pre: bool = False, seen: bool = True) -> str:
    """All visible text of an element; ``seen``: whether its own text is, apart from that of elements in it which say so
    themselves."""
    top = w is None
    w = w or _Writer()
    step = -1 if "reversed" in element.attrs else 1
    first = sum(not isinstance(c, str) and c.tag == "li" for c in element.children) if step < 0 else 1
    number = _number(element.attrs.get("start"), first) - step if element.tag == "ol" else 0
    for c in element.children:
        if isinstance(c, str):
            if seen:
                w.verbatim(c) if pre else w.text(c)
            continue
        if not c.display:
            continue
        tag, shown = c.tag, _seen(c, seen)
        if tag == "select":
            for o in _options(c) if shown else []:
                w.text(" ")
                w.text(o.attrs.get("label") or " ".join(render(o).split()))
                w.text(" ")
        elif tag == "br":
            w.break_line()
        elif tag == "hr":
            w.end(True)
        elif tag == "img":
            if shown and c.attrs.get("alt", "").strip():
                w.text(c.attrs["alt"])
        elif tag == "input":
            if shown and c.attrs.get("type", "text").lower() not in _TEXTLESS and c.attrs.get("value"):
                w.text(c.attrs["value"])
        elif tag == "table":
            w.end(True)
            rows = _table(c, shown)
            if rows:
                w.rows(rows)
            w.end(True)
        elif tag in BLOCK:
            nested = element.tag == "li" and tag in ("ul", "ol", "menu", "dir")
            spaced = tag in SPACED and not nested
            w.end(spaced)
            old = w.indent
            if tag == "li":
                number = _number(c.attrs.get("value"), number + step)
                w.mark = "" if not shown else f"{_marker(number, c.attrs.get('type') or element.attrs.get('type', ''))}. " if element.tag == "ol" else "- "
            elif nested or tag in ("dd", "blockquote"):
                w.indent = (w.indent + "  ")[:MOST_INDENT]
            render(c, w, pre or tag == "pre" or tag in SHOWN_RAW, shown)
            w.end(spaced)
            w.indent = old
            if tag == "li":
                w.mark = ""
        else:
            render(c, w, pre or tag == "textarea", shown)
    return w.result() if top else ""


def html_to_text(html: str | None) -> str:
    """The visible text of a page; empty for a null or empty one."""
    return render(build(html)) if html else ""


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``column`` as ``name``, which replaces an input column of that name.

    Other columns stay. A null or empty page has the empty text; a page of any bytes has some. Rows are independent: ties and repeated rows need no rule. An
    empty table gives an empty one.
    """
    pages = pages.drop(name) if name != column else pages
    at = pages.columns.index(column)

    def run(batches):
        for batch in batches:
            text = pa.array([html_to_text(x) for x in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, name])

    return map_texts(pages, run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_html": op8_html}
