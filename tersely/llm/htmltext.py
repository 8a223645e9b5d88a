"""HTML extraction by layout-aware rendering.

A tree builder opens and closes elements as the page's tags say and where HTML implies it (a new ``li`` ends the last one,
a block ends an open paragraph).  A walk over the tree leaves out what is never shown and writes all the rest: a line for
each block, a blank line around paragraphs, headings, lists and tables, bullets and numbers for list items by depth,
preformatted text as it stands, and table cells padded to the width of their columns.  A cell that spans rows leaves its
columns empty in the rows below.

A page is read in time that grows with its length, however its tags are nested or broken.

Defined results: a null or empty page has empty text; unclosed and stray tags never fail; a tag without any ``>`` after it ends the
page, and after one whose quotes never close all tags end at their next ``>``; numbers of characters that don't exist give
U+FFFD; a nested table is part of its cell's text, and so is a list, with a dash before each item; lists deeper than ``DEEP`` are
indented as that one, and columns wider than ``WIDE`` are padded to that; rows repeat as the input does.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tersely.llm.common import table

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noframes".split())
HIDDEN = frozenset("head script style noscript template iframe object audio video canvas datalist title noframes map".split())
#: What an svg shows: text, and HTML set into it; nothing below the parts it only refers to.
WRITTEN = frozenset("text foreignobject".split())
REFERRED = frozenset("defs desc metadata symbol clippath mask marker pattern".split())
BLOCK = frozenset("address article aside body blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option tbody td tfoot th thead tr".split())
#: What a start tag ends: the open elements it closes, and the ones beyond which it doesn't look.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "body": (("head",), ("html",)),
}
#: Levels of lists that are indented, and characters that a table's column is padded to, at most.
DEEP, WIDE = 32, 200
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_LETTER = re.compile(r"/?[a-zA-Z]")
_ZEROS, _FAR = re.compile(r"&#0++(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")


def decoded(text: str) -> str:
    """``text`` with its references to characters replaced; numbers too long for any are cut short first."""
    return unescape(_FAR.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return decoded(m[2] or m[3] or m[4] or "")
        return None

    @property
    def shown(self) -> bool:
        if self.tag in HIDDEN:
            return False
        low = self.attributes.lower()
        if "hidden" in low and (self.get("hidden") is not None or (self.tag == "input" and (self.get("type") or "").lower() == "hidden")):
            return False
        return not ("style" in low and _UNSEEN.search(self.get("style") or ""))

    def span(self, name: str, low: int, high: int) -> int:
        """The number in an attribute, in the bounds that HTML sets it; 1 if there is none."""
        m = _NUMBER.match(self.get(name) or "") if name in self.attributes.lower() else None
        n = int(m[1][:9]) if m else 1
        return min(n, high) if n >= low else 1

    def parts(self) -> list:
        """The children; of an svg the written parts, each set apart."""
        if self.tag != "svg":
            return self.children
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str) or x.tag in REFERRED or not x.shown:
                continue
            if x.tag in WRITTEN:
                out += [" ", x, " "]
            else:
                todo.extend(reversed(x.children))
        return out


def tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The page's text and tags in order: ``(text, tag after it)``; the receiver may send where to go on."""
    at, begin, pattern = 0, 0, _TAG
    while (low := page.find("<", at)) >= 0:
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            stop = len(page) if end < 0 else end + 3
            m = None
        elif page.startswith(("<!", "<?"), low):
            end = page.find(">", low)
            stop = len(page) if end < 0 else end + 1
            m = None
        elif not _LETTER.match(page, low + 1):
            at = low + 1
            continue
        else:
            m = pattern.match(page, low)
            if m is None and pattern is _TAG:
                pattern = _BARE
                m = pattern.match(page, low)
            stop = m.end() if m else len(page)
        at = (yield page[begin:low], m) or stop
        begin = at
    yield page[begin:], None


class Tree:
    """The open elements, with their places by tag."""

    def __init__(self):
        self.root = Node("#root")
        self.open, self.places = [self.root], {}

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first(self, tags: Iterable[str], above: int) -> int:
        """Place of the outermost open element of these tags within the one at ``above``; 0 if there is none."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, above)) < len(p)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        for node in reversed(self.open[place:]):
            self.places[node.tag].pop()
        del self.open[place:]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def add(self, child: Node | str) -> None:
        self.open[-1].children.append(child)


CELLS = ("td", "th", "table")


def parse(page: str) -> Node:
    """The page's tree; strings among the children are text."""
    tree = Tree()
    stream = tokens(page)
    go_on = None
    while True:
        try:
            text, m = stream.send(go_on)
        except StopIteration:
            return tree.root
        go_on = None
        if text:
            tree.add(decoded(text))
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not tree.places.get("p"):
                tree.add(Node("p"))
            place = tree.last((tag,))
            # an inline end tag doesn't reach out of its cell
            if place and (tag in BLOCK or place >= tree.last(CELLS)):
                tree.close(place)
            continue
        closes, within = ENDS.get(tag, ((), ()))
        if tag in CLOSES_P:
            closes, within = (*closes, "p"), within or ("td", "th", "table", "li", "button")
        if closes and (place := tree.first(closes, tree.last(set(within) - set(closes)))):
            tree.close(place)
        node = Node(tag, m[3])
        tree.add(node)
        at = m.end()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            node.children.append(decoded(raw[raw[:1] == "\n" :]) if tag == "textarea" else raw)
            go_on = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            tree.push(node)
            if tag == "pre" and page.startswith(("\n", "\r\n"), at):
                go_on = at + (1 if page[at] == "\n" else 2)


def flat(node: Node) -> str:
    """All shown text below a node on one line."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.shown:
            if x.tag in BLOCK or x.tag == "br":
                out.append(" - " if x.tag == "li" else " ")
                todo.append(" ")
            todo.extend(reversed(x.parts()))
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def grid(node: Node) -> list[str]:
    """A table's lines, with the cells padded to the width of their columns."""
    rows: list[list[str]] = []
    before: list[str] = []
    held: dict[int, int] = {}  # rows below that a cell above still takes, by column
    covered: set[int] = set()  # such columns of the current row
    todo = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if x is None:  # a row group ends, and the cells that span rows with it
            held.clear()
        elif isinstance(x, str):
            if text := _SPACE.sub(" ", x).strip(" "):
                before.append(text)
        elif not x.shown:
            continue
        elif x.tag == "tr":
            rows.append([])
            covered = set(held)
            held = {k: n - 1 for k, n in held.items() if n > 1}
            todo.extend(reversed(x.children))
        elif x.tag in ("td", "th"):
            if not rows:
                rows.append([])
            row, wide, high = rows[-1], x.span("colspan", 1, 1000), x.span("rowspan", 0, 65534) or 1 << 60
            while len(row) in covered:
                row.append("")
            if high > 1:
                held |= dict.fromkeys(range(len(row), len(row) + wide), high - 1)
            row += [flat(x), *[""] * (wide - 1)]
        elif x.tag in ("thead", "tbody", "tfoot"):
            held.clear()
            todo.append(None)
            todo.extend(reversed(x.children))
        elif text := flat(x):
            before.append(text)
    rows = [r for r in rows if any(r)]
    widths = [0] * max(map(len, rows), default=0)
    for r in rows:
        for k, c in enumerate(r):
            widths[k] = max(widths[k], min(len(c), WIDE))
    return before + [" | ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows]


class Page:
    """Lines of output with collapsed spacing."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.lead = ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.line.append(s)

    def end(self, indent: str, keep: bool = False) -> None:
        """End the line; an empty one counts only with ``keep``."""
        line = "".join(self.line).rstrip(" ")
        self.line = []
        if line:
            self.put(indent + self.lead + line)
            self.lead = ""
        elif keep and self.lines:
            self.lines.append("")

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)


def render(page: str | None) -> str:
    """The page's visible text."""
    out = Page()
    lists: list[list] = []  # [ordered, next number] of the open lists
    pre = 0
    todo: list = [(parse(page or ""), False)]
    while todo:
        x, leaving = todo.pop()
        indent = "  " * min(max(len(lists) - 1, 0), DEEP)
        if isinstance(x, str):
            if pre:
                head, *rest = x.split("\n")
                out.line.append(head)
                for part in rest:
                    out.end(indent, keep=True)
                    out.line.append(part)
            else:
                out.text(x)
            continue
        tag = x.tag
        if leaving:
            if tag in BLOCK:
                out.end(indent)
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                out.gap |= not lists
            elif tag in SPACED:
                out.gap = True
            if tag == "li":
                out.lead = ""
            pre -= tag in ("pre", "textarea")
            continue
        if not x.shown:
            continue
        if tag == "br":
            out.end(indent, keep=True)
            continue
        if tag in BLOCK:
            out.end(indent)
        if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir", "p") and lists):
            out.gap = True
        if tag == "hr":
            out.put("---")
        elif tag == "table":
            for line in grid(x):
                out.put(indent + line)
            out.gap = True
        elif tag not in VOID:
            if tag in ("ul", "ol", "menu", "dir"):
                start = x.get("start") if tag == "ol" and x.attributes else None
                lists.append([tag == "ol", int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                out.lead = f"{lists[-1][1]}. " if lists and lists[-1][0] else "- "
                if lists:
                    lists[-1][1] += 1
            pre += tag in ("pre", "textarea")
            todo.append((x, True))
            todo.extend((c, False) for c in reversed(x.parts()))
    out.end("")
    return "\n".join(out.lines).strip("\n")


def _render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"page_id": batch.column(0), "text": pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())})


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` for every row."""
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(_render, "page_id long, text string")


def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_text(table(spark, sf_dir, "pages"))
