"""HTML extraction by layout-aware rendering.

The standard library's tokenizer reads the markup; a tree builder adds what
the markup implies (closed paragraphs, list items, table rows and cells, a
body) and keeps an element stack, so stray and missing end tags do no harm.
Visibility rules leave out what a browser would not show. The renderer emits
all visible text: inline white space collapses, blocks stand on lines of their
own, paragraphs, headings, lists and tables are set off by a blank line, list
items carry bullets or numbers and are indented by depth, preformatted text
keeps its lines, and the cells of a table are padded to columns; a cell that
spans rows keeps its columns in the rows below. Of inline SVG the text
elements and foreign objects are shown, of MathML all but the annotations; the
texts of an SVG, and the parts of a fraction or matrix, are set off by a space.

The tree is a flat event stream with explicit stacks: work and memory are
linear in the page, at any depth of nesting.

Defined results: NULL or empty html gives an empty text; a page that is cut
off anywhere gives what its readable part shows; equal rows give equal texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Element classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = set("head script style template noscript title datalist object iframe canvas audio video param source track".split())
#: Hidden in SVG or MathML only, and the elements that hold HTML (or text) in them.
FOREIGN_HIDDEN = {"svg": set("defs desc metadata symbol clippath mask marker pattern".split()),
                  "math": set("annotation annotation-xml mphantom".split())}
INTEGRATION = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Tags that end SVG and MathML where they stand directly in it.
BREAKOUT = set("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta
nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
BLOCK = set("""address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul
caption thead tbody tfoot tr td th""".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu table pre blockquote figure hr".split())
#: An opening tag closes the nearest open elements on the right, up to a limit.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
CLOSES_P = BLOCK - {"html", "body", "option", "optgroup", "legend", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
SCOPE = {"table", "td", "th", "caption", "html", "button", "object"} | INTEGRATION - {"desc", "title"}

_STYLE_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


def space_of(tag: str, parent: str) -> str:
    """What the content of an element is: "svg", "svg text", "math", or "" for HTML."""
    if tag in ("svg", "math"):
        return tag
    if parent and tag in INTEGRATION:
        return ""
    return "svg text" if parent == "svg" and tag == "text" else parent


def is_hidden(tag: str, attrs: dict, parent: str = "") -> bool:
    if parent and (tag in FOREIGN_HIDDEN[parent[:4].strip()] or attrs.get("display") == "none"
                   or attrs.get("visibility") in ("hidden", "collapse")):
        return True
    return (tag in HIDDEN or "hidden" in attrs or bool(_STYLE_HIDDEN.search(attrs.get("style") or ""))
            or tag == "input" or (tag == "dialog" and "open" not in attrs))


class _Builder(HTMLParser):
    """Markup to ('open', tag, attributes), ('close', tag, None) and ('text', data, None) events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []
        self.stack: list[str] = []
        self.open_count: dict[str, int] = {}
        self.spaces = [""]  # what each open element holds

    def _push(self, tag, attrs):
        self.spaces.append(space_of(tag, self.spaces[-1]))
        self.events.append(("open", tag, attrs))
        self.stack.append(tag)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def _pop(self):
        tag = self.stack.pop()
        self.spaces.pop()
        self.open_count[tag] -= 1
        self.events.append(("close", tag, None))

    def _close_to(self, tags: set, limits: set):
        """Close through the outermost of ``tags`` that no limit stands in front of."""
        if not any(self.open_count.get(t) for t in tags):
            return
        depth = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in tags:
                depth = k
            elif self.stack[k] in limits:
                break
        while depth is not None and len(self.stack) > depth:
            self._pop()

    def handle_starttag(self, tag, attrs):
        attrs = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if tag in ("html", "body") and self.open_count.get(tag):
            return
        if tag in BREAKOUT:
            while self.spaces[-1]:
                self._pop()
        if tag == "body" or (tag not in HIDDEN and tag not in ("html", "meta", "link", "base")):
            self._close_to({"head"}, set())
        if tag in CLOSES_P:
            self._close_to({"p"}, SCOPE)
        if tag in IMPLIED_END:
            self._close_to(*IMPLIED_END[tag])
        if tag in ("td", "th") and "table" in self.stack and not self._in_row():
            self._push("tr", {})
        if tag in VOID:
            self.events.append(("open", tag, attrs))
            self.events.append(("close", tag, None))
        else:
            self._push(tag, attrs)

    def _in_row(self):
        for t in reversed(self.stack):
            if t in ("tr", "table"):
                return t == "tr"
        return False

    def handle_startendtag(self, tag, attrs):
        depth = len(self.stack)
        foreign = self.spaces[-1] or tag in ("svg", "math")
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML
        if foreign and len(self.stack) > depth and tag not in BREAKOUT:
            self._pop()

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.events += [("open", "br", {}), ("close", "br", None)]
            return
        if not self.open_count.get(tag):
            if tag == "p":
                self.events += [("open", "p", {}), ("close", "p", None)]
            return
        limits = SCOPE - {tag} if tag not in ("table", "html", "body", "form", "div", "section", "article", "main") else {"table"} - {tag}
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k] in limits:
                return

    def handle_data(self, data):
        if self.open_count.get("head") and not self._inside_hidden_head() and data.strip():
            self._close_to({"head"}, set())
        self.events.append(("text", data, None))

    def _inside_hidden_head(self):
        return bool(self.stack) and self.stack[-1] in HIDDEN - {"head"}

    def finish(self):
        self.close()
        while self.stack:
            self._pop()
        return self.events


def width_of(text: str) -> int:
    """Columns that a line takes: wide characters two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Flow:
    """Lines of one flow of content (a page, or one table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # collapsed white space in front of the next word
        self.gap = False  # a blank line in front of the next line
        self.prefix = ""  # bullet of the next line
        self.depth: list[str] = []  # indents

    def text(self, data: str):
        parts = _SPACE.split(data)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        words = [p for p in parts if p]
        if not words:
            self.space = self.space or len(parts) > 1
            return
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = len(parts) > 1 and not parts[-1]

    def raw(self, data: str):
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for x in rest:
            self.end_line(keep_blank=True)
            self.line.append(x)

    def end_line(self, keep_blank: bool = False):
        text = "".join(self.line).rstrip(" \t\n\r\f")
        self.line, self.space = [], False
        if not text and not self.prefix and not keep_blank:
            return
        if not text and not keep_blank:
            return  # a bullet waits for its text
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        indent = "".join(self.depth)
        if self.prefix:
            indent = indent[:len(indent) - len(self.prefix)] + self.prefix
            self.prefix = ""
        self.lines.append((indent + text).rstrip())

    def block(self, spaced: bool):
        self.end_line()
        if spaced and not self.prefix:
            self.gap = True

    def rule(self, spaced_lines: list[str]):
        """Ready lines (a table) as a block of their own."""
        self.block(True)
        for x in spaced_lines:
            self.line.append(x)
            self.end_line(keep_blank=True)
        self.gap = True

    def result(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def _span(value: str | None, most: int, least: int = 1) -> int:
    return max(least, min(int(value), most)) if value and re.fullmatch(r"\s*[0-9]{1,6}\s*", value) else 1


def spread(rows: list[list[tuple[list[str], int, int]]], starts: set[int]) -> list[list[tuple[list[str], int]]]:
    """Rows of (cell lines, column span, row span) to rows of (cell lines,
    column span), with empty cells where a cell of a row above stands. A row
    span ends with its row group; ``starts`` are the first rows of the groups."""
    out, open_ = [], []  # open: (first column, end column, last row), by column
    for k, r in enumerate(rows):
        open_ = [] if k in starts else [x for x in open_ if x[2] >= k]
        line, at, i, new = [], 0, 0, []
        for cell, span, down in r:
            free = at
            while i < len(open_) and open_[i][0] <= free:
                free = max(free, open_[i][1])
                i += 1
            if free > at:
                line.append(([""], free - at))
            line.append((cell, span))
            at = free + span
            if down != 1:
                new.append((free, at, k + down - 1 if down else len(rows)))
        out.append(line)
        open_ = sorted(open_ + new) if new else open_
    return out


def table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (cell lines, column span) to aligned text lines."""
    grid = [r for r in rows if any(any(x for x in cell) for cell, _ in r)]
    widths: list[int] = []
    for r in grid:
        at = 0
        for cell, span in r:
            widths += [0] * (at + 1 - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *map(width_of, cell)])
            at += span
    out = []
    for r in grid:
        for k in range(max(len(cell) for cell, _ in r)):
            line, at, due = "", 0, 0
            for cell, span in r:
                if at:
                    line += " " * max(0, due - width_of(line))
                    line = line.rstrip(" ") + " | " if due <= width_of(line.rstrip(" ")) else line + " | "
                text = cell[k] if k < len(cell) else ""
                due = width_of(line) + sum(widths[at:at + span])
                line += text
                at += span
            out.append(line.rstrip())
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = _Builder()
    builder.feed(html)
    flows = [_Flow()]
    hidden = 0  # open elements since a hidden one
    pre = 0
    lists: list[list] = []  # [ordered, next number]
    tables: list[dict] = []
    details: list[dict] = []
    opened: list[str] = []  # what each open element has to undo
    spaces = [""]  # what each open element holds: HTML, SVG or MathML
    fractions: list[int] = []  # levels of open MathML fractions
    for what, tag, attrs in builder.finish():
        flow = flows[-1]
        # what stands directly in closed details is not shown (its summary is)
        folded = bool(details) and details[-1]["closed"] and details[-1]["level"] == len(opened)
        if what == "text":
            if not hidden and not folded and spaces[-1] != "svg":
                flow.raw(tag) if pre else flow.text(tag)
            continue
        if what == "open":
            if hidden or is_hidden(tag, attrs, spaces[-1]):
                hidden += 1
                continue
            if folded and tag != "summary":
                hidden += 1
                continue
            undo = ""
            if (spaces[-1] == "svg" and tag == "text" or spaces[-1] == "svg text" and tag == "tspan" and {"x", "y", "dy"} & set(attrs)
                    or spaces[-1] == "math" and (tag in ("mtr", "mtd") or fractions and fractions[-1] == len(opened))):
                flow.text(" ")
                undo = "apart"
            spaces.append(space_of(tag, spaces[-1]))
            if tag == "mfrac" and spaces[-1] == "math":
                fractions.append(len(opened) + 1)
                undo = undo + " fraction"
            if tag == "br":
                if flow.line:
                    flow.end_line()
                elif flow.lines and not flow.prefix:
                    flow.gap = True
            elif tag == "hr":
                flow.block(True)
            elif tag in ("ul", "ol", "menu"):
                flow.block(not lists)
                start = attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                undo = "list"
            elif tag == "li":
                flow.end_line()
                mark = "- "
                if lists and lists[-1][0]:
                    value = attrs.get("value", "")
                    lists[-1][1] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else lists[-1][1]
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.depth.append(" " * len(mark))
                flow.prefix = mark
                undo = "li"
            elif tag == "dd":
                flow.end_line()
                flow.depth.append("    ")
                undo = "indent"
            elif tag == "blockquote":
                flow.block(True)
                flow.depth.append("    ")
                undo = "indent"
            elif tag == "pre":
                flow.block(True)
                pre += 1
                undo = "pre"
            elif tag == "table":
                flow.block(True)
                tables.append({"rows": [], "starts": set()})
                undo = "table"
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1]["starts"].add(len(tables[-1]["rows"]))
                flow.block(False)
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]["rows"]:
                    tables[-1]["rows"].append([])
                flows.append(_Flow())
                undo = f"cell {_span(attrs.get('colspan'), 1000)} {_span(attrs.get('rowspan'), 65534, 0)}"
            elif tag == "details":
                flow.block(False)
                details.append({"closed": "open" not in attrs, "level": len(opened) + 1})
                undo = "details"
            elif tag == "q":
                flow.text("“")
                undo = "q"
            elif tag in BLOCK:
                flow.block(tag in SPACED)
            opened.append(undo)
            continue
        if hidden:
            hidden -= 1
            continue
        undo = opened.pop()
        spaces.pop()
        if undo.endswith("fraction"):
            fractions.pop()
        if undo.startswith("apart"):
            flow.text(" ")
        if undo.startswith("cell"):
            lines = flows.pop().result()
            tables[-1]["rows"][-1].append((lines or [""], *map(int, undo.split()[1:])))
        elif undo == "table":
            done = tables.pop()
            flows[-1].rule(table_lines(spread(done["rows"], done["starts"])))
        elif undo == "list":
            lists.pop()
            flow.block(not lists)
        elif undo in ("li", "indent"):
            flow.end_line()
            flow.prefix = ""
            flow.depth.pop()
            if tag == "blockquote":
                flow.gap = True
        elif undo == "pre":
            flow.end_line()
            flow.gap = True
            pre -= 1
        elif undo == "details":
            flow.block(False)
            details.pop()
        elif undo == "q":
            flow.line.append("”")
        elif tag in BLOCK and not (tag == "tr" and tables):
            flow.block(tag in SPACED)
    return "\n".join(flows[0].result())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [render(h) for h in b.column("h").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id`` and ``text``, one row per page row."""
    bounded_batches(pages.sparkSession)
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html}`").alias("h")
                        ).mapInArrow(_render, "page_id long, text string")


def op8_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    text = extract_text(pages)
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
