"""HTML to text as it is laid out: a tree with implied tags, visibility rules, and a block renderer."""
from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Generator, Iterator
from heapq import heappop, heappush
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .textkernel import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never shown.
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist progress meter noframes noembed rp".split())
#: Never shown inside a drawing or a formula.
HIDDEN_IN = {"svg": frozenset("desc metadata defs symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: Buttons show their value, or a word of their own.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure form fieldset".split())
PLAIN = frozenset("html body div section article aside nav header footer main address li dt dd tr caption center details summary figcaption legend hgroup menu search optgroup option thead tbody tfoot td th".split())
BLOCKS = SPACED | PLAIN
#: An opening tag closes these, if they are open inside the given scope.
CLOSES_P = (SPACED | frozenset("div section article aside nav header footer main address hr center details figcaption menu li dt dd".split())) - {"table"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
HEAD_ONLY = frozenset("head title meta link base style script template noscript".split())
SCOPE = frozenset("table td th caption button object html".split())
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important\s*)?(?=;|$)", re.I)
#: A style sheet: comments and statements without a block go; rules, and blocks inside at-rules, which aren't applied.
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
CSS_PART = re.compile(r"[^{}]*[{}]")
SIMPLE = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][a-z_-][\w-]*)*)", re.I | re.A)
WHITE = re.compile(r"[ \t\n\r\f]+")
COMMENT_END = re.compile(r"--!?>")
#: The largest colspan and rowspan of HTML.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534


class Node:
    """An element that is displayed; ``visible`` tells whether its own text can be seen, ``folded`` that only a summary can."""
    __slots__ = ("tag", "attrs", "children", "shown", "visible", "folded")

    def __init__(self, tag: str, attrs: dict[str, str | None], shown: bool = True, visible: bool = True):
        self.tag, self.attrs, self.children, self.shown, self.visible, self.folded = tag, attrs, [], shown, visible, False


def declarations(style: str | None) -> dict[str, tuple[bool, str]]:
    """``display`` and ``visibility`` of a list of declarations, with their importance: the last one counts, an important one first."""
    out: dict[str, tuple[bool, str]] = {}
    for m in DECLARED.finditer(style or ""):
        name, one = m[1].lower(), (bool(m[3]), m[2].lower())
        if one[0] or not out.get(name, (False,))[0]:
            out[name] = one
    return out


class Sheet:
    """Rules on display and visibility whose selector is a tag, classes and an id, in any combination without combinators."""

    def __init__(self, texts: list[str]):
        self.rules: dict[tuple[str, str], list] = {}
        n = 0
        for text in texts:
            selector, depth, skip = "", 0, None
            for m in CSS_PART.finditer(CSS_COMMENT.sub(" ", text)):
                part = m[0]
                if part[-1] == "{":
                    depth += 1
                    selector = part[:-1].rsplit(";", 1)[-1].strip()
                    if selector.startswith("@") and skip is None:
                        skip = depth
                    continue
                if skip is None and depth == 1 and (found := declarations(part[:-1])):
                    for one in selector.split(","):
                        n += 1
                        self._add(one.strip(), n, found)
                if skip is not None and depth <= skip:
                    skip = None
                depth = max(0, depth - 1)

    def _add(self, selector: str, n: int, found: dict) -> None:
        m = SIMPLE.fullmatch(selector)
        if not selector or not m:
            return
        tag = (m[1] or "*").lower()
        names = re.findall(r"([.#])([^.#]+)", m[2])
        ids, classes = {x for k, x in names if k == "#"}, {x for k, x in names if k == "."}
        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
        weight = (sum(k == "#" for k, _ in names), sum(k == "." for k, _ in names), tag != "*", n)
        self.rules.setdefault(key, []).append((weight, tag, ids, classes, found))

    def style(self, tag: str, attrs: dict[str, str | None]) -> dict[str, str]:
        """What rules and the element's own style say: important ones first, then its own, then the most specific, then the last."""
        own = declarations(attrs.get("style"))
        best = {name: ((important, 1, ()), value) for name, (important, value) in own.items()}
        if self.rules:
            classes, name = set((attrs.get("class") or "").split()), attrs.get("id") or ""
            for key in [("", "*"), ("", tag), ("#", name), *((".", c) for c in classes)]:
                for weight, of, ids, needed, found in self.rules.get(key, ()):
                    if of in ("*", tag) and ids <= {name} and needed <= classes:
                        for what, (important, value) in found.items():
                            rank = (important, 0, weight)
                            if what not in best or rank > best[what][0]:
                                best[what] = (rank, value)
        return {k: v for k, (_, v) in best.items()}


class Tree(HTMLParser):
    """Builds a tree of visible nodes; missing end tags are supplied, stray ones ignored."""

    def __init__(self, sheet: Sheet | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}
        self.sheet = sheet or Sheet([])
        self.styles: list[str] = []

    def pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.count[tag] -= 1

    def close(self_, tags=None, scope=frozenset()) -> None:  # noqa: N805
        if tags is None:
            super().close()
            return
        if not any(self_.count.get(t) for t in tags):
            return
        found = None
        for i in range(len(self_.open) - 1, 0, -1):
            tag = self_.open[i].tag
            if tag in tags:
                found = i
            elif tag in scope:
                break
        if found is not None:
            self_.pop_to(found)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if self.count.get("head") and tag not in HEAD_ONLY:
            self.close({"head"})
        if tag in CLOSES_P:
            self.close({"p"}, SCOPE)
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        own = dict(reversed(attrs))  # of attributes with one name the first counts
        top = self.open[-1]
        style = self.sheet.style(tag, own)
        off = "hidden" in own or tag == "dialog" and "open" not in own
        shown = top.shown and tag not in HIDDEN and (style["display"] != "none" if "display" in style else not off)
        for inside, never in HIDDEN_IN.items():
            shown = shown and not (tag in never and self.count.get(inside))
        if top.folded:  # of a closed details element the first summary alone is seen
            shown = shown and tag == "summary" and not any(isinstance(x, Node) for x in top.children)
        visible = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""), top.visible)
        node = Node(tag, own, shown, visible)
        node.folded = tag == "details" and "open" not in own
        if shown:
            top.children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and len(self.open) > 1 and self.open[-1].tag == tag and tag in ("svg", "math"):
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if not self.count.get(tag):
            if tag == "p":
                self.handle_starttag("p", [])
                self.handle_endtag("p")
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.pop_to(i)
                return
            if self.open[i].tag in ("table",) and tag not in ("table", "body"):
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.shown and not top.folded:  # what can't be seen leaves a gap
            top.children.append(data if top.visible else " ")
        elif top.tag == "style" and not self.count.get("template") and (top.attrs.get("media") or "all").strip().lower() in ("all", "screen"):
            self.styles.append(data)

    # The whole page is fed at once: what isn't closed goes to its end and shows nothing.

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def parse_html_declaration(self, i: int) -> int:
        return self._or_end(super().parse_html_declaration(i))

    def parse_pi(self, i: int) -> int:
        return self._or_end(super().parse_pi(i))

    def _or_end(self, at: int) -> int:
        return len(self.rawdata) if at < 0 else at


class Page:
    """Lines of text with collapsed white space and collapsed margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = [""]
        self.marker: str | None = None

    def text(self, data: str) -> None:
        data = WHITE.sub(" ", data)
        if data == " ":
            self.space = True
            return
        if not data:
            return
        if self.line:
            if self.space or data[0] == " ":
                self.line.append(" ")
        else:
            self.begin()
        self.line.append(data.strip(" "))
        self.space = data[-1] == " "

    def begin(self) -> None:
        if self.margin and self.lines:
            self.lines.extend([""] * self.margin)
        self.margin = 0
        if self.marker is not None:
            self.line.append(self.indent[-2] + self.marker if len(self.indent) > 1 else self.marker)
            self.marker = None
        else:
            self.line.append(self.indent[-1])
        self.space = False

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, margin: int) -> None:
        self.end()
        self.margin = max(self.margin, margin)

    def newline(self) -> None:
        if self.line:
            self.end()
        else:
            self.begin()
            self.end()

    def raw(self, data: str) -> None:
        for i, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                self.newline()
            if part:
                if not self.line:
                    self.begin()
                self.line.append(part.expandtabs(8))

    def result(self) -> list[str]:
        self.end()
        return self.lines


Lines = Generator[Node, list[str], list[str]]


def rendered(root: Node) -> list[str]:
    """The lines of a tree. Cells of tables are rendered on an explicit stack, so that depth is no limit."""
    stack, lines = [render(root)], None
    while stack:
        try:
            cell = stack[-1].send(lines)
        except StopIteration as done:
            stack.pop()
            lines = done.value
        else:
            stack.append(render(cell))
            lines = None
    return lines


def _field(attrs: dict[str, str | None]) -> str:
    """What an input element shows."""
    kind = (attrs.get("type") or "text").strip().lower()
    if kind in BUTTONS:
        return attrs.get("value") if attrs.get("value") is not None else BUTTONS[kind]
    if kind == "image":
        return attrs.get("alt") or ""
    hidden = kind in ("hidden", "checkbox", "radio", "file", "range", "color")
    if kind == "password" or hidden:
        return "" if hidden or attrs.get("value") else attrs.get("placeholder") or ""
    return attrs.get("value") or attrs.get("placeholder") or ""


def columns(line: str) -> int:
    """How many columns a line takes: wide characters take two, marks that join others none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.category(ch) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(ch) in "WF" else 1 for ch in line)


def _number(value: str | None, other: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*[+-]?\d{1,9}\s*", value, re.A) else other


def render(root: Node) -> Lines:
    """The lines of a tree, as a generator: it gives cells of tables and is sent their lines."""
    page = Page()
    pre = 0
    lists: list[list] = []  # kind, next number, step
    stack: list[tuple[Node, int]] = [(root, 0)]
    first = True
    while stack:
        node, at = stack.pop()
        if at == 0 and not first:
            tag = node.tag
            if tag == "br":
                page.newline()
                continue
            if tag == "hr":
                page.block(0)
                if node.visible:
                    page.text("---")
                page.block(0)
                continue
            if tag == "img":
                if node.attrs.get("alt") and node.visible:
                    page.text(node.attrs["alt"])
                continue
            if tag == "input":
                if node.visible and (words := _field(node.attrs)):
                    page.text(words)
                continue
            if tag == "textarea" and node.visible and not any(isinstance(x, str) and x.strip() for x in node.children):
                page.text(node.attrs.get("placeholder") or "")
            if tag == "text":  # words of a drawing stand apart
                page.space = True
            if tag == "table":
                page.block(1)
                for line in (yield from grid(node)):
                    if line:
                        page.begin()
                        page.line.append(line)
                        page.end()
                    else:
                        page.newline()
                page.block(1)
                continue
            if tag in BLOCKS:
                page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 0)
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                back = tag == "ol" and "reversed" in node.attrs
                count = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if back else 1
                lists.append([tag, _number(node.attrs.get("start"), count), -1 if back else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                if kind[0] == "ol":
                    kind[1] = _number(node.attrs.get("value"), kind[1])
                marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                page.marker = marker if node.visible else None
                kind[1] += kind[2]
                page.indent.append(page.indent[-1] + " " * len(marker))
            elif tag in ("blockquote", "dd"):
                page.indent.append(page.indent[-1] + "  ")
        first = False
        if at < len(node.children):
            stack.append((node, at + 1))
            child = node.children[at]
            if isinstance(child, str):
                page.raw(child) if pre else page.text(child)
            else:
                stack.append((child, 0))
            continue
        if not stack:
            break
        tag = node.tag
        if tag in BLOCKS:
            page.block(1 if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1) else 0)
        if tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            page.marker = None
            page.indent.pop()
        elif tag in ("blockquote", "dd"):
            page.indent.pop()
        elif tag in ("td", "th", "text"):
            page.space = True
    return page.result()


def _rows(node: Node) -> tuple[list[list[Node]], list[Node]]:
    """Row groups and captions of a table; stray content counts as a row of its own."""
    groups: list[list[Node]] = [[]]
    captions, loose = [], []

    def flush() -> None:
        if any(not isinstance(x, str) or x.strip() for x in loose):
            row, cell = Node("tr", {}), Node("td", {})
            cell.children = list(loose)
            row.children = [cell]
            groups[-1].append(row)
        loose.clear()

    for child in node.children:
        tag = child.tag if isinstance(child, Node) else ""
        if tag == "tr":
            flush()
            groups[-1].append(child)
        elif tag in ("thead", "tbody", "tfoot"):
            flush()
            more, caps = _rows(child)  # a group holds no groups: opening one closes the other
            groups += [*more, []]
            captions += caps
        elif tag == "caption":
            captions.append(child)
        elif tag in ("td", "th"):
            flush()
            row = Node("tr", {})
            row.children = [child]
            groups[-1].append(row)
        elif tag not in ("colgroup", "col"):
            loose.append(child)
    flush()
    return groups, captions


def _span(value: str | None, most: int, zero: int = 1) -> int:
    digits = re.match(r"\s*\+?(\d+)", value or "", re.A)
    if not digits:
        return 1
    return min(most, int(digits[1][:9])) or zero


class Busy:
    """Columns that cells of rows above still cover: in pieces that are covered until the same row, and in runs without gaps."""

    def __init__(self) -> None:
        self.starts: list[int] = []  # of runs
        self.ends: list[int] = []
        self.pieces: list[int] = []  # their starts
        self.piece: dict[int, tuple[int, int]] = {}  # start: end, until
        self.until: list[tuple[int, int, int]] = []

    def free_from(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.ends[k] if k >= 0 and at < self.ends[k] else at

    def cover(self, start: int, stop: int, row: int) -> None:
        """Until ``row``, or later where an older cell says so."""
        first = bisect_right(self.pieces, start) - 1
        if first < 0 or self.piece[self.pieces[first]][0] <= start:
            first += 1
        last, at, new, rest = first, start, [], []
        while last < len(self.pieces) and self.pieces[last] < stop:
            a = self.pieces[last]
            b, until = self.piece[a]
            if until >= row:
                if at < a:
                    new.append((at, a, row))
                new.append((a, b, until))
                at = b
            else:
                if a < start:
                    new.append((a, start, until))
                if b > stop:
                    rest.append((stop, b, until))
            last += 1
        if at < stop:
            new.append((at, stop, row))
        new += rest
        old = {a: self.piece.pop(a) for a in self.pieces[first:last]}
        self.pieces[first:last] = [a for a, _, _ in new]
        for a, b, until in new:
            self.piece[a] = b, until
            if old.get(a) != (b, until):
                heappush(self.until, (until, a, b))
        first = bisect_right(self.ends, start - 1)
        last = bisect_right(self.starts, stop)
        if first < last:
            start, stop = min(start, self.starts[first]), max(stop, self.ends[last - 1])
        self.starts[first:last], self.ends[first:last] = [start], [stop]

    def reach(self, row: int) -> None:
        while self.until and self.until[0][0] <= row:
            until, a, b = heappop(self.until)
            if self.piece.get(a) != (b, until):
                continue
            del self.piece[a], self.pieces[bisect_right(self.pieces, a) - 1]
            k = bisect_right(self.starts, a) - 1
            rest = [(x, y) for x, y in ((self.starts[k], a), (b, self.ends[k])) if x < y]
            self.starts[k : k + 1] = [x for x, _ in rest]
            self.ends[k : k + 1] = [y for _, y in rest]


class Widths:
    """Widths of columns, with sums of and additions to ranges of them in logarithmic time."""

    def __init__(self, n: int):
        self.n, self.flat, self.slope = n, [0] * (n + 2), [0] * (n + 2)

    def _add(self, k: int, by: int) -> None:
        flat, i = by * k, k + 1
        while i <= self.n + 1:
            self.slope[i] += by
            self.flat[i] += flat
            i += i & -i

    def add(self, a: int, b: int, by: int) -> None:
        self._add(a, by)
        self._add(b, -by)

    def upto(self, k: int) -> int:
        """Sum of the first k widths."""
        slope = flat = 0
        i = k
        while i > 0:
            slope += self.slope[i]
            flat += self.flat[i]
            i -= i & -i
        return slope * k - flat

    def need(self, a: int, b: int, width: int) -> None:
        """Columns a to b (exclusive) have ``width`` together at least; what lacks is shared out."""
        lack = width - (self.upto(b) - self.upto(a))
        if lack > 0:
            each, more = divmod(lack, b - a)
            self.add(a, b, each)
            self.add(a, a + more, 1)


def _cell(x: Node | str) -> Node:
    if not isinstance(x, str):
        return x
    cell = Node("td", {})
    cell.children = [x]
    return cell


def grid(node: Node) -> Lines:
    """A table's lines: the cells of a column start at the same place; a cell's further lines stand below its first.

    Two blanks part columns. A cell over several columns that needs more than they have widens all of them. Columns
    between which no cell begins or ends count as one.
    """
    groups, captions = _rows(node)
    out: list[str] = []
    for c in captions:
        out += yield c
    laid: list[list[tuple[int, int, list[str]]]] = []
    for rows in groups:
        busy = Busy()
        for r, row in enumerate(rows):
            busy.reach(r)
            cells, at = [], 0
            down = []
            for x in row.children:
                if isinstance(x, str) and not x.strip():
                    continue
                cell = _cell(x)
                at = busy.free_from(at)
                wide, tall = _span(cell.attrs.get("colspan"), MOST_COLUMNS), _span(cell.attrs.get("rowspan"), MOST_ROWS, MOST_ROWS)
                cells.append((at, at + wide, (yield cell)))
                if tall > 1:
                    down.append((at, at + wide, r + tall))
                at += wide
            for a, b, until in down:
                busy.cover(a, b, until)
            laid.append(cells)
    edges = sorted({x for cells in laid for a, b, _ in cells for x in (a, b)})
    column = {x: k for k, x in enumerate(edges)}
    widths = Widths(max(0, len(edges) - 1))
    for a, b, lines in sorted(((column[a], column[b], lines) for cells in laid for a, b, lines in cells), key=lambda c: (c[1] - c[0], c[0])):
        widths.need(a, b, max(map(columns, lines), default=0) + 2)
    for cells in laid:
        places = [(widths.upto(column[a]), lines) for a, _, lines in cells]
        for i in range(max((len(lines) for _, lines in places), default=0)):
            parts, end = [], 0
            for start, lines in places:
                if i < len(lines) and lines[i]:
                    gap = " " * (start - end) if start >= end else "  "
                    parts.append(gap + lines[i])
                    end += columns(parts[-1])
            out.append("".join(parts).rstrip(" "))
    return out


def html_to_text(html: str | None) -> str:
    """All visible text of a page; null and empty pages give the empty text."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if any("display" in x.lower() or "visibility" in x.lower() for x in tree.styles):  # rules may stand behind what they hide
        tree = Tree(Sheet(tree.styles))
        tree.feed(html)
        tree.close()
    return "\n".join(rendered(tree.root)).strip("\n")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            texts = [html_to_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text, one row per input row, repeated rows included; other columns are ignored.

    Visible text only: no scripts, styles, head, templates or fallback content, no element with ``hidden`` or
    ``display:none``, no closed dialog, of closed details the first summary; ``visibility`` is inherited and can be
    turned on again below. Style sheets of the page count where their selectors are tags, classes and ids; rules with
    combinators, pseudo-classes or attributes and those inside at-rules aren't applied, nor are linked sheets and scripts.
    Drawings and formulas give their text; fields and buttons their value, placeholder or word; a choice all its options. Paragraphs,
    headings, lists and tables stand between blank lines, other blocks on lines of their own; list items have
    markers (numbers follow ``start``, ``value`` and ``reversed``) and hanging indents; table cells are aligned by
    column, spans included, wide characters as two columns. Comments, tags and declarations that aren't closed go to the page's end and show
    nothing. Null and empty pages give the empty text, an empty table no rows. Pages never meet one another, so
    nothing is shuffled; depth of nesting is no limit, time is that of the page's length, and for nested tables of
    their lines times their depth.
    """
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(lean(_extract), "page_id long, text string")


def op9_html_text(spark, sf_dir):
    """``extract_text`` of all pages, with the length and hash of each text; null pages give the empty text, repeated rows come again."""
    text = extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")
