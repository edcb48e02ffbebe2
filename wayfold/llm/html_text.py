"""HTML to text by layout-aware rendering.

A tree builder takes the tokens of the page, adds implied tags (p, li, dt, dd,
option, headings, table rows and cells) and closes what is left open. Content
that stands in a table outside its cells moves before the table, as in
browsers. A renderer then walks the tree: blocks start lines, paragraphs and
headings are set off by a blank line, list items carry bullets or numbers by
depth, line breaks and preformatted text stay, and table cells are padded to
their columns, row and column spans counted.

What a browser does not show is left out: head, scripts and templates, hidden
attributes, closed details and dialogs, display:none, and visibility:hidden
unless a child is visible again, from style attributes and from the page's own
style sheets where a rule's selector is a tag, class, id or their combination.
Text hidden from assistive tools alone is visible, and so are the labels of
buttons that inputs make. Selectors of several elements and rules inside @media
are not read, so text that only they hide is emitted.

Both steps are loops over explicit stacks, whatever the nesting: open tags are
looked up by name, columns pad no wider than WIDEST, indents stop at DEEPEST,
and the cells of tables inside ALIGNED_TABLES others are plain blocks. Spans
push cells aside in the first SPANNED columns alone, and a row steps over
columns taken from above in one jump as long as none of them falls free. A table
whose padding would pass PADDING times its cells is set without padding, two
blanks between cells, so that text stays in proportion to the page. None of
these loses text.

Null pages give null text; empty pages give empty text, an empty table of pages
an empty result. Broken markup never
raises; a tag that the page's end cuts off is dropped, as in browsers. Repeated
rows are rendered each; other columns than id and page are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist area base param source track noframes noembed desc defs metadata".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address li dt dd form figcaption details summary caption center dir menu legend option optgroup dialog search hgroup tr td th".split())
ENDS_P = BLOCK - frozenset("option optgroup tr td th caption legend html body".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("table td th caption button object template html".split())
#: A start tag closes the nearest open element of the first set, unless one of the second is nearer.
CLOSES = {
    "li": (frozenset({"li"}), SCOPE | LISTS),
    "dt": (frozenset({"dt", "dd"}), SCOPE | {"dl"}),
    "dd": (frozenset({"dt", "dd"}), SCOPE | {"dl"}),
    "option": (frozenset({"option"}), SCOPE | {"select", "datalist"}),
    "optgroup": (frozenset({"option", "optgroup"}), SCOPE | {"select"}),
    "body": (frozenset({"head"}), SCOPE),
}
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
BUTTONS = frozenset("submit reset button".split())
TABLE_PARTS = SECTIONS | CELLS | {"caption", "colgroup", "col", "tr"}
TABLE_LEVELS = SECTIONS | {"table", "tr", "colgroup"}

WIDEST, DEEPEST, ALIGNED_TABLES, SPANNED, PADDING = 80, 40, 6, 1_000, 32
#: What a line of a cell counts beside its characters when padding is weighed: about the tag that made it.
LINE_COST = 5
#: Rows that a cell may span in HTML; spans of no stated end take as many.
MOST_ROWS = 65_534
BLANK = " \t\n\r\f"
SPACES = re.compile(r"[ \t\n\r\f]+")
_TAG_NAME = re.compile(r"[^ \t\n\r\f/>]+")
_GAP = re.compile(r"[ \t\n\r\f/]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\r\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\r\f]*=[ \t\n\r\f]*")
_UNQUOTED = re.compile(r"[^ \t\n\r\f>]*")
_RULE = re.compile(r"[^{}]*[{}]?")
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)", re.I)
_SHOWN = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def read_attributes(html: str, at: int) -> tuple[int, dict[str, str]]:
    """Attributes from here to the end of the tag, and the place after it; -1 where the page ends first."""
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at >= len(html):
            return -1, found
        if html[at] == ">":
            return at + 1, found
        m = _ATTRIBUTE.match(html, at)
        name, at, value = m[0].lower(), m.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            if quote and quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return -1, found
                value, at = html[at + 1 : end], end + 1
            else:
                m = _UNQUOTED.match(html, at)
                value, at = m[0], m.end()
        found.setdefault(name, unescape(value) if "&" in value else value)


def tokens(html: str) -> Iterator[tuple]:
    """(kind, value, attributes) of a page: text, start tags, end tags and style sheets."""
    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            yield "text", unescape(html[at:mark]), None
        if mark == size:
            return
        after = html[mark + 1 : mark + 2]
        if after.isascii() and after.isalpha():
            m = _TAG_NAME.match(html, mark + 1)
            tag = m[0].lower()
            at, attrs = read_attributes(html, m.end())
            if at < 0:
                return
            yield "start", tag, attrs
            if tag in RAW_TEXT or tag in ("textarea", "title"):
                end = re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I).search(html, at)
                stop = end.start() if end else size
                body = html[at:stop]
                if tag == "style":
                    yield "style", body, attrs
                elif tag == "textarea":
                    yield "text", unescape(body), None
                elif tag == "xmp":
                    yield "text", body, None
                at = stop
                if not end:
                    yield "end", tag, None
        elif after == "/":
            m = _TAG_NAME.match(html, mark + 2)
            if m and m[0][0].isascii() and m[0][0].isalpha():
                at, _ = read_attributes(html, m.end())
                if at < 0:
                    return
                yield "end", m[0].lower(), None
            else:
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
        elif html.startswith("<!--", mark):
            if html.startswith((">", "->"), mark + 4):
                at = html.find(">", mark) + 1
            else:
                end = html.find("-->", mark + 4)
                at = size if end < 0 else end + 3
        elif after in ("!", "?"):
            end = html.find(">", mark)
            at = size if end < 0 else end + 1
        else:
            yield "text", "<", None
            at = mark + 1


class Tree:
    """The page under construction: open elements by depth, and the depths of every open tag by name."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.sheets: list[str] = []

    def depth(self, names) -> int:
        """Depth of the innermost open element of these, 0 if none."""
        at = self.at
        return max((at[n][-1] for n in names if at.get(n)), default=0)

    def cut(self, depth: int) -> None:
        """Closes the element at this depth and all inside it."""
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def push(self, node: Node) -> None:
        self.place(node)
        self.at.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def place(self, child) -> None:
        """Adds a child to the open element; before the table, where that is a part of a table but no cell."""
        top = self.open[-1]
        fits = not isinstance(child, str) and child.tag in TABLE_PARTS
        if top.tag in TABLE_LEVELS and not fits and (table := self.at.get("table")):
            self.open[table[-1] - 1].children.insert(-1, child)
        else:
            top.children.append(child)

    def text(self, value: str) -> None:
        if self.open[-1].tag in TABLE_LEVELS and not value.strip(BLANK):
            return
        if self.open[-1].tag == "head" and value.strip(BLANK):
            self.cut(len(self.open) - 1)
        self.place(value)

    def start_table_part(self, tag: str, attrs: dict[str, str]) -> None:
        table = self.depth(("table",))
        if not table:
            return  # no table is open: the content flows on
        cell = self.depth(("td", "th", "caption"))
        if cell > table:
            self.cut(cell)
        section, row = self.depth(SECTIONS), self.depth(("tr",))
        if tag in CELLS:
            if row > table:
                self.cut(row + 1)
            else:
                self.cut(max(section, table) + 1)
                self.push(Node("tr", {}))
        elif tag == "tr":
            self.cut(max(section, table) + 1)
        else:
            self.cut(table + 1)
        if tag not in VOID:
            self.push(Node(tag, attrs))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "frameset", "frame") or tag == "body" and self.at.get("body"):
            return
        if tag in TABLE_PARTS:
            self.start_table_part(tag, attrs)
            return
        if tag == "form" and self.open[-1].tag in TABLE_LEVELS:
            return
        if tag == "table" and self.open[-1].tag in TABLE_LEVELS:
            self.cut(self.depth(("table",)))
        if tag in ENDS_P and self.at.get("p") and (p := self.depth(("p",))) > self.depth(SCOPE):
            self.cut(p)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            if (depth := self.depth(names)) > self.depth(stops):
                self.cut(depth)
        if self.at.get("head") and tag not in HIDDEN:
            self.cut(self.depth(("head",)))
        node = Node("img" if tag == "image" else tag, attrs)
        if tag in VOID:
            self.place(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.place(Node("br", {}))
            return
        if tag in HEADINGS:
            depth = self.depth(HEADINGS)
        else:
            depth = self.at[tag][-1] if self.at.get(tag) else 0
        if not depth or tag in ("html", "body"):
            return
        if tag in TABLE_PARTS:
            held = depth > self.depth(("table",))
        elif tag == "table":
            held = True
        elif tag in BLOCK:
            held = depth > self.depth(SCOPE - {tag} | LISTS if tag == "li" else SCOPE - {tag})
        else:
            held = not self.blocks or depth > self.blocks[-1]
        if held:
            self.cut(depth)


def build(html: str) -> Tree:
    tree = Tree()
    for kind, value, attrs in tokens(html):
        if kind == "text":
            tree.text(value)
        elif kind == "start":
            tree.start(value, attrs)
        elif kind == "end":
            tree.end(value)
        elif (attrs.get("media") or "all").strip().lower() in ("", "all", "screen"):
            tree.sheets.append(value)
    return tree


class Styles:
    """What the page's style sheets say about showing an element, for selectors of one element."""

    def __init__(self, sheets: list[str]):
        #: Weight, tag, classes, ids and values of each selector, by one name that it needs.
        self.rules: dict[str, dict[tuple, tuple]] = {}
        self.known: dict[tuple, dict[str, str]] = {}
        for order, (selectors, values) in enumerate(rule for sheet in sheets for rule in self.parsed(sheet)):
            for selector in selectors.split(","):
                m = _SELECTOR.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                parts = re.findall(r"([.#])([\w-]+)", m[2])
                classes, ids = ({n for k, n in parts if k == sign} for sign in ".#")
                tag = (m[1] or "*").lower()
                key = f"#{min(ids)}" if ids else f".{min(classes)}" if classes else tag
                same = (tag, frozenset(classes), frozenset(ids))
                older = self.rules.setdefault(key, {}).get(same, ((), {}))[1]
                self.rules[key][same] = ((len(ids), len(classes), tag != "*", order), older | values)

    @staticmethod
    def parsed(sheet: str) -> Iterator[tuple[str, dict[str, str]]]:
        """(selectors, display and visibility) of rules outside of @-blocks."""
        sheet = re.sub(r"/\*[^*]*(?:\*(?!/)[^*]*)*(?:\*/|\Z)", "", sheet)
        depth, selectors = 0, ""
        for part in _RULE.findall(sheet):
            if part.endswith("{"):
                if not depth:
                    selectors = part[:-1].rpartition(";")[2].strip()
                depth += 1
            elif part.endswith("}"):
                if depth == 1 and not selectors.startswith("@") and (values := shown_values(part[:-1])):
                    yield selectors, values
                depth = max(0, depth - 1)

    def of(self, node: Node) -> dict[str, str]:
        if not self.rules:
            return {}
        named = (node.tag, node.attrs.get("class", ""), node.attrs.get("id", ""))
        if named not in self.known:
            classes = set(named[1].split())
            keys = [node.tag, "*", *(f".{c}" for c in classes), f"#{named[2]}"]
            found = [
                rule for key in keys for (tag, needs, ids), rule in self.rules.get(key, {}).items()
                if tag in ("*", node.tag) and needs <= classes and ids <= {named[2]}
            ]
            self.known[named] = {k: v for _, values in sorted(found, key=lambda x: x[0]) for k, v in values.items()}
        return self.known[named]


def shown_values(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _SHOWN.findall(style)} if ":" in style else {}


def shown(node: Node, styles: Styles, visible: bool) -> bool | None:
    """Whether the text of a node is visible, given its parent's; None where the node is not rendered at all."""
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
        return None
    values = styles.of(node)
    if style := attrs.get("style"):
        values = values | shown_values(style)
    if values.get("display") == "none":
        return None
    wish = values.get("visibility")
    return visible if wish is None else wish not in ("hidden", "collapse") if wish != "inherit" else visible


class Canvas:
    """Lines under construction; a pending gap is 0 for none, 1 for a new line, 2 for a blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.prefix, self.gap, self.space = "", 0, False

    def block(self, gap: int) -> None:
        if self.parts:
            self.flush()
        self.space = False
        self.gap = max(self.gap, gap)

    def flush(self) -> None:
        self.lines.append("".join(self.parts).rstrip())
        self.parts, self.space = [], False

    def start(self) -> None:
        """The line's prefix, after a blank line if one is due."""
        if self.gap == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap, self.space = 0, False
        self.parts.append(self.prefix)
        if self.prefix.strip():
            self.prefix = " " * len(self.prefix)

    def words(self, text: str) -> None:
        body = SPACES.sub(" ", text)
        inner = body.strip(" ")
        if not inner:
            self.space = self.space or bool(body and self.parts)
            return
        if not self.parts:
            self.start()
        elif self.space or body[0] == " ":
            self.parts.append(" ")
        self.parts.append(inner)
        self.space = body[-1] == " "

    def line_break(self) -> None:
        if not self.parts:
            self.start()
        self.flush()

    def preformatted(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self.line_break()
            if part:
                if not self.parts:
                    self.start()
                self.parts.append(part)

    def verbatim(self, lines: list[str]) -> None:
        self.block(0)
        for text in lines:
            self.start()
            self.parts.append(text)
            self.flush()

    def text(self) -> list[str]:
        self.block(0)
        return self.lines


def columns_wide(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


class Table:
    """Cells of one table as they are rendered, and their layout."""

    def __init__(self) -> None:
        self.caption: list[str] = []
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        #: Column to the first row below the cell that reaches down into it.
        self.taken: dict[int, int] = {}
        #: Column to the next one that may be free, and the row at which some column between falls free.
        self.jumps: dict[int, tuple[int, int]] = {}

    def new_row(self) -> None:
        self.rows.append([])

    def new_section(self) -> None:
        self.taken, self.jumps = {}, {}

    def free_column(self, first: int, row: int) -> int:
        """The first column from first on that no cell above reaches down into."""
        at, until = first, MOST_ROWS * 2
        while at < SPANNED:
            if (jump := self.jumps.get(at)) and jump[1] > row:
                at, until = jump[0], min(until, jump[1])
            elif (below := self.taken.get(at, 0)) > row:
                at, until = at + 1, min(until, below)
            else:
                break
        if at > first:
            self.jumps[first] = (at, until)
        return at

    def add(self, lines: list[str], attrs: dict[str, str]) -> None:
        """Takes the next free column of the row; spans are those of HTML, 1 to 1000 columns, 1 to 65534 rows."""
        span, down = (int(v) if (v := attrs.get(k, "1")).isascii() and v.isdecimal() and len(v) < 9 else 1 for k in ("colspan", "rowspan"))
        span, down = min(max(span, 1), 1000), min(down, MOST_ROWS) if down else MOST_ROWS
        row, at = len(self.rows) - 1, 0
        if self.rows[row]:
            column, width, _ = self.rows[row][-1]
            at = column + width
        at = self.free_column(at, row)
        if down > 1 and at < SPANNED:
            for k in range(at, min(at + span, SPANNED)):
                self.taken[k] = max(self.taken.get(k, 0), row + down)
        self.rows[row].append((at, span, lines))

    def layout(self) -> list[str]:
        """One text line for each line of the tallest cell of a row; a row without any text has no line."""
        rows = [r for r in self.rows if any(lines for _, _, lines in r)]
        budget = PADDING * sum(LINE_COST + len(x) for row in rows for _, _, lines in row for x in lines or ("",))
        starts = sorted({at for row in rows for at, _, _ in row})
        place = {at: k for k, at in enumerate(starts)}
        width = [0] * len(starts)
        for row in rows:
            for at, span, lines in row:
                k = place[at]
                if k + 1 == len(starts) or at + span <= starts[k + 1]:
                    width[k] = max([width[k], *(w for x in lines if (w := columns_wide(x)) <= WIDEST)])
        offset = [0]
        for w in width:
            offset.append(offset[-1] + w + 2)
        found = self.lines_of(rows, [offset[k] for k in range(len(starts))], place, budget)
        return self.caption + (self.lines_of(rows, [0] * len(starts), place, None) if found is None else found)

    def lines_of(self, rows: list, offset: list[int], place: dict[int, int], budget: int | None) -> list[str] | None:
        """Lines with cells at their columns' offsets; None where that takes more blanks than the budget."""
        out = []
        for row in rows:
            for k in range(max(len(lines) for _, _, lines in row)):
                parts, reached = [], 0
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = max(offset[place[at]] - reached, 2 if parts else 0)
                        if budget is not None and (budget := budget - gap) < 0:
                            return None
                        parts += [" " * gap, lines[k]]
                        reached += gap + columns_wide(lines[k])
                out.append("".join(parts).rstrip())
        return out


def whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text, re.A) else None


class Renderer:
    """One walk over the tree; a stack of steps takes the place of recursion."""

    def __init__(self, styles: Styles):
        self.styles = styles
        self.canvases, self.tables = [Canvas()], []
        self.counters: list[int | None] = []
        self.prefixes: list[str] = []
        #: Open tables that are not aligned.
        self.plain = 0
        self.stack: list[tuple] = []

    def children(self, nodes: list, pre: bool, visible: bool) -> None:
        self.stack += [("node", child, pre, visible) for child in reversed(nodes)]

    def render(self, root: Node) -> str:
        self.children(root.children, False, True)
        while self.stack:
            step, node, pre, visible = self.stack.pop()
            if step != "node":
                getattr(self, step)(node)
            elif not isinstance(node, str):
                if (seen := shown(node, self.styles, visible)) is not None:
                    self.open(node, pre, seen)
            elif visible:
                (self.canvases[-1].preformatted if pre else self.canvases[-1].words)(node)
        return "\n".join(self.canvases[0].text()).strip("\n")

    def open(self, node: Node, pre: bool, visible: bool) -> None:
        canvas, tag = self.canvases[-1], node.tag
        if tag == "br":
            canvas.line_break()
        elif tag == "img":
            if visible and (alt := node.attrs.get("alt", "").strip()):
                canvas.words(alt)
        elif tag == "input":
            if visible and node.attrs.get("type", "").lower() in BUTTONS and (label := node.attrs.get("value", "").strip()):
                canvas.words(label)
        elif tag == "hr":
            canvas.block(2)
        elif tag == "table" and len(self.tables) < ALIGNED_TABLES:
            canvas.block(2)
            self.tables.append(Table())
            self.stack.append(("end_table", node, pre, visible))
            self.children(node.children, pre, visible)
        elif tag == "table":
            self.plain += 1
            self.stack.append(("end_plain", node, pre, visible))
            self.open_block(node, pre, visible)
        elif tag in TABLE_PARTS and self.tables and not self.plain:
            self.open_part(node, pre, visible)
        else:
            self.open_block(node, pre, visible)

    def open_part(self, node: Node, pre: bool, visible: bool) -> None:
        tag = node.tag
        if tag in CELLS or tag == "caption":
            self.prefixes.append("")
            self.canvases.append(Canvas())
            self.counters.append(None)
            self.stack.append(("end_cell", node, pre, visible))
        elif tag == "tr":
            self.tables[-1].new_row()
        elif tag in SECTIONS:
            self.tables[-1].new_section()
        self.children(node.children, pre, visible)

    def end_cell(self, node: Node) -> None:
        self.prefixes.pop()
        self.counters.pop()
        lines = [x for x in self.canvases.pop().text() if x.strip()]
        if node.tag == "caption":
            self.tables[-1].caption += lines
        else:
            self.tables[-1].add(lines, node.attrs)

    def end_table(self, node: Node) -> None:
        table = self.tables.pop()
        self.canvases[-1].verbatim(table.layout())
        self.canvases[-1].block(2)

    def end_plain(self, node: Node) -> None:
        self.plain -= 1

    def open_block(self, node: Node, pre: bool, visible: bool) -> None:
        canvas, tag = self.canvases[-1], node.tag
        if tag in BLOCK:
            nested = tag in LISTS and bool(self.counters) and self.counters[-1] is not None
            canvas.block(2 if tag in SPACED and not nested else 1)
            if tag in LISTS:
                first = whole_number(node.attrs.get("start"))
                self.counters.append((1 if first is None else first) if tag == "ol" else -1 << 40)
            if tag in ("li", "blockquote", "dd"):
                self.prefixes.append(canvas.prefix)
                canvas.prefix = " " * min(len(canvas.prefix), DEEPEST) + self.marker(node)
            self.stack.append(("end_nested" if nested else "end_block", node, pre, visible))
        inside = node.children
        if tag == "details" and "open" not in node.attrs:
            inside = [c for c in inside if not isinstance(c, str) and c.tag == "summary"]
        self.children(inside, pre or tag in ("pre", "textarea", "xmp"), visible)

    def marker(self, node: Node) -> str:
        """Bullet, number or indent; a negative counter far off marks a list without numbers."""
        if node.tag != "li":
            return "> " if node.tag == "blockquote" else "  "
        if not self.counters or self.counters[-1] is None or self.counters[-1] < -1 << 39:
            return "- "
        own = whole_number(node.attrs.get("value"))
        number = self.counters[-1] if own is None else own
        self.counters[-1] = number + 1
        return f"{number}. "

    def end_block(self, node: Node, gap: int | None = None) -> None:
        canvas = self.canvases[-1]
        canvas.block(gap or (2 if node.tag in SPACED else 1))
        if node.tag in LISTS:
            self.counters.pop()
        if node.tag in ("li", "blockquote", "dd"):
            canvas.prefix = self.prefixes.pop()

    def end_nested(self, node: Node) -> None:
        self.end_block(node, 1)


def extract(html: str | None) -> str | None:
    """All visible text of a page."""
    if html is None:
        return None
    tree = build(html)
    return Renderer(Styles(tree.sheets)).render(tree.root)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every row."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"page_id {kind}, text string")
