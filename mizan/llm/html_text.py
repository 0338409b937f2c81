"""Text of web pages as it would be laid out.

A tokenizer and a tree builder (implied end tags, void and raw-text elements,
stray end tags) make a tree; a renderer walks it, leaves out what is not shown,
and lays the rest out: paragraphs apart by a blank line, other blocks by a line
break, list items behind bullets or numbers and indented, table cells in
aligned columns, preformatted text as it stands.

Defined results: null and empty pages give an empty text; markup cut off in
the middle is closed at the end; nesting of any depth is walked with a stack;
style rules count if their selector is one of tags, classes and ids without
combinators, and not in a media block for something else than a screen; others
are ignored, so what they hide is emitted; buttons and filled-in fields show
their value;
repeated rows give repeated results; an empty table gives an empty result;
further input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import small_batches

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>?"
    r"|(?P<text>[^<]++|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SCREEN = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)\b[^{}]*\{((?:[^{}]*\{[^{}]*\})*)[^{}]*\}", re.I)
_OTHER_AT = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-zA-Z-]+)\s*(!\s*important)?", re.I)
#: Inputs whose value is not text on the page.
NO_TEXT = frozenset("hidden checkbox radio password file image range color".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript iframe object audio video canvas svg math datalist noembed noframes meta link base param source track area map".split())
#: Blocks that a blank line sets apart, and those that a line break does.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu listing xmp".split())
BLOCK = frozenset("html body div section article aside header footer main nav address form fieldset legend details summary figcaption center dir li dt dd caption hgroup search option optgroup".split()) | APART
CLOSES_P = BLOCK - frozenset("html body li dt dd caption option optgroup legend".split())
#: Start tag: open elements it ends, and the elements that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "colgroup": ({"caption", "colgroup"}, {"table"}),
}
#: An end tag does not reach out of these.
SCOPE = frozenset("td th caption table html body template".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(raw)))}


def parse(html: str) -> Node:
    """The tree of a page, under a root node."""
    root = Node("", {})
    stack, at, size, sheets = [root], 0, len(html), []

    def close(index: int) -> None:
        del stack[index:]

    def close_p() -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                return close(i)
            if stack[i].tag in SCOPE:
                return None

    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        if (text := m["text"]) is not None:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(unescape(text))
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or (tag[0] == "h" and tag[1:].isdigit() and re.fullmatch("h[1-6]", stack[i].tag)):
                    close(i)
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in CLOSES_P:
            close_p()
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if ends := IMPLIED.get(tag):
            cut = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends[1]:
                    break
                if stack[i].tag in ends[0]:
                    cut = i
            if cut:
                close(cut)
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        raw = m["attrs"] if m["tag"] else m["attrs2"]
        node = Node(tag, _attributes(raw))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inner = html[at : end.start() if end else size]
            node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
            if tag == "style":
                sheets.append(inner)
            at = end.end() if end else size
        elif tag not in VOID and not (raw.endswith("/") and tag in ("svg", "math", "path")):
            stack.append(node)
    root.attrs["sheets"] = "\n".join(sheets)
    return root


def _declarations(body: str) -> list[tuple[str, str, bool]]:
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(body)]


class Sheet:
    """The rules of a page's style elements for display and visibility, under
    the last tag, class or id of their selector."""

    def __init__(self, css: str):
        self.rules: dict[str, list] = {}
        css = _OTHER_AT.sub("", _SCREEN.sub(r"\1", _COMMENT.sub("", css)))
        for at, (selectors, body) in enumerate(_RULE.findall(css)):
            if not (found := _declarations(body)):
                continue
            for one in selectors.split(","):
                if not (m := _SELECTOR.fullmatch(one.strip())) or not m[0]:
                    continue
                parts = re.findall(r"[.#][\w-]+", m[2])
                tag = (m[1] or "*").lower()
                ids = sum(x[0] == "#" for x in parts)
                rank = (ids, len(parts) - ids, tag != "*", at)
                self.rules.setdefault(parts[-1] if parts else tag, []).append((tag, frozenset(parts), rank, found))

    def of(self, node: Node) -> dict[str, str]:
        """What the rules, and over them the style attribute, declare."""
        out: dict[str, tuple] = {}
        if self.rules:
            names = {f".{x}" for x in node.attrs.get("class", "").split()} | ({f"#{node.attrs['id']}"} if "id" in node.attrs else set())
            for key in ("*", node.tag, *names):
                for tag, parts, rank, found in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and parts <= names:
                        for name, value, important in found:
                            out[name] = max(out.get(name, ((),)), ((important, 0, *rank), value))
        for name, value, important in _declarations(node.attrs.get("style", "")):
            out[name] = max(out.get(name, ((),)), ((important, 1), value))
        return {name: value[1] for name, value in out.items()}


def hidden(node: Node, style: dict[str, str]) -> bool:
    """Whether the node and all in it take no part in the layout."""
    return node.tag in HIDDEN or style.get("display", "none" if "hidden" in node.attrs else "") == "none"


def _field(node: Node) -> str:
    """What an input shows."""
    return "" if node.attrs.get("type", "text").strip().lower() in NO_TEXT else node.attrs.get("value", "")


class Flow:
    """Lines of one column of text, with white space as a page shows it."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.indent, self.marker, self.space = 0, [], "", False

    def text(self, s: str, keep: bool) -> None:
        if keep:
            for i, line in enumerate(s.split("\n")):
                if i:
                    self.flush(force=True)
                if line:
                    self.parts.append(line)
            return
        s = _BLANKS.sub(" ", s)
        if s.startswith(" "):
            self.space = True
            s = s[1:]
        if not s:
            return
        if self.space and self.parts and not self.parts[-1].endswith(" "):
            self.parts.append(" ")
        self.space = s.endswith(" ")
        self.parts.append(s.rstrip(" "))

    def flush(self, force: bool = False) -> None:
        line, self.parts, self.space = "".join(self.parts).rstrip(), [], False
        if line or self.marker and force:
            self._put(line)
        elif force and self.lines:
            self.lines.append("")

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        indent = "".join(self.indent)
        if self.marker:
            indent, self.marker = indent[: -len(self.marker)] + self.marker, ""
        self.lines.append((indent + line).rstrip())

    def apart(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def rows(self, lines: list[str]) -> None:
        self.flush()
        for line in lines:
            self._put(line)

    def result(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows) as lines of aligned columns."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        cells, col = {}, 0
        for lines, span, down in row:
            while taken.get(col, 0):
                col += 1
            cells[col] = (lines, span)
            for c in range(col, col + span):
                taken[c] = max(taken.get(c, 0), down)
            col += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for c, (lines, span) in cells.items():
            if span == 1:
                width[c] = max([width.get(c, 0), *map(len, lines)])
    for cells in grid:
        for c, (lines, span) in cells.items():
            room = sum(width.get(k, 0) for k in range(c, c + span)) + 2 * (span - 1)
            need = max([0, *map(len, lines)])
            if need > room:
                width[c + span - 1] = width.get(c + span - 1, 0) + need - room
    start, at = {}, 0
    for c in range(max(width, default=-1) + 1):
        start[c] = at
        at += width.get(c, 0) + 2
    out = []
    for cells in grid:
        for i in range(max([0, *(len(lines) for lines, _ in cells.values())])):
            line = ""
            for c in sorted(cells):
                if i < len(cells[c][0]):
                    line = line.ljust(start.get(c, 0)) + cells[c][0][i]
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, tables, lists, keep, sheet = [Flow()], [], [], 0, Sheet(root.attrs.get("sheets", ""))
    walk: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while walk:
        node, leaving, seen = walk.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen and not (tables and tables[-1][2] == len(flows) and node.isspace()):
                flow.text(node, keep > 0)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                if lists:
                    flow.apart(1)
                    continue
            elif tag == "li":
                flow.flush(force=bool(flow.marker))
                flow.indent.pop()
            elif tag in ("blockquote", "dd"):
                flow.flush()
                flow.indent.pop()
            elif tag in ("td", "th") and tables:
                cell = flows.pop().result()
                table = tables[-1]
                if not table[0]:
                    table[0].append([])
                span, down = (min(1000, max(1, _number(node.attrs.get(k), 1))) for k in ("colspan", "rowspan"))
                table[0][-1].append((cell, span, down))
                continue
            elif tag == "caption" and tables:
                tables[-1][1] += flows.pop().result()
                continue
            elif tag == "table":
                rows, caption, _ = tables.pop()
                flow.rows(caption + _aligned(rows))
            elif tag == "pre":
                keep -= 1
            elif tag == "q":
                flow.text("”", False)
            if tag in BLOCK:
                flow.apart(2 if tag in APART else 1)
            continue
        style = sheet.of(node) if sheet.rules or "style" in node.attrs else {}
        if hidden(node, style):
            continue
        if "visibility" in style:  # what is in an unseen node can be seen again
            seen = style["visibility"] not in ("hidden", "collapse") if style["visibility"] != "inherit" else seen
        if tag == "input":
            if seen and (value := _field(node)):
                flow.text(f" {value} ", False)
            continue
        if tag == "br":
            flow.flush(force=True)
            continue
        if tag == "wbr" or tag == "img" or tag == "embed":
            continue
        if tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir") and lists
            flow.apart(1 if nested or tag not in APART else 2)
        if tag == "hr":
            continue
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag == "ol", _number(node.attrs.get("start"), 1)])
        elif tag == "li":
            mark = "- " if seen else "  "
            if lists and lists[-1][0]:
                lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1])
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            flow.marker = mark
            flow.indent.append(" " * len(mark))
        elif tag in ("blockquote", "dd"):
            flow.indent.append("  ")
        elif tag == "table":
            tables.append([[], [], len(flows)])
        elif tag == "tr" and tables:
            tables[-1][0].append([])
        elif tag in ("td", "th") and tables:
            flows.append(Flow())
        elif tag == "caption" and tables:
            flows.append(Flow())
        elif tag == "pre":
            keep += 1
        elif tag == "q":
            flow.text("“", False)
        walk.append((node, True, seen))
        children = node.children
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        walk.extend((c, False, seen) for c in reversed(children))
    return "\n".join(flows[0].result())


def extract(html: str | None) -> str:
    return render(parse(html)) if html else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield pa.record_batch([part.column(0), pa.array(map(extract, part.column(1).to_pylist()), pa.string())], ["page_id", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id and the laid-out text of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(_run, "page_id long, text string")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
