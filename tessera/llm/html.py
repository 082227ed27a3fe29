"""Text of HTML pages as laid out: a tree with implied tags, visibility rules, then block spacing, lists and aligned tables."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes noscript object audio video canvas svg math datalist map area meta link base".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
#: Blocks with an empty line around them.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: A start tag closes an open element of these, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "a": ({"a"}, {"table", "td", "th", "div"}),
    **dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
}
#: Start tags that close an open paragraph.
ENDS_P = BLOCK - {"body", "html", "optgroup", "option", "legend", "li"} | {"li"}
SCOPE = frozenset({"table", "td", "th", "caption", "button", "html"})

#: What may start markup, and what matters inside a tag.
_MARKUP, _NAME, _STOP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])"), re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DECLARED = re.compile(r"\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*", re.I)
_SELECTOR = re.compile(r"(?:[a-z][a-z0-9]*)?(?:[.#][\w-]+)*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


#: Elements open at a time, and frames that rendering them takes at most.
DEPTH, RECURSION = 500, 4000


def declared(body: str) -> dict[str, tuple[bool, bool]]:
    """(important, hides) of display and visibility in a list of declarations; of equal importance the last stands."""
    out: dict[str, tuple[bool, bool]] = {}
    for one in body.split(";"):
        if m := _DECLARED.fullmatch(one):
            name, value, important = m[1].lower(), m[2].lower(), bool(m[3])
            if important >= out.get(name, (False, False))[0]:
                out[name] = important, value in (("none",) if name == "display" else ("hidden", "collapse"))
    return out


class Node:
    __slots__ = ("children", "hidden", "inline", "marks", "tag")

    def __init__(self, tag: str, marks: dict[str, str] | None = None):
        self.tag, self.children, self.marks = tag, [], marks or {}
        self.hidden = tag in UNSEEN or "hidden" in self.marks or (tag == "input" and self.marks.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in self.marks)
        #: Whether only its style hides it, which a rule may overrule.
        self.inline = not self.hidden and "style" in self.marks and any(hides for _, hides in declared(self.marks["style"]).values())
        self.hidden |= self.inline


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


class Reader:
    """Reads markup from a page, in time in proportion to its length."""

    def __init__(self, source: str):
        self.source = source
        self.last_quote = {q: source.rfind(q) for q in "\"'"}

    def end_of_tag(self, at: int) -> int:
        """Place after the > that ends a tag: outside quotes, where a quote that nothing closes is an ordinary character. The end of the page, if there is none."""
        while m := _STOP.search(self.source, at):
            if m[0] == ">":
                return m.end()
            at = self.source.find(m[0], m.end()) + 1 if self.last_quote[m[0]] > m.start() else m.end()
        return len(self.source) + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the next piece of markup from a place on; kind is "", "start" or "end"."""
        m = _MARKUP.search(self.source, at)
        if not m:
            return None
        begin = m.start()
        if m[0] == "<!--":
            stop = self.source.find("-->", begin + 2)
            return begin, len(self.source) if stop < 0 else max(stop, begin + 2) + 3, "", "", ""
        if m[0][1] in "!?":
            stop = self.source.find(">", begin)
            return begin, len(self.source) if stop < 0 else stop + 1, "", "", ""
        closing = m[0][1] == "/"
        name = _NAME.match(self.source, begin + 1 + closing)
        stop = self.end_of_tag(name.end())
        if stop > len(self.source):
            return begin, len(self.source), "", "", ""  # a tag that never ends shows nothing
        return begin, stop, "end" if closing else "start", name[0].lower(), self.source[name.end() : stop - 1]


def plain_rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet in order. Comments and at-rules with what they hold are left out."""
    sheet = re.sub(r"/\*.*?(?:\*/|$)", "", sheet, flags=re.S)
    plain, depth, skip = [], 0, None
    for part in re.split(r"([{}@;])", sheet):
        if part == "@" and skip is None:
            skip = depth
        depth += (part == "{") - (part == "}")
        if skip is None:
            plain.append(part)
        elif depth == skip and part in "};" and part:
            skip = None
    for rule in "".join(plain).split("}")[:-1]:
        head, brace, body = rule.rpartition("{")
        if brace:
            yield head.rpartition("{")[2], body


class Sheets:
    """Rules of style sheets whose selector is a tag, classes and an id of one element, for display and visibility.

    A rule is filed once, under the one of its tag, classes and id that the fewest rules name, so that an element is tried only on rules filed under a name of its own. Rules of one
    selector are one. The strongest declaration of each property wins: important ones first, then by id, number of classes, tag, and place.
    """

    def __init__(self, sheets: list[str]):
        found: dict[tuple[str, frozenset[str]], dict[str, tuple]] = {}
        for place, (selectors, body) in enumerate(rule for sheet in sheets for rule in plain_rules(sheet)):
            if not (what := declared(body)):
                continue
            for one in selectors.lower().split(","):
                one = one.strip()
                if not one or not _SELECTOR.fullmatch(one):
                    continue
                tag, names = re.match(r"[a-z0-9]*", one)[0], re.findall(r"[.#][\w-]+", one)
                ids = sum(n[0] == "#" for n in names)
                kept = found.setdefault((tag, frozenset(names)), {})
                for prop, (important, hides) in what.items():
                    kept[prop] = max(kept.get(prop, ()), ((important, ids, len(names) - ids, bool(tag), place), hides))
        named: dict[str, int] = {}
        for tag, names in found:
            for name in (*names, *([tag] if tag else [])):
                named[name] = named.get(name, 0) + 1
        self.filed: dict[str, list[tuple[str, frozenset[str], dict[str, tuple]]]] = {}
        for (tag, names), what in found.items():
            under = min((*names, *([tag] if tag else [])), key=lambda n: (named[n], n))
            self.filed.setdefault(under, []).append((tag, names, what))

    def hides(self, node: Node) -> bool:
        own = {node.tag, *("." + c for c in node.marks.get("class", "").lower().split())}
        if "id" in node.marks:
            own.add("#" + node.marks["id"].lower())
        best = {prop: ((important, 1 << 30), hides) for prop, (important, hides) in declared(node.marks.get("style", "")).items()}
        for name in own:
            for tag, names, what in self.filed.get(name, ()):
                if (not tag or tag == node.tag) and names <= own:
                    for prop, one in what.items():
                        best[prop] = max(best.get(prop, ()), one)
        return any(hides for _, hides in best.values())


def apply_rules(root: Node, sheets: Sheets) -> None:
    """Hides what the sheets hide. What its tag or an attribute other than its style hides stays hidden."""
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [c for c in node.children if isinstance(c, Node)]
        if node.inline or not node.hidden:
            node.hidden = sheets.hides(node)


def tree(source: str) -> Node:
    """Builds the tree. Missing html, head, body, tbody, tr and end tags are implied; stray end tags are ignored; what follows an unclosed tag sits inside it."""
    html = Node("html")
    head, body = Node("head"), Node("body")
    html.children = [head, body]
    stack, at, in_head, reader, sheets = [body], 0, True, Reader(source), []

    def close(tags: set[str], stop: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return close(tags, stop)
            if stack[i].tag in stop:
                return None
        return None

    def say(text: str) -> None:
        nonlocal in_head
        if text:
            if text.strip():
                in_head = False
            stack[-1].children.append(unescape(text))

    while at < len(source):
        found = reader.next(at)
        if not found:
            say(source[at:])
            break
        begin, stop, kind, name, inside = found
        if begin > at:
            say(source[at:begin])
        at, end, start = stop, name if kind == "end" else "", name if kind == "start" else ""
        if end:
            if end == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            elif end == "br":
                stack[-1].children.append(Node("br"))
            elif end not in ("body", "html", "head"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == end or (end in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[i].tag)):
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and end not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
                        break
                    if stack[i].tag == "table":
                        break
        elif start:
            tag = start
            marks = attributes(inside) if inside else {}
            if tag in ("html", "head", "body"):
                in_head = in_head and tag != "body"
                if tag != "head":
                    (body if tag == "body" else html).hidden |= Node(tag, marks).hidden
                continue
            if tag in HEAD and in_head:
                where = head
            else:
                in_head = False
                if tag in ENDS_P:
                    close({"p"}, SCOPE)
                if tag in CLOSES:
                    close(*CLOSES[tag])
                if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1].tag) and len(stack) > 1:
                    stack.pop()
                if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    stack.append(row := Node("tr"))
                    stack[-2].children.append(row)
                where = stack[-1]
            where.children.append(node := Node(tag, marks))
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                inner = source[at : stop.start() if stop else len(source)]
                node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
                if tag == "style":
                    sheets.append(inner)
                at = stop.end() if stop else len(source)
            elif tag not in VOID and len(stack) < DEPTH:
                if where is not head or tag == "template":
                    stack.append(node)
    if sheets and (rules := Sheets(sheets)).filed:
        apply_rules(html, rules)
    return html


class Page:
    """Collects lines; knows whether a blank line or a space is due."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.blank = "", False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.line += first
            for x in rest:
                self.push(True)
                self.line = x
            return
        s = _BLANKS.sub(" ", s)
        self.line += s.lstrip(" ") if not self.line or self.line.endswith(" ") else s

    def push(self, keep: bool = False) -> None:
        line = self.line.rstrip(" ")
        if line or keep:
            if self.blank and self.lines and self.lines[-1] != "":
                self.lines.append("")
            self.blank = False
            self.lines.append(line)
        self.line = ""

    def gap(self) -> None:
        self.push()
        self.blank = True

    def done(self) -> str:
        self.push()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def cell_width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


SECTIONS = ("tbody", "thead", "tfoot")
#: Between rows and cells these are no boxes of their own.
SEE_THROUGH = ("form", *SECTIONS)


def rows_of(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag == "tr":
                yield c
            elif c.tag in SEE_THROUGH:
                yield from rows_of(c)


def cells_of(row: Node) -> Iterator[Node]:
    for c in row.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag in ("td", "th"):
                yield c
            elif c.tag == "form":
                yield from cells_of(c)


def strays(node: Node) -> Iterator[str | Node]:
    """What a table holds outside its cells and captions, in order."""
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                yield c
        elif not c.hidden:
            if c.tag in ("tr", *SECTIONS) or (c.tag == "form" and any(isinstance(x, Node) and x.tag in ("tr", "td", "th", *SECTIONS) for x in c.children)):
                yield " "
                yield from strays(c)
                yield " "
            elif c.tag not in ("td", "th", "caption", "colgroup", "col"):
                yield c


def number(s: str, least: int) -> int:
    return min(1000, max(least, int(s))) if s.strip().isdigit() else least


def table_lines(node: Node) -> list[str]:
    """Rows as lines, their cells padded to columns two spaces apart; cells of several lines go on below; column and row spans keep their places."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for tr in rows_of(node):
        row: dict[int, tuple[list[str], int]] = {}
        col, down = 0, {k: v - 1 for k, v in held.items() if v > 1}
        for c in cells_of(tr):
            while held.get(col, 0) > 0:
                col += 1
            span, deep = number(c.marks.get("colspan", ""), 1), number(c.marks.get("rowspan", ""), 1)
            row[col] = (render(c).split("\n"), span)
            if deep > 1:
                down.update(dict.fromkeys(range(col, col + span), deep - 1))
            col += span
        held = down
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for col, (lines, span) in row.items():
            if span == 1:
                widths[col] = max(widths.get(col, 0), *map(cell_width, lines))
    ordered, at, place = sorted({c + k for row in grid for c, (_, s) in row.items() for k in range(s)}), 0, {}
    for c in ordered:
        place[c] = at
        at += widths.get(c, 0) + 2 if c in widths else 0
    out = []
    for row in grid:
        for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
            line, used = "", 0
            for col in sorted(row):
                part = row[col][0][i] if i < len(row[col][0]) else ""
                if part:
                    pad = max(place[col] - used, 2 if used else 0)
                    line += " " * pad + part
                    used += pad + cell_width(part)
            out.append(line)
    return out


def options_of(node: Node) -> Iterator[Node]:
    for c in node.children:
        if isinstance(c, Node) and not c.hidden:
            if c.tag == "option":
                yield c
            else:
                yield from options_of(c)


def put(node: Node, page: Page, pre: bool, lists: tuple) -> None:
    for c in node.children:
        if isinstance(c, str):
            page.text(c, pre)
            continue
        if c.hidden:
            continue
        if c.tag == "br":
            page.push(True)
        elif c.tag == "hr":
            page.gap()
        elif c.tag == "img":
            page.text(c.marks.get("alt", ""), False)
        elif c.tag == "input":
            if c.marks.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel"):
                page.text(c.marks.get("value") or "", False)
        elif c.tag == "table":
            page.gap()
            for cap in (x for x in c.children if isinstance(x, Node) and x.tag == "caption" and not x.hidden):
                put(cap, page, pre, ())
                page.push()
            for x in strays(c):  # it stands before the table
                holder = Node("div")
                holder.children = [x]
                put(holder, page, pre, lists)
            page.push()
            for line in table_lines(c):
                page.line = line
                page.push()
            page.gap()
        elif c.tag in ("ul", "ol", "menu"):
            (page.push if lists else page.gap)()
            start = c.marks.get("start", "")
            put(c, page, pre, (*lists, [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if c.tag == "ol" else None))
            (page.push if lists else page.gap)()
        elif c.tag == "li":
            page.push()
            mark = "- "
            if lists and lists[-1] is not None:
                value = c.marks.get("value", "")
                lists[-1][0] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[-1][0]
                mark = f"{lists[-1][0]}. "
                lists[-1][0] += 1
            page.line = "  " * max(0, len(lists) - 1) + mark
            before, bare = len(page.lines), page.line
            put(c, page, pre, lists)
            if len(page.lines) == before and page.line == bare:
                page.line = ""
            page.push()
        elif c.tag == "details" and "open" not in c.marks:
            page.push()
            for x in [x for x in c.children if isinstance(x, Node) and x.tag == "summary"][:1]:
                put(x, page, pre, lists)
            page.push()
        elif c.tag == "select" and "multiple" not in c.marks and number(c.marks.get("size", ""), 1) == 1:
            options = list(options_of(c))
            for x in ([x for x in options if "selected" in x.marks] or options)[:1]:
                put(x, page, False, lists)
        elif c.tag in BLOCK:
            inside_item = c.tag == "p" and page.line.lstrip() and re.fullmatch(r"\s*(?:-|\d+\.) ", page.line)
            if not inside_item:
                (page.gap if c.tag in SPACED else page.push)()
            if c.tag == "dd":
                page.line = "  "
            put(c, page, pre or c.tag == "pre", lists)
            (page.gap if c.tag in SPACED else page.push)()
        else:
            put(c, page, pre or c.tag == "textarea", lists)


def render(node: Node) -> str:
    page = Page()
    if not node.hidden:
        put(node, page, False, ())
    return page.done()


def text_of(source: str | None) -> str:
    if sys.getrecursionlimit() < RECURSION:
        sys.setrecursionlimit(RECURSION)
    return render(tree((source or "").replace("\r\n", "\n").replace("\x00", "")))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns of ``keep``, text (all visible text as laid out) and n_chars. No shuffle; each page on its own.

    Hidden: what browsers don't show (head, script, style, template, media and the like), the hidden attribute, display:none and
    visibility:hidden, inline or by the strongest rule of the style sheets for its tag, classes and id, closed dialogs, all but the summary of closed details, all but the chosen option of a
    select. What stands in a table outside its cells comes before it. Paragraphs, headings, lists, tables and the like have an empty line around them, other blocks a line of their
    own; white space collapses except in pre; list items get "- " or their number, indented by depth; table cells are aligned in columns.

    A null or empty page gives an empty text. Broken markup never fails: unclosed tags end with their parents, an unclosed comment, tag or raw element runs to the
    end, a quote that nothing closes counts as a letter. Nesting beyond 500 elements is read as if closed. Repeated rows return each; very long pages are read whole. An empty table gives an
    empty result. Other columns are ignored; ``keep`` must not name text or n_chars.
    """
    rows = pages.select(pages[id_col], *(pages[c] for c in keep), pages[html_col].alias("_html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [text_of(h) for h in b["_html"]]
            yield b.drop(columns="_html").assign(text=texts, n_chars=[len(t) for t in texts])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")
    return rows.mapInPandas(run, f"{kinds}, text string, n_chars long")
