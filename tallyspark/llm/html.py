"""Layout-aware rendering of HTML to text (operator 8)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template title iframe object audio video canvas datalist noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary "
                  "table ul caption tr thead tbody tfoot xmp plaintext listing".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul fieldset menu".split())
#: White space inside stands as written.
PRE = frozenset("pre xmp plaintext listing textarea".split())
#: Start tags that end an open element of the named kinds, unless one of the
#: fences is met first.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    **{k: ({"select"}, {"table"}) for k in ("select", "input", "textarea")},
    **{k: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"})
       for k in ("thead", "tbody", "tfoot", "caption", "colgroup", "col")},
}
#: Elements that hold parts of a table only; what else stands there goes before the table.
FRAME = frozenset("table thead tbody tfoot tr".split())
PARTS = FRAME - {"table"} | {"td", "th", "caption", "colgroup", "col"}
#: Where a search for the table around ends.
APART = frozenset("td th caption template svg math".split())
UNSEEN = frozenset("script style template".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - {"body", "html", "tr", "thead", "tbody", "tfoot", "caption", "legend"} | {"hr"}
SCOPE = frozenset("table td th caption button object html".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
#: What a head's noscript may hold; anything else belongs to the body.
HEAD_NOSCRIPT = frozenset("link meta style noframes".split())
#: Elements of svg and math in which html goes on, html that ends them, and
#: parts of them that are not drawn.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                         "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter "
                    "annotation annotation-xml".split())
#: Parts of a formula that stand above or beside each other.
STACKED = frozenset("mfrac msup msub msubsup munder mover munderover mroot mtr mtable".split())
#: Input fields that show their value, or else their placeholder.
FIELDS = frozenset("text search url tel email number date month week time datetime-local".split())
BUTTONS = frozenset("submit button reset".split())
#: Values of display that show an element.
SHOWN = frozenset("block inline inline-block flow-root list-item flex inline-flex grid inline-grid contents table "
                  "inline-table table-row table-cell table-caption table-row-group initial unset revert".split())

#: Elements nested deeper stand beside what they would stand in, as in browsers.
DEPTH = 512
#: A table is padded with at most that many spaces for each of its characters
#: (a cell counts as two more); beyond it, its widest cells stand out of their columns.
PADDING = 16

#: An attribute: a name, and after "=" a value in quotes or up to white space or
#: the tag's end.  Anywhere else a quote is a character like others; one that is
#: never closed is part of an unquoted value.
_ATTR = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+"
                   r"(?:\"([^\"]*+)\"|'([^']*+)'|([^ \t\n\f\r>]++)))?+")
_GAP = re.compile(r"[ \t\n\f\r/]*+")
_NAME_END = re.compile(r"[ \t\n\f\r/>]")
_COMMENT_END = re.compile(r"--!?>")
_WHITE = re.compile(r"[ \t\n\f\r]+")
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*+\"?+|'[^']*+'?+|\([^)]*+\)?+)++")


def declared(style: str) -> dict[str, str]:
    """Properties of a style attribute: the last of a name, or the last important one."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _DECLARATION.findall(re.sub(r"/\*.*?(?:\*/|\Z)", "", style, flags=re.S)):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if not colon:
            continue
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        if important or not out.get(name, (False,))[0]:
            out[name] = (important, value)
    return {k: v for k, (_, v) in out.items()}


class Node:
    """``hidden``: neither it nor what it holds is shown.  ``seen``: whether its
    own text is visible; None is as around it."""

    __slots__ = ("name", "attrs", "kids", "hidden", "seen")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.kids = name, attrs or {}, []
        style = declared(self.attrs["style"]) if "style" in self.attrs else {}
        display = style.get("display")
        away = "hidden" in self.attrs or (name == "dialog" and "open" not in self.attrs)
        self.hidden = name in HIDDEN or display == "none" or (away and display not in SHOWN)
        self.seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""))


class _Tags:
    """Tags of a page, each found in time that is linear over the whole page.

    A tag that runs to the page's end without ending is no tag: its "<" is text.
    The places between its attributes are remembered, so another one that comes
    to such a place is given up at once.
    """

    def __init__(self, html: str):
        self.html = html
        self.dead: set[int] = set()
        self.name_end = -1
        self.last_end = html.rfind(">")

    def tag(self, at: int) -> tuple[str, list[tuple], bool, int] | None:
        """Name, attributes, whether it closes itself, and end of the tag whose name begins at ``at``."""
        html = self.html
        if at > self.last_end:
            return None
        if self.name_end < at:
            m = _NAME_END.search(html, at)
            self.name_end = m.start() if m else len(html)
        b, passed, attrs = self.name_end, [], []
        name = (at, b)
        while True:
            b = _GAP.match(html, b).end()
            if b == len(html) or b in self.dead:
                self.dead.update(passed)
                return None
            if html[b] == ">":
                return html[slice(*name)].lower(), attrs, html[b - 1] == "/", b + 1
            passed.append(b)
            m = _ATTR.match(html, b)
            attrs.append(m.groups(""))
            b = m.end()

    def after_markup(self, at: int) -> int:
        """End of the comment, declaration or broken end tag that begins at ``at``."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith(">", at + 4):
                return at + 5
            if html.startswith("->", at + 4):
                return at + 6
            m = _COMMENT_END.search(html, at + 4)
            return m.end() if m else len(html)
        end = html.find(">", at)
        return end + 1 if end >= 0 else len(html)


def parse(html: str) -> Node:
    """The document's tree; start and end tags that HTML lets authors leave out
    are implied, what is never closed ends with its parent.  A table's part ends
    all but the table's frame (a form or link round a cell), and what stands in
    the frame itself goes before the table, as in browsers."""
    root = Node("html")
    stack = [root]

    def pop_to(names, fences) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                del stack[i:]
                return True
            if stack[i].name in fences:
                return False
        return False

    def around() -> int:
        """Place of the table whose frame is the open element; 0 if none."""
        if stack[-1].name in FRAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "table":
                    return i
                if stack[i].name in APART:
                    break
        return 0

    def leave_head(name: str) -> None:
        """What a head may not hold ends it; ``name``: of an element, or empty for text."""
        if name and stack[-1].name == "noscript" and stack[-2].name == "head" and name not in HEAD_NOSCRIPT:
            stack.pop()
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            stack.pop()

    gap = False  # a part of a table began or ended since something went before it

    def add(kid: Node | str) -> None:
        nonlocal gap
        text = isinstance(kid, str)
        blank = text and not kid.strip(" \t\n\f\r")
        if not blank:
            leave_head("" if text else kid.name)
        if stack[-1].name == "colgroup" and not blank and (text or kid.name not in ("col", "template")):
            stack.pop()
        i = 0 if not text and (kid.name in PARTS or kid.name in UNSEEN) else around()
        if not i:
            stack[-1].kids.append(kid)
        elif blank:
            gap = True
        else:
            stack[i - 1].kids[-1:-1] = [" ", kid] if gap else [kid]  # the table is the last
            gap = False

    def foreign() -> bool:
        """Whether the open element is part of an svg or a formula."""
        if any_foreign:
            for n in reversed(stack):
                if n.name in HTML_INSIDE:
                    return False
                if n.name in ("svg", "math"):
                    return True
        return False

    html = html.replace("\r\n", "\n").replace("\r", "\n")
    tags, any_foreign = _Tags(html), False
    at = look = 0
    while at < len(html):
        look = html.find("<", look)
        if look < 0:
            add(unescape(html[at:]))
            break
        after = html[look + 1:look + 3]
        start, close = after[:1], after[:1] == "/"
        found = None
        if start.isascii() and start.isalpha() or close and after[1:].isascii() and after[1:].isalpha():
            found = tags.tag(look + 1 + close)
        if found is None and start not in ("!", "?", "/"):
            look += 1
            continue
        if look > at:
            add(unescape(html[at:look]))
        at = look = found[3] if found else tags.after_markup(look)
        if not found:
            continue
        name, pairs, own_end, _ = found
        if close:
            gap = gap or name in PARTS
            if name == "br":
                add(Node("br"))
            elif name == "p" and not any(n.name == "p" for n in stack):
                add(Node("p"))
            elif name not in ("html", "body"):
                pop_to({name}, {"table"} if name not in ("table", "html") else ())
            continue
        attrs = {}
        for k, x, y, z in pairs:
            attrs.setdefault(k.lower(), unescape(x or y or z))
        inside = foreign()
        if inside and name in ENDS_FOREIGN:
            while foreign():
                stack.pop()
            inside = False
        if name in ("html", "body"):
            own = root if name == "html" else next((n for n in stack[1:2] if n.name == "body"), None)
            if own is not None:
                own.attrs.update({k: v for k, v in attrs.items() if k not in own.attrs})
                continue
            pop_to({"head"}, ())
        else:
            leave_head(name)
        if not inside:
            if name in ENDS_P:
                pop_to({"p"}, SCOPE)
            if name == "table":
                gap = True
                pop_to({"table"}, APART)
            elif name in PARTS:
                gap = True
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in FRAME:
                        del stack[i + 1:]
                    if stack[i].name in FRAME or stack[i].name in APART:
                        break
            if name in CLOSES:
                for _ in range(3):
                    if not pop_to(*CLOSES[name]):
                        break
            if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr")
                stack[-1].kids.append(row)
                stack.append(row)
        node = Node(name, attrs)
        if (inside and name in UNDRAWN) or (name == "noscript" and stack[-1].name == "head"):
            node.hidden = True
        if name == "form" and around():  # holds nothing there
            gap = True
            continue
        add(node)
        if name in VOID or (own_end and (inside or name in ("svg", "math"))):
            continue
        if name in RAW:
            end, stop = None, -1
            if name != "plaintext":
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", end.end()) if end else -1
            text = html[at:end.start() if stop >= 0 else len(html)]
            node.kids.append(unescape(text) if name == "textarea" else text)
            at = look = stop + 1 if stop >= 0 else len(html)
            continue
        any_foreign = any_foreign or name in ("svg", "math")
        if len(stack) < DEPTH:
            stack.append(node)
    return root


def width(text: str) -> int:
    """Columns that the text takes: two for wide characters, none for marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class _Page:
    """Lines under way: ``gap`` counts the line breaks due before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, "", ""

    def line(self, n: int = 1) -> None:
        self.gap, self.space = max(self.gap, n), False

    def text(self, t: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(t.split("\n")):
                if i:
                    self.out_break()
                if part:
                    self.put(part)
            return
        t = _WHITE.sub(" ", t)
        if t.startswith(" "):
            self.space = self.space or (bool(self.out) and not self.gap)
        body = t.strip(" ")
        if body:
            self.put((" " if self.space and not self.gap else "") + body)
            self.space = t.endswith(" ")

    def out_break(self) -> None:
        if self.gap:
            self.gap += 1
        else:
            self.gap = 1
        self.space = False

    def put(self, t: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            self.out.append(self.indent[:max(0, len(self.indent) - len(self.mark))] + self.mark)
            self.mark = ""
            self.gap = 0
        self.out.append(t)
        self.space = False


def _table_rows(node: Node, seen: bool) -> tuple[list[list[tuple[Node, bool]]], list[tuple[Node, bool]]]:
    """Rows of cells, and captions, each with whether text is visible round it;
    the parser leaves no other text in a table's frame."""
    rows, captions, todo = [], [], [(k, seen) for k in reversed(node.kids)]
    while todo:
        k, own = todo.pop()
        if isinstance(k, str) or k.hidden:
            continue
        inner = own if k.seen is None else k.seen
        if k.name == "tr":
            rows.append([(c, inner) for c in k.kids if isinstance(c, Node) and c.name in ("td", "th") and not c.hidden])
        elif k.name in ("thead", "tbody", "tfoot"):
            todo.extend((x, inner) for x in reversed(k.kids))
        elif k.name == "caption":
            captions.append((k, own))
    return rows, captions


def _span(cell: Node) -> int:
    n = cell.attrs.get("colspan", "1").strip()
    return max(1, min(int(n), 1000)) if n.isascii() and n.isdigit() and len(n) < 6 else 1


def _table(page: _Page, node: Node, seen: bool) -> None:
    """Rows with their cells padded to the width of their column; a cell of
    several lines goes on below, a spanning cell takes its columns together.
    Columns are only as wide as ``PADDING`` allows for the whole table."""
    rows, captions = _table_rows(node, seen)
    page.line(2)
    for k, own in captions:
        _walk(page, k, own)
        page.line()
    cells = [[(render(c, own).split("\n"), _span(c), c.attrs.get("align", "").lower()) for c, own in row] for row in rows]
    wide: dict[int, int] = {}
    text = 0
    for row in cells:
        col = 0
        for lines, n, _ in row:
            if n == 1:
                wide[col] = max(wide.get(col, 0), *(width(x) for x in lines))
            col += n
            text += 2 + sum(len(x) - x.count(" ") for x in lines)
    places = sorted(wide)

    def rooms(limit: int) -> list[list[int]]:
        """Columns that each cell takes, its row's cells in order."""
        upto = [0, *accumulate(min(wide[c], limit) + 2 for c in places)]
        out = []
        for row in cells:
            col, own = 0, []
            for _, n, _ in row:
                a, b = bisect_left(places, col), bisect_left(places, col + n)
                own.append(max(0, upto[b] - upto[a] - 2))
                col += n
            out.append(own)
        return out

    limit = max(wide.values(), default=0)
    room = rooms(limit)
    while limit and sum(max(map(len, (x for x, _, _ in row))) * sum(own) for row, own in zip(cells, room, strict=True)
                        if row) > PADDING * text:
        limit //= 2
        room = rooms(limit)
    for row, own in zip(cells, room, strict=True):
        if not any(any(lines) for lines, _, _ in row):
            continue
        page.line()
        live = list(zip(row, own, strict=True))
        for i in range(max(len(lines) for lines, _, _ in row)):
            last = max((j for j, ((lines, _, _), _) in enumerate(live) if i < len(lines) and lines[i]), default=-1)
            line = []
            for (lines, _, align), size in live[:last + 1]:
                t = lines[i] if i < len(lines) else ""
                fill = " " * max(0, size - width(t))
                line.append(fill + t if align == "right" else t + fill)
            full = "  ".join(line).rstrip()
            if full:
                page.put(full)
                page.line()
            while live and len(live[-1][0][0]) <= i + 1:  # nothing more to the right
                live.pop()
    page.line(2)


def _chosen(select: Node) -> Node:
    """What a select shows: its chosen option, or all options of a list box."""
    options, todo = [], [(k, False) for k in reversed(select.kids)]
    while todo:
        k, off = todo.pop()
        if isinstance(k, str) or k.hidden:
            continue
        off = off or "disabled" in k.attrs
        if k.name == "option":
            options.append((k, off))
        else:
            todo.extend((x, off) for x in reversed(k.kids))
    size = select.attrs.get("size", "").strip()
    box = "multiple" in select.attrs or (size.isascii() and size.isdigit() and size.strip("0") not in ("", "1"))
    if not box:
        marked = [o for o in options if "selected" in o[0].attrs]
        options = marked[-1:] or [o for o in options if not o[1]][:1]
    shown = Node("span")
    for o, _ in options:
        one = Node("div" if box else "span")
        one.kids = [o.attrs["label"]] if o.attrs.get("label") else o.kids
        shown.kids.append(one)
    return shown


_NUMBER = re.compile(r"-?[0-9]{1,9}")


def _number(text: str | None, other: int) -> int:
    text = (text or "").strip()
    return int(text) if _NUMBER.fullmatch(text) else other


def _first(node: Node) -> tuple[int, int]:
    """First number of a list, and the step to the next."""
    if "reversed" in node.attrs and node.name == "ol":
        items = sum(isinstance(k, Node) and k.name == "li" and not k.hidden for k in node.kids)
        return _number(node.attrs.get("start"), items), -1
    return _number(node.attrs.get("start"), 1), 1


def _walk(page: _Page, start: Node, seen: bool = True) -> None:
    """Text of a node in order; an explicit stack, so depth does not matter.
    ``seen``: whether text is visible round it."""
    todo: list = [(start, False, seen, None)]  # drawn: None in html, in an svg whether text is drawn
    pre = 0
    lists: list[list] = []  # kind, next number, step
    while todo:
        node, leave, seen, drawn = todo.pop()
        if isinstance(node, str):
            if seen and drawn is not False:
                page.text(node, pre > 0)
            continue
        name = node.name
        if leave:
            if name in ("ul", "ol", "menu"):
                lists.pop()
                page.line(2 if not lists else 1)
            elif name == "li":
                page.indent = page.indent[:-len(node.attrs[""])] if node.attrs[""] else page.indent
                page.mark = ""
                page.line()
            elif name in SPACED:
                page.line(2)
            elif name in BLOCK:
                page.line()
            if name in PRE:
                pre -= 1
            if name == "blockquote" or name == "dd":
                page.indent = page.indent[:-2]
            if name == "text" and drawn is not None:
                page.text(" ", False)
            continue
        if node.hidden:
            continue
        if node.seen is not None:
            seen = node.seen
        if name == "br":
            page.out_break()
            continue
        if name == "hr":
            page.line()
            if seen:
                page.put("---")
            page.line()
            continue
        if name in ("img", "input"):
            kind = node.attrs.get("type", "text").strip().lower() or "text"
            if name == "img" or kind == "image":
                shown = node.attrs.get("alt", "")
            elif kind in BUTTONS or kind in FIELDS:
                shown = node.attrs.get("value") or (node.attrs.get("placeholder", "") if kind in FIELDS else "")
            else:
                shown = ""
            if seen and shown.strip():
                page.text(shown.strip() if name == "img" else shown, False)
            continue
        if name == "table":
            _table(page, node, seen)
            continue
        if name == "svg":
            drawn = False
        elif drawn is not None and name in ("text", "foreignobject"):
            drawn = True if name == "text" else None
            page.text(" ", False)
        if name in SPACED:
            page.line(1 if name in ("ul", "ol", "menu") and lists else 2)
        elif name in BLOCK:
            page.line()
        if name in ("ul", "ol", "menu"):
            lists.append([name, *_first(node)])
        elif name == "li":
            own = lists[-1] if lists else ["ul", 1, 1]
            own[1] = _number(node.attrs.get("value"), own[1])
            mark = f"{own[1]}. " if own[0] == "ol" else "- "
            own[1] += own[2]
            node.attrs = {**node.attrs, "": " " * len(mark)}
            page.indent += node.attrs[""]
            page.mark = mark if seen else ""
        elif name in PRE:
            pre += 1
        if name == "blockquote" or name == "dd":
            page.indent += "  "
        if name in ("td", "th"):
            page.text(" ", False)
        todo.append((node, True, seen, drawn))
        kids = node.kids
        if name == "select":
            kids = [_chosen(node)]
        elif name == "textarea" and not any(kids):
            kids = [node.attrs.get("placeholder", "")]
        elif name in ("pre", "listing", "textarea") and kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
            kids = [kids[0][1:], *kids[1:]]
        elif name in STACKED:
            kids = [x for k in kids for x in (k, " ")][:-1]
        todo.extend((k, False, seen, drawn) for k in reversed(kids))


def render(node: Node, seen: bool = True) -> str:
    page = _Page()
    if node.name in ("td", "th"):
        shell = Node("span")
        shell.kids, shell.seen = node.kids, node.seen
        node = shell
    _walk(page, node, seen)
    return "".join(page.out)


def html_to_text(html: str | None) -> str:
    """All visible text of a page: blocks on lines of their own, paragraphs and
    the like parted by an empty line, list items marked, table cells aligned.
    Scripts are not run, so noscript shows (in a head, from its first element
    that a head may not hold; bare text there does not); form fields show their value (a
    select its chosen option) or placeholder; a closed details element is shown whole.  Styles
    count where they stand in a style attribute.  Null is empty text."""
    return render(parse(html)) if html else ""


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text (see ``html_to_text``), n_chars.

    One row per row of ``pages``, ids null or repeated included; null or empty
    html gives an empty text, text without tags comes back with its white space
    folded; other columns are not returned.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [html_to_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text,
                                "n_chars": [len(t) for t in text]})
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
