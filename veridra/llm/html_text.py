"""Layout-aware text of HTML pages.

A tree builder follows the open elements of a page, with the tags that HTML lets
authors leave out implied, and drives a renderer: blocks stand on lines of their
own, paragraphs and the like are set off by a blank line, list items carry their
bullet or number and indent what they hold, and the cells of a table are aligned in
columns. All visible text is emitted, navigation and footers included. Not visible
are scripts, styles, templates and embedded media (the text of drawings and formulas
is visible, their descriptions and annotations are not), elements with ``hidden``,
``display: none`` or ``visibility: hidden`` (in their style attribute or by a rule
of the page with simple selectors), closed ``details`` and ``dialog``, hidden
inputs, and the options of a drop-down list that are not selected.

The open elements are a list, not recursion, and a page is read once, so deep and
long pages take time in proportion to their length.

Defined results: a null or empty page has empty text and title; text that is not
HTML comes out with its white space collapsed; repeated rows have equal results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: element classes of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
UNSEEN = frozenset(
    "script style template title iframe noembed noframes object video audio canvas datalist picture "
    "defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp ul ol dir menu dl hr figure fieldset table form".split())
LINES = frozenset(
    "address article aside body center details dialog div dd dt figcaption footer header hgroup html legend li main nav "
    "optgroup option search section summary caption tr thead tbody tfoot td th text".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = (PARAGRAPHS | LINES) - {"body", "html", "caption", "tr", "thead", "tbody", "tfoot", "td", "th", "option", "optgroup", "legend", "text"}
WALLS = frozenset("table td th caption template button object".split())
CELLS, GROUPS = frozenset(("td", "th")), frozenset(("thead", "tbody", "tfoot"))

#: blanks that align a table: at most this many, or as many for each character of its text. Columns are as wide as their
#: widest cell; where that took more blanks, wide cells stand out of columns as wide as can be.
PADDING, PADDING_SHARE = 1 << 18, 2
#: fixed values: what the HTML standard allows cells to span, columns and rows
MAX_SPANS = (1000, 65_534)
INDENT = "  "

# a quote counts where a value begins; repetition never backs up, so no page takes quadratic time
_TOKEN = re.compile(
    r"<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)(>?)|[!?/]([^>]*+)(>?))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"<style[^>]*>(.*?)(?:</style|\Z)", re.S | re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


def hiding_rules(page: str) -> list[tuple[str, frozenset, frozenset, bool]]:
    """(tag, classes, ids, display) of the page's rules that hide what they match."""
    rules = []
    for style in _STYLE.findall(page):
        style = re.sub(r"/\*.*?\*/", "", style, flags=re.S)
        style = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", style)
        for selectors, body in _RULE.findall(style):
            display, visibility = _NONE.search(body), _VISIBILITY.search(body)
            if not display and not (visibility and visibility[1].lower() != "visible"):
                continue
            for selector in selectors.split(","):
                if (simple := _SIMPLE.match(selector.strip())) and simple[0]:
                    parts = re.findall(r"([.#])([\w-]+)", simple[2])
                    tag = "" if simple[1] in (None, "*") else simple[1].lower()
                    classes, ids = (frozenset(v for k, v in parts if k == sign) for sign in ".#")
                    rules.append((tag, classes, ids, bool(display)))
    return rules


def shown_width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []  # of the line at hand
        self.space = False
        self.gap = 0  # 1: a new line is due, 2: a blank line as well
        self.prefix, self.marker = "", None

    def end_line(self, gap: int = 1) -> None:
        if self.words:
            lead = self.prefix if self.marker is None else self.marker
            self.lines.append((lead + "".join(self.words)).replace("\xa0", " ").rstrip())
            self.words, self.marker, self.gap = [], None, 0
        self.space = False
        self.gap = max(self.gap, gap)

    def _begin(self) -> None:
        if not self.words and self.gap == 2 and self.lines and self.lines[-1]:
            self.lines.append("")

    def text(self, text: str) -> None:
        words = _SPACE.split(text)
        if self.words and (self.space or not words[0]) and any(words):
            self.words.append(" ")
        self.space = bool(self.words or any(words)) and not words[-1]
        if any(words):
            self._begin()
            self.words.append(" ".join(filter(None, words)))
        elif self.words and text:
            self.space = True

    def preserved(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").expandtabs(8).split("\n")
        for k, line in enumerate([first, *rest]):
            if k:
                if not self.words:
                    self.lines.append("")
                self.end_line(0)
            if line:
                self._begin()
                self.words.append(line)

    def block(self, lines: list[str]) -> None:
        """Finished lines, set off as a paragraph."""
        self.end_line(2)
        if any(lines):
            self._begin()
            for k, line in enumerate(lines):
                lead = self.marker if self.marker is not None and not k else self.prefix
                self.lines.append((lead + line).rstrip())
            self.marker = None
            self.gap = 2

    def finish(self) -> list[str]:
        self.end_line()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((i for i, line in enumerate(lines) if line), 0)
        return lines[start:]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.caption: list[str] = []

    def _widths(self, cells: dict[int, Counter]) -> dict[int, int]:
        """Widths of the columns from how many of their cells have which width."""
        rows = len(self.rows)
        text = sum(width * n for of in cells.values() for width, n in of.items())
        most = max(PADDING, PADDING_SHARE * text)

        def blanks(limit: int) -> int:
            return sum(rows * min(limit, max(of)) - sum(min(limit, w) * n for w, n in of.items()) for of in cells.values())

        low, high = 0, max((max(of) for of in cells.values()), default=0)
        while low < high:  # the widest limit that keeps within the blanks; nearly always none is needed
            middle = high if low == 0 and blanks(high) <= most else (low + high + 1) // 2
            low, high = (middle, high) if blanks(middle) <= most else (low, middle - 1)
        return {column: min(low, max(of)) for column, of in cells.items()}

    def lines(self) -> list[str]:
        """The cells in aligned columns; what spans columns widens none."""
        placed, taken = [], {}
        held: dict[int, Counter] = {}
        for row in self.rows:
            column, cells = 0, []
            for lines, across, down in row:
                while taken.get(column):
                    column += 1
                cells.append((column, lines))
                if across == 1:
                    held.setdefault(column, Counter())[max(map(shown_width, lines), default=0)] += 1
                if down > 1:
                    taken |= dict.fromkeys(range(column, column + across), down)
                column += across
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
            placed.append(cells)
        widths = self._widths(held)
        starts, at = {}, 0
        for column in range(max(widths, default=-1) + 1):
            starts[column] = at
            at += widths.get(column, 0) + (2 if widths.get(column) else 0)
        out = list(self.caption)
        for cells in placed:
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                line, reached = [], 0
                for column, lines in cells:
                    if k < len(lines) and lines[k]:
                        pad = starts.get(column, at) - reached if column else 0
                        blank = max(pad, 2 if line else 0)
                        line.append(" " * blank + lines[k])
                        reached += blank + shown_width(lines[k])
                out.append("".join(line))
        return out


class Element:
    __slots__ = ("tag", "unseen", "invisible", "pre", "saved")

    def __init__(self, tag, unseen, invisible, pre, saved=None):
        self.tag, self.unseen, self.invisible, self.pre, self.saved = tag, unseen, invisible, pre, saved


class Page:
    """Follows the open elements of a page and renders what is visible."""

    def __init__(self, rules: list):
        self.rules = rules
        self.open = [Element("", False, False, False)]
        self.count: Counter[str] = Counter()
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.tables: list[Table] = []
        self.lists: list[list] = []  # kind, next number, step
        self.title = ""
        self.fresh_pre = False

    # text

    def text(self, text: str) -> None:
        top = self.open[-1]
        if top.unseen or top.invisible or top.saved == "closed":
            return
        if "&" in text:
            text = unescape(text)
        if self.fresh_pre and text.startswith("\n"):
            text = text[1:]
        self.fresh_pre = False
        (self.flow.preserved if top.pre else self.flow.text)(text)

    # the tree

    def _near(self, tags: frozenset | set, walls: frozenset = WALLS) -> int:
        """Place of the innermost open element of ``tags`` inside the walls, or 0."""
        if not any(self.count[t] for t in tags):
            return 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in walls:
                return 0
        return 0

    def _close_to(self, place: int) -> None:
        while len(self.open) > place:
            self._leave(self.open.pop())

    def _hidden(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
        """Is the element not displayed; is it invisible (None: as its parent)."""
        unseen = tag in UNSEEN or "hidden" in attrs
        unseen |= tag == "dialog" and "open" not in attrs
        style, invisible = attrs.get("style", ""), None
        if style:
            unseen |= bool(_NONE.search(style))
            if found := _VISIBILITY.search(style):
                invisible = found[1].lower() != "visible"
        if self.rules:
            classes, own = set(attrs.get("class", "").split()), {attrs.get("id", "")}
            for of_tag, of_classes, of_ids, display in self.rules:
                if of_tag in ("", tag) and of_classes <= classes and of_ids <= own:
                    unseen |= display
                    invisible = True if not display and invisible is None else invisible
        return unseen, invisible

    def start(self, tag: str, source: str) -> None:
        attrs = attributes(source) if source.strip(" /\t\n\r\f") else {}
        if tag in ("html", "head", "body"):
            return
        if tag in CLOSES_P and (place := self._near({"p"})):
            self._close_to(place)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._close_to(len(self.open) - 1)
        if tag == "li" and (place := self._near({"li"}, WALLS | {"ul", "ol", "menu", "dir"})):
            self._close_to(place)
        elif tag in ("dt", "dd") and (place := self._near({"dt", "dd"}, WALLS | {"dl"})):
            self._close_to(place)
        elif tag in ("option", "optgroup") and (place := self._near({"option"} if tag == "option" else {"option", "optgroup"})):
            self._close_to(place)
        elif tag in ("a", "button") and (place := self._near({tag})):
            self._close_to(place)
        elif tag in CELLS or tag == "tr" or tag in GROUPS or tag == "caption":
            if not self.count["table"]:
                return
            self._to_table(CELLS | {"caption"} | (frozenset() if tag in CELLS else {"tr"}) | (GROUPS if tag in GROUPS else frozenset()))
            if tag in CELLS and self.open[-1].tag != "tr":
                self._enter("tr", {})
        if tag == "img" or tag == "col":
            return
        if tag == "br":
            if not self._silent():
                self.flow.end_line(1) if self.flow.words else self._blank()
            return
        if tag == "hr":
            if not self._silent():
                self.flow.end_line(2)
            return
        if tag == "input":
            shown = attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number")
            if shown and attrs.get("value") and not self._hidden(tag, attrs)[0] and not self._silent():
                self.flow.text(f" {attrs['value']} ")
            return
        if tag not in VOID:
            self._enter(tag, attrs)

    def _silent(self) -> bool:
        return self.open[-1].unseen or self.open[-1].invisible

    def _blank(self) -> None:
        """A line break on an empty line."""
        if self.flow.lines and self.flow.lines[-1] and self.flow.gap == 1:
            self.flow.gap = 2

    def _to_table(self, tags: frozenset) -> None:
        """Close the open parts of the innermost table that ``tags`` names."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "table":
                break
        lowest = next((j for j in range(i + 1, len(self.open)) if self.open[j].tag in tags), None)
        if lowest is not None:
            self._close_to(lowest)

    def _enter(self, tag: str, attrs: dict[str, str]) -> None:
        parent = self.open[-1]
        unseen, invisible = self._hidden(tag, attrs)
        unseen |= parent.unseen
        if parent.tag == "details" and tag != "summary" and parent.saved == "closed":
            unseen = True
        invisible = parent.invisible if invisible is None else invisible
        element = Element(tag, unseen, invisible, parent.pre or tag in ("pre", "listing", "xmp", "textarea"))
        self.open.append(element)
        self.count[tag] += 1
        if tag == "details":
            element.saved = "closed" if "open" not in attrs else None
        elif tag == "select":
            element.saved = {"one": "multiple" not in attrs and "size" not in attrs, "first": None, "chosen": None, "flow": self.flow}
            self.flows.append(self.flow)
            self.flow = Flow()
        elif tag == "option":
            element.saved = (self.flow, "selected" in attrs)
            self.flow = Flow()
        if unseen:
            return
        flow = self.flow
        if tag in PARAGRAPHS and tag not in ("table",):
            flow.end_line(1 if tag in ("ul", "ol", "menu", "dir") and self.lists else 2)
        elif tag in LINES and tag not in CELLS and tag not in ("tr", "caption", "option", "optgroup") and tag not in GROUPS:
            flow.end_line(1)
        if element.pre and not parent.pre:
            self.fresh_pre = True
        if tag in ("ul", "ol", "menu", "dir"):
            number = attrs.get("start", "")
            number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
            self.lists.append([tag, number, -1 if "reversed" in attrs else 1])
        elif tag == "li":
            element.saved = (flow.prefix, flow.marker)
            marker = "- "
            if self.lists and self.lists[-1][0] == "ol":
                if re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")):
                    self.lists[-1][1] = int(attrs["value"])
                marker = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += self.lists[-1][2]
            flow.marker = flow.prefix + marker
            flow.prefix += " " * len(marker)
        elif tag in ("blockquote", "dd"):
            element.saved = (flow.prefix, flow.marker)
            flow.prefix += INDENT
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif (tag in CELLS or tag == "caption") and self.tables:
            spans = [attrs.get(k, "") for k in ("colspan", "rowspan")]
            element.saved = [min(most, max(1, int(s))) if re.fullmatch(r"\d{1,9}", s) else 1 for s, most in zip(spans, MAX_SPANS)]
            self.flows.append(flow)
            self.flow = Flow()
        elif tag == "q":
            flow.text("“") if not invisible else None

    def _leave(self, element: Element) -> None:
        tag = element.tag
        self.count[tag] -= 1
        if tag == "option":
            outer, selected = element.saved
            lines, self.flow = self.flow.finish(), outer
            select = next((e for e in reversed(self.open) if e.tag == "select"), None)
            if select is None:
                if not element.unseen:
                    outer.block(lines)
            elif not select.saved["one"]:
                for line in lines if not element.unseen else ():
                    self.flow.end_line()
                    self.flow.text(line)
            else:
                label = " ".join(lines)
                if select.saved["first"] is None:
                    select.saved["first"] = label
                if selected and select.saved["chosen"] is None:
                    select.saved["chosen"] = label
        elif tag == "select":
            lines, self.flow = self.flow.finish(), self.flows.pop()
            state = element.saved
            if not element.unseen and not element.invisible:
                if state["one"]:
                    self.flow.text(f" {state['chosen'] if state['chosen'] is not None else state['first'] or ''} ")
                else:
                    self.flow.block(lines)
        if element.unseen:
            return
        flow = self.flow
        if tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
            flow.end_line(1 if self.lists else 2)
        elif tag in ("li", "blockquote", "dd"):
            flow.end_line(2 if tag == "blockquote" else 1)
            flow.prefix, flow.marker = element.saved
        elif (tag in CELLS or tag == "caption") and self.tables:
            lines, self.flow = flow.finish(), self.flows.pop()
            if tag == "caption":
                self.tables[-1].caption += lines
            elif self.tables[-1].rows:
                self.tables[-1].rows[-1].append((lines, *element.saved))
        elif tag == "table":
            flow.block(self.tables.pop().lines())
        elif tag == "q":
            flow.text("”") if not element.invisible else None
        elif tag in PARAGRAPHS:
            flow.end_line(2)
        elif tag in LINES and tag != "tr" and tag not in GROUPS and tag != "optgroup":
            flow.end_line(1)

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag == "br":
            return self.start("br", "")
        if tag == "p" and not self._near({"p"}):
            if not self._silent():
                self.flow.end_line(2)
            return
        walls = frozenset() if tag in ("table", "template", "object") else frozenset(("table",)) if tag in CELLS | GROUPS | {"tr", "caption"} else WALLS - {tag}
        place = self._near(HEADINGS if tag in HEADINGS else {tag}, walls)
        if not place:
            return
        if tag not in PARAGRAPHS | LINES | WALLS | {"select", "details", "template"}:
            # an inline element does not close the blocks that began inside it
            if any(e.tag in PARAGRAPHS or e.tag in LINES or e.tag in WALLS for e in self.open[place + 1 :]):
                self.count[tag] -= 1
                gone = self.open.pop(place)
                if not self.open[place - 1].unseen and gone.unseen:
                    for e in self.open[place:]:
                        e.unseen = False
                return
        self._close_to(place)


def render(page: str | None) -> tuple[str, str]:
    """(title, visible text) of a page."""
    if not page:
        return "", ""
    page = page.replace("\x00", "")
    built = Page(hiding_rules(page) if "<style" in page or "<STYLE" in page else [])
    at, end = 0, len(page)
    search = _TOKEN.search
    while at < end:
        found = search(page, at)
        if found is None:
            built.text(page[at:])
            break
        if found.start() > at:
            built.text(page[at : found.start()])
        tag = found[3]
        if tag and not found[5] or found[6] is not None and not found[7]:
            built.text(page[found.start() :])  # a tag that never ends is text
            break
        at = found.end()
        if not tag:
            continue
        tag = tag.lower()
        if found[2]:
            built.end(tag)
            continue
        built.start(tag, found[4] or "")
        if tag == "plaintext":
            built.text(page[at:].replace("&", "&amp;"))
            break
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            raw = page[at : close.start() if close else end]
            if tag == "title" and not built.title and not built.count["svg"]:
                built.title = _SPACE.sub(" ", unescape(raw)).strip()
            elif tag in ("textarea", "xmp"):
                built.text(raw if tag == "textarea" else raw.replace("&", "&amp;"))
            at = close.start() if close else end
    built._close_to(1)
    return built.title, "\n".join(built.flow.finish())


def extract(html: Column) -> Column:
    """``struct<title, text>`` of a whole page."""

    @F.arrow_udf("struct<title string, text string>")
    def visible_text(pages: pa.Array) -> pa.Array:
        done = [render(page.as_py()) for page in pages]
        return pa.StructArray.from_arrays(
            [pa.array([t for t, _ in done], pa.string()), pa.array([x for _, x in done], pa.string())], ["title", "text"]
        )

    return visible_text(html)
