"""HTML to text lines with heading sizes: pure Python on one document, called from an Arrow pass.

Scripts, styles and templates hold no text; inline-XBRL headers are dropped. Innermost tables with a row of
figures become one line a row, each value after its column's headings. A line gets a heading size if all of
it is bold: the largest size of its bold parts.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from lodestrata.constants import (
    BOLD_STYLE, CELL_NUMBER, CELL_YEAR, FONT_SIZE_STYLE, FOOTER_LINE, FOOTER_MIN_REPEATS, HEADING_YEAR, ITEM_HEADING, NOISE_LINE, NUMBER_PREFIXES, NUMBER_SUFFIXES, PERIOD_LABEL,
)

# Elements by how they are laid out.
BLOCKS = frozenset(("p", "div", "tr", "li", "br", "table", "h1", "h2", "h3", "h4", "h5", "h6"))
CELLS = frozenset(("td", "th"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
NO_TEXT = frozenset(("script", "style", "template", "ix:header"))
#: An element that opens ends an open one of these, unless a barrier stands between them.
ENDS = {
    "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "thead": {"tr", "td", "th", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
    **{tag: {"p"} for tag in ("p", "div", "table", "ul", "ol", "dl", "pre", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "blockquote", "center")},
}
BARRIERS = {"li": {"ul", "ol", "table"}, "p": {"table", "td", "th", "div", "li"}}

_number, _year = re.compile(CELL_NUMBER).match, re.compile(CELL_YEAR).match
_heading, _noise, _footer = (re.compile(p, re.IGNORECASE).match for p in (ITEM_HEADING, NOISE_LINE, FOOTER_LINE))
_heading_year, _period = re.compile(HEADING_YEAR).search, re.compile(PERIOD_LABEL, re.IGNORECASE).search
_bold_style, _font_size = re.compile(BOLD_STYLE, re.IGNORECASE).search, re.compile(FONT_SIZE_STYLE, re.IGNORECASE).search


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def bold(self) -> bool:
        return self.tag in ("b", "strong") or bool(_bold_style(self.attrs.get("style", "")))

    def size(self) -> float:
        """The font size of the nearest element that names one."""
        at = self
        while at is not None:
            if found := _font_size(at.attrs.get("style", "")):
                try:
                    return float(found.group(1))
                except ValueError:
                    return 0.0
            at = at.parent
        return 0.0

    def span(self, name: str) -> int:
        try:
            return max(1, int(self.attrs.get(name, 1)))
        except ValueError:
            return 1


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        if closes := ENDS.get(tag):
            self._close_open(closes, BARRIERS["p"] if "p" in closes else BARRIERS["li"] if "li" in closes else {"table"})
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        # "<p/>" opens a paragraph as "<p>" does; elements of other namespaces (ix:...) close themselves.
        self.handle_starttag(tag, attrs)
        if ":" in tag and tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        at = self.at
        while at is not None and at.tag != tag:
            if at.tag in CELLS | {"table"} and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                return  # no end tag in a cell closes what was opened outside it
            at = at.parent
        if at is not None and at.parent is not None:
            self.at = at.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close_open(self, tags, barriers):
        """End the outermost open element of these tags below the nearest barrier."""
        at, last = self.at, None
        while at is not None and at.tag not in barriers - tags:
            if at.tag in tags:
                last = at
            at = at.parent
        if last is not None:
            self.at = last.parent


def decoded(html: bytes | str) -> str:
    if isinstance(html, str):
        return html
    declared = re.search(rb"charset=[\"']?([\w-]+)", html[:2048])
    for name in ("utf-8-sig", declared.group(1).decode() if declared else "cp1252"):
        try:
            return html.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return html.decode("cp1252", errors="replace")


def _strings(e: Element):
    for child in e.children:
        if isinstance(child, str):
            yield child
        elif child.tag not in NO_TEXT:
            yield from _strings(child)


def _within(e: Element, tags: frozenset[str] | set[str]):
    for child in e.children:
        if not isinstance(child, str) and child.tag not in NO_TEXT:
            if child.tag in tags:
                yield child
            yield from _within(child, tags)


def table_rows(table: Element) -> list[list[tuple[int, int, str]]]:
    """The non-empty cells (first column, column after the last, text) of each row, in columns as a browser
    lays them out: cells that span rows push the cells of the rows below to the right."""
    rows, taken_until = [], {}
    for number, tr in enumerate(_within(table, {"tr"})):
        cells, column, spanning = [], 0, {}
        for cell in _within(tr, CELLS):
            while taken_until.get(column, 0) > number:
                column += 1
            end, height = column + cell.span("colspan"), cell.span("rowspan")
            text = " ".join(" ".join(_strings(cell)).split())
            text = re.sub(r"([$(])\s+", r"\1", text)
            text = re.sub(r"\s+(?=[)%])", "", text)
            if text:
                cells.append((column, end, text))
            if height > 1:
                spanning.update(dict.fromkeys(range(column, end), number + height))
            column = end
        taken_until |= spanning
        if cells:
            rows.append(joined_affixes(cells))
    return rows


def joined_affixes(cells: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Currency signs and brackets in cells of their own are joined to the number they stand beside."""
    out: list[tuple[int, int, str]] = []
    for start, end, text in cells:
        if out:
            before = out[-1]
            if text in NUMBER_SUFFIXES and (before[2][-1] == ")" or before[2][-1].isdecimal()):
                out[-1] = (before[0], end, before[2] + text)
                continue
            if before[2] in NUMBER_PREFIXES and (text[0] in "(-" or text[0].isdecimal()):
                out[-1] = (start, end, before[2] + text)
                continue
        out.append((start, end, text))
    return out


def headings_over(start: int, starts: list[int], header: list[list[tuple[int, int, str]]]) -> str:
    """The header cells over a column, top down, without those that stand over every value of a longer row."""
    over_all = lambda a, b: len(starts) > 1 and all(a <= s < b for s in starts)
    return " ".join(text for row in header for a, b, text in row if a <= start < b and not over_all(a, b))


def counts_under_years(label: str | None, values: list[tuple[int, int, str]], header: list[list[tuple[int, int, str]]]) -> bool:
    """Whether a row of numbers that look like years holds figures: it has a label that tells no period, and each value stands
    under a heading that names a year ("Net income | 1990" below "2025"). Several years, each below itself, are the heading again."""
    if not label or _period(label):
        return False
    over = [(text, headings_over(start, [start], header)) for start, _, text in values]
    return all(_heading_year(name) for _, name in over) and (len(over) == 1 or any(text not in name for text, name in over))


def rendered(rows: list[list[tuple[int, int, str]]]) -> list[str] | None:
    """A table's lines; None if it has no row of figures, or lays out Item headings."""
    if any(_heading(text) for row in rows for _, _, text in row):
        return None
    lines, header, open_header, figures = [], [], True, False
    for row in rows:
        label = row[0][2] if row[0][0] == 0 and not _number(row[0][2]) else None
        values = row if label is None else row[1:]
        numbers = [text for _, _, text in values if _number(text)]
        if any(not _year(n) for n in numbers) or (numbers and len(numbers) == len(values) and counts_under_years(label, values, header)):
            figures, open_header = True, False
            starts = [s for s, _, _ in values]
            parts = [] if label is None else [label]
            for start, _, text in values:
                name = headings_over(start, starts, header)
                parts.append(f"{name}: {text}" if name else text)
            lines.append(" | ".join(parts))
        elif values:
            if not open_header:  # the first header row after figures starts a new header
                header, open_header = [], True
            header.append(row)
            lines.append(" | ".join(text for _, _, text in row))
        else:
            lines.append(label or "")
    return lines if figures else None


class _Lines:
    """Gathers text into lines; a bold stretch counts only if it begins and ends within one line."""

    def __init__(self):
        self.done: list[tuple[str, float | None]] = []
        self.parts: list[str] = []
        self.bold: list[tuple[int, int, float]] = []
        self.opened: tuple[int, float] | None = None

    def text(self, value: str) -> None:
        first, *rest = value.split("\n")
        self.parts.append(first)
        for part in rest:
            self.end()
            self.parts.append(part)

    def open(self, size: float) -> None:
        self.opened = (len(self.parts), size)

    def close(self) -> None:
        if self.opened is not None:
            self.bold.append((self.opened[0], len(self.parts), self.opened[1]))
        self.opened = None

    def end(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text and not _noise(text):
            size = None
            if self.bold:
                inside = {i for a, b, _ in self.bold for i in range(a, b)}
                if not "".join(p for i, p in enumerate(self.parts) if i not in inside).strip():
                    size = max(s for _, _, s in self.bold)
            self.done.append((text, size))
        self.parts, self.bold, self.opened = [], [], None


def _walk(e: Element, out: _Lines, in_bold: bool) -> None:
    for child in e.children:
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if tag in NO_TEXT:
            continue
        if tag == "table" and next(_within(child, {"table"}), None) is None and (lines := rendered(table_rows(child))) is not None:
            out.text("\n" + "\n".join(lines) + "\n")
            continue
        if tag in BLOCKS:
            out.text("\n")
        starts_bold = not in_bold and child.bold()
        if starts_bold:
            out.open(child.size())
        _walk(child, out, in_bold or starts_bold)
        if starts_bold:
            out.close()
        if tag in CELLS:
            out.text(" ")
        if tag in BLOCKS:
            out.text("\n")


def without_footers(lines: list[tuple[str, float | None]]) -> list[tuple[str, float | None]]:
    """Lines but for running footers: "label | page" whose label occurs five times or more."""
    label = [m.group(1) if (m := _footer(text)) else None for text, _ in lines]
    counts = Counter(label)
    return [line for line, name in zip(lines, label, strict=True) if name is None or counts[name] < FOOTER_MIN_REPEATS]


def parse_lines(html: bytes | str | None) -> list[tuple[str, float | None]]:
    """(text, heading size or None) of each line of a document; no lines for null."""
    if not html:
        return []
    tree = _Tree()
    tree.feed(decoded(html))
    tree.close()
    out = _Lines()
    _walk(tree.root, out, False)
    out.end()
    return without_footers(out.done)
