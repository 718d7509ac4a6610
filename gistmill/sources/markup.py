"""Parsers of HTML, XML, JSON and Markdown."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from xml.etree import ElementTree

from gistmill import fixed
from gistmill.sources.blocks import Block, trimmed

HTML_TAGS, XML_START = re.compile(fixed.HTML_TAGS, re.I), re.compile(fixed.XML_START, re.S)

# ---- HTML -----------------------------------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript svg nav header footer".split())
KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "li": "list", "tr": "table", "pre": "code", "code": "code", "p": "prose", "blockquote": "prose"}
#: An element of the first kind ends when one of the second kind opens.
ENDS = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: Elements that an implied end never crosses.
WALLS = frozenset("ul ol table td th html body div section article main".split())


class _Tree(HTMLParser):
    """Keeps the open elements; text goes to every open element of interest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None, bool]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        while self.open and self._ended_by(tag):
            self._pop()
        if tag in VOID:
            return
        drop = tag in DROPPED or (tag == "span" and "mw-editsection" in (dict(attrs).get("class") or ""))
        parts = None
        self.hidden += drop
        if tag in KINDS and not self.hidden:
            parts = []
            self.found.append((tag, parts))
        self.open.append((tag, parts, drop))

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _ended_by(self, tag) -> bool:
        for name, _, _ in reversed(self.open):
            if tag in ENDS.get(name, ()):
                return True
            if name in WALLS:
                return False
        return False

    def _pop(self):
        self.hidden -= self.open.pop()[2]

    def handle_endtag(self, tag):
        if any(name == tag for name, _, _ in self.open):
            while self.open[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.hidden:
            for _, parts, _ in self.open:
                if parts is not None:
                    parts.append(data)


def is_html(text: str) -> bool:
    return HTML_TAGS.search(text[:3000].strip()) is not None


def html(text: str) -> list[Block]:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    out = []
    for tag, parts in tree.found:
        body = " ".join("".join(parts).split())
        if len(body) >= 4:
            out.append(Block(tag, KINDS[tag], body, ((0, len(text)),), "rewrite", {"tag": tag}))
    return out


# ---- XML ------------------------------------------------------------------------------------------------------------
def is_xml(text: str) -> bool:
    head = text[:500].strip()
    return XML_START.match(head) is not None and not head.lower().startswith("<!doctype html")


def safe_xml(data: str | bytes) -> ElementTree.Element:
    """Parse without entity declarations, which could expand without bound or read files."""
    if re.search(rb"<!ENTITY" if isinstance(data, bytes) else "<!ENTITY", data):
        raise ElementTree.ParseError("entity declarations are refused")
    return ElementTree.fromstring(data)


def xml(text: str) -> list[Block]:
    out, at = [], 0
    for element in safe_xml(text.strip()).iter():
        body, attributes = (element.text or "").strip(), " ".join(f'{k}="{v}"' for k, v in element.attrib.items())
        if not body and not attributes:
            continue
        tag = element.tag.rpartition("}")[2]
        shown = body or next(iter(element.attrib.values()))
        place = text.find(shown, at)
        place = place if place >= 0 else text.find(shown)
        span = (place, place + len(shown)) if place >= 0 else (0, 0)
        at = span[1] or at
        out.append(Block(tag, "structured", f"{body} ({attributes})" if body and attributes else body or attributes, (span,), "rewrite", {"tag": tag}))
    return out


# ---- JSON -----------------------------------------------------------------------------------------------------------
def _strict(name: str):
    raise ValueError(name)


def loaded(text: str):
    return json.loads(text, parse_constant=_strict)


def is_json(text: str) -> bool:
    body = text.strip()
    if (body[:1], body[-1:]) not in (("{", "}"), ("[", "]")):
        return False
    try:
        loaded(body)
    except (ValueError, RecursionError):
        return False
    return True


def json_items(text: str) -> list[Block]:
    """A block for each top-level field or item; nested values as JSON, others as text."""
    data = loaded(text.strip())
    items = [(f"{k}: ", v, "field") for k, v in data.items()] if isinstance(data, dict) else [(f"[{i}] ", v, "item") for i, v in enumerate(data)]
    out = []
    for head, value, tag in items:
        body = head + (json.dumps(value, ensure_ascii=False) if isinstance(value, dict | list) else str(value))
        at = text.find(body)
        out.append(Block(tag, "structured", body, ((at, at + len(body)) if at >= 0 else (0, len(text)),), "rewrite", {"tag": tag}))
    return out


# ---- Markdown -------------------------------------------------------------------------------------------------------
FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})\s*([^\s`]*)")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT, RULE = re.compile(r" {0,3}(=+|-+)[ \t]*$"), re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
QUOTE, DELIMITER = re.compile(r" {0,3}> ?"), re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
TAG_BLOCK = re.compile(r" {0,3}<(?:[!?/]|[A-Za-z])")


def may_be_markdown(text: str) -> bool:
    return any(mark in text for mark in ("#", "```", "|", "- "))


def _cells(line: str) -> int:
    return len(re.split(r"(?<!\\)\|", line.strip().strip("|")))


def markdown(text: str) -> list[Block]:
    """Headings, fenced and indented code, tables, whole lists and paragraphs, verbatim; rules and HTML blocks go."""
    rows, at = [], 0
    for line in text.splitlines(keepends=True):
        rows.append((at, line.rstrip("\r\n")))
        at += len(line)
    ends = [a for a, _ in rows[1:]] + [len(text)]
    out: list[Block] = []

    def emit(tag, kind, first, last, **meta):
        if r := trimmed(text, rows[first][0], ends[last]):
            out.append(Block(tag, kind, text[r[0] : r[1]], (r,), "copy", meta))

    def opens(i) -> bool:
        """Whether line i ends a paragraph."""
        line = rows[i][1]
        item = ITEM.match(line)
        listed = item is not None and item.group(3) is not None and (item.group(2) in "-+*" or int(item.group(2)[:-1]) == 1)
        return not line.strip() or bool(ATX.match(line) or FENCE.match(line) or RULE.match(line) or QUOTE.match(line) or listed)

    i = 0
    while i < len(rows):
        line = rows[i][1]
        first = i
        if not line.strip():
            i += 1
        elif m := FENCE.match(line):
            mark = m.group(1)
            close = re.compile(r" {0,3}" + re.escape(mark[0]) + "{" + str(len(mark)) + r",}[ \t]*$")
            i += 1
            while i < len(rows) and not close.match(rows[i][1]):
                i += 1
            i = min(i + 1, len(rows))
            emit("code", "code", first, i - 1, language=m.group(2))
        elif m := ATX.match(line):
            emit("heading", "heading", i, i, level=str(len(m.group(1))))
            i += 1
        elif line.startswith(("    ", "\t")):
            last = i
            while i < len(rows) and (rows[i][1].startswith(("    ", "\t")) or not rows[i][1].strip()):
                last = i if rows[i][1].strip() else last
                i += 1
            emit("code", "code", first, last, language="")
            i = last + 1
        elif RULE.match(line):
            i += 1
        elif m := ITEM.match(line):
            ordered, indent = m.group(2)[-1] in ".)", len(m.group(0))
            blank, last = False, i
            i += 1
            while i < len(rows):
                now = rows[i][1]
                width = len(now.expandtabs(4)) - len(now.expandtabs(4).lstrip())
                same = ITEM.match(now)
                if not now.strip():
                    blank = True
                elif width >= min(indent, 2) or (same and not RULE.match(now) and (same.group(2)[-1] in ".)") == ordered):
                    blank, last = False, i
                elif blank or ATX.match(now) or FENCE.match(now) or RULE.match(now) or QUOTE.match(now) or same:
                    break
                else:
                    last = i  # a lazy continuation line
                i += 1
            i = last + 1
            emit("list", "list", first, last)
        elif QUOTE.match(line):
            while i < len(rows) and rows[i][1].strip():
                inner = QUOTE.sub("", rows[i][1], count=1)
                if QUOTE.match(rows[i][1]) and not inner.strip():  # an empty quoted line parts paragraphs
                    if first < i:
                        emit("prose", "prose", first, i - 1)
                    first = i + 1
                elif not QUOTE.match(rows[i][1]) and opens(i):
                    break
                i += 1
            if first < i:
                emit("prose", "prose", first, i - 1)
        elif TAG_BLOCK.match(line):
            while i < len(rows) and rows[i][1].strip():
                i += 1
        elif i + 1 < len(rows) and "|" in line and DELIMITER.match(rows[i + 1][1]) and _cells(line) == _cells(rows[i + 1][1]):
            i += 2
            while i < len(rows) and not opens(i):
                i += 1
            emit("table", "table", first, i - 1)
        else:
            i += 1
            while i < len(rows) and not opens(i) and not SETEXT.match(rows[i][1]):
                i += 1
            under = SETEXT.match(rows[i][1]) if i < len(rows) else None
            if under:
                emit("heading", "heading", first, i, level="1" if under.group(1)[0] == "=" else "2")
                i += 1
            else:
                emit("prose", "prose", first, i - 1)
    return out
