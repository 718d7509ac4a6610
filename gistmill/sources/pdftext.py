"""Text of PDF files with the standard library alone: plain and deflated streams, simple fonts, and fonts with a ToUnicode map.

Encrypted files, other filters and fonts that name glyphs without saying which characters they are give no text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from gistmill import fixed

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"\bstream\r?\n")
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
NAMED = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"%[^\r\n]*|\((?:[^()\\]|\\.)*|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+[0-9]*\*?", re.S)
ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|\r\n|(.))", re.S)
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}
#: A move of so many font sizes down begins a paragraph; a shift of so many thousandths inside a word is a space.
GAP, SPACE = 1.8, 200


@dataclass
class Font:
    wide: bool = False
    characters: dict[bytes, str] = field(default_factory=dict)

    def text(self, raw: bytes) -> str:
        if not self.characters:
            return "" if self.wide else raw.decode("cp1252", "replace")
        step = 2 if self.wide else 1
        return "".join(self.characters.get(raw[i : i + step], "") for i in range(0, len(raw), step))


class File:
    """Objects of a file by number; those of object streams too."""

    def __init__(self, raw: bytes):
        self.objects = {int(m[1]): m[2] for m in OBJECT.finditer(raw)}
        self.room = fixed.MAX_BYTES * 4
        for body in [b for b in self.objects.values() if b"/ObjStm" in b[:400]]:
            data, first, n = self.stream(body), self.number(body, b"First"), self.number(body, b"N")
            if data and first is not None and n:
                head = [int(x) for x in data[:first].split()[: 2 * n]]
                ends = [*head[3::2], len(data) - first]
                for num, at, end in zip(head[::2], head[1::2], ends, strict=False):
                    self.objects.setdefault(num, data[first + at : first + end])

    def number(self, body: bytes, key: bytes) -> int | None:
        m = re.search(rb"/" + key + rb"\s+(\d+)", body)
        return int(m[1]) if m else None

    def stream(self, body: bytes) -> bytes:
        """Decoded data of an object's stream; empty where it cannot be decoded or the file unpacks to too much."""
        m = STREAM.search(body)
        if not m:
            return b""
        head, data = body[: m.start()], body[m.end() : max(body.rfind(b"endstream"), m.end())]
        if b"/Filter" not in head:
            return data
        if not re.search(rb"/Filter\s*(?:\[\s*)?/(?:FlateDecode|Fl)\s*(?:\]|/|>|$)", head) or re.search(rb"/Predictor\s+(?:[2-9]|1\d)", head):
            return b""
        try:
            out = zlib.decompressobj().decompress(data, self.room)
        except zlib.error:
            return b""
        self.room = max(1, self.room - len(out))
        return out

    def part(self, body: bytes, key: bytes) -> bytes:
        """What stands behind a key: the object that it refers to, or the dictionary or list in place."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := REFERENCE.match(rest):
            return self.objects.get(int(ref[1]), b"")
        opening = rest[:2] if rest.startswith(b"<<") else rest[:1]
        if opening not in (b"<<", b"["):
            return rest[:64]
        closing, depth = {b"<<": b">>", b"[": b"]"}[opening], 0
        for t in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
            depth += 1 if t[0] == opening else -1
            if not depth:
                return rest[: t.end()]
        return rest

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in order, resources from the nearest node above that has them."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out: list[tuple[bytes, bytes]] = []
        seen: set[bytes] = set()
        stack = [(self.part(root, b"Pages"), b"")] if root else []
        while stack and len(out) < fixed.MAX_PAGES:
            node, above = stack.pop()
            if not node or node in seen:
                continue
            own = self.part(node, b"Resources") or above
            if re.search(rb"/Type\s*/Pages\b", node):
                seen.add(node)
                kids = REFERENCE.findall(self.part(node, b"Kids"))
                stack += [(self.objects.get(int(k), b""), own) for k in reversed(kids)]
            else:
                out.append((node, own))
        return out

    def fonts(self, resources: bytes) -> dict[bytes, Font]:
        out = {}
        for name, num in NAMED.findall(self.part(resources, b"Font")):
            body = self.objects.get(int(num), b"")
            font = Font(wide=bool(re.search(rb"/Subtype\s*/Type0\b", body)))
            if cmap := self.stream(self.part(body, b"ToUnicode")):
                _map(cmap, font)
            out[b"/" + name] = font
        return out

    def content(self, page: bytes) -> bytes:
        at = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        if not at:
            return b""
        bodies = [self.objects.get(int(k), b"") for k in REFERENCE.findall(at[1])]
        if len(bodies) == 1 and not STREAM.search(bodies[0]):
            bodies = [self.objects.get(int(k), b"") for k in REFERENCE.findall(bodies[0])]
        return b"\n".join(self.stream(b) for b in bodies)


def _map(cmap: bytes, font: Font) -> None:
    """Characters of a ToUnicode map."""
    character = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            font.characters[bytes.fromhex(code.decode())] = character(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(\[[^\]]*\]|<[0-9A-Fa-f]+>)", block):
            a, b, width = int(low, 16), int(high, 16), len(low) // 2
            listed = re.findall(rb"<([0-9A-Fa-f]+)>", to)
            for k in range(min(b - a + 1, 65_536)):
                if to.startswith(b"["):
                    if k >= len(listed):
                        break
                    shown = character(listed[k])
                else:
                    first = character(listed[0])
                    shown = first[:-1] + chr(ord(first[-1]) + k)
                font.characters[(a + k).to_bytes(width, "big")] = shown


def _literal(raw: bytes) -> bytes:
    return ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else ESCAPED.get(m[2] or b"\n", m[2] or b""), raw)


def _tokens(data: bytes):
    """Tokens in turn; strings come as ("s", bytes)."""
    at = 0
    while m := TOKEN.search(data, at):
        token, at = m[0], m.end()
        if token.startswith(b"("):  # nested brackets are balanced by hand
            depth, start = 1, m.start() + 1
            for t in re.compile(rb"\\.|[()]", re.S).finditer(data, start):
                depth += {b"(": 1, b")": -1}.get(t[0], 0)
                if not depth:
                    at = t.end()
                    yield "s", _literal(data[start : t.start()])
                    break
            else:
                return
        elif token.startswith(b"<") and not token.startswith(b"<<"):
            digits = re.sub(rb"\s", b"", token[1:-1])
            yield "s", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif not token.startswith(b"%"):
            yield "t", token


def _shown(data: bytes, fonts: dict[bytes, Font]) -> str:
    """Text that a page's operators show, a line for each line, an empty line where a paragraph begins."""
    out: list[str] = []
    stack: list = []
    font, size, row = Font(), 1.0, None

    def down(by: float) -> None:
        if by:
            out.append("\n\n" if abs(by) > GAP * size else "\n")

    def number(k: int) -> float:
        try:
            return float(stack[k])
        except (IndexError, TypeError, ValueError):
            return 0.0

    for kind, token in _tokens(data):
        if kind == "s" or not (token[:1].isalpha() or token in (b"'", b'"')):
            stack.append(("s", token) if kind == "s" else token)
            continue
        if token == b"Tf":
            size = abs(number(-1)) or size
            font = next((fonts[x] for x in stack if isinstance(x, bytes) and x in fonts), Font())
        elif token in (b"Td", b"TD"):
            down(number(-1))
            row = None
        elif token == b"Tm":
            if row is not None:
                down((row - number(-1)) / max(abs(number(-3)) or 1.0, 1e-6))
            row = number(-1)
        elif token in (b"T*", b"'", b'"'):
            out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for x in stack:
                if isinstance(x, tuple):
                    out.append(font.text(x[1]))
                elif token == b"TJ" and x not in (b"[", b"]"):
                    try:
                        out.append(" " if float(x) < -SPACE else "")
                    except ValueError:
                        pass
        if token == b"ET":
            out.append("\n")
            row = None
        stack = []
    return "".join(out)


def pages(raw: bytes) -> list[str]:
    """Text of each page; no pages for an encrypted or unreadable file."""
    if re.search(rb"/Encrypt\s+\d", raw):
        return []
    file = File(raw)
    return [_shown(file.content(page), file.fonts(resources)) for page, resources in file.pages()]
