"""Protected atoms: identifiers, places, quantities, negations and the like, with places in the clean text.

``find`` works on one text; ``atoms`` is the DataFrame operator (one row per atom, by an Arrow map, as offsets need a
scan); ``surfaces`` in ``functions.text`` is the pure Column form of one class without offsets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from gistmill import fixed
from gistmill.functions.arrow import map_texts
from gistmill.functions.shared import kept

PATTERNS = {kind: re.compile(pattern, re.I if fold else 0) for kind, pattern, fold, _, _ in fixed.ATOMS}
REQUIRED = frozenset(kind for kind, _, _, required, _ in fixed.ATOMS if required)
ENTITY = tuple(kind for kind, _, _, _, entity in fixed.ATOMS if entity)
VERSION_BEFORE, HASH_BESIDE, NOT_HASH = (re.compile(p, re.I) for p in (fixed.VERSION_BEFORE, fixed.HASH_BESIDE, fixed.NOT_HASH))
NEGATION_WORDS = tuple(fixed.NEGATIONS.split("|"))
CAMEL = re.compile("[a-z0-9][A-Z]")

# Two patterns that take more than linear time as they stand have forms with equal matches that do not: a match can only
# begin at the start of a run of its characters (or where the last match ended), and runs are never given back.
NAME, SCHEME = r"a-zA-Z0-9_.\-", r"a-zA-Z0-9+.\-"
_SCHEMED = rf"[0-9+.\-]*+([a-zA-Z][{SCHEME}]*+://[^\s<>\"'()]++)"
_PLACED = rf"arn:aws:[{NAME}]++:[{NAME}]*+:(?:\d{{12}})?:[{NAME}/:*]++|/[{NAME}]++(?:/[{NAME}]++)++|(?<![{NAME}])[{NAME}][a-zA-Z0-9_\-]*+\.[{NAME}]++/[^\s]*+"
# of a chain a/b/c the last part with a word edge, behind it or behind a line number, ends the match; parts of dots and
# dashes alone have none
_PART = rf"\s*+/\s*+[{NAME}]"
_END = r"(?::\d+(?::\d+)?)?\b"
_MORE = rf"(?:\s*+/\s*+[.\-]++(?!\w|:\d))*+{_PART}+{_END}"
_LOCATED = rf"(?:(?!\b)(?:[a-zA-Z0-9_]++|[.\-]++))?\b([{NAME}]++(?:{_PART}++(?={_MORE}))*+{_PART}+{_END})"
#: kind: (what may follow right where the last match ended, the first match anywhere); the first group with a match counts.
LINEAR = {
    "path_or_url": (re.compile(_SCHEMED), re.compile(rf"(?<![{SCHEME}]){_SCHEMED}|({_PLACED})")),
    "file_location": (re.compile(_LOCATED), re.compile(rf"(?<![{NAME}]){_LOCATED}")),
}
#: The same for Java, whose \\G stands where the last match ended: (pattern, group, what to take off a match's front).
JAVA_LINEAR = {
    "path_or_url": (rf"(?:(?<![{SCHEME}])|\G){_SCHEMED}|{_PLACED}", 0, rf"^[0-9+.\-]+(?=[a-zA-Z][{SCHEME}]*+://)"),
    "file_location": (rf"(?:(?<![{NAME}])|\G){_LOCATED}", 1, None),
}
#: Letters that ignoring case equates with ASCII ones, which lower-casing does not; texts with them are always scanned.
DIGIT = re.compile("[0-9]")
FOLDING = re.compile("[\u017f\u0130\u0131\u212a]")
#: What is neither Latin (without those, and the micro sign) nor punctuation. In texts without it, a pattern that ignores case
#: matches where the same in small letters matches the text in small letters, which takes far less time.
BEYOND = re.compile("[^\x00-\xb4\xb6-\u012f\u0132-\u017e\u0180-\u024f\u2000-\u206f]")
LOWER = {kind: re.compile(pattern.lower()) for kind, pattern, fold, _, _ in fixed.ATOMS if fold}
HEX = re.compile("[0-9a-fA-F]{40}")


def _signs(*words: str):
    def found(t) -> bool:
        low = t.low
        for w in words:
            if w in low:
                return True
        return False

    return found


_negated = _signs(*NEGATION_WORDS)


class _Signs:
    """What a text has at all, to skip classes that it cannot hold."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        plain = text.isascii()
        self.digit = not plain or DIGIT.search(text) is not None
        self.sure = plain or not FOLDING.search(text)
        self.small = plain or not BEYOND.search(text)
        self.has_negation = None

    def negated(self) -> bool:
        """Two classes ask for the same words."""
        if self.has_negation is None:
            self.has_negation = _negated(self)
        return self.has_negation


#: A necessary sign of each class, far cheaper than its pattern.
NEEDS = {
    "cve": _signs("cve-"),
    "instance_id": lambda t: t.digit and "i-" in t.text,
    "ipv4": lambda t: t.digit and t.text.count(".") >= 3,
    "ipv6": lambda t: "::" in t.text or t.text.count(":") >= 7,
    "uuid": lambda t: t.text.count("-") >= 4,
    "git_sha": lambda t: len(t.text) >= 40 and HEX.search(t.text) is not None,
    "git_sha_short": lambda t: t.digit and HASH_BESIDE.search(t.text) is not None,
    "path_or_url": lambda t: "/" in t.text or "arn:" in t.text,
    "file_location": lambda t: "/" in t.text,
    "quantity": lambda t: t.digit,
    "currency": lambda t: t.digit and any(w in t.text for w in ("$", "€", "£", "USD", "EUR")),
    "code_identifier": lambda t: "_" in t.text or "::" in t.text or ("-" in t.text and t.digit) or CAMEL.search(t.text) is not None,
    "timestamp": lambda t: t.digit and ("-" in t.text or ":" in t.text),
    "bound_negation": _Signs.negated,
    "cjk_negation": lambda t: not t.text.isascii(),
    "negation": _Signs.negated,
    "modality": _signs("must", "should", "may", "might", "could", "shall"),
    "condition": _signs("if", "unless", "except", "provided", "excluding"),
    "causality": _signs("because", "therefore", "caused", "results", "leads"),
    "compliance_acronym": _signs("pii", "gdpr", "hipaa", "soc2", "mtls", "cidr", "sts", "iam", "acl", "rbac"),
    "email": lambda t: "@" in t.text,
}


class Atom(NamedTuple):
    kind: str
    surface: str
    canonical: str
    start: int
    end: int
    required: bool


def _linear(kind: str, text: str) -> list[tuple[int, int]]:
    here, ahead = LINEAR[kind]
    out, at = [], 0
    while m := (here.match(text, at) if at else None) or ahead.search(text, at):
        out.append(m.span(m.lastindex))
        at = m.end()
    return out


def places(kind: str, text: str, signs: _Signs | None = None) -> list[tuple[int, int]]:
    """Ranges of a class in a text, with the context that addresses and short hashes need."""
    signs = signs or _Signs(text)
    if signs.sure and not NEEDS[kind](signs):
        return []
    if kind in LINEAR:
        return _linear(kind, text)
    found = [m.span() for m in (LOWER[kind].finditer(signs.low) if kind in LOWER and signs.small else PATTERNS[kind].finditer(text))]
    if kind == "ipv4":
        return [(a, b) for a, b in found if not VERSION_BEFORE.search(text[max(0, a - fixed.VERSION_CHARS) : a])]
    if kind == "git_sha_short":
        beside = lambda a, b: HASH_BESIDE.search(text[max(0, a - fixed.HASH_CHARS) : a]) or HASH_BESIDE.search(text[b : b + fixed.HASH_CHARS])
        return [(a, b) for a, b in found if not NOT_HASH.match(text[a:b]) and beside(a, b)]
    return found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges as disjoint sorted ranges; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Cover:
    """Containment in a union of ranges."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = merged(spans)
        self.starts = [a for a, _ in self.spans]

    def holds(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and end <= self.spans[k][1]


def canonical(kind: str, surface: str) -> str:
    if kind != "quantity":
        return surface.lower()
    m = PATTERNS["quantity"].fullmatch(surface)
    unit = (m.group(2) or "").lower() if m else ""
    value = m.group(1) if m else surface
    return f"{value} {fixed.CANONICAL_UNITS.get(unit, unit)}".strip()


@lru_cache(maxsize=256)
def _term(term: str) -> tuple[re.Pattern, re.Pattern | None]:
    """A user's term as a whole word, and for `number unit` a looser form."""
    words = term.split()
    loose = None
    if len(words) == 2 and words[0].isdigit():
        loose = re.compile(rf"\b{re.escape(words[0])}\s*(?:{re.escape(words[1])}|minutes?|hours?|seconds?)\b", re.I)
    return re.compile(rf"(?<![a-zA-Z0-9_]){re.escape(term)}(?![a-zA-Z0-9_])", re.I), loose


def find(text: str, terms: tuple[str, ...] = ()) -> list[Atom]:
    """All atoms in order of detection (class by class, then by place)."""
    out: dict[tuple[int, int, str], Atom] = {}

    def add(kind, spans, name=None, shape=None):
        for a, b in spans:
            surface = text[a:b]
            out.setdefault((a, b, kind), Atom(kind, surface, shape or canonical(name or kind, surface), a, b, kind == "required_term" or (name or kind) in REQUIRED))

    for term in filter(None, terms):
        exact, loose = _term(term)
        if spans := [m.span() for m in exact.finditer(text)]:
            add("required_term", spans)
        elif loose:
            add("required_term", [m.span() for m in loose.finditer(text)], shape=term.lower())
    where: dict[str, list[tuple[int, int]]] = {}
    signs = _Signs(text)
    for kind, *_ in fixed.ATOMS:
        where[kind] = spans = places(kind, text, signs)
        if kind == "code_identifier" and spans:
            taken = Cover(where["path_or_url"] + where["file_location"])
            spans = [s for s in spans if not taken.holds(*s)]
        add(fixed.SHOWN.get(kind, kind), spans, kind)
    return list(out.values())


def possible(texts: list[str]) -> tuple[str, ...]:
    """Classes of ENTITY that any of the texts could hold: signs that all of them together lack, none of them has."""
    signs = _Signs("\n".join(texts))
    return tuple(k for k in ENTITY if not signs.sure or NEEDS[k](signs))


@kept
def entities(text: str, kinds: tuple[str, ...] = ENTITY) -> frozenset[str]:
    """Distinct surfaces of the classes that selection must cover."""
    if not kinds:
        return frozenset()
    signs = _Signs(text)
    return frozenset(text[a:b].strip() for kind in kinds for a, b in places(kind, text, signs))


SCHEMA = "atom_seq int, atom_id string, kind string, surface string, canonical string, start long, end long, required boolean"


def atoms(df: DataFrame, id_col: str = "document_id", text_col: str = "clean_text", terms: tuple[str, ...] = (), by_kind: bool = False) -> DataFrame:
    """One row per atom of every text: the id, then SCHEMA; ``start`` and ``end`` count code points.

    ``by_kind``: the places of every class as they are matched, before classes exclude or join each other (``units.covered``
    says the exclusion as a join).
    """
    types = [("atom_seq", pa.int32()), ("atom_id", pa.string()), ("kind", pa.string()), ("surface", pa.string()), ("canonical", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("required", pa.bool_())]

    def each(text):
        signs = _Signs(text)
        for kind, *_ in fixed.ATOMS:
            for a, b in places(kind, text, signs):
                yield Atom(kind, text[a:b], canonical(kind, text[a:b]), a, b, kind in REQUIRED)

    def rows(text):
        for k, a in enumerate(each(text) if by_kind else find(text, terms)):
            yield k, f"atom_{k:04d}_{a.kind}", a.kind, a.surface, a.canonical, a.start, a.end, a.required

    return map_texts(df, id_col, text_col, rows, SCHEMA, types)
