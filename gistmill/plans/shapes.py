"""Compilation by shape: short documents that differ in their numbers alone are compiled once, then filled in.

A shape is a text with its numbers (runs of digits without leading zeros) taken out, their lengths, and which of them are
equal, as far as that counts. No stage reads a number's value, but for the few that ``VALUES`` names: patterns take digits as
a class, counts and costs go by lengths, ranks and choices by which words of units are equal. So documents of one shape have
the same blocks, units, spans, choice and metrics, and their texts and manifests differ where the source's numbers stand. What
would hang on one surface standing inside another by chance has no shape: every atom is held with its place, or has no number.

A shape is learnt when it is met again, from two documents with other numbers, which show what comes from where; if their
results differ in anything but numbers of the source, documents of that shape are compiled one by one.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache
from typing import NamedTuple

from gistmill.operators import rewrite
from gistmill.operators.atoms import ENTITY, Atom, places
from gistmill.operators.validate import check_manifest
from gistmill.plans import compile as plan
from gistmill.sources import plain

NUMBER = re.compile("([1-9][0-9]*)")
DIGIT, WORD = re.compile("[0-9]"), re.compile(r"\w+")
#: Characters and numbers of a text that has a shape at most, and shapes (and texts met once) that a worker keeps.
MOST_CHARS, MOST_NUMBERS, KEPT, MET = 1024, 64, 1 << 14, 1 << 17
ROUTES = frozenset(("test_log", "code", "email", "markdown", "text"))
#: Where a value may count: addresses, ``::1``, names of hashes and standards with a number, headings of HTML, first items of lists.
VALUES = re.compile(r"\d\.\d+\.\d+\.\d|::\d|(?i:sha\d|soc\d|<h\d)|(?m:^[\s>]*\d{1,9}[.)])|\A\s*[<{\[]|[\x00\x01\x1b\ufeff\ue000-\uf8ff]")


class Shape(NamedTuple):
    route: str
    metrics: dict
    #: What stands between numbers, and for each number its place among the source's (-1: the document's id).
    text: tuple[list[str], list[int]]
    manifest: tuple[list[str], list[int]]
    #: Bytes of the source and of the text that a copy says are equal; segments; None if one needs more than comparing bytes.
    copies: list[tuple[int, int, int, int]] | None
    verified: tuple[str, int, str]


def filled(template: tuple[list[str], list[int]], values: list[str]) -> str:
    parts, at = template
    out = parts.copy()
    out[1::2] = [values[i] for i in at]
    return "".join(out)


def others(classes: list[int], lengths: tuple[int, ...]) -> tuple[list[str], list[str]] | None:
    """Two lists of numbers of these lengths, equal where the classes are and nowhere else, each class with two values."""
    rng, values, used = random.Random(len(lengths)), {}, (set(), set())
    for c, length in zip(classes, lengths):
        if c in values:
            continue
        if length == 1:
            k = sum(len(v[0]) == 1 for v in values.values())
            if k == 9:
                return None
            values[c] = str(k + 1), str((k + 1) % 9 + 1)
            continue
        one = two = ""
        while not one or one in used[0]:
            one = str(rng.randrange(10 ** (length - 1), 10**length))
        while not two or two in used[1] or two == one:
            two = str(rng.randrange(10 ** (length - 1), 10**length))
        values[c] = one, two
        used[0].add(one)
        used[1].add(two)
    return [values[c][0] for c in classes], [values[c][1] for c in classes]


def joined(parts: list[str], numbers: list[str]) -> str:
    out = parts.copy()
    out[1::2] = numbers
    return "".join(out)


def template(one: str, two: str, at: dict[str, int], other: dict[str, str]) -> tuple[list[str], list[int]] | None:
    """What two results have in common, with places for the source's numbers; None if they differ in anything else."""
    a, b = NUMBER.split(one), NUMBER.split(two)
    if a[::2] != b[::2]:
        return None
    parts, slots = [a[0]], []
    for x, y, rest in zip(a[1::2], b[1::2], a[2::2]):
        if x == y:
            parts[-1] += x + rest
        elif other.get(x) == y:
            parts += ["", rest]
            slots.append(at[x])
        else:
            return None
    # \x01 stands for the document's id
    out, where = [], []
    for k, part in enumerate(parts[::2]):
        first, *more = part.split("\x01")
        out.append(first)
        for x in more:
            out += ["", x]
            where.append(-1)
        if k < len(slots):
            out.append("")
            where.append(slots[k])
    return out, where


def whole(text: str, spans) -> bool:
    """Whether no span cuts a run of digits."""
    return not any(0 < i < len(text) and text[i - 1] in "0123456789" and text[i] in "0123456789" for s in spans for i in s)


class Shapes:
    """Compiles documents under one policy; what it learns stays in the worker."""

    def __init__(self, policy):
        self.policy = policy
        self.met: set[int] = set()
        #: By text between numbers and their lengths: the numbers whose equality counts (None: no shape), and shapes by what is equal.
        self.known: dict[tuple, tuple[tuple[int, ...] | None, dict]] = {}
        self.size = 0
        # files count tokens by what digits are, and terms may name numbers
        self.none = policy.profile().is_exact or bool(policy.required_terms)

    def find(self, raw: bytes) -> tuple[Shape | None, list[str] | None]:
        """The shape of a document, and its numbers."""
        if self.none or len(raw) > MOST_CHARS or not raw.strip():
            return None, None
        try:
            parts = NUMBER.split(raw.decode())
        except UnicodeDecodeError:
            return None, None
        numbers = parts[1::2]
        if len(numbers) > MOST_NUMBERS:
            return None, None
        key = ("\0".join(parts[::2]), tuple(map(len, numbers)))
        entry = self.known.get(key)
        if entry is None:
            if (met := hash(key)) not in self.met:
                if len(self.met) >= MET:
                    self.met.clear()
                self.met.add(met)
                return None, None
            entry = self.keep(self.known, key, (self.counting(parts), {}))
        counts, shapes_ = entry
        if counts is None:
            return None, None
        same = None
        if counts:
            own = [numbers[i] for i in counts]
            same = tuple(map(own.index, own)) if len(set(own)) < len(own) else None
        if same not in shapes_:
            self.keep(shapes_, same, self.learn(parts, counts, same))
        return shapes_[same], numbers

    def keep(self, where: dict, key, value):
        if self.size >= KEPT:
            self.known.clear()
            self.size = 0
        self.size += 1
        where[key] = value
        return value

    def counting(self, parts: list[str]) -> tuple[int, ...] | None:
        """The numbers whose being equal may count: those in words of units that may be the same but for their numbers.

        None does if every unit is chosen for what it is: mandatory, or alone in having some entity.
        """
        text = "".join(parts)
        if VALUES.search(text) or not text.isascii() and any(c.isdigit() for c in text if not c.isascii()):
            return None
        numbers = parts[1::2]
        every = tuple(range(len(numbers)))
        distinct = others(list(every), tuple(map(len, numbers)))
        if distinct is None:
            return every
        trace: dict = {}
        plan.compile_bytes(joined(parts, distinct[0]).encode(), self.policy, trace)
        if not trace:
            return None
        t = trace["table"]
        blank = lambda x: NUMBER.sub(lambda m: "\0" * len(m.group()), x)
        entities = [{blank(e) for e in own} for own in t.entities]
        alone = [own - set().union(*entities[:i], *entities[i + 1 :]) for i, own in enumerate(entities)]
        if self.policy.tokens is None and all(must or own or len(t) == 1 for must, own in zip(t.mandatory, alone)):
            return ()
        place, words = {n: i for i, n in enumerate(distinct[0])}, {}
        for u in t.texts:
            for word in WORD.findall(u):
                for k, n in enumerate(NUMBER.findall(word)):
                    if n in place:
                        words.setdefault((blank(word), k), set()).add(place[n])
        return tuple(sorted(set().union(*(own for own in words.values() if len(own) > 1))))

    def learn(self, parts: list[str], counts: tuple[int, ...], same: tuple[int, ...] | None) -> Shape | None:
        numbers = parts[1::2]
        classes = list(range(len(numbers)))
        for i, k in zip(counts, same or ()):
            classes[i] = counts[k]
        values = others(classes, tuple(map(len, numbers)))
        if values is None:
            return None
        at, other = {}, dict(zip(*values))
        for i, n in enumerate(values[0]):
            at.setdefault(n, i)
        raws, traces = [joined(parts, v).encode() for v in values], ({}, {})
        one, two = (plan.compile_bytes(x, self.policy, t) for x, t in zip(raws, traces))
        if one["status"] != "OK" or one["route"] not in ROUTES or {**one, "text": "", "manifest": ""} != {**two, "text": "", "manifest": ""}:
            return None
        ids = ["sha256:" + hashlib.sha256(x).hexdigest() for x in raws]
        shown = template(one["text"], two["text"], at, other)
        manifest = template(one["manifest"].replace(ids[0], "\x01"), two["manifest"].replace(ids[1], "\x01"), at, other)
        if shown is None or manifest is None or not self.sure(raws[0].decode(), traces, shown, at, other):
            return None
        checks = [check_manifest(x, r["text"], r["manifest"]) for x, r in zip(raws, (one, two))]
        if checks[0] != checks[1]:
            return None
        copies = [(*s["spans"][0], s["output_start"], s["output_end"]) for s in traces[0]["segments"] if s["kind"] == "copy"]
        output = one["text"].encode()
        exact = checks[0][0] == "PASSED" and all(raws[0][a:b] == output[c:d] for a, b, c, d in copies)
        return Shape(one["route"], one["metrics"], shown, manifest, copies if exact else None, checks[0])

    def sure(self, text: str, traces: tuple[dict, dict], shown: tuple[list[str], list[int]], at: dict[str, int], other: dict[str, str]) -> bool:
        """Whether nothing in a document's result hangs on what its numbers are."""
        stages, segments = traces[0]["stages"], traces[0]["segments"]
        source = stages.source
        if (source.codec, source.skip) != ("utf-8", 0) or source.clean != text or any(b.made == "rewrite" for b in stages.blocks):
            return False
        if plain._may_split([text.strip()[a:b] for a, b in plain.lines_of(text.strip())[:10]]):
            return False
        if any(s["kind"] == "copy" and len(s["spans"]) != 1 for s in segments):
            return False
        # a number that a parser adds could be equal to one of the source
        for u, v in zip(stages.units, traces[1]["stages"].units, strict=True):
            own = template(u.text, v.text, at, other)
            if own is None or NUMBER.search("".join(own[0])):
                return False
        found = [a for _, a in stages.atoms]
        if not whole(text, ((a.start, a.end) for a in found)) or not all(whole(u.text, places(kind, u.text)) for u in stages.units for kind in ENTITY):
            return False
        # numbers of the source as single characters: one text holds another for all numbers if it does so written thus
        signs = {n: chr(0xE000 + i) for n, i in at.items()}
        written = lambda x: NUMBER.sub(lambda m: signs.get(m.group(), m.group()), x)
        output = filled(shown, [signs[n] for n in NUMBER.findall(text)])
        lower = output.lower()

        def held(a: Atom) -> bool:
            return written(a.surface) in output or written(a.canonical) in lower and (a.kind == "quantity" or not a.required)

        if not all(held(a) or not DIGIT.search(a.surface) for a in found):
            return False
        if self.policy.mode in ("compact", "task"):
            by_number = dict(stages.atoms)
            for s in segments:
                u = stages.units[s["unit"]]
                bound = [by_number[k] for k in u.atoms]
                if not any(a.required and DIGIT.search(a.surface) for a in bound):
                    continue
                surfaces = frozenset(a.surface.lower() for a in bound)
                if rewrite.candidate(u.text, surfaces, self.policy.discourse_pruning, self.policy.abbreviations)[0] != u.text:
                    return False
        return True

    def compile(self, raw: bytes, document_id: str | None, text: bool = True, manifest: bool = True) -> dict:
        """``compile_bytes``; text and manifest may be left out of what is filled in."""
        shape, numbers = self.find(raw)
        if shape is None:
            return plan.compile_bytes(raw, self.policy)
        numbers.append(document_id)
        return {"status": "OK", "route": shape.route, "text": filled(shape.text, numbers) if text else "", "metrics": shape.metrics, "manifest": filled(shape.manifest, numbers) if manifest else "", "diagnostics": []}

    def check(self, raw: bytes, document_id: str) -> tuple[str, int, str]:
        """``check_manifest`` of the compiled document: its hash, and every copy's bytes; the rest by shape."""
        shape, numbers = self.find(raw)
        if shape is not None and shape.copies is not None and document_id == "sha256:" + hashlib.sha256(raw).hexdigest():
            output = filled(shape.text, numbers).encode()
            if all(raw[a:b] == output[c:d] for a, b, c, d in shape.copies):
                return shape.verified
        r = plan.compile_bytes(raw, self.policy)
        return check_manifest(raw, r["text"], r["manifest"])


@lru_cache(maxsize=8)
def shapes(policy) -> Shapes:
    return Shapes(policy)
