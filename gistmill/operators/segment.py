"""Sentences with offsets, as one pattern; the Column form of the same pattern is in ``functions.text``."""

from __future__ import annotations

from functools import lru_cache

import regex

from gistmill import fixed
from gistmill.functions.shared import kept

#: What ends a sentence: a run of western stops that is no abbreviation, no pause and is followed by a space, a closing
#: mark or the end; a single stop of another script; or an empty line. The look ahead at its front spares the look behind
#: elsewhere. ``{end}`` differs between regex dialects.
STOP = (
    r"(?=[.!?\nOTHER])(?<!\b(?i:ABBR)\s{0,8})(?:(?<![.!?])(?!\.{2,}+\s*(?:\(|\p{Ll}))[.!?]++(?={end}|[\s\"')\]}»”])|[OTHER]|\n{2,}+)"
).replace("ABBR", fixed.ABBREVIATED).replace("OTHER", fixed.OTHER_STOPS)


@lru_cache(maxsize=1)
def _stop():
    return regex.compile(STOP.replace("{end}", r"\Z"))


@kept
def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence without surrounding white space."""
    cuts = [m.end() for m in _stop().finditer(text)] + [len(text)]
    out, start = [], 0
    for end in cuts:
        part = text[start:end]
        body = part.strip()
        if body:
            at = start + len(part) - len(part.lstrip())
            out.append((at, at + len(body)))
            start = end
    return out
