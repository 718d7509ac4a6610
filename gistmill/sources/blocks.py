"""What parsers make of a document: blocks, with spans as clean character ranges."""

from __future__ import annotations

from typing import NamedTuple


class Block(NamedTuple):
    tag: str
    kind: str
    text: str
    spans: tuple[tuple[int, int], ...]
    #: copy: the text stands in the source as it is; rewrite: re-serialised by the parser; aggregate: composed of several places
    made: str = "copy"
    meta: dict = {}


def block_id(number: int, tag: str) -> str:
    return f"block_{number:04d}_{tag}"


def trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The range without surrounding white space; None if nothing is left."""
    part = text[start:end]
    body = part.strip()
    if not body:
        return None
    start += len(part) - len(part.lstrip())
    return start, start + len(body)
