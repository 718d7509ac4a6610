"""From bytes to clean text: codec choice, escape removal, and offsets back into the bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from gistmill import fixed

ANSI = re.compile(fixed.ANSI)
#: Codec names as Spark's ``decode`` takes them, with the bytes to skip at the start.
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


class Rejected(Exception):
    """A document that is not compiled; ``status`` says why."""

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


def utf16_without_mark(raw: bytes) -> str | None:
    """utf-16-le or utf-16-be if NUL bytes sit mostly at one parity, 'ambiguous' if they are many but on both, else None."""
    sample = np.frombuffer(raw[: fixed.SNIFF_BYTES], dtype=np.uint8)
    sample = sample[: len(sample) // 2 * 2].reshape(-1, 2) == 0
    if sample.size < 4 or sample.mean() < fixed.NUL_RATIO:
        return None
    even, odd = sample.mean(axis=0)
    if even > fixed.DOMINANT_RATIO and odd < fixed.MINORITY_RATIO:
        return "utf-16-be"
    if odd > fixed.DOMINANT_RATIO and even < fixed.MINORITY_RATIO:
        return "utf-16-le"
    return "ambiguous"


def codec_of(raw: bytes) -> tuple[str, int]:
    """Codec and length of the byte order mark."""
    for mark, codec in BOMS:
        if raw.startswith(mark):
            return codec, len(mark)
    wide = utf16_without_mark(raw)
    if wide == "ambiguous":
        raise Rejected("UNDECODABLE_INPUT", "many NUL bytes without a byte order mark; the byte order cannot be told")
    if wide:
        return wide, 0
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return "latin-1", 0
    return "utf-8", 0


@dataclass
class Source:
    """One document: bytes that spans index, codec, decoded and clean text."""

    raw: bytes
    codec: str = "utf-8"
    skip: int = 0

    @cached_property
    def decoded(self) -> str:
        return self.raw[self.skip :].decode(self.codec, errors="replace")

    @cached_property
    def clean(self) -> str:
        return ANSI.sub("", self.decoded)

    @cached_property
    def _bytes_at(self) -> np.ndarray:
        """Byte offset of each character of the decoded text, and of its end."""
        points = np.frombuffer(self.decoded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if self.codec == "utf-8":
            width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        elif self.codec == "latin-1":
            width = np.ones(len(points), dtype=np.int64)
        else:
            width = 2 + 2 * (points > 0xFFFF).astype(np.int64)
        return self.skip + np.concatenate([[0], np.cumsum(width)])

    @cached_property
    def _kept(self) -> np.ndarray | None:
        """Decoded index of each clean character; None if they are the same."""
        if len(self.clean) == len(self.decoded):
            return None
        keep = np.ones(len(self.decoded), dtype=bool)
        for m in ANSI.finditer(self.decoded):
            keep[m.start() : m.end()] = False
        return np.flatnonzero(keep)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Byte span of clean characters from start to end."""
        if not 0 <= start <= end <= len(self.clean):
            raise ValueError(f"characters {start} to {end} are out of bounds")
        if self._kept is not None:
            places = self._kept
            first = int(places[start]) if start < len(places) else len(self.decoded)
            end = first if start == end else int(places[end - 1]) + 1
            start = first
        if self.decoded.isascii() and self.codec in ("utf-8", "latin-1"):
            return self.skip + start, self.skip + end
        return int(self._bytes_at[start]), int(self._bytes_at[end])

    def characters(self, start: int, end: int) -> tuple[int, int]:
        """Decoded character range that byte positions start to end touch."""
        at = self._bytes_at
        return int(np.searchsorted(at, start, "left")), max(int(np.searchsorted(at, end, "right")) - 1, 0)

    def text_at(self, start: int, end: int) -> str:
        """Decoded text of a byte span, without escapes."""
        return ANSI.sub("", self.raw[start:end].decode(self.codec, errors="replace"))


def read(raw: bytes, most: int = fixed.MAX_BYTES) -> Source:
    if len(raw) > most:
        raise Rejected("INPUT_TOO_LARGE", f"{len(raw)} bytes are more than {most}")
    return Source(raw, *codec_of(raw))
