"""Parsers of test runner output: a summary, then one block for each failure."""

from __future__ import annotations

import re

from gistmill import fixed
from gistmill.sources.blocks import Block
from gistmill.sources.plain import log_lines

R = {
    name: re.compile(getattr(fixed, name), flags)
    for flags, names in (
        (0, ("CARGO_HEAD", "CARGO_RESULT", "CARGO_FAILED", "CARGO_ASSERT", "CARGO_PLACE", "PYTEST_HEAD", "PYTEST_RESULT", "PYTEST_PLACE", "PYTEST_ASSERT", "VITEST_FAIL", "VITEST_PLACE", "VITEST_EXPECT")),
        (re.DOTALL, ("CARGO_SECTION", "PYTEST_SECTION", "VITEST_RESULT")),
    )
    for name in names
}


def is_test_log(text: str) -> bool:
    return bool(R["CARGO_HEAD"].search(text) or R["PYTEST_HEAD"].search(text)) or any(mark in text for mark in fixed.LOG_MARKS)


def _first(name: str, text: str, group: int = 1) -> str:
    m = R[name].search(text)
    return (m.group(group) or "") if m else ""


def _summary(passed, failed, took: str, span: tuple[int, int], runner: str) -> Block:
    text = f"✓ {int(passed or 0)} · ✗ {int(failed or 0)}" + (f" · {took}" if took else "")
    return Block("test_summary", "log", text, (span,), "aggregate", {"runner": runner})


def _failure(name: str, notes: list[str], span: tuple[int, int], runner: str) -> Block:
    return Block("test_failure", "log", "".join([f"✗ {name}", *notes]), (span,), "aggregate", {"runner": runner, "test_name": name})


def _expected(m: re.Match | None, want: int, got: int) -> list[str]:
    return [f" · exp: {m.group(want).strip()} got: {m.group(got).strip()}"] if m else []


def _sections(text: str, runner: str, section: str, place: str, check: str) -> list[Block]:
    out = []
    for m in R[section].finditer(text):
        where = _first(place, m.group(2))
        notes = ([f" ({where})"] if where else []) + _expected(R[check].search(m.group(2)), 2, 1)
        out.append(_failure(m.group(1), notes, m.span(), runner))
    return out


def test_log(text: str) -> list[Block]:
    head = (0, min(50, len(text)))
    if R["CARGO_HEAD"].search(text):
        m = R["CARGO_RESULT"].search(text)
        found = _sections(text, "cargo", "CARGO_SECTION", "CARGO_PLACE", "CARGO_ASSERT")
        found = found or [_failure(f.group(1), [], f.span(), "cargo") for f in R["CARGO_FAILED"].finditer(text)]
        first = _summary(m.group(2), m.group(3), m.group(5), m.span(), "cargo") if m else _summary(0, 0, "", head, "cargo")
        return [first, *found]
    if R["PYTEST_HEAD"].search(text):
        m = R["PYTEST_RESULT"].search(text)
        first = _summary(m.group(2), m.group(1), m.group(3), m.span(), "pytest") if m else _summary(0, 0, "", head, "pytest")
        return [first, *_sections(text, "pytest", "PYTEST_SECTION", "PYTEST_PLACE", "PYTEST_ASSERT")]
    if "FAIL " in text and ("Test Files" in text or "Duration" in text):
        fail, place, m = R["VITEST_FAIL"].search(text), R["VITEST_PLACE"].search(text), R["VITEST_RESULT"].search(text)
        notes = _expected(R["VITEST_EXPECT"].search(text), 1, 2) + ([f" · {place.group(1).strip()}"] if place else [])
        start, end = fail.start() if fail else 0, place.end() if place else len(text)
        span = (start, end) if start <= end else (start, len(text))
        failed = (m.group(1) if m else None) or 1
        return [_summary(m.group(2) if m else 0, failed, m.group(3) if m else "", head, "vitest"), _failure(fail.group(1).strip() if fail else "test", notes, span, "vitest")]
    return log_lines(text)
