"""Transactional rewriting: preambles go, wordy phrases and (if asked) technical words get shorter.

A rewrite counts only if it saves tokens and keeps every required surface. The rules that are tried are those whose phrase
stands in the text before any rewrite, longest first.
"""

from __future__ import annotations

import re
from functools import lru_cache

from gistmill import fixed
from gistmill.functions.shared import kept

PREAMBLES = [re.compile(p, re.I) for p in fixed.PREAMBLES]
CODE = re.compile(r"```[\s\S]*?```|`[^`\r\n]+`")
HEADER_LIKE = re.compile(fixed.HEADER_LIKE)


def prune(text: str) -> str:
    """Without leading scaffolding; the first letter is raised only if something went."""
    body = text.strip()
    rest = body
    for p in PREAMBLES:
        rest = p.sub("", rest)
    return rest[:1].upper() + rest[1:] if rest != body and rest[:1].islower() else rest


@lru_cache(maxsize=1)
def rules() -> list[tuple[str, str, str, re.Pattern, bool]]:
    """(phrase, short form, rule, pattern, is abbreviation) by falling length."""
    table = [(*r, False) for r in fixed.PHRASES] + [(w, s, f"abbrev_{w}", True) for w, s in fixed.ABBREVIATIONS.items()]
    return [(p, s, r, re.compile(rf"(?<![\w\-\/]){re.escape(p)}(?![\w\-\/])", re.I), short) for p, s, r, short in sorted(table, key=lambda x: -len(x[0]))]


@lru_cache(maxsize=1)
def unit_rules() -> list[tuple[re.Pattern, str, str]]:
    return [(re.compile(rf"(?<!\d)(\d+(?:\.\d+)?)\s+{re.escape(w)}\b", re.I), s, f"unit_{w}") for w, s in fixed.UNIT_ABBREVIATIONS.items()]


@kept
def candidate(text: str, surfaces: frozenset[str] = frozenset(), pruning: bool = True, abbreviations: bool = False) -> tuple[str, list[str]]:
    """The shortened text and the rules used; code is left alone, as are phrases equal to one of the (lower-case) surfaces."""
    hidden: list[str] = []

    def hide(m):
        hidden.append(m.group())
        return f"\x00{len(hidden) - 1}\x00"

    now, used = CODE.sub(hide, text) if "`" in text else text, []
    if pruning and (shorter := prune(now)) != now:
        now = shorter
        used.append("discourse_prune")
    short_ok = abbreviations and not HEADER_LIKE.match(now)
    present = now.lower()
    for phrase, short, rule, pattern, is_short in [r for r in rules() if r[0] in present and (short_ok or not r[4])]:
        if phrase in surfaces:
            continue
        # a capitalised word inside a unit is likely a name
        changed = pattern.sub(lambda m: m.group() if is_short and m.group()[0].isupper() and m.start() else short, now)
        if changed != now:
            now = changed
            used.append(rule)
    if short_ok:
        for pattern, short, rule in unit_rules():
            changed = pattern.sub(lambda m: f"{m.group(1)} {short}", now)
            if changed != now:
                now = changed
                used.append(rule)
    for k, code in enumerate(hidden):
        now = now.replace(f"\x00{k}\x00", code)
    return now, used


def rewrite(text: str, count, required: list[str], surfaces: frozenset[str], pruning: bool = True, abbreviations: bool = False) -> tuple[str, str | None]:
    """Final text and rule names joined by +; the text itself and None if the rewrite does not count."""
    new, used = candidate(text, surfaces, pruning, abbreviations)
    if new != text and all(s in new for s in required) and count(new) < count(text):
        return new, "+".join(used)
    return text, None
