"""Text operators as Spark columns: sentences, boilerplate, vocabulary, atoms' surfaces, pruning and rewriting.

Patterns run with Java's Unicode classes (``(?U)``), which agree with the in-memory forms in ``operators``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed
from gistmill.operators.atoms import JAVA_LINEAR
from gistmill.operators.segment import STOP

U = "(?U)"
MARK = "\x00"
EDGES = U + r"^\s+|\s+$"


def java(kind: str) -> str:
    """Java pattern of an atom class."""
    pattern, fold = next((p, f) for k, p, f, _, _ in fixed.ATOMS if k == kind)
    return (U + "(?i)" if fold else U) + pattern


#: Version words right before an address, as a bounded look behind.
VERSION = r"(?<=(?i:upgrade|upgraded|upgrading|downgrade|downgraded|downgrading)\s{1,9}(?i:from)[\s:#]{0,3}|(?i:version|release|section|upgrade|downgrade|v)[\s:#]{0,3})"


def surfaces(text: Column, kind: str) -> Column:
    """All surfaces of one atom class, in order (short hashes need their surroundings: see ``operators.atoms``)."""
    if kind == "ipv4":  # a version number is matched too, so that no address begins inside it, but not captured
        plain = java(kind).removeprefix(U)
        return F.filter(F.regexp_extract_all(text, F.lit(f"{U}\\b(?=\\d){VERSION}{plain}|({plain})"), F.lit(1)), lambda x: x != "")
    if kind in JAVA_LINEAR:
        pattern, group, front = JAVA_LINEAR[kind]
        found = F.regexp_extract_all(text, F.lit(U + pattern), F.lit(group))
        return F.transform(found, lambda x: F.regexp_replace(x, front, "")) if front else found
    return F.regexp_extract_all(text, F.lit(java(kind)), F.lit(0))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def sentences(text: Column) -> Column:
    """Array of sentences: a mark goes behind every stop, and the text is cut at marks. Texts with NUL lose it here."""
    marked = F.regexp_replace(F.regexp_replace(text, MARK, ""), U + "(" + STOP.replace("{end}", r"\z") + ")", "$1" + MARK)
    return F.filter(F.transform(F.split(marked, MARK), trim), lambda x: x != "")


def is_boilerplate(text: Column) -> Column:
    body = trim(text)
    hit = F.lit(False)
    for pattern, fold in fixed.BOILERPLATE:
        hit = hit | body.rlike(("(?iu)" if fold else "") + pattern.replace(r"\s", r"[\s\x85\xa0]"))
    return F.when(F.length(body) < 3, ~body.rlike(U + r"[\p{L}\p{N}]")).otherwise(hit)


def vocabulary(text: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def canonical_quantity(value: Column, unit: Column) -> Column:
    """Value and canonical unit."""
    table = F.create_map(*[F.lit(x) for kv in fixed.CANONICAL_UNITS.items() for x in kv])
    low = F.lower(unit)
    return F.trim(F.concat_ws(" ", value, F.coalesce(F.try_element_at(table, low), low)))


def discourse_prune(text: Column) -> Column:
    """Without leading scaffolding, the first letter raised if something went."""
    body = trim(text)
    rest = body
    for p in fixed.PREAMBLES:
        rest = F.regexp_replace(rest, U + "(?i)" + p, "")
    return F.when((rest != body) & rest.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)


def phrase_rewrite(text: Column) -> Column:
    """Every wordy phrase by its short form, longest phrase first."""
    for phrase, short, _ in sorted(fixed.PHRASES, key=lambda r: -len(r[0])):
        text = F.regexp_replace(text, rf"{U}(?i)(?<![\w\-/])\Q{phrase}\E(?![\w\-/])", short.replace("$", r"\$"))
    return text


def unit_abbreviate(text: Column) -> Column:
    """Unit words directly behind a number by their short forms."""
    for word, short in fixed.UNIT_ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"{U}(?i)(?<!\d)(\d+(?:\.\d+)?)\s+{word}\b", f"$1 {short}")
    return text


def rewrite_gate(original: Column, candidate: Column, tokens: Column, new_tokens: Column, required: Column) -> Column:
    """The candidate if it saves tokens and keeps every required surface, else the original."""
    kept = F.forall(required, lambda s: F.contains(candidate, s))
    return F.when((candidate != original) & (new_tokens < tokens) & kept, candidate).otherwise(original)


def strip_escapes(text: Column) -> Column:
    return F.regexp_replace(text, fixed.ANSI, "")


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes of UTF-8 before a character position."""
    return F.octet_length(F.substring(text, F.lit(1), chars.cast("int")))


def relation(kind: Column) -> Column:
    """Relation that an atom of a kind stands for; null for others."""
    return (
        F.when(kind == "bound_negation", "negation_scope")
        .when(kind == "modality", "modality_scope")
        .when(kind == "causality", "causality")
        .when(kind == "condition", "condition")
    )


def relation_marker(kind: Column, surface: Column) -> Column:
    """The word that makes the relation: the first of a bound negation, else the whole surface."""
    return F.when(kind == "bound_negation", F.regexp_extract(surface, U + r"^\s*(\S+)", 1)).otherwise(surface)
