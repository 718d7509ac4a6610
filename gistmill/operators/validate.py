"""Checks of a compiled document against its source: in memory for one document, and as a job over stored manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.operators.atoms import Atom
from gistmill.sources.decode import ANSI, Source


def _same(text: str) -> str:
    return text.strip().replace("\r\n", "\n")


def held(atom: Atom, output: str, lower: str) -> bool:
    """Whether an atom stands in the output, a quantity also in its canonical form."""
    return atom.surface in output or (atom.kind == "quantity" and bool(atom.canonical) and atom.canonical in lower)


def violations(output: str, segments: list[dict], source: Source, required: list[Atom], tokens: int | None = None, most: int | None = None) -> list[str]:
    """All broken invariants: provenance of segments, presence of required atoms, the hard budget."""
    out, size, normal = [], len(source.raw), output.replace("\r\n", "\n")
    for s in segments:
        spans = s["spans"]
        if s["kind"] == "copy":
            for a, b in spans:
                want = _same(source.text_at(a, b))
                if len(spans) == 1 and want and _same(ANSI.sub("", s["text"])) != want:
                    out.append(f"Provenance violation: copied text differs from source bytes [{a}, {b}): '{s['text'][:30]}'")
                elif len(spans) > 1 and want and want not in normal:
                    out.append(f"Provenance violation: source bytes [{a}, {b}) not found in the output")
            continue
        if s["kind"] == "rewrite" and not s["rule_id"]:
            out.append("Provenance violation: rewrite segment without rule_id")
        out += [f"Provenance violation: {s['kind']} segment with source span [{a}, {b}) out of bounds" for a, b in spans if not 0 <= a <= b <= size]
    lower = output.lower()
    out += [f"Atom violation: required atom '{a.surface}' ({a.kind}) was dropped" for a in required if not held(a, output, lower)]
    if most is not None and tokens is not None and tokens > most:
        out.append(f"Budget violation: {tokens} tokens exceed the budget of {most}")
    return out


# ---- relational forms ------------------------------------------------------------------------------------------------
def copy_violations(segments: DataFrame, sources: DataFrame, by: str = "document_id") -> DataFrame:
    """UTF-8 copy segments (by, unit_seq, start, end, text) whose bytes differ from the source's (by, content)."""
    s = sources.select(F.col(by).alias("_doc"), "content")
    joined = segments.join(s, segments[by] == s["_doc"])
    piece = F.decode(F.substring(F.col("content"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    same = F.replace(F.trim(piece), F.lit("\r\n"), F.lit("\n")) == F.replace(F.trim("text"), F.lit("\r\n"), F.lit("\n"))
    return joined.where(~same).drop("_doc", "content")


def missing_required(atoms: DataFrame, outputs: DataFrame, by: str = "document_id") -> DataFrame:
    """Anti join: required atoms that stand nowhere in their document's output (by, text)."""
    o = outputs.select(F.col(by).alias("_doc"), F.col("text").alias("_text"))
    shown = F.contains(F.col("_text"), F.col("surface")) | ((F.col("kind") == "quantity") & F.contains(F.lower("_text"), F.col("canonical")))
    return atoms.where("required").join(o, (atoms[by] == o["_doc"]) & shown, "left_anti")


def check_manifest(raw: bytes, text: str, manifest: str) -> tuple[str, int, str]:
    """(verdict, verified segments, message): PASSED, FAILED, or UNVERIFIED if nothing could be checked."""
    import hashlib

    from gistmill.sources import office

    try:
        m = json.loads(manifest)
        about, segments = m["source"], m["output_segments"]
    except (ValueError, KeyError, TypeError):
        return "FAILED", 0, "the manifest cannot be read"
    if about.get("document_id") != "sha256:" + hashlib.sha256(raw).hexdigest():
        return "FAILED", 0, "the source's hash differs from the manifest's"
    codec = about.get("codec", "utf-8")
    if about.get("span_basis") == "extracted_text":
        extract = {"pdf": office.pdf, "docx": office.docx}.get(about.get("format"))
        if extract is None:
            return "FAILED", 0, "unknown format of extracted text"
        raw, codec = extract(raw)[1].encode(), "utf-8"
        if "sha256:" + hashlib.sha256(raw).hexdigest() != about.get("extracted_text_sha256"):
            return "FAILED", 0, "the extracted text's hash differs from the manifest's"
    source, output, verified = Source(raw, codec), text.encode(), 0
    for s in segments:
        spans = [(x.get("start", -1), x.get("end", -1)) for x in s.get("sources", [])]
        if s.get("kind") == "copy":
            own = _same(ANSI.sub("", output[s["output_start"] : s["output_end"]].decode("utf-8", "replace")))
            for a, b in spans:
                want = _same(source.text_at(a, b))
                if want and (want != own if len(spans) == 1 else want not in text):
                    return "FAILED", verified, f"source span [{a}, {b}) does not match its output segment"
                verified += 1
            continue
        if s.get("kind") == "rewrite" and not s.get("rule_id"):
            return "FAILED", verified, "a rewrite segment has no rule_id"
        if not spans or any(not 0 <= a <= b <= len(raw) for a, b in spans):
            return "FAILED", verified, "a segment's source span is out of bounds"
        verified += 1
    return ("PASSED", verified, f"{verified} segments verified") if verified else ("UNVERIFIED", 0, "no segment could be verified")
