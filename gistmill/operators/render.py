"""Rendering: joined text, segments with output byte ranges, metrics and the manifest."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill.operators.atoms import Atom
from gistmill.operators.validate import held
from gistmill.sources.decode import Source

VERSION = "1.0"


def place(segments: list[dict]) -> str:
    """The joined text; sets each segment's output byte range."""
    at = 0
    for s in segments:
        size = len(s["text"].encode())
        s["output_start"], s["output_end"] = at, at + size
        at += size + 1
    return "\n".join(s["text"] for s in segments)


def metrics(text: str, segments: list[dict], source: Source, atoms: list[tuple[int, Atom]], count) -> tuple[dict, list[tuple[int, Atom]]]:
    """The metrics and the required atoms that the text holds."""
    lower = text.lower()
    required = [x for x in atoms if x[1].required]
    kept = [x for x in required if held(x[1], text, lower)]
    shown = sum(a.surface in text or a.canonical in lower for _, a in atoms)
    before, after = count(source.clean), count(text)
    kinds = [s["kind"] for s in segments]
    return {
        "input_bytes": len(source.raw),
        "output_bytes": len(text.encode()),
        "input_tokens": before,
        "output_tokens": after,
        "compression_ratio": round(1 - after / max(1, before), 4),
        "required_atom_coverage": round(len(kept) / len(required), 4) if required else 1.0,
        "retained_required_atoms_count": len(kept),
        "total_required_atoms_count": len(required),
        "total_atom_coverage": round(shown / max(1, len(atoms)), 4),
        "retained_atoms_count": shown,
        "total_atoms_count": len(atoms),
        "copy_segments_count": kinds.count("copy"),
        "rewrite_segments_count": kinds.count("rewrite"),
        "aggregate_segments_count": kinds.count("aggregate"),
    }, kept


def span_dicts(document_id: str, spans) -> list[dict]:
    return [{"document_id": document_id, "start": a, "end": b} for a, b in spans]


def manifest(document_id: str, route: str, source: Source, segments: list[dict], kept: list[tuple[int, Atom]], numbers: dict, profile, mode: str) -> str:
    about = {"document_id": document_id, "byte_length": len(source.raw), "format": route if route in ("pdf", "docx") else "text", "codec": source.codec}
    if about["format"] == "text":
        about["span_basis"] = "raw_bytes"
    else:
        about |= {"span_basis": "extracted_text", "extracted_text_sha256": "sha256:" + hashlib.sha256(source.raw).hexdigest()}
    return json.dumps(
        {
            "schema_version": VERSION,
            "status": "OK",
            "source": about,
            "environment": {"mode": mode},
            "tokenizer": {"profile": profile.name, "exact": profile.is_exact},
            "metrics": numbers,
            "output_segments": [{"output_start": s["output_start"], "output_end": s["output_end"], "kind": s["kind"], "sources": span_dicts(document_id, s["spans"]), "rule_id": s["rule_id"]} for s in segments],
            "atoms": [{"atom_id": f"atom_{k:04d}_{a.kind}", "kind": a.kind, "surface": a.surface, "canonical": a.canonical, "sources": span_dicts(document_id, [source.span(a.start, a.end)]), "confidence": 1.0, "required": True} for k, a in kept],
            "diagnostics": [],
        },
        ensure_ascii=False,
    )


# ---- relational forms ------------------------------------------------------------------------------------------------
def output_offsets(parts: DataFrame, by: str = "document_id", order: str = "unit_seq", text: str = "text") -> DataFrame:
    """``out_start`` and ``out_end``: byte ranges of the parts when joined by newlines in order."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length(text) + 1).over(before), F.lit(0)).cast("long")
    return parts.withColumn("out_start", start).withColumn("out_end", start + F.octet_length(text))


def joined(parts: DataFrame, by: str = "document_id", order: str = "unit_seq", text: str = "text") -> DataFrame:
    """(by, text): the parts of each document joined by newlines in order."""
    whole = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return parts.groupBy(by).agg(whole.alias("_all")).select(by, F.array_join(F.transform("_all", lambda x: x["t"]), "\n").alias(text))
