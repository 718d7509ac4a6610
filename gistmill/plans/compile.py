"""Compilation of many documents: one row in, one row out, without a shuffle.

Every document is independent and at most ten megabytes, so the physical plan that scales is a map: a document goes to one Python worker,
all ten stages run there, and the result row comes back. Identity and the size gate are columns, so that
oversized content never leaves the JVM. The relational forms in ``operators`` are for queries over stages.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import fixed
from gistmill.functions import route as R
from gistmill.functions.arrow import bounded, spread
from gistmill.functions.tokens import Profile, profile
from gistmill.operators import rank, render, rewrite, select, validate
from gistmill.operators.atoms import Atom, entities, find, possible
from gistmill.operators.units import Unit, in_blocks, units
from gistmill.sources.blocks import Block, block_id
from gistmill.sources.decode import Rejected, Source
from gistmill.sources.router import parse

MODES = ("verbatim", "strict", "compact", "task")


@dataclass(frozen=True)
class Policy:
    """How documents are compiled. ``tokens`` None: cut at the knee of vocabulary coverage; else a budget, hard or soft."""

    mode: str = "compact"
    required_terms: tuple[str, ...] = ()
    tokens: int | None = None
    hard_budget: bool = True
    tokenizer: str = "openai:cl100k_base"
    tokenizer_path: str | None = None
    tokenizer_pattern: str | None = None
    preserve_failures: bool = True
    max_k_neighbors: int = fixed.NEIGHBOURS
    pagerank_damping: float = fixed.DAMPING
    discourse_pruning: bool = True
    filter_boilerplate: bool = True
    abbreviations: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        self.profile()

    def profile(self) -> Profile:
        return profile(self.tokenizer, self.tokenizer_path, self.tokenizer_pattern)


@dataclass
class Stages:
    """All intermediate tables of one document."""

    route: str
    source: Source
    blocks: list[Block]
    atoms: list[tuple[int, Atom]]
    units: list[Unit]


def analyse(raw: bytes, policy: Policy, upto: str = "units") -> Stages:
    """Route and blocks, atoms in kept zones, and units: the stages up to the named one."""
    route, source, blocks = parse(raw)
    s = Stages(route, source, blocks, [], [])
    if upto != "blocks" and blocks:
        s.atoms = in_blocks(find(source.clean, policy.required_terms), blocks)
    if upto == "units":
        s.units = units(blocks, s.atoms, policy.filter_boilerplate)
    return s


def table(s: Stages, policy: Policy, count) -> select.Table:
    required = {k for k, a in s.atoms if a.required}
    texts = [u.text for u in s.units]
    must = [bool(required.intersection(u.atoms)) or (policy.preserve_failures and "test_failure" in u.block_id) or "_decision" in u.block_id or "_request" in u.block_id for u in s.units]
    scores = rank.scores(texts, policy.max_k_neighbors, policy.pagerank_damping)
    kinds = possible(texts)
    return select.Table(texts, [count(t) for t in texts], [entities(t, kinds) for t in texts], must, scores, [u.kind == "heading" for u in s.units])


def close(chosen: list[int], headings: list[bool]) -> list[int]:
    """The chosen units and the nearest heading before each."""
    out, last, above = set(chosen), None, []
    for i, h in enumerate(headings):
        above.append(last)
        last = i if h else last
    return sorted(out | {above[i] for i in chosen if above[i] is not None})


def _segments(s: Stages, chosen: list[int], policy: Policy, count) -> list[dict]:
    by_number, out = dict(s.atoms), []
    for i in chosen:
        u = s.units[i]
        bound = [by_number[k] for k in u.atoms]
        text, rule = u.text, None
        if policy.mode in ("compact", "task"):
            required = [a.surface for a in bound if a.required]
            text, rule = rewrite.rewrite(u.text, count, required, frozenset(a.surface.lower() for a in bound), policy.discourse_pruning, policy.abbreviations)
        kind = "rewrite" if rule else u.made
        out.append({"unit": i, "text": text, "kind": kind, "rule_id": rule or ("parser_structural" if kind == "rewrite" else None), "spans": [s.source.span(a, b) for a, b in u.spans]})
    return out


def _result(status: str, route: str | None = None, text: str = "", numbers: dict | None = None, manifest: dict | str | None = None, diagnostics: tuple = ()) -> dict:
    shown = manifest if isinstance(manifest, str) else json.dumps(manifest or {"status": status}, ensure_ascii=False)
    return {"status": status, "route": route, "text": text, "metrics": numbers, "manifest": shown, "diagnostics": list(diagnostics)}


def compile_bytes(raw: bytes, policy: Policy = Policy(), trace: dict | None = None) -> dict:
    """Status, route, text, metrics, manifest (JSON) and diagnostics of one document. Never raises for a document's sake.

    ``trace`` gets the stages, table and segments of a document that is rendered.
    """
    if not raw.strip():
        return _result("OK", "empty", numbers={"input_tokens": 0, "output_tokens": 0}, manifest={"status": "EMPTY"})
    document_id = "sha256:" + hashlib.sha256(raw).hexdigest()
    try:
        s = analyse(raw, policy)
    except Rejected as e:
        return _result(e.status, manifest={"schema_version": render.VERSION, "status": e.status, "error": str(e)}, diagnostics=(str(e),))
    tokenizer = policy.profile()
    count = tokenizer.count
    t = table(s, policy, count)
    try:
        if policy.tokens is None:
            chosen = select.select_free(t)
        else:
            required = {k for k, a in s.atoms if a.required}
            chosen = select.select_within(t, policy.tokens, policy.hard_budget, count, [required.intersection(u.atoms) for u in s.units])
    except select.OverBudget as e:
        by_number = dict(s.atoms)
        numbers = {"requested_tokens": e.requested, "minimum_safe_tokens": e.minimum}
        about = {"schema_version": render.VERSION, "status": "TARGET_BUDGET_UNSAFE", "source": {"document_id": document_id}, "budget": numbers, "missing_atoms": [by_number[k].surface for k in e.missing], "mandatory_unit_ids": [f"unit_{i:04d}" for i in e.kept]}
        return _result("TARGET_BUDGET_UNSAFE", s.route, numbers=numbers, manifest=about, diagnostics=(str(e),))
    segments = _segments(s, close(chosen, t.headings), policy, count)
    text = render.place(segments)
    if trace is not None:
        trace.update(stages=s, table=t, segments=segments)
    broken = validate.violations(text, segments, s.source, [a for _, a in s.atoms if a.required], count(text), policy.tokens if policy.hard_budget else None)
    if broken:
        return _result("INVARIANT_FAILED", s.route, manifest={"status": "INVARIANT_FAILED", "violations": broken}, diagnostics=tuple(broken))
    numbers, kept = render.metrics(text, segments, s.source, s.atoms, count)
    return _result("OK", s.route, text, numbers, render.manifest(document_id, s.route, s.source, segments, kept, numbers, tokenizer, policy.mode))


METRICS = (
    ("input_bytes", pa.int64()), ("output_bytes", pa.int64()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("compression_ratio", pa.float64()), ("required_atom_coverage", pa.float64()),
    ("retained_required_atoms_count", pa.int64()), ("total_required_atoms_count", pa.int64()), ("total_atom_coverage", pa.float64()), ("retained_atoms_count", pa.int64()), ("total_atoms_count", pa.int64()),
    ("copy_segments_count", pa.int64()), ("rewrite_segments_count", pa.int64()), ("aggregate_segments_count", pa.int64()), ("requested_tokens", pa.int64()), ("minimum_safe_tokens", pa.int64()),
)
_METRICS_DDL = ", ".join(f"{n}: {'double' if t == pa.float64() else 'bigint'}" for n, t in METRICS)
RESULT = f"status string, route string, text string, metrics struct<{_METRICS_DDL}>, manifest string, diagnostics array<string>"
_TYPES = [("status", pa.string()), ("route", pa.string()), ("text", pa.string()), ("metrics", pa.struct(METRICS)), ("manifest", pa.string()), ("diagnostics", pa.list_(pa.string()))]


def _content(df: DataFrame, column: str) -> Column:
    return F.to_binary(F.col(column), F.lit("utf-8")) if df.schema[column].dataType.simpleString() == "string" else F.col(column)


def _prepared(df: DataFrame, id_col: str, content_col: str, dealt: bool = False) -> tuple[DataFrame, str]:
    """id, document_id, byte_length, and the content unless it is too large; dealt out, unless the rows are already."""
    content = _content(df, content_col)
    out = df.select(F.col(id_col).alias("id"), R.document_id(content).alias("document_id"), F.octet_length(content).alias("byte_length"), F.when(~R.too_large(content), content).alias("content"))
    return bounded(out if dealt else spread(out)), df.schema[id_col].dataType.simpleString()


#: Results are handed on once so many rows, or so many bytes of text and manifest, have come together.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def _too_large(size: int) -> dict:
    note = f"{size} bytes are more than {fixed.MAX_BYTES}"
    return _result("INPUT_TOO_LARGE", manifest={"schema_version": render.VERSION, "status": "INPUT_TOO_LARGE", "error": note}, diagnostics=(note,))


def _once(values: list, of: pa.DataType) -> pa.Array:
    """An array of values many of which are the same object, made once each."""
    number = {}
    at = [number.setdefault(id(v), len(number)) for v in values]
    firsts = {i: v for i, v in zip(at, values, strict=True)}
    return pa.array([firsts[i] for i in range(len(firsts))], of).take(pa.array(at, pa.int32()))


def compile_documents(df: DataFrame, id_col: str, content_col: str, policy: Policy = Policy(), columns: tuple[str, ...] = tuple(n for n, _ in _TYPES), dealt: bool = False) -> DataFrame:
    """One row per document: the id, document_id, then RESULT (or those of its columns that are named). ``content_col`` is binary or a string.

    A null content is compiled as empty. The plan is a scan, a projection, for small inputs a deal-out (``spread``), and a map.
    """
    prepared, id_type = _prepared(df, id_col, content_col, dealt)
    types = [(n, t) for n, t in _TYPES if n in columns]
    text, manifest = "text" in columns, "manifest" in columns

    def handed(batch, start, rows):
        arrays = [_once([r[n] for r in rows], t) if n == "metrics" else pa.array([r[n] for r in rows], t) for n, t in types]
        return pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), batch.column(1).slice(start, len(rows)), *arrays], names=["id", "document_id", *(n for n, _ in types)])

    def run(batches):
        from gistmill.plans.shapes import shapes

        known = shapes(policy)
        for batch in batches:
            start, rows, size_ = 0, [], 0
            for k, (document_id, size, raw) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                if raw is None and size is not None:
                    r = _too_large(size)
                else:
                    r = known.compile(raw or b"", document_id, text, manifest)
                rows.append(r)
                size_ += len(r["text"]) + len(r["manifest"])
                if len(rows) >= (BATCH_ROWS if text or manifest else 16 * BATCH_ROWS) or size_ >= BATCH_BYTES:
                    yield handed(batch, start, rows)
                    start, rows, size_ = k + 1, [], 0
            if rows:
                yield handed(batch, start, rows)

    schema = {"status": "status string", "route": "route string", "text": "text string", "metrics": f"metrics struct<{_METRICS_DDL}>", "manifest": "manifest string", "diagnostics": "diagnostics array<string>"}
    return prepared.mapInArrow(run, ", ".join([f"id {id_type}, document_id string", *(schema[n] for n, _ in types)])).withColumnRenamed("id", id_col)


BLOCKS = "block_seq int, block_id string, route string, kind string, seg_kind string, start long, end long, text string, meta map<string,string>"
UNITS = "unit_seq int, unit_id string, block_id string, block_kind string, seg_kind string, start long, end long, text string, atom_ids array<int>, n_required int, tokens int"


def _stage(df: DataFrame, id_col: str, content_col: str, policy: Policy, schema: str, types, rows, upto: str) -> DataFrame:
    prepared, id_type = _prepared(df, id_col, content_col)

    def handed(batch, at, found):
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=["id", *(n for n, _ in types)])

    def run(batches):
        for batch in batches:
            at, found = [], []
            for k, raw in enumerate(batch.column(3).to_pylist()):
                try:
                    own = list(rows(analyse(raw, policy, upto))) if raw and raw.strip() else []
                except Rejected:
                    own = []
                at += [k] * len(own)
                found += own
                if len(found) >= 16 * BATCH_ROWS:
                    yield handed(batch, at, found)
                    at, found = [], []
            if found:
                yield handed(batch, at, found)

    return prepared.mapInArrow(run, f"id {id_type}, {schema}").withColumnRenamed("id", id_col)


def document_blocks(df: DataFrame, id_col: str, content_col: str, policy: Policy = Policy()) -> DataFrame:
    """One row per block of every document; ``start`` and ``end`` are bytes of the source (of extracted text for PDF and DOCX)."""
    types = [("block_seq", pa.int32()), ("block_id", pa.string()), ("route", pa.string()), ("kind", pa.string()), ("seg_kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))]

    def rows(s: Stages):
        for k, b in enumerate(s.blocks):
            first = s.source.span(*b.spans[0]) if b.spans else (0, 0)
            yield k, block_id(k, b.tag), s.route, b.kind, b.made, *first, b.text, list(b.meta.items())

    return _stage(df, id_col, content_col, policy, BLOCKS, types, rows, "blocks")


def document_units(df: DataFrame, id_col: str, content_col: str, policy: Policy = Policy()) -> DataFrame:
    """One row per candidate unit of every document, with the numbers of its atoms."""
    types = [("unit_seq", pa.int32()), ("unit_id", pa.string()), ("block_id", pa.string()), ("block_kind", pa.string()), ("seg_kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("atom_ids", pa.list_(pa.int32())), ("n_required", pa.int32()), ("tokens", pa.int32())]

    def rows(s: Stages):
        required, count = {k for k, a in s.atoms if a.required}, policy.profile().count
        for k, u in enumerate(s.units):
            first = s.source.span(*u.spans[0]) if u.spans else (0, 0)
            yield k, f"unit_{k:04d}", u.block_id, u.kind, u.made, *first, u.text, list(u.atoms), len(required.intersection(u.atoms)), count(u.text)

    return _stage(df, id_col, content_col, policy, UNITS, types, rows, "units")


def document_atoms(df: DataFrame, id_col: str, content_col: str, policy: Policy = Policy()) -> DataFrame:
    """One row per atom in a kept zone of every document; places are bytes of the source."""
    types = [("atom_seq", pa.int32()), ("atom_id", pa.string()), ("kind", pa.string()), ("surface", pa.string()), ("canonical", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("required", pa.bool_())]

    def rows(s: Stages):
        for k, a in s.atoms:
            yield k, f"atom_{k:04d}_{a.kind}", a.kind, a.surface, a.canonical, *s.source.span(a.start, a.end), a.required

    schema = "atom_seq int, atom_id string, kind string, surface string, canonical string, start long, end long, required boolean"
    return _stage(df, id_col, content_col, policy, schema, types, rows, "atoms")


def summarize(text: str) -> str:
    """Compact text of one document, cut at its natural density; empty if it cannot be compiled."""
    return compile_bytes(text.encode())["text"]


def validate_results(results: DataFrame, sources: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, verdict, verified, message) for stored texts and manifests against their sources."""
    s = sources.select(F.col(id_col).alias("_id"), _content(sources, content_col).alias("_raw"))
    rows = results.join(s, results[id_col] == s["_id"], "left").select(F.col(id_col).alias("id"), "_raw", "text", "manifest")
    id_type = results.schema[id_col].dataType.simpleString()
    types = [("verdict", pa.string()), ("verified", pa.int64()), ("message", pa.string())]

    def run(batches):
        for batch in batches:
            found = [validate.check_manifest(raw, text or "", manifest or "") if raw is not None else ("FAILED", 0, "no source") for raw, text, manifest in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True) if found else [[]] * 3, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *(n for n, _ in types)])

    return bounded(rows).mapInArrow(run, f"id {id_type}, verdict string, verified long, message string").withColumnRenamed("id", id_col)


def validate_compiled(df: DataFrame, id_col: str, content_col: str, policy: Policy = Policy(), dealt: bool = False) -> DataFrame:
    """``validate_results`` of ``compile_documents``, each document against its own source in the worker that compiled it: no join.

    A row without content has no source.
    """
    prepared, id_type = _prepared(df, id_col, content_col, dealt)
    types = [("verdict", pa.string()), ("verified", pa.int64()), ("message", pa.string())]

    def run(batches):
        from gistmill.plans.shapes import shapes

        known = shapes(policy)

        def one(document_id, size, raw):
            if raw is not None:
                return known.check(raw, document_id)
            return ("FAILED", 0, "no source") if size is None else validate.check_manifest(b"", "", _too_large(size)["manifest"])

        for batch in batches:
            found = [one(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True) if found else [[]] * 3, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *(n for n, _ in types)])

    return prepared.mapInArrow(run, f"id {id_type}, verdict string, verified long, message string").withColumnRenamed("id", id_col)
