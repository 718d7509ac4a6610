"""Ingest and routing as Spark columns: identity, size gate, codec, clean text, and the route by signs alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed


def document_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def too_large(content: Column) -> Column:
    return F.octet_length(content) > fixed.MAX_BYTES


def codec(content: Column) -> Column:
    """Codec by byte order mark, by where NUL bytes stand, or by whether the bytes are UTF-8; ``ambiguous`` if undecidable."""
    head = F.hex(F.substring(content, 1, 3))
    sample = F.hex(F.substring(content, F.lit(1), F.least(F.floor(F.octet_length(content) / 2) * 2, F.lit(fixed.SNIFF_BYTES)).cast("int")))
    units = F.regexp_extract_all(sample, F.lit("...."), F.lit(0))
    n = F.greatest(F.size(units), F.lit(1))
    even = F.size(F.filter(units, lambda u: u.startswith("00"))) / n
    odd = F.size(F.filter(units, lambda u: u.endswith("00"))) / n
    wide = (F.size(units) >= 2) & ((even + odd) / 2 >= fixed.NUL_RATIO)
    return (
        F.when(head.startswith("EFBBBF"), "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
        .when(wide & (even > fixed.DOMINANT_RATIO) & (odd < fixed.MINORITY_RATIO), "utf-16-be")
        .when(wide & (odd > fixed.DOMINANT_RATIO) & (even < fixed.MINORITY_RATIO), "utf-16-le")
        .when(wide, "ambiguous")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8")
        .otherwise("latin-1")
    )


def is_html(text: Column) -> Column:
    return F.substring(F.trim(text), 1, 3000).rlike("(?i)" + fixed.HTML_TAGS)


def is_xml(text: Column) -> Column:
    head = F.trim(F.substring(F.trim(text), 1, 500))
    return head.rlike("(?s)" + fixed.XML_START) & ~F.lower(head).startswith("<!doctype html")


def is_json(text: Column) -> Column:
    body = F.trim(text)
    shaped = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    return shaped & F.try_parse_json(body).isNotNull()


def is_test_log(text: Column) -> Column:
    hit = text.rlike(fixed.CARGO_HEAD) | text.rlike(fixed.PYTEST_HEAD)
    for mark in fixed.LOG_MARKS:
        hit = hit | text.contains(mark)
    return hit


def is_code(text: Column) -> Column:
    return text.rlike("(?m)" + fixed.CODE_LINE)


def is_mail(text: Column) -> Column:
    return text.rlike("(?im)" + fixed.FROM_LINE) & text.rlike("(?im)" + fixed.SUBJECT_LINE)


def may_be_markdown(text: Column) -> Column:
    return text.contains("#") | text.contains("```") | text.contains("|") | text.contains("- ")


def _fields(delimiter: str):
    return lambda x: F.size(F.split(F.regexp_replace(x, '"[^"]*"', "q"), rf"\Q{delimiter}\E"))


def is_table(text: Column) -> Column:
    """Ten first lines with the same number (two or more) of fields under one delimiter; quoted fields count as one."""
    lines = F.slice(F.filter(F.split(text, "\r\n|[\n\r]"), lambda x: F.trim(x) != ""), 1, 10)
    hit = F.lit(False)
    for d in (",", ";", "\t", "|"):
        fields = F.transform(lines, _fields(d))
        hit = hit | ((F.array_min(fields) > 1) & (F.array_min(fields) == F.array_max(fields)))
    return (F.size(lines) >= 2) & hit


def route(text: Column) -> Column:
    """First route whose signs the text has (a parser that finds nothing there falls through: ``sources.router``)."""
    return (
        F.when(F.trim(text) == "", "empty")
        .when(is_html(text), "html")
        .when(is_xml(text), "xml")
        .when(is_json(text), "json")
        .when(is_table(text), "csv")
        .when(is_test_log(text), "test_log")
        .when(is_code(text), "code")
        .when(is_mail(text), "email")
        .when(may_be_markdown(text), "markdown")
        .otherwise("text")
    )
