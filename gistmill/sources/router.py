"""Chooses the parser of a document; the Column form of the same order is in ``functions.route``."""

from __future__ import annotations

from gistmill.sources import mail, markup, office, plain, testlogs
from gistmill.sources.blocks import Block
from gistmill.sources.decode import Rejected, Source, read

#: Routes in order; a parser that finds nothing leaves the document to the next that fits.
ROUTES = (
    ("html", markup.is_html, markup.html),
    ("xml", markup.is_xml, markup.xml),
    ("json", markup.is_json, markup.json_items),
    ("csv", plain.is_table, plain.table),
    ("test_log", testlogs.is_test_log, testlogs.test_log),
    ("code", plain.is_code, plain.code),
    ("email", mail.is_mail, mail.mail),
    ("markdown", markup.may_be_markdown, markup.markdown),
    ("text", lambda text: True, plain.paragraphs),
)


def parse_text(text: str) -> tuple[str, list[Block]]:
    """Route and blocks of clean text; a parser's error gives one opaque block of all."""
    body = text.strip()
    if not body:
        return "empty", []
    for name, fits, parser in ROUTES:
        try:
            found = parser(text) if fits(body) else []
        except Exception:
            if name == "xml":  # malformed markup is left to the routes that follow
                continue
            break
        if found:
            return name, found
    return "opaque", [Block("opaque", "opaque", body, ((0, len(text)),))]


def parse(raw: bytes) -> tuple[str, Source, list[Block]]:
    """Route, the text that spans index, and blocks of a file."""
    for name, fits, parser in (("pdf", office.is_pdf, office.pdf), ("docx", office.is_docx, office.docx)):
        if fits(raw):
            blocks, text = parser(raw)
            if not text:  # the bytes themselves are no text
                raise Rejected("UNDECODABLE_INPUT", f"no text can be read from the {name} file")
            return name, Source(text.encode()), blocks
    source = read(raw)
    route, blocks = parse_text(source.clean)
    return route, source, blocks
