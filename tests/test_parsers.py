import io
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gistmill.plans.compile import compile_bytes
from gistmill.sources import mail, markup, office, plain, testlogs
from gistmill.sources.decode import Rejected, codec_of, read
from gistmill.sources.router import parse, parse_text


def kinds(text):
    return [(b.kind, b.text) for b in parse_text(text)[1]]


@pytest.mark.parametrize(
    ("raw", "codec"),
    [
        (b"plain", "utf-8"),
        ("é".encode(), "utf-8"),
        (b"\xef\xbb\xbfhi", "utf-8"),
        ("hi".encode("utf-16"), "utf-16-le"),
        (b"\xfe\xff" + "hi".encode("utf-16-be"), "utf-16-be"),
        ("some words".encode("utf-16-le"), "utf-16-le"),
        ("some words".encode("utf-16-be"), "utf-16-be"),
        (b"caf\xe9 latin", "latin-1"),
        (b"", "utf-8"),
    ],
)
def test_codecs(raw, codec):
    assert codec_of(raw)[0] == codec
    assert "�" not in read(raw).clean


def test_rejected():
    with pytest.raises(Rejected) as e:
        read(b"\x00" * 400)
    assert e.value.status == "UNDECODABLE_INPUT"
    with pytest.raises(Rejected) as e:
        read(b"x" * 11, most=10)
    assert e.value.status == "INPUT_TOO_LARGE"


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "utf-16-le", "utf-16-be", "latin-1"])
def test_spans_round_trip(codec):
    text = "Grüße an alle, \x1b[31mrot\x1b[0m und Ende" + ("" if codec == "latin-1" else " 🙂漢字 x")
    raw = text.encode(codec)
    if codec.startswith("utf-16"):
        raw = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}[codec] + raw
    source = read(raw)
    assert "\x1b" not in source.clean
    for a in range(0, len(source.clean), 3):
        for b in range(a, len(source.clean) + 1, 5):
            assert source.text_at(*source.span(a, b)) == source.clean[a:b]
    with pytest.raises(ValueError):
        source.span(3, 2)


def test_html_tree():
    page = "<!DOCTYPE html><html><head><meta charset=utf-8><title>No title</title><style>p{}</style></head><body><nav><ul><li>menu item</li></ul></nav><h2>Main &amp; more</h2><p>One two<br>three <b>four</b><p>Second part<ul><li>first item<p>inner text</li><li>second item</ul><table><tr><td>a1</td><td>b22</td></tr></table><pre><code>x = 1</code></pre><footer><p>the foot</p></footer><p>abc</p></body></html>"
    assert kinds(page) == [("heading", "Main & more"), ("prose", "One twothree four"), ("prose", "Second part"), ("list", "first iteminner text"), ("prose", "inner text"), ("list", "second item"), ("table", "a1b22"), ("code", "x = 1"), ("code", "x = 1")]


def test_html_with_nothing_falls_through():
    assert parse_text("<div><script>var x = 1;</script></div> - plain")[0] != "html"


def test_xml():
    assert kinds('<?xml version="1.0"?><a x="1"><b>text one</b><c y="2">more</c><d/></a>') == [("structured", 'x="1"'), ("structured", "text one"), ("structured", 'more (y="2")')]
    assert parse_text('<!DOCTYPE a [<!ENTITY e "boom">]><a>&e;</a>')[0] == "text"


def test_json():
    assert kinds('{"a": 1, "b": {"c": [true, null]}, "d": null, "é": "ü"}') == [("structured", "a: 1"), ("structured", 'b: {"c": [true, null]}'), ("structured", "d: None"), ("structured", "é: ü")]
    assert kinds('[1, "x"]') == [("structured", "[0] 1"), ("structured", "[1] x")]
    assert not markup.is_json('{"a": NaN}') and not markup.is_json("{bad}")


def test_csv_chunks():
    text = "a,b\n" + "".join(f"{i},v{i}\n" for i in range(23))
    blocks = plain.table(text)
    assert [b.text.count("\n") + 1 for b in blocks] == [1, 10, 10, 3]
    assert all(text[slice(*b.spans[0])] == b.text for b in blocks)
    assert parse_text("x;y\n1;2\n")[0] == "csv" and not plain.is_table("one line")


def test_cargo_pytest_vitest_and_plain_logs():
    cargo = "running 2 tests\n---- m::a stdout ----\npanicked at src/a.rs:3:5:\nassertion `left == right` failed\n  left: 1\n right: 2\n---- m::b stdout ----\nboom\n\nfailures:\ntest result: FAILED. 3 passed; 2 failed; 0 ignored; finished in 0.02s"
    assert [b.text for b in testlogs.test_log(cargo)] == ["✓ 3 · ✗ 2 · 0.02s", "✗ m::a (src/a.rs:3:5) · exp: 2 got: 1", "✗ m::b"]
    assert [b.text for b in testlogs.test_log("running 1 test\ntest x ... FAILED\n")] == ["✓ 0 · ✗ 0", "✗ x"]
    py = "==== test session starts ====\n____ test_one ____\nE   assert 1 == 2\na/test_x.py:7: AssertionError\n==== 1 failed, 4 passed in 0.1s ===="
    assert [b.text for b in testlogs.test_log(py)] == ["✓ 4 · ✗ 1 · 0.1s", "✗ test_one (a/test_x.py:7) · exp: 2 got: 1"]
    vi = "FAIL src/a.test.ts > adds\n- Expected:\n  3\n+ Received:\n  4\n ❯ src/a.test.ts:5:2\nTest Files 1 failed\nTests 1 failed | 2 passed\nDuration 1.2s"
    assert [b.text for b in testlogs.test_log(vi)] == ["✓ 2 · ✗ 1 · 1.2s", "✗ src/a.test.ts > adds · exp: 3 got: 4 · src/a.test.ts:5:2"]
    assert kinds("start\n\n  FAILED here \n") == [("log", "start"), ("log", "FAILED here")]


def test_code():
    blocks = plain.code("def test_a():\n    assert x == 1\ndef helper():\n    pass\n")
    assert [b.text for b in blocks] == ["test: test_a\nassert: x == 1", "test: helper"] and {b.made for b in blocks} == {"aggregate"}
    assert [b.kind for b in plain.code("import os\nprint(os)")] == ["code"]


def test_mail_thread():
    text = "From: a@x.org\nTo: b@x.org,\n c@x.org\nReceived: junk\nSubject: Plans\n\nPlease send the file. We agreed to meet. Is it late?\n> old words here.\n-- \nA. Name\n\n-----\nFrom: b@x.org\nSubject: Re\n\nThanks a lot. The sky is blue today.\nTo unsubscribe from this group send mail.\nhidden text here."
    blocks = mail.mail(text)
    assert [b.tag for b in blocks] == ["email_header", "request", "decision", "question", "email_header", "fact"]
    assert blocks[0].text == "From: a@x.org\nTo: b@x.org, c@x.org\nSubject: Plans" and len(blocks[0].spans) == 3
    for b in blocks:
        if b.kind == "prose":
            assert text[slice(*b.spans[0])] == b.text


def test_mbox():
    text = "From a@x.org Mon Jan  1 10:00:00 2024\nFrom: a@x.org\nSubject: One\n\nFirst body text.\n\nFrom b@x.org Tue Jan  2 10:00:00 2024\nFrom: b@x.org\nSubject: Two\n\nSecond body text.\n"
    assert [b.tag for b in mail.mail(text)] == ["email_header", "fact", "email_header", "fact"]


def test_markdown():
    text = "# Top\n\nA paragraph\nof two lines.\n\nSub\n---\n\n- one\n  more\n- two\n\n  inner\n\n1. first\n2. second\n\n> quoted text\n\n```py\ncode = 1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n***\n\n<div>gone</div>\n\n    indented\n\nEnd."
    got = kinds(text)
    assert [k for k, _ in got] == ["heading", "prose", "heading", "list", "list", "prose", "code", "table", "code", "prose"]
    assert got[1][1] == "A paragraph\nof two lines." and got[5][1] == "> quoted text" and got[-1][1] == "End."
    assert all(text[slice(*b.spans[0])] == b.text for b in markup.markdown(text))


def test_paragraphs():
    assert kinds("one part\nstill\n\n  two part \n \n\nthree") == [("prose", "one part\nstill"), ("prose", "two part"), ("prose", "three")]


def archive(xml, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_docx():
    raw = archive(f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Body te</w:t></w:r><w:r><w:t>xt</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    route, source, blocks = parse(raw)
    assert route == "docx" and [(b.kind, b.text) for b in blocks] == [("heading", "Title"), ("prose", "Body text"), ("table", "a | b")]
    assert all(source.clean[slice(*b.spans[0])] == b.text for b in blocks)


def test_docx_bombs_and_broken_files():
    with pytest.raises(Rejected):
        office.docx(archive("<a>" + "x" * 10_000_001 + "</a>"))
    assert office.docx(archive('<!DOCTYPE a [<!ENTITY e "x">]><a/>')) == ([], "")
    assert not office.is_docx(b"PK\x03\x04broken") and not office.is_docx(archive("<a/>", "other.xml"))
    assert office.pdf(b"%PDF-1.4 broken")[1] == ""


def pdf_file(contents, fonts="<< /F1 5 0 R >>", extra=(), deflate=True, trailer=b""):
    """A file of one page for each content stream."""
    out, kids = [], []
    for k, text in enumerate(contents):
        data = zlib.compress(text) if deflate else text
        out.append(f"{10 + 2 * k} 0 obj\n<< /Length {len(data)} {'/Filter /FlateDecode ' if deflate else ''}>>\nstream\n".encode() + data + b"\nendstream\nendobj")
        out.append(f"{11 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {10 + 2 * k} 0 R >>\nendobj".encode())
        kids.append(f"{11 + 2 * k} 0 R")
    head = [b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj", f"2 0 obj\n<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] /Resources << /Font {fonts} >> >>\nendobj".encode(), b"5 0 obj\n<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>\nendobj"]
    return b"%PDF-1.4\n" + b"\n".join([*head, *extra, *out]) + b"\n" + trailer + b"%%EOF"


PAGE = b"BT /F1 12 Tf 72 700 Td (REPORT TITLE) Tj 0 -40 Td (First \\(long\\) line) Tj 0 -14 Td [(of p) 20 (arag) -300 (raph \\351t\\351)] TJ ET"


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_text(deflate):
    route, source, blocks = parse(pdf_file([PAGE, b"BT /F1 10 Tf (Second page.) Tj ET"], deflate=deflate))
    assert route == "pdf" and [(b.kind, b.text) for b in blocks] == [("heading", "REPORT TITLE"), ("prose", "First (long) line of parag raph \xe9t\xe9"), ("prose", "Second page.")]
    assert all(source.clean[slice(*b.spans[0])] == b.text for b in blocks)


def test_pdf_fonts_with_a_character_map():
    cmap = b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<00E9> <4E2D>] endbfrange"
    extra = [b"5 0 obj\n<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>\nendobj", f"6 0 obj\n<< /Length {len(cmap)} >>\nstream\n".encode() + cmap + b"\nendstream\nendobj"]
    _, source, _ = parse(pdf_file([b"BT /F1 12 Tf <0010 0011 0012 0003 0020 0021> Tj ET"], extra=extra))
    assert source.clean == "ABC \xe9\u4e2d"


def test_unreadable_pdf_is_refused():
    """Encrypted, empty, of unknown glyphs, or broken: a status of its own, never the file's bytes as text."""
    glyphs = [b"5 0 obj\n<< /Type /Font /Subtype /Type0 >>\nendobj"]
    for raw in (pdf_file([PAGE], trailer=b"trailer << /Encrypt 9 0 R >>\n"), pdf_file([b""]), pdf_file([b"BT /F1 12 Tf <00100011> Tj ET"], extra=glyphs), b"%PDF-1.4 broken", pdf_file([PAGE])[:200]):
        out = compile_bytes(raw)
        assert out["status"] == "UNDECODABLE_INPUT" and out["text"] == ""
    assert compile_bytes(pdf_file([PAGE]))["status"] == "OK"
    assert compile_bytes(archive("<a>" + "x" * 10_000_001 + "</a>"))["status"] == "INPUT_TOO_LARGE"


@given(st.binary(max_size=300))
def test_any_pdf_bytes_end(data):
    for raw in (b"%PDF-" + data, pdf_file([data]), pdf_file([PAGE]).replace(b"Tj", data[:5])):
        compile_bytes(raw)


@pytest.mark.parametrize("text", ["", "   ", "\n\n", "\x00\x01", "<", "{", "[", "#", "|", "From: x", "a" * 5000, "‮ right", "-" * 50, "```", "> ", "1. "])
def test_odd_texts_do_not_break(text):
    route, blocks = parse_text(text)
    assert all(b.text for b in blocks) and route
