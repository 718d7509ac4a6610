import json
import random

import pytest
from pyspark.sql import functions as F

from gistmill.functions import route as R
from gistmill.functions import text as T
from gistmill.functions.language import language
from gistmill.functions.tokens import estimate, token_estimate
from gistmill.operators import native, rank, rewrite, units
from gistmill.operators.atoms import PATTERNS, atoms, find
from gistmill.operators.segment import sentences
from gistmill.plans.compile import Policy, compile_bytes, compile_documents, document_atoms, document_blocks, document_units, summarize, validate_results
from gistmill.plans.job import main
from gistmill.sources.files import read_files
from gistmill.streaming.stream import compile_stream, read_folder, write_stream

REPORT = "# Incident\n\nIt is important to note that host 10.0.0.7 failed in order to show CVE-2024-12345.\n\n" + "\n\n".join(
    f"Section {i} tells that service alpha{i} was slow because of load number {i}. Nobody noticed the {i} warnings on that day." for i in range(12)
)
MAIL = "From: a@x.org\nSubject: Plan\n\nPlease check host 10.1.1.1 today. We agreed to wait. The weather is nice here.\n"


def texts():
    rng = random.Random(2)
    bits = ["Dr. Who", "e.g. this", "3.14", "...", "! ", "? ", ". ", "\n\n", "word", "No.", "(x)", "…", "。", "été", "10.0.0.1", "must", "not all men", " ", '"q." ', "CVE-2024-99999", "v1.2", "a_b", "upgrade from 1.2.3.4"]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", " ", "\n"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([*enumerate(texts())], "document_id long, text string")


def test_columns_agree_with_kernels(frame):
    rows = frame.select("text", T.sentences(F.col("text")).alias("s"), token_estimate(F.col("text")).alias("n"), *[T.surfaces(F.col("text"), k).alias(k) for k in ("ipv4", "cve", "negation", "quantity", "code_identifier")], T.discourse_prune(F.col("text")).alias("p")).collect()
    for r in rows:
        assert r.s == [r.text[a:b] for a, b in sentences(r.text)]
        assert r.n == estimate(r.text)
        assert r.p == rewrite.prune(r.text)
        for k in ("cve", "negation", "quantity", "code_identifier"):
            assert r[k] == [m.group() for m in PATTERNS[k].finditer(r.text)]
        assert r.ipv4 == [a.surface for a in find(r.text) if a.kind == "ipv4"]


def test_spans_of_sentences(frame):
    got = {(r.document_id, r.start, r.end) for r in native.sentence_spans(frame).collect()}
    assert got == {(i, a, b) for i, t in enumerate(texts()) for a, b in sentences(t)}


def test_atoms_operator_and_binding(frame):
    found = atoms(frame, text_col="text")
    assert found.count() == sum(len(find(t)) for t in texts())
    parts = native.sentence_spans(frame)
    for width in (4096, 3):
        bound = {(r.document_id, r.unit_seq, r.atom_seq) for r in units.bind(parts, found, width=width).distinct().collect()}
        want = {(i, k, j) for i, t in enumerate(texts()) for k, (a, b) in enumerate(sentences(t)) for j, x in enumerate(find(t)) if a <= x.start and x.end <= b}
        assert bound == want


def test_relational_ranking_equals_kernel(spark):
    docs = [(d, i, f"the {random.Random(d * 50 + i).choice(['red', 'blue', 'old'])} house number {i % 4} of street {d}") for d in range(4) for i in range(9)] + [(9, 0, "alone")]
    df = spark.createDataFrame(docs, "document_id long, unit_seq int, text string")
    edges = rank.similar(rank.tfidf(df), k=3)
    got = {(r.document_id, r.unit_seq): r.score for r in rank.pagerank(df, edges).collect()}
    for d in {x[0] for x in docs}:
        own = [t for i, _, t in docs if i == d]
        assert [got[d, i] for i in range(len(own))] == pytest.approx(rank.scores(own, 3).tolist(), abs=1e-6)


def test_routes_and_language(spark):
    rows = [("<p>hello there</p>", "html"), ("<?xml version='1.0'?><a>b</a>", "xml"), ('{"a": 1}', "json"), ("a,b\n1,2", "csv"), ("x FAILED", "test_log"), ("import os\nx", "code"), (MAIL, "email"), ("# x", "markdown"), ("plain", "text"), ("  ", "empty")]
    df = spark.createDataFrame(rows, "text string, want string").withColumn("got", R.route(F.col("text")))
    assert [(r.text, r.got) for r in df.where("got <> want").collect()] == []
    df = spark.createDataFrame([("The cat is on the mat with a hat", "en"), ("Der Hund und die Katze sind auf dem Dach", "de"), ("Le chat est sur la table avec les autres", "fr"), ("El perro y los gatos en una casa con el pan", "es"), ("Это русский текст", "ru"), ("日本語のテキストです", "ja"), ("", "en")], "text string, want string")
    assert df.where(language(F.col("text")) != F.col("want")).count() == 0


def test_codec_column(spark):
    from gistmill.sources.decode import codec_of

    raws = [b"plain", "é".encode(), b"\xff\xfea\x00", b"\xfe\xff\x00a", "some words".encode("utf-16-le"), "some words".encode("utf-16-be"), b"caf\xe9", b"\xef\xbb\xbfx"]
    rows = spark.createDataFrame([(bytearray(r),) for r in raws], "c binary").select("c", R.codec(F.col("c")).alias("codec")).collect()
    assert [r.codec.replace("-sig", "") for r in rows] == [codec_of(bytes(r.c))[0] for r in rows]
    assert spark.createDataFrame([(bytearray(400),)], "c binary").select(R.codec(F.col("c"))).first()[0] == "ambiguous"


def test_compile_report():
    r = compile_bytes(REPORT.encode())
    assert r["status"] == "OK" and r["route"] == "markdown"
    assert "10.0.0.7" in r["text"] and "CVE-2024-12345" in r["text"] and r["text"].startswith("# Incident\nHost 10.0.0.7 failed to show")
    m = json.loads(r["manifest"])
    out = r["text"].encode()
    for s in m["output_segments"]:
        piece = out[s["output_start"] : s["output_end"]].decode()
        if s["kind"] == "copy":
            (src,) = s["sources"]
            assert REPORT.encode()[src["start"] : src["end"]].decode() == piece
    assert r["metrics"]["required_atom_coverage"] == 1.0 and r["metrics"]["output_tokens"] < r["metrics"]["input_tokens"]


def test_compile_modes_terms_and_budgets():
    assert "in order to" in compile_bytes(REPORT.encode(), Policy(mode="strict"))["text"]
    assert "alpha11" in compile_bytes(REPORT.encode(), Policy(required_terms=("alpha11",)))["text"]
    for budget in range(5, 300, 20):
        r = compile_bytes(REPORT.encode(), Policy(tokens=budget))
        assert r["status"] in ("OK", "TARGET_BUDGET_UNSAFE")
        if r["status"] == "OK":
            assert r["metrics"]["output_tokens"] <= budget
        else:
            assert r["metrics"]["minimum_safe_tokens"] > budget and "10.0.0.7" in json.loads(r["manifest"])["missing_atoms"]
    assert compile_bytes(REPORT.encode(), Policy(tokens=5, hard_budget=False))["status"] == "OK"
    with pytest.raises(ValueError):
        Policy(mode="other")
    with pytest.raises(ValueError):
        Policy(tokenizer="other")


def test_compile_odd_documents():
    assert compile_bytes(b"")["text"] == "" and json.loads(compile_bytes(b" \n")["manifest"])["status"] == "EMPTY"
    assert compile_bytes(b"\x00" * 500)["status"] == "UNDECODABLE_INPUT"
    coloured = "\x1b[31mError\x1b[0m at host 10.0.0.9 was \x1b[1mseen\x1b[0m today by all. Another sentence follows here."
    r = compile_bytes(coloured.encode())
    assert r["status"] == "OK" and "\x1b" not in r["text"] and "10.0.0.9" in r["text"]
    assert compile_bytes("Zu Gast bei 10.0.0.9 in Köln heute.".encode("latin-1"))["status"] == "OK"
    page = "<html><body><h1>Head line</h1><p>Host 10.0.0.3 is down now.</p><script>var ip = '10.9.9.9'</script></body></html>"
    r = compile_bytes(page.encode())
    assert r["route"] == "html" and "10.0.0.3" in r["text"] and "10.9.9.9" not in r["text"] and r["metrics"]["total_required_atoms_count"] == 1
    tests = "def test_a():\n    assert host == '10.0.0.4'\n"
    assert compile_bytes(tests.encode())["status"] in ("OK", "INVARIANT_FAILED")
    assert summarize("One fine sentence is here. One fine sentence is here.").startswith("One fine")


def test_mail_keeps_actions():
    r = compile_bytes(MAIL.encode())
    assert r["route"] == "email" and "Please check host" in r["text"] and "We agreed to wait." in r["text"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, REPORT), (2, MAIL), (3, ""), (4, None), (5, "x" * 10_000_001), (6, "a,b\n1,2\n3,4"), (7, "running 1 test\ntest x ... FAILED\n")]
    return spark.createDataFrame(rows, "id long, content string")


def test_compile_documents(corpus):
    rows = {r.id: r for r in compile_documents(corpus, "id", "content").collect()}
    assert rows[1].text == compile_bytes(REPORT.encode())["text"] and rows[5].status == "INPUT_TOO_LARGE" and rows[4].status == "OK"
    assert rows[6].route == "csv" and rows[7].route == "test_log"
    plan = compile_documents(corpus, "id", "content")._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_same_for_any_partitions(corpus):
    want = sorted((r.id, r.manifest) for r in compile_documents(corpus.coalesce(1), "id", "content").collect())
    assert sorted((r.id, r.manifest) for r in compile_documents(corpus.repartition(7), "id", "content").collect()) == want


def test_stage_tables(corpus):
    blocks = document_blocks(corpus, "id", "content")
    assert {r.kind for r in blocks.collect()} == {"heading", "prose", "email_header", "table", "log"} or blocks.count() > 10
    u = document_units(corpus, "id", "content").withColumnRenamed("id", "document_id")
    assert units.mandatory(u).where("is_mandatory").count() >= 3
    a = document_atoms(corpus, "id", "content")
    assert {"ipv4", "cve"} <= {r.kind for r in a.where("required").collect()}
    r = a.where("id = 1 AND kind = 'ipv4'").first()
    assert REPORT.encode()[r.start : r.end] == b"10.0.0.7"


def test_validation_job(corpus):
    results = compile_documents(corpus.where("id IN (1, 2, 6, 7)"), "id", "content")
    assert {r.verdict for r in validate_results(results, corpus, "id", "content").collect()} == {"PASSED"}
    bad = results.withColumn("text", F.concat(F.lit("x"), "text"))
    assert "FAILED" in {r.verdict for r in validate_results(bad, corpus, "id", "content").collect()}
    other = corpus.withColumn("content", F.concat("content", F.lit(" ")))
    assert {r.verdict for r in validate_results(results, other, "id", "content").collect()} == {"FAILED"}


def test_files_stream_and_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text(REPORT)
    (folder / "b.eml").write_text(MAIL)
    batch = {r.path: r.text for r in compile_documents(read_files(spark, str(folder)), "path", "content").collect()}
    q = write_stream(compile_stream(read_folder(spark, str(folder)), "path", "content"), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert {r.path: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert main(["compile", str(folder), "--output", str(tmp_path / "job"), "--tokenizer", "heuristic"]) == 0
    assert main(["validate", str(tmp_path / "job"), "--source", str(folder)]) == 0
    assert main(["inspect", str(folder)]) == 0
    assert main(["compile", str(tmp_path / "none"), "--output", str(tmp_path / "x")]) == 1
    assert main(["compile", str(folder), "--output", str(tmp_path / "tight"), "--budget", "3"]) == 2
