"""Compilation by shape against compilation one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gistmill.operators import validate
from gistmill.plans import compile as plan
from gistmill.plans.compile import Policy, compile_bytes, compile_documents, validate_compiled, validate_results
from gistmill.plans.shapes import Shapes, template

MAIL = "From: a{} <c{}@example.com>\nSubject: order {}\nDate: day {}\n\nPlease ship order {} soon, {} of {}.\nWe approved the plan for {} min.\n> quoted {}.\nThe total is {} and {}.\n"
LOG = "running {} tests\n---- suite::job_{} stdout ----\npanicked at src/job.rs:{}:5:\nassertion `left == right` failed\n  left: {}\n right: {}\n\nfailures:\ntest result: FAILED. {} passed; 1 failed; 0 ignored; finished in 0.0{}s"
SHAPED = [MAIL, LOG, "# Customer {}\n\nIt is important to note that {} of {} waited in order to pay {}. They left early.\n\n- point {}\n\n| a | b |\n|---|---|\n| {} | {} |\n"]
#: Texts in which values, or what stands in what by chance, count.
OTHERS = [
    "Host 10.{}.{}.{} is down. It must restart after {} ms.\n",
    "{}. first\n{}. second\n\nAfter that come {} more words of text. # a\n",
    "The wait was {} min there. Later it took {} min again, and {} min in all. Nobody paid {}$ or {}%. Rules: {} s.",
    "See ::{} and fe80::{} for the route of {} packets. Not {} of them came back.",
    "The sha{} of commit {}ab{}c is fine, as SOC{} says of it. No {} here.",
    "==== test session starts ====\n____ test_a{} ____\nE  assert {} == {}\na.py:{}: AssertionError\n=== {} failed, {} passed in 0.{}s ===\n",
    "FAIL a{}.test\nTests {} failed | {} passed\nDuration {}.{}s\n- Expected:\n {}\n+ Received:\n {}\n",
    "FAIL a{}\n- Expected:\n {}\n+ Received:\n {}\nDuration\nTests | {} passed Duration 1.5",
    "a,b\n{},{}\n{},{}\n",
    '{{"a": {}, "b": [{}, 1.{}]}}',
    "<h{}>Title {}</h{}><p>Words &#6{}; and more words {} here.</p>",
    "Versão {} não é {} nem {}. É de {} até {}; v{}.{} também serve. Nothing of {}.",
    "\x1b[{}m red {} text here \x1b[0m and {} words more. It must go at {}.",
    "def test_{}(x):\n    assert x{} == {}\ndef helper_{}(y):\n    return y\n",
    "On 2024-{}-{} at {}:{} UTC we should see CVE-2024-{}. It is 0{} or 00{} of {}. Refund €{} or USD {}.",
    "It should be noted that {} MB of i-{}abcdef{} are gone prior to {} MB, without {} more. Use `x{}` or a_{} and b-{}.",
]


def instances(text: str, n: int, rng: random.Random) -> list[bytes]:
    most = [9, 99, 999]
    return [text.format(*(rng.choice([0, 1, 5, "007", rng.randint(1, m), rng.randint(1, m)]) for m in rng.choices(most, k=text.count("{}")))).encode() for _ in range(n)]


def sha(raw: bytes) -> str:
    return "sha256:" + hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("mode", ["compact", "verbatim"])
@pytest.mark.parametrize("text", SHAPED + OTHERS)
def test_same_as_one_by_one(text, mode):
    policy = Policy(mode=mode)
    known, rng = Shapes(policy), random.Random(len(text))
    for raw in instances(text, 150, rng):
        want = compile_bytes(raw, policy)
        # met now, so the shape is learnt and used at once
        known.find(raw)
        assert known.compile(raw, sha(raw)) == want, raw
        assert known.check(raw, sha(raw)) == validate.check_manifest(raw, want["text"], want["manifest"])


@pytest.mark.parametrize("policy", [Policy(tokens=30, hard_budget=False), Policy(abbreviations=True), Policy(required_terms=("5 min",))])
def test_other_policies(policy):
    known, rng = Shapes(policy), random.Random(3)
    for text in SHAPED + OTHERS:
        for raw in instances(text, 30, rng):
            known.find(raw)
            assert known.compile(raw, sha(raw)) == compile_bytes(raw, policy), raw


def test_documents_of_a_shape_are_compiled_once(monkeypatch):
    calls, real = [], plan.compile_bytes
    monkeypatch.setattr(plan, "compile_bytes", lambda *a: calls.append(a) or real(*a))
    known = Shapes(Policy())
    for i in range(500):
        raw = LOG.format(2 + i % 7, 1000 + i, 10 + i % 90, 1500, 3, 1 + i % 9, 1 + i % 8).encode()
        assert known.compile(raw, sha(raw))["route"] == "test_log"
        assert known.check(raw, sha(raw))[0] == "PASSED"
    assert len(calls) <= 4


def test_checks_see_other_sources():
    known = Shapes(Policy())
    mail = MAIL.format(*range(11, 22)).encode()
    known.check(mail, sha(mail))
    shape, numbers = known.find(mail)
    assert shape.copies and all(mail[a:b] in mail for a, b, _, _ in shape.copies)
    # a template that puts a number elsewhere is seen by the bytes, and the document is compiled by itself
    key = next(k for k, v in known.known.items() if shape in v[1].values())
    known.known[key] = (known.known[key][0], {same: s._replace(text=(s.text[0], s.text[1][::-1])) for same, s in known.known[key][1].items()})
    want = compile_bytes(mail)
    assert known.check(mail, sha(mail)) == validate.check_manifest(mail, want["text"], want["manifest"])


def test_template_needs_numbers_of_the_source():
    assert template("a 12 b 7", "a 34 b 7", {"12": 0}, {"12": "34"}) == (["a ", "", " b 7"], [0])
    assert template("a 12", "a 35", {"12": 0}, {"12": "34"}) is None


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    found = [(i, raw.decode()) for i, raw in enumerate(raw for text in SHAPED + OTHERS for raw in instances(text, 12, rng))]
    return spark.createDataFrame([*found, (-1, None), (-2, ""), (-3, "x" * 10_000_001)], "id long, content string")


def test_validation_in_one_pass(rows):
    want = validate_results(compile_documents(rows, "id", "content"), rows, "id", "content")
    got = validate_compiled(rows, "id", "content")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in got._jdf.queryExecution().toString()


def test_columns(rows):
    whole = compile_documents(rows, "id", "content")
    some = compile_documents(rows, "id", "content", columns=("status", "route", "metrics"), dealt=True)
    assert some.columns == ["id", "document_id", "status", "route", "metrics"]
    key = lambda r: r.id
    assert sorted(some.collect(), key=key) == sorted(whole.select(some.columns).collect(), key=key)
    assert some.where(F.col("metrics").isNull()).count() == whole.where(F.col("metrics").isNull()).count()


def test_metrics_are_made_without_texts(spark, monkeypatch):
    from gistmill import queries

    asked = []
    real = queries.compile_documents
    monkeypatch.setattr(queries, "compile_documents", lambda *a, **named: asked.append(named.get("columns")) or real(*a, **named))
    out = queries.compile_metrics(spark, "/root/testdata/sf0.001")
    assert asked == [("status", "route", "metrics")]
    docs = queries.corpus(spark, "/root/testdata/sf0.001")
    assert sum(r.n for r in out.collect()) == docs.count()


def test_patterns_in_small_letters_match_alike(monkeypatch):
    from gistmill import fixed
    from gistmill.operators import atoms

    rng = random.Random(9)
    bits = ["NO ", "Not", " não", " NÃO ", "Niemals ", "ohne", " 5 MB", "7 µS ", "7 ΜS", "3 Ms,", "CVE-2024-12345", " commit ab12CD9 ", "MUST ", "Unless", "caused BY ", "mtls", "Pii", "É", "ß", "İ", "K", "ſ", "Σ", "НЕ ", "ᲀ", "’", "kein’s ", "jamás\n", ". ", "word ", "a" * 40, "x "]
    texts = ["".join(rng.choices(bits, k=12)) for _ in range(800)]
    for kind, pattern, fold, _, _ in fixed.ATOMS:
        got = [atoms.places(kind, t) for t in texts]
        monkeypatch.setattr(atoms, "BEYOND", atoms.re.compile(""))
        monkeypatch.setattr(atoms._Signs, "__init__", lambda self, text, make=atoms._Signs.__init__: (make(self, text), setattr(self, "small", False))[0])
        assert got == [atoms.places(kind, t) for t in texts], kind
        monkeypatch.undo()
