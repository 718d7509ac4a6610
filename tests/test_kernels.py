import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gistmill import fixed
from gistmill.functions import text as T
from gistmill.functions.arrow import spread
from gistmill.functions.tokens import estimate, profile
from gistmill.operators import atoms as A
from gistmill.operators import rank, rewrite, select
from gistmill.operators.atoms import Cover, entities, find, merged
from gistmill.operators.segment import sentences
from gistmill.operators.units import is_boilerplate
from gistmill.sources.decode import Source


def kinds(text, **k):
    return {(a.kind, a.surface) for a in find(text, **k)}


@pytest.mark.parametrize(
    ("text", "kind", "surface"),
    [
        ("see cve-2024-12345 now", "cve", "cve-2024-12345"),
        ("host 10.2.3.4:8080 is", "ipv4", "10.2.3.4:8080"),
        ("at fe80::1 and", "ipv6", "fe80::1"),
        ("id 123e4567-e89b-12d3-a456-426614174000.", "uuid", "123e4567-e89b-12d3-a456-426614174000"),
        ("commit ab12cd3 landed", "git_sha", "ab12cd3"),
        ("x " + "a1" * 20 + " y", "git_sha", "a1" * 20),
        ("node i-0abcdef12 up", "instance_id", "i-0abcdef12"),
        ("took 35 minutes", "quantity", "35 minutes"),
        ("cost $5 million", "quantity", "$5 million"),
        ("read https://a.b/c?d now", "path_or_url", "https://a.b/c?d"),
        ("in src/a.py:10:2 there", "file_location", "src/a.py:10:2"),
        ("call parse_code_blocks please", "code_identifier", "parse_code_blocks"),
        ("on 2024-01-02T03:04:05Z it", "timestamp", "2024-01-02T03:04:05Z"),
        ("do not touch the red one", "bound_negation", "not touch the red"),
        ("它没有完成任务", "bound_negation", "没有完成任"),
        ("no", "negation", "no"),
        ("you must go", "modality", "must"),
        ("unless it rains", "condition", "unless"),
        ("late because of it", "causality", "because"),
        ("our hipaa duty", "compliance_acronym", "hipaa"),
        ("write a.b@c.org today", "email", "a.b@c.org"),
    ],
)
def test_atom_classes(text, kind, surface):
    assert (kind, surface) in kinds(text)


@pytest.mark.parametrize(("text", "kind"), [("upgraded from 1.2.3.4 on", "ipv4"), ("version 1.2.3.4", "ipv4"), ("size 1e10000 hash", "git_sha"), ("word deadbee1 alone", "git_sha"), ("300.1.1.1", "ipv4"), ("knot", "negation")])
def test_no_such_atom(text, kind):
    assert kind not in {k for k, _ in kinds(text)}


def test_atoms_order_terms_and_canonical():
    found = find("wait 5 seconds for Foo and foo_bar", ("foo", "5 minutes", "absent"))
    assert [(a.kind, a.surface) for a in found][:2] == [("required_term", "Foo"), ("required_term", "5 seconds")]
    assert next(a for a in found if a.kind == "quantity").canonical == "5 s"
    assert all(a.required == (a.kind == "required_term") for a in found)
    assert not any(a.kind == "code_identifier" for a in find("see src/my_file/x_y now"))
    assert entities("at 10.0.0.1, never mind the gap") == {"10.0.0.1", "never mind the gap"}


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 8)).map(lambda t: (t[0], t[0] + t[1])), max_size=12))
def test_merged_spans(spans):
    out = merged(spans)
    assert all(b < c for (_, b), (c, _) in zip(out, out[1:]))
    assert {x for a, b in spans for x in range(a, b)} == {x for a, b in out for x in range(a, b)}
    assert all(Cover(spans).holds(*s) for s in spans)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Pi is 3.14 today. See v1.2.", ["Pi is 3.14 today.", "See v1.2."]),
        ("Dr. Who met Mrs. X. They left.", ["Dr. Who met Mrs. X.", "They left."]),
        ("Well... maybe. Wait... Go", ["Well... maybe.", "Wait...", "Go"]),
        ("你好。再见！", ["你好。", "再见！"]),
        ("a b\n\nc d", ["a b", "c d"]),
        ('He said "no." Then left.', ['He said "no.', '" Then left.']),
        ("Hm (etc.) and on", ["Hm (etc.) and on"]),
        ("نعم؟ لا۔", ["نعم؟", "لا۔"]),
        ("यह है। वह भी।", ["यह है।", "वह भी।"]),
        ("   ", []),
        ("", []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences(text)] == want


@given(st.text(alphabet="aB.!? \n…。éz.b(", max_size=60))
def test_sentences_keep_every_character(text):
    spans = sentences(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "").replace("\n", "") == "".join(text.split())


@given(st.text(max_size=300).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), st.data())
def test_source_spans(text, data):
    source = Source(text.encode())
    a = data.draw(st.integers(0, len(source.clean)))
    b = data.draw(st.integers(a, len(source.clean)))
    assert source.text_at(*source.span(a, b)).replace("\x1b", "") == source.clean[a:b].replace("\x1b", "") or "\x1b" in text


@pytest.mark.parametrize(("text", "is_"), [("12", False), ("1234", True), ("..", True), ("x.", False), ("Inhaltsverzeichnis", True), ("II. Intro 12", True), ("B. Parts 3", True), ("----", True), ("", True), ("A real line", False)])
def test_boilerplate(text, is_):
    assert is_boilerplate(text) is is_


def test_tokens():
    assert estimate("") == 0 and estimate("a") == 1 and estimate("word " * 40) == (50 + 52) // 2
    assert profile("heuristic:x").name == "heuristic:x" and not profile("openai:cl100k_base").is_exact
    with pytest.raises(ValueError):
        profile("unknown")


def dense(n, src, dst, weight, d=0.85):
    m = np.zeros((n, n))
    m[src, dst] = weight
    out = m.sum(axis=1)
    m = np.where(out[:, None] > 0, m / np.maximum(out, 1e-300)[:, None], 0)
    p = np.full(n, 1 / n)
    for _ in range(50):
        q = d * (m.T @ p) + (d * p[out == 0].sum() + 1 - d) / n
        done = np.abs(q - p).sum() < 1e-6
        p = q
        if done:
            break
    p = np.round(p, 8)
    return (p - p.min()) / (p.max() - p.min()) if p.max() > p.min() else np.ones(n)


def test_pagerank_equals_dense_model():
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 40):
        pairs = np.array([(i, j) for i in range(n) for j in range(n) if i != j and rng.random() < 0.3]).reshape(-1, 2).astype(int)
        w = rng.random(len(pairs))
        assert np.allclose(rank.ranks(n, pairs[:, 0], pairs[:, 1], w), dense(n, pairs[:, 0], pairs[:, 1], w), atol=1e-6)
    assert rank.ranks(0, [], [], []).tolist() == [] and rank.ranks(1, [], [], []).tolist() == [1.0]
    none = np.zeros(0, dtype=int)
    assert rank.ranks(3, none, none, np.zeros(0)).tolist() == [1, 1, 1]


def test_graph_is_bounded_and_symmetric_in_weight():
    texts = [f"common words here number {i} and {i % 3}" for i in range(30)] + ["!!", "lonely"]
    src, dst, weight = rank.graph(texts, 5)
    assert np.bincount(src.astype(int)).max() <= 5 and (weight > fixed.MIN_SIMILARITY).all() and (weight <= 1 + 1e-9).all()
    assert not np.isin([30, 31], dst).any()
    assert rank.scores(["!!", "??"]).tolist() == [1, 1]


def table(texts, mandatory=None, scores=None, headings=None):
    return select.Table(texts, [estimate(t) for t in texts], [entities(t) for t in texts], mandatory or [False] * len(texts), np.array(scores if scores is not None else [1.0] * len(texts)), headings or [False] * len(texts))


def test_cover_takes_most_first():
    sets = [frozenset("ab"), frozenset("abc"), frozenset("cd"), frozenset(), frozenset("d")]
    assert select.cover(sets, set()) == {1, 2} and select.cover(sets, {2}) == {0}


def test_knee():
    assert select.knee([0, 10, 20, 30], [0, 8, 9, 10]) == 1
    assert select.knee([0, 10, 20], [0, 1, 2]) == 2 and select.knee([0, 10, 20, 30], [0, 1, 2, 30]) == 3


def test_free_selection_drops_repeats():
    texts = ["Server 10.0.0.1 failed hard.", "The quick brown fox jumps over dogs.", "The quick brown fox jumps over dogs.", "Another different statement about weather patterns.", "The weather and the fox."]
    chosen = select.select_free(table(texts, [True] + [False] * 4))
    assert 0 in chosen and not {1, 2} <= set(chosen)
    assert select.select_free(table([])) == []


words = st.lists(st.sampled_from("alpha beta gamma delta 10.0.0.1 must 5ms".split()), min_size=1, max_size=8).map(" ".join)


@settings(max_examples=60)
@given(st.lists(words, min_size=1, max_size=12), st.integers(1, 60), st.data())
def test_budget_holds_or_is_refused(texts, budget, data):
    mandatory = [data.draw(st.booleans()) for _ in texts]
    headings = [data.draw(st.booleans()) for _ in texts]
    t = table(texts, mandatory, [data.draw(st.floats(0, 1)) for _ in texts], headings)
    required = [{i} if m else set() for i, m in enumerate(mandatory)]
    try:
        chosen = select.select_within(t, budget, True, estimate, required)
    except select.OverBudget as e:
        assert e.minimum > budget and set(e.missing) <= {i for i, m in enumerate(mandatory) if m}
        return
    must = {i for i, m in enumerate(mandatory) if m}
    assert must <= set(chosen)
    assert estimate("\n".join(texts[i] for i in chosen)) <= budget or set(chosen) <= must | {i for i, h in enumerate(headings) if h}
    soft = select.select_within(t, 1, False, estimate, required)
    assert must <= set(soft)


@pytest.mark.parametrize(("old", "new"), [("It is important to note that rain falls.", "Rain falls."), ("ps: I'll call", "ps: I'll call"), ("Darüber hinaus, gilt es", "Gilt es"), ("Il convient de noter que le prix", "Le prix"), ("Cabe destacar que el plan", "El plan"), ("Moreover, furthermore it is", "Furthermore it is")])
def test_prune(old, new):
    assert rewrite.prune(old) == new


@pytest.mark.parametrize("rule", fixed.PHRASES, ids=lambda r: r[2])
def test_every_phrase(rule):
    phrase, short, name = rule
    text, used = rewrite.candidate(f"we {phrase} now", pruning=False)
    assert name in used or any(len(p) > len(phrase) and phrase in p for p, _, _ in fixed.PHRASES)
    assert name not in rewrite.candidate(f"we x{phrase}y now", pruning=False)[1]


@pytest.mark.parametrize("pair", fixed.ABBREVIATIONS.items(), ids=lambda p: p[0])
def test_every_abbreviation(pair):
    word, short = pair
    assert rewrite.candidate(f"the {word} here", pruning=False, abbreviations=True)[0] == f"the {short} here"
    assert rewrite.candidate(f"the {word.capitalize()} here", pruning=False, abbreviations=True)[0] == f"the {word.capitalize()} here"
    assert rewrite.candidate(f"the {word} here", pruning=False)[0] == f"the {word} here"


@pytest.mark.parametrize("pair", fixed.UNIT_ABBREVIATIONS.items(), ids=lambda p: p[0])
def test_every_unit(pair):
    word, short = pair
    assert rewrite.candidate(f"in 30 {word} or a {word}", pruning=False, abbreviations=True)[0] == f"in 30 {short} or a {word}"


def test_rewrite_keeps_code_headers_and_required():
    assert "`in order to`" in rewrite.candidate("see `in order to` in order to go")[0]
    assert rewrite.candidate("Subject: database", abbreviations=True)[0] == "Subject: database"
    text = "We wait in order to finish the very long task for everyone"
    assert rewrite.rewrite(text, estimate, ["in order to"], frozenset()) == (text, None)
    new, rule = rewrite.rewrite(text, estimate, [], frozenset())
    assert new == text.replace("in order to", "to") and rule == "wg_in_order_to"
    assert rewrite.rewrite(text, estimate, [], frozenset(["in order to"])) == (text, None)


# ---- patterns in linear time -----------------------------------------------------------------------------------------
_PIECES = {
    "path_or_url": ["a", "b1", "/", ".", "-", "_", "+", "://", "http://", ":", " ", "é", "(", "arn:aws:", "s3:", "123456789012", "*", "9", "\n", "'"],
    "file_location": ["a", "b1", "/", " / ", ".", "-", "_", ":", "12", "é", " ", "(", "\n", "::", "/.", "/-"],
}
_LONG = ("a." * 500_000 + " b/", "a" * 1_000_000, "a1" * 500_000 + " http://x", "a/" * 500_000, "/a" * 400_000 + ":", "a / " * 250_000, " " * 1_000_000 + "a/b", "1." * 500_000 + "://")


def _mixed(kind, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(_PIECES[kind]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("kind", sorted(_PIECES))
def test_linear_forms_equal_the_patterns(kind):
    for text in _mixed(kind, 20_000, 5):
        assert A.places(kind, text) == [m.span() for m in A.PATTERNS[kind].finditer(text)], text


@pytest.mark.parametrize("kind", sorted(_PIECES))
def test_long_lines_take_little_time(spark, kind):
    for text in _LONG:
        start = time.perf_counter()
        A._linear(kind, text)
        assert time.perf_counter() - start < 1, text[:9]
    start = time.perf_counter()
    spark.createDataFrame([(t,) for t in _LONG], "text string").select(F.size(T.surfaces(F.col("text"), kind))).collect()
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("kind", sorted(_PIECES))
def test_linear_forms_of_both_engines_agree(spark, kind):
    texts = _mixed(kind, 4_000, 6)
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").orderBy("i").select(T.surfaces(F.col("text"), kind)).collect()]
    assert got == [[m.group() for m in A.PATTERNS[kind].finditer(t)] for t in texts]


def test_classes_that_no_unit_can_hold_are_skipped():
    rng = random.Random(3)
    parts = ["10.0.0.1", "a/b", "CVE-2024-12345", "x_y", "mail@a.b", "no", "5 MB", "plain words", "http://x.y", "::1", "é", "2024-01-02"]
    for _ in range(300):
        texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 4))]
        kinds = A.possible(texts)
        assert [A.entities(t, kinds) for t in texts] == [A.entities(t) for t in texts]


def test_small_inputs_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(1000, numPartitions=1)
    assert spread(df).rdd.getNumPartitions() == 2 * cores
    assert spread(df.join(df.withColumnRenamed("id", "k"), F.col("id") == F.col("k"))).rdd.getNumPartitions() == 2 * cores


def test_tokenizer_files_count_exactly():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    counter = profile("openai:cl100k_base", path)
    text = "Exact counts, été 123 " * 5
    assert counter.is_exact and counter.count(text) == len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert counter.count("") == 0 and not profile("openai:cl100k_base", "ranks.tiktoken").is_exact
