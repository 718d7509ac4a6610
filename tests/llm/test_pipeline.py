"""The pipeline's stages against brute force on small documents, each on its own input."""

import importlib.util
import random

import pytest

P = pytest.importorskip("public_tokenizers")
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("no pipeline", allow_module_level=True)
import corpus_pipeline as C  # noqa: E402
from tests.llm.test_decontaminate import brute as brute_hits  # noqa: E402
from tests.llm.test_jaccard_join import brute as brute_components  # noqa: E402
from tests.llm.test_line_dedup import brute as brute_lines  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(6)
    out = []
    for i in range(60):
        lang = rng.choice(["aa", "bb"])
        syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ü"]}[lang]
        lines = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(3, 20))) for _ in range(rng.randint(1, 5))]
        out.append((i, "\n".join(lines), lang))
    out += [(100 + k, out[k][1], out[k][2]) for k in range(5)]  # exact copies
    out += [(200 + k, out[k][1] + " extra", out[k][2]) for k in range(5, 9)]  # near copies
    out += [(300, "123 456", None), (301, None, None), (302, "q" * 90, None)]
    return [(d, t, lang, f"s{d % 3}", len(t or "")) for d, t, lang in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{path}/documents.parquet")
    words = data[12][1].split()
    spark.createDataFrame([(7, " ".join(words[:15])), (8, "none of these words here at all in any text")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        if k < 4:
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {300, 301, 302}
        elif name == "line_dedup":
            want = {eval(x) for x in brute_lines(pairs)}  # noqa: S307
            assert {(r.doc_id, r.text) for r in after} == {(d, t) for d, _, _, emptied, t in want if not emptied}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "jaccard_join":
            assert {r.doc_id for r in after} == {d for d, _, c in brute_components(pairs) if d == c}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert {r.doc_id for r in after} == {r[0] for r in brute_hits(pairs, items) if not r[5]} and len(after) < len(before)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(r.n_tokens > 0 for r in after)
        before = after


def test_run_is_the_stages_in_order(spark, folder):
    out = C.run(spark, folder)
    assert out.count() > 30 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "bpe"]


def test_near_duplicates_keeps_one_of_repeated_rows(spark, folder):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "aa", "s", 1), (1, text, "aa", "s", 1), (2, text, "aa", "s", 1), (None, "x y", None, None, None), (3, None, None, None, None)], SCHEMA)
    got = sorted(str(r.doc_id) for r in C.near_duplicates(spark, docs, folder).collect())
    assert got == ["1", "3", "None"]


def test_rows_that_share_an_id_or_have_none_are_judged_one_by_one(spark, folder):
    text, own = "one two three four five six seven", "a text that no other row has at all"
    item = " ".join(rows()[12][1].split()[:15])
    docs = spark.createDataFrame([(1, text, "aa", "s", 1), (5, text, "aa", "s", 1), (5, own, "aa", "s", 1), (None, text, "aa", "s", 1), (None, "alone with no id here", "aa", "s", 1), (None, "alone with no id here", "bb", "s", 1), (6, own, None, "s", 1), (6, own, "s", None, 1), (7, "", None, None, 0), (7, "", None, None, 0)], SCHEMA)
    got = sorted(str((r.doc_id, r.text)) for r in C.near_duplicates(spark, docs, folder).collect())
    assert got == sorted(map(str, [(1, text), (5, own), (None, "alone with no id here"), (7, ""), (7, "")]))
    bad = spark.createDataFrame([(1, item, "aa", "s", 1), (1, own, "aa", "s", 1), (None, "x " + item, "aa", "s", 1), (None, own, "aa", "s", 1), (2, None, None, None, None)], SCHEMA)
    got = sorted(str((r.doc_id, r.text)) for r in C.clean(spark, bad, folder).collect())
    assert got == sorted(map(str, [(1, own), (None, own), (2, None)]))


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_empty_tables_and_extra_columns(spark, folder, monkeypatch, most):
    monkeypatch.setattr(C, "MOST_BROADCAST", most)
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS row_key", "'n' AS node", "2 AS k1", "3 AS gone_key_", "4 AS hashes")
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 30, name
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert C.tokens(spark, docs.limit(0), folder).count() == 0
