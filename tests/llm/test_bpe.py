import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from gistmill.llm.bpe import Splitter, bpe_decode, bpe_round_trip, load  # noqa: E402
from gistmill.llm.token_counts import length_table, token_counts, whole_words  # noqa: E402

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(4)
    pieces = ["the", " The", "THEIR", "don't", "we'LL", "\xe9t\xe9", "ΑΣ", "Σίσυφος", "İstanbul", "stra\xdfe", "中文字", "日本", "\U0001f642\U0001f44d\U0001f3fd", "é", "１２", "\xbd", "\xb2", "12345", "...", "!!", "\t", "\n\n", "  ", "\xa0", "\x1c", "\x85", "　", "aaaaaaa", "_", "ab_c", "#$%", "<|endoftext|>", "<|startoftext|>", "​", "ﬁ", "क्षि", "عربي", "\x00", "ǅ", "Ⅷ", "᠎", " "]
    out = ["".join(rng.choice(pieces) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x2FFF), rng.randrange(0x10000, 0x10400)])) for _ in range(30)) for _ in range(300)]
    return [*out, "", None, "a" * 5000, "=" * 3001, "abc " * 3000, "x y" * 10, " lead", "trail  ", "ab" * 2000]


def test_round_trip_equals_library(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = [*enumerate(texts()), (5, "again"), (5, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "'z' AS decoded")
    got = sorted(map(str, (tuple(r) for r in bpe_round_trip(df, BYTE, ("n_tokens", "ids_sha256", "decoded_sha256")).collect())))
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())))
    assert got == sorted(want)


def test_general_outputs_and_decode(spark):
    df = spark.createDataFrame([(1, "Hello wörld <|endoftext|> x"), (2, "")], "doc_id long, text string")
    out = bpe_round_trip(df, BYTE)
    assert {r.doc_id: r.decoded for r in out.collect()} == {1: "Hello wörld <|endoftext|> x", 2: ""}
    assert {r.doc_id: r.text for r in bpe_decode(out, BYTE).collect()} == {1: "Hello wörld <|endoftext|> x", 2: ""}


def test_counts_equal_library(spark):
    tok = Tokenizer.from_file(WORD)
    rows = [*enumerate(texts()), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens").repartition(40)
    got = sorted(map(str, (tuple(r) for r in token_counts(df, WORD, limit=20).collect())))
    want = [str((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 20)) for i, t in rows]
    assert got == sorted(want)
    words = whole_words(load(WORD))
    assert len(words) > 30_000 and {"the", "and"} < set(words)


@pytest.mark.parametrize("frequent", [None, [], ["the", chr(0x12000) * 64, "no", "<|endoftext|>"]])
def test_long_words_and_any_first_tier(spark, frequent):
    """A pre-token of more than 255 tokens, repeated within and across rows, whatever the table holds."""
    tok, word = Tokenizer.from_file(WORD), chr(0x12000) * 64
    rows = [(i, " ".join([word] * 3 + ["the no"] * i)) for i in range(4)] * 2 + [(None, word * 40), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(map(str, ((r.doc_id, r.n_tokens, r.over_limit) for r in token_counts(df, WORD, frequent=frequent).collect())))
    want = [str((i, n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048)) for i, t in rows]
    assert got == sorted(want) and "768" in str(got)
    assert length_table(load(WORD), [word])[1].tolist() == [256]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_round_trip(df, BYTE).count() == token_counts(df, WORD).count() == 0


def test_splitter_cuts_at_special_strings():
    assert Splitter(load(WORD)).words("A<|endoftext|>B") == ["a", "<|endoftext|>", "b"]
