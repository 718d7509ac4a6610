import random
import re

import pytest

import corpus_pipeline
from gistmill.llm.line_dedup import MIN_WORDS, dedup_lines, drop_repeated_lines, within_one_edit

M = 5


def words(line):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return re.findall("[^\x20\x09-\x0d]+", lowered)


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        prev, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (a != b))
    return row[-1]


def brute(docs):
    lines = sorted(((2**63 - 1 if d is None else d), k, words(x)) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")))
    out = []
    for d, t in docs:
        if t is None:
            out.append((d, 0, 0, False, None))
            continue
        own, kept, left = t.split("\n"), [], 0
        for k, x in enumerate(own):
            w = words(x)
            at = (2**63 - 1 if d is None else d, k)
            if len(w) >= M and any((e, j) < at and len(v) >= M and abs(len(v) - len(w)) < 2 and distance(v, w) < 2 for e, j, v in lines):
                continue
            kept.append(x)
            left += len(w) >= M
        out.append((d, len(own), len(own) - len(kept), len(kept) < len(own) and not left, "\n".join(kept)))
    return sorted(map(str, out))


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "cat", "Sat", "été", "mat", "on", "x", "y"]
    bank = [[rng.choice(vocab) for _ in range(rng.randint(1, 12))] for _ in range(25)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(0, 7)):
            line = list(rng.choice(bank))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(line) + 1)
                line[p : p + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
            own.append(rng.choice([" ", "  ", " \t"]).join(line))
        docs.append((rng.randrange(10**6) * 100 + i, "\n".join(own)))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hashes", "2 AS doc", "3 AS line")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed) + [(None, "one two three four five\nlast"), (1, None), (2, ""), (3, "a b c d e\na b c d e"), (3, "a b c d e\na b c d e"), (9, "\n\n")]
    got = sorted(str((r.doc_id, r.n_lines, r.n_dropped, r.emptied, r.text)) for r in dedup_lines(frame(spark, docs)).collect())
    assert got == brute(docs)


def test_hot_template_lines(spark):
    docs = [(i, f"page number {i} of the whole large book\nown line {i} {i + 1} {i + 2} {i + 3}") for i in range(300)]
    got = {r.doc_id: r.n_dropped for r in dedup_lines(frame(spark, docs)).collect()}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 300))


def test_stage_keeps_columns_and_drops_emptied(spark):
    docs = [(1, "one two three four five six"), (2, "one two three four five six\nshort"), (3, None), (4, "fresh line with five more words")]
    df = frame(spark, docs)
    out = drop_repeated_lines(df)
    assert out.schema == df.schema and sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_edit_check():
    assert within_one_edit(list("abc"), list("abc")) and within_one_edit(list("abc"), list("ac")) and within_one_edit(list("abc"), list("axc"))
    assert not within_one_edit(list("abc"), list("acb")) and not within_one_edit(list("abcd"), list("ab"))


def test_short_lines_of_its_own_keep_a_document(spark):
    licence = "one two three four five six"
    docs = [(1, licence), (2, licence + "\nown verse"), (3, licence + "\n\u4e00\u4e8c\u4e09"), (4, licence + "\n \n")]
    assert {r.doc_id: r.emptied for r in dedup_lines(frame(spark, docs), own_words=1).collect()} == {1: False, 2: False, 3: False, 4: True}
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert got == {1: licence, 2: "own verse", 3: "\u4e00\u4e8c\u4e09"}


def brute_own(docs):
    """As ``brute``, with exact copies of every line that has a word."""
    lines = sorted((d, k, words(x)) for d, t in docs for k, x in enumerate(t.split("\n")))
    out = {}
    for d, t in docs:
        kept = []
        for k, x in enumerate(t.split("\n")):
            w = words(x)
            earlier = [v for e, j, v in lines if (e, j) < (d, k)]
            near = len(w) >= MIN_WORDS and any(len(v) >= MIN_WORDS and abs(len(v) - len(w)) < 2 and distance(v, w) < 2 for v in earlier)
            if not w or not (near or w in earlier):
                kept.append(x)
        out[d] = (len(kept) < t.count("\n") + 1 and not any(map(words, kept)), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_exact_copies_of_short_lines_go(spark, seed):
    docs = corpus(seed) + [(1, "Les.\n\n"), (2, "les.\n\nLes.\nnew"), (3, "\u4e00\u4e8c\u4e09\u56db" * 9), (4, "\u4e00\u4e8c\u4e09\u56db" * 9)]
    got = {r.doc_id: (r.emptied, r.text) for r in dedup_lines(frame(spark, docs), own_words=1).collect()}
    assert got == brute_own(docs)
    assert got[2] == (False, "\nnew") and got[4] == (True, "")
    kept = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id: r.text for r in kept.collect()} == {d: t for d, (emptied, t) in got.items() if not emptied}


def test_rows_without_an_id_are_documents_of_their_own(spark):
    line = "one two three four five six"
    docs = [(None, f"{line}\nfirst own line of mine here"), (None, f"{line}\nsecond own line that I have"), (9, "unrelated words in this line"), (None, "unrelated words in this line")]
    got = {(r.doc_id, r.text) for r in dedup_lines(frame(spark, docs)).collect()}
    assert sum(line in t for _, t in got) == 1 and (9, docs[2][1]) in got and (None, "") in got
    assert sum("own line" in t for _, t in got) == 2
