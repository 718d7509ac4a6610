import itertools
import random

import numpy as np
import pyarrow as pa

from gistmill.llm import quality_crf as Q


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 0, 1, 2, 2])
    odds, trans = rng.normal(size=7), rng.normal(size=(2, 2))
    good, expected, z = Q.Chain(doc).marginals(odds, trans)
    want, pairs, total = np.zeros(7), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights, sums, counts = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(odds[i] * v for i, v in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in itertools.pairwise(y)))
            weights += w
            sums += w * np.array(y)
            for a, b in itertools.pairwise(y):
                counts[a, b] += w
        want[at], total = sums / weights, total + np.log(weights)
        pairs += counts / weights
    assert np.allclose(good, want) and np.allclose(expected, pairs) and np.isclose(z, total)


def corpus(n=400):
    rng = random.Random(3)
    vocab = ["the", "river", "sounds", "like", "an", "old", "song", "tonight"]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        lines = []
        for _ in range(rng.randint(1, 8)):
            words = [rng.choice(vocab) for _ in range(rng.randint(3, 12))]
            if bad and rng.random() < 0.8:
                words = rng.choice([[w.upper() + "!!" for w in words], [w + "###" for w in words], [words[0]] * 20, [w + " |" for w in words]])
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    extra = [(1000, None), (1001, ""), (None, "the river"), (5, "again"), (1002, "word " * 50000), (1003, "\n" * 500)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS quality")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (7, labels[7][1])], "doc_id long, quality int")
    field = Q.train(df, lab)
    out = Q.score_quality(df, field).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.93
    again = Q.train(df.repartition(5), lab)
    assert np.allclose(again.w, field.w)


def test_labels_of_one_kind_or_none(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert Q.train(df, one) == 1.0 and Q.train(df, one.limit(0)) == 0.5
    assert {r.score for r in Q.score_quality(df, 0.5).collect()} == {0.5}
    assert Q.score_quality(df.limit(0), 0.5).count() == 0


def test_neighbours_are_features():
    x, doc, _ = Q.line_features(pa.array(["LOUD!!\nquiet line", "alone"]))
    n = Q.FEATURES
    assert np.array_equal(x[0, 1 : 1 + n], x[1, 1 + n : 1 + 2 * n]) and np.array_equal(x[1, 1 : 1 + n], x[0, 1 + 2 * n :])
    assert not x[2, 1 + n :].any() and doc.tolist() == [0, 0, 1]


def test_sampled_lines_are_runs_of_neighbours():
    at, begins = Q.sampled(10, 100)
    assert at.tolist() == [*range(10)] and begins.tolist() == [True] + [False] * 9
    at, begins = Q.sampled(1000, 100)
    assert len(at) <= 100 and at[0] == 0 and at[-1] == 999 and begins.sum() == Q.RUNS
    assert np.all((np.diff(at) == 1) == ~begins[1:])
