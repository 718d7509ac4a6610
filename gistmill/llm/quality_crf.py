"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are ratios of its own bytes and words (capitals, digits, symbols, exclamation marks,
separators, repeated words, word length, size) and the same of the line before and after. Forward-backward gives each
line's marginal; the mean of the marginals, weighted by line length, is put on the scale of the labels by a one-dimensional logistic fit
that also sees the worst line's share.

Training takes at most ``max_documents`` labelled documents that are not held out, those of smallest hash of the id (a
bounded sample, documented here). Their lines start with the document's label; in bad documents, lines that a logistic
model finds good are relabelled good. The field's weights then follow the likelihood's gradient. Features are computed on the executors;
the driver only gets feature rows, at most ``max_lines`` of each sampled document (60 MB in all): of a longer one evenly spaced
runs of neighbouring lines, each a sequence of its own, so that only true neighbours count as such.

Scoring reads every whole text. Labels, language, source and doc_id are no inputs of a score.

Nulls and empty texts: scored as one empty line. A null label is not learned from; of repeated labels the largest counts.
A null doc_id is never held out and never learned from. With labels of one kind or none, every score is the prior (1 or
0 for one kind, 0.5 for none). Repeated rows and very long texts get a row each; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import flat
from gistmill.llm.session import held_out, map_blocks, texts_of

#: Bounds of the training sample: labelled documents, lines of each, and runs of neighbours that these are taken in.
MAX_DOCUMENTS, MAX_LINES, RUNS = 3_000, 100, 4
CUT = 0.3


def _class(*spans) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    for lo, hi in spans:
        out[lo : hi + 1] = 1
    return out


CAPITALS, SMALL, DIGITS, HIGH = _class((0x41, 0x5A)), _class((0x61, 0x7A)), _class((0x30, 0x39)), _class((0x80, 0xFF))
SYMBOL, SHOUT, BAR, STOP = (np.isin(np.arange(256), [*map(ord, s)]).astype(np.uint8) for s in ("#*$%&<>", "!", "|", ".,;:?"))
FEATURES = 16


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all lines of a block (own, previous and next line's), each line's row and its weight."""
    from gistmill.llm.line_dedup import Lines

    lines = Lines(texts)
    raw, _ = flat.raw(texts)
    n = len(lines.doc)
    size = lines.end - lines.start

    def total(mask):
        sums = np.concatenate([[0], np.cumsum(mask[raw], dtype=np.int64)])
        return sums[lines.end] - sums[lines.start]

    words, h = lines.n, lines.words.hash
    same = np.zeros(len(h) + 1, dtype=np.int64)
    if len(h) > 1:
        np.cumsum(h[1:] == h[:-1], out=same[2:])
    repeats = np.where(words > 1, same[lines.b] - same[np.minimum(lines.a + 1, lines.b)], 0)
    capitals, small, digits, high, symbol, shout, bar, stop = (total(m) for m in (CAPITALS, SMALL, DIGITS, HIGH, SYMBOL, SHOUT, BAR, STOP))
    letters, each = np.maximum(capitals + small + high, 1), np.maximum(words, 1)
    empty = words == 0
    own = np.stack(
        [
            np.log1p(size) / 8, np.log1p(words) / 6, np.minimum(size / each, 40) / 10, capitals / letters, (capitals / letters > 0.4).astype(float), digits / np.maximum(size, 1),
            np.minimum(symbol / each, 3), (symbol / each > 0.3).astype(float), np.minimum(shout / each, 3), (shout / each > 0.3).astype(float), np.minimum(bar / each, 1), (bar / each > 0.3).astype(float),
            repeats / each, (repeats / each > 0.3).astype(float), np.minimum(stop / each, 2), empty.astype(float),
        ],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    joint = np.flatnonzero(lines.doc[1:] == lines.doc[:-1])
    before[joint + 1], after[joint] = own[joint], own[joint + 1]
    return np.concatenate([np.ones((n, 1)), own, before, after], axis=1), lines.doc, size + 1.0


WIDTH = 1 + 3 * FEATURES


class Chain:
    """Padded sequences of several documents, and inference on them."""

    def __init__(self, doc: np.ndarray):
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate([starts, [len(doc)]]))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        #: how many sequences reach each step
        self.alive = np.searchsorted(-self.sizes, -np.arange(1, (self.sizes[0] if len(sizes) else 0) + 1), side="right")

    def marginals(self, odds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transition counts and log partition; ``odds`` scores good against bad.

        ``trans`` [from, to] are transition scores between bad (0) and good (1).
        """
        n = len(odds)
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        for t, k in enumerate(self.alive):
            at = self.starts[:k] + t
            if t:
                prev = fwd[at - 1]
                fwd[at] = np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
            fwd[at, 1] += odds[at]
        for t in range(len(self.alive) - 2, -1, -1):
            at = self.starts[: self.alive[t + 1]] + t
            nxt = bwd[at + 1].copy()
            nxt[:, 1] += odds[at + 1]
            bwd[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
        last = self.starts + self.sizes - 1
        z = np.zeros(n)
        ends = np.logaddexp(fwd[last, 0], fwd[last, 1])
        z = np.repeat(ends[np.argsort(self.starts)], self.sizes[np.argsort(self.starts)])
        good = np.exp(np.clip(fwd[:, 1] + bwd[:, 1] - z, -700, 0))
        expected = np.zeros((2, 2))
        pairs = np.ones(n, dtype=bool)
        pairs[self.starts] = False
        at = np.flatnonzero(pairs)
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] = np.exp(np.clip(fwd[at - 1, i] + trans[i, j] + j * odds[at] + bwd[at, j] - z[at], -700, 0)).sum()
        return good, expected, float(ends.sum())


class Field:
    """Weights of the chain and of the document scale."""

    def __init__(self, w: np.ndarray, trans: np.ndarray, scale: np.ndarray):
        self.w, self.trans, self.scale = w, trans, scale

    def documents(self, x: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, chain: np.ndarray | None = None) -> np.ndarray:
        """Mean marginal by length, and share of length in lines that are rather bad; ``chain`` where a document is several."""
        good, _, _ = Chain(doc if chain is None else chain).marginals(x @ self.w, self.trans)
        total = np.maximum(np.bincount(doc, weights=weight, minlength=n), 1e-9)
        return np.stack([np.bincount(doc, weights=weight * good, minlength=n) / total, np.bincount(doc, weights=weight * (good < 0.5), minlength=n) / total], axis=1)

    def score(self, means: np.ndarray) -> np.ndarray:
        return _sigmoid(np.concatenate([np.ones((len(means), 1)), means], axis=1) @ self.scale)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    share = np.full(len(y), 1.0) if weight is None else weight
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(n: int, most: int, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of n lines as evenly spaced runs of neighbours, and whether each begins a run."""
    if n <= most:
        return np.arange(n), np.arange(n) == 0
    size = max(1, most // runs)
    starts = np.linspace(0, n - size, min(runs, most)).astype(int)
    at = np.unique((starts[:, None] + np.arange(size)).ravel())
    return at, np.concatenate([[True], np.diff(at) > 1])


def fit(x: np.ndarray, doc: np.ndarray, weight: np.ndarray, labels: np.ndarray, rounds: int = 80, chain_of: np.ndarray | None = None) -> Field:
    """A field for lines with weak labels from their documents (``labels`` by document number).

    ``chain_of`` numbers the sequences of neighbouring lines; without it each document is one.
    """
    chain_of = doc if chain_of is None else chain_of
    y = labels[doc].astype(float)
    even = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = _logistic(x, y, even, ridge=1.0)
    z = x @ w
    # a bad document's clearly good lines are good, but one line at least stays bad
    worst = np.full(len(labels), np.inf)
    np.minimum.at(worst, doc, z)
    y = np.where((y == 0) & (z > 0) & (z > worst[doc]), 1.0, y)
    chain, trans = Chain(chain_of), np.zeros((2, 2))
    target = x.T @ y
    pairs = chain_of[1:] == chain_of[:-1]
    seen = np.array([[np.sum(pairs & (y[:-1] == i) & (y[1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)
    theta = np.concatenate([_logistic(x, y, ridge=1.0), trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):  # gradient ascent with moments
        good, expected, _ = chain.marginals(x @ theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
        grad = np.concatenate([target - x.T @ good, (seen - expected).ravel()]) / len(y) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field = Field(theta[:WIDTH], theta[WIDTH:].reshape(2, 2), np.zeros(3))
    means = field.documents(x, doc, weight, len(labels), chain_of)
    field.scale = _logistic(np.concatenate([np.ones((len(means), 1)), means], axis=1), labels.astype(float), ridge=0.1)
    return field


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_documents: int = MAX_DOCUMENTS, max_lines: int = MAX_LINES) -> Field | float:
    """A field, or the constant score where there is one kind of label or none."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    sample = {r.id: r.y for r in known.orderBy(F.xxhash64("id"), "id").limit(max_documents).collect()}
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(sample))
    types = pa.schema([("doc_id", pa.int64()), ("rows", pa.binary())])

    def step(batch):
        ids = batch.column(0).to_pylist()
        keep = [i for i, d in enumerate(ids) if d in wanted.value]
        if keep:
            x, doc, weight = line_features(texts_of(batch).take(pa.array(keep)))
            data = []
            for k in range(len(keep)):
                at = np.flatnonzero(doc == k)
                some, begins = sampled(len(at), max_lines)
                at = at[some]
                data.append(np.concatenate([x[at], weight[at, None], begins[:, None]], axis=1).astype(np.float32).tobytes())
            yield {"doc_id": [ids[i] for i in keep], "rows": data}

    got = map_blocks(docs, "doc_id long, rows binary", step, types).toArrow().sort_by([("doc_id", "ascending"), ("rows", "ascending")])
    ids, data = got["doc_id"].to_pylist(), got["rows"].to_pylist()
    once = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]  # repeated rows of a sampled id count once
    y = np.array([sample[ids[k]] for k in once])
    if not len(y):
        return 0.5
    if y.min() == y.max():
        return float(y[0])
    parts = [np.frombuffer(data[k], dtype=np.float32).reshape(-1, WIDTH + 2).astype(np.float64) for k in once]
    rows = np.concatenate(parts)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(rows[:, :WIDTH], doc, rows[:, WIDTH], y, chain_of=np.cumsum(rows[:, WIDTH + 1] > 0))


def score_quality(documents: DataFrame, field: Field | float, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_lines, bad_share (length in lines that are rather bad)."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def step(batch):
        field_, texts = shared.value, texts_of(batch)
        x, doc, weight = line_features(texts)
        if isinstance(field_, Field):
            means = field_.documents(x, doc, weight, len(texts))
            score, bad = field_.score(means), means[:, 1]
        else:
            score, bad = np.full(len(texts), field_), np.zeros(len(texts))
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= cut).astype(np.int32), "n_lines": np.bincount(doc, minlength=len(texts)), "bad_share": bad}

    types = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_lines", pa.int64()), ("bad_share", pa.float64())])
    return map_blocks(docs, "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_share double", step, types)
