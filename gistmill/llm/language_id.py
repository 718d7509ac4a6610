"""Language identification with interpolated Kneser-Ney character models, one per language.

Text is lower-cased and reduced to runs of letters; each run is predicted letter by letter and to its closing boundary
from up to three characters before it inside the run. A four-character window packs into one 64-bit number (16 bits a
character; characters beyond the basic plane share one code), so the sorted key arrays are collision-free hash arrays and
a lookup is a binary search.

Training counts windows over all texts of known language that are not held out: each task counts distinct words, then
their windows, and only these partial sums are shuffled. Lower orders use continuation counts, discounts follow from
counts of counts, both over all windows; nothing is left out. A model is, for each language and order, a sorted array of the
windows seen with their interpolated log probabilities, and one of contexts with what they leave to the next lower order:
12 bytes an entry, and about 1.5 entries a window. There is no matrix of windows by languages. The driver gets the summed
table of distinct windows in one job and sends the arrays to the workers; they grow with the distinct windows of each
language, not with the number of texts.

A text gets the language of lowest cross-entropy per predicted character. Rejection is calibrated per language: the limit is
halfway between the cross-entropy of its own training windows and that of the nearest other language's windows under its
model, and a text of n characters may exceed it by ``SPREADS`` standard errors, the spread of a character's log probability
in training divided by the root of n. ``score`` is the posterior of the chosen language over at most ``SURE_CHARS``
characters, times the logistic acceptance.

Nulls: a null text or one without a letter is ``und``, score 0, rejected. A null language is not learned from. A null doc_id is
never held out. With nothing to learn from everything is ``und``. Ties go to the language first by name. Repeated rows, empty
tables and very long texts (also without spaces) are handled alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.session import bounded, blocks, held_out, map_blocks, texts_of

ORDER, EDGE = 4, 0x20
SURE_CHARS, SPREADS = 40, 3.0
LETTERS = re.compile(r"[^\W\d_]{1,32}")
FLUSH, CACHE = 200_000, 200_000
UND = "und"


def letters(text: str) -> list[str]:
    """Lower-case runs of letters; longer ones come in pieces of 32."""
    return LETTERS.findall(text.lower())


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows ending at each character of each word and at its closing edge, and the word each belongs to."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    codes = np.minimum(codes, np.uint64(0xFFFF))
    # every word stands between three leading edges and one closing edge
    starts = np.cumsum(sizes + 4) - (sizes + 4)
    line = np.full(int((sizes + 4).sum()), EDGE, dtype=np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    within = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    line[starts[word] + 3 + within] = codes
    n = len(line) - 3
    packed = (line[:n] << np.uint64(48)) | (line[1 : n + 1] << np.uint64(32)) | (line[2 : n + 2] << np.uint64(16)) | line[3:]
    owner = np.repeat(np.arange(len(words)), sizes + 4)
    # a window counts if it lies in one word's stretch: it starts at most at the stretch's end minus 4
    ok = np.arange(n) - starts[owner[:n]] <= sizes[owner[:n]]
    return packed[ok], owner[:n][ok]


def count_windows(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, window, n) over all texts of known language that are not held out."""
    learned = documents if id_col is None else documents.where(~held_out(F.col(id_col)))
    docs = learned.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    types = pa.schema([("lang", pa.string()), ("win", pa.int64()), ("n", pa.int64())])

    def flush(lang, words):
        packed, owner = windows(list(words))
        weight = np.fromiter(words.values(), dtype=np.int64, count=len(words))[owner]
        order = np.argsort(packed, kind="stable")
        packed, weight = packed[order], weight[order]
        starts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        return packed[starts], np.add.reduceat(weight, starts)

    def rows(lang, keys, counts):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], schema=types)

    def run(batches):
        words: dict[str, Counter] = {}
        sums: dict[str, tuple] = {}

        def settle(lang):
            keys, counts = flush(lang, words.pop(lang))
            if lang in sums:
                keys, counts = np.concatenate([sums[lang][0], keys]), np.concatenate([sums[lang][1], counts])
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.bincount(at, weights=counts).astype(np.int64)
            sums[lang] = (keys, counts)

        for batch in batches:
            texts, langs = texts_of(batch), batch.column(1).to_pylist()
            for start, end in blocks(texts):
                for text, lang in zip(texts.slice(start, end - start).to_pylist(), langs[start:end], strict=True):
                    words.setdefault(lang, Counter()).update(letters(text))
                    if len(words[lang]) > FLUSH:
                        settle(lang)
                        if len(sums[lang][0]) > 4 * FLUSH:
                            yield rows(lang, *sums.pop(lang))
        for lang in [*words]:
            if words[lang]:
                settle(lang)
        for lang, (keys, counts) in sums.items():
            yield rows(lang, keys, counts)

    return bounded(docs).mapInArrow(run, "lang string, win long, n long").groupBy("lang", "win").agg(F.sum("n").alias("n"))


class Model:
    """Log2 probabilities of windows under every language's interpolated Kneser-Ney model, in sorted arrays.

    ``tables`` has distinct windows and their counts for each language.
    """

    def __init__(self, langs: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        tables = [(keys[order], counts[order]) for keys, counts in tables for order in [np.argsort(keys)]]
        alphabet = np.unique(np.concatenate([keys & np.uint64(0xFFFF) for keys, _ in tables])) if langs else ()
        self.uniform = 1.0 / (len(alphabet) + 1)
        #: per language, orders 1 to 4: (windows, their log probabilities, contexts, logs of what these leave to the order below)
        self.orders = [self._orders(keys, counts.astype(np.float64)) for keys, counts in tables]
        #: calibration: cross-entropy and spread of each language's own windows, and the nearest other language's entropy
        size = len(langs)
        self.own, self.spread, other = np.zeros(size), np.zeros(size), np.full(size, np.inf if size > 1 else -np.log2(self.uniform))
        for m, (keys, n) in enumerate(tables):
            for lang in range(size):
                logs = self.logs(lang, keys)
                cross = -(logs * n).sum() / n.sum()
                if lang == m:
                    self.own[m], self.spread[m] = cross, np.sqrt(max(((logs + cross) ** 2 * n).sum() / n.sum(), 0.0))
                else:
                    other[lang] = min(other[lang], cross)
        self.limit = (self.own + np.maximum(other, self.own + 1)) / 2

    def _orders(self, keys: np.ndarray, n: np.ndarray) -> list[tuple]:
        levels = [(keys, n)]
        for k in range(ORDER - 1, 0, -1):  # a shorter window counts the longer ones that it ends
            shorter, kinds = np.unique(levels[-1][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            levels.append((shorter, kinds.astype(np.float64)))
        out: list[tuple] = []
        for k, (keys, n) in enumerate(reversed(levels), 1):
            ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            contexts, at, kinds = np.unique(keys >> np.uint64(16), return_inverse=True, return_counts=True)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            left = discount * kinds / total
            below = 2.0 ** self._walk(out, keys & np.uint64((1 << 16 * (k - 1)) - 1))
            logs = np.log2(np.maximum(n - discount, 0) / total[at] + left[at] * below)
            out.append((keys, logs.astype(np.float32), contexts, np.log2(left).astype(np.float32)))
        return out

    def _walk(self, orders: list[tuple], windows_: np.ndarray) -> np.ndarray:
        """Log probabilities from the highest order on: a seen window's own, else what its context leaves times the order below."""
        logs, open_ = np.zeros(len(windows_)), np.arange(len(windows_))
        for k in range(len(orders), 0, -1):
            keys, own, contexts, left = orders[k - 1]
            key = windows_[open_] if k == ORDER else windows_[open_] & np.uint64((1 << 16 * k) - 1)
            place, seen = _find(keys, key)
            logs[open_[seen]] += own[place[seen]]
            open_, key = open_[~seen], key[~seen]
            place, known = _find(contexts, key >> np.uint64(16))
            logs[open_[known]] += left[place[known]]
        logs[open_] += np.log2(self.uniform)
        return logs

    def logs(self, lang: int, windows_: np.ndarray) -> np.ndarray:
        """Log2 probability of each window's last character in a language."""
        return self._walk(self.orders[lang], windows_)

    def word_logs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log2 probabilities of each word (a column for each language) and its predicted characters."""
        packed, owner = windows(words)
        names, at = np.unique(packed, return_inverse=True)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums = [np.add.reduceat(self.logs(lang, names)[at], starts) for lang in range(len(self.langs))]
        return np.stack(sums, axis=1), np.diff(np.concatenate([starts, [len(owner)]]))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each number in a sorted array, and whether it is there."""
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    return place, keys[place] == wanted


def train(documents: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Models of all languages; ``id_col`` None learns from all rows, else held-out rows are left out."""
    counts = count_windows(documents, id_col, text_col, lang_col).toArrow()
    names = counts["lang"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
    windows_, n, which = counts["win"].to_numpy().view(np.uint64), counts["n"].to_numpy(), names.indices.to_numpy()
    found = names.dictionary.to_pylist()
    langs = sorted(found)
    return Model(langs, [(windows_[which == k], n[which == k]) for k in map(found.index, langs)])


class Scorer:
    """Scores texts with a model, keeping words it has seen."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.langs)))
        self.size = np.zeros(0, dtype=np.int64)

    def block(self, texts: list[str]) -> dict:
        model, n = self.model, len(texts)
        lists = [letters(t) for t in texts]
        if len(self.place) > CACHE:
            self.__init__(model)
        missing = [*set().union(*lists).difference(self.place)]
        if missing and model.langs:
            logs, size = model.word_logs(missing)
            self.place.update(zip(missing, range(len(self.place), len(self.place) + len(missing)), strict=True))
            self.logs, self.size = np.concatenate([self.logs, logs]), np.concatenate([self.size, size])
        langs, scores, rejected, entropy = [], np.zeros(n), np.ones(n, dtype=bool), np.full(n, np.nan)
        for d, words in enumerate(lists):
            if not words or not model.langs:
                langs.append(UND)
                continue
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            chars = int(self.size[at].sum())
            h = -self.logs[at].sum(axis=0) / chars
            best = int(np.argmin(h))
            weight = 2.0 ** (-(h - h[best]) * min(chars, SURE_CHARS))
            over = h[best] - model.limit[best] - SPREADS * model.spread[best] / chars**0.5
            scores[d] = 1 / weight.sum() / (1 + np.exp(np.clip(4 * over, -60, 60)))
            rejected[d] = over > 0
            entropy[d] = h[best]
            langs.append(model.langs[best])
        return {"lang_pred": langs, "score": scores, "rejected": rejected, "cross_entropy": entropy}


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, cross_entropy (null for ``und``)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own: list[Scorer] = []

    def step(batch):
        if not own:
            own.append(Scorer(shared.value))
        out = own[0].block(texts_of(batch).to_pylist())
        out["cross_entropy"] = pa.array(out["cross_entropy"], from_pandas=True)
        yield {"doc_id": batch.column(0), "held_out": batch.column(1), **out}

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    types = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())])
    return map_blocks(docs, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double", step, types)


def keep_identified(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not reject."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).fill_null("")
            for start, end in blocks(texts):
                out = scorer.block(texts.slice(start, end - start).to_pylist())
                kept = batch.slice(start, end - start).filter(pa.array(~out["rejected"]))
                if kept.num_rows:
                    yield kept

    return bounded(documents).mapInArrow(run, documents.schema)
