"""Token counts by a two-tier map-side lookup; pre-tokens are never shuffled, and texts are read once.

First tier: a compact table of the lengths of frequent pre-tokens, broadcast. Frequent are those that the tokenizer's
vocabulary holds as whole words, which is what its own training found frequent; a caller may name others, say of an
earlier count. The table has as many rows as the vocabulary at most, whatever the corpus, and only decides speed: counts
never depend on it. Second tier: what the table misses is encoded in numpy merge rounds, once per worker, in a cache of
bounded size. Both are looked up once for each distinct pre-token of a block of texts.

Nulls: a null text has no tokens. Repeated rows, null ids, empty and very long texts get a row each, whole. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gistmill.llm.bpe import CACHE_LENGTH, CACHE_WORDS, Bpe, Splitter, load
from gistmill.llm.session import map_blocks, narrow, texts_of

LIMIT = 2048


def whole_words(bpe: Bpe) -> list[str]:
    """Pre-tokens that are one entry of the vocabulary."""
    split, out = Splitter(bpe), []
    for data in bpe.bytes.values():
        word = data.decode("utf-8", "replace")
        if bpe.suffix:
            if not word.endswith(" "):
                continue
            word = word[:-1]
        if split.words(word) == [word] and word not in bpe.special:
            out.append(word)
    return out


def length_table(bpe: Bpe, words: Iterable[str]) -> tuple[str, np.ndarray]:
    """The distinct words, joined by line ends (no pre-token with one is kept), and their numbers of tokens."""
    words = sorted({w for w in words if w and "\n" not in w and w not in bpe.special})
    _, off = bpe.encode([w.encode() for w in words])
    return "\n".join(words), np.diff(off).astype(np.uint32)


class Counter:
    """Worker state: the splitter, the broadcast table, and the cache of what it misses."""

    def __init__(self, path: str, names: str, lengths: np.ndarray):
        self.bpe = load(path)
        self.split = Splitter(self.bpe)
        self.table = dict(zip(names.split("\n"), lengths.tolist(), strict=True)) if len(lengths) else {}
        self.table |= dict.fromkeys(self.bpe.special, 1)
        self.cache: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        lists = [self.split.words(t) for t in texts]
        words = set().union(*lists)
        missed = words.difference(self.table)
        new = [*missed.difference(self.cache)]
        own = {w: self.table[w] for w in words - missed} | {w: self.cache[w] for w in missed.intersection(self.cache)}
        if new:
            _, off = self.bpe.encode([w.encode() for w in new])
            found = dict(zip(new, np.diff(off).tolist(), strict=True))
            own |= found
            if len(self.cache) > CACHE_WORDS:
                self.cache = {}
            self.cache |= {w: n for w, n in found.items() if len(w) <= CACHE_LENGTH}
        return [sum(map(own.__getitem__, x)) for x in lists]


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", frequent: Iterable[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    ``frequent`` are the pre-tokens of the first tier (the vocabulary's whole words if not given).
    """
    docs = narrow(documents, id_col, text_col)
    bpe = load(tokenizer_path)
    shared = docs.sparkSession.sparkContext.broadcast(length_table(bpe, whole_words(bpe) if frequent is None else frequent))
    own: list[Counter] = []

    def step(batch):
        if not own:
            own.append(Counter(tokenizer_path, *shared.value))
        texts = texts_of(batch)
        counts = own[0].counts(texts.to_pylist())
        yield {"doc_id": batch.column(0), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    types = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return map_blocks(docs, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", step, types)
