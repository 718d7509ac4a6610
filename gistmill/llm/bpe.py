"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round finds for every word its lowest-ranked adjacent pair (binary
search over the sorted keys of all mergeable pairs), merges that pair's occurrences from the left, and looks up only the
pairs that changed. Words without a mergeable pair leave the array. A worker keeps the results of words it has seen, in
a cache of bounded size, so a batch encodes each new word once.

Two published schemes are read from their JSON files: byte-level words with leading spaces, and lower-cased words with an
end-of-word suffix. Special strings inside texts become their one special token, as the library's default has it.

Nulls: a null text is the empty text (no tokens, empty decoded text). Rows are never merged: repeated rows and null ids
give a result each. Very long words run through the same rounds but are not cached. Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gistmill.llm.session import map_blocks, narrow, texts_of

#: The published splitting patterns of the two schemes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space as the library's patterns have it (Unicode White_Space).
SPACE = "[" + "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"

NONE = np.iinfo(np.int32).max
CACHE_WORDS, CACHE_LENGTH = 300_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Vocabulary and sorted pair table of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab = model["vocab"]
        suffix = self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        letters = byte_letters()
        self.base = np.array([vocab[c] for c in letters] + [vocab[c + suffix] for c in letters], dtype=np.int64)
        rows = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rows.append(((vocab[a] << 32) | vocab[b], rank, vocab[a + b]))
        table = np.array(rows, dtype=np.int64)
        table = table[np.argsort(table[:, 0])]
        self.pairs, self.rank, self.made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].copy()
        ids = np.repeat(self.base[:, None], 512, axis=1)
        self.first = self.find((ids << 32) | self.base[None, :])  # pairs of base symbols need no search later
        back = {c: b for b, c in enumerate(letters)}
        self.bytes: dict[int, bytes] = {}
        for token, i in vocab.items():
            if suffix and token.endswith(suffix):
                token = token[: -len(suffix)] + " "
            self.bytes[i] = bytes(back.get(c, 32) for c in token)
        self.bytes |= {i: s.encode() for s, i in self.special.items()}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each pair in the sorted table, -1 if it does not merge."""
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == keys, at, -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and offsets by word."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        if self.suffix:
            raw[np.cumsum(sizes)[sizes > 0] - 1] += 256
        ids, word = self.base[raw], np.repeat(np.arange(len(words)), sizes)
        pair = np.full(len(ids), -1, dtype=np.int64)
        if len(ids) > 1:
            pair[:-1] = np.where(word[1:] == word[:-1], self.first[raw[:-1], raw[1:]], -1)
        done_word, done_ids = [], []
        while len(ids):
            rank = np.where(pair >= 0, self.rank[pair], NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.concatenate([starts, [len(ids)]]))
            live = np.repeat(least < NONE, spans)
            if not live.all():
                done_word.append(word[~live])
                done_ids.append(ids[~live])
                rank, ids, word, pair, least = rank[live], ids[live], word[live], pair[live], np.repeat(least, spans)[live]
                if not len(ids):
                    break
            else:
                least = np.repeat(least, spans)
            hit = rank == least
            at = np.flatnonzero(hit)
            if len(at) > 1:  # of touching occurrences (equal symbols in a row) every other one merges
                fresh = np.concatenate([[True], np.diff(at) > 1])
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            ids[at] = self.made[pair[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            ids, word, pair = ids[keep], word[keep], pair[keep]
            changed = place[at]
            changed = np.unique(np.concatenate([changed, changed[changed > 0] - 1]))
            pair[changed] = -1
            inner = changed[changed < len(ids) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            pair[inner] = self.find((ids[inner] << 32) | ids[inner + 1])
        if not done_ids:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


class Splitter:
    """Words of a text in one of the two schemes; special strings come out as themselves."""

    def __init__(self, bpe: Bpe):
        self.lower = bool(bpe.suffix)
        space = SPACE[1:-1]
        pattern = (WORD_PATTERN if self.lower else BYTE_PATTERN).replace(r"[^\s", f"[^{space}").replace(r"(?!\S)", f"(?![^{space}])").replace(r"\s", SPACE)
        self.find = regex.compile(pattern).findall
        self.special = [*bpe.special]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def piece(self, text: str) -> list[str]:
        if self.lower:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            text = text.lower()
        return self.find(text)

    def words(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return self.piece(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.piece(part)
        return out


class Coder:
    """Worker state: the vocabulary and a bounded cache of words, each with its ids as text and its decoded text."""

    def __init__(self, path: str):
        self.bpe = load(path)
        self.split = Splitter(self.bpe)
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.text = {}, {}
        for special, i in self.bpe.special.items():
            self.ids[special], self.text[special] = str(i), self.bpe.bytes[i].decode()
        missing = [*set().union(*lists).difference(self.ids)]
        if not missing:
            return
        ids, off = self.bpe.encode([w.encode() for w in missing])
        names, token = ids.tolist(), self.bpe.bytes
        for k, w in enumerate(missing):
            own = names[off[k] : off[k + 1]]
            self.ids[w] = ",".join(map(str, own))
            self.text[w] = b"".join([token[i] for i in own]).decode("utf-8", "replace")

    def forget_long(self, lists: list[list[str]]) -> None:
        for words in lists:
            for w in words:
                if len(w) > CACHE_LENGTH:
                    self.ids.pop(w, None)
                    self.text.pop(w, None)


@lru_cache(maxsize=4)
def coder(path: str) -> Coder:
    return Coder(path)


#: What a round trip can return besides doc_id.
OUTPUTS = {"n_tokens": ("long", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def bpe_round_trip(documents: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode its ids again; one row per document with ``outputs`` (see OUTPUTS).

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text in UTF-8, both of the
    real ids and text. ``tokenizer_path`` must be readable on every worker.
    """
    types = pa.schema([("doc_id", pa.int64())] + [(o, OUTPUTS[o][1]) for o in outputs])
    schema = ", ".join(["doc_id long"] + [f"{o} {OUTPUTS[o][0]}" for o in outputs])

    def step(batch):
        own = coder(tokenizer_path)
        lists = [own.split.words(t) for t in texts_of(batch).to_pylist()]
        own.learn(lists)
        ids = [",".join(map(own.ids.__getitem__, words)) for words in lists]
        out: dict = {"doc_id": batch.column(0)}
        if "n_tokens" in outputs:
            out["n_tokens"] = [x.count(",") + bool(x) for x in ids]
        if "ids" in outputs:
            out["ids"] = [np.fromstring(x, dtype=np.int32, sep=",") if x else np.zeros(0, dtype=np.int32) for x in ids]
        if "ids_sha256" in outputs:
            out["ids_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
        if "decoded" in outputs or "decoded_sha256" in outputs:
            text = ["".join(map(own.text.__getitem__, words)) for words in lists]
            out["decoded"] = text
            out["decoded_sha256"] = [hashlib.sha256(x.encode()).hexdigest() for x in text]
        own.forget_long(lists)
        yield out

    return map_blocks(narrow(documents, id_col, text_col), schema, step, types)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows of token ids (null: empty text; ids outside the vocabulary decode to nothing)."""

    def run(batches):
        token = load(tokenizer_path).bytes
        for batch in batches:
            texts = [b"".join([token.get(i, b"") for i in x or ()]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"CAST(`{ids_col}` AS ARRAY<INT>) AS ids").mapInArrow(run, "doc_id long, text string")
