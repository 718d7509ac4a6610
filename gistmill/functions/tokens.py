"""Token counts: an estimate as a Column and as a function, and exact counts from a rank or tokenizer file where there is one."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill import fixed

#: White space as Python's ``str.split`` has it, for Java's regex.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def estimate(text: str) -> int:
    """Half of (a quarter of the characters plus 1.3 per word), rounded down; 1 at least, 0 for the empty text."""
    return max(1, (len(text) // 4 + int(len(text.split()) * 1.3)) // 2) if text else 0


def token_estimate(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""))
    chars = F.floor(F.length(text) / 4)
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((chars + F.floor(words * F.lit(1.3))) / 2))).cast("int")


@lru_cache(maxsize=4)
def exact(path: str, pattern: str) -> Callable[[str], int]:
    """Counter from a rank file (one base64 token and its rank a line) and the scheme's splitting pattern."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


@lru_cache(maxsize=4)
def from_file(path: str) -> Callable[[str], int]:
    """Counter from a tokenizer's own file: ``.json`` or ``.model``; without added begin and end tokens."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda text: len(pieces.encode(text))


class Profile:
    """A named way of counting; ``is_exact`` tells estimates apart. Exact are rank files with a pattern, and tokenizer files."""

    def __init__(self, name: str, path: str | None = None, pattern: str | None = None):
        self.name, self.path, self.pattern = name, path, pattern
        self.whole = bool(path) and path.endswith((".json", ".model"))
        self.is_exact = self.whole or bool(path and pattern)

    def count(self, text: str) -> int:
        if not self.is_exact or not text:
            return estimate(text)
        return from_file(self.path)(text) if self.whole else exact(self.path, self.pattern)(text)


def profile(name: str, path: str | None = None, pattern: str | None = None) -> Profile:
    """Profile by name; an unknown name is an error rather than a silent estimate.

    ``openai:<encoding>`` and the bare names are exact only with a rank file (``path`` and ``pattern``) or a tokenizer file
    (``path``) at hand, as nothing is fetched here; otherwise they estimate and say so.
    """
    clean = name.strip().lower()
    if clean.startswith("openai:") or clean in fixed.TOKENIZER_NAMES:
        return Profile(name if ":" in name else f"openai:{clean}", path, pattern)
    if clean == "heuristic" or clean.startswith("heuristic:"):
        return Profile(name)
    raise ValueError(f"Unknown tokenizer profile: {name!r}")
