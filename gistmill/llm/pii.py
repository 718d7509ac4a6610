"""Personal data: fixed base patterns, plus spans found by weak supervision.

Base spans (email, ip, card, phone) follow given patterns, leftmost and without overlap for each kind. Further candidates
(secrets, local phone numbers, spelled-out mail addresses, IBANs, social security numbers) come from broad patterns.
Labelers vote on each candidate: strict patterns, gazetteers (key prefixes, country codes, placeholders), context words
before it, assignment signs, shape, and boundaries. How often each pattern of votes occurs with each kind is counted over all
texts; expectation-maximisation on these counts estimates how reliable each labeler is, first over all kinds, then for each
kind from there. A logistic span classifier is trained on the posteriors; besides the votes it sees the span itself and its
surroundings: lengths, shares of digits and capitals, variety, the words beside it (hashed). It decides on the candidates.

The driver gets at most ``CODES`` counted vote patterns, and of the distinct (votes, features) rows the ``max_spans`` of
smallest hash: the bounded sample that the classifier is fitted on. All candidates are judged.

Nulls: a null text is empty. A null doc_id, repeated rows and very long texts get a row each; the patterns take time
linear in the text. Without any candidates nothing is added. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.session import checkpoint, map_blocks, narrow, texts_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "phone_local", "email_spelled", "iban", "ssn")
KINDS = BASE + ADDED

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number can only begin where a run of digits does, which keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``local@domain`` from each @ outwards: the same as scanning for the pattern, but linear."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out)


#: Fixed values of the labelers.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-")
COUNTRIES = frozenset("AD AE AL AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
PLACEHOLDERS = ("example", "xxxx", "0000", "changeme", "placeholder", "your", "test", "dummy", "1234567")
TOP_DOMAINS = frozenset("com net org edu gov io de fr es uk eu info".split())
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "access-key")
CUES = {"secret": SECRET_CUES + ("key", "credential", "bearer"), "phone_local": ("call", "phone", "tel", "fax", "mobile", "contact"), "email_spelled": ("mail", "contact", "write", "reach"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social", "security")}
WRONG_CUES = ("version", "isbn", "issue", "commit", "sha", "md5", "checksum", "order", "page", "build", "doi")

ASSIGNED = re.compile(r"(?:" + "|".join(SECRET_CUES) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/-]{8,})", re.IGNORECASE)
PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.)-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]{2,}+)+", re.IGNORECASE)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the broad patterns find."""
    out = []
    low = text.lower()
    if any(c in low for c in SECRET_CUES):
        out += [(*m.span(1), 0) for m in ASSIGNED.finditer(text)]
    if any(p in text for p in KEY_PREFIXES):
        out += [(*m.span(), 0) for m in PREFIXED.finditer(text)]
    if "at)" in low or "at ]" in low or "at]" in low or "at )" in low:
        out += [(*m.span(), 2) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        out += [(*m.span(), 1) for m in LOCAL_PHONE.finditer(text)]
        out += [(*m.span(), 3) for m in IBAN.finditer(text)]
        out += [(*m.span(), 4) for m in SSN.finditer(text)]
    return [(a, k, b) for a, b, k in out]


def _mod97(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(text: str, start: int, kind: int, end: int) -> list[int]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 none."""
    value, name = text[start:end], ADDED[kind]
    plain = re.sub(r"[^A-Za-z0-9]", "", value)
    digits = sum(c.isdigit() for c in plain)
    before = text[max(0, start - 32) : start].lower()
    if name == "secret":
        strict = bool(PREFIXED.fullmatch(value)) or (len(value) >= 12 and 0 < digits < len(plain))
        known = value.startswith(KEY_PREFIXES)
    elif name == "phone_local":
        strict, known = plain[3] in "23456789" and len(plain) == 10, False
    elif name == "email_spelled":
        top = re.split(r"[^A-Za-z]+", value)[-1].lower()
        strict, known = len(top) >= 2, top in TOP_DOMAINS
    elif name == "iban":
        strict, known = 15 <= len(plain) <= 34 and _mod97(plain), plain[:2] in COUNTRIES
    else:
        strict, known = plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000", False
    placeholder = any(p in value.lower() for p in PLACEHOLDERS)
    cue, wrong = any(c in before for c in CUES[name]), any(c in before for c in WRONG_CUES)
    assigned = bool(re.search(r"[=:]\s*[\"']?$", before))
    varied = len(set(plain)) >= 5
    inside = (start > 0 and text[start - 1] in "/.#_") or (end < len(text) and text[end : end + 1] in "/_@")
    return [1 if strict else -1, -1 if placeholder else int(known), -1 if wrong else int(cue), int(assigned), 1 if varied else -1, -1 if inside else 0]


LABELERS = 6
CODES = 3**LABELERS * len(ADDED)
BUCKETS, MAX_SPANS = 256, 20_000
WORD = re.compile(r"[^\W\d_]+")


def code(text: str, start: int, kind: int, end: int) -> int:
    """Votes and kind as one number below CODES."""
    out = 0
    for v in votes(text, start, kind, end):
        out = out * 3 + v + 1
    return out * len(ADDED) + kind


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (a column for each labeler) and kinds of codes."""
    rest, kind = codes // len(ADDED), codes % len(ADDED)
    cols = []
    for _ in range(LABELERS):
        cols.append(rest % 3 - 1)
        rest = rest // 3
    return np.stack(cols[::-1], axis=1), kind


def traits(text: str, start: int, kind: int, end: int) -> list[int]:
    """Buckets of what the span and its surroundings look like, each with the kind."""
    value = text[start:end]
    plain = [c for c in value if c.isalnum()]
    n = max(len(plain), 1)
    before, after = WORD.findall(text[max(0, start - 32) : start].lower()), WORD.findall(text[end : end + 32].lower())
    seen = {
        "length": min(len(value) // 6, 12),
        "digits": 5 * sum(c.isdigit() for c in plain) // n,
        "capitals": 5 * sum(c.isupper() for c in plain) // n,
        "variety": min(len(set(plain)) // 3, 8),
        "signs": len({c for c in value if not c.isalnum()}),
        "left": text[start - 1] if start and not text[start - 1].isalnum() else "",
        "right": text[end : end + 1] if not text[end : end + 1].isalnum() else "",
        "before": before[-1] if before else "",
        "after": after[0] if after else "",
    }
    return [zlib.crc32(f"{kind}:{name}={x}".encode("utf-8", "replace")) % BUCKETS for name, x in seen.items()]


def reliabilities(vote: np.ndarray, n: np.ndarray, rounds: int = 50, start: np.ndarray | None = None, weight: float = 4.0, share: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each vote pattern, the labelers' vote probabilities [labeler, class, vote], and the share of data, by EM."""
    # start from labelers that are right more often than wrong; the prior counts keep them on that side
    first = np.tile(np.array([[0.5, 0.35, 0.15], [0.15, 0.35, 0.5]]), (vote.shape[1], 1, 1)) if start is None else start
    table, prior, prior_share = first.copy(), first * weight, share
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        logs = np.stack([np.log(table[np.arange(vote.shape[1]), c, vote + 1]).sum(axis=1) for c in (0, 1)], axis=1)
        odds = np.log(share / (1 - share)) + logs[:, 1] - logs[:, 0]
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        by = np.stack([(1 - post) * n, post * n], axis=1)
        share = float((by[:, 1].sum() + weight * prior_share) / (n.sum() + weight))
        for v in range(3):
            table[:, :, v] = prior[:, :, v] + ((vote == v - 1)[:, :, None] * by[:, None, :]).sum(axis=0)
        table /= table.sum(axis=2, keepdims=True)
    return post, table, share


def by_kind(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Posterior of each code, and the labelers' vote probabilities for each kind.

    The estimate over all kinds is the start and the prior (as many counts as a quarter of the kind's own) of each kind's.
    """
    vote, kind = decode(codes)
    post, table, share = reliabilities(vote, n)
    tables = {}
    for k in np.unique(kind).tolist():
        own = kind == k
        post[own], tables[k], _ = reliabilities(vote[own], n[own], start=table, weight=max(8.0, n[own].sum() / 4), share=share)
    return post, tables


def features(codes: np.ndarray, found: list[list[int]]) -> np.ndarray:
    vote, kind = decode(codes)
    hashed = np.zeros((len(codes), BUCKETS))
    for row, buckets in enumerate(found):
        hashed[row, buckets] = 1
    return np.concatenate([np.ones((len(codes), 1)), vote == 1, vote == -1, np.eye(len(ADDED))[kind], hashed], axis=1).astype(float)


def fit(codes: np.ndarray, n: np.ndarray, sample: list[tuple[int, list[int], int]]) -> np.ndarray:
    """Classifier weights from all counted codes and a sample of (code, buckets, count)."""
    post, _ = by_kind(codes, n.astype(float))
    target = dict(zip(codes.tolist(), post.tolist(), strict=True))
    x = features(np.array([c for c, _, _ in sample]), [b for _, b, _ in sample])
    y, scale = np.array([target[c] for c, _, _ in sample]), np.array([k for _, _, k in sample], dtype=float)
    scale /= scale.sum()
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (p - y)) + 1e-3 * w
        hess = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def train(docs: DataFrame, max_spans: int = MAX_SPANS) -> np.ndarray | None:
    """Weights from the candidates of all texts; None without any."""
    types = pa.schema([("code", pa.int64()), ("buckets", pa.list_(pa.int32()))])

    def step(batch):
        found = [(code(t, *c), traits(t, *c)) for t in texts_of(batch).to_pylist() for c in candidates(t)]
        yield {"code": [c for c, _ in found], "buckets": [b for _, b in found]}

    rows = checkpoint(map_blocks(docs.select("text"), "code long, buckets array<int>", step, types).groupBy("code", "buckets").agg(F.count("*").alias("n")))
    counts = rows.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    if not counts.num_rows:
        return None
    sample = [(r.code, r.buckets, r.n) for r in rows.orderBy(F.xxhash64("code", "buckets"), "code", "buckets").limit(max_spans).collect()]
    return fit(counts["code"].to_numpy(), counts["n"].to_numpy(), sample)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, as kind:start:end), n_added, n_found (of all spans)."""
    docs = narrow(documents, id_col, text_col)
    weights = train(docs)

    def step(batch):
        counts, digests, spans, added = [], [], [], []
        for text in texts_of(batch).to_pylist():
            base = base_spans(text)
            found = list(base)
            more = candidates(text) if weights is not None else []
            if more:
                p = features(np.array([code(text, *c) for c in more]), [traits(text, *c) for c in more]) @ weights
                logit = np.log(least / (1 - least))
                for (a, k, b), score in sorted(zip(more, p, strict=True), key=lambda x: (x[0][0], -x[0][2], x[0][1])):
                    if score >= logit and not any(a < e and s < b for s, _, e in found):
                        found.append((a, len(BASE) + k, b))
            kinds = [k for _, k, _ in base]
            counts.append([kinds.count(k) for k in range(4)])
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted(found)))
            added.append(len(found) - len(base))
        columns = {f"n_{name}": [c[i] for c in counts] for i, name in enumerate(BASE)}
        yield {"doc_id": batch.column(0), **columns, "base_sha256": digests, "spans": spans, "n_added": added, "n_found": [sum(c) + n for c, n in zip(counts, added, strict=True)]}

    types = pa.schema([("doc_id", pa.int64())] + [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_found", pa.int64())])
    return map_blocks(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long", step, types)
