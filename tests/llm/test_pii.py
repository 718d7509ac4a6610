import hashlib
import random
import re

import numpy as np

from gistmill.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), list(PATTERNS).index(k), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]
    return sorted(found)


def texts():
    rng = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "x@y.z@w.v", "é", " ", ".", "-", "+", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1", "12", "999", "(", ")", "mail@", "%", "\n", "+49.30.1234567", "1.2.3.4.5.6.7.8.9", "00000000000000", "secret"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(2500)]


def test_base_equals_patterns():
    for text in texts():
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1 " * 100_000, "+1" + "(" * 200_000, "1." * 100_000, "@" * 200_000):
        pii.base_spans(text)
        pii.candidates(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS code", "2 AS spans")


def test_added_spans_and_edge_cases(spark):
    rng = random.Random(3)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'lorem token = "{hexa(40)}" ipsum password={hexa(18)} dolor AKIA{"".join(rng.choice("ABCDEFGHJKMNPQ23456") for _ in range(16))} sit') for i in range(30)]
    rows += [(100 + i, f"see version 123-45-6789 or call 212 555 {1000 + i} now, jane [at] mail [dot] com") for i in range(10)]
    rows += [(200, None), (201, ""), (202, "x@y.org and 10.0.0.1"), (202, "x@y.org and 10.0.0.1"), (None, "+1 (988) 555-2485"), (203, "word " * 20000 + "x@y.org")]
    df = frame(spark, rows)
    out = pii.find_pii(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in range(30):
        assert by[i].spans.count("secret:") == 3
    assert by[200].spans == "" and by[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[202].spans == "email:0:7,ip:12:20" and (by[202].n_email, by[202].n_ip) == (1, 1)
    assert by[None].spans == "phone:0:17"
    assert by[203].spans == "email:100000:100007"
    assert "email_spelled" in by[100].spans
    for r, text in ((r, dict(rows)[r.doc_id]) for r in out):
        base = brute(text)
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(r.spans.split(","))


def test_no_candidates_and_empty_table(spark):
    df = frame(spark, [(1, "plain words only")])
    assert [r.spans for r in pii.find_pii(df).collect()] == [""]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_em_recovers_reliable_labelers():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.6
    acc = np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.85])
    vote = np.where(rng.random((4000, 6)) < acc, np.where(y[:, None], 1, -1), np.where(y[:, None], -1, 1))
    post, table, share = pii.reliabilities(vote, np.ones(4000))
    assert abs(share - 0.6) < 0.05
    assert np.mean((post > 0.5) == y) > 0.96
    assert np.all(np.abs(table[:, 1, 2] - acc) < 0.05)
    codes = np.arange(0, pii.CODES, 97)
    v, k = pii.decode(codes)
    back = np.zeros(len(codes), dtype=np.int64)
    for j in range(6):
        back = back * 3 + v[:, j] + 1
    assert np.array_equal(back * len(pii.ADDED) + k, codes)


def test_reliabilities_differ_by_kind():
    """A labeler that is right for one kind and guesses for another gets two reliabilities."""
    rng = np.random.default_rng(2)
    kind, y = rng.integers(0, 2, 6000), rng.random(6000) < 0.5
    acc = np.where(kind[:, None] == 0, [0.95, 0.95, 0.9, 0.9, 0.9, 0.9], [0.95, 0.5, 0.9, 0.9, 0.9, 0.9])
    vote = np.where(rng.random((6000, 6)) < acc, np.where(y[:, None], 1, -1), np.where(y[:, None], -1, 1))
    codes = np.zeros(6000, dtype=np.int64)
    for j in range(6):
        codes = codes * 3 + vote[:, j] + 1
    names, at, n = np.unique(codes * len(pii.ADDED) + kind, return_inverse=True, return_counts=True)
    post, tables = pii.by_kind(names, n.astype(float))
    assert np.mean((post[at] > 0.5) == y) > 0.95
    assert tables[0][1, 1, 2] > 0.85 and tables[1][1, 1, 2] < 0.65


def planted(rng):
    """(value to find, kind, text), and texts of look-alikes by kind, in random words."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    words = lambda: " ".join(word() for _ in range(rng.randint(4, 12)))
    take = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, capital = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def iban():
        account = take("0123456789", 18)
        return next(f"DE{c:02d}{account}" for c in range(2, 99) if int(f"{account}1314{c:02d}") % 97 == 1)

    real = {
        "secret": lambda: rng.choice([(f"password={(v := take(hexa, 18))}", v), (f'token = "{(v := take(hexa, 40))}"', v), ((v := "AKIA" + take(capital, 16)), v), ((v := "ghp_" + take(hexa, 36)), v)]),
        "phone_local": lambda: ((v := f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"), v) if rng.random() < 0.5 else (f"call ({(a := rng.randint(200, 999))}) 555-{(b := rng.randint(1000, 9999))}", f"({a}) 555-{b}"),
        "email_spelled": lambda: ((v := f"{word()}{rng.choice([' [at] ', ' (at) '])}{word()}{rng.choice([' [dot] ', ' (dot) ', '.'])}{rng.choice(['com', 'org', 'de'])}"), v),
        "iban": lambda: (rng.choice(["iban ", "", "konto "]) + (v := iban()), v),
        "ssn": lambda: (rng.choice(["ssn ", "social security ", ""]) + (v := f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), v),
    }
    like = {
        "secret": lambda: rng.choice(["password=changeme", "token = placeholder", "api_key: your_key_here", "secret=xxxxxxxxxxxx"]),
        "phone_local": lambda: f"order {rng.randint(200, 999)}-{rng.choice('01')}{rng.randint(10, 99)}-0000/",
        "iban": lambda: f"build DE00{take('ABCDEFGH', 4)}{take('0000', 4)}{take(capital, 4)}",
        "ssn": lambda: f"version {rng.choice(['000', '666'])}-00-{rng.randint(1000, 9999)}",
    }
    good = [(kind, *make()) for kind, make in real.items() for _ in range(60)]
    bad = [(kind, make()) for kind, make in like.items() for _ in range(30)]
    return [(kind, v, f"{words()} {t} {words()}") for kind, t, v in good], [(kind, f"{words()} {t} {words()}") for kind, t in bad]


def test_recall_by_kind(spark):
    """Of planted data of every kind 0.9 at least are found whole; of look-alikes at most a tenth."""
    good, bad = planted(random.Random(11))
    rows = [(i, t) for i, (_, _, t) in enumerate(good)] + [(10_000 + i, t) for i, (_, t) in enumerate(bad)]
    spans = {r.doc_id: r.spans.split(",") for r in pii.find_pii(frame(spark, rows)).collect()}
    for kind in pii.ADDED:
        own = [f"{kind}:{t.index(v)}:{t.index(v) + len(v)}" in spans[i] for i, (k, v, t) in enumerate(good) if k == kind]
        assert len(own) == 60 and np.mean(own) >= 0.9, (kind, np.mean(own))
        wrong = [any(x.startswith(kind + ":") for x in spans[10_000 + i]) for i, (k, _) in enumerate(bad) if k == kind]
        assert not wrong or np.mean(wrong) <= 0.1, (kind, np.mean(wrong))


def test_long_secrets_are_whole():
    value = "aB3dE5gH7j" * 50
    for text, start in ((f"token = {value} end", 8), (f"x sk-{value} end", 2), (f"x ghp_{value} end", 2), (f"x xoxb-{value} end", 2)):
        assert (start, 0, len(text) - 4) in pii.candidates(text)
    pii.candidates("token=" + "a" * 300_000 + " sk-" + "b" * 300_000)
