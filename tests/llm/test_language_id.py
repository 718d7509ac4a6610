import math
import random
import zlib
from collections import Counter

import numpy as np

from gistmill.llm.language_id import Model, identify, keep_identified, letters, train, windows

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "tion", "é", "que"]}


def rows(n=300):
    rng = random.Random(1)
    out = []
    for i in range(n):
        lang = rng.choice([*SYLLABLES])
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 40))]
        out.append((i, " ".join(words).title() + ".", lang))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS win")


def test_held_out_accuracy_and_edge_cases(spark):
    data = rows()
    extra = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... !", None), (None, "kalo mita", None), (1004, "ung" * 20000, "bb"), (1005, "x" * 100, None), (7, "kalomita", "aa"), (7, "kalomita", "aa")]
    df = frame(spark, data + extra)
    model = train(df)
    out = identify(df, model).collect()
    assert len(out) == len(data) + len(extra)
    truth = {i: lang for i, _, lang in data}
    held = [r for r in out if r.held_out and r.doc_id in truth and r.doc_id != 7]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "bb"]
    assert by[1002].score == 0 and by[1002].rejected and all(0 <= r.score <= 1 for r in out)
    assert by[1005].rejected and not any(r.rejected for r in held)
    kept = keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == len(out) - sum(r.rejected for r in out)


def test_same_model_for_any_partitions(spark):
    df = frame(spark, rows(80))
    one, many = train(df.coalesce(1)), train(df.repartition(7))
    assert one.langs == many.langs and np.allclose(one.limit, many.limit)
    assert all(np.array_equal(x, y) for a, b in zip(one.orders, many.orders, strict=True) for c, d in zip(a, b, strict=True) for x, y in zip(c, d, strict=True))


def test_nothing_to_learn(spark):
    df = frame(spark, rows(60))
    none = frame(spark, [(1, "text", None)])
    assert [r.lang_pred for r in identify(none, train(none)).collect()] == ["und"]
    assert identify(df.limit(0), train(df)).count() == 0


def test_probabilities_sum_to_one():
    packed, _ = windows(["abab", "abba", "caab", "b"])
    keys, counts = np.unique(packed, return_counts=True)
    model = Model(["x"], [(keys, counts)])
    alphabet = [*map(ord, "abc"), 0x20]
    for ctx in ("   ", "  a", " ab", "zzz"):
        base = np.uint64(0)
        for c in ctx:
            base = (base << np.uint64(16)) | np.uint64(ord(c))
        p = 2.0 ** model.logs(0, (base << np.uint64(16)) | np.array(alphabet, dtype=np.uint64))
        rest = 1 - p.sum()  # what is left for characters never seen
        assert -1e-6 <= rest < 2 * model.uniform


def test_letters_of_the_whole_text():
    assert letters('Token = "dfd19d" Einer ab12') == ["token", "dfd", "d", "einer", "ab"]
    assert letters("a1b2") == ["a", "b"] and letters("12") == [] and letters("x" * 70) == ["x" * 32, "x" * 32, "x" * 6]


class Plain:
    """Interpolated Kneser-Ney in dictionaries, letter by letter."""

    def __init__(self, texts):
        self.counts = [Counter(), Counter(), Counter(), Counter()]
        for t in texts:
            for w in letters(t):
                line = "   " + w + " "
                self.counts[3].update(line[i : i + 4] for i in range(len(w) + 1))
        for k in (2, 1, 0):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount = []
        for c in self.counts:
            ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discount.append(min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95))

    def p(self, gram, uniform):
        if not gram:
            return uniform
        k, c = len(gram) - 1, self.counts[len(gram) - 1]
        own = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return self.p(gram[1:], uniform)
        return max(c[gram] - self.discount[k], 0) / sum(own) + self.discount[k] * len(own) / sum(own) * self.p(gram[1:], uniform)

    def entropy(self, text, uniform):
        grams = [("   " + w + " ")[i : i + 4] for w in letters(text) for i in range(len(w) + 1)]
        return -sum(math.log2(self.p(g, uniform)) for g in grams) / len(grams)


def test_choice_and_calibration_equal_a_plain_loop(spark):
    data = rows(40)
    learned = {lang: [t for i, t, x in data if x == lang and zlib.crc32(str(i).encode()) % 5] for lang in SYLLABLES}
    plain = {lang: Plain(t) for lang, t in learned.items()}
    uniform = 1 / (len({c for m in plain.values() for c in m.counts[0]}) + 1)
    cross = {(a, b): sum(-n * math.log2(plain[a].p(g, uniform)) for g, n in plain[b].counts[3].items()) / sum(plain[b].counts[3].values()) for a in plain for b in plain}
    limit, spread = {}, {}
    for a in plain:
        limit[a] = (cross[a, a] + max(min(cross[a, b] for b in plain if b != a), cross[a, a] + 1)) / 2
        total = sum(plain[a].counts[3].values())
        spread[a] = math.sqrt(sum(n * (math.log2(plain[a].p(g, uniform)) + cross[a, a]) ** 2 for g, n in plain[a].counts[3].items()) / total)
    asked = [(500, "kalo mita", None), (501, "qqqq xxxx wwww qx", None), (502, "eau schung 7tion", None), (503, "k", None), (504, "zz" * 60, None)]
    df = frame(spark, data + asked)
    seen = set()
    for r in identify(df, train(df)).collect():
        text = dict((i, t) for i, t, _ in data + asked)[r.doc_id]
        h = {a: m.entropy(text, uniform) for a, m in plain.items()}
        best = min(sorted(h), key=h.get)
        chars = sum(len(w) + 1 for w in letters(text))
        over = h[best] - limit[best] - 3 * spread[best] / math.sqrt(chars)
        assert r.lang_pred == best and abs(r.cross_entropy - h[best]) < 1e-4 and r.rejected == (over > 0)
        score = 1 / sum(2 ** (-(x - h[best]) * min(chars, 40)) for x in h.values()) / (1 + math.exp(min(4 * over, 60)))
        assert abs(r.score - score) < 1e-3
        seen.add(r.rejected)
    assert seen == {True, False}


def test_ties_go_to_the_first_name(spark):
    df = frame(spark, [(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc", None)])
    assert {r.lang_pred for r in identify(df, train(df, id_col=None)).collect()} == {"a"}


def test_unseen_languages_are_rejected(spark):
    """Texts of a language with other letters or other letter patterns than those learned."""
    df = frame(spark, rows(200))
    model = train(df)
    rng = random.Random(9)
    words = lambda syllables: " ".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(30))
    other = [(k, words(x), None) for k, x in enumerate([["жу", "ра", "ть"], ["xq", "zw", "vv"], ["日", "本", "語"], ["pfr", "zt", "gw"]] * 20)]
    assert sum(r.rejected for r in identify(frame(spark, other), model).collect()) >= 0.95 * len(other)
    assert sum(r.rejected for r in identify(frame(spark, rows(200)), model).collect()) <= 2


def test_windows_match_a_plain_loop():
    words = ["a", "été", "longer", "𝒳y"]
    want = []
    for k, w in enumerate(words):
        line = "   " + w + " "
        for i in range(len(w) + 1):
            v = 0
            for c in line[i : i + 4]:
                v = (v << 16) | min(ord(c), 0xFFFF)
            want.append((v, k))
    packed, owner = windows(words)
    assert list(zip(packed.tolist(), owner.tolist(), strict=True)) == want


def test_all_windows_are_kept(spark):
    """A script of many characters has more than 200,000 distinct windows, nearly all of them once."""
    rng = random.Random(4)
    texts = [" ".join("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30)) for _ in range(100)) for _ in range(100)]
    df = frame(spark, [(i, t, "zz") for i, t in enumerate(texts)])
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5]
    want, n = np.unique(windows([w for t in learned for w in letters(t)])[0], return_counts=True)
    model = train(df)
    assert len(want) > 200_000 and np.array_equal(model.orders[0][3][0], want)
    # nearly all occur once: the discount comes from them
    ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    contexts, kinds = np.unique(want >> np.uint64(16), return_counts=True)
    total = np.bincount(np.searchsorted(contexts, want >> np.uint64(16)), weights=n)
    assert np.allclose(2.0 ** model.orders[0][3][3], min(ones / (ones + 2 * twos), 0.95) * kinds / total, rtol=1e-5)
