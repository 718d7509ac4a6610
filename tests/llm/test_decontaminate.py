import hashlib
import random
import re

from gistmill.llm import bits
from gistmill.llm.decontaminate import decontaminate


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            if not v:
                continue
            n = min(10, len(v))
            for j in range(len(v) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        found.update([] if item is None else [str(item)])
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocab = ["the", "Cat", "sat", "o'n", "été", "12", "mat", "x_y", "ÉCOLE", "ß"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(0, 24))) for i in range(12)] + [(100, text(30)), (101, None), (102, "zebra"), (102, "zebra quokka"), (None, text(12)), (103, "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(25)]
    for i, (_, t) in enumerate(items):
        if t:
            docs.append((200 + i, text(5) + " - " + t.upper() + "\n" + text(5)))
    docs += [(300, None), (301, ""), (302, "a zebra, ran"), (302, "a zebra, ran"), (None, "zebra quokka"), (303, "the " * 400), (304, items[12][1] + " " + items[12][1])]
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS mark", "3 AS n_hit", "'x' AS k1")
    got = decontaminate(d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS item"))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_without_a_filter(spark, monkeypatch):
    """More fingerprints than a filter holds: all of the documents' go to the join."""
    monkeypatch.setattr(bits, "MOST_BYTES", 8)
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_spans_and_items(spark):
    v = [f"v{i}" for i in range(30)]
    docs = [(1, " ".join(["x", *v[:12], "y", *v[15:25], *v[20:30]])), (2, "x")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(v)), (10, " ".join(v[:11])), (None, " ".join(v[20:30]))], "item_id long, text string"))
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].hit_spans == [1, 13, 14, 34] and by[1].items == ["10", "9"] and by[1].n_hit == 32
    assert by[2].hit_spans == [] and by[2].items == [] and not by[2].contaminated


def test_long_texts_and_many_copies(spark):
    """One passage repeated all over a very long text and in many equal texts; a long item that repeats itself."""
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(1, (passage + " ") * 3000), (2, "w " * 100_000)] + [(10 + i, passage) for i in range(300)]
    items = [(5, (passage + " ") * 200), (6, "q " * 50)]
    got = {r[0]: r[1:] for r in run(spark, docs, items)}
    digest = hashlib.sha256(b"5").hexdigest()
    assert got[1] == (42_000, 42_000, 1, digest, True) and got[2][:3] == (100_000, 0, 0)
    assert all(got[10 + i] == (14, 14, 1, digest, True) for i in range(300))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate(d, none).collect()] == [(3, 0)]
    assert decontaminate(d.limit(0), none).count() == 0
