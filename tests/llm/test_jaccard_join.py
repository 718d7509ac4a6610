import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from gistmill.llm import jaccard_join as J
from gistmill.llm.session import RELEASE, released


def sets_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lowered)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [sets_of(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[find(i)])) for i, (d, _) in enumerate(docs))


def corpus(seed, n_base=12, copies=10):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["Été", "L'eau"]
    docs = []
    for _ in range(n_base):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 8, 11, 20, 40, 90, 300]))]
        docs.append(" ".join(base))
        walk = list(base)
        for _ in range(copies):
            own = list(walk if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                p = rng.randrange(len(own) + 1)
                own[p : p + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 1)
            walk = own or walk
            docs.append(rng.choice([" ", "\n"]).join(own).upper() if rng.random() < 0.2 else " ".join(own))
    docs += ["", "  \n", "same", "SAME"]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS node", "0 AS component_id", "1 AS label")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())


def test_equals_brute_force(spark):
    docs = corpus(1) + [(9000, None), (3, "the repeated row"), (3, "the repeated row")]
    assert run(spark, docs) == brute(docs)


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL_GROUP", 2)
    monkeypatch.setattr(J, "KERNEL_GROUP", 4)
    docs = corpus(2, 8, 12)
    assert run(spark, docs) == brute(docs)


def test_shingles_of_many_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "COMMON", 4)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(rng.choice([0, 2, 3, 5, 9, 30, 200])))) for i in range(120)]
    assert len(J.common_shingles(spark.createDataFrame(docs, "doc_id long, text string"), 4)) >= 57
    assert run(spark, docs) == brute(docs)


def test_chain_through_members_of_a_star(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(200)]
    docs = []
    for i in range(30):  # neighbours link, far ones do not
        docs.append((rng.randrange(10**9), " ".join(base)))
        for _ in range(2):
            base[rng.randrange(200)] = f"n{i}{rng.random()}"
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("share", [0, 3, 40, 90, 100])
def test_keys_keep_every_linked_pair(share):
    """Whatever shingles count as common."""
    docs = corpus(7, 10, 6)
    sets = J.Sets(pa.array([t for _, t in docs]), 4)
    every = np.unique(sets.values)
    row, key, group, need = J.segment_keys(sets, 85, every[np.random.default_rng(1).random(len(every)) * 100 < share])
    # a set's keys count only where a group of them has as many shared ones as any partner would share
    several = {k for k in set(key.tolist()) if len(set(sets.node[row[key == np.uint64(k)]].tolist())) > 1}
    ok = np.array([k in several for k in key.tolist()])
    enough = np.bincount(group[ok], minlength=len(need)) >= need
    by = {}
    for r, k in zip(row[ok & enough[group]].tolist(), key[ok & enough[group]].tolist(), strict=True):
        by.setdefault(r, set()).add(k)
    for i in range(len(docs)):
        for j in range(i):
            a, b = (set(sets.values[sets.first[x] : sets.first[x + 1]].tolist()) for x in (i, j))
            if a and a != b and 100 * len(a & b) >= 85 * len(a | b):
                assert by[i] & by[j]
    assert len(np.unique(sets.node)) > 10


@pytest.mark.parametrize("values", [1 << 19, 300])
def test_links_are_counted(spark, monkeypatch, values):
    """All links, those inside a component and those of copies too, in one block and in many."""
    monkeypatch.setattr(J, "BLOCK_VALUES", values)
    docs = corpus(3, 8, 10) + [(9000, None), (9001, "the repeated row"), (9001, "the repeated row")]
    sets = [sets_of(t) for _, t in docs]
    want = sorted((d, sum(i != j and bool(x) and 100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets))) for i, ((d, _), x) in enumerate(zip(docs, sets, strict=True)))
    got = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == want and max(n for _, n in want) > 4
    assert J.jaccard_components(spark.createDataFrame(docs[:5], "doc_id long, text string"), count_links=False).columns == ["doc_id", "n_shingles", "component_id"]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_steps_leave_no_shuffle_files(spark):
    """On a table of many partitions the files of finished steps took more disk than the rows in them."""
    docs = corpus(5, n_base=4)
    before = shuffle_files(spark)
    out = J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    for _ in range(2):  # what is handed out may be computed again
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(docs)


def test_release_is_put_back(spark):
    for value in (None, "false"):
        spark.conf.unset(RELEASE) if value is None else spark.conf.set(RELEASE, value)
        before = spark.conf.get(RELEASE, None)
        with pytest.raises(ValueError), released(spark):
            assert spark.conf.get(RELEASE) == "true"
            raise ValueError
        assert spark.conf.get(RELEASE, None) == before
    spark.conf.unset(RELEASE)
