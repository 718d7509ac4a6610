"""Cases of reviews that earlier versions got wrong."""

from collections import Counter

import duckdb
import pandas as pd

from gistmill import queries as Q


def twin(spark, folder, name, **tables):
    """Rows of a query and of its SQL, over tables given as data frames."""
    con = duckdb.connect()
    for key, df in tables.items():
        df.to_parquet(folder / f"{key}.parquet")
        con.execute(f"CREATE VIEW {key} AS SELECT * FROM '{folder}/{key}.parquet'")
    got = Q.QUERIES[name](spark, str(folder))
    want = con.execute(Q.SQL[name])
    names = [d[0] for d in want.description]
    assert set(names) == set(got.columns)
    shown = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    return Counter(shown(tuple(r)) for r in got.select(*names).collect()), Counter(map(shown, want.fetchall()))


def test_headings_resolve_the_references_that_the_sql_reads(spark, tmp_path):
    heads = ["cut at &amp", "token = &quot;0b96a8c8d&quot;", "one &lt;two&gt; &amp;lt; three", "Tom &#38; Ann &nbsp;&eacute;&copy", "a & b && c &; d"]
    pages = pd.DataFrame({"page_id": range(len(heads)), "html": [f"<!DOCTYPE html><html><body><h1>{h}</h1><p>text body</p></body></html>" for h in heads]})
    got, want = twin(spark, tmp_path, "html_headings", pages=pages)
    assert got == want and len(got) == len(heads)


ODD = ["One two three. Two three four. One two, three four!", None, "", "Alone.", "ΟΔΟΣ οδοσ here. ΟΔΟΣ there. İstanbul is. istanbul is big.", "A b c. A b c. A b c. D e f.", "!!! ???\n\n...", "हिन्दी भाषा है. हिन्दी भाषा.", " ".join(f"Word{i % 7} of w{i % 11}." for i in range(60))]


def test_ranks_and_neighbours_of_odd_texts(spark, tmp_path):
    """Ids that stand twice or are null, texts without words, and more pairs than are held at once."""
    docs = pd.DataFrame({"doc_id": pd.array([*range(len(ODD)), 0, 8, None, None], dtype="Int64"), "text": [*ODD, "One two three. Five six.", "Word1 of w2. Word1 of w3.", "No id here. No id there.", "No id here."]})
    for name in ("similarity_topk", "pagerank_units"):
        got, want = twin(spark, tmp_path, name, documents=docs)
        assert got == want and got


def test_bounds_of_the_ranking_kernel_change_nothing(spark, monkeypatch):
    import pyarrow as pa

    from gistmill.operators import rank

    units = [[{"unit": i, "text": f"w{i % 3} w{i % 5} w{i * d % 4}"} for i in range(2 + 7 * d)] for d in range(9)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(units, pa.list_(pa.struct([("unit", pa.int64()), ("text", pa.string())])))], names=["id", "units"]).slice(1)

    def edges():
        return [(int(first + doc[a]), int(number[a]), int(number[b]), round(float(w), 9)) for first, doc, number, _, _, e in rank._graphs(batch, 3, 0.05) for a, b, w in zip(*e)]

    whole = edges()
    assert len(whole) > 500
    assert {w.dtype.kind for n in range(9) for *_, (_, _, w) in rank._graphs(batch.slice(n, 1), 3, 2.0)} == {"f"}
    for most in (40, 900):
        monkeypatch.setattr(rank, "MOST_PAIRS", most)
        monkeypatch.setattr(rank, "MOST_ALONE", most)
        assert edges() == whole
    monkeypatch.setattr(rank, "MOST_CHARS", 100)
    assert edges() == whole


def test_texts_are_dealt_out_once(spark, tmp_path):
    """Terms and edges stay in the worker: one exchange, of the texts."""
    pd.DataFrame({"doc_id": [1], "text": ["One two. One three."]}).to_parquet(tmp_path / "documents.parquet")
    for name in ("similarity_topk", "pagerank_units"):
        plan = Q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, plan


def test_packed_units_and_packed_sentences_rank_alike(spark):
    from gistmill.operators import rank

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    near = lambda rows: Counter(map(str, rank.neighbours(rows).collect()))
    lists = Q.sentence_lists(docs, "doc_id")
    assert near(lists) == near(rank.packed(Q.sentence_units(docs, "doc_id")))
    edges = lists.sparkSession.createDataFrame([(r.document_id, r.src, d, w) for r in rank.neighbours(lists).collect() for d, w in r.near], "document_id long, src long, dst long, weight double")
    parts = Q.sentence_units(docs, "doc_id")
    want = {(r.document_id, r.unit_seq): round(r.score, 6) for r in rank.pagerank(parts, edges).collect()}
    assert {(r.document_id, r.unit_seq): round(r.score, 6) for r in rank.unit_ranks(lists).collect()} == want


def test_short_texts_are_judged_once_and_results_are_the_callers_own(monkeypatch):
    from gistmill.operators import atoms, segment

    calls, real = [], atoms.places
    monkeypatch.setattr(atoms, "places", lambda *a: calls.append(a) or real(*a))
    line = "A line of its own, judged once: CVE-2024-77123."
    assert [atoms.entities(line) for _ in range(3)] == [frozenset({"CVE-2024-77123"})] * 3
    assert len(calls) == len(atoms.ENTITY)
    segment.sentences(line).clear()
    assert len(segment.sentences(line)) == 1


def test_ranks_by_matrix_equal_those_by_edges(monkeypatch):
    import numpy as np

    from gistmill.operators import rank

    rng = np.random.default_rng(5)
    for n in range(2, rank.MOST_DENSE + 1):
        src, dst = np.nonzero(rng.random((n, n)) < 0.2)
        weight = rng.random(len(src))
        small = rank.ranks(n, src, dst, weight)
        monkeypatch.setattr(rank, "MOST_DENSE", 0)
        assert np.allclose(small, rank.ranks(n, src, dst, weight), atol=1e-6)
        monkeypatch.undo()


def test_spans_of_plain_texts_need_no_table_of_offsets():
    from gistmill.sources.decode import Source

    plain, other = Source(b"\xef\xbb\xbfab\x1b[0mcd", "utf-8", 3), Source("aé b".encode())
    assert plain.span(1, 3) == (4, 10) and "_bytes_at" not in vars(plain)
    assert other.span(1, 3) == (1, 4)
