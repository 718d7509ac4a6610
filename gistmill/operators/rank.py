"""Ranking of units: TF-IDF, a top-k cosine graph, and PageRank.

``tfidf``, ``similar`` and ``pagerank`` are the relational forms (aggregates, and kernels over one packed row a document);
``neighbours`` and ``unit_ranks`` do them in one go, so that a document's terms meet in no shuffle; ``scores`` is the same for
the units of one document in memory, which the row-wise plan uses.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistmill import fixed
from gistmill.functions.arrow import bounded

TOKEN = re.compile(fixed.TOKEN)


#: Pairs of units, and products of weights, that are held at once: of documents together, and of one alone.
MOST_PAIRS, MOST_ALONE = 1 << 19, 1 << 21
#: Units of a document whose ranks are computed with a dense matrix.
MOST_DENSE = 32
#: Bytes of text of documents that are ranked together (a longer one goes alone).
MOST_CHARS = 1 << 20


class _Numbers(dict):
    """Numbers of keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _vectors(texts: list[str], row: np.ndarray, doc: np.ndarray, size: np.ndarray):
    """Row, term and weight of the length-one TF-IDF vectors, sorted by term, of units of many documents.

    Terms are words and pairs of neighbouring words, of one document each. ``row`` has the unit of each text, whose words are
    counted together; ``doc`` the document of each unit; ``size`` the number of texts of each document.
    """
    numbers, words = _Numbers(), [TOKEN.findall(t) for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
    if not len(word):
        return word, word, np.zeros(0)
    n, unit = len(numbers), np.repeat(row, count)
    last = np.zeros(len(word), dtype=bool)
    last[np.cumsum(count)[count > 0] - 1] = True
    first = np.flatnonzero(~last)
    term = np.concatenate([word, n + word[first] * n + word[first + 1]])
    unit = np.concatenate([unit, unit[first]])
    # a document's terms get a range of numbers of their own; what is distinct stays far below 2^63, as texts are bounded
    col = np.unique(doc[unit] * (n + n * n) + term, return_inverse=True)[1]
    key, tf = np.unique(col * len(doc) + unit, return_counts=True)
    col, unit = np.divmod(key, len(doc))
    df = np.bincount(col)
    w = (1 + np.log(tf)) * (np.log((1 + size[doc[unit]]) / (1 + df[col])) + 1)
    w /= np.sqrt(np.bincount(unit, weights=w * w, minlength=len(doc)))[unit]
    return unit, col, w


def graph(texts: list[str], k: int = fixed.NEIGHBOURS, least: float = fixed.MIN_SIMILARITY):
    """Directed edges (src, dst, weight) to each unit's k most similar units above the threshold; ties go to lower dst."""
    n = len(texts)
    vectors = _vectors([t.lower() for t in texts], np.arange(n), np.zeros(n, dtype=np.int64), np.array([n]))
    return nearest(*vectors, n, k, least)


def nearest(row: np.ndarray, col: np.ndarray, w: np.ndarray, n: int, k: int, least: float):
    """The same from the vectors' entries: unit, term number and weight, sorted by term."""
    size = np.bincount(col)
    if max(n * n, int((size * (size - 1)).sum()) // 2) <= MOST_ALONE:
        return _together(row, col, w, np.zeros(n, dtype=np.int64), np.array([n]), k, least)
    # rows of one term form a group; a unit sums products over its terms' groups
    starts = np.searchsorted(col, np.arange(col[-1] + 2)) if len(col) else np.zeros(1, dtype=np.int64)
    by_unit = np.argsort(row, kind="stable")
    unit_starts = np.searchsorted(row[by_unit], np.arange(n + 1))
    sizes = starts[col[by_unit] + 1] - starts[col[by_unit]] if len(col) else col
    products = np.concatenate([[0], np.cumsum(sizes)])[unit_starts]
    found, i = [], 0
    while i < n:
        # a run of units whose sums, n each, and products stay within the bound
        j = i + max(1, int(np.searchsorted(products[i + 1 :] - products[i] + n * np.arange(1, n - i + 1), MOST_ALONE, "right")))
        own, size = by_unit[unit_starts[i] : unit_starts[j]], sizes[unit_starts[i] : unit_starts[j]]
        at = np.repeat(starts[col[own]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        sim = np.bincount(np.repeat((row[own] - i) * n, size) + row[at], weights=w[at] * np.repeat(w[own], size), minlength=(j - i) * n)
        sim[np.arange(j - i) * n + np.arange(i, j)] = 0
        best = np.flatnonzero(sim > least)
        sim, (src, dst) = sim[best].astype(float), np.divmod(best, n)
        order = np.lexsort((dst, -np.round(sim, 12), src))
        src, dst, sim = src[order], dst[order], sim[order]
        best = np.arange(len(src)) - np.searchsorted(src, src) < k
        found.append((src[best] + i, dst[best], sim[best]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))


def _together(row: np.ndarray, col: np.ndarray, w: np.ndarray, doc: np.ndarray, units: np.ndarray, k: int, least: float):
    """``nearest`` for many documents at once, whose units stand side by side: all products, summed by pair of units."""
    first = np.cumsum(units) - units
    base = np.cumsum(units * units) - units * units
    # entry by entry, the later ones of the same term
    ends = np.cumsum(np.bincount(col))[col] if len(col) else col
    later = ends - np.arange(len(col)) - 1
    one = np.repeat(np.arange(len(col)), later)
    two = np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later) + one + 1
    a, b = row[one], row[two]
    d = doc[a]
    sim = np.bincount(base[d] + (a - first[d]) * units[d] + b - first[d], weights=w[one] * w[two], minlength=int((units * units).sum()))
    at = np.flatnonzero(sim > least)
    sim = sim[at].astype(float)  # sums of nothing are whole numbers
    d = np.searchsorted(base + units * units, at, "right")
    a, b = np.divmod(at - base[d], units[d])
    a, b = a + first[d], b + first[d]
    src, dst, sim = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([sim, sim])
    order = np.lexsort((dst, -np.round(sim, 12), src))
    src, dst, sim = src[order], dst[order], sim[order]
    best = np.arange(len(src)) - np.searchsorted(src, src) < k
    return src[best], dst[best], sim[best]


def ranks(n: int, src, dst, weight, damping: float = fixed.DAMPING) -> np.ndarray:
    """PageRank of n nodes scaled to 0..1; all 1 if all are equal."""
    if n < 2 or not len(src):
        return np.ones(n)
    if n <= MOST_DENSE:
        return _dense_ranks(n, np.asarray(src), np.asarray(dst), np.asarray(weight), damping)
    out = np.bincount(src, weights=weight, minlength=n) if len(src) else np.zeros(n)
    share = weight / out[src] if len(src) else weight
    sinks = out <= 0
    p = np.full(n, 1 / n)
    for _ in range(fixed.MAX_ROUNDS):
        flow = np.bincount(dst, weights=share * p[src], minlength=n) if len(src) else np.zeros(n)
        nxt = damping * flow + (damping * p[sinks].sum() + 1 - damping) / n
        moved = np.abs(nxt - p).sum()
        p = nxt
        if moved < fixed.TOLERANCE:
            break
    p = np.round(p, 8)
    low, high = p.min(), p.max()
    return (p - low) / (high - low) if high > low else np.ones(n)


def _dense_ranks(n: int, src, dst, weight, damping: float) -> np.ndarray:
    """``ranks`` by products with a small matrix, which takes fewer calls a round."""
    flow = np.bincount(src * n + dst, weights=weight, minlength=n * n).reshape(n, n)
    out = flow.sum(axis=1)
    sinks = out <= 0
    flow *= (damping / np.where(sinks, 1, out))[:, None]
    flow[sinks] = damping / n
    p, rest = np.full(n, 1 / n), (1 - damping) / n
    for _ in range(fixed.MAX_ROUNDS):
        nxt = p @ flow
        nxt += rest
        p -= nxt
        moved, p = np.abs(p, out=p).sum(), nxt
        if moved < fixed.TOLERANCE:
            break
    p = np.round(p, 8)
    low, high = p.min(), p.max()
    return (p - low) / (high - low) if high > low else np.ones(n)


def _ranks_together(doc: np.ndarray, times: np.ndarray, size: np.ndarray, src, dst, weight, damping: float) -> np.ndarray:
    """``ranks`` for many documents at once, each until it stands still; a unit counts as often as ``times`` says."""
    total = lambda x: np.bincount(doc, weights=x, minlength=len(size))
    out = np.bincount(src, weights=weight, minlength=len(doc))
    share = weight / out[src] * times[src]
    sinks = np.where(out > 0, 0, times)
    p, moving = 1 / size[doc], size > 1
    for _ in range(fixed.MAX_ROUNDS):
        if not moving.any():
            break
        flow = np.bincount(dst, weights=share * p[src], minlength=len(doc))
        nxt = damping * flow + ((damping * total(p * sinks) + 1 - damping) / size)[doc]
        change = np.where(moving[doc], nxt - p, 0)
        p = np.where(moving[doc], nxt, p)
        still = moving & (total(np.abs(change) * times) < fixed.TOLERANCE)
        if still.any():
            moving &= ~still
            on = moving[doc[src]]
            src, dst, share = src[on], dst[on], share[on]
    p = np.round(p, 8)
    low, high = np.full(len(size), np.inf), np.full(len(size), -np.inf)
    np.minimum.at(low, doc, p)
    np.maximum.at(high, doc, p)
    wide = (high > low)[doc]
    return np.where(wide, (p - low[doc]) / np.where(wide, (high - low)[doc], 1), 1.0)


def scores(texts: list[str], k: int = fixed.NEIGHBOURS, damping: float = fixed.DAMPING) -> np.ndarray:
    if len(texts) < 2:
        return np.ones(len(texts))
    src, dst, weight = graph(texts, k)
    return ranks(len(texts), src.astype(np.int64), dst.astype(np.int64), weight, damping)


# ---- relational forms ------------------------------------------------------------------------------------------------
#: The token pattern with Java's Unicode classes.
JAVA_TOKEN = "(?U)" + fixed.TOKEN


def tfidf(units: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, unit_seq, term, weight): length-one TF-IDF vectors, with document frequencies among the units of one document.

    Two shuffles: terms are counted within a row by array functions, so only (unit, term) rows meet for the frequency, and the
    unit count joins them by document.
    """
    words = units.select(by, "unit_seq", F.expr(f"regexp_extract_all(lower({text}), r'{JAVA_TOKEN}', 0)").alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    each = words.select(by, "unit_seq", F.explode(F.concat("w", pairs)).alias("term"))
    counts = each.groupBy(by, "unit_seq", "term").agg(F.count("*").alias("tf"))
    n = units.groupBy(by).agg(F.count("*").alias("n")).withColumnRenamed(by, "_doc")
    df = counts.withColumn("df", F.count("*").over(Window.partitionBy(by, "term")))
    weighed = df.join(n, df[by] == n["_doc"]).select(by, "unit_seq", "term", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(by, "unit_seq")))
    return weighed.select(by, "unit_seq", "term", (F.col("raw") / norm).alias("weight"))


def similar(vectors: DataFrame, by: str = "document_id", k: int = fixed.NEIGHBOURS, least: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """(by, src, dst, weight): the k most similar units of the same document above the threshold; ties go to lower dst.

    One row a document with its vectors packed (terms as 64-bit hashes), so a term that very many units share meets in no join:
    the kernel holds the sums of one unit at a time. Documents are at most ten megabytes, which bounds the row.
    """
    entry = F.struct(F.xxhash64("term").alias("term"), F.col("unit_seq").cast("long").alias("unit"), F.col("weight").alias("weight"))
    rows = vectors.groupBy(by).agg(F.collect_list(entry).alias("e"))
    names, id_type = [by, "src", "dst", "weight"], vectors.schema[by].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for d in range(batch.num_rows):
                e = batch.column(1)[d].values
                term, unit, weight = (e.field(c).to_numpy() for c in range(3))
                ids, row = np.unique(unit, return_inverse=True)
                terms_, col = np.unique(term, return_inverse=True)
                order = np.lexsort((row, col))
                src, dst, sim = nearest(row[order], col[order], weight[order], len(ids), k, least + 5e-13)
                columns = [ids[src.astype(np.int64)], ids[dst.astype(np.int64)], np.round(sim, 12)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d] * len(src), pa.int32())), *map(pa.array, columns)], names=names)

    unit_type = vectors.schema["unit_seq"].dataType
    out = bounded(rows).mapInArrow(run, f"`{by}` {id_type}, src long, dst long, weight double")
    return out.withColumns({c: F.col(c).cast(unit_type) for c in ("src", "dst")})


def pagerank(units: DataFrame, edges: DataFrame, by: str = "document_id", damping: float = fixed.DAMPING) -> DataFrame:
    """(by, unit_seq, score) for every unit, isolated ones too; one kernel call a document, with its edges packed in one row."""
    nodes = units.groupBy(by).agg(F.sort_array(F.collect_list("unit_seq")).alias("nodes"))
    links = edges.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "weight"))).alias("links")).withColumnRenamed(by, "_doc")
    rows = nodes.join(links, nodes[by] == links["_doc"], "left").select(by, "nodes", "links")

    @F.pandas_udf("array<double>")
    def kernel(nodes, links):
        import pandas as pd

        def one(ids, es):
            place = {v: i for i, v in enumerate(ids)}
            es = es if es is not None else []
            src, dst = (np.array([place[e[c]] for e in es], dtype=np.int64) for c in ("src", "dst"))
            return ranks(len(ids), src, dst, np.array([e["weight"] for e in es], dtype=float), damping).tolist()

        return pd.Series([one(a, b) for a, b in zip(nodes, links)])

    out = rows.select(by, F.explode(F.arrays_zip("nodes", kernel("nodes", "links").alias("s"))).alias("z"))
    return out.select(by, F.col("z.nodes").alias("unit_seq"), F.col("z.s").alias("score"))


def packed(units: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, units): one row a document with an array of (unit, text); no shuffle if rows are dealt out by document already."""
    entry = F.struct(F.col("unit_seq").cast("long").alias("unit"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return units.groupBy(by).agg(F.collect_list(entry).alias("units"))


def _graphs(batch: pa.RecordBatch, k: int, least: float):
    """Of runs of a batch's rows: (first row, each unit's row from there, unit numbers, how often each stands there, texts by row, edges).

    Edges (src, dst, weight) are by place among the run's units, in order of src, with weights of twelve digits.
    """
    packed = batch.column(1)
    size, ends = np.diff(packed.offsets.to_numpy()), np.cumsum(np.diff(packed.offsets.to_numpy()))
    values = packed.flatten()
    length = np.concatenate([[0], np.cumsum(pc.binary_length(values.field(1)).to_numpy(zero_copy_only=False))])
    start = 0
    while start < batch.num_rows:
        # as many rows as stay within the bounds, one at least
        low = ends[start] - size[start]
        chars, pairs = length[ends[start:]] - length[low], np.cumsum(size[start:].astype(float) ** 2)
        stop = start + max(1, int(np.count_nonzero((chars <= MOST_CHARS) & (pairs <= MOST_PAIRS))))
        part = values.slice(low, ends[stop - 1] - low)
        own, n = size[start:stop], stop - start
        # DuckDB and Spark lower-case these two by themselves, Python by what stands beside them
        texts = [(x if x.isascii() else x.replace("\u0130", "i").replace("\u03a3", "\u03c3")).lower() for x in part.field(1).to_pylist()]
        number, of = part.field(0).to_numpy(), np.repeat(np.arange(n), own)
        order = np.lexsort((number, of))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(of[order]) != 0) | (np.diff(number[order]) != 0)
        row = np.empty(len(order), dtype=np.int64)
        row[order] = np.cumsum(fresh) - 1
        doc, number, times = of[order][fresh], number[order][fresh], np.bincount(row, minlength=int(fresh.sum()))
        edges = _edges(*_vectors(texts, row, doc, own), doc, n, k, least + 5e-13)
        if len(doc):
            yield start, doc, number, times, own, (edges[0], edges[1], np.round(edges[2], 12))
        start = stop


def _edges(row, col, w, doc, n, k, least):
    """The edges of n documents, those together whose products are few enough."""
    units = np.bincount(doc, minlength=n)
    group = np.bincount(col)
    of_group = np.zeros(len(group), dtype=np.int64)
    of_group[col] = doc[row]
    products = np.bincount(of_group, weights=group * (group - 1.0) / 2, minlength=n)
    at, rows, found = np.searchsorted(of_group, np.arange(n + 1)), np.cumsum(units) - units, []
    first_entry = np.concatenate([np.cumsum(group) - group, [len(col)]])
    i = 0
    while i < n:
        j = i + max(1, int(np.count_nonzero(np.cumsum(products[i:]) <= MOST_PAIRS)))
        own, base, total = slice(first_entry[at[i]], first_entry[at[j]]), rows[i], int(units[i:j].sum())
        entries = row[own] - base, col[own] - at[i], w[own]
        if j == i + 1:
            edges = nearest(*entries, total, k, least)
        else:
            edges = _together(*entries, doc[base : base + total] - i, units[i:j], k, least)
        found.append((edges[0].astype(np.int64) + base, edges[1].astype(np.int64) + base, edges[2]))
        i = j
    return tuple(np.concatenate(x) for x in zip(*found))


def neighbours(rows: DataFrame, by: str = "document_id", k: int = fixed.NEIGHBOURS, least: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """(by, src, near): what ``similar`` of ``tfidf`` says, one row a unit that has neighbours, ``near`` an array of (dst, weight), nearest first.

    ``rows`` is ``packed``. Vectors and sums never leave the worker: only the units' texts are dealt out, once.
    """
    rows, id_type = rows.where(F.col(by).isNotNull()), rows.schema[by].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start, doc, number, _, _, (src, dst, weight) in _graphs(batch, k, least):
                has, first = np.unique(src, return_index=True)
                near = pa.StructArray.from_arrays([pa.array(number[dst]), pa.array(weight)], names=["dst", "weight"])
                near = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(src)]]), pa.int32()), near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + doc[has])), pa.array(number[has]), near], names=[by, "src", "near"])

    return bounded(rows).mapInArrow(run, f"`{by}` {id_type}, src long, near array<struct<dst: bigint, weight: double>>")


def unit_ranks(rows: DataFrame, by: str = "document_id", damping: float = fixed.DAMPING, k: int = fixed.NEIGHBOURS, least: float = fixed.MIN_SIMILARITY) -> DataFrame:
    """(by, unit_seq, score): ``pagerank`` over the graph of ``neighbours``, in the same worker; one row for each unit of ``packed`` rows."""
    id_type = rows.schema[by].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start, doc, number, times, size, edges in _graphs(batch, k, least):
                if batch.column(0).null_count:  # rows without an id have nothing in common
                    known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[start + doc[edges[0]]]
                    edges = tuple(x[known] for x in edges)
                score = _ranks_together(doc, times, np.maximum(size, 1), *edges, damping)
                again = np.repeat(np.arange(len(doc)), times)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + doc[again])), pa.array(number[again]), pa.array(score[again])], names=[by, "unit_seq", "score"])

    return bounded(rows).mapInArrow(run, f"`{by}` {id_type}, unit_seq long, score double")
