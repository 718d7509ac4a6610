"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Of every 6 consecutive 5-gram hashes the
smallest is kept as a fingerprint, so any span of 10 equal words shares a fingerprint between document and item. An item
of fewer than 10 words (but not none) is one window of its own length and its whole hash is its fingerprint.

1. Fingerprints of items become a table, each with the hashes of the (up to) six 10-word windows around it, and a bit filter of
   bounded size.
2. One pass over the documents emits the fingerprints that the filter lets pass, likewise with their windows; of short
   items' lengths, and only of these, it emits runs that pass.
3. Both are joined on the fingerprint, which is all that a benchmark of any size needs: where windows at the same
   place around it agree, the window is a hit and so is each of its words.

Documents are told apart by two 64-bit hashes of their text, so equal texts are compared once, and no text is ever
shuffled or collected. Results meet the documents again in a plain join, which Spark splits where equal texts are many.

Nulls: a null text has no words; a null item text is skipped; an item without an id makes hits but cannot be listed or
counted; rows with a null doc_id are judged like others. Repeated rows give repeated results; equal texts under several item
ids are all reported. Empty tables give an empty result (no documents) or no hits (no items). Texts of any length are handled
whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import bits, flat
from gistmill.llm.session import checkpoint, map_blocks, narrow, texts_of

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1

#: A fingerprint: its hash, its length if it is a whole run of words (else 0), its place, the windows around it by offset.
MARKS = "mark long, run int, place long, around array<long>"


def winnow(words: flat.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of all minimal 5-grams of every 10-word window (ties: each minimum)."""
    grams, _ = words.grams(GRAM)
    n = len(grams) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), grams[:0]
    least = grams[:n].copy()
    for j in range(1, SPAN):
        np.minimum(least, grams[j : j + n], out=least)
    whole = words.doc[:n] == words.doc[WINDOW - 1 :]
    chosen = np.zeros(len(grams), dtype=bool)
    for j in range(SPAN):
        chosen[j : j + n] |= whole & (grams[j : j + n] == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def around(words: flat.Words, at: np.ndarray) -> pa.Array:
    """For each fingerprint's position the hashes of the windows that start 0 to 5 words before it; null where there is none."""
    grams, whole = words.grams(WINDOW)
    start = at[:, None] - np.arange(SPAN)
    ok = (start >= 0) & (start < len(grams))
    start = np.where(ok, start, 0)
    if len(grams):
        ok &= whole[start] & (words.doc[start] == words.doc[at][:, None])
        values = grams[start].view(np.int64)
    else:
        values = np.zeros(start.shape, dtype=np.int64)
    flat_values = pa.array(values.ravel(), mask=~ok.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * SPAN, pa.int32()), flat_values)


def _marks(texts: DataFrame, names: list[str], lengths: list[int] | None, wanted: np.ndarray | None = None) -> DataFrame:
    """MARKS of the text column (last) with the named columns, which are whole numbers or strings.

    ``lengths``: those of runs to be emitted; None: texts are items, and short ones are one run.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    types = pa.schema([(n, pa.string() if kinds[n] == "string" else pa.int64()) for n in names] + [("mark", pa.int64()), ("run", pa.int32()), ("place", pa.int64()), ("around", pa.list_(pa.int64()))])
    schema = ", ".join([f"{n} {'string' if kinds[n] == 'string' else 'long'}" for n in names] + [MARKS])

    def step(batch):
        words = flat.Words(texts_of(batch), flat.ALNUM)

        def out(at, marks, run):
            ok = bits.maybe(shared.value, marks)
            at, marks = at[ok], marks[ok]
            row = words.doc[at]
            near = around(words, at) if not run else pa.array([[]] * len(at), pa.list_(pa.int64()))
            return {n: batch.column(batch.schema.get_field_index(n)).take(pa.array(row)) for n in names} | {"mark": marks.view(np.int64), "run": np.full(len(at), run, dtype=np.int32), "place": at - words.first[row], "around": near}

        yield out(*winnow(words), 0)
        for n in range(1, WINDOW) if lengths is None else lengths:
            grams, whole = words.grams(n)
            if lengths is None and len(grams):
                whole = whole & (words.counts[words.doc[: len(grams)]] == n)
            p = np.flatnonzero(whole)
            yield out(p, grams[p], n)

    return map_blocks(texts.select(*names, "text"), schema, step, types)


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, start, end, item): windows, in words, of texts that an item has too."""
    theirs = checkpoint(_marks(items, ["item"], None).select("item", "mark", "run", F.col("around").alias("theirs")).distinct())
    lengths = sorted(r.run for r in theirs.where("run > 0").select("run").distinct().collect())
    wanted = bits.build(theirs.select("mark").distinct(), "mark")
    ours = _marks(docs, ["k1", "k2"], lengths, wanted).distinct()
    met = ours.join(theirs, ["mark", "run"])
    same = F.filter(F.sequence(F.lit(0), F.lit(SPAN - 1)), lambda j: F.get("around", j) == F.get("theirs", j))
    met = met.select("k1", "k2", "item", "run", F.explode(F.when(F.col("run") > 0, F.array(F.lit(0))).otherwise(same)).alias("back"), "place")
    start = F.col("place") - F.col("back")
    return met.select("k1", "k2", start.alias("start"), (start + F.when(F.col("run") > 0, F.col("run")).otherwise(WINDOW)).alias("end"), "item")


def runs(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Starts and ends, in turn, of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(starts) - 1]])
    return np.stack([starts[fresh], reach[last]], axis=1).ravel().tolist()


FOUND = "k1 long, k2 long, n_hit long, n_items long, items_sha256 string, items array<string>, hit_spans array<long>"


def _found(hits: DataFrame) -> DataFrame:
    """FOUND: what there is of each text with a hit."""
    types = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("items", pa.list_(pa.string())), ("hit_spans", pa.list_(pa.int64()))])
    spans = hits.groupBy("k1", "k2", "start").agg(F.max("end").alias("end")).groupBy("k1", "k2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    items = hits.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.collect_list("item").alias("items"))

    def run(batches):
        for batch in batches:
            names = [sorted(x) for x in batch.column(4).to_pylist()]
            spans = [runs(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            data = [batch.column(0), batch.column(1), hit, [len(x) for x in names], digests, names, spans]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(data, types, strict=True)], schema=types)

    return spans.join(items, ["k1", "k2"]).select("k1", "k2", "starts", "ends", "items").mapInArrow(run, FOUND)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans.

    ``hit_spans`` has the starts and ends of hit runs as word numbers, in turn. See the module for the edge cases.
    """
    docs = narrow(documents, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    found = checkpoint(_found(checkpoint(_hits(docs, items))))
    types = pa.schema([(n, pa.int64()) for n in ("doc_id", "k1", "k2", "n_words")])

    def count(batch):
        yield {n: batch.column(i) for i, n in enumerate(("doc_id", "k1", "k2"))} | {"n_words": flat.Words(texts_of(batch), flat.ALNUM).counts}

    counted = map_blocks(docs, "doc_id long, k1 long, k2 long, n_words long", count, types)
    none = hashlib.sha256(b"").hexdigest()
    found = found.withColumnsRenamed({"k1": "f1", "k2": "f2"})
    both = counted.join(found, (counted["k1"] == found["f1"]) & (counted["k2"] == found["f2"]), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return both.select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (hit > 0).alias("contaminated"), empty("items", "array<string>"), empty("hit_spans", "array<bigint>"))
