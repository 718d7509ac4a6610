"""Parsers and selections that need no Python, or a kernel over whole texts or packed arrays only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill import fixed
from gistmill.functions import text as T
from gistmill.functions.arrow import map_texts
from gistmill.functions.tokens import token_estimate
from gistmill.operators.segment import sentences
from gistmill.sources.decode import Source


def csv_chunks(docs: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, chunk, n_rows, text): the header line as chunk 0, then verbatim chunks of ten non-empty lines."""
    lines = F.filter(F.split(text, "\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    rows = docs.select(by, F.posexplode(lines).alias("i", "line")).select(by, F.ceil(F.col("i") / fixed.CSV_ROWS).alias("chunk"), F.struct("i", "line").alias("x"))
    packed = rows.groupBy(by, "chunk").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select(by, "chunk", "n_rows", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias(text))


def paragraphs(docs: DataFrame, by: str = "document_id", text: str = "text") -> DataFrame:
    """(by, block_seq, text): parts between empty lines, trimmed."""
    parts = F.filter(F.transform(F.split(text, fixed.PARAGRAPH), T.trim), lambda x: x != "")
    return docs.select(by, F.posexplode(parts).alias("block_seq", text))


def sentence_spans(docs: DataFrame, by: str = "document_id", text: str = "text", in_bytes: bool = False) -> DataFrame:
    """(by, unit_seq, start, end, text): sentences with their places, in characters or in bytes of UTF-8; linear in the text."""

    def rows(whole):
        source = Source(whole.encode()) if in_bytes else None
        clean = source.clean if in_bytes else whole
        for k, (a, e) in enumerate(sentences(clean)):
            yield k, *(source.span(a, e) if in_bytes else (a, e)), clean[a:e]

    types = [("unit_seq", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]
    return map_texts(docs, by, text, rows, "unit_seq int, start long, end long, text string", types)


def _packed(units: DataFrame, by: str) -> DataFrame:
    """One row a document: its units in order, packed. Groups are single documents, so bounded."""
    return units.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("unit_seq", "text"))).alias("u"))


def entity_cover(units: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, unit_seq): units chosen greedily until every entity is held."""
    from gistmill.operators.atoms import entities, possible
    from gistmill.operators.select import cover

    @F.pandas_udf("array<int>")
    def kernel(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(cover([entities(t, kinds) for t in ts], set())) for ts in texts for kinds in [possible(list(ts))]])

    rows = _packed(units, by).select(by, F.transform("u", lambda x: x["unit_seq"]).alias("ids"), kernel(F.transform("u", lambda x: x["text"])).alias("chosen"))
    return rows.select(by, F.explode(F.transform("chosen", lambda i: F.get("ids", i))).alias("unit_seq"))


def coverage_curve(units: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, step, unit_seq, tokens, words, kept): the greedy vocabulary curve, and whether a step lies before the knee."""
    from gistmill.operators.select import Table, curve, knee

    @F.pandas_udf("array<struct<step:int,i:int,tokens:bigint,words:bigint,kept:boolean>>")
    def kernel(texts: pd.Series, costs: pd.Series) -> pd.Series:
        out = []
        for ts, cs in zip(texts, costs, strict=True):
            t = Table(list(ts), [int(c) for c in cs], [], [], np.ones(len(ts)))
            order, tokens, words = curve(t, set())
            cut = knee(tokens, words)
            out.append([{"step": k + 1, "i": i, "tokens": tokens[k + 1], "words": words[k + 1], "kept": k < cut} for k, i in enumerate(order)])
        return pd.Series(out)

    rows = _packed(units, by)
    rows = rows.select(by, F.transform("u", lambda x: x["unit_seq"]).alias("ids"), kernel(F.transform("u", lambda x: x["text"]), F.transform("u", lambda x: token_estimate(x["text"]))).alias("c"))
    return rows.select(by, "ids", F.explode("c").alias("c")).select(by, "c.step", F.get("ids", F.col("c.i")).alias("unit_seq"), "c.tokens", "c.words", "c.kept")
