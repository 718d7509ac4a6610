"""Line deduplication within one word edit, by a deletion-neighbourhood join.

Lines are cut at ``\\n``; a line is its sequence of words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z lower-cased). A line goes if
an earlier line (by doc_id, then line number) has the same words, or, among lines of ``min_words`` words or more, the same
words but for one inserted, deleted or replaced word. So of every such line the earliest stays. ``own_words`` is the least
number of words from which exact copies go (``min_words`` where it is not given; the queries and the pipeline give 1: every
line with a word). Lines without a word are never touched.

1. Exact copies: distinct lines by a 128-bit hash, each with its first document.
2. Pre-filter without loss: two lines one edit apart agree in a prefix or a suffix of about half their words, so each
   line shows three half keys and only lines that share one go on.
3. Deletion neighbourhood: a surviving line emits the hash of itself and of itself without each of its words. Equal hashes
   with the same place deleted are lines that differ by a replaced word; a whole line that equals another's variant
   differs by an inserted word. In a group of equal variants all are compared with the earliest only (whoever shares the
   place is one edit from it), so no pairs are formed inside a group.
4. Every found pair is verified on the words themselves before the later line goes.

A document loses its lines in a last pass. ``emptied`` marks one that lost lines and has no line of ``own_words`` left.

Nulls: a null text stays null and has no lines. Rows without a doc_id come last, in the order of a hash of their text, each
text a document of its own. Rows with one doc_id count as one document, as do equal texts without one: equal lines of theirs do
not make each other go, and what goes from one goes from all. Ids from 2**62 on may fall among the rows without one. Ties cannot
arise otherwise. Empty and very long
texts, empty tables and extra columns need no special care; text that loses nothing is returned unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import bits, flat
from gistmill.llm.session import bounded, blocks, checkpoint, map_blocks, texts_of

MIN_WORDS = 5
#: Rows without an id take their places from here on.
LAST = 1 << 62
Q1, Q2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
P1, I1 = flat._Powers(Q1), flat._Powers(pow(Q1, -1, 1 << 64))
P2, I2 = flat._Powers(Q2), flat._Powers(pow(Q2, -1, 1 << 64))
BACK1 = flat.U(pow(Q1, -1, 1 << 64))


class Lines:
    """Lines of a block of texts: byte span, words ``a`` to ``b``, row ``doc``, number in the text, two hashes."""

    def __init__(self, texts: pa.Array):
        words = self.words = flat.Words(texts, flat.SPACES)
        off = words.off
        breaks = np.flatnonzero(words.buf == 0x0A)
        # a text's first line starts with it; a break's next line belongs to the text that holds the break
        starts = np.concatenate([off[:-1], breaks + 1])
        owner = np.concatenate([np.arange(len(texts)), np.searchsorted(off, breaks, side="right") - 1])
        order = np.lexsort((starts, owner))
        self.start, self.doc = starts[order], owner[order]
        end = np.empty_like(self.start)
        last = np.concatenate([self.doc[1:] != self.doc[:-1], [True]]) if len(self.doc) else np.zeros(0, dtype=bool)
        end[:-1] = self.start[1:] - 1
        end[last] = off[1:][self.doc[last]]
        self.end = end
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        self.a, self.b = np.searchsorted(words.start, self.start), np.searchsorted(words.start, self.end)
        self.n = self.b - self.a
        self.sums1 = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words.hash * P1.upto(len(words.hash)))])
        self.h1 = self.span(self.a, self.b)
        other = flat.mix(words.hash ^ flat.U(Q2))
        sums2 = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(other * P2.upto(len(other)))])
        self.h2 = flat.mix((sums2[self.b] - sums2[self.a]) * I2.upto(len(sums2))[self.a])

    def span(self, a, b) -> np.ndarray:
        """Hash of the words from a to b."""
        return flat.mix((self.sums1[b] - self.sums1[a]) * I1.upto(len(self.sums1))[a] + (b - a).astype(np.uint64))

    def without(self, a, b, p) -> np.ndarray:
        """Hash of the words from a to b but word p; equals ``span`` of such a line."""
        rest = (self.sums1[p] - self.sums1[a]) + (self.sums1[b] - self.sums1[p + 1]) * BACK1
        return flat.mix(rest * I1.upto(len(self.sums1))[a] + (b - a - 1).astype(np.uint64))

    def repeated(self, eligible: np.ndarray) -> np.ndarray:
        """Eligible lines equal to an earlier one of their text."""
        out = np.zeros(len(self.doc), dtype=bool)
        at = np.flatnonzero(eligible)
        order = at[np.lexsort((self.number[at], self.h2[at], self.h1[at], self.doc[at]))]
        same = (self.doc[order[1:]] == self.doc[order[:-1]]) & (self.h1[order[1:]] == self.h1[order[:-1]]) & (self.h2[order[1:]] == self.h2[order[:-1]])
        out[order[1:][same]] = True
        return out

    def halves(self, at: np.ndarray) -> list[np.ndarray]:
        """Three half keys of each line: for n even prefixes of n/2 and n/2 - 1 and a suffix of n/2, else one prefix and two suffixes."""
        a, b, n = self.a[at], self.b[at], self.n[at]
        even = n % 2 == 0
        low, high = n // 2, (n + 1) // 2
        prefix = flat.mix(self.span(a, a + low) ^ flat.U(0x50))
        suffix = flat.mix(self.span(b - high, b) ^ flat.U(0x53))
        third = np.where(even, flat.mix(self.span(a, a + np.maximum(low - 1, 0)) ^ flat.U(0x50)), flat.mix(self.span(b - np.maximum(high - 1, 0), b) ^ flat.U(0x53)))
        return [prefix, suffix, third]


def _first_lines(docs: DataFrame, min_words: int, own_words: int) -> DataFrame:
    """Distinct lines: h1, h2, doc and line of the first, last document with it, half keys (null below ``min_words``)."""
    names = ["h1", "h2", "doc", "line", "k1", "k2", "k3"]
    types = pa.schema([(n, pa.int64()) for n in names])

    def step(batch):
        lines = Lines(texts_of(batch))
        eligible = lines.n >= own_words
        at = np.flatnonzero(eligible & ~lines.repeated(eligible))
        short = lines.n[at] < min_words
        ids = batch.column(0).to_numpy()[lines.doc[at]]
        yield {"h1": lines.h1[at].view(np.int64), "h2": lines.h2[at].view(np.int64), "doc": ids, "line": lines.number[at]} | {f"k{i + 1}": pa.array(k.view(np.int64), mask=short) for i, k in enumerate(lines.halves(at))}

    rows = map_blocks(docs, ", ".join(f"{n} long" for n in names), step, types)
    return rows.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.min_by("line", "doc").alias("line"), F.max("doc").alias("last"), *[F.min(k).alias(k) for k in ("k1", "k2", "k3")])


def _copies(docs: DataFrame, repeated: DataFrame, own_words: int) -> DataFrame:
    """(doc, h1) of lines whose first copy is in an earlier document."""
    wanted = docs.sparkSession.sparkContext.broadcast(bits.build(repeated, "h1"))
    types = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "doc")])

    def step(batch):
        lines = Lines(texts_of(batch))
        at = np.flatnonzero(lines.n >= own_words)
        at = at[bits.maybe(wanted.value, lines.h1[at])]
        yield {"h1": lines.h1[at].view(np.int64), "h2": lines.h2[at].view(np.int64), "doc": batch.column(0).to_numpy()[lines.doc[at]]}

    rows = map_blocks(docs, "h1 long, h2 long, doc long", step, types)
    first = repeated.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("doc").alias("first"))
    return rows.join(first, (rows["h1"] == first["r1"]) & (rows["h2"] == first["r2"])).where("doc > first").select("doc", "h1")


def _with_words(docs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """The rows (h1, h2, doc, line) with their words, from the documents."""
    wanted = docs.sparkSession.sparkContext.broadcast(bits.build(lines, "h1"))
    types = pa.schema([(n, pa.int64()) for n in ("e1", "e2", "edoc", "eline")] + [("words", pa.string())])

    def step(batch):
        lines = Lines(texts_of(batch))
        at = np.flatnonzero(lines.n >= min_words)
        at = at[bits.maybe(wanted.value, lines.h1[at])]
        raw, words = lines.words.buf.tobytes(), lines.words
        texts = [" ".join(raw[words.start[a] : words.end[b - 1]].decode().split()) if b > a else "" for a, b in zip(lines.a[at].tolist(), lines.b[at].tolist(), strict=True)]
        yield {"e1": lines.h1[at].view(np.int64), "e2": lines.h2[at].view(np.int64), "edoc": batch.column(0).to_numpy()[lines.doc[at]], "eline": lines.number[at], "words": texts}

    rows = map_blocks(docs, "e1 long, e2 long, edoc long, eline long, words string", step, types)
    joined = rows.join(lines, (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2")) & (F.col("edoc") == F.col("doc")) & (F.col("eline") == F.col("line")))
    return joined.select("h1", "doc", "line", "words").dropDuplicates(["h1", "doc", "line"])


def _variants(survivors: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(variant, place, h1, doc, line): each line itself (place -1) and without each of its words."""
    shared = None if wanted is None else survivors.sparkSession.sparkContext.broadcast(wanted)
    names = ["variant", "place", "h1", "doc", "line"]
    types = pa.schema([(n, pa.int64()) for n in names])

    def step(batch):
        lines = Lines(texts_of(batch))
        each = np.repeat(np.arange(len(lines.n)), lines.n)
        a, b = lines.a[each], lines.b[each]
        p = np.arange(len(each)) - np.repeat(np.cumsum(lines.n) - lines.n, lines.n)
        variant = np.concatenate([lines.span(lines.a, lines.b), lines.without(a, b, a + p)])
        place = np.concatenate([np.full(len(lines.n), -1), p])
        row = np.concatenate([lines.doc, lines.doc[each]])
        if shared is not None:
            ok = bits.maybe(shared.value, variant)
            variant, place, row = variant[ok], place[ok], row[ok]
        yield {"variant": variant.view(np.int64), "place": place} | {n: batch.column(batch.schema.get_field_index(n)).take(pa.array(row)) for n in ("h1", "doc", "line")}

    return map_blocks(survivors.select("h1", "doc", "line", F.col("words").alias("text")), ", ".join(f"{n} long" for n in names), step, types)


def within_one_edit(x: list[str], y: list[str]) -> bool:
    """Whether the word lists differ by at most one inserted, deleted or replaced word."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def _verified(pairs: DataFrame, survivors: DataFrame) -> DataFrame:
    """(doc, h1) of later lines whose words are within one edit of the earlier line's."""
    late = survivors.select(F.col("h1").alias("late"), F.col("doc").alias("late_doc"), F.col("words").alias("x"))
    early = survivors.select(F.col("h1").alias("early"), F.col("words").alias("y"))
    types = pa.schema([("doc", pa.int64()), ("h1", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([within_one_edit(a.split(" "), b.split(" ")) for a, b in zip(x, y, strict=True)], pa.bool_())
            kept = batch.filter(ok)
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], schema=types)

    joined = pairs.join(late, "late").join(early, "early").select("late_doc", "late", "x", "y")
    return bounded(joined).mapInArrow(run, "doc long, h1 long").distinct()


def _near(docs: DataFrame, first: DataFrame, min_words: int) -> DataFrame:
    """(doc, h1) of distinct lines that are one edit from an earlier line."""
    keyed = first.where("k1 IS NOT NULL").select("h1", "h2", "doc", "line", F.explode(F.array("k1", "k2", "k3")).alias("half"))
    common = keyed.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("half")
    lines = checkpoint(keyed.join(common, "half", "left_semi").drop("half").distinct())
    survivors = checkpoint(_with_words(docs, lines, min_words))
    shared = checkpoint(_variants(survivors, None).groupBy("variant").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("variant"))
    rows = checkpoint(_variants(survivors, bits.build(shared, "variant")).join(shared, "variant", "left_semi"))
    order = F.struct("doc", "line", "h1")
    # a replaced word: same place; all but the earliest of a group go
    least = rows.where("place >= 0").groupBy("variant", "place").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1").select(F.col("variant").alias("v"), F.col("place").alias("p"), F.col("first.h1").alias("early"))
    replaced = rows.join(least, (rows["variant"] == least["v"]) & (rows["place"] == least["p"])).where("h1 <> early").select(F.col("h1").alias("late"), "early")
    # an inserted word: a whole line against the lines that have it as a variant
    whole = rows.where("place < 0").select(F.col("variant").alias("v"), F.col("h1").alias("w1"), F.struct("doc", "line", "h1").alias("worder"))
    inserted = rows.where("place >= 0").join(whole, rows["variant"] == whole["v"]).where("h1 <> w1")
    later = order > F.col("worder")
    inserted = inserted.select(F.when(later, F.col("h1")).otherwise(F.col("w1")).alias("late"), F.when(later, F.col("w1")).otherwise(F.col("h1")).alias("early"))
    return _verified(checkpoint(replaced.unionByName(inserted).distinct()), survivors)


def _place(id_col, text_col):
    """A document's place in the order: its id, or for rows without one a hash of the text above all ids."""
    return F.coalesce(id_col.cast("long"), F.xxhash64(text_col.cast("string")).bitwiseAND(F.lit(LAST - 1)) + F.lit(LAST))


def line_drops(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, own_words: int | None = None) -> DataFrame:
    """(doc, hashes): for each document the hashes of lines that go because of an earlier document's or line's."""
    if min_words < 3:
        raise ValueError("min_words must be 3 or more")
    docs = documents.select(_place(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    own_words = own_words or min_words
    first = checkpoint(_first_lines(docs, min_words, own_words))
    copies = _copies(docs, first.where("last > doc"), own_words)
    return copies.unionByName(_near(docs, first, min_words)).groupBy("doc").agg(F.collect_set("h1").alias("hashes"))


def _cut(texts: pa.Array, drops: list, own_words: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """New texts (None: unchanged), line counts, dropped counts, emptied flags."""
    lines = Lines(texts)
    eligible = lines.n >= own_words
    gone = lines.repeated(eligible)
    sizes = [len(x or ()) for x in drops]
    if any(sizes):
        keys = np.fromiter((h for x in drops for h in x or ()), dtype=np.int64, count=sum(sizes)).view(np.uint64)
        marks = flat.mix(keys ^ flat.mix(np.repeat(np.arange(len(drops)), sizes).astype(np.uint64)))
        gone |= eligible & np.isin(flat.mix(lines.h1 ^ flat.mix(lines.doc.astype(np.uint64))), marks)
    n = len(texts)
    counts, dropped = np.bincount(lines.doc, minlength=n), np.bincount(lines.doc[gone], minlength=n)
    left = np.bincount(lines.doc[eligible & ~gone], minlength=n)
    raw, _ = flat.raw(texts)
    raw = raw.tobytes()
    first = np.searchsorted(lines.doc, np.arange(n + 1))
    out: list = [None] * n
    for d in np.flatnonzero(dropped):
        kept = np.flatnonzero(~gone[first[d] : first[d + 1]]) + first[d]
        out[d] = b"\n".join([raw[lines.start[k] : lines.end[k]] for k in kept]).decode()
    return out, counts, dropped, (dropped > 0) & (left == 0)


def _joined(documents: DataFrame, drops: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    name = "hashes"
    while name.lower() in {c.lower() for c in documents.columns} | {"doc"}:
        name += "_"
    key = _place(documents[id_col], documents[text_col])
    drops = drops.select(F.col("doc").alias(name + "k"), F.col("hashes").alias(name))
    return documents.join(drops, key == drops[name + "k"], "left").drop(name + "k"), name


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, own_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, emptied, text (what is left)."""
    narrow = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined, name = _joined(narrow, line_drops(narrow, "doc_id", "text", min_words, own_words), "doc_id", "text")
    types = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("emptied", pa.bool_()), ("text", pa.string())])

    def step(batch):
        old = batch.column(1)
        new, counts, dropped, emptied = _cut(texts_of(batch), batch.column(2).to_pylist(), own_words or min_words)
        null = old.is_null().to_numpy(zero_copy_only=False)
        texts = pa.array([o if t is None else t for o, t in zip(old.to_pylist(), new, strict=True)], pa.string())
        yield {"doc_id": batch.column(0), "n_lines": np.where(null, 0, counts), "n_dropped": dropped, "emptied": emptied, "text": texts}

    return map_blocks(joined.select("doc_id", "text", name), "doc_id long, n_lines long, n_dropped long, emptied boolean, text string", step, types)


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, own_words: int | None = None) -> DataFrame:
    """The documents, with all their columns, without repeated lines; emptied documents go."""
    joined, name = _joined(documents, line_drops(documents, id_col, text_col, min_words, own_words), id_col, text_col)
    at, width = documents.columns.index(text_col), len(documents.columns)

    def run(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            texts, drops = column.fill_null(""), batch.column(width).to_pylist()
            for start, end in blocks(texts):
                new, _, _, emptied = _cut(texts.slice(start, end - start), drops[start:end], own_words or min_words)
                own = batch.slice(start, end - start)
                out = pa.array([o if t is None else t for o, t in zip(column.slice(start, end - start).to_pylist(), new, strict=True)], pa.string())
                arrays = [out if i == at else own.column(i) for i in range(width)]
                kept = pa.RecordBatch.from_arrays(arrays, names=own.schema.names[:width]).filter(pa.array(~emptied))
                if kept.num_rows:
                    yield kept

    return bounded(joined).mapInArrow(run, documents.schema)
