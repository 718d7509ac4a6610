"""N-gram Jaccard join over parity sketches.

A text's set is its distinct 4-word shingles (64-bit hashes). The shingles of a set are XOR-ed into a bit sketch: the
hash's high half chooses one of ``m`` segments, its low half one of 4,096 bits there, and a bit holds the parity of its
shingles. The Hamming distance of two sketches is at most the symmetric difference of the sets. Two sets of sizes a, b
link at ``percent`` only if their symmetric difference is at most ``(100 - percent) / (100 + percent) * (a + b)``; size
bands make that a fixed number D, so with ``m > D`` segments a linked pair has an equal segment (pigeonhole). Segments
are joined as hashed keys; in no case is the sketch itself shuffled.

Shingles that very many texts share (found by bounded summaries of every task, broadcast as a sorted array of at most
``MOST_COMMON`` hashes) say little, so segments are first taken of the other, rare shingles alone: their symmetric
difference is within D too. A band has ``m - D - 1`` segments to spare, so as long as no more of them are empty an equal
segment with a rare shingle remains, and only such segments are emitted. A set with more empty ones emits these and
also all segments of its whole set; there, light ones (fewer than three shingles) are left out while the spare ones
allow it. Which shingles count as common thus never decides a result, and every linked pair keeps a common key.

The spare segments also prune: a linked pair has at least ``m - D`` equal segments, so a set needs as many shared keys in a
band, less its empty (or light) ones. Sets with fewer are dropped from the band before anything is shuffled for them.

Equal sets are one node. Sets and shingles are told apart by 64-bit hashes. The first pass over the keys, which only finds
keys of more than one node, sends 40 bits of each node: a link is missed if two linked nodes agree in these (2^-40 a pair)
and no third one shares their keys. Joined keys are resolved without pairs inside a group: each member is paired with the least
node of its group (a star); pairs that sizes and 2048-bit parity sketches do not rule out are compared exactly, by
intersecting the sets; links give components. Only keys whose members are still in different components are looked at
again, and of keys with the same members only one: members of different components are paired if two exact filters pass (their distances from the common least
node, where known, differ by 1 - percent / 100 at most, as Jaccard distance is a metric; and the sketches), in groups of
up to 16 by a join, in larger ones in blocks inside a kernel that returns only survivors. Sets are only moved for
documents of pairs that are left, one document of each node.

Links are counted once the components are known: every link lies in one component, so all sets of a component are compared
exactly, in blocks of about ``BLOCK_VALUES`` shingles that meet pairwise in a kernel; it returns a count for each node, no
pairs. A component of two nodes needs no comparison. A linked node counts with its copies, and so do a node's own others.

Nulls and empty texts: empty set, n_shingles 0, linked with nothing. Fewer words than 4: the whole sequence is the one
shingle. A null doc_id keeps a row; it is no smallest id of a component unless alone (then null). Repeated rows link like any
copies. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm import bits, flat
from gistmill.llm.components import components
from gistmill.llm.session import bounded, blocks, checkpoint, map_blocks, released, texts_of

SHINGLE, PERCENT = 4, 85
LIGHT = 3
BITS = flat.stream(6, 4096)
SMALL_GROUP, KERNEL_GROUP, SKETCH = 16, 2048, 2048
BLOCK_VALUES = 1 << 19
#: Of so many shingles at a time a task reports up to LEADERS that LOCAL texts or more have there.
SUMMARY, LOCAL, LEADERS = 4_000_000, 3, 50_000
COMMON, MOST_COMMON = 32, 1_000_000


class Sets:
    """Distinct shingle hashes of each text of a block, sorted within a text: ``values``, ``first``, ``counts``."""

    def __init__(self, texts: pa.Array, k: int):
        words = flat.Words(texts, flat.SPACES)
        grams, _ = words.grams(k)
        pieces, first = [], np.zeros(len(texts) + 1, dtype=np.int64)
        for d in range(len(texts)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            else:
                own = flat.gram_hash(words.hash[a:b], b - a) if b > a else grams[:0]
            pieces.append(own)
            first[d + 1] = first[d] + len(own)
        self.values = np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.uint64)
        self.first, self.counts = first, np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(flat.mix(self.values))])
        self.node = flat.mix(sums[first[1:]] - sums[first[:-1]] + self.counts.astype(np.uint64))


@lru_cache(maxsize=8)
def bands(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; sizes that can link lie in one band or in two that follow each other."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] * 100 // percent, out[-1] + 1))
    return np.array(out, dtype=np.int64)


def plan(band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest symmetric difference D in a band, and its number of segments (0 where no two different sets can link)."""
    most = (100 - percent) * 2 * bands(percent)[band] // (100 + percent)
    return most, np.where(most > 0, most + 1 + np.maximum(1, 15 * (most + 1) // 100), 0)


def _segments(values: np.ndarray, doc: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketch digest and number of shingles of every segment of every set, in order."""
    base = np.concatenate([[0], np.cumsum(m)])
    sketch, held = np.zeros(base[-1], dtype=np.uint64), np.zeros(base[-1], dtype=np.int64)
    if len(values):
        segment = ((values >> flat.U(32)) * m[doc].astype(np.uint64)) >> flat.U(32)
        place = base[doc] + segment.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sketch[place[starts]] = np.bitwise_xor.reduceat(BITS[(values & flat.U(4095)).astype(np.int64)], starts)
        held[place[starts]] = np.diff(np.concatenate([starts, [len(place)]]))
    return sketch, held


def segment_keys(sets: Sets, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of the segments that a set shows in its own band and, as the smaller one of a pair, in the next.

    Also the group of each key, and how many keys of a group a partner shares at least, for every group. Groups are those
    of one set, one band, and rare or whole segments.
    """
    rows, keys, groups, needs = [], [], [], []
    own = np.searchsorted(bands(percent), np.maximum(sets.counts, 1))
    rare = np.ones(len(sets.values), dtype=bool) if common is None or not len(common) else ~_in_sorted(common, sets.values)
    n = len(sets.counts)
    for part, band in enumerate((own, own + 1)):
        most, m = plan(band, percent)
        m = np.where(sets.counts > 0, m, 0)
        row = np.repeat(np.arange(n), m)
        if not len(row):
            needs += [np.ones(n, dtype=np.int64)] * 2
            continue
        at = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        tag = (band[row].astype(np.uint64) << flat.U(40)) + (at.astype(np.uint64) << flat.U(1))
        use = rare & (m[sets.doc] > 0)
        sketch, held = _segments(sets.values[use], sets.doc[use], m)
        empty = np.bincount(row[held == 0], minlength=n)
        pick = np.flatnonzero(held > 0)
        rows.append(row[pick])
        keys.append(flat.mix(sketch[pick] ^ flat.mix(tag[pick])))
        groups.append(row[pick] + 2 * part * n)
        # with too many empty segments a partner may still need this set's rare ones: one that is shared is enough
        needs.append(np.maximum(m - most - empty, 1))
        whole = (empty > m - most - 1) & (m > 0)
        enough = np.ones(n, dtype=np.int64)
        if whole.any():
            m2 = np.where(whole, m, 0)
            use = whole[sets.doc]
            sketch, held = _segments(sets.values[use], sets.doc[use], m2)
            pick = np.flatnonzero(whole[row])
            row, tag, light = row[pick], tag[pick], held < LIGHT
            lights = np.bincount(row[light], minlength=n)
            every = lights > m - most - 1
            emit = ~light | every[row]
            rows.append(row[emit])
            keys.append(flat.mix(sketch[emit] ^ flat.mix(tag[emit] + flat.U(1))))
            groups.append(row[emit] + (2 * part + 1) * n)
            # a set that shows its light segments too may have partners that do not
            enough = np.maximum(m - most - lights, 1)
        needs.append(enough)
    need = np.concatenate(needs) if needs else np.zeros(0, dtype=np.int64)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), need
    # 56 bits: fewer bytes to shuffle; keys that fall together by chance only add candidates
    return np.concatenate(rows), np.concatenate(keys) >> flat.U(8), np.concatenate(groups), need


def _in_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Membership in a sorted array, by a bit per leading 20 bits first."""
    seen = np.zeros(1 << 20, dtype=bool)
    seen[(table >> flat.U(44)).astype(np.int64)] = True
    out = seen[(values >> flat.U(44)).astype(np.int64)]
    some = np.flatnonzero(out)
    at = np.searchsorted(table, values[some])
    at[at == len(table)] = 0
    out[some] = table[at] == values[some]
    return out


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles of very many texts: leaders of bounded summaries, with COMMON texts or more in all."""
    types = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def leaders(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        values, n = values[n >= LOCAL], n[n >= LOCAL]
        if len(n) > LEADERS:
            top = np.argpartition(-n, LEADERS)[:LEADERS]
            values, n = values[top], n[top]
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], schema=types)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts = texts_of(batch)
            for start, end in blocks(texts):
                held.append(Sets(texts.slice(start, end - start), k).values)
                size += len(held[-1])
                if size > SUMMARY:
                    yield leaders(held)
                    held, size = [], 0
        if held:
            yield leaders(held)

    counts = bounded(docs.select("text")).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counts = checkpoint(counts)
    least = COMMON
    while counts.where(F.col("n") >= least).count() > MOST_COMMON:
        least *= 2
    return np.sort(counts.where(F.col("n") >= least).select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def _keys(docs: DataFrame, k: int, percent: int, common, wanted: np.ndarray | None = None, first: bool = True) -> DataFrame:
    """(key, node): at ``first`` 40 bits of the node, later the whole node and only keys of groups with enough wanted keys."""
    filter_ = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def step(batch):
        sets = Sets(texts_of(batch), k)
        row, key, group, need = segment_keys(sets, percent, common.value)
        node = sets.node
        if first:
            node = node >> flat.U(24)
        elif filter_ is not None:
            ok = bits.maybe(filter_.value, key)
            enough = np.bincount(group[ok], minlength=len(need)) >= need
            ok &= enough[group]
            row, key = row[ok], key[ok]
        yield {"key": key.view(np.int64), "node": node[row].view(np.int64)}

    return map_blocks(docs.select("text"), "key long, node long", step, pa.schema([("key", pa.int64()), ("node", pa.int64())]))


def _members(docs: DataFrame, k: int) -> DataFrame:
    names = ["doc_id", "carried"]

    def step(batch):
        sets = Sets(texts_of(batch), k)
        yield {n: batch.column(i) for i, n in enumerate(names)} | {"node": sets.node.view(np.int64), "n_shingles": sets.counts}

    return map_blocks(docs, "doc_id long, carried long, node long, n_shingles long", step, pa.schema([(n, pa.int64()) for n in (*names, "node", "n_shingles")]))


def _of_some(docs: DataFrame, k: int, wanted: np.ndarray | None, schema: str, types: pa.Schema, rows) -> DataFrame:
    """Columns that ``rows`` makes of the nonempty sets of documents that may be wanted; others' sets are not made."""
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def step(batch):
        if shared is not None:
            batch = batch.filter(pa.array(bits.maybe(shared.value, batch.column(0).to_numpy().view(np.uint64))))
        if batch.num_rows:
            sets = Sets(texts_of(batch), k)
            yield rows(sets, np.flatnonzero(sets.counts > 0))

    return map_blocks(docs.select(_mark("doc_id").alias("mark"), "text"), schema, step, types)


def _sets(docs: DataFrame, k: int, wanted: np.ndarray | None) -> DataFrame:
    """(node, hashes) of the documents that may be wanted (few nodes come twice)."""

    def rows(sets, keep):
        keep = keep[np.unique(sets.node[keep], return_index=True)[1]]
        return {"node": sets.node[keep].view(np.int64), "hashes": [sets.values[sets.first[d] : sets.first[d + 1]].tobytes() for d in keep]}

    return _of_some(docs, k, wanted, "node long, hashes binary", pa.schema([("node", pa.int64()), ("hashes", pa.binary())]), rows)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst, both, total): sizes of intersection and union for each pair."""
    one = sets.select(F.col("node").alias("src"), F.col("hashes").alias("a"))
    two = sets.select(F.col("node").alias("dst"), F.col("hashes").alias("b"))
    types = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("both", pa.int64()), ("total", pa.int64())])

    def run(batches):
        for batch in batches:
            both, total = [], []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both.append(int(np.count_nonzero(y[at] == x)))
                total.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(total, pa.int64())], schema=types)

    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long, both long, total long")


def _sketches(docs: DataFrame, k: int, wanted: np.ndarray | None) -> DataFrame:
    """(node, n, sketch) as ``_sets``: size and a parity sketch of SKETCH bits; one row a node."""

    def rows(sets, keep):
        data = [np.packbits((np.bincount((sets.values[sets.first[d] : sets.first[d + 1]] & flat.U(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes() for d in keep]
        return {"node": sets.node[keep].view(np.int64), "n": sets.counts[keep], "sketch": data}

    return _of_some(docs, k, wanted, "node long, n long, sketch binary", pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())]), rows).dropDuplicates(["node"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of sketches."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _may_link(na, nb, apart, percent: int):
    """Necessary for a link: the sizes, and the sketches' distance as a lower bound of the symmetric difference."""
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (apart * (100 + percent) <= (100 - percent) * (na + nb))


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) that sizes and sketches do not rule out."""
    one = sketches.select(F.col("node").alias("src"), F.col("n").alias("na"), F.col("sketch").alias("a"))
    two = sketches.select(F.col("node").alias("dst"), F.col("n").alias("nb"), F.col("sketch").alias("b"))

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, SKETCH // 64) for i in (4, 5))
            ok = _may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), _apart(a, b), percent)
            yield batch.select(["src", "dst"]).filter(pa.array(ok))

    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "na", "nb", "a", "b").mapInArrow(run, "src long, dst long")


def _open_members(keys: DataFrame, star: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, label, size, far): members of keys with several components, but for the least node, which the star compared."""
    labelled = keys.join(label.withColumnRenamed("node", "n0"), keys["node"] == F.col("n0"), "left").select("key", "node", "least", F.coalesce("label", "node").alias("label"))
    # two members of a key were compared by the star; from three on, members of several components are left
    digest = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"d{i}") for i in (0, 1)]
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), *digest).where("lo < hi AND size > 2")
    # near copies share most of their keys: of keys with the same members one is enough
    open_keys = open_keys.groupBy("d0", "d1", "size").agg(F.min("key").alias("k")).select("k", "size")
    members = labelled.join(open_keys, labelled["key"] == F.col("k")).drop("k")
    away = star.select(F.col("src").alias("s"), F.col("dst").alias("d"), (F.lit(1.0) - F.col("both") / F.col("total")).alias("far"))
    members = members.join(away, (members["node"] == F.col("s")) & (members["least"] == F.col("d")), "left").where("node <> least").select("key", "node", "label", "size", "far")
    return checkpoint(members)


def _rest(members: DataFrame, sketches: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (src, dst) of members of one key in different components that pass the exact filters.

    ``forest``: of the pairs that a large group's blocks find, only as many as would join what they could join.
    """
    near = 1 - percent / 100 + 1e-9
    few, many = members.where(F.col("size") <= SMALL_GROUP), members.where(F.col("size") > SMALL_GROUP)
    a, b = few.alias("a"), few.alias("b")
    together = F.coalesce(F.abs(F.col("a.far") - F.col("b.far")) <= near, F.lit(True))
    joined = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & together)
    pairs = _likely(joined.select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct(), sketches, percent)
    if many.isEmpty():
        return pairs
    # blocks of a large group meet pairwise: a member is sent once to each pair of blocks that its block is part of
    wide = many.join(sketches.withColumnRenamed("node", "sn"), many["node"] == F.col("sn")).drop("sn")
    wide = wide.withColumn("parts", F.ceil(F.col("size") / KERNEL_GROUP)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    wide = wide.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).select("key", "x", "y", "node", "label", "n", "far", "sketch")

    def blockwise(pdf):
        import pandas as pd

        found = []
        n, label, node = (pdf[c].to_numpy(copy=True) for c in ("n", "label", "node"))
        far = pdf["far"].to_numpy(dtype=float, na_value=np.nan)
        rows = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint64).reshape(-1, SKETCH // 64)
        for i in range(len(pdf) - 1):
            j = np.arange(i + 1, len(pdf))
            j = j[(label[j] != label[i]) & ~(np.abs(far[j] - far[i]) > near)]
            j = j[_may_link(n[j], n[i], _apart(rows[j], rows[i]), percent)]
            while forest and len(j):
                found.append((min(node[i], node[j[0]]), max(node[i], node[j[0]])))
                label[label == label[j[0]]] = label[i]
                j = j[label[j] != label[i]]
            found += [(min(node[i], v), max(node[i], v)) for v in node[j]]
        return pd.DataFrame(found, columns=["src", "dst"]).astype("int64")

    return pairs.unionByName(wide.groupBy("key", "x", "y").applyInPandas(blockwise, "src long, dst long")).distinct()


def _mark(id_col: str):
    return F.xxhash64(F.coalesce(id_col, F.lit(0)))


def _marks(wanted: DataFrame, nodes: DataFrame) -> np.ndarray | None:
    """Filter of hashed ids, one document of each node of the one-column (vn) table."""
    return bits.build(wanted.join(nodes, wanted["vn"] == nodes["node"]).select(_mark("rep").alias("mark")), "mark")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("vn")).distinct()


def _degrees(docs: DataFrame, nodes: DataFrame, label: DataFrame, k: int, percent: int) -> DataFrame:
    """(fn, linked): for each node of a component the number of documents of other nodes that a document of it links with."""
    placed = checkpoint(nodes.join(label.withColumnRenamed("node", "ln"), nodes["node"] == F.col("ln")).select("node", "copies", "n", "label"))
    groups = checkpoint(placed.groupBy("label").agg(F.count("*").alias("nodes"), F.sum("copies").alias("all"), F.sum("n").alias("values")).withColumnRenamed("label", "gl"))
    inside = placed.join(groups, placed["label"] == F.col("gl")).drop("gl")
    two = inside.where("nodes = 2").select("node", (F.col("all") - F.col("copies")).alias("linked"))
    wide = checkpoint(inside.where("nodes > 2").withColumn("parts", F.ceil(F.col("values") / BLOCK_VALUES)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))))
    sets = _sets(docs, k, _marks(wide.select(F.col("node").alias("vn")), nodes)).dropDuplicates(["node"]).withColumnRenamed("node", "sn")
    wide = wide.join(sets, wide["node"] == F.col("sn")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    wide = wide.withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).select("label", "x", "y", "part", "node", "copies", "hashes")

    def blockwise(pdf):
        import pandas as pd

        sets = [np.frombuffer(h, dtype=np.uint64) for h in pdf["hashes"]]
        part, copies = pdf["part"].to_numpy(), pdf["copies"].to_numpy()
        sizes = np.array([len(x) for x in sets])
        first = np.concatenate([[0], np.cumsum(sizes)])
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        mine, apart = np.zeros(len(names), dtype=bool), pdf["x"].iloc[0] != pdf["y"].iloc[0]
        linked = np.zeros(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            own = ids[first[i] : first[i + 1]]
            mine[own] = True
            both = np.add.reduceat(mine[ids], first[:-1], dtype=np.int64)
            mine[own] = False
            ok = both * 100 >= (sizes + sizes[i] - both) * percent
            ok[i] = False
            # two different blocks: pairs inside each are counted where it meets itself
            linked[i] = copies[ok & (part != part[i]) if apart else ok].sum()
        return pd.DataFrame({"node": pdf["node"].to_numpy(), "linked": linked})

    return two.unionByName(wide.groupBy("label", "x", "y").applyInPandas(blockwise, "node long, linked long")).groupBy(F.col("node").alias("fn")).agg(F.sum("linked").alias("linked"))


def _candidates(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, node, least) of keys that several nodes share, least being the key's smallest node."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))
    shared = _keys(docs, k, percent, common).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    shared = checkpoint(shared)
    wanted = bits.build(shared, "key")
    rows = _keys(docs, k, percent, common, wanted, first=False).distinct()
    if wanted is None:
        rows = rows.join(shared, "key", "left_semi")
    rows = checkpoint(rows)
    least = checkpoint(rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("hi")).where("least < hi").select(F.col("key").alias("k"), "least"))
    return checkpoint(rows.join(least, rows["key"] == least["k"]).select("key", "node", "least"))


def _linked(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, label): the component, by its smallest node, of every node that links with another."""
    keys = _candidates(docs, k, percent)
    star = keys.where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst")).distinct()
    sketches = checkpoint(_sketches(docs, k, _marks(keys.select(F.col("node").alias("vn")).distinct(), nodes)))
    star = checkpoint(_likely(star, sketches, percent))
    sets = checkpoint(_sets(docs, k, _marks(_ends(star), nodes)))
    star = checkpoint(_compared(star, sets).distinct())
    linked = F.col("both") * 100 >= F.col("total") * percent
    links = star.where(linked).select("src", "dst")
    label = checkpoint(components(links))
    members = _open_members(keys, star, label)
    # first every pair of small groups and as few of large ones as could join all; then every pair that large ones still have open
    for forest in (True, False):
        rest = checkpoint(_rest(members, sketches, percent, forest))
        if rest.isEmpty():
            break
        sets = _sets(docs, k, _marks(_ends(rest), nodes))
        new = checkpoint(_compared(rest, sets).where(linked).select("src", "dst").distinct())
        if not new.isEmpty():
            label = checkpoint(components(label.select(F.col("node").alias("src"), F.col("label").alias("dst")).unionByName(new)))
        now = label.select(F.col("node").alias("n1"), F.col("label").alias("l1"))
        members = members.join(now, members["node"] == now["n1"], "left").select("key", "node", F.coalesce("l1", "label").alias("label"), "size", "far").where(F.col("size") > SMALL_GROUP)
        live = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
        members = checkpoint(members.join(live, members["key"] == live["k"], "left_semi"))
    return label


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, count_links: bool = True, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and, with ``count_links``, n_links (other documents that it links with).

    ``carry`` names a column of whole numbers, say a key of rows, that comes along as ``carried``; with it ``leader`` tells
    whether the row is its component's first by id (rows without one last), then by ``carried``. Of repeated rows with one id
    and one carried number all or none are. Rows with an empty set are.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(carry) if carry else F.lit(0)).cast("long").alias("carried"), F.col(text_col).cast("string").alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "carried")
    with released(documents.sparkSession):
        members = checkpoint(_members(docs, shingle))
        nodes = checkpoint(members.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min(order).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n")))
        label = _linked(docs, nodes, shingle, percent)
        # a row a node; the rows of a node only meet it in a plain join, which Spark splits where copies are many
        named = label.withColumnRenamed("node", "ln")
        placed = checkpoint(nodes.join(named, nodes["node"] == F.col("ln"), "left").select("node", "rep", "first", "copies", F.coalesce("label", "node").alias("label")))
        least = checkpoint(placed.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("first").alias("leads")).withColumnRenamed("label", "l2"))
        placed = placed.join(least, placed["label"] == F.col("l2")).select("node", "copies", "component_id", "leads")
        if count_links:
            degree = checkpoint(_degrees(docs, nodes, label, shingle, percent))
            placed = placed.join(degree, placed["node"] == F.col("fn"), "left").select("node", "component_id", "leads", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
        placed = checkpoint(placed.withColumnRenamed("node", "pn"))
    extra = (["n_links"] if count_links else []) + (["carried", "leader"] if carry else [])
    full, none = members.where("n_shingles > 0"), members.where("n_shingles = 0").withColumns({"n_links": F.lit(0).cast("long"), "leader": F.lit(True)})
    out = full.join(placed, full["node"] == F.col("pn")).withColumn("leader", (order == F.col("leads"))).select("doc_id", "n_shingles", "component_id", *extra)
    return out.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *extra))
