"""URL filter: a Bloom filter cascade gives exact membership of listed domains without joins.

Level 0 is a Bloom filter of the listed keys. Level 1 holds the keys of the corpus that are not listed but pass level 0,
level 2 the listed keys that pass level 1, and so on until a level lets no wrong key pass. As the levels are built
over the complete universe of keys in the corpus (every domain suffix of every host, as long as listed keys can be), the
first level that a key does not pass decides exactly. All of it is DataFrame and SQL expressions: the universe of keys is
written once, levels are built by bit_or over cells and put together in chunks by aggregates, and each travels as one
binary literal. Levels have at most ``most_bits`` bits together (6.7 million listed keys at 10 bits); a longer list, which is
no longer fit to be sent to every task, is answered by a left semi join on the same keys.

A url's host is what follows the first ``://`` up to ``/``, ``?`` or ``#`` with A-Z lower-cased; its path follows up to ``?`` or
``#``. Given rules come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest
wins. Else a url is blocked if its host or a parent domain is listed.

Nulls: a null url, or one without ``://``, has empty host and path and is allowed. A null page_id, repeated rows and very
long urls get a row each. An empty list blocks nothing; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm.session import checkpoint

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Listed domains of the production query; ``url_filter`` takes any table of them.
LISTED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track") for top in ("com", "net", "org"))
MOST_BITS = 1 << 26
BITS_PER_KEY, HASHES, CELL = 10, 3, 7  # a cell is one byte of seven bits, so that it is ASCII
CHUNK = 4096


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column, labels: int) -> Column:
    """The host and its parent domains of at most ``labels`` labels."""
    name = F.split(host, "\\.", -1)
    n = F.size(name)
    return F.transform(F.sequence(F.greatest(F.lit(1), n - (labels - 1)), n), lambda i: F.array_join(F.slice(name, i, n), "."))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits)) for j in range(HASHES)]


def _filter(keys: DataFrame, level: int, n: int) -> tuple[bytes, int]:
    """Cells and number of bits of a Bloom filter over ``n`` keys; the driver gets one row for each chunk of cells."""
    bits = -(-max(n, 1) * BITS_PER_KEY // CELL) * CELL
    places = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
    cells = places.select(F.expr(f"at div {CELL}").alias("cell"), F.expr(f"shiftleft(1, cast(at % {CELL} as int))").alias("bits"))
    every = cells.unionByName(keys.sparkSession.range(bits // CELL).select(F.col("id").alias("cell"), F.lit(0).alias("bits")))
    every = every.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    chunks = every.groupBy(F.expr(f"cell div {CHUNK}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("cell", "bits"))).alias("cells"))
    rows = chunks.select("chunk", F.array_join(F.transform("cells", lambda c: F.char(c["bits"])), "").alias("cells")).orderBy("chunk").collect()
    return "".join(r["cells"] for r in rows).encode("ascii"), bits


def _passes(key: Column, level: int, cells: bytes, bits: int) -> Column:
    data = F.lit(bytearray(cells))

    def bit(at: Column) -> Column:
        cell = F.ascii(F.substring(data, (at / CELL).cast("int") + 1, F.lit(1)).cast("string"))
        return F.floor(cell / F.pow(F.lit(2), at % CELL)) % 2 == 1

    return F.forall(F.array(*_places(key, level, bits)), bit)


def cascade(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> list[tuple[bytes, int]] | None:
    """Filters level by level for the one-column (key) tables, or None if they would exceed ``most_bits``."""
    marked = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    marked = checkpoint(marked.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")))
    levels: list[tuple[bytes, int]] = []
    while True:
        side = marked.where(F.col("listed") == (len(levels) % 2 == 0))
        n = side.count()
        if n == 0:
            return levels
        if sum(b for _, b in levels) + n * BITS_PER_KEY > most_bits:
            return None
        levels.append(_filter(side, len(levels), n))
        # from here on only the other side's keys that pass, and all of this side's, still matter
        other = F.col("listed") == (len(levels) % 2 == 0)
        marked = checkpoint(marked.where(~other | _passes(F.col("key"), len(levels) - 1, *levels[-1])))


def member(key: Column, levels: list[tuple[bytes, int]]) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels) - 1, -1, -1):
        out = F.when(~_passes(key, level, *levels[level]), F.lit(level % 2 == 1)).otherwise(out)
    return out


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", key_col: str = "key", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict (allow or block)."""
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = listed.select(F.lower(F.col(key_col).cast("string")).alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    labels = keys.agg(F.max(F.size(F.split("key", "\\."))).alias("n")).first()["n"] or 0
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if not labels:
        hit = F.lit(False)
    else:
        universe = urls.select("host").distinct().select(F.explode(suffixes(F.col("host"), labels)).alias("key"))
        levels = cascade(universe, keys, most_bits)
        if levels is None:
            blocked = urls.select("host").distinct().select("host", F.explode(suffixes(F.col("host"), labels)).alias("key")).join(keys, "key", "left_semi").select(F.col("host").alias("bad")).distinct()
            urls = urls.join(blocked, urls["host"] == blocked["bad"], "left")
            hit = F.col("bad").isNotNull()
        else:
            hit = F.exists(suffixes(F.col("host"), labels), lambda k: member(k, levels))
    return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def listed_domains(spark: SparkSession, names=LISTED) -> DataFrame:
    """A one-column (key) table of the names."""
    rows = ", ".join("('" + n.replace("\\", "\\\\").replace("'", "\\'") + "')" for n in names)
    return spark.sql(f"SELECT key FROM VALUES {rows} AS t(key)" if names else "SELECT CAST(NULL AS STRING) AS key WHERE false")


def oracle(listed=LISTED, rules=RULES) -> str:
    """The same as DuckDB SQL over ``pages``."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = " ".join(f"WHEN {c} THEN '{h + p}'" for c, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"WHEN {c} THEN '{k}'" for c, (k, _, _) in zip(fits, ordered, strict=True))
    bad = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in listed)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
