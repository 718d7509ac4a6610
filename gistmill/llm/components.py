"""Connected components of a link table by alternating large-star and small-star steps, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistmill.llm.session import checkpoint


def components(links: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node of ``links`` the smallest node it reaches.

    Large-star links each node's larger neighbours to its smallest neighbour; small-star does so for smaller ones. Both
    need only the minimum of a neighbourhood, which is pre-aggregated and written, so that links meet it in a plain join of
    two exchanges: Spark splits that join where a hub has very many links (adaptive skew join), and a hub that is the least of
    its neighbourhood has nothing to fetch.
    Rounds stop when no link changes; ``most_rounds`` is far above the logarithm of any node count and only guards
    against an endless loop (it raises). Null ends and self links are ignored; no links give an empty table.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct()
    edges = checkpoint(edges)
    before = None
    for _ in range(most_rounds):
        # large star: every neighbour above a node goes to the least of the node's closed neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("k"), "m"))
        large = edges.join(least, edges["v"] == least["k"], "left").select("u", F.coalesce("m", "v").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1").select(F.col("u").alias("k"), "m"))
        joined = large.join(least, large["u"] == least["k"], "left").select("u", "v", F.coalesce("m", "v").alias("m"))
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now[0] == now[2] and before == tuple(now):
            break
        if now[0] == 0:
            break
        # every node has one parent and no parent is itself a child: stars, nothing left to do
        if now[0] == now[2] and edges.join(edges.select(F.col("v").alias("w")).distinct(), edges["u"] == F.col("w"), "left_semi").isEmpty():
            break
        before = tuple(now)
    else:
        raise RuntimeError("links did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
