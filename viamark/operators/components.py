"""Connected components of an edge list, by large-star and small-star rounds.

Each round groups and joins on one end of the edges, so that a node with very many edges
is split between tasks by the skew join. Tables between rounds are written out: lineage
stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viamark.plans.tables import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of every node to the smallest of them (and of itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    tied = both.join(least.hint("merge"), "a")
    if large:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (two integer columns a, b): root is its component's smallest node.

    Loops and repeated edges do no harm; an empty table gives no rows. Labels only fall, so
    rounds end.
    """
    found = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        found = stage(_star(_star(found, large=True), large=False), "edges")
        now = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = found.groupBy("b").agg(F.lit(0)).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
