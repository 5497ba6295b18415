"""Connected components by alternating large-star and small-star steps, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.session import cut


def _star(neighbours: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's (larger) neighbours to the smallest node around it.

    The minimum is a grouping that combines before the shuffle; the links go back to it in a join whose hot keys
    Spark can split.
    """
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = neighbours.join(least, "u")
    if larger_only:
        linked = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return linked.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two bigint columns a, b); component is the smallest node.

    Each round is written to the shared folder, so a lost executor costs one round.  Rounds grow with the logarithm
    of the longest path.  Loops and repeated edges count once; no edges give no rows.
    """
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("s"),
            F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        ).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v")
            ).distinct()
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(both, larger_only=True)
        now = cut(_star(now.select("u", "v"), larger_only=False))
