"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenbib.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a grouped minimum
    plus a join on the node, so no component is ever gathered in one task, and the number of rounds is
    logarithmic in the component size. Each round is checkpointed; it ends when no edge changes.
    Null ends are dropped, self loops keep their node, repeated edges count once. An empty table gives
    an empty result.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    cur = cut(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node are hung on the least node around it.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: neighbours at or below a node are hung on their minimum.
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = cut(small)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    members = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(
        members.union(roots).select("node").distinct(), "node", "left_anti"
    )
    return members.union(roots).distinct().union(alone)
