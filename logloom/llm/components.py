"""Connected components with DataFrame operations only (distributed union-find).

Each round hooks every node onto its least neighbour, halves the pointer
chains until they are flat, and contracts the edges onto their ends; edges inside
one set vanish, so the edge table shrinks until it is empty.  Hubs are harmless:
least neighbours are partial aggregates, and the joins that look pointers up
have a written table on their other side, so that Spark can split hot keys.

Tables between rounds are Parquet, not checkpoints: a checkpoint keeps the
size that was estimated for the joins behind it, which squares each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the least node that can be reached.

    Loops, repeated edges and nulls are allowed (an edge with a null end links
    nothing); without edges the result is empty.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = stored(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("to")))
        hook = first
        while True:  # a chain of pointers halves each time, until all point to the end of theirs
            nxt = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stored(hook.select("node", "to").join(nxt, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            discard(hook)
            hook = jumped
            if hook.where("moved").isEmpty():
                break
        left, right = hook.select(F.col("node").alias("a"), F.col("to").alias("ra")), hook.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        rest = stored(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(edges)
        edges = rest
        if found is None:
            found = hook.select("node", F.col("to").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), "to")
            found, old = stored(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))), found
            discard(old, hook)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
