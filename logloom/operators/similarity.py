"""Similarity of event texts, all pairs by an inverted index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_cosine(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Cosine of two texts as a corpus of two: a term that the other text contains weighs tf, else tf (1 + ln 2)."""

    def weights(tokens: Column, other: Column) -> Column:
        n = F.size(tokens)
        return F.transform(F.array_sort(F.array_distinct(tokens)), lambda t: F.struct(t.alias("t"), (F.size(F.filter(tokens, lambda x: x == t)) / n * F.when(other.contains(t), 1.0).otherwise(1 + math.log(2))).alias("w")))

    wa, wb = weights(ta, b), weights(tb, a)
    both = F.aggregate(wa, F.lit(0.0), lambda s, x: s + x["w"] * F.aggregate(F.filter(wb, lambda y: y["t"] == x["t"]), F.lit(0.0), lambda r, y: r + y["w"]))
    na, nb = (F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])) for w in (wa, wb))
    return F.round(F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(both / (na * nb)), 3)


def similar_pairs(events: DataFrame, threshold: float = 0.0, key: str = "node_id", text: str = "event") -> DataFrame:
    """``src, dst, weight`` with src < dst and a pair cosine above the threshold.

    A cosine above 0 needs a whole word in common, so pairs come from an
    equi-join on words; each pair is weighed once.
    """
    tokens = events.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).where("word <> ''")
    left, right = tokens.withColumnRenamed(key, "src"), tokens.withColumnRenamed(key, "dst")
    pairs = left.join(right, "word").where("src < dst").select("src", "dst").distinct()
    a, b = events.select(F.col(key).alias("src"), F.col(text).alias("a")), events.select(F.col(key).alias("dst"), F.col(text).alias("b"))
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    weighed = pairs.join(a, "src").join(b, "dst").select("src", "dst", pair_cosine(F.col("a"), F.col("b"), split(F.col("a")), split(F.col("b"))).alias("weight"))
    return weighed.where(F.col("weight") > threshold)


def vector_cosine(weights: DataFrame, norms: DataFrame, key: str = "node_id", threshold: float = 0.0) -> DataFrame:
    """``src, dst, weight``: cosine of term vectors that share a term."""
    left, right = weights.select(F.col(key).alias("src"), "term", F.col("w").alias("wa")), weights.select(F.col(key).alias("dst"), "term", F.col("w").alias("wb"))
    dots = left.join(right, "term").where("src < dst").groupBy("src", "dst").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = norms.select(F.col(key).alias("src"), F.col("norm").alias("na")), norms.select(F.col(key).alias("dst"), F.col("norm").alias("nb"))
    cosine = F.round(F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)), 3)
    return dots.join(na, "src").join(nb, "dst").select("src", "dst", cosine.alias("weight")).where(F.col("weight") > threshold)


def cluster_distances(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """``node_id, cluster_id, n, mean``: distances 1 - weight from each node to each cluster, stored pairs only."""
    both = pairs.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "weight").unionByName(pairs.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "weight"))
    of = membership.select(F.col("node_id").alias("other"), "cluster_id")
    return both.join(of, "other").groupBy("node_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("weight")).alias("total"))
