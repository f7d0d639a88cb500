"""Anomaly scores of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small polarity table (a sentiment library is not available).
POLARITY = {"accepted": 0.5, "success": 0.6, "opened": 0.3, "good": 0.7, "failed": -0.6, "failure": -0.6, "error": -0.5, "invalid": -0.5, "denied": -0.6, "attack": -0.8, "purchase": 0.4, "signup": 0.3, "view": 0.1, "click": 0.1}


def scores(properties: DataFrame) -> DataFrame:
    """members * frequency / (all members * all frequency) * rate."""
    total = properties.agg(F.sum("members").alias("sm"), F.sum("frequency").alias("sf"))
    value = F.try_divide(F.col("members") * F.col("frequency"), F.col("sm") * F.col("sf")) * F.col("rate")
    return properties.join(F.broadcast(total)).select("cluster_id", F.coalesce(value, F.lit(0.0)).alias("score"))


def _scaled(rows: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    span = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    share = F.coalesce(F.try_divide(F.col(column) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    value = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise(low + share * (high - low))
    return rows.join(F.broadcast(span)).withColumn(name, value).drop("lo", "hi")


def transformed(rows: DataFrame) -> DataFrame:
    """Min-max, then -4 s^2 + 4 s, then to [-1, 1]; a range of zero gives 0."""
    one = _scaled(rows, "score", 0.0, 1.0, "s").withColumn("quadratic", -4 * F.col("s") * F.col("s") + 4 * F.col("s"))
    return _scaled(one, "quadratic", -1.0, 1.0, "normalised").select("cluster_id", F.round("quadratic", 6).alias("quadratic"), F.round("normalised", 6).alias("normalised"))


def polarity(tokens: Column) -> Column:
    """Mean polarity of the known words, 0 if there is none."""
    table = F.create_map(*[x for k, v in POLARITY.items() for x in (F.lit(k), F.lit(v))])
    known = F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, t)))
    return F.when(F.size(known) == 0, F.lit(0.0)).otherwise(F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def decisions(rows: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """``attack`` below zero, else ``normal``; with sentiment, the mean of both decides."""
    value = F.col("normalised")
    if sentiment is not None:
        rows, value = rows.join(sentiment, "cluster_id", "left"), (F.col("normalised") + F.coalesce("polarity", F.lit(0.0))) / 2
    return rows.select("cluster_id", F.round(value, 6).alias("final_score"), F.when(value < 0, "attack").otherwise("normal").alias("decision"))
