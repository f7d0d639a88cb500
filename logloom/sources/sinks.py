"""Sinks: each builds the lines or rows of an output, ``save`` writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_line(lines: DataFrame, membership: DataFrame, names: DataFrame) -> DataFrame:
    """``cluster; label; raw`` for each line; a cluster without a name is ``undefined``."""
    joined = lines.join(membership, "line_id").join(names, "cluster_id", "left")
    return joined.select("line_id", F.concat_ws("; ", F.col("cluster_id").cast("string"), F.coalesce("label", F.lit("undefined")), "raw").alias("out"))


def per_cluster(lines: DataFrame, membership: DataFrame, with_id: bool = False) -> DataFrame:
    """Lines by cluster, with their ids if wanted."""
    joined = lines.join(membership, "line_id")
    text = F.concat_ws(", ", F.col("line_id").cast("string"), "raw") if with_id else F.col("raw")
    return joined.select("cluster_id", "line_id", text.alias("out"))


def abstraction_per_line(lines: DataFrame, abstractions: DataFrame, keys: list[str]) -> DataFrame:
    """``line_id, abstraction``: the template of each line's group; null for a line whose group has none."""
    return lines.join(abstractions.select(*keys, F.col("template").alias("abstraction")), keys, "left").select("line_id", "abstraction")


def node_distances(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """``node_id, cluster_id, other, distance``: the distances of each node to the nodes of each cluster, 1 - weight."""
    both = pairs.selectExpr("src node_id", "dst other", "weight").unionByName(pairs.selectExpr("dst node_id", "src other", "weight"))
    named = both.join(membership.selectExpr("node_id other", "cluster_id"), "other")
    return named.select("node_id", "cluster_id", "other", F.round(1 - F.col("weight"), 3).alias("distance"))


def anomaly_per_line(lines: DataFrame, membership: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decision; raw`` for each line."""
    return lines.join(membership, "line_id").join(decisions, "cluster_id").select("line_id", F.concat_ws("; ", "decision", "raw").alias("out"))


def evaluation_report(quality: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each file, one column for each metric."""
    return quality.groupBy("file").pivot("metric", metrics).agg(F.first("value"))


def dot_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.concat(F.col("src").cast("string"), F.lit(" -- "), F.col("dst").cast("string"), F.lit(" [weight="), F.format_string("%.3f", "weight"), F.lit("];")).alias("out"))


def graph_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a graph event stream: add-node and add-edge events as JSON."""
    an = nodes.select(F.to_json(F.struct(F.create_map(F.col("node_id").cast("string"), F.struct(F.col("event").alias("label"))).alias("an"))).alias("out"))
    ae = edges.select(F.concat(F.lit('{"ae":{"'), "src", F.lit("-"), "dst", F.lit('":{"source":"'), "src", F.lit('","target":"'), "dst", F.lit('","directed":false}}}')).alias("out"))
    return an.unionByName(ae)


def node_styles(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Size and a colour by cluster for each node; the colour is a hash, not chance."""
    colour = F.substring(F.md5(F.col("cluster_id").cast("string")), 1, 6)
    return nodes.join(clusters, "node_id").select("node_id", "frequency", "cluster_id", colour.alias("colour"))


def save(out: DataFrame, path: str, kind: str = "parquet", partitions: list[str] | None = None) -> None:
    """Write rows; text sinks take the column ``out``."""
    writer = (out.select("out") if kind == "text" else out).write.mode("overwrite")
    if partitions and kind != "text":
        writer = writer.partitionBy(*partitions)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)


def save_distances(distances: DataFrame, path: str) -> None:
    """Write ``node_distances`` as CSV files with a header."""
    distances.select("node_id", "cluster_id", "other", "distance").write.mode("overwrite").csv(path, header=True)
