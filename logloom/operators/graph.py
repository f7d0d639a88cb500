"""Weighted graphs as ``edges(src, dst, weight)`` with src < dst."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset a temporary one (local mode) or one beside the warehouse."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        local = context.master.startswith("local[") or context.master == "local"
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through Parquet in the shared folder.

    A checkpoint would keep the size that was estimated for the plan behind it;
    in loops of joins the digits of that estimate double each round.
    """
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 6).alias("weighted_degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, cluster_id``: cluster_id is the least node that can be reached.

    Hooks each node onto its least neighbour, follows the pointers by doubling,
    and contracts, so the number of steps grows with logarithms, not with the
    diameter.
    """
    left = written(edges.select("src", "dst").where("src <> dst").distinct())
    labels = nodes.select("node_id", F.col("node_id").alias("cluster_id"))
    while not left.isEmpty():
        both = left.selectExpr("src n", "dst o").unionByName(left.selectExpr("dst n", "src o"))
        hook = written(both.groupBy("n").agg(F.min("o").alias("o")).select("n", F.least("n", "o").alias("to")))
        while True:  # a chain of pointers halves each time, until all point to the end of theirs
            hook = written(hook.select("n", "to").join(hook.selectExpr("n to", "to further"), "to").selectExpr("n", "further to", "further <> to moved"))
            if hook.where("moved").isEmpty():
                break
        labels = written(labels.join(hook.selectExpr("n cluster_id", "to"), "cluster_id", "left").select("node_id", F.coalesce("to", "cluster_id").alias("cluster_id")))
        a, b = hook.selectExpr("n src", "to a"), hook.selectExpr("n dst", "to b")
        left = written(left.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    return labels


def ranked(labels: DataFrame) -> DataFrame:
    """Cluster ids as ranks from 0 (one row per cluster is ranked, not per node)."""
    ids = labels.select("cluster_id").distinct().withColumn("rank", (F.row_number().over(Window.orderBy("cluster_id")) - 1).cast("long"))
    return labels.join(ids, "cluster_id").select("node_id", F.col("rank").alias("cluster_id"))


def cliques(edges: DataFrame, k: int) -> DataFrame:
    """``nodes``: all cliques of k nodes, ascending; level by level, each join needs all earlier nodes adjacent."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.select(F.array("src", "dst").alias("nodes"))
    for size in range(3, k + 1):
        grown = out.join(pairs, F.element_at("nodes", -1) == F.col("src")).select(F.concat("nodes", F.array("dst")).alias("nodes"))
        for i in range(size - 2):
            grown = grown.join(pairs, (F.col("nodes")[i] == F.col("src")) & (F.element_at("nodes", -1) == F.col("dst")), "left_semi")
        out = grown
    return out


def clique_intensity(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Geometric mean of the edge weights of each clique, to five places."""
    keyed = found.withColumn("key", F.concat_ws("-", F.transform("nodes", lambda x: x.cast("string"))))
    members = keyed.select("key", F.explode("nodes").alias("n"))
    inner = members.withColumnRenamed("n", "src").join(members.withColumnRenamed("n", "dst"), "key").where("src < dst").join(edges, ["src", "dst"])
    return inner.groupBy("key").agg(F.round(F.exp(F.avg(F.log("weight"))), 5).alias("intensity"))


def percolation(found: DataFrame, k: int) -> DataFrame:
    """Edges between cliques that share at least k - 1 nodes (cliques by their first place in node order)."""
    keyed = found.withColumn("key", F.concat_ws("-", F.transform("nodes", lambda x: x.cast("string")))).select("key", F.explode("nodes").alias("n"))
    one, two = keyed.withColumnRenamed("key", "src"), keyed.withColumnRenamed("key", "dst")
    return one.join(two, "n").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= k - 1)


def split_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges with whether both ends are in one cluster."""
    a, b = membership.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("c1")), membership.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("c2"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", (F.col("c1") == F.col("c2")).alias("inside"))


def triangles(edges: DataFrame) -> DataFrame:
    """``a, b, c`` with the weights of their three edges."""
    ab, bc, ac = (edges.selectExpr(f"src {x}", f"dst {y}", f"weight w_{x}{y}") for x, y in ("ab", "bc", "ac"))
    return ab.join(bc, "b").join(ac, ["a", "c"])


def prune_triangles(edges: DataFrame) -> DataFrame:
    """Edges that are not the weakest of any triangle (of equals, the smallest pair is the weakest)."""
    t = triangles(edges)
    weakest = F.least(F.struct(F.col("w_ab").alias("w"), F.col("a").alias("x"), F.col("b").alias("y")), *(F.struct(F.col(w).alias("w"), F.col(x).alias("x"), F.col(y).alias("y")) for w, x, y in (("w_ac", "a", "c"), ("w_bc", "b", "c"))))
    gone = t.select(weakest.alias("e")).select(F.col("e.x").alias("src"), F.col("e.y").alias("dst")).distinct()
    return edges.join(gone, ["src", "dst"], "left_anti")


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a partition: share of weight inside less the share expected by degree."""
    total = edges.agg(F.sum("weight").alias("m"))
    inner = split_edges(edges, membership).where("inside").join(membership.withColumnRenamed("node_id", "src"), "src").groupBy("cluster_id").agg(F.sum("weight").alias("inner"))
    strength = symmetric(edges).join(membership, "node_id").groupBy("cluster_id").agg(F.sum("weight").alias("strength"))
    each = strength.join(inner, "cluster_id", "left").join(F.broadcast(total))
    return each.agg(F.round(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m") - F.pow(F.col("strength") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def node_entropy(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Entropy of the share of a node's weight that stays in its cluster, to five places."""
    pairs = symmetric(edges).join(membership, "node_id").join(membership.select(F.col("node_id").alias("other"), F.col("cluster_id").alias("c2")), "other")
    share = pairs.groupBy("node_id").agg((F.sum(F.when(F.col("cluster_id") == F.col("c2"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("p"))
    p = F.col("p")
    return share.select("node_id", F.round(F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0), 5).alias("entropy"))


def label_rounds(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """Majority clustering in synchronous rounds: each node takes the label with the most weight around it (ties: least label)."""
    labels = nodes.select("node_id", F.col("node_id").alias("label"))
    both = symmetric(edges)
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node_id").alias("other"), "label"), "other").groupBy("node_id", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy("node_id").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("b")).select("node_id", F.col("b.label").alias("new"))
        labels = written(labels.join(best, "node_id", "left").select("node_id", F.coalesce("new", "label").alias("label")))
    return labels.select("node_id", F.col("label").alias("cluster_id"))


def k_clique_clusters(nodes: DataFrame, edges: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Clique percolation: nodes of cliques that are linked by k - 1 shared nodes; the rest are alone.

    A node of several communities belongs to the one with the least node.
    """
    found = cliques(edges, k)
    keyed = found.withColumn("key", F.concat_ws("-", F.transform("nodes", lambda x: x.cast("string"))))
    if threshold > 0:
        keyed = keyed.join(clique_intensity(found, edges).where(F.col("intensity") > threshold), "key", "left_semi")
    # Two k-cliques share k - 1 nodes if and only if they have such a subset in common: link the least nodes through it.
    numbered = written(keyed.select(F.xxhash64("key").alias("node_id"), "nodes"))
    subsets = numbered.select("node_id", F.posexplode("nodes").alias("i", "n"), "nodes").select("node_id", F.concat_ws("-", F.array_sort(F.array_remove("nodes", F.col("n")))).alias("part"))
    star = subsets.join(subsets.groupBy("part").agg(F.min("node_id").alias("src")), "part").select("src", F.col("node_id").alias("dst")).where("src <> dst")
    communities = components(numbered.select("node_id"), star)
    members = numbered.join(communities, "node_id").select(F.explode("nodes").alias("n"), "cluster_id")
    least = members.groupBy("cluster_id").agg(F.min("n").alias("least"))
    return nodes.join(members.join(least, "cluster_id").groupBy("n").agg(F.min("least").alias("least")).withColumnRenamed("n", "node_id"), "node_id", "left").select("node_id", F.coalesce("least", "node_id").alias("cluster_id"))


def distances_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``node_id, distance`` from the nearest source over 1 - weight, by relaxation until no distance falls."""
    both = written(symmetric(edges).select("node_id", "other", F.round(1 - F.col("weight"), 3).alias("step")))
    best = front = written(sources.select("node_id", F.lit(0.0).alias("distance")))
    while not front.isEmpty():
        reached = front.join(both, "node_id").groupBy(F.col("other").alias("node_id")).agg(F.round(F.min(F.col("distance") + F.col("step")), 6).alias("reached"))
        front = written(reached.join(best, "node_id", "left").where("distance is null or reached < distance").select("node_id", F.col("reached").alias("distance")))
        best = written(best.unionByName(front).groupBy("node_id").agg(F.min("distance").alias("distance")))
    return best.select("node_id", F.round("distance", 3).alias("distance"))


def density_clusters(nodes: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """Density clustering over ``near(src, dst)`` pairs: cores have ``least`` neighbours (themselves included).

    Cores that are near each other are one cluster, a border node joins its
    least core's cluster, noise is alone.
    """
    both = near.selectExpr("src node_id", "dst other").unionByName(near.selectExpr("dst node_id", "src other"))
    cores = written(both.groupBy("node_id").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= least).select("node_id"))
    inner = near.join(cores.withColumnRenamed("node_id", "src"), "src", "left_semi").join(cores.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    found = written(components(cores, inner.select("src", "dst")))
    border = both.join(cores, "node_id", "left_anti").join(found.select(F.col("node_id").alias("other"), "cluster_id"), "other").groupBy("node_id").agg(F.min(F.struct("other", "cluster_id")).alias("b")).select("node_id", F.col("b.cluster_id").alias("cluster_id"))
    return nodes.select("node_id").join(found.unionByName(border), "node_id", "left").select("node_id", F.coalesce("cluster_id", "node_id").alias("cluster_id"))
