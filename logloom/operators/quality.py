"""Quality of clusterings: internal indices and measures against a ground truth."""

from __future__ import annotations

import math
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .events import centroids, contained, terms
from .similarity import pair_cosine


def text_distance(a: Column, b: Column) -> Column:
    """0.1 for equal texts, else 1 - cosine, to three places."""
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    return F.round(F.when(a == b, F.lit(0.1)).otherwise(1 - pair_cosine(a, b, split(a), split(b))), 3)


def calinski_harabasz(rows: DataFrame, cluster: str = "cluster_id", order: str = "line_id", text: str = "event") -> DataFrame:
    """Between over within dispersion around token-set centroids; 0 where it is undefined."""
    own = centroids(rows, cluster, order, text)
    whole = centroids(rows.withColumn("all", F.lit(0)), "all", order, text).select(F.col("centroid").alias("whole"))
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    between = own.join(sizes, cluster).join(F.broadcast(whole)).agg(F.sum(F.col("n") * F.pow(text_distance(F.col("centroid"), F.col("whole")), 2)).alias("b"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    inner = rows.groupBy(cluster, text).agg(F.count(F.lit(1)).alias("m")).join(own, cluster)
    within = inner.agg(F.sum(F.col("m") * F.pow(text_distance(F.col(text), F.col("centroid")), 2)).alias("w"))
    ratio = F.try_divide(F.try_divide("b", F.col("k") - 1), F.try_divide("w", F.col("total") - F.col("k")))
    return between.join(within).select(F.round(F.coalesce(ratio, F.lit(0.0)), 3).alias("value"))


def davies_bouldin(rows: DataFrame, cluster: str = "cluster_id", order: str = "line_id", text: str = "event") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d(c_i, c_j); cluster pairs are few."""
    own = centroids(rows, cluster, order, text)
    inner = rows.groupBy(cluster, text).agg(F.count(F.lit(1)).alias("m")).join(own, cluster)
    spread = inner.groupBy(cluster).agg((F.sum(F.col("m") * text_distance(F.col(text), F.col("centroid"))) / F.sum("m")).alias("s")).join(own, cluster)
    a, b = spread.select(F.col(cluster).alias("i"), F.col("s").alias("si"), F.col("centroid").alias("ci")), spread.select(F.col(cluster).alias("j"), F.col("s").alias("sj"), F.col("centroid").alias("cj"))
    ratio = F.round(F.coalesce(F.try_divide(F.col("si") + F.col("sj"), text_distance(F.col("ci"), F.col("cj"))), F.lit(0.0)), 3)
    worst = a.join(b, F.col("i") != F.col("j")).groupBy("i").agg(F.max(ratio).alias("r"))
    return worst.agg(F.round(F.coalesce(F.avg("r"), F.lit(0.0)), 3).alias("value"))


def graph_silhouette(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Silhouette with distance 1 - weight over the edges there are; singletons count 1; macro average over clusters."""
    both = edges.selectExpr("src n", "dst o", "weight").unionByName(edges.selectExpr("dst n", "src o", "weight"))
    d = both.join(membership.selectExpr("node_id n", "cluster_id cn"), "n").join(membership.selectExpr("node_id o", "cluster_id co"), "o")
    to = d.groupBy("n", "cn", "co").agg(F.avg(F.round(1 - F.col("weight"), 3)).alias("d"))
    ab = to.groupBy("n", "cn").agg(F.coalesce(F.max(F.when(F.col("cn") == F.col("co"), F.col("d"))), F.lit(0.0)).alias("a"), F.coalesce(F.min(F.when((F.col("cn") != F.col("co")) & (F.col("d") != 0), F.col("d"))), F.lit(0.0)).alias("b"))
    sizes = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    all_ = membership.join(sizes, "cluster_id").join(ab.selectExpr("n node_id", "a", "b"), "node_id", "left")
    s = F.when(F.col("size") == 1, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return all_.select("cluster_id", s.alias("s")).groupBy("cluster_id").agg(F.avg("s").alias("s")).agg(F.round(F.coalesce(F.avg("s"), F.lit(-1.0)), 3).alias("value"))


def graph_dunn(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Least distance between clusters over the largest inside one (1 where there is none)."""
    d = edges.join(membership.selectExpr("node_id src", "cluster_id c1"), "src").join(membership.selectExpr("node_id dst", "cluster_id c2"), "dst").select((F.col("c1") == F.col("c2")).alias("inside"), F.round(1 - F.col("weight"), 3).alias("d"))
    sep, comp = F.coalesce(F.min(F.when(~F.col("inside") & (F.col("d") != 0), F.col("d"))), F.lit(1.0)), F.max(F.when(F.col("inside"), F.col("d")))
    return d.agg(F.round(sep / F.when(F.coalesce(comp, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(comp), 3).alias("value"))


def pair_silhouette(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """The silhouette over the pairs of texts that are stored (similarity above 0); 0 where there is no second cluster."""
    several = membership.agg((F.min("cluster_id") < F.max("cluster_id")).alias("several"))
    return graph_silhouette(pairs, membership).join(several).select(F.when(F.col("several"), F.col("value")).otherwise(0.0).alias("value"))


def pair_dunn(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Dunn's index over the pairs of texts that are stored (similarity above 0)."""
    return graph_dunn(pairs, membership)


#: Internal indices by name, and whether they are computed from rows with texts or from edges and a membership.
INTERNAL = {
    "calinski_harabasz": (calinski_harabasz, False),
    "davies_bouldin": (davies_bouldin, False),
    "graph_silhouette": (graph_silhouette, True),
    "graph_dunn": (graph_dunn, True),
    "pair_silhouette": (pair_silhouette, True),
    "pair_dunn": (pair_dunn, True),
}


def internal(metrics: list[str], rows: DataFrame | None = None, edges: DataFrame | None = None, membership: DataFrame | None = None) -> DataFrame:
    """``metric, value`` of the chosen indices; an unknown name, no name, or a missing input is an error."""
    unknown = sorted(set(metrics) - set(INTERNAL))
    if unknown or not metrics:
        raise ValueError(f"unknown metrics {unknown}; known: {sorted(INTERNAL)}")
    out = None
    for name in dict.fromkeys(metrics):
        measure, on_graph = INTERNAL[name]
        inputs = (edges, membership) if on_graph else (rows,)
        if any(x is None for x in inputs):
            raise ValueError(f"{name} needs {'edges and a membership' if on_graph else 'rows'}")
        one = measure(*inputs).select(F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def contingency(rows: DataFrame, truth: str, found: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("t"), F.col(found).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _margins(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.groupBy("t").agg(F.sum("n").alias("a")), cells.groupBy("p").agg(F.sum("n").alias("b"))


def pair_counts(cells: DataFrame) -> DataFrame:
    """Pairs in common cells, in common rows, in common columns, and in all."""
    rows, cols = _margins(cells)
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    return cells.agg(two("n").alias("both"), F.sum("n").alias("total")).join(rows.agg(two("a").alias("rows"))).join(cols.agg(two("b").alias("cols")))


def adjusted_rand(rows: DataFrame, truth: str, found: str) -> DataFrame:
    p = pair_counts(contingency(rows, truth, found))
    chance = F.col("rows") * F.col("cols") / (F.col("total") * (F.col("total") - 1) / 2)
    value = F.try_divide(F.col("both") - chance, (F.col("rows") + F.col("cols")) / 2 - chance)
    return p.select(F.round(F.coalesce(value, F.lit(1.0)), 6).alias("value"))


def fowlkes_mallows(rows: DataFrame, truth: str, found: str) -> DataFrame:
    p = pair_counts(contingency(rows, truth, found))
    return p.select(F.round(F.coalesce(F.try_divide("both", F.sqrt(F.col("rows") * F.col("cols"))), F.lit(0.0)), 6).alias("value"))


def information(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Entropies of both sides and mutual information, in nats."""
    cells = contingency(rows, truth, found)
    a, b = _margins(cells)
    total = cells.agg(F.sum("n").alias("total"))
    full = cells.join(a, "t").join(b, "p").join(F.broadcast(total))
    n, x, y, t = (F.col(c) for c in ("n", "a", "b", "total"))
    mutual = full.agg(F.sum(n / t * F.log(n * t / (x * y))).alias("mi"))
    ht = a.join(F.broadcast(total)).agg(F.sum(-x / t * F.log(x / t)).alias("h_t"))
    hp = b.join(F.broadcast(total)).agg(F.sum(-y / t * F.log(y / t)).alias("h_p"))
    return mutual.join(ht).join(hp)


def normalised_mutual_information(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Geometric normaliser."""
    return information(rows, truth, found).select(F.round(F.coalesce(F.try_divide("mi", F.sqrt(F.col("h_t") * F.col("h_p"))), F.lit(1.0)), 6).alias("value"))


def v_measure(rows: DataFrame, truth: str, found: str) -> DataFrame:
    i = information(rows, truth, found)
    h, c = F.coalesce(F.try_divide("mi", "h_t"), F.lit(1.0)), F.coalesce(F.try_divide("mi", "h_p"), F.lit(1.0))
    return i.select(F.round(h, 6).alias("homogeneity"), F.round(c, 6).alias("completeness"), F.round(F.coalesce(F.try_divide(2 * h * c, h + c), F.lit(0.0)), 6).alias("v_measure"))


def adjusted_mutual_information(rows: DataFrame, truth: str, found: str, average: str = "max") -> float:
    """Mutual information less its expectation by chance; margins (not rows) come to the driver."""
    cells = contingency(rows, truth, found)
    a, b = _margins(cells)
    x, y = ([r[1] for r in m.collect()] for m in (a, b))
    n = sum(x)
    r = information(rows, truth, found).first()
    expected = 0.0
    for i in x:
        for j in y:
            for k in range(max(1, i + j - n), min(i, j) + 1):
                p = lgamma(i + 1) + lgamma(j + 1) + lgamma(n - i + 1) + lgamma(n - j + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(i - k + 1) - lgamma(j - k + 1) - lgamma(n - i - j + k + 1)
                expected += k / n * log(n * k / (i * j)) * exp(p)
    top = max(r["h_t"], r["h_p"]) if average == "max" else (r["h_t"] + r["h_p"]) / 2
    return (r["mi"] - expected) / (top - expected) if top != expected else 1.0


def confusion(rows: DataFrame, truth: str, found: str, positive: str = "normal", negative: str = "attack") -> DataFrame:
    """Counts and rates; the positive class is the normal one; 0 where a rate is undefined."""
    t, f = F.col(truth), F.col(found)
    counts = rows.agg(*(F.count_if((t == x) & (f == y)).alias(n) for n, x, y in (("tp", positive, positive), ("fn", positive, negative), ("fp", negative, positive), ("tn", negative, negative))))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    c = F.col
    return counts.select("tp", "fn", "fp", "tn", rate(c("tn"), c("tn") + c("fp")).alias("specificity"), rate(c("tp"), c("tp") + c("fp")).alias("precision"), rate(c("tp"), c("tp") + c("fn")).alias("recall"), rate(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")).alias("accuracy"))


def dominant_labels(lines: DataFrame, phrases: list[str], cluster: str = "cluster_id", raw: str = "raw") -> DataFrame:
    """``cluster, label``: the phrase that most distinct lines contain; a phrase belongs to the cluster with more of them."""
    low = lines.select(cluster, F.lower(raw).alias("low")).distinct()
    hits = low.select(cluster, F.explode(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col("low"), p))).alias("label")).groupBy(cluster, "label").agg(F.count(F.lit(1)).alias("n"))
    best = hits.groupBy(cluster).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select(cluster, F.col("b.label").alias("label"), (-F.col("b.n")).alias("n"))
    owner = best.groupBy("label").agg(F.min(F.struct((-F.col("n")).alias("n"), cluster)).alias("o")).select("label", F.col(f"o.{cluster}").alias("owner"))
    named = best.join(owner, "label").where(F.col(cluster) == F.col("owner")).select(cluster, "label")
    return lines.select(cluster).distinct().join(named, cluster, "left").select(cluster, F.coalesce("label", F.lit("undefined")).alias("label"))


def xie_beni(rows: DataFrame, cluster: str = "cluster_id", order: str = "line_id", text: str = "event") -> DataFrame:
    """Sum of squared similarities to the centroid over the lines times the least squared similarity of centroids.

    A centroid is all texts of a cluster end to end, so it is kept as counts of
    its words and never built; their ``order`` does not matter. In the cosine of
    a corpus of two a word weighs tf where the other text contains it, else
    tf (1 + ln 2): squared norms come from all words and from those contained.
    """
    split = F.filter(F.split(text, " "), lambda t: t != "")
    texts = graph.written(rows.where(F.col(cluster).isNotNull()).groupBy(cluster, text).agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id()))
    counts = texts.select(cluster, "m", F.explode(split).alias("term")).groupBy(cluster, "term").agg(F.sum("m").alias("n"))
    own = graph.written(counts.join(counts.groupBy(cluster).agg(F.sum("n").alias("all")), cluster).select(F.col(cluster).alias("a"), "term", (F.col("n") / F.col("all")).alias("tf")))
    whole = graph.written(own.groupBy("a").agg(F.sum(F.col("tf") * F.col("tf")).alias("whole")))
    vocabulary = own.select("term").distinct()
    inside = graph.written(contained(vocabulary, vocabulary.withColumnRenamed("term", "word")))
    square = (1 + math.log(2)) ** 2
    norm = lambda all_, within: F.sqrt(F.col(within) + square * F.greatest(F.col(all_) - F.col(within), F.lit(0.0)))

    words = graph.written(terms(texts, split, "id").join(texts.select("id", F.col(cluster).alias("a")), "id"))
    near = words.withColumnRenamed("tf", "t").join(own, ["a", "term"]).groupBy("id").agg(F.sum(F.col("t") * F.col("tf")).alias("dot"), F.sum(F.col("t") * F.col("t")).alias("square"))
    met = words.select("id", "a", F.col("term").alias("word")).join(inside, "word").select("id", "a", "term").distinct()
    within = met.join(own, ["a", "term"]).groupBy("id", "a").agg(F.sum(F.col("tf") * F.col("tf")).alias("within"))
    # all words of a text stand in its own centroid
    scored = near.join(within, "id").join(whole, "a").select("id", F.round(F.col("dot") / (F.sqrt("square") * norm("whole", "within")), 3).alias("likeness"))
    top = texts.join(scored, "id", "left").agg(F.sum(F.col("m") * F.pow(F.coalesce("likeness", F.lit(0.0)), 2)).alias("top"), F.sum("m").alias("n"), F.countDistinct(cluster).alias("k"))

    other = own.select(F.col("a").alias("b"), "term", F.col("tf").alias("t"))
    dots = own.join(other, "term").groupBy("a", "b").agg(F.sum(F.col("tf") * F.col("t")).alias("dot"))
    held = other.select("b", F.col("term").alias("word")).join(inside, "word").select("b", "term").distinct()
    parts = graph.written(own.join(held, "term").groupBy("a", "b").agg(F.sum(F.col("tf") * F.col("tf")).alias("within")))
    both = dots.join(parts, ["a", "b"]).join(parts.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("within").alias("back")), ["a", "b"])
    sized = both.join(whole, "a").join(whole.select(F.col("a").alias("b"), F.col("whole").alias("other")), "b")
    least = sized.agg(F.min(F.round(F.col("dot") / (norm("whole", "within") * norm("other", "back")), 3)).alias("least"), F.count(F.lit(1)).alias("pairs"))
    lowest = F.when(F.col("pairs") == F.col("k") * F.col("k"), F.col("least")).otherwise(0.0)  # centroids without a common word have similarity 0
    return top.join(least).select(F.round(F.coalesce(F.try_divide("top", F.col("n") * F.pow(lowest, 2)), F.lit(0.0)), 3).alias("value"))


def text_silhouette(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """Silhouette over all pairs: pairs that are not stored have similarity 0, so sums over stored ones are enough."""
    sizes = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.selectExpr("src n", "dst o", "weight").unionByName(pairs.selectExpr("dst n", "src o", "weight"))
    near = both.join(membership.selectExpr("node_id o", "cluster_id co"), "o").groupBy("n", "co").agg(F.sum("weight").alias("w"))
    every = membership.selectExpr("node_id n", "cluster_id cn").join(F.broadcast(sizes.selectExpr("cluster_id co", "size")))  # clusters are few
    full = every.join(near, ["n", "co"], "left").withColumn("others", F.col("size") - (F.col("cn") == F.col("co")).cast("long"))
    d = full.select("n", "cn", "co", (1 - F.try_divide(F.coalesce("w", F.lit(0.0)), F.col("others"))).alias("d")).where("d is not null")
    ab = d.groupBy("n", "cn").agg(F.coalesce(F.max(F.when(F.col("cn") == F.col("co"), F.col("d"))), F.lit(0.0)).alias("a"), F.coalesce(F.min(F.when(F.col("cn") != F.col("co"), F.col("d"))), F.lit(0.0)).alias("b"))
    scored = ab.join(F.broadcast(sizes), F.col("cn") == F.col("cluster_id"))
    s = F.when(F.col("size") == 1, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return scored.select("cluster_id", s.alias("s")).groupBy("cluster_id").agg(F.avg("s").alias("s")).agg(F.round(F.coalesce(F.avg("s"), F.lit(-1.0)), 3).alias("value"))
