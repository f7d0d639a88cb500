"""Further registered queries: graph distances, density clusters, sweeps and the rest of the sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import strings as st
from logloom.functions import text as tx
from logloom.operators import events as ev
from logloom.operators import graph, kernels, quality
from logloom.operators import similarity as sim
from logloom.operators import tokens as tk

from .queries import _BRAND, _MEM, _NODES, _SIZED, _brands, _edges, _fives, _graph_query, _nodes, _orders, _table, query


@query("agg_19_by_first_pattern", f"with {_SIZED} select l[1] as first, len(l) as n_words, count(*) as n from r group by 1, 2")
def agg_19(s, d):
    return _orders(s, d).groupBy(F.col("tokens")[0].alias("first"), F.size("tokens").alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


@_graph_query("agg_18_degree_rank", "dg as (select n node_id, count(*) degree from sy group by 1) select node_id, degree, rank() over (order by degree desc) as rank from dg")
def agg_18(s, d):
    g = graph.written(graph.degrees(_edges(s, d)).select("node_id", "degree"))
    above = g.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))  # few distinct degrees, so ranks come from their counts
    rank = above.alias("a").join(above.alias("b"), F.expr("b.degree > a.degree"), "left").groupBy("a.degree").agg((F.coalesce(F.sum("b.n"), F.lit(0)) + 1).alias("rank"))
    return g.join(rank, "degree").select("node_id", "degree", "rank")


_VEC = f"{_NODES}, tk as (select node_id, t, count(*) / any_value(n) tf from (select node_id, unnest(string_split(event, ' ')) t, len(string_split(event, ' ')) n from nodes) group by 1, 2), df as (select t, count(*) df from tk group by 1), w as (select node_id, t, tf * (1 + ln((select count(*) from nodes)::double / df)) w from tk join df using (t)), nm as (select node_id, sqrt(sum(w * w)) n from w group by 1)"


@query("sim_01_vector_cosine", f"with {_VEC}, dt as (select a.node_id src, b.node_id dst, sum(a.w * b.w) d from w a join w b on a.t = b.t and a.node_id < b.node_id group by 1, 2) select src, dst, round(d / (x.n * y.n), 3) as weight from dt join nm x on x.node_id = src join nm y on y.node_id = dst where round(d / (x.n * y.n), 3) > 0.3")
def sim_01(s, d):
    nodes = _nodes(s, d)
    table = ev.terms(nodes, F.split("event", " "))
    df = table.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = graph.written(ev.tf_idf(table, df, nodes.count()))
    return sim.vector_cosine(w, ev.norms(w), threshold=0.3)


@_graph_query("sim_05_cluster_distances", f"{_MEM} select n as node_id, cluster_id, count(*) as n, round(sum(1 - weight), 6) as total from sy join m on m.node_id = o group by 1, 2")
def sim_05(s, d):
    return sim.cluster_distances(_edges(s, d), _fives(s, d)).select("node_id", "cluster_id", "n", F.round("total", 6).alias("total"))


@_graph_query("sim_06_master_distances", "z as (select 1) select src, dst, round(1 - weight, 3) as distance from edges")
def sim_06(s, d):
    return _edges(s, d).select("src", "dst", F.round(1 - F.col("weight"), 3).alias("distance"))


@query("sim_13_template_by_subsequence")
def sim_13(s, d):
    nodes = _nodes(s, d).select("node_id", F.split("event", " ").alias("tokens"))
    types = ev.numbered(_table(s, d, "part").select(F.lower("p_type").alias("type")).distinct(), "type", "template_id")
    scored = nodes.join(types.select("template_id", F.split("type", " ").alias("t")), F.lit(True)).select("node_id", "template_id", F.size(st.common_subsequence_udf("tokens", "t")).alias("n"))
    return scored.groupBy("node_id").agg(F.max(F.struct("n", "template_id")).alias("b")).select("node_id", F.col("b.template_id").alias("template_id"))


@_graph_query("gra_05_induced_subgraph", "z as (select 1) select src, dst, weight from edges where src in (select node_id from nodes where frequency > 5) and dst in (select node_id from nodes where frequency > 5)")
def gra_05(s, d):
    few = _nodes(s, d).where("frequency > 5").select("node_id")
    return _edges(s, d).join(few.withColumnRenamed("node_id", "src"), "src", "left_semi").join(few.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


@_graph_query("gra_08_neighbours", "z as (select 1) select n as node_id, string_agg(o, ',' order by o) as neighbours from sy group by 1")
def gra_08(s, d):
    return graph.symmetric(_edges(s, d)).groupBy("node_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string"))).alias("neighbours"))


@_graph_query("gra_15_cluster_attribute", f"{_MEM} select src as node_id, max(greatest(a.cluster_id, b.cluster_id)) as cluster_id from edges join m a on a.node_id = src join m b on b.node_id = dst group by 1")
def gra_15(s, d):
    m = _fives(s, d)
    joined = _edges(s, d).join(m.selectExpr("node_id src", "cluster_id a"), "src").join(m.selectExpr("node_id dst", "cluster_id b"), "dst")
    return joined.groupBy(F.col("src").alias("node_id")).agg(F.max(F.greatest("a", "b")).alias("cluster_id"))


#: Edges of the longest path that the SQL follows; the query itself goes on until no distance falls.
_LONGEST = 12
_HOPS = "dg as (select n, count(*) c from sy group by 1), d0 as (select n node_id, 0.0::double d from dg where c = (select max(c) from dg))" + "".join(f", d{i + 1} as (select node_id, min(d) d from (select * from d{i} union all select sy.o, d{i}.d + round(1 - weight, 3) from d{i} join sy on sy.n = d{i}.node_id) group by 1)" for i in range(_LONGEST))


@_graph_query("gra_18_path_distances", f"{_HOPS} select node_id, round(d, 3) as distance from d{_LONGEST}")
def gra_18(s, d):
    edges = graph.written(_edges(s, d))
    degrees = graph.written(graph.degrees(edges))
    centres = degrees.join(F.broadcast(degrees.agg(F.max("degree").alias("degree"))), "degree").select("node_id")
    return graph.distances_from(edges, centres)


for _name, _kernel in (
    ("gra_16_min_cut_sides", kernels.cut_sides),
    ("clu_04_maximal_cliques", kernels.maximal_clique_clusters),
    ("clu_05_weighted_maximal_cliques", lambda g: kernels.maximal_clique_clusters(g, 3, 0.55)),
    ("clu_09_refined_neighbour", kernels.refined_neighbour),
    ("clu_15_recursive_louvain", kernels.recursive_louvain),
    ("tok_10_forward_groups", lambda g: kernels.forward_groups([(a, b) for a in g for b in g[a] if a < b], list(g))),
):
    query(_name)(lambda s, d, k=_kernel: kernels.per_component(_nodes(s, d), graph.written(_edges(s, d)), k))


@_graph_query("tok_24_density_clusters", None)
def tok_24(s, d):
    return graph.density_clusters(_nodes(s, d), graph.written(_edges(s, d).select("src", "dst")), 3)


@query("tok_04_cardinalities", f"with {_SIZED}, p as (select len(l) part, unnest(l) w, unnest(range(len(l))) i from r), c as (select part, i, count(distinct w) card from p group by 1, 2) select part, card, count(*) as places, min(i) as first from c group by 1, 2")
def tok_04(s, d):
    return tk.position_cardinalities(tk.by_count(_orders(s, d)))


@query("tok_04_goodness", f"with {_SIZED}, p as (select len(l) part, unnest(l) w, unnest(range(len(l))) i from r), c as (select part, i, count(distinct w) card from p group by 1, 2) select part, round(sum(case when card = 1 then 1 else 0 end) / count(*), 6) as goodness from c group by 1")
def tok_04_goodness(s, d):
    return tk.goodness(tk.by_count(_orders(s, d)))


@query("tok_05_split_rank", "select event_type, case when count(distinct user_id) / count(*) <= 0.25 then 2 else 1 end as rank from events group by 1")
def tok_05(s, d):
    e = _table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("c"), F.count(F.lit(1)).alias("n"))
    return e.select("event_type", tk.split_rank(F.lit("1-M"), F.col("c"), F.col("n")).alias("rank"))


@query("tok_09_two_means")
def tok_09(s, d):
    return s.createDataFrame([(tk.two_means(_table(s, d, "events"), "value"),)], "threshold double")


@query("tok_13_entropy", f"with {_SIZED}, p as (select len(l) part, unnest(l) w, unnest(range(len(l))) i from r), n as (select part, i pos, w, count(*) n from p group by 1, 2, 3), k as (select part, pos, count(*) k from n group by 1, 2) select part, pos, round(sum(-(n / k) * ln(n / k)), 6) as entropy from n join k using (part, pos) group by 1, 2")
def tok_13(s, d):
    return tk.token_entropy(tk.by_count(_orders(s, d)))


@query("tok_21_support_sweep", f"with {_SIZED}, f as (select u w, count(*) n from (select unnest(l) u from r) group by 1), g as (select unnest(range(10, 100, 10)) percent) select percent, count(*) filter (n >= floor(percent * (select count(*) from r) / 100)) as words from f, g group by 1")
def tok_21(s, d):
    rows = graph.written(_orders(s, d))
    return tk.support_sweep(rows, list(range(10, 100, 10)), rows.count())


@query("int_01_text_distance", f"with {_NODES} select a.node_id as a, a.node_id as b, 0.1 as distance from nodes a")
def int_01(s, d):
    n = _nodes(s, d)
    return n.select(F.col("node_id").alias("a"), F.col("node_id").alias("b"), quality.text_distance(F.col("event"), F.col("event")).alias("distance"))


def _sharing(s, d):
    """``a, b, ta, tb``: all pairs a < b of nodes that share a word, with their texts; pairs that share none have distance 1."""
    n = graph.written(_nodes(s, d).select("node_id", "event"))
    words = n.select("node_id", F.explode(F.array_distinct(F.split("event", " "))).alias("word")).where("word <> ''")
    pairs = words.selectExpr("node_id a", "word").join(words.selectExpr("node_id b", "word"), "word").where("a < b").select("a", "b").distinct()
    return pairs.join(n.selectExpr("node_id a", "event ta"), "a").join(n.selectExpr("node_id b", "event tb"), "b")


@_graph_query("int_01_text_distance_pairs", "z as (select 1) select src as a, dst as b, round(1 - weight, 3) as distance from sims")
def int_01_pairs(s, d):
    return _sharing(s, d).select("a", "b", quality.text_distance(F.col("ta"), F.col("tb")).alias("distance"))


@query("sim_14_membership_pairs", f"with {_NODES} select a.node_id as a, b.node_id as b, len(list_intersect(string_split(a.event, ' '), string_split(b.event, ' '))) as common from nodes a join nodes b on a.node_id < b.node_id where common > 0")
def sim_14_pairs(s, d):
    return _sharing(s, d).select("a", "b", F.size(F.array_intersect(F.split("ta", " "), F.split("tb", " "))).alias("common"))


@query("int_04_xie_beni")
def int_04(s, d):
    return quality.xie_beni(_brands(s, d))


@query("snk_02_per_cluster", f"with {_BRAND} select cluster_id, line_id, event as out from c")
def snk_02(s, d):
    return _brands(s, d).select("cluster_id", "line_id", F.col("event").alias("out"))


@query(
    "snk_08_confusion_by_file",
    "select cast(user_id % 3 as varchar) as file, count(*) filter (value >= 20 and event_type <> 'error') as tp, count(*) filter (value >= 20 and event_type = 'error') as fn, count(*) filter (value < 20 and event_type <> 'error') as fp, count(*) filter (value < 20 and event_type = 'error') as tn from events group by 1",
)
def snk_08(s, d):
    good, fine = F.col("value") >= 20, F.col("event_type") != "error"
    return _table(s, d, "events").groupBy((F.col("user_id") % 3).cast("string").alias("file")).agg(*(F.count_if(c).alias(n) for n, c in (("tp", good & fine), ("fn", good & ~fine), ("fp", ~good & fine), ("tn", ~good & ~fine))))


@query("snk_12_template_table", f"with {_SIZED} select l[4] as status, count(*) as n, min(line_id) as first_line from r group by 1")
def snk_12(s, d):
    return _orders(s, d).groupBy(F.col("tokens")[3].alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line"))


@query("pre_11_dispatch", "select event_id as line_id, event_type as service from events")
def pre_11(s, d):
    from logloom.sources import grammar
    from logloom.sources.corpora import corpus

    return grammar.parse(corpus(s, d, "auth"), "auth").select("line_id", "service")


@query("tok_25_subcluster_counts", f"with {_BRAND} select cluster_id, len(string_split(event, ' ')) as n_words, count(*) as n from c group by 1, 2")
def tok_25(s, d):
    return _brands(s, d).groupBy("cluster_id", F.size(tx.words(F.col("event"))).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


@_graph_query(
    "int_06_text_silhouette",
    f"{_MEM}, z as (select cluster_id, count(*) size from m group by 1), sa as (select src n, dst o, weight from sims where weight > 0 union all select dst, src, weight from sims where weight > 0), nr as (select n, cluster_id co, sum(weight) w from sa join m on m.node_id = o group by 1, 2), dd as (select m.node_id n, m.cluster_id cn, z.cluster_id co, 1 - coalesce(w, 0) / (z.size - case when m.cluster_id = z.cluster_id then 1 else 0 end) d from m, z left join nr on nr.n = m.node_id and nr.co = z.cluster_id), ab as (select n, cn, max(case when cn = co then d end) a, min(case when cn <> co then d end) b from dd group by 1, 2) select round(avg(s), 3) as value from (select cn, avg((b - a) / greatest(a, b)) s from ab group by 1)",
)
def int_06(s, d):
    return quality.text_silhouette(graph.written(_edges(s, d, 0.0)), _fives(s, d))


@query("abs_05_trailing_asterisks", "select p_partkey as line_id, p_partkey % 4 as n from part")
def abs_05(s, d):
    from logloom.operators import templates

    part = _table(s, d, "part")
    return part.select(F.col("p_partkey").alias("line_id"), templates.trailing_asterisks(F.concat(F.col("p_type"), F.lit(" * end"), F.expr("repeat(' *', cast(p_partkey % 4 as int))"))).alias("n"))


@query("tok_16_local_search")
def tok_16(s, d):
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_id")
        pairs = [{(a, b) for i, a in enumerate(t) for b in t[i + 1 :]} for t in part.tokens]
        return pd.DataFrame({"line_id": part.line_id, "group_id": tk.local_search(pairs, part.group_id.tolist(), 4)})

    rows = _orders(s, d)
    files = _table(s, d, "orders").select(F.col("o_orderkey").alias("line_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("file"))  # one file a day
    return rows.join(tk.initial_groups(rows, 4, 7), "line_id").join(files, "line_id").groupBy("file").applyInPandas(run, "line_id long, group_id int")


_SP = f"{_MEM}, sp as (select src n, dst o, weight from sims where weight > 0 union all select dst, src, weight from sims where weight > 0), dd as (select n, o, a.cluster_id cn, b.cluster_id co, round(1 - weight, 3) d from sp join m a on a.node_id = n join m b on b.node_id = o)"
_SIL = "t as (select n, cn, co, avg(d) d from dd group by 1, 2, 3), ab as (select n, coalesce(max(case when cn = co then d end), 0) a, coalesce(min(case when cn <> co and d <> 0 then d end), 0) b from t group by 1), z as (select cluster_id, count(*) size from m group by 1), s as (select m.cluster_id, case when size = 1 then 1 when greatest(a, b) is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end s from m join z using (cluster_id) left join ab on ab.n = m.node_id), sil as (select case when (select count(*) from z) > 1 then round(avg(s), 3) else 0 end as value from (select cluster_id, avg(s) s from s group by 1))"
_DUN = "dun as (select round(coalesce(min(case when cn <> co and d <> 0 then d end), 1) / (case when coalesce(max(case when cn = co then d end), 0) = 0 then 1 else max(case when cn = co then d end) end), 3) as value from dd)"


@_graph_query("int_08_pair_silhouette", f"{_SP}, {_SIL} select value from sil")
def int_08(s, d):
    return quality.pair_silhouette(graph.written(_edges(s, d, 0.0)), _fives(s, d))


@_graph_query("int_09_pair_dunn", f"{_SP}, {_DUN} select value from dun")
def int_09(s, d):
    return quality.pair_dunn(graph.written(_edges(s, d, 0.0)), _fives(s, d))


@_graph_query("int_12_chosen_metrics", f"{_SP}, {_SIL}, {_DUN} select 'pair_silhouette' as metric, value from sil union all select 'pair_dunn', value from dun")
def int_12(s, d):
    return quality.internal(["pair_silhouette", "pair_dunn"], edges=graph.written(_edges(s, d, 0.0)), membership=_fives(s, d))


@_graph_query("snk_09_node_distances", f"{_SP} select n as node_id, co as cluster_id, o as other, d as distance from dd")
def snk_09(s, d):
    from logloom.sources import sinks

    return sinks.node_distances(_edges(s, d, 0.0), _fives(s, d))


@query(
    "ext_08_json_truth",
    "with k as (select case o_orderstatus when 'F' then 'normal' when 'O' then 'attack' else 'other' end t, case when o_totalprice < 150000 then 'normal' else 'attack' end f from orders), c as (select count(*) filter (t = 'normal' and f = 'normal') tp, count(*) filter (t = 'normal' and f = 'attack') fn, count(*) filter (t = 'attack' and f = 'normal') fp, count(*) filter (t = 'attack' and f = 'attack') tn from k) select tp, fn, fp, tn, round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from c",
)
def ext_08(s, d):
    from logloom.sources import readers

    orders = _table(s, d, "orders")
    label = F.when(F.col("o_orderstatus") == "F", "normal").when(F.col("o_orderstatus") == "O", "attack").otherwise("other")
    files = orders.select(F.lit(0).alias("line_id"), F.to_json(F.create_map(F.col("o_orderkey").cast("string"), label)).alias("json"))
    found = orders.select(F.col("o_orderkey").cast("long").alias("line_id"), F.when(F.col("o_totalprice") < 150000, "normal").otherwise("attack").alias("found"))
    return quality.confusion(readers.json_truth(files, "json").join(found, "line_id"), "label", "found")


@query(
    "snk_06_abstraction_per_line",  # even lines are grouped by their last word, odd ones by nothing but their length
    f"with {_BRAND}, g as (select line_id, string_split(event, ' ') l, len(string_split(event, ' ')) n_words, case when line_id % 2 = 0 then string_split(event, ' ')[-1] else '' end grp from c), p as (select grp, n_words, unnest(l) w, unnest(range(len(l))) i from g), q as (select grp, n_words, i, case when min(w) = max(w) then min(w) else '*' end w from p group by 1, 2, 3), t as (select grp, n_words, string_agg(w, ' ' order by i) template from q group by 1, 2) select line_id, case when replace(replace(template, '*', ''), ' ', '') <> '' then template end as abstraction from g join t using (grp, n_words)",
)
def snk_06(s, d):
    from logloom.sources import sinks

    rows = _brands(s, d).withColumn("tokens", F.split("event", " "))
    sized = rows.withColumn("n_words", F.size("tokens")).withColumn("grp", F.when(F.col("line_id") % 2 == 0, F.element_at("tokens", -1)).otherwise(""))
    made = ev.positional_template(sized, ["grp", "n_words"]).where(F.regexp_replace("template", r"[* ]", "") != "")
    return sinks.abstraction_per_line(sized, made, ["grp", "n_words"])
