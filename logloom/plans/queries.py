"""Registered queries over the driver tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import strings as st
from logloom.functions import text as tx
from logloom.operators import anomaly, graph, kernels, quality, templates
from logloom.operators import events as ev
from logloom.operators import similarity as sim
from logloom.operators import tokens as tk
from logloom.sources import grammar, readers, sinks
from logloom.sources.corpora import EVENT_LOGS, corpus, corpus_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- sources and grammars


def _field_sql(log_type: str) -> str:
    pattern, parts = grammar.FORMATS[log_type]
    one = lambda g: f"nullif(regexp_extract(raw, $${grammar.only_group(pattern, g)}$$, 1), '')"
    cols = [f"concat_ws(' ', {', '.join(map(one, gs))}) as \"{n}\"" if len(gs) > 1 else f'{one(gs[0])} as "{n}"' for n, gs in parts.items()]
    return f"select line_id, {', '.join(cols)} from {corpus_sql(log_type)}"


for _i, _name in enumerate(["auth", "kippo", "syslog", "bluegene", "raslog", "vpnlog", "snort_secrepo", "snort_sotm34", "httpd", "casper"], 1):
    query(f"pre_{_i:02d}_grammar_{_name}", _field_sql(_name))(lambda s, d, n=_name: grammar.parse(corpus(s, d, n), n))
assert set(grammar.FORMATS) == set(EVENT_LOGS)


@query("src_01_lines", f"select line_id, raw from {corpus_sql('doc')}")
def src_01(s, d):
    return corpus(s, d, "doc")


@query("src_06_labels", f"select line_id, string_split(concat(raw, ';x'), ';')[1] as label from {corpus_sql('orders')}")
def src_06(s, d):
    return readers.labels(corpus(s, d, "orders").withColumn("raw", F.concat("raw", F.lit(";x"))))


@query("src_07_ground_truth_json", "select event_id as line_id, k as key, json_extract_string(props, concat('$.', k)) as value from (select event_id, props, unnest(json_keys(props)) k from events)")
def src_07(s, d):
    return readers.ground_truth(_table(s, d, "events").select(F.col("event_id").alias("line_id"), "props"), "props")


@query(
    "src_13_tool_output",
    "with e as (select event_type, count(*) n from events group by 1) select cast(row_number() over (order by event_type) - 1 as bigint) block, concat('user did ', event_type) template, n support from e",
)
def src_13(s, d):
    counts = _table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.lit("tool").alias("file"), F.explode(F.array(F.struct(F.concat("event_type", F.lit("0")).alias("line_id"), F.concat(F.lit("user did "), "event_type").alias("raw")), F.struct(F.concat("event_type", F.lit("1")).alias("line_id"), F.concat(F.lit("Support: "), F.col("n").cast("string")).alias("raw")))).alias("l"))
    return readers.tool_output(lines.select("file", "l.line_id", "l.raw")).select("block", "template", "support")


# ---------------------------------------------------------------- text

_CG = "[y for y in [regexp_replace(x, '[^a-z]', '', 'g') for x in regexp_split_to_array(lower(raw), '\\s+')] if y <> '']"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_STOP_M = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS + tx.MONTHS) + "]"
_EV = f"[z for z in {_CG} if length(z) > 1 and not list_contains({_STOP_M}, z)]"
_W = "[x for x in regexp_split_to_array(raw, '\\s+') if x <> '']"


def _extra_sql(x: str) -> str:
    out = f"regexp_replace(lower({x}), '[^a-z]', ' ', 'g')"
    for stop in tx.EXTRA_STOPS:
        out = f"replace({out}, '{stop}', '')"
    return f"replace({out}, '_', ' ')"


def _text(name: str, source: str, column, sql: str) -> None:
    query(name, f"select line_id, {sql} as out from {corpus_sql(source)}")(lambda s, d: corpus(s, d, source).select("line_id", column(F.col("raw")).alias("out")))


_text("pre_12_lower", "orders", F.lower, "lower(raw)")
_text("pre_13_positional_strip", "auth", tx.strip_positions, f"array_to_string(list_concat([string_split(({_W})[6], '[')[1]], ({_W})[7:]), ' ')")
_text("pre_14_letters_only", "auth", tx.letters_only, _extra_sql("raw"))
_text("pre_15_squeeze", "auth", lambda c: tx.squeeze(tx.letters_only(c)), f"array_to_string([x for x in regexp_split_to_array({_extra_sql('raw')}, ' +') if length(x) > 1], ' ')")
_text("pre_16_stop_words", "doc", lambda c: F.concat_ws(" ", tx.without_stops(tx.countgroup(c))), f"array_to_string([z for z in {_CG} if not list_contains({_STOP}, z)], ' ')")
_text("pre_21_countgroup", "doc", lambda c: F.concat_ws(" ", tx.countgroup(c)), f"array_to_string({_CG}, ' ')")
_text("pre_22_event", "doc", lambda c: F.concat_ws(" ", tx.event_tokens(c)), f"array_to_string({_EV}, ' ')")
_text("pre_23_date_words", "auth", lambda c: F.concat_ws(" ", tx.date_words(c)), r"array_to_string(regexp_extract_all(lower(raw), '\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{1,2}\b', 1), ' ')")
_text("pre_27_erase", "orders", lambda c: F.concat_ws(" ", tx.erase(c, ["[0-9]+"], [0, 2])), "array_to_string([w for w, i in [x for x in regexp_split_to_array(regexp_replace(raw, '[0-9]+', '', 'g'), '\\s+') if x <> ''] if i <> 1 and i <> 3], ' ')")
_text("pre_28_blank_lines", "doc", lambda c: F.trim(c) != "", "trim(raw) <> ''")
_text("pre_29_short_words", "orders", lambda c: F.concat_ws(" ", F.filter(tx.words(c), lambda t: (F.length(t) != 1) | (t == "*"))), f"array_to_string([x for x in {_W} if length(x) <> 1 or x = '*'], ' ')")
_text("pre_30_pad_day", "auth", lambda c: tx.pad_day(F.regexp_extract(c, "^([A-Z][a-z]{2} [0-9]+)", 1)), "regexp_replace(regexp_extract(raw, '^([A-Z][a-z]{2} [0-9]+)', 1), '^([A-Z][a-z]{2}) ([0-9])( |$)', '\\1  \\2\\3')")


@query("pre_26_timestamps", "select cast(event_id as bigint) line_id, date_trunc('second', ts) ts from events")
def pre_26(s, d):
    years = _table(s, d, "events").select(F.col("event_id").cast("long").alias("line_id"), F.year("ts").alias("y"))
    parsed = grammar.parse(corpus(s, d, "kippo"), "kippo").join(years, "line_id")
    return parsed.select("line_id", tx.timestamp(F.col("timestamp"), 0, "kippo").cast("timestamp_ntz").alias("ts"))


# ---------------------------------------------------------------- events and term weights

_TF = f"w as (select line_id node_id, t, n, len from (select line_id, u.t, count(*) n, any_value(len(l)) len from (select line_id, {_CG} l from {corpus_sql('orders')}) x, lateral (select unnest(x.l) t) u group by 1, 2))"


@query("pre_17_term_frequency", f"with {_TF} select node_id, t as term, round(n / len, 6) as tf from w")
def pre_17(s, d):
    return ev.terms(corpus(s, d, "orders").withColumnRenamed("line_id", "node_id"), tx.countgroup(F.col("raw"))).select("node_id", "term", F.round("tf", 6).alias("tf"))


_DF = f"{_TF}, v as (select distinct t from w), df as (select v.t, count(c.raw) df from v left join {corpus_sql('orders')} c on contains(lower(c.raw), v.t) group by 1)"


def _document_frequency(lines):
    return ev.document_frequency(graph.written(lines.select(F.explode(tx.countgroup(F.col("raw"))).alias("term")).distinct()), lines)


@query("pre_18_document_frequency", f"with {_DF} select t as term, df from df")
def pre_18(s, d):
    return _document_frequency(corpus(s, d, "orders"))


_TFIDF = f"{_DF}, x as (select w.node_id, w.t term, w.n / w.len * (case when df.df = 0 then 1 else 1 + ln((select count(*) from orders)::double / df.df) end) w from w join df using (t))"


def _weights(s, d):
    lines = corpus(s, d, "orders")
    table = ev.terms(lines.withColumnRenamed("line_id", "node_id"), tx.countgroup(F.col("raw")))
    return ev.tf_idf(table, graph.written(_document_frequency(lines)), lines.count())  # its size is known then, so a small one is broadcast


@query("pre_19_tf_idf", f"with {_TFIDF} select node_id, term, round(w, 6) as w from x")
def pre_19(s, d):
    return _weights(s, d).select("node_id", "term", F.round("w", 6).alias("w"))


@query("pre_20_norms", f"with {_TFIDF} select node_id, round(sqrt(sum(w * w)), 6) as norm from x group by 1")
def pre_20(s, d):
    return ev.norms(_weights(s, d)).select("node_id", F.round("norm", 6).alias("norm"))


_PLACED = f"p as (select line_id, u.w, u.i from (select line_id, {_W} l from {corpus_sql('orders')}) x, lateral (select unnest(x.l) w, unnest(range(len(x.l))) i) u)"


def _orders(s, d, deal=False):
    lines = corpus(s, d, "orders")
    return (tk.dealt(lines) if deal else lines).select("line_id", tx.words(F.col("raw")).alias("tokens"))


for _first in (False, True):
    _pick = "min(i)" if _first else "i"
    query(
        "pre_25_first_constant" if _first else "pre_24_constant_columns",
        f"with {_PLACED}, c as (select i from p group by i having min(w) = max(w)), g as (select {_pick} i from c) select line_id, coalesce(string_agg(w, ' ' order by i) filter (where i not in (select i from g)), '') as event from p group by 1",
    )(lambda s, d, f=_first: ev.drop_constant(_orders(s, d), first_only=f))

_EVENTS = f"e as (select array_to_string({_EV}, ' ') event, line_id from {corpus_sql('doc')}), u as (select event, count(*) frequency, min(line_id) first_line, list(line_id order by line_id) m from e group by 1)"


@query("agg_01_unique_events", f"with {_EVENTS} select row_number() over (order by first_line) - 1 as node_id, event, frequency, first_line, array_to_string(m, ',') as members from u")
def agg_01(s, d):
    return ev.unique_events(corpus(s, d, "doc")).withColumn("members", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))))


@query(
    "agg_02_events_with_countgroups",
    f"select array_to_string({_EV}, ' ') event, count(*) frequency, count(distinct array_to_string({_CG}, ' ')) n_groups, min(line_id) first_line from {corpus_sql('part')} group by 1",
)
def agg_02(s, d):
    return corpus(s, d, "part").groupBy(F.concat_ws(" ", tx.event_tokens(F.col("raw"))).alias("event")).agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct(F.concat_ws(" ", tx.countgroup(F.col("raw")))).alias("n_groups"), F.min("line_id").alias("first_line"))


@query("agg_03_start_end", "with t as (select event_type event, concat('user did ', event_type) m, ts, event_id from events), k as (select distinct event from t) select k.event, min(ts) as first_ts, max(ts) as last_ts from k join t on contains(t.m, k.event) group by 1")
def agg_03(s, d):
    t = _table(s, d, "events").select(F.col("event_type").alias("event"), F.concat(F.lit("user did "), "event_type").alias("m"), "ts")
    span = t.groupBy("m").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))  # equal messages first: the join is between few texts
    return t.select("event").distinct().join(span, F.contains("m", "event")).groupBy("event").agg(F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


@query("agg_04_word_count_groups", f"select len({_CG}) as n_words, count(*) as n from {corpus_sql('doc')} group by 1")
def agg_04(s, d):
    return corpus(s, d, "doc").groupBy(F.size(tx.countgroup(F.col("raw"))).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_05_positional_template", f"with {_PLACED}, q as (select i, case when min(w) = max(w) then min(w) else '*' end w from p group by i) select 'all' as g, string_agg(w, ' ' order by i) as template, (select count(*) from orders) as n from q")
def agg_05(s, d):
    return ev.positional_template(_orders(s, d).withColumn("g", F.lit("all")), ["g"])


@query("agg_09_interarrival", "with x as (select event_type, count(*) frequency, cast(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) as bigint) sp from events group by 1) select event_type, frequency, case when sp = 0 then 1 else sp end as seconds, round(case when sp = 0 then 1 else sp end / frequency, 6) as rate from x")
def agg_09(s, d):
    return ev.interarrival(_table(s, d, "events"), "event_type")


@query("agg_10_top_message", "select user_id % 7 as cluster_id, min_by(event_type, (-n, event_type)) as top from (select user_id, event_type, count(*) over (partition by user_id % 7, event_type) n from events) group by 1")
def agg_10(s, d):
    c = _table(s, d, "events").groupBy((F.col("user_id") % 7).alias("cluster_id"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "event_type")).alias("b")).select("cluster_id", F.col("b.event_type").alias("top"))


_BRAND = "c as (select p_partkey line_id, dense_rank() over (order by p_brand) - 1 cluster_id, lower(concat_ws(' ', p_name, p_type)) event, p_type truth from part)"


def _brands(s, d):
    part = _table(s, d, "part")
    ids = ev.numbered(part.select("p_brand").distinct(), "p_brand", "cluster_id")
    return part.join(ids, "p_brand").select(F.col("p_partkey").alias("line_id"), "cluster_id", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("event"), F.col("p_type").alias("truth"))


_CENTROID = "k as (select cluster_id, u.t, min(line_id * 100 + u.i) o from c, lateral (select unnest(string_split(event, ' ')) t, unnest(range(len(string_split(event, ' ')))) i) u group by 1, 2), ce as (select cluster_id, string_agg(t, ' ' order by o) centroid from k group by 1)"


@query("agg_12_centroids", f"with {_BRAND}, {_CENTROID} select cluster_id, centroid from ce")
def agg_12(s, d):
    return ev.centroids(_brands(s, d), "cluster_id", "line_id", "event")


@query("agg_13_raw_centroids", f"with {_BRAND} select cluster_id, string_agg(event, ' ' order by line_id) as centroid from c group by 1")
def agg_13(s, d):
    return ev.centroids(_brands(s, d), "cluster_id", "line_id", "event", distinct=False)


@query("agg_14_node_to_line", f"with {_EVENTS} select row_number() over (order by first_line) - 1 as node_id, unnest(m) as line_id from u")
def agg_14(s, d):
    return ev.unique_events(corpus(s, d, "doc")).select("node_id", F.explode("members").alias("line_id"))


_FREQ = f"f as (select u.w word, count(*) n from (select {_CG} l from {corpus_sql('doc')}) x, lateral (select unnest(x.l) w) u group by 1)"


@query("agg_15_word_frequency", f"with {_FREQ} select word, n from f")
def agg_15(s, d):
    return ev.word_frequency(corpus(s, d, "doc"), tx.countgroup(F.col("raw")))


@query("agg_16_relative_support", f"with {_FREQ} select word, n from f where n >= floor(2 * (select count(*) from {corpus_sql('doc')}) / 100)")
def agg_16(s, d):
    lines = corpus(s, d, "doc").select("line_id", tx.countgroup(F.col("raw")).alias("tokens"))
    return tk.frequent_words(lines, 2, lines.count())


# ---------------------------------------------------------------- the part graph

_NODES = "nodes as (select row_number() over (order by min(p_partkey)) - 1 node_id, lower(concat_ws(' ', p_name, p_type)) event, count(*) frequency from part group by 2)"
_GRAPH = f"""{_NODES},
tok as (select node_id, t, count(*) * 1.0 / any_value(n) tf from (select node_id, unnest(string_split(event, ' ')) t, len(string_split(event, ' ')) n from nodes) group by 1, 2),
pr as (select a.node_id src, a.event ea, b.node_id dst, b.event eb from nodes a join nodes b on a.node_id < b.node_id),
pa as (select src, dst, t, tf * (case when contains(eb, t) then 1 else 1 + ln(2) end) w from pr join tok on tok.node_id = src),
pb as (select src, dst, t, tf * (case when contains(ea, t) then 1 else 1 + ln(2) end) w from pr join tok on tok.node_id = dst),
na as (select src, dst, sqrt(sum(w * w)) n from pa group by 1, 2), nb as (select src, dst, sqrt(sum(w * w)) n from pb group by 1, 2),
dots as (select src, dst, sum(pa.w * pb.w) d from pa join pb using (src, dst, t) group by 1, 2),
sims as (select src, dst, round(d / (na.n * nb.n), 3) weight from dots join na using (src, dst) join nb using (src, dst)),
edges as (select * from sims where weight > 0.5),
sy as (select src n, dst o, weight from edges union all select dst, src, weight from edges),
"""
_COMP = """reach(n, r) as (select node_id, node_id from nodes union select reach.n, sy.o from reach join sy on sy.n = reach.r),
comp as (select n node_id, min(r) cluster_id from reach group by 1)
"""


def _nodes(s, d):
    part = _table(s, d, "part").select(F.col("p_partkey").alias("line_id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("event"))
    return ev.unique_events(part, F.col("event"))


def _edges(s, d, threshold=0.5):
    return sim.similar_pairs(_nodes(s, d), threshold)


def _graph_query(name: str, sql: str | None, recursive: bool = False):
    prefix = "with recursive " if recursive else "with "
    return query(name, None if sql is None else f"{prefix}{_GRAPH}{_COMP + ' ' if recursive else ''}{sql}")


@_graph_query("sim_03_pair_cosine", "z as (select 1) select src, dst, weight from sims where weight > 0")
def sim_03(s, d):
    return _edges(s, d, 0.0)


@_graph_query("gra_02_edges", "z as (select 1) select src, dst, weight from edges")
def gra_02(s, d):
    return _edges(s, d)


@_graph_query("gra_07_degrees", "z as (select 1) select n as node_id, count(*) as degree, round(sum(weight), 6) as weighted_degree from sy group by 1")
def gra_07(s, d):
    return graph.degrees(_edges(s, d))


@_graph_query("gra_09_components", "select node_id, cluster_id from comp", recursive=True)
def gra_09(s, d):
    return graph.components(_nodes(s, d), _edges(s, d))


@_graph_query("clu_01_connected_components", ", k as (select distinct cluster_id from comp), r as (select cluster_id, row_number() over (order by cluster_id) - 1 i from k) select node_id, i as cluster_id from comp join r using (cluster_id)", recursive=True)
def clu_01(s, d):
    return graph.ranked(graph.components(_nodes(s, d), _edges(s, d)))


@_graph_query(
    "flagship_cluster_properties",
    ", m as (select cluster_id, count(*) members, sum(frequency) frequency from comp join nodes using (node_id) group by 1), i as (select a.cluster_id, count(*) edges from edges join comp a on a.node_id = src join comp b on b.node_id = dst where a.cluster_id = b.cluster_id group by 1) "
    "select cluster_id, members, cast(frequency as bigint) as frequency, round(frequency / sum(frequency) over (), 6) as share, coalesce(edges, 0) as edges, round(coalesce(edges, 0) / members, 6) as density from m left join i using (cluster_id)",
    recursive=True,
)
def flagship(s, d):
    nodes, edges = _nodes(s, d), graph.written(_edges(s, d))
    return ev.cluster_properties(nodes, graph.components(nodes, edges), edges)


_TRI = "t as (select x.src a, x.dst b, y.dst c, x.weight w_ab, z.weight w_ac, y.weight w_bc from edges x join edges y on x.dst = y.src join edges z on z.src = x.src and z.dst = y.dst)"


@_graph_query("gra_10_cliques_3", f"{_TRI} select concat_ws('-', a, b, c) as clique from t")
def gra_10(s, d):
    return graph.cliques(graph.written(_edges(s, d)), 3).select(F.concat_ws("-", F.transform("nodes", lambda x: x.cast("string"))).alias("clique"))


@_graph_query("gra_06_triangle_pruning", f"{_TRI}, g as (select distinct list_sort([(w_ab, a, b), (w_ac, a, c), (w_bc, b, c)])[1] e from t) select src, dst, weight from edges where (weight, src, dst) not in (select e from g)")
def gra_06(s, d):
    return graph.prune_triangles(graph.written(_edges(s, d)))


@_graph_query("gra_12_clique_intensity", f"{_TRI} select concat_ws('-', a, b, c) as key, round(exp((ln(w_ab) + ln(w_ac) + ln(w_bc)) / 3), 5) as intensity from t")
def gra_12(s, d):
    edges = graph.written(_edges(s, d))
    return graph.clique_intensity(graph.cliques(edges, 3), edges)


@_graph_query("gra_13_percolation", f"{_TRI}, k as (select concat_ws('-', a, b, c) key, unnest([a, b, c]) n from t) select x.key as src, y.key as dst, count(*) as shared from k x join k y on x.n = y.n and x.key < y.key group by 1, 2 having count(*) >= 2")
def gra_13(s, d):
    return graph.percolation(graph.cliques(graph.written(_edges(s, d)), 3), 3)


_MEM = "m as (select node_id, node_id % 5 cluster_id from nodes)"


def _fives(s, d):
    return _nodes(s, d).select("node_id", (F.col("node_id") % 5).alias("cluster_id"))


@_graph_query("gra_14_inter_cluster_edges", f"{_MEM} select src, dst, weight, a.cluster_id = b.cluster_id as inside from edges join m a on a.node_id = src join m b on b.node_id = dst")
def gra_14(s, d):
    return graph.split_edges(_edges(s, d), _fives(s, d))


@_graph_query("gra_17_modularity", f"{_MEM}, w as (select sum(weight) m from edges), i as (select a.cluster_id, sum(weight) w from edges join m a on a.node_id = src join m b on b.node_id = dst where a.cluster_id = b.cluster_id group by 1), g as (select cluster_id, sum(weight) s from sy join m on m.node_id = n group by 1) select round(sum(coalesce(i.w, 0) / w.m - pow(g.s / (2 * w.m), 2)), 6) as modularity from g left join i using (cluster_id), w")
def gra_17(s, d):
    return graph.modularity(graph.written(_edges(s, d)), _fives(s, d))


@_graph_query("gra_19_node_entropy", f"{_MEM}, q as (select n, sum(case when a.cluster_id = b.cluster_id then weight else 0 end) / sum(weight) p from sy join m a on a.node_id = n join m b on b.node_id = o group by 1) select n as node_id, round(case when p > 0 and p < 1 then -p * log2(p) - (1 - p) * log2(1 - p) else 0 end, 5) as entropy from q")
def gra_19(s, d):
    return graph.node_entropy(_edges(s, d), _fives(s, d))


def _round_sql(n: int) -> str:
    out = "l0 as (select node_id, node_id label from nodes)"
    for i in range(n):
        out += f", v{i} as (select sy.n node_id, label, round(sum(weight), 6) w from sy join l{i} on l{i}.node_id = sy.o group by 1, 2), b{i} as (select node_id, min_by(label, (-w, label)) new from v{i} group by 1), l{i + 1} as (select node_id, coalesce(new, label) label from l{i} left join b{i} using (node_id))"
    return out


@_graph_query("clu_08_majority_rounds", f"{_round_sql(3)} select node_id, label as cluster_id from l3")
def clu_08(s, d):
    nodes = _nodes(s, d)
    return graph.label_rounds(nodes, graph.written(_edges(s, d)), 3)


for _name, _kernel in (("clu_08_majority_sequential", kernels.majority), ("clu_10_heaviest_neighbour", kernels.heaviest_neighbour), ("clu_11_graph_entropy", kernels.graph_entropy), ("clu_13_louvain", kernels.louvain), ("clu_14_graph_cut", kernels.recursive_cut)):
    query(_name)(lambda s, d, k=_kernel: kernels.per_component(_nodes(s, d), graph.written(_edges(s, d)), k))


@query("clu_02_k_clique_percolation")
def clu_02(s, d):
    return graph.k_clique_clusters(_nodes(s, d), graph.written(_edges(s, d)), 3)


@query("clu_03_weighted_percolation")
def clu_03(s, d):
    return graph.k_clique_clusters(_nodes(s, d), graph.written(_edges(s, d)), 3, threshold=0.55)


@query("snk_13_dot_edges", f"with {_GRAPH} z as (select 1) select src, dst, concat(src, ' -- ', dst, ' [weight=', printf('%.3f', weight), '];') as out from edges")
def snk_13(s, d):
    return sinks.dot_edges(_edges(s, d))


@query("snk_14_graph_events", f"""with {_GRAPH} z as (select 1) select concat('{{"an":{{"', node_id, '":{{"label":"', event, '"}}}}}}') as out from nodes union all select concat('{{"ae":{{"', src, '-', dst, '":{{"source":"', src, '","target":"', dst, '","directed":false}}}}}}') from edges""")
def snk_14(s, d):
    return sinks.graph_events(_nodes(s, d), _edges(s, d))


@query("snk_16_node_styles", f"with {_NODES} select node_id, frequency, node_id % 5 as cluster_id, substr(md5(cast(node_id % 5 as varchar)), 1, 6) as colour from nodes")
def snk_16(s, d):
    return sinks.node_styles(_nodes(s, d), _fives(s, d))


# ---------------------------------------------------------------- token clustering

_SIZED = f"r as (select line_id, {_W} l from {corpus_sql('orders')})"


@query("tok_01_by_count", f"with {_SIZED} select line_id, len(l) as part from r")
def tok_01(s, d):
    return tk.by_count(_orders(s, d)).select("line_id", "part")


@query(
    "tok_02_by_position",
    f"with {_SIZED}, p as (select len(l) part, line_id, unnest(l) w, unnest(range(len(l))) i from r), d as (select part, i, count(distinct w) d from p group by 1, 2), b as (select part, min_by(i, (d, i)) i, min(d) d from d group by 1) select r.line_id, b.part, case when b.d > 1 then b.i else -1 end as pos, case when b.d > 1 then l[b.i + 1] else '' end as token from r join b on b.part = len(r.l)",
)
def tok_02(s, d):
    return tk.by_position(tk.by_count(_orders(s, d, deal=True))).select("line_id", "part", "pos", "token")


@query(
    "tok_03_mapping",
    f"with {_SIZED}, q as (select distinct len(l) part, l[4] t1, l[6] t2 from r), n1 as (select part, t1, count(*) n1 from q group by 1, 2), n2 as (select part, t2, count(*) n2 from q group by 1, 2), j as (select * from q join n1 using (part, t1) join n2 using (part, t2)), k as (select *, max(n2) over (partition by part, t1) m2, max(n1) over (partition by part, t2) m1 from j) "
    "select part, t1, t2, case when n1 = 1 and n2 = 1 then '1-1' when n1 > 1 and m2 = 1 then '1-M' when n2 > 1 and m1 = 1 then 'M-1' else 'M-M' end as kind from k",
)
def tok_03(s, d):
    return tk.mapping(tk.by_count(_orders(s, d)), 3, 5)


@query("tok_06_templates", f"with {_SIZED}, p as (select len(l) part, l[4] token, unnest(l) w, unnest(range(len(l))) i from r), q as (select part, token, i, case when min(w) = max(w) then min(w) else '*' end w from p group by 1, 2, 3), n as (select len(l) part, l[4] token, count(*) n from r group by 1, 2) select part, token, string_agg(q.w, ' ' order by i) as template, any_value(n.n) as n from q join n using (part, token) group by 1, 2")
def tok_06(s, d):
    rows = tk.by_count(_orders(s, d)).withColumn("token", F.col("tokens")[3])
    return ev.positional_template(rows, ["part", "token"])


_PAIRS = f"{_SIZED}, p as (select line_id, unnest(l) w, unnest(range(len(l))) i from r), tp as (select a.line_id, a.w first, b.w next from p a join p b on a.line_id = b.line_id and a.i < b.i)"


@query("tok_14_term_pairs", f"with {_PAIRS} select line_id, first, next from tp")
def tok_14(s, d):
    return tk.term_pairs(_orders(s, d))


_GROUPS = f"gr as (select line_id, cast(('0x' || substr(md5(concat_ws('-', line_id, '7')), 1, 8))::bigint % 4 as int) group_id from {corpus_sql('orders')})"


@query("tok_15_group_pair_counts", f"with {_PAIRS}, {_GROUPS} select group_id, first, next, count(*) as n from (select distinct * from tp) join gr using (line_id) group by 1, 2, 3")
def tok_15(s, d):
    return tk.pair_counts(_orders(s, d, deal=True).withColumn("group_id", tk.initial_group(F.col("line_id"), 4, 7)))


@query("tok_17_signatures", f"with {_SIZED}, {_GROUPS}, z as (select group_id, count(*) c from gr group by 1), w as (select group_id, w word, count(*) n from (select distinct line_id, unnest(l) w from r) join gr using (line_id) group by 1, 2) select group_id, word, n from w join z using (group_id) where n >= ceil(c / 2)")
def tok_17(s, d):
    rows = _orders(s, d)
    return tk.signatures(rows, tk.initial_groups(rows, 4, 7))


_CAND = f"{_SIZED}, p as (select line_id, len(l) len, unnest(l) w, unnest(range(len(l))) i from r), fw as (select w from p group by 1 having count(*) >= floor(10 * (select count(*) from r) / 100)), k as (select p.* from p join fw using (w)), ca as (select line_id, any_value(len) len, string_agg(w, ' ' order by i) candidate, list(i order by i) ps from k group by 1)"


def _frequent(s, d):
    rows = graph.written(_orders(s, d, deal=True))
    return rows, tk.frequent_words(rows, 10, rows.count())


@query("tok_19_candidates", f"with {_CAND} select r.line_id, ca.candidate from r left join ca using (line_id)")
def tok_19(s, d):
    return tk.candidates(*_frequent(s, d))


_GAPS = f"{_CAND}, sl as (select candidate, unnest(range(len(ps) + 1)) slot, ps, len from ca), g as (select candidate, slot, (case when slot = len(ps) then len else ps[slot + 1] end) - (case when slot = 0 then -1 else ps[slot] end) - 1 gap from sl), gg as (select candidate, slot, min(gap) low, max(gap) high, count(*) n from g group by 1, 2)"


@query("tok_19_gaps", f"with {_GAPS} select candidate, slot, low, high, n from gg")
def tok_19_gaps(s, d):
    return tk.candidate_gaps(*_frequent(s, d))


@query("tok_22_patterns", f"with {_GAPS} select candidate, string_agg(concat_ws(' ', concat('*{{', low, ',', high, '}}'), string_split(candidate, ' ')[slot + 1]), ' ' order by slot) as pattern, max(n) as support from gg group by 1".replace("{{", "{").replace("}}", "}"))
def tok_22(s, d):
    return tk.pretty(tk.candidate_gaps(*_frequent(s, d)))


@query("tok_20_frequent_candidates", f"with {_CAND}, c as (select candidate, count(*) n from ca group by 1 having count(*) >= 100) select r.line_id, coalesce(c.candidate, 'outlier') as cluster from r left join ca using (line_id) left join c using (candidate)")
def tok_20(s, d):
    found = tk.candidates(*_frequent(s, d))
    often = found.where("candidate is not null").groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).where("n >= 100").select("candidate", F.col("candidate").alias("cluster"))
    return found.join(graph.written(often), "candidate", "left").select("line_id", F.coalesce("cluster", F.lit("outlier")).alias("cluster"))


@query("tok_26_line_patterns", f"with {_SIZED}, p as (select line_id, unnest(l) w, unnest(range(len(l))) i from r), f as (select i, w, true o from p group by 1, 2 having count(*) >= 150), m as (select line_id, string_agg(case when o then p.w else '*' end, ' ' order by p.i) pattern from p left join f using (i, w) group by 1) select pattern, count(*) as n from m group by 1 having count(*) >= 150")
def tok_26(s, d):
    return tk.line_patterns(graph.written(_orders(s, d, deal=True)), 150)


@query("tok_27_assign_templates", f"select line_id, case when contains(raw, 'status O') and contains(raw, 'URGENT') then 0 when contains(raw, 'status F') then 1 end as template_id from {corpus_sql('orders')} where (contains(raw, 'status O') and contains(raw, 'URGENT')) or contains(raw, 'status F')")
def tok_27(s, d):
    t = s.createDataFrame([(0, ["status O", "URGENT"]), (1, ["status F"])], "template_id int, fragments array<string>")
    return tk.assign_templates(corpus(s, d, "orders"), t)


# ---------------------------------------------------------------- templates


@query("abs_01_substring_templates")
def abs_01(s, d):
    return templates.substring_templates(_brands(s, d), "cluster_id", "line_id", "event")


@query("abs_02_candidate_groups", f"with {_BRAND} select cluster_id, len(string_split(event, ' ')) as n_words, count(*) as n_lines, count(distinct event) as n_texts from c group by 1, 2")
def abs_02(s, d):
    return templates.candidate_groups(_brands(s, d).withColumn("tokens", F.split("event", " ")), "cluster_id")


@query(
    "abs_03_asterisk_templates",
    f"with {_BRAND}, p as (select cluster_id, len(string_split(event, ' ')) n_words, unnest(string_split(event, ' ')) w, unnest(range(len(string_split(event, ' ')))) i from c), q as (select cluster_id, n_words, i, case when min(w) = max(w) then min(w) else '*' end w from p group by 1, 2, 3), t as (select cluster_id, n_words, string_agg(w, ' ' order by i) template from q group by 1, 2), b as (select cluster_id, len(string_split(event, ' ')) n_words, event, count(*) n from c group by 1, 2, 3) "
    "select b.cluster_id, b.n_words, case when replace(replace(template, '*', ''), ' ', '') = '' then event else template end as template, cast(sum(b.n) as bigint) as n from t join b using (cluster_id, n_words) group by 1, 2, 3",
)
def abs_03(s, d):
    return templates.asterisk_templates(_brands(s, d).withColumn("tokens", F.split("event", " ")), "cluster_id")


_NAMES = "t as (select distinct template from (select lower(p_type) template from part union all select lower(concat_ws(' ', p_name, p_type)) from part))"


@query("abs_04_contained_templates", f"with {_NAMES} select a.template as short, min_by(b.template, (length(b.template), b.template)) as long from t a join t b on contains(b.template, a.template) and length(b.template) > length(a.template) and a.template <> '' group by 1")
def abs_04(s, d):
    part = _table(s, d, "part")
    return templates.contained_templates(part.select(F.lower("p_type").alias("template")).unionByName(part.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("template"))))


@query("abs_06_renumbered", "with t as (select distinct p_type template from part where p_type <> '') select template, row_number() over (order by template) - 1 as template_id from t")
def abs_06(s, d):
    return templates.renumbered(_table(s, d, "part").select(F.col("p_type").alias("template")))


@query("abs_09_re_identified", "with k as (select distinct p_type template from part), g as (select distinct template, cast(length(template) as bigint) * 1000 + ascii(template) template_id from k where length(template) % 2 = 0), h as (select template, min(template_id) template_id from g group by 1) select template, template_id from h union all select template, row_number() over (order by template) + (select max(template_id) from h) from k where template not in (select template from h)")
def abs_09(s, d):
    k = _table(s, d, "part").select(F.col("p_type").alias("template")).distinct()
    truth = k.where(F.length("template") % 2 == 0).select("template", (F.length("template").cast("long") * 1000 + F.ascii("template")).alias("template_id"))
    return templates.re_identified(k, truth)


# ---------------------------------------------------------------- quality



@query("int_02_calinski_harabasz")
def int_02(s, d):
    return quality.calinski_harabasz(_brands(s, d))


@query("int_03_davies_bouldin")
def int_03(s, d):
    return quality.davies_bouldin(_brands(s, d))


_SD = f"{_MEM}, dd as (select n, a.cluster_id cn, b.cluster_id co, round(1 - weight, 3) d from sy join m a on a.node_id = n join m b on b.node_id = o)"


@_graph_query(
    "int_05_graph_silhouette",
    f"{_SD}, t as (select n, cn, co, avg(d) d from dd group by 1, 2, 3), ab as (select n, coalesce(max(case when cn = co then d end), 0) a, coalesce(min(case when cn <> co and d <> 0 then d end), 0) b from t group by 1), z as (select cluster_id, count(*) size from m group by 1), s as (select m.cluster_id, case when size = 1 then 1 when greatest(a, b) is null or greatest(a, b) = 0 then 0 else (b - a) / greatest(a, b) end s from m join z using (cluster_id) left join ab on ab.n = m.node_id) select round(avg(s), 3) as value from (select cluster_id, avg(s) s from s group by 1)",
)
def int_05(s, d):
    return quality.graph_silhouette(graph.written(_edges(s, d)), _fives(s, d))


@_graph_query("int_07_graph_dunn", f"{_SD} select round(coalesce(min(case when cn <> co and d <> 0 then d end), 1) / (case when coalesce(max(case when cn = co then d end), 0) = 0 then 1 else max(case when cn = co then d end) end), 3) as value from dd")
def int_07(s, d):
    return quality.graph_dunn(graph.written(_edges(s, d)), _fives(s, d))


_CELLS = f"{_BRAND}, x as (select truth t, cluster_id p, count(*) n from c group by 1, 2), a as (select t, sum(n) a from x group by 1), b as (select p, sum(n) b from x group by 1), pc as (select (select sum(n * (n - 1) / 2) from x) tp, (select sum(a * (a - 1) / 2) from a) r, (select sum(b * (b - 1) / 2) from b) c, (select sum(n) from x) n)"


@query("ext_02_adjusted_rand", f"with {_CELLS} select round((tp - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 6) as value from pc")
def ext_02(s, d):
    return quality.adjusted_rand(_brands(s, d), "truth", "cluster_id")


@query("ext_03_adjusted_mutual_information")
def ext_03(s, d):
    return s.createDataFrame([(round(quality.adjusted_mutual_information(_brands(s, d), "truth", "cluster_id"), 6),)], "value double")


@query("ext_04_fowlkes_mallows", f"with {_CELLS} select round(tp / sqrt(r * c), 6) as value from pc")
def ext_04(s, d):
    return quality.fowlkes_mallows(_brands(s, d), "truth", "cluster_id")


_INFO = f"{_CELLS}, i as (select (select sum(x.n / pc.n * ln(x.n * pc.n / (a.a * b.b))) from x join a using (t) join b using (p), pc) mi, (select sum(-a.a / pc.n * ln(a.a / pc.n)) from a, pc) ht, (select sum(-b.b / pc.n * ln(b.b / pc.n)) from b, pc) hp)"


@query("ext_05_normalised_mutual_information", f"with {_INFO} select round(mi / sqrt(ht * hp), 6) as value from i")
def ext_05(s, d):
    return quality.normalised_mutual_information(_brands(s, d), "truth", "cluster_id")


@query("ext_06_v_measure", f"with {_INFO} select round(mi / ht, 6) as homogeneity, round(mi / hp, 6) as completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) as v_measure from i")
def ext_06(s, d):
    return quality.v_measure(_brands(s, d), "truth", "cluster_id")


_DEC = "select case when event_type = 'error' then 'attack' else 'normal' end f, case when value < 20 then 'attack' else 'normal' end t from events"


@query(
    "ext_09_confusion",
    f"with k as ({_DEC}), c as (select count(*) filter (t = 'normal' and f = 'normal') tp, count(*) filter (t = 'normal' and f = 'attack') fn, count(*) filter (t = 'attack' and f = 'normal') fp, count(*) filter (t = 'attack' and f = 'attack') tn from k) select tp, fn, fp, tn, round(tn / (tn + fp), 6) as specificity, round(tp / (tp + fp), 6) as \"precision\", round(tp / (tp + fn), 6) as recall, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from c",
)
def ext_09(s, d):
    e = _table(s, d, "events").select(F.when(F.col("event_type") == "error", "attack").otherwise("normal").alias("f"), F.when(F.col("value") < 20, "attack").otherwise("normal").alias("t"))
    return quality.confusion(e, "t", "f")


_PHRASES = ["status o", "status f", "urgent", "low"]


@query("ext_01_dominant_labels")
def ext_01(s, d):
    return quality.dominant_labels(corpus(s, d, "orders").withColumn("cluster_id", F.col("line_id") % 6), _PHRASES)


# ---------------------------------------------------------------- anomaly

_ANO = "pr as (select event_type cluster_id, count(distinct user_id) members, count(*) frequency, cast(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) as bigint) sp from events group by 1), sc as (select cluster_id, members * frequency / (sum(members) over () * sum(frequency) over ()) * (case when sp = 0 then 1 else sp end / frequency) score from pr)"


def _scores(s, d):
    e = _table(s, d, "events").withColumnRenamed("event_type", "cluster_id")
    gaps = ev.interarrival(e, "cluster_id").select("cluster_id", "frequency", (F.col("seconds") / F.col("frequency")).alias("rate"))
    return anomaly.scores(e.groupBy("cluster_id").agg(F.countDistinct("user_id").alias("members")).join(gaps, "cluster_id"))


@query("ano_02_scores", f"with {_ANO} select cluster_id, round(score, 6) as score from sc")
def ano_02(s, d):
    return _scores(s, d).select("cluster_id", F.round("score", 6).alias("score"))


_NORM = f"{_ANO}, s1 as (select cluster_id, (score - min(score) over ()) / (max(score) over () - min(score) over ()) s from sc), q1 as (select cluster_id, -4 * s * s + 4 * s q from s1), no as (select cluster_id, q, -1 + 2 * (q - min(q) over ()) / (max(q) over () - min(q) over ()) z from q1)"


@query("ano_03_transformed", f"with {_NORM} select cluster_id, round(q, 6) as quadratic, round(z, 6) as normalised from no")
def ano_03(s, d):
    return anomaly.transformed(_scores(s, d))


@query("ano_04_decisions", f"with {_NORM} select cluster_id, round(z, 6) as final_score, case when round(z, 6) < 0 then 'attack' else 'normal' end as decision from no")
def ano_04(s, d):
    return anomaly.decisions(anomaly.transformed(_scores(s, d)))


@query("ano_05_sentiment", "select event_type as cluster_id, case event_type when 'error' then -0.5 when 'purchase' then 0.4 when 'signup' then 0.3 else 0.1 end as polarity from events group by 1")
def ano_05(s, d):
    return _table(s, d, "events").select(F.col("event_type").alias("cluster_id")).distinct().select("cluster_id", anomaly.polarity(F.array("cluster_id")).alias("polarity"))


@query("ano_06_line_decisions", f"with {_NORM} select event_id as line_id, concat_ws('; ', case when round(z, 6) < 0 then 'attack' else 'normal' end, event_type) as out from events join no on no.cluster_id = event_type")
def ano_06(s, d):
    e = _table(s, d, "events").select(F.col("event_id").alias("line_id"), F.col("event_type").alias("raw"))
    return sinks.anomaly_per_line(e, e.select("line_id", F.col("raw").alias("cluster_id")), anomaly.decisions(anomaly.transformed(_scores(s, d))))


@query("snk_01_per_line", f"with {_BRAND} select line_id, concat_ws('; ', cluster_id, case when cluster_id < 5 then 'known' else 'undefined' end, event) as out from c")
def snk_01(s, d):
    b = _brands(s, d)
    names = b.where("cluster_id < 5").select("cluster_id", F.lit("known").alias("label")).distinct()
    return sinks.per_line(b.select("line_id", F.col("event").alias("raw")), b.select("line_id", "cluster_id"), names)


@query("snk_03_per_cluster_ids", f"with {_BRAND} select cluster_id, line_id, concat_ws(', ', line_id, event) as out from c")
def snk_03(s, d):
    b = _brands(s, d)
    return sinks.per_cluster(b.select("line_id", F.col("event").alias("raw")), b.select("line_id", "cluster_id"), with_id=True)


@query("snk_07_evaluation_report", "select event_type as file, count(*) filter (value >= 20) as high, count(*) filter (value < 20) as low from events group by 1")
def snk_07(s, d):
    q = _table(s, d, "events").groupBy(F.col("event_type").alias("file"), F.when(F.col("value") < 20, "low").otherwise("high").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return sinks.evaluation_report(q, ["high", "low"]).fillna(0)


# ---------------------------------------------------------------- string measures

_NP = "n as (select distinct n_name from nation)"


@query("sim_07_jaro_winkler", f"with {_NP} select a.n_name as a, b.n_name as b, nullif(round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 3), 0) as jw from n a join n b on a.n_name < b.n_name")
def sim_07(s, d):
    n = _table(s, d, "nation").select("n_name").distinct()
    return n.select(F.col("n_name").alias("a")).join(n.select(F.col("n_name").alias("b")), F.col("a") < F.col("b")).select("a", "b", st.jaro_winkler_udf(F.lower("a"), F.lower("b")).alias("jw"))


@query("sim_09_edit_distance")
def sim_09(s, d):
    n = _nodes(s, d).select("node_id", F.split("event", " ").alias("tokens")).repartition("node_id")
    pairs = n.selectExpr("node_id a", "tokens ta").join(n.selectExpr("node_id b", "tokens tb"), F.expr("a <= b"))
    return pairs.select("a", "b", F.round(st.edit_distance_udf("ta", "tb", F.lit(3.0)), 6).alias("distance"))


@query("sim_12_common_subsequence")
def sim_12(s, d):
    n = _nodes(s, d).select("node_id", F.split("event", " ").alias("tokens")).repartition("node_id")
    pairs = n.selectExpr("node_id a", "tokens ta").join(n.selectExpr("node_id b", "tokens tb"), F.expr("a < b"))
    return pairs.select("a", "b", F.concat_ws(" ", st.common_subsequence_udf("ta", "tb")).alias("common"))


@query("sim_14_membership", f"with {_NODES} select a.node_id as a, b.node_id as b, len(list_intersect(string_split(a.event, ' '), string_split(b.event, ' '))) as common from nodes a join nodes b on b.node_id = a.node_id + 1")
def sim_14(s, d):
    n = _nodes(s, d).select("node_id", F.split("event", " ").alias("t"))
    return n.select(F.col("node_id").alias("a"), "t").join(n.select((F.col("node_id") - 1).alias("a"), F.col("node_id").alias("b"), F.col("t").alias("u")), "a").select("a", "b", F.size(F.array_intersect("t", "u")).alias("common"))
