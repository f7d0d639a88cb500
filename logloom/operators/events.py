"""Unique events, term weights and cluster properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import countgroup, event_tokens

from . import graph


def unique_events(lines: DataFrame, event: Column | None = None, raw: str = "raw") -> DataFrame:
    """``node_id, event, frequency, first_line, members``: equal events are one, numbered by first line."""
    key = F.concat_ws(" ", event_tokens(F.col(raw))) if event is None else event
    grouped = lines.select("line_id", key.alias("event")).groupBy("event").agg(F.count(F.lit(1)).alias("frequency"), F.min("line_id").alias("first_line"), F.sort_array(F.collect_list("line_id")).alias("members"))
    return numbered_by_ranges(grouped, "first_line", "node_id")


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Dense ids from 0 in the order of ``by``, in one task: for clusters, few against the lines."""
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(by)) - 1).cast("long"))


def numbered_by_ranges(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The same ids for any number of rows with distinct ``by``: each task orders a range, and what stands in earlier ranges is added."""
    placed = F.monotonically_increasing_id()  # the partition from bit 33 on, below it the place
    kept = graph.written(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", placed))
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))  # one row a task
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__part", before.alias("__before"))
    return kept.withColumn("__part", part).join(F.broadcast(shifts), "__part").select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(name))


def terms(events: DataFrame, tokens: Column, key: str = "node_id") -> DataFrame:
    """``key, term, tf``: term frequency as a share of the tokens; each key has one row, so nothing is shuffled.

    Equal tokens are runs of the sorted array. The generators of one element
    make each array once, since a lambda would compute it for every token.
    """
    ordered = events.select(key, F.explode(F.array(F.array_sort(tokens))).alias("s"))
    starts = F.filter(F.transform("s", lambda t, i: i), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    runs = ordered.select(key, "s", F.explode(F.array(starts)).alias("at"))
    counted = F.transform("at", lambda a, j: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("at", j + 1), F.size("s")) - a).alias("n")))
    return runs.select(key, F.size("s").alias("len"), F.explode(counted).alias("c")).select(key, "c.term", (F.col("c.n") / F.col("len")).alias("tf"))


#: Characters of a term that are looked up; what follows them is compared.
KEY = 64


def contained(terms: DataFrame, words: DataFrame) -> DataFrame:
    """``word, term``: the distinct terms that stand inside each of the distinct words.

    A word gives its substrings at the lengths that terms have, and these meet
    the terms in an equi-join; of terms beyond ``KEY`` characters the first
    ``KEY`` are the key, so a word gives no more than ``KEY`` times its length.
    """
    keyed = terms.select("term", F.substring("term", 1, KEY).alias("key"))
    lengths = keyed.agg(F.collect_set(F.length("key")).alias("lengths"))
    sized = words.join(F.broadcast(lengths)).select("word", F.explode("lengths").alias("l")).where("l > 0 and l <= length(word)")
    parts = sized.select("word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("l") + 1), lambda i: F.substring("word", i, F.col("l"))))).alias("key"))
    return parts.join(keyed, "key").where((F.length("term") <= KEY) | F.expr("contains(word, term)")).select("word", "term")


def _lines_with(terms: DataFrame, texts: DataFrame, units: Column) -> DataFrame:
    """``term, n``: texts of which a unit contains the term; texts of the same units are counted together and known by two 64-bit hashes."""
    asked = texts.join(F.broadcast(terms.limit(1).select(F.lit(True).alias("__any")))).select(units.alias("units"))
    sets = asked.groupBy("units").agg(F.count(F.lit(1)).alias("n"))
    placed = sets.select(F.xxhash64("units").alias("h"), F.xxhash64(F.lit("units"), "units").alias("g"), "n", F.explode("units").alias("word"))
    hits = placed.join(contained(terms, placed.select("word").distinct()), "word").select("h", "g", "n", "term").distinct()
    return hits.groupBy("term").agg(F.sum("n").alias("n"))


def document_frequency(term_table: DataFrame, lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``term, df``: lines that contain the term as a substring.

    A term of letters stands inside one run of letters, so it is sought in the
    distinct runs of the lines; any other term is sought in whole lines.
    """
    vocabulary = term_table.select("term").distinct()
    texts = lines.select(F.lower(raw).alias("low")).where("low is not null")
    letters = F.col("term").rlike("^[a-z]+\\z")
    runs = F.array_sort(F.array_distinct(F.filter(F.split("low", "[^a-z]+"), lambda r: r != "")))
    found = _lines_with(vocabulary.where(letters), texts, runs).unionByName(_lines_with(vocabulary.where(~letters & (F.col("term") != "")), texts, F.array("low")))
    empty = vocabulary.where("term = ''").join(F.broadcast(texts.agg(F.count(F.lit(1)).alias("n"))))  # every line contains it
    return vocabulary.join(found.unionByName(empty), "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("df"))


def tf_idf(term_table: DataFrame, df: DataFrame, n: int, key: str = "node_id") -> DataFrame:
    """``key, term, w``: tf times 1 + ln(n / df), tf itself where df is 0."""
    idf = F.when(F.col("df") == 0, F.lit(1.0)).otherwise(1 + F.log(F.lit(float(n)) / F.col("df")))
    return term_table.join(df, "term").select(key, "term", (F.col("tf") * idf).alias("w"))


def norms(weights: DataFrame, key: str = "node_id") -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def constant_positions(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Places below the shortest length whose token is the same in all rows."""
    shortest = rows.agg(F.min(F.size(tokens)).alias("shortest"))
    placed = rows.select(F.posexplode(tokens).alias("pos", "token")).join(F.broadcast(shortest)).where("pos < shortest")
    return placed.groupBy("pos").agg(F.min("token").alias("low"), F.max("token").alias("high")).where("low = high").select("pos")


def drop_constant(rows: DataFrame, tokens: str = "tokens", first_only: bool = False) -> DataFrame:
    """``line_id, event`` without the constant places (at most as many as a line has tokens)."""
    places = constant_positions(rows, tokens)
    gone = places.agg((F.array(F.min("pos")) if first_only else F.collect_list("pos")).alias("gone"))
    return rows.join(F.broadcast(gone)).select("line_id", F.concat_ws(" ", F.filter(tokens, lambda t, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))).alias("event"))


def positional_template(rows: DataFrame, group: list[str], tokens: str = "tokens") -> DataFrame:
    """``group.., template, n``: the token of each place that all rows of a group share, else ``*``."""
    sized = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    placed = rows.select(*group, F.posexplode(tokens).alias("__pos", "__w")).groupBy(*group, "__pos").agg(F.min("__w").alias("low"), F.max("__w").alias("high"))
    words = placed.select(*group, F.struct("__pos", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("*").alias("w")).alias("s"))
    made = words.groupBy(*group).agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["w"])).alias("template"))
    return sized.join(made, group, "left").select(*group, F.coalesce("template", F.lit("")).alias("template"), "n")


def word_frequency(lines: DataFrame, tokens: Column) -> DataFrame:
    return lines.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def cluster_properties(events: DataFrame, membership: DataFrame, edges: DataFrame) -> DataFrame:
    """Members, frequency, shares, inner edges and density of each cluster."""
    base = events.join(membership, "node_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.sum("frequency").alias("frequency"))
    src, dst = membership.select(F.col("node_id").alias("src"), F.col("cluster_id").alias("c1")), membership.select(F.col("node_id").alias("dst"), F.col("cluster_id").alias("c2"))
    inner = edges.join(src, "src").join(dst, "dst").where("c1 = c2").groupBy(F.col("c1").alias("cluster_id")).agg(F.count(F.lit(1)).alias("edges"))
    total = base.agg(F.sum("members").alias("all_members"), F.sum("frequency").alias("all_frequency"))
    return base.join(inner, "cluster_id", "left").join(F.broadcast(total)).select(
        "cluster_id", "members", "frequency", F.round(F.col("frequency") / F.col("all_frequency"), 6).alias("share"), F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.round(F.coalesce("edges", F.lit(0)) / F.col("members"), 6).alias("density")
    )


def interarrival(rows: DataFrame, group: str, ts: str = "ts", legacy: bool = False) -> DataFrame:
    """Seconds between first and last (0 counts as 1; ``legacy`` drops whole days) and rate by frequency."""
    span = F.unix_timestamp(F.max(F.col(ts).cast("timestamp"))) - F.unix_timestamp(F.min(F.col(ts).cast("timestamp")))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("frequency"), span.alias("span"))
    seconds = F.col("span") % 86400 if legacy else F.col("span")
    seconds = F.when(seconds == 0, 1).otherwise(seconds).cast("long")
    return out.select(group, "frequency", seconds.alias("seconds"), F.round(seconds / F.col("frequency"), 6).alias("rate"))


def centroids(rows: DataFrame, cluster: str, order: str, text: str, distinct: bool = True) -> DataFrame:
    """Texts of each cluster end to end in order; distinct words, first seen, unless told otherwise."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    words = F.flatten(F.transform(texts, lambda t: F.split(t, " ")))
    return rows.groupBy(cluster).agg(F.concat_ws(" ", F.array_distinct(words) if distinct else words).alias("centroid"))


def countgroup_text(raw: Column) -> Column:
    return F.concat_ws(" ", countgroup(raw))
