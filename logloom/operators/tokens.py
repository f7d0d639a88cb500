"""Clustering by token positions, frequent words and term pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Lines of one task where each line brings keys of its own into a count.
DEALT = 100_000


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out to tasks of ``DEALT`` lines, so that the partial counts of a task fit its memory however the files are cut."""
    parts = -(-rows.count() // DEALT)
    return rows.repartition(parts) if parts > 1 else rows


def by_count(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Step 1: partition by token count."""
    return rows.select("line_id", tokens, F.size(tokens).alias("part"))


def by_position(rows: DataFrame, support: int = 0) -> DataFrame:
    """Step 2: split each part by the place with the fewest distinct tokens (the first of equals).

    ``line_id, tokens, part, pos, token``; a part whose fewest is 1, or that has
    at most ``support`` lines, is not split (pos -1, empty token). The choices,
    one for each number of tokens that a line has, are broadcast: few parts hold
    nearly all lines, so a shuffle by part would put these into few tasks.
    """
    placed = rows.select("part", F.posexplode("tokens").alias("pos", "token"))
    distinct = placed.groupBy("part", "pos").agg(F.countDistinct("token").alias("d"))
    best = distinct.groupBy("part").agg(F.min(F.struct("d", "pos")).alias("b")).select("part", F.col("b.d").alias("d"), F.col("b.pos").alias("best"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    chosen = best.join(sizes, "part").select("part", F.when((F.col("d") > 1) & (F.col("n") > support), F.col("best")).otherwise(-1).alias("pos"))
    return rows.join(F.broadcast(chosen), "part", "left").select("line_id", "tokens", "part", F.coalesce("pos", F.lit(-1)).alias("pos"), F.when(F.col("pos") >= 0, F.get("tokens", F.col("pos"))).otherwise("").alias("token"))


def mapping(rows: DataFrame, p1: int, p2: int) -> DataFrame:
    """Step 3: kind of mapping between the tokens of two places, for each pair of a part."""
    pairs = rows.where(F.size("tokens") > max(p1, p2)).select("part", F.col("tokens")[p1].alias("t1"), F.col("tokens")[p2].alias("t2")).distinct()
    n1 = pairs.groupBy("part", "t1").agg(F.count(F.lit(1)).alias("n1"))
    n2 = pairs.groupBy("part", "t2").agg(F.count(F.lit(1)).alias("n2"))
    both = pairs.join(n1, ["part", "t1"]).join(n2, ["part", "t2"])
    worst1 = both.groupBy("part", "t1").agg(F.max("n2").alias("m2"))
    worst2 = both.groupBy("part", "t2").agg(F.max("n1").alias("m1"))
    full = both.join(worst1, ["part", "t1"]).join(worst2, ["part", "t2"])
    kind = F.when((F.col("n1") == 1) & (F.col("n2") == 1), "1-1").when((F.col("n1") > 1) & (F.col("m2") == 1), "1-M").when((F.col("n2") > 1) & (F.col("m1") == 1), "M-1").otherwise("M-M")
    return full.select("part", "t1", "t2", kind.alias("kind"))


def split_rank(kind: Column, cardinality: Column, lines: Column, lower: float = 0.25) -> Column:
    """Side to split on: 1 or 2."""
    few = cardinality / lines <= lower
    return F.when(kind == "1-M", F.when(few, 2).otherwise(1)).when(kind == "M-1", F.when(few, 1).otherwise(2)).otherwise(1)


def term_pairs(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Ordered pairs of tokens of each line, first place before second."""
    i = F.posexplode(tokens).alias("i", "first")
    return rows.select("line_id", tokens, i).select("line_id", "first", F.explode(F.slice(tokens, F.col("i") + 2, F.size(tokens))).alias("next"))


def distinct_term_pairs(rows: DataFrame, *keep: str, tokens: str = "tokens") -> DataFrame:
    """The pairs of each line once, with the columns ``keep``, without a shuffle: the first place of a token sees all that follow it."""
    firsts = rows.select(*keep, tokens, F.posexplode(tokens).alias("i", "first")).where(F.array_position(tokens, F.col("first")) == F.col("i") + 1)
    return firsts.select(*keep, "first", F.explode(F.array_distinct(F.slice(tokens, F.col("i") + 2, F.size(tokens)))).alias("next"))


def initial_group(line_id: Column, k: int, seed: int = 0) -> Column:
    digest = F.conv(F.substring(F.md5(F.concat_ws("-", line_id.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.pmod(digest, F.lit(k)).cast("int")


def initial_groups(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """A group for each line from a hash of its id and a seed."""
    return rows.select("line_id", initial_group(F.col("line_id"), k, seed).alias("group_id"))


def pair_counts(grouped: DataFrame) -> DataFrame:
    """``group_id, first, next, n``: lines of a group (``line_id, tokens, group_id``) that have the pair."""
    return distinct_term_pairs(grouped, "group_id").groupBy("group_id", "first", "next").agg(F.count(F.lit(1)).alias("n"))


def signatures(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Words that stand in at least half of the lines of a group."""
    sized = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("lines"))
    words = rows.select("line_id", F.explode(F.array_distinct("tokens")).alias("word")).join(groups, "line_id").groupBy("group_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(sized, "group_id").where("n >= ceil(lines / 2)").select("group_id", "word", "n")


def frequent_words(rows: DataFrame, percent: float, lines: int, tokens: str = "tokens") -> DataFrame:
    """Words that occur at least ``floor(percent * lines / 100)`` times."""
    return rows.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= int(percent * lines / 100))


#: Words (or places with words) that are looked up inside a line; where there are more, they are joined.
LISTED = 10_000


def _listed(found: DataFrame, column: str) -> list[str] | None:
    """The values of a column of distinct strings, or nothing where they are more than ``LISTED``."""
    values = [r[0] for r in found.select(column).limit(LISTED + 1).collect()]
    return values if len(values) <= LISTED else None


def candidates(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``line_id, candidate``: the frequent words of each line in order; none: null.

    Words that stand in a share of the lines are few, so each line looks them up
    and nothing is shuffled.
    """
    words = _listed(frequent, "word")
    if words is not None:
        made = F.concat_ws(" ", F.filter("tokens", lambda t: t.isin(words) if words else F.lit(False)))
        return rows.select("line_id", F.when(F.exists("tokens", lambda t: t.isin(words) if words else F.lit(False)), made).alias("candidate"))
    placed = rows.select("line_id", F.posexplode("tokens").alias("pos", "word")).join(frequent.select("word"), "word")
    made = placed.groupBy("line_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"])).alias("candidate"))
    return rows.select("line_id").join(made, "line_id", "left")


def candidate_gaps(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``candidate, slot, low, high, n``: fewest and most other words before each frequent word, and after the last."""
    words = _listed(frequent, "word")
    if words is not None:
        kept = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("pos"), t.alias("word"))), lambda x: x["word"].isin(words) if words else F.lit(False))
        by_line = rows.select("line_id", F.size("tokens").alias("len"), F.explode(F.array(kept)).alias("s")).where(F.size("s") > 0)  # the generator makes it once
    else:
        placed = rows.select("line_id", F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "word")).join(frequent.select("word"), "word")
        by_line = placed.groupBy("line_id", "len").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("s"))
    places = F.concat(F.array(F.lit(-1)), F.transform("s", lambda x: x["pos"]), F.array(F.col("len")))
    gaps = F.zip_with(places, F.slice(places, 2, 1_000_000), lambda a, b: b - a - 1)
    slots = by_line.select(F.concat_ws(" ", F.transform("s", lambda x: x["word"])).alias("candidate"), F.posexplode(F.filter(gaps, lambda g: g.isNotNull())).alias("slot", "gap"))
    return slots.groupBy("candidate", "slot").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("n"))


def pretty(gaps: DataFrame) -> DataFrame:
    """``candidate, pattern``: ``*{low,high} word ..`` with the trailing gap."""
    slot = F.struct("slot", F.concat(F.lit("*{"), F.col("low").cast("string"), F.lit(","), F.col("high").cast("string"), F.lit("}")).alias("g"))
    made = gaps.groupBy("candidate").agg(F.transform(F.array_sort(F.collect_list(slot)), lambda s: s["g"]).alias("g"), F.max("n").alias("support"))
    return made.select("candidate", F.concat_ws(" ", F.flatten(F.zip_with("g", F.split("candidate", " "), lambda g, w: F.array_compact(F.array(g, w))))).alias("pattern"), "support")


def line_patterns(rows: DataFrame, support: int) -> DataFrame:
    """Frequent (place, word) pairs make a pattern of each line; patterns below the support go.

    Lines look up the pairs of at least one line in a thousand, few by their
    share. Only for the other pairs are tokens joined, and then without any word
    that most lines have.
    """
    at = lambda i, w: F.concat_ws(" ", i.cast("string"), w)
    placed = rows.select("line_id", F.posexplode("tokens").alias("pos", "word"))
    often = graph.written(placed.groupBy("pos", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select(at(F.col("pos"), F.col("word")).alias("at"), "n"))
    bar = max(support, rows.count() // 1000)
    known = _listed(often.where(F.col("n") >= bar), "at") or []
    rest = often.where(F.col("n") < bar).select("at") if known else often.select("at")
    listed = lambda i, w: at(i, w).isin(known) if known else F.lit(False)
    if rest.isEmpty():
        whole = rows.where(F.size("tokens") > 0).select(F.transform("tokens", lambda w, i: F.when(listed(i, w), w).otherwise("*")).alias("words"))
    else:
        asked = placed.where(~listed(F.col("pos"), F.col("word"))).select("line_id", "pos", at(F.col("pos"), F.col("word")).alias("at"))
        more = asked.join(rest, "at").groupBy("line_id").agg(F.collect_list("pos").alias("more"))
        both = rows.where(F.size("tokens") > 0).join(more, "line_id", "left")
        whole = both.select(F.transform("tokens", lambda w, i: F.when(listed(i, w) | F.coalesce(F.array_contains("more", i), F.lit(False)), w).otherwise("*")).alias("words"))
    return whole.groupBy(F.concat_ws(" ", "words").alias("pattern")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def two_means(values: DataFrame, column: str, rounds: int = 20) -> float | None:
    """Least value of the upper of two clusters on a line, started from the extremes."""
    row = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high = row["a"], row["b"]
    if low is None or low == high:
        return low
    for _ in range(rounds):
        upper = F.abs(F.col(column) - low) > F.abs(F.col(column) - high)
        r = values.agg(F.avg(F.when(~upper, F.col(column))).alias("a"), F.avg(F.when(upper, F.col(column))).alias("b"), F.min(F.when(upper, F.col(column))).alias("least")).first()
        if (r["a"], r["b"]) == (low, high):
            break
        low, high = r["a"], r["b"]
    return r["least"]


def assign_templates(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """``line_id, template_id``: the first template (longest first) all of whose fragments the line contains.

    ``templates(template_id, fragments)`` is a result of clustering, so it is
    small against the lines; Spark broadcasts it within its size threshold.
    """
    matched = lines.join(templates, F.forall("fragments", lambda f: F.contains(F.col("raw"), f)))
    rank = F.struct((-F.aggregate("fragments", F.lit(0), lambda s, f: s + F.length(f))).alias("l"), "template_id")
    return matched.groupBy("line_id").agg(F.min(rank).alias("r")).select("line_id", F.col("r.template_id").alias("template_id"))


def position_cardinalities(rows: DataFrame) -> DataFrame:
    """``part, card, places, first``: how many places of a part have each number of distinct tokens, and the first of them."""
    cards = rows.select("part", F.posexplode("tokens").alias("pos", "token")).groupBy("part", "pos").agg(F.countDistinct("token").alias("card"))
    return cards.groupBy("part", "card").agg(F.count(F.lit(1)).alias("places"), F.min("pos").alias("first"))


def goodness(rows: DataFrame) -> DataFrame:
    """Share of constant places of each part."""
    cards = position_cardinalities(rows)
    return cards.groupBy("part").agg(F.round(F.sum(F.when(F.col("card") == 1, F.col("places")).otherwise(0)) / F.sum("places"), 6).alias("goodness"))


def token_entropy(rows: DataFrame) -> DataFrame:
    """Entropy of the tokens of each place, counts over the number of distinct tokens."""
    n = rows.select("part", F.posexplode("tokens").alias("pos", "token")).groupBy("part", "pos", "token").agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy("part", "pos").agg(F.count(F.lit(1)).alias("d"))
    p = F.col("n") / F.col("d")
    return n.join(d, ["part", "pos"]).groupBy("part", "pos").agg(F.round(F.sum(-p * F.log(p)), 6).alias("entropy"))


def support_sweep(rows: DataFrame, percents: list[int], lines: int) -> DataFrame:
    """``percent, words``: frequent words at each relative support, from one count of the words."""
    counts = rows.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("n", F.explode(F.array(*map(F.lit, percents))).alias("percent")).groupBy("percent").agg(F.count_if(F.col("n") >= F.floor(F.col("percent") * lines / 100)).alias("words"))


def local_search(pairs: list[set[tuple[str, str]]], groups: list[int], k: int, rounds: int = 50) -> list[int]:
    """Move lines between groups while the potential of shared term pairs rises; the first strictly best group wins.

    The potential of a line in a group is the sum, over its pairs, of the cubed
    share of the group's lines that have the pair.
    """
    sizes, counts = [0] * k, [dict() for _ in range(k)]
    for own, g in zip(pairs, groups, strict=True):
        sizes[g] += 1
        for p in own:
            counts[g][p] = counts[g].get(p, 0) + 1
    for _ in range(rounds):
        moved = False
        for i, own in enumerate(pairs):
            g = groups[i]
            value = [sum((counts[c].get(p, 0) / sizes[c]) ** 3 for p in own) if sizes[c] else 0.0 for c in range(k)]
            best = max(range(k), key=lambda c: (value[c], -c))
            if value[best] > value[g] + 1e-12:
                moved = True
                groups[i] = best
                sizes[g] -= 1
                sizes[best] += 1
                for p in own:
                    counts[g][p] -= 1
                    counts[best][p] = counts[best].get(p, 0) + 1
        if not moved:
            break
    return groups
