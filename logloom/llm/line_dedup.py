"""Fuzzy line dedup by MinHash, DataFrame operations only.

Lines are verified by the exact Jaccard similarity of all their character
shingles and signed by the same shingles.  The hashes of a line are sorted; a
band is ``BAND`` hashes that follow one another, and like lines share one:

* A line of fewer than ``LEAST`` shingles and one that is like it share one of the
  least fifth of their hashes (and one more); each of these is a band.
* Below ``EVERY`` shingles a band begins at every hash.  Like lines that differ in
  ``d`` hashes share at least ``4 d``, so somewhere in the order of both at least
  ``BAND`` shared ones follow one another.
* Other lines have a band at the beginning of each of ``RANGES`` ranges of hashes,
  so every shingle is hashed once.  At a similarity of just 0.8 each is shared
  with probability 0.8 ** 3 or so, and all are missed with about 0.49 ** 32, or
  1e-10, were they independent; the nearer two lines, the less.

Every two lines of a bucket are compared unless their sizes rule likeness out or
they are in one component already.  First all lines meet the one that meets most
others, as the original of many copies does; then buckets that hold several
components have rounds of a further line each, as long as rounds find like
lines; in what is left then, crowded buckets are dealt into chunks that all
meet.  There sketches come before texts: in a sketch every shingle turns over
one bit, so two differ in no more bits than shingles that only one line has,
and pairs beyond what a similarity of 0.8 allows go without a loss.
Distributed union-find keeps one line of each component.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, discard, may_match, release, stored
from .components import components

#: Characters in a shingle, least Jaccard similarity, and that as a ratio of whole numbers.
SHINGLE, SIMILARITY, RATIO = 8, 0.8, (4, 5)
#: Ranges of hashes, hashes in a band, shingles of lines with bands of a single hash and with a band at every hash (both below).
RANGES, BAND, LEAST, EVERY = 32, 3, 16, 64
#: Rounds of a further line each go on while this share of a round's pairs is alike; then buckets are crossed, by chunks of so many lines.
YIELD, CHUNK = 0.01, 256
#: Words of 64 bits in a sketch.
WORDS = 16
BLANK = " \t\n\x0b\x0c\r"


def shingles(line: Column) -> Column:
    """Hashes of the shingles, one for each place; a line that is shorter is one shingle."""
    wide = 4 * SHINGLE  # four bytes a character, so that a place is found without counting
    places = lambda t: F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(t) - (wide - 1)), F.lit(4))
    of = lambda t: F.transform(places(t), lambda i: F.xxhash64(F.substring(t, i, F.lit(wide))))
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-32")), of), 1)


def filled(line: Column) -> Column:
    """Whether a line holds more than white space."""
    return F.trim(line, F.lit(BLANK)) != ""


def row_id(documents: DataFrame, text: str, key: str) -> list[Column]:
    """128 bits, in two columns, that stand for key and text of a row."""
    parts = F.coalesce(documents[key].cast("string"), F.lit("\x00")), F.coalesce(documents[text].cast("string"), F.lit(""))
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def occurrences(documents: DataFrame, text: str, key: str) -> DataFrame:
    """``id, id2, key, pos, line`` of every line with more than white space; id and id2 stand for key and text."""
    body = F.coalesce(documents[text].cast("string"), F.lit(""))
    one, two = row_id(documents, text, key)
    rows = documents.select(one.alias("id"), two.alias("id2"), documents[key].alias("key"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    return rows.where(filled(F.col("line")))


def _held(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns; a generator keeps the optimizer from repeating their expressions wherever they are named."""
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("__made")
    return df.select(*keep, made).select(*keep, *[F.col(f"__made.{name}").alias(name) for name in columns])


def shingle_sets(df: DataFrame, keep: list[str], **lines: str) -> DataFrame:
    """``keep`` and sorted sets of the hashes of the distinct shingles of columns of lines.

    Functions of elements keep a whole operator out of generated code, so they stand alone in theirs: interpreted, sorting takes as long as they do.
    """
    found = _held(df, keep, **{name: shingles(F.col(line)) for name, line in lines.items()})
    return _held(found, keep, **{name: F.array_distinct(F.sort_array(name)) for name in lines})


def bands(lines: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``n`` (distinct shingles) and ``band``, a hash, for each band of each ``line``."""
    up, down = RATIO
    found = _held(shingle_sets(lines, keep, g="line"), [*keep, "g"], n=F.size("g"))
    # Places from 1 on are those of bands, and below 0 those of single hashes of short lines.
    # Two like sets, one of fewer than LEAST shingles, share one of the least of both.
    least = F.when(F.col("n") <= LEAST * down // up - 1, F.sequence(F.lit(-1), -F.floor(F.col("n") * (down - up) / down).cast("int") - 1, F.lit(-1)))
    runs = F.when(F.col("n") >= LEAST, F.sequence(F.lit(1), F.col("n") - (BAND - 1)))
    none = F.array().cast("array<int>")
    spread = found.select(*keep, "g", "n", F.explode(F.concat(F.coalesce(least, none), F.coalesce(runs, none))).alias("p"))
    # From EVERY shingles on those places stay whose hash is the first of its range, the top bits of a sorted (signed) hash.
    part = lambda i: F.shiftrightunsigned(F.get("g", i), 65 - RANGES.bit_length())
    spread = spread.where((F.col("p") <= 1) | (F.col("n") < EVERY) | (part(F.col("p") - 1) != part(F.col("p") - 2)))
    run = F.xxhash64(*[F.get("g", F.col("p") - 1 + i) for i in range(BAND)])
    return spread.select(*keep, "n", F.when(F.col("p") < 0, F.xxhash64(F.get("g", -F.col("p") - 1))).otherwise(run).alias("band"))


def _can_be(na: str, nb: str) -> Column:
    """Whether sets of these sizes can be like one another."""
    up, down = RATIO
    return down * F.least(na, nb) >= up * F.greatest(na, nb)


def like(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of lines whose exact Jaccard similarity is at least ``SIMILARITY``."""
    up, down = RATIO
    left, right = texts.select(F.col("k").alias("a"), F.col("line").alias("la")), texts.select(F.col("k").alias("b"), F.col("line").alias("lb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")
    sets = shingle_sets(met, ["a", "b"], sa="la", sb="lb")
    sized = _held(sets, ["a", "b"], shared=F.size(F.array_intersect("sa", "sb")), total=F.size("sa") + F.size("sb"))
    return sized.where((up + down) * F.col("shared") >= up * F.col("total")).select("a", "b")


def line_classes(documents: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Written tables ``lines(id, id2, key, pos, lid, lid2)`` and ``classes(lid, lid2, root)`` of the lines that are like another.

    ``lid`` and ``lid2`` are hashes of a line.  Of texts that share a ``lid``
    only one takes part in comparisons; the other ``lid2`` keep them apart.
    In the graph a line is its number ``k``.  ``lines`` are written last, since
    disk is fullest while the bands are.
    """
    both = {"lid": F.xxhash64("line"), "lid2": F.xxhash64(F.lit(1), "line")}
    found = occurrences(documents, text, key)
    distinct = found.select(both["lid"].alias("lid"), "line").groupBy("lid").agg(F.first("line").alias("line"))
    texts = stored(distinct.select(F.monotonically_increasing_id().alias("k"), "line"))
    release(documents.sparkSession)
    banded = bands(texts, ["k"])
    met = F.count(F.lit(1)).over(Window.partitionBy("band"))
    buckets = stored(banded.select("band", "k", "n", met.alias("met")).where("met > 1"))
    release(documents.sparkSession)
    # The first line of a bucket is the one that meets most lines in all its buckets, as the original of many copies does.
    most = stored(buckets.groupBy("k").agg(F.sum("met").alias("most")))
    firsts = stored(buckets.join(most, "k").groupBy("band").agg(F.max(F.struct("most", "k", "n")).alias("f")).selectExpr("band", "f.k first", "f.n nf"))
    others = buckets.select("band", "k", "n").join(firsts, "band").where("k <> first")
    seen = stored(others.where(_can_be("n", "nf")).selectExpr("least(first, k) a", "greatest(first, k) b").distinct())
    edges = stored(like(seen, texts))
    roots = components(edges)
    open_ = _open(others.select("band", "k", "n"), roots)
    discard(buckets, most, firsts)
    turn, found_like = 0, 1.0
    while found_like >= YIELD and not open_.isEmpty():
        turn += 1
        firsts = stored(open_.groupBy("band").agg(F.min(F.struct(F.xxhash64("k", F.lit(turn)).alias("h"), "k", "n", "root")).alias("f")).selectExpr("band", "f.k first", "f.n nf", "f.root rf"))
        others = stored(open_.join(firsts, "band").where("k <> first"))
        discard(open_, firsts)
        pairs = stored(others.where("root <> rf").where(_can_be("n", "nf")).selectExpr("least(first, k) a", "greatest(first, k) b").distinct().join(seen, ["a", "b"], "left_anti"))
        more = stored(like(pairs, texts))
        found_like = more.count() / max(1, pairs.count())
        seen, edges = seen.unionByName(pairs), edges.unionByName(more)
        if found_like:
            roots = components(edges)
        open_ = _open(others.select("band", "k", "n"), roots)
        discard(others)
    if not open_.isEmpty():
        crossed = _crossed(open_, texts)
        pairs = stored(crossed.join(seen, ["a", "b"], "left_anti"))
        discard(crossed)
        more = stored(like(pairs, texts))
        if not more.isEmpty():
            roots = components(edges.unionByName(more))
        discard(pairs)
    classes = stored(texts.select("k", *[c.alias(name) for name, c in both.items()]).join(roots.select(F.col("node").alias("k"), "root"), "k").select("lid", "lid2", "root"))
    discard(open_, texts)
    return stored(found.withColumns(both).select("id", "id2", "key", "pos", *both)), classes


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, k, n, root`` of the members of buckets that hold several components."""
    named = stored(members.join(roots.withColumnRenamed("node", "k"), "k", "left").select("band", "k", "n", F.coalesce("root", "k").alias("root")))
    mixed = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    out = stored(named.join(mixed, "band", "left_semi"))
    discard(named)
    return out


def sketches(texts: DataFrame) -> DataFrame:
    """``k, sketch`` of each ``line``: ``64 * WORDS`` bits, each turned over by every shingle that falls on it."""
    each = shingle_sets(texts, ["k"], g="line").select("k", F.explode("g").alias("x"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 8) % 64 as int))")
    words = [F.bit_xor(F.when(F.pmod("x", F.lit(WORDS)) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)]
    return each.groupBy("k").agg(*words).select("k", F.array(*[f"w{w}" for w in range(WORDS)]).alias("sketch"))


def _near(sa: str, sb: str, na: str, nb: str) -> Column:
    """Whether sketches let sets of these sizes be alike: bits that differ are no more than shingles that only one has."""
    up, down = RATIO
    differ = reduce(add, [F.bit_count(F.get(sa, F.lit(w)).bitwiseXOR(F.get(sb, F.lit(w)))) for w in range(WORDS)])
    return (up + down) * differ <= (down - up) * (F.col(na) + F.col(nb))


def _crossed(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs ``a, b`` of a bucket that are in two components and may be alike by sizes and sketches; no task gets more than two chunks at once."""
    own = stored(sketches(texts.join(members.select("k").distinct(), "k", "left_semi")))
    sized = members.join(members.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "band").join(own, "k")
    dealt = stored(sized.withColumn("x", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int")))
    side = lambda s: [F.col(c).alias(c[0] + s) for c in ("k", "n", "root", "sketch")]
    left = dealt.select("band", F.col("x").alias("u"), F.explode(F.sequence("x", F.col("chunks") - 1)).alias("v"), *side("a"))
    right = dealt.select("band", F.explode(F.sequence(F.lit(0), "x")).alias("u"), F.col("x").alias("v"), *side("b"))
    met = left.join(right, ["band", "u", "v"]).where("ra <> rb and (u < v or ka < kb)").where(_can_be("na", "nb")).where(_near("sa", "sb", "na", "nb"))
    out = stored(met.selectExpr("least(ka, kb) a", "greatest(ka, kb) b").distinct())
    discard(own, dealt)
    return out


def removals(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Written table ``id, id2, gone``: the places of the lines that go, for every row that loses one."""
    lines, classes = line_classes(documents, text, key)
    place = F.struct(F.col("key").isNull().alias("k"), "key", "id", "id2", "pos")
    per_line = lines.groupBy("lid", "lid2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    root, own = F.coalesce("root", "lid").alias("root"), F.when(F.col("root").isNull(), F.col("lid2")).otherwise(0).alias("own")
    rooted = stored(per_line.join(classes, ["lid", "lid2"], "left").where("n > 1 or root is not null").select("lid", "lid2", "first", root, own))
    kept = stored(rooted.groupBy("root", "own").agg(F.min("first").alias("first")))
    keeper = stored(rooted.select("lid", "lid2", "root", "own").join(kept, ["root", "own"]).select("lid", "lid2", F.col("first.id").alias("kid"), F.col("first.id2").alias("kid2"), F.col("first.pos").alias("kpos")))
    marked = may_match(lines.select("id", "id2", "pos", "lid", "lid2"), "lid", bit_filter(keeper, "lid")).join(keeper, ["lid", "lid2"])
    gone = stored(marked.where("id <> kid or id2 <> kid2 or pos <> kpos").groupBy("id", "id2").agg(F.collect_set("pos").alias("gone")))
    discard(lines, classes, rooted, kept, keeper)
    return gone


def dedup_lines(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns, ``text`` without the lines that go, and ``n_lines, n_removed``.

    Of each component of equal or like lines the one stays that comes first by
    key (null last), then by place.  Lines of white space alone stay.  Rows
    that repeat both key and text count as one and get the same result.  A null
    text stays null with 0 lines; an empty table gives no rows; existing columns
    named ``n_lines`` or ``n_removed`` are replaced, all others may have any name.
    """
    gone = removals(documents, text, key)
    names = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    one, two = row_id(documents, text, key)
    # The columns travel in one struct, so that their names cannot clash with those of the join.
    left = documents.select(F.struct(*[documents[c] for c in names]).alias("row"), one.alias("id"), two.alias("id2"))
    joined = left.join(gone.hint("shuffle_hash"), ["id", "id2"], "left")
    own = F.col("row").getField(text)
    lines = F.split(own.cast("string"), "\n")
    n_lines = F.size(F.filter(lines, filled))
    clean = F.concat_ws("\n", F.filter(lines, lambda x, i: ~F.array_contains("gone", i)))
    new = F.when(F.col("gone").isNull() | own.isNull(), own).otherwise(clean)
    return joined.select(
        *[(new if c == text else F.col("row").getField(c)).alias(c) for c in names],
        F.when(own.isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )
