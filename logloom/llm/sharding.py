"""Histogram sort: shards of near-equal bytes with one exchange, DataFrame operations only.

Rows are ordered by a 64-bit hash of their text.  Each round counts the exact
bytes below evenly spaced probe keys, on all partitions; an interval that
holds a wanted boundary is probed again 4096 times finer, until the bytes
below a probe are within the tolerance of the wanted number or the interval
is a single key.  Then every row knows its shard, and rows move once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_bytes

#: Bits that one round of probes resolves, and parts into which rows of equal keys are dealt for numbering.
BITS, SALTS = 12, 16


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.col("sort_key"), 64 - bits)


def splitters(sized: DataFrame, shards: int, tolerance: float = 0.001) -> list[int]:
    """``shards - 1`` boundaries as unsigned 64-bit keys, ascending; a row is below a boundary if its key is less.

    The driver gets at most ``4096 * (shards - 1)`` sums in a round.
    """
    done: dict[int, int] = {}
    open_: dict[int, list[int]] = {0: list(range(1, shards))}  # prefix of an interval -> boundaries in it
    below_of = {0: 0}
    bits, total = 0, None
    while open_:
        wider = min(64, bits + BITS)
        rows = sized if not bits else sized.where(_prefix(bits).isin(list(map(_signed, open_))))
        sums = {r["p"] % (1 << 64): r["b"] for r in rows.groupBy(_prefix(wider).alias("p")).agg(F.sum("size").alias("b")).collect()}
        if total is None:
            total = sum(sums.values())
        again: dict[int, list[int]] = {}
        again_below: dict[int, int] = {}
        step = wider - bits
        for interval, wanted in open_.items():
            below, k = below_of[interval], 0
            inside = sorted(p for p in sums if p >> step == interval)
            for p in inside:
                upto = below + sums[p]
                while k < len(wanted) and total * wanted[k] / shards <= upto:
                    target = total * wanted[k] / shards
                    near = p if target - below <= upto - target else p + 1
                    if wider == 64 or min(target - below, upto - target) <= tolerance * total / shards:
                        done[wanted[k]] = near << (64 - wider)
                    else:
                        again.setdefault(p, []).append(wanted[k])
                        again_below[p] = below
                    k += 1
                below = upto
            for w in wanted[k:]:
                done[w] = (interval + 1) << (64 - bits)
        open_, below_of, bits = again, again_below, wider
    return [done[i] for i in range(1, shards)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shard(documents: DataFrame, shards: int = 16, tolerance: float = 0.001, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Put all rows into ``shards`` shards of near-equal bytes; rows of equal text stay together.

    ``key, size`` (UTF-8 bytes + 1), ``text_crc32, law`` ("bytes"), ``shard``,
    ``slot`` (0, 1, .. in each shard), ``grown_shard`` (null: only the law by
    key has it).  Sizes differ from the mean by the tolerance and by the largest
    group of equal texts that lies on a boundary.  A null text counts as
    an empty one; null keys and repeated rows are
    kept as they are; an empty table gives no rows; other columns are not read.
    """
    body = documents[text].cast("string")
    slim = cut_lineage(
        documents.select(
            documents[key].alias("key"),
            (text_bytes(text) + 1).alias("size"),
            F.crc32(F.coalesce(body, F.lit(""))).alias("text_crc32"),
            F.xxhash64(F.coalesce(body, F.lit(""))).alias("sort_key"),
            F.pmod(F.xxhash64(documents[key], F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt"),
        )
    )
    edges = splitters(slim, shards, tolerance)
    flipped = F.col("sort_key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order as signed order
    number = reduce(lambda a, b: a + b, (F.when(flipped >= F.lit(e - (1 << 63)).cast("long"), 1).otherwise(0) for e in edges if e < 1 << 64), F.lit(0))
    dealt = slim.withColumn("shard", number.cast("int")).withColumn("part", _prefix(BITS) * SALTS + F.col("salt"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("sort_key", "key"))
    return (
        dealt.withColumn("nth", nth)
        .join(bases, ["shard", "part"])
        .select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
