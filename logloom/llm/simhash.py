"""SimHash near-duplicates by the pigeonhole principle.

A fingerprint of 64 bits is cut into ``radius + 2`` blocks.  Two fingerprints
that differ in at most ``radius`` bits agree on at least two whole blocks, so
they meet under one of the pairs of blocks.  Under each pair the fingerprints
that share it are compared by Hamming distance; what a bucket yields is a
spanning forest of its links, never all its pairs.  Buckets over
``BUCKET`` fingerprints are dealt into chunks, and every two chunks meet in a
task of their own, so no task holds more than two chunks and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices
from .components import components
from .words import normal, shingle_hashes

#: Distinct fingerprints of a bucket that one task compares as they are.
BUCKET = 1024


def simhash(texts: list[bytes], width: int) -> np.ndarray:
    """Fingerprints (uint64) of normalised texts: a bit is 1 if more than half of the shingle hashes have it."""
    return simhash_of(*shingle_hashes(texts, width)[:2])


def simhash_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints of texts whose shingle hashes begin at ``first`` (one more at the end)."""
    out = np.zeros(len(first) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in range(len(first) - 1):
        s, e = first[i], first[i + 1]
        if e > s:
            ones = np.zeros(64, np.int64)
            for k in range(s, e, 1 << 16):
                bits = np.unpackbits(hashes[k : min(e, k + (1 << 16))].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(0, dtype=np.uint32)
            out[i] = weights[2 * ones > e - s].sum(dtype=np.uint64)
    return out


def fingerprints(documents: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp`` of every row (fp: the 64 bits as a signed long)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            parts = [simhash(texts[s:e], width) for s, e in slices([len(t) + 1 for t in texts])]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], names=[key, "fp"])

    return documents.select(documents[key], documents[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, fp long")


def block_masks(radius: int) -> list[int]:
    """Signed masks of all pairs out of ``radius + 2`` blocks of the 64 bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(n)]
    return [int(np.uint64(a | b).astype(np.int64)) for a, b in combinations(blocks, 2)]


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links inside each run of equal ``group`` values."""
    n = len(fp)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n) if n else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    label = np.arange(n)
    rows, d = np.arange(n), 1
    while len(rows := rows[rows + d < end[rows]]):
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows + d]) <= radius]
        a, b = near, near + d
        while len(a):
            ra, rb = label[a], label[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
            while (jump := label[label] != label).any():
                label[jump] = label[label[jump]]
        d += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges ``a, b`` that connect all of ``distinct(fp)`` within ``radius`` bits of each other."""
    masks = F.array(*(F.lit(m).cast("long") for m in block_masks(radius)))
    keyed = distinct.select("fp", F.posexplode(masks).alias("c", "mask")).select("fp", "c", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    counts = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    dealt = (
        keyed.join(cut_lineage(counts), ["c", "k"])
        .withColumn("s", chunks)
        .withColumn("i", own)
        .withColumn("j", F.explode(F.when(F.col("s") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("s") - 1), lambda x: x != F.col("i")))))
        .select(F.xxhash64("c", "k", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "fp")
    )
    sorted_ = dealt.repartition("g").sortWithinPartitions("g", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_g, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(g, fp):
            a, b = forest(g, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            g = np.concatenate([rest_g, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(g):
                continue
            whole = np.searchsorted(g, g[-1], "left")  # the last group may go on
            rest_g, rest_fp = g[whole:], fp[whole:]
            if whole:
                yield out(g[:whole], fp[:whole])
        if len(rest_g):
            yield out(rest_g, rest_fp)

    return sorted_.mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fingerprint, component_id`` of every row.

    The fingerprint has 16 lower-case hex digits; component_id is the smallest
    key that can be reached over links of at most ``radius`` differing bits.
    Texts without words (null and empty ones too) have fingerprint zero and
    link like any other.  Null keys stay and never name a component unless it
    has no other; rows that repeat share a component; an empty table gives no
    rows; other columns are not read.
    """
    prints = cut_lineage(fingerprints(documents, width, text, key))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut_lineage(rooted.select("fp", "root").join(cut_lineage(named), "root").select("fp", "component_id"))
    return prints.join(of, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, width: int = 5, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of near-duplicates: the one with the least key (null last); all columns stay.

    Rows that repeat both key and text are one.  Texts without words, null
    among them, are one component.
    """
    parts = F.coalesce(documents[key].cast("string"), F.lit("\x00")), F.coalesce(documents[text].cast("string"), F.lit(""))
    row = F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))
    place = F.struct(documents[key].isNull().alias("last"), documents[key].alias("key"), row.alias("row"))
    found = near_duplicates(documents.select(place.alias("place"), documents[text].alias("text")), width, radius, "text", "place")
    first = cut_lineage(found.select("component_id.row").distinct())
    # The columns travel in one struct, so that their names cannot clash with those of the join.
    whole = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("kept"), row.alias("row")).dropDuplicates(["row"])
    return whole.join(first, "row", "left_semi").select("kept.*")
