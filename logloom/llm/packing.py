"""Large-item matching: pack token pieces into as few sequences as possible.

The decisions are made on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is.  Pieces above a third of the
capacity meet at most twice in a bin: the longest unmatched one takes the
longest partner that still fits (greedy matching).  Shorter pieces, longest
first, then go to the smallest gap that holds them.  A run of equal bins is
handled as one entry, so the plan is small; each piece finds its place in the
plan by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut_lineage
from .token_counts import byte_alphabet

#: Fixed value of the public lower-case BPE: its pre-tokenizer pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Cached chunks and words per worker, and characters of the longest that is kept (bounds on memory, not on results).
CACHE_CHUNKS, CACHE_WORDS, CACHE_LENGTH = 600_000, 200_000, 64


class ChunkEncoder:
    """Ids of a text as little-endian unsigned 32-bit values, through a cache of chunks.

    No pre-token of this tokenizer holds white space, so the ids of a text are
    those of its white-space separated chunks in order.  A chunk that is not
    cached goes through the library's normalizer and model, word by word.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERN)
        self.alphabet = byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower() if chunk.isascii() else self.tokenizer.normalizer.normalize_str(chunk)
        cached = self.words
        out = []
        for word in (low,) if low.isalpha() and low.isascii() else self.pattern.findall(low):
            known = cached.get(word)
            if known is None:
                if len(cached) > CACHE_WORDS:
                    cached.clear()
                tokens = self.tokenizer.model.tokenize("".join([self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]))
                known = b"".join([t.id.to_bytes(4, "little") for t in tokens])
                if len(word) <= CACHE_LENGTH:
                    cached[word] = known
            out.append(known)
        return b"".join(out)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or CONTROL_SPACE.search(text) or not text.isascii() and MARK.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = self.chunks
        words = text.split()
        try:
            return b"".join(map(chunks.__getitem__, words))
        except KeyError:
            if len(chunks) > CACHE_CHUNKS:
                chunks.clear()
            out = []
            for w in words:
                known = chunks.get(w)
                if known is None:
                    known = self._chunk(w)
                    if len(w) <= CACHE_LENGTH:
                        chunks[w] = known
                out.append(known)
            return b"".join(out)


#: What Python splits on but the tokenizer does not, and marks that may combine with what stands before.
CONTROL_SPACE = regex.compile(r"[\x1c-\x1f]")
MARK = regex.compile(r"\p{M}")


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where the pieces of each length go.

    Returns runs ``(length, first rank, count, first sequence, offset)`` - the
    pieces of that length with ranks ``first rank ..`` go to ``count``
    successive sequences at that offset - and the number of sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    bins = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, count)
    order: list[int] = []  # gaps that have bins

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used.get(length, 0), count, first, offset))
        used[length] = used.get(length, 0) + count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        top = large[-1]
        k = bisect_left(large, capacity - top + 1) - 1
        count = left[top]
        if k < 0:
            place(top, count, bins, 0)
            leave(capacity - top, bins, count)
            bins += count
            left[top] = 0
        elif large[k] == top:
            both = count // 2
            if both:
                place(top, both, bins, 0)
                place(top, both, bins, top)
                leave(capacity - 2 * top, bins, both)
                bins += both
            left[top] = count - 2 * both
            if left[top]:
                k = len(large) - 2
                mate = large[k] if k >= 0 else 0
                place(top, 1, bins, 0)
                if mate:
                    place(mate, 1, bins, top)
                    left[mate] -= 1
                leave(capacity - top - mate, bins, 1)
                bins += 1
                left[top] = 0
                if mate and not left[mate]:
                    large.pop(k)
        else:
            mate = large[k]
            both = min(count, left[mate])
            place(top, both, bins, 0)
            place(mate, both, bins, top)
            leave(capacity - top - mate, bins, both)
            bins += both
            left[top] -= both
            left[mate] -= both
            if not left[mate]:
                large.pop(k)
        if not left[top]:
            large.remove(top)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            k = bisect_left(order, n)
            if k == len(order):
                gap, first, there = capacity, bins, -(-count // (capacity // n))
                bins += there
            else:
                gap = order[k]
                first, there = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
            each = gap // n
            full = min(there, count // each)
            for j in range(each if full else 0):
                place(n, full, first, capacity - gap + j * n)
            leave(gap - each * n, first, full)
            count -= full * each
            first, there = first + full, there - full
            if count and there:  # the last bin gets what is left
                for j in range(count):
                    place(n, 1, first, capacity - gap + j * n)
                leave(gap - count * n, first, 1)
                first, there, count = first + 1, there - 1, 0
            leave(gap, first, there)
    return runs, bins


def pieces_of(documents: DataFrame, tokenizer_path: str, capacity: int, separator: int, text: str, key: str) -> DataFrame:
    """Token pieces: ``key, piece, start, length, ids_crc32, task, nth`` (nth: rank among the task's pieces of its length)."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        tail = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = encode.ids(t) + tail
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i)
                    piece.append(k // (4 * capacity))
                    start.append(k // 4)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(seen.get(n, 0))
                    seen[n] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int32()), pa.array(nth, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return documents.select(documents[key], documents[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, separator: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack every document's ids (and ``separator``) into sequences of ``capacity`` tokens.

    One row per piece: ``key, piece, start, length, ids_crc32, sequence_id,
    offset``.  Only documents longer than the capacity are cut.  A null or
    empty text is the separator alone; null keys and repeated rows are packed
    like any other; an empty table gives no rows; other columns are not read.
    """
    kind = documents.schema[key].dataType.simpleString()
    pieces = cut_lineage(pieces_of(documents, tokenizer_path, capacity, separator, text, key))
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan(histogram, capacity)
    runs.sort()
    where = documents.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))  # grows with the capacity, not with the rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        width = int(table[:, 1].max(initial=0)) + 1 if len(table) else 1
        wide = max(width, 1 << 40)
        index = table[:, 0] * wide + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            k = np.searchsorted(index, length * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(table[k, 3] + rank - table[k, 1], pa.int64()), pa.array(table[k, 4], pa.int64())], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
