"""Benchmark decontamination by SimHash over item-sized windows.

Every document is read as words; a window of as many words as a benchmark item
has is a candidate for that item if their SimHash fingerprints differ in at
most ``RADIUS`` bits.  The fingerprints of the items of a size are indexed by
``BLOCKS`` blocks of bits: two fingerprints within the radius have a block in
which they differ in at most ``RADIUS // BLOCKS`` bits, so looking each block
up under all values that near finds every one of them.  Candidates are
verified by their exact weighted-shingle similarity, the sum of the lesser
multiplicities over that of the greater.

A window that is similar enough shares most of its shingles with the item, so
windows are only fingerprinted where enough shingles of the benchmark occur;
that leaves no similar window out.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, utf8
from .words import shingle_spans, xxh64_spans

#: Words in a shingle, least similarity, bits that fingerprints may differ in, blocks of the index.
#: One changed word costs ``WIDTH`` shingles on either side: (n - 5) / (n + 1) of n words remain, and (n - 8) / (n + 4) after two.
#: So items from 11 words on are found with one word changed, from 20 words on with two; five words and 0.8 ask for 49 and 94.
#: At this similarity 17 of 64 bits differ on average and 3.6 is the deviation; the radius is three of these away.
WIDTH, SIMILARITY, RADIUS, BLOCKS = 3, 0.5, 28, 8
#: Bytes of benchmark text that are sent to the executors at once; a larger benchmark goes in blocks.
BENCHMARK_BYTES = 16 << 20

PUNCTUATION = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def plain(text: str | None) -> bytes:
    """Lower case, words without ASCII punctuation, single spaces."""
    return b" ".join(utf8(text.lower()).translate(PUNCTUATION).split()) if text else b""


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = (h ^ words[k : k + n]) * MIX[0]
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(30))) * MIX[1]
        h = (h ^ (h >> np.uint64(27))) * MIX[2]
        return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each text (one more at the end)."""
    buf, starts, ends, first, _ = shingle_spans(texts, 1)
    return xxh64_spans(buf, starts, ends), first


def window_fingerprints(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of ``hashes[s : s + size]`` for each start."""
    low, high = int(starts.min()), int(starts.max()) + size
    bits = np.unpackbits(hashes[low:high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((high - low + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[starts - low + size] - sums[starts - low]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


#: Masks of a block's value that leave it in reach.
NEAR = np.array([m for m in range(1 << 64 // BLOCKS) if m.bit_count() <= RADIUS // BLOCKS], np.int64)


@dataclass
class SizeIndex:
    """Items of one number of words: fingerprints, and in each block the items in the order of its value."""

    items: list[int] = field(default_factory=list)
    prints: list[int] = field(default_factory=list)

    def build(self) -> None:
        bits = 64 // BLOCKS
        self.array = np.array(self.prints, np.uint64)
        self.blocks = []
        for b in range(BLOCKS):
            values = (self.array >> np.uint64(bits * b)).astype(np.int64) & ((1 << bits) - 1)
            self.blocks.append((np.argsort(values, kind="stable"), np.searchsorted(np.sort(values), np.arange((1 << bits) + 1))))

    def candidates(self, fp: int) -> list[int]:
        """All fingerprints within the radius: those have a block in which ``RADIUS // BLOCKS`` bits differ at most."""
        bits, found = 64 // BLOCKS, []
        for b, (order, start) in enumerate(self.blocks):
            values = NEAR ^ (fp >> (bits * b) & ((1 << bits) - 1))
            found += [order[start[v] : start[v + 1]] for v in values[start[values] < start[values + 1]].tolist()]
        if not found:
            return []
        near = np.unique(np.concatenate(found))
        return near[np.bitwise_count(self.array[near] ^ np.uint64(fp)) <= RADIUS].tolist()


class Benchmark:
    """Everything an executor needs of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str | None]):
        norm = [plain(t) for t in texts]
        some = [i for i, t in enumerate(norm) if t]
        self.ids = [ids[i] for i in some]
        words, first = word_hashes([norm[i] for i in some]) if some else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.counts: list[Counter] = []
        self.sizes: dict[int, SizeIndex] = defaultdict(SizeIndex)
        self.grams: dict[int, set[int]] = defaultdict(set)  # width -> shingle hashes
        sized: dict[int, set[tuple[int, int]]] = defaultdict(set)  # width -> shingle hash and words of an item that has it
        for k in range(len(some)):
            own = words[first[k] : first[k + 1]]
            h = chain(own, min(WIDTH, len(own)))
            self.counts.append(Counter(h.tolist()))
            self.grams[min(WIDTH, len(own))].update(h.tolist())
            sized[min(WIDTH, len(own))].update((g, len(own)) for g in h.tolist())
            index = self.sizes[len(own)]
            index.items.append(k)
            index.prints.append(int(window_fingerprints(h, np.zeros(1, np.int64), len(h))[0]))
        self.sorted = {w: np.array(sorted(g), np.uint64) for w, g in self.grams.items()}
        self.bloom = {}
        for w, g in self.sorted.items():
            bits = np.zeros(1 << 22, bool)
            bits[(g & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.bloom[w] = bits
        for index in self.sizes.values():
            index.build()
        # Shingles of items of a size that any window needs at least: one of fewer shingles than its item needs as many of them.
        self.order = sorted(self.sizes)
        self.least = np.array([int(np.ceil(SIMILARITY * (n - min(WIDTH, n) + 1) - 1e-9)) for n in self.order])
        place = {n: k for k, n in enumerate(self.order)}
        self.owners = {}
        for w, pairs in sized.items():
            both = sorted(pairs)
            starts = np.searchsorted(np.array([g for g, _ in both], np.uint64), self.sorted[w])
            self.owners[w] = (np.append(starts, len(both)), np.array([place[n] for _, n in both], np.int64))

    def hits(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where shingles of the benchmark stand, and which."""
        maybe = np.flatnonzero(self.bloom[width][(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        known = self.sorted[width]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        good = known[at] == hashes[maybe]
        return maybe[good], at[good]

    def similarity(self, counts: Counter, item: int) -> float:
        other = self.counts[item]
        shared = sum(min(n, other[h]) for h, n in counts.items() if h in other)
        return shared / (counts.total() + other.total() - shared)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, float]]:
        """``(text, item, first word, words, windows, similarity)``: the best window of each item in each text."""
        words, first = word_hashes(texts)
        best: dict[tuple[int, int], list] = {}
        for width in self.grams:
            hashes = chain(words, width)
            hit, gram = self.hits(hashes, width)
            if not len(hit):
                continue
            doc = np.searchsorted(first, hit, "right") - 1
            inside = hit + width <= first[doc + 1]  # not across two texts
            hit, gram, doc = hit[inside], gram[inside], doc[inside]
            starts, places = self.owners[width]
            for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]):
                if hi - lo < self.least.min():
                    continue
                d = doc[lo]
                n, base = int(first[d + 1] - first[d]), int(first[d])
                many = starts[gram[lo:hi] + 1] - starts[gram[lo:hi]]
                where = np.repeat(hit[lo:hi] - base, many)
                ends = np.cumsum(many)
                sizes = places[np.arange(ends[-1]) - np.repeat(ends - many - starts[gram[lo:hi]], many)]
                for place in np.flatnonzero(np.bincount(sizes, minlength=len(self.order)) >= self.least).tolist():
                    size = self.order[place]
                    index = self.sizes[size]
                    if min(size, WIDTH) != width:
                        continue
                    flags = np.zeros(n - width + 2, np.int32)
                    flags[where[sizes == place] + 1] = 1
                    upto = np.cumsum(flags)
                    m = min(size, n) - width + 1  # shingles of a window; a shorter text is one window
                    need = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (m + size - width + 1) - 1e-9))
                    if m < need:
                        continue
                    begins = np.flatnonzero(upto[m:] - upto[:-m] >= need)
                    if not len(begins):
                        continue
                    for run in np.split(begins, np.flatnonzero(np.diff(begins) > 4 * m) + 1):
                        for part in np.array_split(run, len(run) // 4096 + 1):
                            prints = window_fingerprints(hashes[base : base + n - width + 1], part, m)
                            for s, fp in zip(part.tolist(), prints.tolist(), strict=True):
                                near = index.candidates(fp)
                                if not near:
                                    continue
                                counts = Counter(hashes[base + s : base + s + m].tolist())
                                for k in near:
                                    item = index.items[k]
                                    value = self.similarity(counts, item)
                                    if value >= SIMILARITY:
                                        row = best.setdefault((int(d), item), [s, m + width - 1, 0, 0.0])
                                        row[2] += 1
                                        if value > row[3]:
                                            row[0], row[1], row[3] = s, m + width - 1, value
        return [(d, i, *row) for (d, i), row in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, limit: int = BENCHMARK_BYTES) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of about ``limit`` bytes of text."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(utf8(row[1])) + 64
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Benchmark items that stand in documents, one row for each row of ``documents`` and item.

    ``key, item, start_word, n_words, n_windows, similarity``: the most similar
    window (the first of equals), and how many windows reach the least
    similarity.  A document that is shorter than an item is one window.  An
    item of fewer than three words is one shingle and so matches windows of
    equal words only.  Null or empty texts and items match nothing; null keys
    and repeated rows are reported row by row; empty tables give no rows; other
    columns are not read.
    """
    kind, item_kind = documents.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {item_kind}, start_word long, n_words long, n_windows long, similarity double"
    rows = documents.select(documents[key], documents[text].cast("string"))
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = None
    for ids, texts in benchmark_blocks(benchmark, item, item_text):
        part = rows.mapInArrow(_finder(_sent(documents.sparkSession, ids, texts), key, item, item_type), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).selectExpr(f"`{key}`", f"cast(null as {item_kind}) `{item}`", "0L start_word", "0L n_words", "0L n_windows", "0D similarity")


_built: dict[str, Benchmark] = {}


def _sent(spark: SparkSession, ids: list, texts: list[str | None]) -> Broadcast:
    """A broadcast block under a name of its own; workers outlive tasks, and addresses of values come again."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, ids, texts))


def _index(shared: Broadcast) -> Benchmark:
    """The index of a broadcast block, built once in each worker."""
    name, ids, texts = shared.value
    if name not in _built:
        _built.clear()
        _built[name] = Benchmark(ids, texts)
    return _built[name]


def _finder(shared, key: str, item: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in batches:
            texts = [plain(t) for t in batch.column(1).to_pylist()]
            rows = [(s + r[0], *r[1:]) for s, e in slices([len(t) + 1 for t in texts]) for r in index.search(texts[s:e])]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.ids[i] for i in cols[1]], item_type), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.float64())],
                names=[key, item, "start_word", "n_words", "n_windows", "similarity"],
            )

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``documents`` in which no benchmark item stands; all columns stay.

    Null and empty texts are clean; see ``contaminated`` for the rest.
    """
    place = documents.columns.index(text)
    schema = documents.schema
    out = documents
    for ids, texts in benchmark_blocks(benchmark, item, item_text):
        shared = _sent(documents.sparkSession, ids, texts)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                norm = [plain(t) for t in batch.column(place).to_pylist()]
                bad = {s + r[0] for s, e in slices([len(t) + 1 for t in norm]) for r in index.search(norm[s:e])}
                yield batch.filter(pa.array([i not in bad for i in range(len(norm))], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
