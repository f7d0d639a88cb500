"""Remove every byte that a long repeated string covers, by sharded suffix arrays.

1. Anchors.  In every string of ``length`` bytes the least hash of its
   ``GRAM``-byte grams (the leftmost of equals) is its anchor.  Equal strings
   have equal anchors at equal places, so a string whose anchor gram occurs
   once in the corpus is not repeated, and only the others go on.
2. Blocks.  Up to ``BLOCK`` successive starts of the same anchor share a core of
   ``length - BLOCK + 1`` bytes; what differs between them are at most
   ``BLOCK - 1`` bytes to either side.  Taking the core as one symbol, a string
   of ``length`` bytes is a string of ``BLOCK`` symbols.
3. Suffix arrays.  Blocks are dealt into shards by core.  Each shard sorts the
   suffixes of its blocks by Larsson-Sadakane refinement, doubling the compared
   prefix and sorting only what is still tied, and finds common prefixes by
   Kasai's rule, for all blocks side by side.  A string repeats in its shard if
   it has ``BLOCK`` symbols in common with a neighbour.
4. Merging.  Cores with very many different blocks are dealt to several shards;
   the strings that these have not settled are merged in order, and each is
   looked up in the merged order by binary search.

Equal blocks are one block with a count before they are sorted, so groups of
copies cost no more than one copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored, utf8

#: Bytes of a gram, starts in a block, blocks in a shard, blocks of a core that stay in one shard, bytes handled at once.
GRAM, BLOCK, SHARD, CORE_BLOCKS, SEGMENT = 64, 64, 6000, 256, 4 << 20
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]))
        return self.up, self.down


POWERS = Powers()


def anchor_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with the same anchor: anchor place, first start, last start, gram hash."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64)
    parts = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        piece = data[at : at + SEGMENT + length - 1]
        up, down = POWERS.get(len(piece) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
            gram = (sums[GRAM:] - sums[:-GRAM]) * down[: len(piece) - GRAM + 1]
            gram ^= gram >> np.uint64(31)
            gram *= np.uint64(0xBF58476D1CE4E5B9)
            gram ^= gram >> np.uint64(29)
        value = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
        width = length - GRAM + 1
        padded = np.full(-(-len(value) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(value)] = value
        grid = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(grid, axis=1).ravel()
        n = len(value) - width + 1
        owner = (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & PLACE).astype(np.int64)
        first = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
        last = np.append(first[1:], n) - 1
        parts.append((owner[first] + at, first + at, last + at, gram[owner[first]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def blocks_of(data: bytes, runs, wanted: set[int], length: int) -> Iterator[tuple[bytes, bytes, bytes, int, int]]:
    """``core digest, left bytes, right bytes, start 0, first place`` of every block of the wanted anchors.

    Start 0 is where the block's first place would be; the places that count run
    from ``first place`` to ``len(right)``.
    """
    for a, lo, hi, gram in zip(*(r.tolist() for r in runs), strict=True):
        if gram not in wanted:
            continue
        for j in range((a - hi) // BLOCK, (a - lo) // BLOCK + 1):
            zero = a - (j + 1) * BLOCK + 1
            first, last = max(lo, zero), min(hi, zero + BLOCK - 1)
            core, end = zero + BLOCK - 1, zero + length
            yield xxhash.xxh3_128_digest(data[core:end]), data[first:core], data[end : end + last - zero], zero, first - zero


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of ``text``.

    Larsson-Sadakane: a group of equal ranks is sorted by the ranks ``h`` places
    on, and ``h`` doubles; suffixes that are alone in their group are done.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    count = np.bincount(rank)
    rank = (np.cumsum(count) - count)[rank].astype(np.int64)  # a group's rank is its first place
    open_ = np.flatnonzero(count[np.searchsorted(np.cumsum(count) - count, rank)] > 1)
    bits = int(n + 1).bit_length()
    mask = np.uint64((1 << bits) - 1)
    h = 1
    while len(open_):
        after = np.zeros(len(open_), np.uint64)
        inside = open_ + h < n
        after[inside] = rank[open_[inside] + h] + 1
        packed = (rank[open_].astype(np.uint64) << np.uint64(2 * bits)) | (after << np.uint64(bits)) | open_.astype(np.uint64)
        packed.sort()
        place = (packed & mask).astype(np.int64)
        pair = packed >> np.uint64(bits)
        new = np.append(True, pair[1:] != pair[:-1])
        group = rank[place]
        head = np.append(True, group[1:] != group[:-1])
        at = np.arange(len(place))
        rank[place] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        alone = new & np.append(new[1:], True)
        open_ = place[~alone]
        h *= 2
    return rank


def common_prefixes(text: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and by place in it the symbols shared with the one before, up to ``depth``.

    Kasai: the prefix a suffix shares with its predecessor is at most one
    shorter than that of the suffix one place to the left.  The rule runs along
    each of the strings at ``starts`` at the same time.
    """
    n = len(text)
    order = np.argsort(rank, kind="stable")
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.append(text, np.full(depth + 1, -1))
    shared, got = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > t)
        i = starts[live] + t
        j = before[i]
        k = np.where(j < 0, 0, np.maximum(got[live] - 1, 0))
        grow = np.flatnonzero(j >= 0)
        while len(grow):
            grow = grow[k[grow] < depth]
            x, y = i[grow] + k[grow], j[grow] + k[grow]
            same = (y < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            grow = grow[same]
            k[grow] += 1
        got[live] = k
        shared[i] = k
    return order, shared[order]


def repeated_places(cores: np.ndarray, lefts: list[bytes], rights: list[bytes]) -> list[int]:
    """For each block of a shard the places whose string occurs elsewhere in the shard, as bits.

    ``cores`` numbers the blocks' cores; bit ``i`` stands for place ``i``.
    """
    m = len(lefts)
    if not m:
        return []
    sizes = np.array([len(a) + len(b) + 2 for a, b in zip(lefts, rights, strict=True)])
    starts = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    left_n = np.array([len(a) for a in lefts])
    body = np.ones(len(text), bool)
    body[starts + left_n] = body[starts + sizes - 1] = False
    text[body] = np.frombuffer(b"".join([x for p in zip(lefts, rights, strict=True) for x in p]), np.uint8)
    text[starts + left_n] = 256 + cores
    text[starts + sizes - 1] = 256 + int(cores.max()) + 1 + np.arange(m)  # ends differ from each other
    rank = suffix_array(text)
    order, shared = common_prefixes(text, rank, starts, sizes, BLOCK)
    hit = np.zeros(len(text), bool)
    long_ = np.flatnonzero(shared >= BLOCK)
    hit[order[long_]] = hit[order[long_ - 1]] = True
    where = np.flatnonzero(hit)
    block = np.searchsorted(starts, where, "right") - 1
    place = BLOCK - 1 - left_n[block] + where - starts[block]
    bits = np.zeros(m, np.uint64)
    np.bitwise_or.at(bits, block, np.uint64(1) << place.astype(np.uint64))
    return bits.tolist()


def _text_id(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def repeated_starts(documents: DataFrame, length: int, text: str) -> DataFrame:
    """``tid, found``: for each text (by digest) the blocks ``(zero, bits)`` whose marked places start a repeated string."""
    rows = documents.where(F.octet_length(documents[text].cast("string")) >= length).select(documents[text].cast("string").alias("t"))
    rows = rows.select(_text_id(F.col("t")).alias("tid"), "t")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, grams, counts, lens = batch.column(0), [], [], []
            for t in batch.column(1).to_pylist():
                g, n = np.unique(anchor_runs(np.frombuffer(utf8(t), np.uint8), length)[3], return_counts=True)
                grams.append(g)
                counts.append(n)
                lens.append(len(g))
            take = pa.array(np.repeat(np.arange(len(lens)), lens), pa.int64())
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([tids.take(take), pa.array(flat.view(np.int64)), pa.array(np.concatenate(counts).astype(np.int32) if counts else [], pa.int32())], names=["tid", "gram", "n"])

    found = stored(rows.mapInArrow(anchors, "tid binary, gram long, n int"))
    often = cut_lineage(found.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"))
    wanted = stored(found.join(often, "gram").groupBy("tid").agg(F.collect_set("gram").alias("grams")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            sent: set[bytes] = set()

            def flush(out=out, batch=batch):
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
                names = ("mid", "tid", "zero", "core", "left", "right", "n")
                made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))
                for c in out:
                    c.clear()
                return made

            for tid, t, grams in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data = utf8(t)
                runs = anchor_runs(np.frombuffer(data, np.uint8), length)
                for core, left, right, zero, _ in blocks_of(data, runs, {g % (1 << 64) for g in grams}, length):
                    mid = xxhash.xxh3_128_digest(core + bytes((len(left), len(right))) + left + right)
                    for c, v in zip(out, (mid, tid, zero), strict=False):
                        c.append(v)
                    full = mid not in sent  # its bytes go along once in a batch
                    sent.add(mid)
                    for c, v in zip(out[3:], (core, left, right) if full else (None, None, None), strict=False):
                        c.append(v)
                    out[6].append(1)
                if len(out[0]) > 50_000:
                    yield flush()
            yield flush()

    made = stored(rows.join(wanted, "tid").select("tid", "t", "grams").mapInArrow(blocks, "mid binary, tid binary, zero long, core binary, left binary, right binary, n int"))
    members = made.groupBy("mid").agg(F.max("core").alias("core"), F.max("left").alias("left"), F.max("right").alias("right"), F.sum("n").alias("n"))
    members = stored(members)
    crowded = cut_lineage(members.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")).where("all > 1").select("core", F.ceil(F.col("m") / CORE_BLOCKS).cast("int").alias("s")))
    dealt = members.join(crowded, "core").withColumn("salt", F.pmod(F.xxhash64("mid"), F.col("s")).cast("int"))
    dealt = dealt.select("core", "salt", "s", "mid", "left", "right", "n").repartition("core", "salt").sortWithinPartitions("core", "salt", "mid")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bits of the blocks of each shard, and the strings of split cores that other shards may have."""
        rest: list[tuple] = []

        def shard(part: list[tuple]) -> pa.RecordBatch:
            number: dict[tuple, int] = {}
            cores = np.array([number.setdefault(r[:2], len(number)) for r in part], np.int64)
            bits = repeated_places(cores, [r[4] for r in part], [r[5] for r in part])
            mids, masks, strings, places = [], [], [], []
            for (core, _, s, mid, left, right, n), mask in zip(part, bits, strict=True):
                low = BLOCK - 1 - len(left)
                if n > 1:
                    mask |= ((1 << (len(right) + 1)) - 1) & ~((1 << low) - 1)
                if mask:
                    mids.append(mid)
                    masks.append(_signed(mask))
                    strings.append(None)
                    places.append(None)
                if s > 1:
                    for i in range(low, len(right) + 1):
                        mids.append(mid)
                        masks.append(_signed(mask))
                        strings.append(xxhash.xxh3_128_digest(core + bytes((i,)) + left[i - low :] + right[:i]))
                        places.append(i)
            return pa.RecordBatch.from_arrays([pa.array(mids, pa.binary()), pa.array(masks, pa.int64()), pa.array(strings, pa.binary()), pa.array(places, pa.int32())], names=["mid", "bits", "string", "place"])

        for batch in batches:
            rest += zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)
            while len(rest) > SHARD + CORE_BLOCKS * 4:
                cut = SHARD
                while cut < len(rest) and rest[cut][:2] == rest[cut - 1][:2]:
                    cut += 1
                if cut == len(rest):
                    break
                yield shard(rest[:cut])
                del rest[:cut]
        if rest:
            yield shard(rest)

    settled = cut_lineage(dealt.mapInArrow(settle, "mid binary, bits long, string binary, place int"))
    open_ = settled.where("string is not null").select("string", "mid", "place").repartition("string").sortWithinPartitions("string")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Look every string up in the merged order of its shards."""
        keys, mids, places = np.zeros(0, "V16"), [], np.zeros(0, np.int64)

        def found(keys, mids, places):
            order = np.array([k.hex() for k in keys.tolist()], "S32")
            many = np.searchsorted(order, order, "right") - np.searchsorted(order, order, "left") > 1
            hit = np.flatnonzero(many)
            return pa.RecordBatch.from_arrays([pa.array([mids[i] for i in hit], pa.binary()), pa.array([_signed(1 << int(places[i])) for i in hit], pa.int64())], names=["mid", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.array(batch.column(0).to_pylist(), "V16")])
            mids = mids + batch.column(1).to_pylist()
            places = np.concatenate([places, batch.column(2).to_numpy(zero_copy_only=False)])
            cut = len(keys)
            while cut and keys[cut - 1] == keys[-1]:  # the last string may go on
                cut -= 1
            if cut:
                yield found(keys[:cut], mids[:cut], places[:cut])
                keys, mids, places = keys[cut:], mids[cut:], places[cut:]
        if len(keys):
            yield found(keys, mids, places)

    merged = open_.mapInArrow(merge, "mid binary, bits long")
    marked = settled.where("string is null").select("mid", "bits").unionByName(merged).groupBy("mid").agg(F.bit_or("bits").alias("bits"))
    return made.select("mid", "tid", "zero").join(cut_lineage(marked), "mid").groupBy("tid").agg(F.collect_set(F.struct("zero", "bits")).alias("found"))


def dedup_substrings(documents: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row without the bytes that lie in a string of ``length`` bytes that also starts elsewhere.

    ``key, n_bytes, spans`` (maximal removed runs as ``(start, end)``), ``kept``
    (the other bytes, concatenated).  Texts are judged as they come in and
    strings never cross texts; overlapping occurrences count.  A null text is
    empty; null keys and repeated rows are rows like any other (equal texts
    repeat each other); an empty table gives no rows; other columns are not read.
    """
    if length < GRAM + BLOCK:
        raise ValueError(f"length must be at least {GRAM + BLOCK} bytes")
    found = cut_lineage(repeated_starts(documents, length, text))
    kind = documents.schema[key].dataType.simpleString()
    body = documents[text].cast("string")
    rows = documents.select(documents[key].alias("__key"), body.alias("t"), _text_id(F.coalesce(body, F.lit(""))).alias("tid"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for t, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = utf8(t)
                sizes.append(len(data))
                if not blocks:
                    spans.append([])
                    kept.append(data)
                    continue
                zero = np.array([b["zero"] for b in blocks], np.int64)
                bits = np.array([b["bits"] for b in blocks], np.int64).view(np.uint64)
                on = np.unpackbits(bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                starts = (zero[:, None] + np.arange(64))[on]
                change = np.zeros(len(data) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + length, -1)
                covered = np.cumsum(change)[:-1] > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())], names=[key, "n_bytes", "spans", "kept"])

    joined = rows.join(found, "tid", "left").select("__key", "t", "found")
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
