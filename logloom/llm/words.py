"""Words, shingles and XXH64 over whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import utf8

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _merge(acc, value):
    return (acc ^ _round(np.uint64(0), value)) * P1 + P4


def xxh64_spans(buf: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[s:e]`` for each span, as uint64; spans of a length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    data = np.frombuffer(buf + bytes(8), np.uint8)
    at8 = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    at4 = np.ndarray((len(data) - 3,), "<u4", data.data, 0, (1,))
    lengths = ends - starts
    order = np.argsort(lengths.astype(np.uint16) if lengths.max() < 65536 else lengths, kind="stable")
    counts = np.bincount(lengths)
    seed64 = np.uint64(seed)
    at = 0
    with np.errstate(over="ignore"):
        for n in np.flatnonzero(counts):
            rows = order[at : at + counts[n]]
            at += counts[n]
            pos, left = starts[rows], int(n)
            if left >= 32:
                acc = [np.full(len(rows), seed64 + P1 + P2), np.full(len(rows), seed64 + P2), np.full(len(rows), seed64), np.full(len(rows), seed64 - P1)]
                while left >= 32:
                    for k in range(4):
                        acc[k] = _round(acc[k], at8[pos + 8 * k])
                    pos, left = pos + 32, left - 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for k in range(4):
                    h = _merge(h, acc[k])
            else:
                h = np.full(len(rows), seed64 + P5)
            h = h + np.uint64(n)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), at8[pos]), 27) * P1 + P4
                pos, left = pos + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (at4[pos].astype(np.uint64) * P1), 23) * P2 + P3
                pos, left = pos + 4, left - 4
            for k in range(left):
                h = _rotl(h ^ (data[pos + k].astype(np.uint64) * P5), 11) * P1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def normal(text: str | None) -> bytes:
    """A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+`` joined by single spaces."""
    return b" ".join(utf8(text).translate(LOWER).split())


def shingle_spans(texts: list[bytes], width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles of normalised texts laid end to end.

    Returns the buffer, the first byte and end of each shingle, the index of
    the first shingle of each text (one more at the end) and the words of each
    text.  A text of fewer words has its whole sequence as one shingle, one
    without words has none.
    """
    buf = b" ".join(texts) + b" "
    space = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size + 1) - 1  # the separator after each text
    word_ends = space
    word_starts = np.concatenate([[0], space[:-1] + 1]) if len(space) else space
    full = word_ends > word_starts  # an empty text leaves an empty word
    word_starts, word_ends = word_starts[full], word_ends[full]
    upto = np.searchsorted(word_ends, stop, "right")
    words = np.diff(upto, prepend=0)
    shingles = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(shingles)])
    doc = np.repeat(np.arange(len(texts)), shingles)
    word = np.arange(first[-1]) - first[doc] + (upto - words)[doc]
    last = word + np.minimum(width, words[doc]) - 1
    return buf, word_starts[word], word_ends[last], first, words


def shingle_hashes(texts: list[bytes], width: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of every shingle, the first shingle of each text, the words of each text."""
    buf, starts, ends, first, words = shingle_spans(texts, width)
    return xxh64_spans(buf, starts, ends, seed), first, words
