"""Exact BPE token counts at every prefix, by dynamic programming.

A byte-pair encoding is valid if and only if each pair of neighbouring tokens
is what the merges leave of those two tokens' bytes.  So the encoding of a
prefix ends in the one vocabulary token ``t`` that (a) is a suffix of the
prefix and (b) is compatible with the last token of the encoding of what comes
before.  ``count[e] = count[e - len(t)] + 1`` gives the count at every prefix
end ``e`` in one pass, and the table answers truncation ("how many bytes fit
into N tokens") and budget ("how many tokens are in the first N bytes")
questions with no further encoding.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import utf8

#: Fixed values of the public byte-level BPE: its pre-tokenizer pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Cached words and pairs of tokens per worker; beyond it a cache starts anew (a bound on memory, not on results).
CACHE_WORDS, CACHE_PAIRS = 400_000, 4_000_000
#: Bytes from which a word is not cached and its table of prefixes is an array of its own.
LONG_WORD = 64
#: A run of letters: each of its prefixes is one pre-token too.
LETTERS = regex.compile(r" ?\p{L}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {}, 256
    for b in range(256):
        if b in printable:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class PrefixCounter:
    """Token counts at all prefixes for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ids = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
        self.of_id = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[bytes, tuple[int, int]] = {b"": (0, -1)}  # prefix -> tokens so far, last token
        self.long: tuple[bytes, list[int], list[int]] = (b"", [0], [-1])  # the last long word: tokens and last token by prefix
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {}

    def compatible(self, left: int, right: int) -> bool:
        if left < 0:
            return self._merged(self.of_id[right]) == [right]
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merged(self.of_id[left] + self.of_id[right]) == [left, right]
        return known

    def _merged(self, data: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.alphabet[b] for b in data]))]

    def state(self, word: bytes) -> tuple[int, int]:
        """Tokens and last token of one pre-token; fills the table for all its prefixes."""
        if len(word) >= LONG_WORD:
            counts, lasts = self.table(word)
            return counts[len(word)], lasts[len(word)]
        states = self.states
        known = states.get(word)
        if known is not None:
            return known
        if len(states) > CACHE_WORDS:
            states.clear()
            states[b""] = (0, -1)
        end = len(word) - 1
        while end and word[:end] not in states:
            end -= 1
        if not end and b"" not in states:
            states[b""] = (0, -1)
        ids, longest = self.ids, self.longest
        for e in range(end + 1, len(word) + 1):
            for s in range(max(0, e - longest), e):
                token = ids.get(word[s:e])
                if token is None:
                    continue
                count, last = states[word[:s]]
                if self.compatible(last, token):
                    states[word[:e]] = (count + 1, token)
                    break
            else:
                raise ValueError(f"no encoding of {word!r} in this vocabulary")
        return states[word]

    def table(self, word: bytes) -> tuple[list[int], list[int]]:
        """Tokens and last token of every prefix of one pre-token, in arrays as long as the word."""
        whole, counts, lasts = self.long
        if whole.startswith(word):
            return counts, lasts
        counts, lasts = [0], [-1]
        ids, longest = self.ids, self.longest
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - longest), e):
                token = ids.get(word[s:e])
                if token is not None and self.compatible(lasts[s], token):
                    counts.append(counts[s] + 1)
                    lasts.append(token)
                    break
            else:
                raise ValueError(f"no encoding of {word!r} in this vocabulary")
        self.long = (word, counts, lasts)
        return counts, lasts

    def words(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in order, with whether each is a special token."""
        for k, part in enumerate(self.split_special.split(text) if self.split_special else [text]):
            if k % 2:
                yield part, True
            else:
                for word in self.pattern.findall(part):
                    yield word, False

    def _plain(self, text: str) -> int:
        return sum(self.state(word.encode("utf-8", "surrogatepass"))[0] for word in self.pattern.findall(text))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text.

        Where single spaces and single newlines are the only white space and
        stand between other characters, no pre-token crosses them, so the
        chunks between them are counted through a cache of chunks.
        """
        if not text:
            return 0
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace() or any(s in text for s in self.special) or ODD_SPACE.search(text):
            return sum(1 if special else self.state(word.encode("utf-8", "surrogatepass"))[0] for word, special in self.words(text))
        spaced, bare = self.spaced, self.bare
        if len(spaced) > CACHE_WORDS:
            spaced.clear()
        if len(bare) > CACHE_WORDS:
            bare.clear()
        total = -1
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            n = bare.get(first)
            if n is None:
                n = self._plain(first)
                if len(first) < LONG_WORD:
                    bare[first] = n
            total += n + 1  # the newline
            try:
                total += sum(map(spaced.__getitem__, rest))
            except KeyError:
                for chunk in rest:
                    n = spaced.get(chunk)
                    if n is None:
                        n = self._plain(" " + chunk)
                        if len(chunk) < LONG_WORD:
                            spaced[chunk] = n
                    total += n
        return total

    def prefixes(self, text: str | None) -> list[int]:
        """Token count of ``text[:i]`` for i = 0 .. len(text).

        A pre-token is final once the text goes on past it; a prefix that ends
        inside white space, a contraction or a special string is cut into
        pre-tokens anew from the last place where every longer prefix agrees.
        """
        text = text or ""
        starts, counts, at, total = [0], [0], 0, 0
        inside: dict[int, int] = {}  # counts at prefixes that end inside a long run of letters, two characters in at least
        for word, special in self.words(text):
            if len(word) >= LONG_WORD and not special and LETTERS.fullmatch(word):
                tokens, place = self.table(word.encode("utf-8", "surrogatepass"))[0], 0
                for k, c in enumerate(word[:-1]):
                    place += len(c.encode("utf-8", "surrogatepass"))
                    if k:
                        inside[at + k + 1] = total + tokens[place]
            total += 1 if special else self.state(word.encode("utf-8", "surrogatepass"))[0]
            at += len(word)
            starts.append(at)
            counts.append(total)
        out = []
        for i in range(len(text) + 1):
            if i in inside:
                out.append(inside[i])
                continue
            k = bisect_right(starts, i) - 1
            k = max(0, k - 1)
            floor = i - max(map(len, self.special), default=0)
            while k and (starts[k] > floor or text[starts[k] - 1].isspace() or text[starts[k]].isspace() or text[starts[k]] == "'"):
                k -= 1
            tail = text[starts[k] : i]
            out.append(counts[k] + sum(1 if sp else self.state(w.encode("utf-8", "surrogatepass"))[0] for w, sp in self.words(tail)))
        return out

    def truncate(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        table = self.prefixes(text)
        return max(i for i, n in enumerate(table) if n <= budget)


#: White space other than the space and the newline.
ODD_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f]")


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(documents: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Exact token count of every whole text, one row per input row.

    ``key, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``).  Null and
    empty texts have 0 bytes and 0 tokens; a null key stays null; repeated
    rows and ties are counted row by row; an empty table gives an empty table;
    other columns, whatever their names, are not read.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(utf8(t)) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return documents.select(documents[key], documents[text].cast("string")).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
