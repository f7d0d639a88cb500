"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  The vector of an n-gram binds
(multiplies) its letters' vectors, each permuted (rolled) by its place; a text
bundles (adds) the vectors of its n-grams, and so does the prototype of a
language over all its training texts.  A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Dimensions, letters in an n-gram, and symbols: 0 is the gap between words,
#: 1 to 26 are a to z, other letters share the rest by their code point.
DIMENSIONS, GRAM, SYMBOLS, SEED = 1024, 3, 64, 20240229


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane; letters are lower-cased first."""
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


def grams(text: str | None) -> np.ndarray:
    """Codes of the n-grams of a text: words are runs of letters, with one gap before, between and after them."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_table()[np.minimum(points, 0xFFFF)]
    if points.max() > 0xFFFF:
        for i in np.flatnonzero(points > 0xFFFF):
            symbols[i] = 27 + int(points[i]) % (SYMBOLS - 27) if chr(points[i]).isalpha() else 0
    s = np.zeros(len(symbols) + 2, np.int32)
    s[1:-1] = symbols
    s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))]  # one gap at a time
    if len(s) < GRAM:
        return np.zeros(0, np.int64)
    n, code = len(s) - GRAM + 1, 0
    for k in range(GRAM):
        code = code * SYMBOLS + s[k : k + n]
    return code


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    letters, out = letter_vectors(), None
    for k in range(GRAM):
        place = GRAM - 1 - k
        part = np.roll(letters, place, axis=1)[codes // SYMBOLS**place % SYMBOLS]
        out = part if out is None else out * part
    return out


class Vectors:
    """Vectors of the n-grams seen so far, as float32 rows."""

    def __init__(self, limit: int = 40_000):
        self.limit, self.where, self.rows, self.n = limit, np.full(SYMBOLS**GRAM, -1, np.int32), np.zeros((0, DIMENSIONS), np.float32), 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.where[codes] < 0]
        if len(new):
            if self.n + len(new) > self.limit:
                if len(codes) > self.limit:
                    return gram_vectors(codes).astype(np.float32)
                self.where[:], self.n, new = -1, 0, codes
            if self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[: self.n], np.zeros((max(4096, len(new)), DIMENSIONS), np.float32)])
            self.rows[self.n : self.n + len(new)] = gram_vectors(new)
            self.where[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        return self.rows[self.where[codes]]


def held_out(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Prototypes of all languages of ``labelled``: every row counts, none is sampled.

    Each text is bundled at unit length (its n-gram counts over their Euclidean
    norm, in steps of 1/65536), so that a long text of one repeated string
    weighs no more than any other.

    What reaches the driver is one number for each language and n-gram, at most
    ``64 ** 3`` for a language however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = grams(t)
                if name not in totals:
                    totals[name] = np.zeros(SYMBOLS**GRAM, np.int64)
                own, n = np.unique(codes, return_counts=True)
                totals[name][own] += np.rint(n * (65536 / np.linalg.norm(n))).astype(np.int64) if len(n) else 0
        for name, total in totals.items():
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["lang", "gram", "n"])

    rows = labelled.select(labelled[text].cast("string"), labelled[lang].cast("string")).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), object)
    codes, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    prototypes = np.zeros((len(langs), DIMENSIONS))
    for i, name in enumerate(langs):
        own = np.flatnonzero(names == name)
        for k in range(0, len(own), 8192):
            part = own[k : k + 8192]
            prototypes[i] += n[part].astype(np.float64) @ gram_vectors(codes[part]).astype(np.float64)
        prototypes[i] /= np.linalg.norm(prototypes[i]) or 1
    return langs, prototypes.astype(np.float32)


def predict(documents: DataFrame, langs: list[str], prototypes: np.ndarray, extra: list[Column], text: str = "text", schema: str = "") -> DataFrame:
    """``extra`` columns, then ``lang_pred`` and ``score`` (the cosine, at least 0)."""
    width = len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            texts = batch.column(width).to_pylist()
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            for s, e in slices([max(4096, len(t or "")) for t in texts], 1 << 20) if langs else ():
                codes = [grams(t) for t in texts[s:e]]
                flat = np.concatenate(codes)
                if not len(flat):
                    continue
                flag = np.zeros(SYMBOLS**GRAM, bool)
                flag[flat] = True
                cols = np.flatnonzero(flag)
                place = np.zeros(SYMBOLS**GRAM, np.int32)
                place[cols] = np.arange(len(cols))
                doc = np.repeat(np.arange(e - s), [len(c) for c in codes])
                counts = np.bincount(doc * len(cols) + place[flat], minlength=(e - s) * len(cols)).reshape(e - s, len(cols)).astype(np.float32)
                bundles = counts @ vectors.of(cols)
                norms = np.linalg.norm(bundles, axis=1)
                cosines = bundles @ prototypes.T / np.where(norms > 0, norms, 1)[:, None]
                top = cosines.argmax(1)
                some = np.array([len(c) > 0 for c in codes])
                best[s:e] = np.where(some, top, -1)
                score[s:e] = np.where(some, np.clip(cosines[np.arange(e - s), top], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(["und" if b < 0 else langs[b] for b in best], pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:width], "lang_pred", "score"])

    return documents.select(*extra, documents[text].cast("string").alias("__text")).mapInArrow(run, schema)


def identify(documents: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """Predict the language of every whole text: ``key, held_out, lang_pred, score``.

    Prototypes come from the rows with a language whose ``crc32(key) mod 5`` is
    not 0; the language of a row is never used to predict it.  A text that is
    null or has no letter is ``und`` with score 0, and so is every text if no
    row has a language.  A null key is neither held out nor learned from;
    repeated rows count as often as they stand there; an empty table gives no
    rows; other columns are not read.
    """
    langs, prototypes = train(documents.where(~held_out(key)), text, lang)
    kind = documents.schema[key].dataType.simpleString()
    flag = F.coalesce(held_out(key), F.lit(False)).alias("held_out")
    return predict(documents, langs, prototypes, [documents[key], flag], text, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, least: float = 0.05, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows whose text has a language: not ``und``, and a cosine of ``least`` or more; all columns stay."""
    langs, prototypes = train(documents.where(~held_out(key)), text, lang)
    names = documents.columns
    extra = [documents[c].alias(f"c{i}") for i, c in enumerate(names)]
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(documents.schema)) + ", lang_pred string, score double"
    found = predict(documents, langs, prototypes, extra, text, schema)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
