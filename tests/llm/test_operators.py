"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names, and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from logloom.llm import decontamination, html_extraction, language, line_dedup, packing, quality, sharding, simhash, suffix_dedup, token_counts
from logloom.llm.components import components
from logloom.llm.words import normal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, fp long, lid long, id long, pos int, key string, t string, n long, score double, lang_pred string, node long, root long"
WORDS = {"en": "the of and to in is that with for from by was are".split(), "de": "und der die das ist nicht ein mit von zu für auf sich".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ung" if lang == "de" else "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [(prose(rng, l, rng.randint(1, 60)), l) for l in ("en", "de") * 40]
    base = "\n".join(prose(rng, "en", 25) for _ in range(6))
    texts += [(base, "en")] * 3 + [(base.replace("the", "a", 1), "en"), (base + "\nextra line of text", "en"), (base * 30, "en")]
    texts += [(None, "en"), ("", "de"), ("  \n ", None), ("12 345 !!", "en"), ("été \U0001f600", None), ("same line\nsame line\n\nsame line", "en"), ("x" * 5000, "en")]
    out = [(i, t, l, "s0" if i % 3 else None, None) for i, (t, l) in enumerate(texts)]
    out += [out[3], out[3], (None, "orphan text without a key", None, None, None), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([r + (1, 2, 3, 4, 5, 6, "k", "t", 7, 0.5, "zz", 8, 9) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert collections.Counter(map(str, got)) == collections.Counter(map(str, want))


def test_token_counts(docs, empty, rows):
    path = P.path("byte_bpe_50k.json")
    c = token_counts.counter(path)
    got = token_counts.token_counts(docs, path, 20).collect()
    same([tuple(r) for r in got], [(k, len((t or "").encode()), len(c.tokenizer.encode(t or "", add_special_tokens=False).ids), len(c.tokenizer.encode(t or "", add_special_tokens=False).ids) > 20) for k, t, *_ in rows])
    assert token_counts.token_counts(empty, path).count() == 0


def test_packing(docs, empty, rows):
    path = P.path("word_bpe_49k.json")
    got = packing.pack(docs, path, capacity=64).collect()
    tok = packing.encoder(path).tokenizer
    want = []
    for k, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(k, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for i in range(0, len(ids), 64)]
    same([tuple(r)[:5] for r in got], want)
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in fill.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack(empty, path).count() == 0


def test_language(docs, empty, rows):
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1
    known = {k: l for k, t, l, *_ in rows if k is not None and k < 80 and len(t.split()) > 10}
    held = [(r["lang_pred"], known[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert held and np.mean([a == b for a, b in held]) >= 0.9
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {k for k, t, *_ in rows if not any(c.isalpha() for c in t or "")} == und
    kept = language.keep_identified(docs, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(not any(c.isalpha() for c in r[1] or "") for r in rows)
    assert language.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def fingerprints(texts, width=3):
    return simhash.simhash([normal(t) for t in texts], width)


def test_near_duplicates(docs, empty, rows):
    fp = fingerprints([r[1] for r in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if int(fp[i] ^ fp[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {g: min((k for k in ks if k is not None), default=None) for g, ks in groups.items()}
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    same(got, [(r[0], f"{int(fp[i]):016x}", least[find(i)]) for i, r in enumerate(rows)])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(docs, width=3).count() == len(groups)


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in rng.integers(0, 1 << 62, 3, dtype=np.uint64)]))
    got = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long"))).collect()}
    label = {int(x): int(x) for x in fp.view(np.int64)}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    for _ in range(50):
        for i, x in enumerate(fp.view(np.int64)):
            label[int(x)] = min(label[int(y)] for y in fp.view(np.int64)[near[i]])
    assert {k: got.get(k, k) for k in label} == label


def test_sharding(docs, empty, rows):
    got = sharding.shard(docs, 4).collect()
    assert len(got) == len(rows)
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows])
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 4 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    where = collections.defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard(empty, 4).count() == 0


def test_shards_are_even(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("p")).select("doc_id", F.concat(F.col("doc_id").cast("string"), "p").alias("text"))
    sizes = [r["s"] for r in sharding.shard(frame).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 16 and max(sizes) <= 1.02 * min(sizes)


def statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, empty, rows):
    got = quality.quality(docs).collect()
    same([tuple(r)[:6] for r in got], [(r[0], *statistics(r[1])) for r in rows])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality(empty).count() == 0


def test_robust_estimate(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 4)) @ np.diag([0.5, 0.4, 0.6, 0.3]) + [1, 2, 3, 4]
    x[:60] += 8
    frame = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    p = quality.outlier_bounds(frame).first()
    assert np.allclose([p[f"m_{i}"] for i in range(4)], x[60:].mean(0), atol=0.1)
    assert np.allclose([p[f"s_{i}_{i}"] for i in range(4)], np.square([0.5, 0.4, 0.6, 0.3]) + np.square(quality.FLOORS), rtol=0.35)
    assert quality.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


def like(a, b, k=line_dedup.SHINGLE):
    a, b = ({x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in (a, b))
    return len(a & b) >= line_dedup.SIMILARITY * len(a | b)


def test_line_dedup(docs, empty, rows):
    distinct = list(dict.fromkeys((r[0], r[1]) for r in rows))
    order = sorted(distinct, key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = [], collections.Counter()
    lines = [(r, i, x) for r in order for i, x in enumerate((r[1] or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    texts = list(dict.fromkeys(x for *_, x in lines))
    label = {x: x for x in texts}
    for _ in range(3):
        for x in texts:
            for y in texts:
                if label[x] != label[y] and like(x, y):
                    old, new = label[y], label[x]
                    label = {k: new if v == old else v for k, v in label.items()}
    for r, _, x in lines:
        gone[r] += label[x] in seen
        seen.append(label[x])
    out = line_dedup.dedup_lines(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    same([(r["doc_id"], r["n_removed"]) for r in got], [(r[0], gone[r[0], r[1]]) for r in rows])
    for r in got:
        assert (r["text"] is None) == (r["n_lines"] == 0 and r["text"] is None)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_substrings(spark, docs, empty, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CORE_BLOCKS", 4)
    rng = random.Random(1)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 401, 450, 900)]
    texts = [r[1] for r in rows] + ["x" * 1000, "ab" * 600, "x" * 399]
    texts += ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 300))) + rng.choice(parts)[rng.choice([0, 0, 1, 30]) :] + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 300))) for _ in range(120)]
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + 400] for b in data for i in range(len(b) - 399))
    want = []
    for b in data:
        change = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                change[i] += 1
                change[i + 400] -= 1
        on = np.cumsum(change)[:-1] > 0
        want.append((len(b), int(np.diff(np.concatenate([[0], on.astype(int)])).clip(0).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~on].tobytes()).hexdigest()))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup_substrings(frame, 400).orderBy("doc_id").collect()
    assert [(r["n_bytes"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got] == want
    assert suffix_dedup.dedup_substrings(empty, 400).count() == 0
    assert suffix_dedup.dedup_substrings(docs, 400).count() == len(rows)


def test_decontamination(spark, docs, empty, rows):
    bench = spark.createDataFrame([(1, " ".join(rows[80][1].split()[3:40])), (2, None), (3, ""), (4, "one two three four five six seven never seen")], "item_id long, text string")
    got = decontamination.contaminated(docs, bench)
    hit = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert {(80, 1), (81, 1), (82, 1)} <= hit and {i for _, i in hit} == {1}
    bad = {k for k, _ in hit}
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r[0] not in bad for r in rows)
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_html(spark):
    page = "<html><body><nav>Menu here</nav><div><p>Article {0} has its own words, number {0}, and more of them.</p><p>Second {0}</p></div><div>Subscribe to our letter today</div></body></html>"
    data = [(i, f"http://H.example.com/{i}", page.format(i)) for i in range(5)] + [(5, None, None), (6, "http://h.example.com:80/x", ""), (None, "bad", "<p>alone"), (1, "http://H.example.com/1", page.format(1))]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, html string, host string, wrapper string")
    got = html_extraction.extract_main_text(frame).collect()
    assert len(got) == len(data)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Article 1 has its own words, number 1, and more of them.\n\nSecond 1"
    assert text[5] == text[6] == "" and text[None] == "alone"
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extraction.extract_main_text(frame.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (5, 9), (9, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (5, 5), (9, 5), (7, 5)}
    assert components(edges.limit(0)).count() == 0
