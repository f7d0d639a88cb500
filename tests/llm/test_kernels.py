"""Kernels against brute force and the libraries themselves."""

import collections
import random

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm.decontamination import Benchmark, plain
from logloom.llm.html_extraction import extract, matches, parse, wrapper_of
from logloom.llm.packing import encoder, plan
from logloom.llm.simhash import block_masks, forest, simhash
from logloom.llm.suffix_dedup import repeated_places, suffix_array
from logloom.llm.token_counts import counter
from logloom.llm.words import normal, shingle_hashes

ODD = ["", "a  b", " a", "a\n\nb ", "it's we'll 'l 's", "x<|endoftext|> y", "  \n ", "日本語 text x", "éa", "ΑΣ ΣΑΣ", "\x1ca b", "a\tb", "½ ²x 12345", "foo'S 'LL", "😀 😀", "ä b", "İI", "\r\n x"]
TEXT = st.text(alphabet=st.sampled_from("ab c\n'sT.,é1\t<|>endoftx"), max_size=40)


@pytest.fixture(scope="module")
def byte_bpe():
    path = P.path("byte_bpe_50k.json")
    return counter(path), Tokenizer.from_file(path)


@pytest.mark.parametrize("text", ODD)
def test_token_counts_at_every_prefix(byte_bpe, text):
    c, t = byte_bpe
    assert c.prefixes(text) == [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert c.count(text) == c.prefixes(text)[-1]


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_token_counts_match_library(text):
    path = P.path("byte_bpe_50k.json")
    assert counter(path).count(text) == len(counter(path).tokenizer.encode(text, add_special_tokens=False).ids)


def test_truncation(byte_bpe):
    c, _ = byte_bpe
    text = "The quick brown fox jumps over it."
    n = c.truncate(text, 3)
    assert c.count(text[:n]) <= 3 < c.count(text[: n + 1])


@pytest.mark.parametrize("text", ODD)
def test_chunk_ids(text):
    e = encoder(P.path("word_bpe_49k.json"))
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=25))
def test_packing_plan(histogram):
    runs, bins = plan(histogram, 50)
    ranks, fill = collections.defaultdict(list), collections.defaultdict(list)
    for n, rank, count, first, offset in runs:
        for i in range(count):
            ranks[n].append(rank + i)
            fill[first + i].append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert len(fill) == bins
    for items in fill.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 50
    assert bins <= 1.05 * first_fit(histogram, 50) + 1


def first_fit(histogram, capacity):
    """Bins of first fit, longest first."""
    gaps = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            for i, gap in enumerate(gaps):
                if gap >= n:
                    gaps[i] -= n
                    break
            else:
                gaps.append(capacity - n)
    return len(gaps)


def test_shingle_hashes_and_fingerprints():
    texts = [normal(t) for t in ["", "One", "one Two", "a b c d e", "x " * 50, "é ü ö " * 9, None]]
    hashes, first, words = shingle_hashes(texts, 3)
    want = []
    for t in texts:
        w = t.split()
        want.append([xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else [])
    assert [hashes[first[i] : first[i + 1]].tolist() for i in range(len(texts))] == want
    prints = simhash(texts, 3)
    for p, hs in zip(prints.tolist(), want, strict=True):
        assert p == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_blocks_leave_no_pair_out():
    random.seed(5)
    masks = [m % (1 << 64) for m in block_masks(3)]
    for _ in range(2000):
        flips = sum(1 << b for b in random.sample(range(64), random.randint(0, 3)))
        assert any(flips & m == 0 for m in masks)


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 5, dtype=np.uint64)
    fp = np.sort(np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, 40).astype(np.uint64)) for b in base])))
    a, b = forest(np.zeros(len(fp), np.int64), fp, 3)
    assert len(a) < len(fp)
    assert (np.bitwise_count(a ^ b) <= 64).all()
    parent = {int(x): int(x) for x in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[find(x)] = find(y)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert find(int(fp[i])) == find(int(fp[j]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=120))
def test_suffix_array(symbols):
    text = np.array([*symbols, 9])
    rank = suffix_array(text)
    assert np.argsort(rank).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_repeated_places():
    random.seed(2)
    blocks = [(random.randrange(3), bytes(random.choice(b"ab") for _ in range(63)), bytes(random.choice(b"ab") for _ in range(63))) for _ in range(12)]
    blocks += [(c, bytes(40) + l[40:], r[:30] + bytes(33)) for c, l, r in blocks[:6]]
    bits = repeated_places(np.array([b[0] for b in blocks]), [b[1] for b in blocks], [b[2] for b in blocks])
    seen = collections.Counter((c, i, l[i:], r[:i]) for c, l, r in blocks for i in range(64))
    assert bits == [sum(1 << i for i in range(64) if seen[(c, i, l[i:], r[:i])] > 1) for c, l, r in blocks]


def test_benchmark_windows():
    random.seed(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(random.choice(vocab) for _ in range(n)) for n in (4, 20, 30, 41)]
    noise = lambda n: " ".join(random.choice(vocab) for _ in range(n))
    changed = items[3].split()
    changed[0] = changed[-1] = "other"
    docs = [noise(50) + " " + items[1].upper() + "! " + noise(9), noise(80), noise(3) + " " + " ".join(changed), items[2], "", None, " ".join(items[2].split()[:-1])]
    found = Benchmark([0, 1, 2, 3], items).search([plain(d) for d in docs])
    hits = {(d, i) for d, i, *_ in found if i}
    shingles = lambda w: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    want = set()
    for d, text in enumerate(docs):
        w = plain(text).decode().split()
        for i in (1, 2, 3):
            own = items[i].split()
            for s in range(max(1, len(w) - len(own) + 1)):
                x, y = shingles(w[s : s + len(own)]), shingles(own)
                both = (x & y).total()
                if w and both >= 0.8 * (x.total() + y.total() - both):
                    want.add((d, i))
    assert hits == want and {(0, 1), (2, 3), (3, 2), (6, 2)} <= hits


def test_extraction():
    page = """<html><head><title>x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><a href=1>one</a></div>
    <main><div class="post-content"><h2>Head &amp; line</h2><p>First <b>para</b> of
 text&nbsp;here<p>Second one<br>goes on.<div class="share">Share</div><form>Sub</form></div><section id="comments"><p>Great post indeed, I like this very much</section></main><footer>foot</footer></body></html>"""
    assert extract(page, None) == "Head & line\n\nFirst para of text here\n\nSecond one goes on."
    assert extract(None, None) == extract("", None) == ""
    assert extract("plain &lt;p&gt; text", None) == "plain <p> text"
    assert extract("<p>open <a href='x>y'>q</a><!-- c", None) == "open q"
    assert extract("<div>" * 3000 + "deep", None) == "deep"


def test_wrappers_fold_repeats():
    w = wrapper_of(parse("<ul><li>a<li>b<li>c</ul><p>x<p>y"))
    assert [c[0] for c in w[4]] == ["ul", "p"] and w[4][1][3] and len(w[4][0][4]) == 1
    assert matches(list("abcd"), list("xbyd")) == [(1, 1), (3, 3)]
