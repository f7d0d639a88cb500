"""Benchmark passages with one and two changed words, by size of the item."""

import random

from logloom.llm.decontamination import SIMILARITY, WIDTH, Benchmark, plain


def similarity(a, b):
    a, b = ([tuple(t[i : i + WIDTH]) for i in range(len(t) - WIDTH + 1)] for t in (a, b))
    shared = sum(min(a.count(g), b.count(g)) for g in set(a))
    return shared / (len(a) + len(b) - shared)


def test_changed_words():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6))) for _ in range(400)]
    items = [[rnd.choice(words) for _ in range(n)] for n in range(16, 56) for _ in range(5)]
    bench = Benchmark(list(range(len(items))), [" ".join(t) for t in items])
    asked = found = 0
    for changes in (0, 1, 2):
        texts = []
        for item in items:
            edited = list(item)
            for at in rnd.sample(range(len(item)), changes):
                edited[at] = rnd.choice(words)
            texts.append((edited, [rnd.choice(words) for _ in range(40)]))
        hits = {(t, i) for t, i, *_ in bench.search([plain(" ".join(pad[:20] + edited + pad[20:])) for edited, pad in texts])}
        within = {k for k, (edited, _) in enumerate(texts) if similarity(edited, items[k]) >= SIMILARITY}
        assert changes == 2 or len(within) == len(items)
        asked, found = asked + len(within), found + sum((k, k) in hits for k in within)
        assert all(t == i for t, i in hits)
    assert found >= 0.98 * asked and asked >= 0.95 * 3 * len(items)
    assert not bench.search([plain(" ".join(rnd.choice(words) for _ in range(300))) for _ in range(50)])
