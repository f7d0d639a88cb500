"""Wide lists of siblings are aligned like narrow ones."""

import random

from logloom.llm import html_extraction


def table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_wide_lists_by_chance():
    rnd = random.Random(1)
    for n, m in ((1, 5), (7, 7), (40, 3), (60, 90), (130, 100)):
        for keys in (2, 5, 50):
            a, b = ([f"k{rnd.randrange(keys)}" for _ in range(k)] for k in (n, m))
            assert html_extraction._wide_matches(a, b) == table(a, b)


def test_beyond_the_switch():
    rnd = random.Random(2)
    a, b = (["begin" + c, *[rnd.choice("pqrst") for _ in range(600)], "end" + c] for c in "ab")
    assert html_extraction.matches(a, b) == table(a, b)
