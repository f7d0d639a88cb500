"""No like lines are left out, however they differ and however crowded their buckets are."""

import random

from logloom.llm import line_dedup

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def like(a, b, k=line_dedup.SHINGLE):
    a, b = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(a & b) >= line_dedup.SIMILARITY * len(a | b)


def lines_left(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed = 0").orderBy("doc_id").collect()]


def test_beginnings_of_words_differ(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice(LETTERS) for _ in range(n))
    lines = []
    while len(lines) < 400:
        words = [word(rnd.randint(7, 13)) for _ in range(rnd.randint(9, 45))]
        other, best = list(words), None
        for at in rnd.sample(range(len(words)), len(words)):  # as many as the threshold allows
            other[at] = word(1) + other[at][1:]
            if not like(" ".join(words), " ".join(other)):
                break
            best = " ".join(other)
        if best and best != " ".join(words):
            lines += [" ".join(words), best]
    assert lines_left(spark, lines) == list(range(0, len(lines), 2))


def test_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 40, raising=False)
    rnd = random.Random(7)
    part = lambda n: "".join(rnd.choice(LETTERS) for _ in range(n))
    common = part(100)
    lines = [common + part(13) for _ in range(130)]
    lines += [common + part(4) + line[-9:] for line in lines[:12]]
    want = [k for k in range(len(lines)) if not any(like(lines[j], lines[k]) for j in range(k))]
    assert 100 < len(want) < 130 and lines_left(spark, lines) == want
