"""Like lines on either side of the switch between the two signatures."""

import random

from logloom.llm import line_dedup


def like(a, b, k=line_dedup.SHINGLE):
    a, b = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(a & b) >= line_dedup.SIMILARITY * len(a | b)


def lines_left(spark, lines):
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed = 0").orderBy("doc_id").collect()]


def test_one_blank_more(spark):
    pairs = [("Privacy policy", " Privacy policy"), ("Contact support", "Contact support "), ("Subscribe today", "Subscribe  today    now"), ("令和七年度予算案について国会で審議が行われた 本日 ", "令和七年度予算案について国会で審議が行われた 本日"), ("x" * 12 + "0123456789abcdefghijklmnopqrstuvwxyz", "x" * 12 + "0123456789abcdefghijklmnopqrstuvwxyz" + " " * 90)]
    lines = [t for pair in pairs for t in pair]
    want = [k for k in range(len(lines)) if not any(like(lines[j], lines[k]) for j in range(k))]
    assert sum(like(a, b) for a, b in pairs) == 4 and lines_left(spark, lines) == want


def test_switch_by_chance(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines, wanted = [], 0
    while wanted < 150:
        a = f"{word(rnd.randint(8, 70))} {word(rnd.randint(5, 60))}"
        at = rnd.choice((0, len(a), rnd.randrange(len(a))))
        b = a[:at] + " " * rnd.randint(1, 3) + a[at:]
        if like(a, b):
            lines += [a, b]
            wanted += 1
    assert len(lines) - len(lines_left(spark, lines)) >= 0.97 * wanted
