"""Lines that share a passage but are not alike do not reach the comparison of texts in every pair."""

import random

from logloom.llm import line_dedup


def shingles(t, k=line_dedup.SHINGLE):
    return {t[i : i + k] for i in range(max(1, len(t) - k + 1))}


def test_common_passage(spark, monkeypatch):
    rnd = random.Random(13)
    part = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = part(120)
    lines = [common + part(80) for _ in range(150)]
    lines += [line[:-6] + part(6) for line in lines[:10]]
    asked, like = [], line_dedup.like

    def counted(pairs, texts):
        asked.append(pairs.count())
        return like(pairs, texts)

    monkeypatch.setattr(line_dedup, "like", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    left = [r["doc_id"] for r in line_dedup.dedup_lines(docs).where("n_removed = 0").orderBy("doc_id").collect()]
    assert left == list(range(150)) and sum(asked) < 2000  # of 12720 pairs


def test_sketches_bound_differences(spark):
    rnd = random.Random(17)
    part = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    lines = [part(rnd.choice((5, 40, 400, 3000))) for _ in range(20)]
    lines += [line[: len(line) * 9 // 10] + part(len(line) // 10) for line in lines]
    got = line_dedup.sketches(spark.createDataFrame(list(enumerate(lines)), "k long, line string")).collect()
    sketch = {r["k"]: r["sketch"] for r in got}
    differ = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sketch[a], sketch[b], strict=True))
    sets = [shingles(t) for t in lines]
    assert len(sketch) == 40 and all(differ(a, b) <= len(sets[a] ^ sets[b]) for a in range(40) for b in range(40))
    assert any(differ(a, b) > 100 for a in range(40) for b in range(40))
