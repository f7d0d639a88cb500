"""Bands of lines: what runs in generated code, and the places where they begin."""

import random

from logloom.llm import line_dedup


def shingles(t, k=line_dedup.SHINGLE):
    return {t[i : i + k] for i in range(max(1, len(t) - k + 1))}


def test_sets_in_generated_code(spark):
    lines = spark.createDataFrame([(1, "some line of text that is long enough")], "k long, line string")
    plan = line_dedup.bands(lines, ["k"])._jdf.queryExecution().executedPlan().toString()
    slow = [row for row in plan.splitlines() if "lambdafunction" in row and "*(" not in row]
    assert slow and not any(f in row for row in slow for f in ("sort_array", "array_distinct", "array_position"))


def test_places_of_bands(spark):
    rnd = random.Random(23)
    part = lambda n: "".join(rnd.choice("ab cdé") for _ in range(n))
    lines = [part(n) for n in (1, 7, 8, 9, 22, 23, 24, 26, 27, 60, 69, 70, 71, 72, 90, 200, 900)] + ["x" * 500, "ab" * 90 + part(80)]
    frame = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    sets = {r["k"]: r["g"] for r in line_dedup.shingle_sets(frame, ["k"], g="line").collect()}
    got: dict[int, list] = {}
    for r in line_dedup.bands(frame, ["k"]).collect():
        assert r["n"] == len(shingles(lines[r["k"]])) == len(sets[r["k"]]) and r["band"] is not None
        got.setdefault(r["k"], []).append(r["band"])
    top = lambda h: ((h + 2**63) * line_dedup.RANGES) >> 64
    for k, g in sets.items():
        n = len(g)
        assert g == sorted(set(g))
        single = n // 5 + 1 if n <= line_dedup.LEAST * 5 // 4 - 1 else 0
        starts = range(n - 2) if n >= line_dedup.LEAST else ()
        if n >= line_dedup.EVERY:
            starts = [i for i in starts if i == 0 or top(g[i]) != top(g[i - 1])]
        assert len(got[k]) == single + len(starts)
        run = spark.createDataFrame([tuple(g[i : i + 3]) for i in starts], "a long, b long, c long").selectExpr("xxhash64(a, b, c) h") if starts else None
        assert run is None or {r["h"] for r in run.collect()} <= set(got[k])
