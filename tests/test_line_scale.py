"""Clusterings over many lines: plans without a shuffle by few keys, and the same rows from lists and from joins."""

import contextlib
import io
from collections import Counter

from pyspark.sql import functions as F

from logloom.operators import tokens as tk

LINES = ["a b c", "a b d", "a x", "a", "b b c b", "x a b c", "", "c a a"] * 3


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def rows(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in enumerate(LINES)], "line_id long, tokens array<string>")


def test_choices_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = plan(tk.by_position(tk.by_count(rows(spark))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [part" in made


def test_pairs_without_a_join(spark):
    made = tk.pair_counts(rows(spark).withColumn("group_id", tk.initial_group(F.col("line_id"), 2, 7)))
    group = dict(map(tuple, tk.initial_groups(rows(spark), 2, 7).collect()))
    want = Counter((group[i], a, b) for i, t in enumerate(LINES) for a, b in {(a, b) for j, a in enumerate(t.split()) for b in t.split()[j + 1 :]})
    assert {(r["group_id"], r["first"], r["next"]): r["n"] for r in made.collect()} == want and "Join" not in plan(made)


def test_candidates_without_a_join(spark, monkeypatch):
    frequent = spark.createDataFrame([("a",), ("c",)], "word string")
    want = {i: " ".join(w for w in t.split() if w in "ac") or None for i, t in enumerate(LINES)}
    assert "Join" not in plan(tk.candidates(rows(spark), frequent)) + plan(tk.candidate_gaps(rows(spark), frequent))
    gaps = sorted(map(tuple, tk.candidate_gaps(rows(spark), frequent).collect()))
    for limit in (10, 1):
        monkeypatch.setattr(tk, "LISTED", limit)
        assert dict(map(tuple, tk.candidates(rows(spark), frequent).collect())) == want
        assert sorted(map(tuple, tk.candidate_gaps(rows(spark), frequent).collect())) == gaps


def test_patterns_from_lists_and_joins(spark, monkeypatch):
    places = Counter((i, w) for t in LINES for i, w in enumerate(t.split()))
    for support in (4, 6, 100):
        made = Counter(" ".join(w if places[i, w] >= support else "*" for i, w in enumerate(t.split())) for t in LINES if t)
        want = {p: n for p, n in made.items() if n >= support}
        for limit in (10, 1):
            monkeypatch.setattr(tk, "LISTED", limit)
            got = tk.line_patterns(rows(spark), support)
            assert dict(map(tuple, got.collect())) == want
            assert limit == 1 or "Join" not in plan(got)
