"""Distances and shared words of different texts."""

import logloom.plans.more  # noqa: F401  registers its queries
from logloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_pairs_of_different_nodes(spark):
    distances = QUERIES["int_01_text_distance_pairs"](spark, SF).collect()
    assert all(r["a"] < r["b"] for r in distances) and len({r["distance"] for r in distances}) > 1
    shared = QUERIES["sim_14_membership_pairs"](spark, SF).collect()
    assert {(r["a"], r["b"]) for r in shared} == {(r["a"], r["b"]) for r in distances} and all(r["common"] > 0 for r in shared)
