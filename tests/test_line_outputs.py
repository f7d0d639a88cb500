"""Distances written and read again, and lines without an abstraction."""

from logloom.sources import readers, sinks


def test_distances_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.25)], "src long, dst long, weight double")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node_id long, cluster_id long")
    made = sinks.node_distances(pairs, clusters)
    sinks.save_distances(made, str(tmp_path / "d"))
    read = sorted(map(tuple, readers.read_distances(spark, str(tmp_path / "d")).collect()))
    assert read == sorted(map(tuple, made.collect())) == [(0, 0, 1, 0.2), (1, 0, 0, 0.2), (1, 1, 2, 0.75), (2, 0, 1, 0.75)]


def test_no_abstraction(spark):
    lines = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "line_id long, cluster_id long")
    known = spark.createDataFrame([(1, "a *")], "cluster_id long, template string")
    out = {r["line_id"]: r["abstraction"] for r in sinks.abstraction_per_line(lines, known, ["cluster_id"]).collect()}
    assert out == {0: "a *", 1: None, 2: None}
