"""Long chains, long paths, and files that are read in several splits."""

from pyspark.sql import functions as F

from logloom.operators import graph
from logloom.sources import readers, sinks


def test_chain_of_100_000_nodes(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("id node_id")
    edges = spark.range(n - 1).selectExpr("id src", "id + 1 dst")
    out = graph.components(nodes, edges)
    assert out.agg(F.count(F.lit(1)), F.max("cluster_id")).first()[:] == (n, 0)


def test_distances_over_many_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(9)] + [(0, 9, 0.05), (20, 21, 0.5)], "src long, dst long, weight double")
    got = dict(map(tuple, graph.distances_from(edges, spark.createDataFrame([(0,)], "node_id long")).collect()))
    assert got == {i: round(0.1 * i, 3) for i in range(10)}


def test_files_in_splits(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 7)):
        (tmp_path / name).write_text("".join(f"{name} {i}\r\n" if i % 7 else "\n" for i in range(n)))
    (tmp_path / "empty.log").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(rows) == 5007 and {(r["file"].rsplit("/", 1)[1], r["line_id"]) for r in rows} == {(f, i) for f, n in (("a.log", 5000), ("b.log", 7)) for i in range(n)}
    assert all(r["raw"].strip("\r") in ("", f"{r['file'].rsplit('/', 1)[1]} {r['line_id']}") for r in rows)


def test_graph_events_escape(spark):
    nodes = spark.createDataFrame([(1, 'say "x" \\ y')], "node_id long, event string")
    edges = spark.createDataFrame([], "src long, dst long")
    assert sinks.graph_events(nodes, edges).first()["out"] == '{"an":{"1":{"label":"say \\"x\\" \\\\ y"}}}'
