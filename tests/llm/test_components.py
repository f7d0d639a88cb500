"""Components of long chains, hubs and odd edges."""

from pyspark.sql import functions as F

from logloom.llm.components import components


def test_long_chain_and_hub(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("id * 7919 % 100003 a", "(id + 1) * 7919 % 100003 b")
    hub = spark.range(20_000).selectExpr("1000000 a", "id + 1000001 b")
    out = components(chain.unionByName(hub)).groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy("root").collect()
    assert [(r["root"], r["n"]) for r in out] == [(0, n + 1), (1000000, 20_001)]


def test_chain_in_order(spark):
    n = 100_000
    out = components(spark.range(n - 1).selectExpr("id a", "id + 1 b"))
    assert out.agg(F.count(F.lit(1)), F.max("root")).first()[:] == (n, 0)


def test_odd_edges(spark):
    edges = spark.createDataFrame([(3, 2), (2, 3), (5, 5), (None, 1), (2, 9), (7, 8)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(2, 2), (3, 2), (7, 7), (8, 7), (9, 2)]
    assert components(edges.limit(0)).count() == 0
