"""Values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.functions import strings, text
from logloom.operators import anomaly, events, graph, kernels, quality, search, similarity, tokens
from logloom.sources import grammar, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a,b,want",
    [("failed password invalid user", "failed login user", 0.326), ("in user", "login user", 0.36), ("session opened user root", "session closed user root", 0.511), ("a b", "c d", 0.0)],
)
def test_pair_cosine(spark, a, b, want):
    a, b = F.lit(a), F.lit(b)
    assert one(spark, similarity.pair_cosine(a, b, F.split(a, " "), F.split(b, " "))) == want


@pytest.mark.parametrize("a,b,want", [("a b c", "a x c", 1.7615941559557646), ("a b c", "a b c d", 0.7310585786300049), ("a b c", "x b c", 1.9051482536448667)])
def test_edit_distance(a, b, want):
    assert strings.weighted_edit_distance(a.split(), b.split(), 3) == pytest.approx(want)


def test_common_substring():
    assert strings.common_substring(["abcde", "xbcdy"]) == "bcd"
    assert strings.common_substring(["abc"]) == ""


def test_text(spark):
    assert one(spark, text.squeeze(text.letters_only(F.lit("information from port 22")))) == "inmation"
    assert one(spark, F.concat_ws(" ", text.countgroup(F.lit("sshd[123]: Failed user=root from 10.0.0.1")))) == "sshd failed userroot from"


def test_constant_columns(spark):
    single = spark.createDataFrame([(0, ["a", "b"])], "line_id long, tokens array<string>")
    assert [r["event"] for r in events.drop_constant(single).collect()] == [""]
    rows = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "x", "c"])], "line_id long, tokens array<string>")
    made = events.positional_template(rows.withColumn("g", F.lit(0)), ["g"]).first()
    assert (made["template"], made["n"]) == ("a * c", 2)


def test_anomaly_transform(spark):
    rows = spark.createDataFrame(list(enumerate([0.0, 0.1, 0.25, 0.5, 1.0])), "cluster_id long, score double")
    out = {r["cluster_id"]: (r["quadratic"], r["normalised"]) for r in anomaly.transformed(rows).collect()}
    assert [out[i] for i in range(5)] == [(0.0, -1.0), (0.36, -0.28), (0.75, 0.5), (1.0, 1.0), (0.0, -1.0)]
    flat = spark.createDataFrame([(0, 2.0), (1, 2.0)], "cluster_id long, score double")
    assert {r["normalised"] for r in anomaly.transformed(flat).collect()} == {0.0}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {n: n for n in range(400)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    frame = spark.createDataFrame([(min(e), max(e), 1.0) for e in edges], "src long, dst long, weight double")
    got = {r["node_id"]: r["cluster_id"] for r in graph.components(spark.range(400).toDF("node_id"), frame).collect()}
    assert got == {n: find(n) for n in range(400)}
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert graph.components(spark.range(3).toDF("node_id"), none).count() == 3


def ring(*groups):
    out = {}
    for g in groups:
        for a in g:
            for b in g:
                if a != b:
                    out.setdefault(a, {})[b] = 1.0
    for x, y in zip(groups, groups[1:], strict=False):
        out[x[-1]][y[0]] = out[y[0]][x[-1]] = 0.1
    return out


@pytest.mark.parametrize("kernel", [kernels.majority, kernels.louvain, kernels.recursive_cut])
def test_kernels_find_two_cliques(kernel):
    label = kernel(ring([0, 1, 2, 3], [4, 5, 6, 7]))
    assert len({label[n] for n in range(4)}) == 1 and len({label[n] for n in range(4, 8)}) == 1 and label[0] != label[4]


def test_cut_cliques_groups():
    g = ring([0, 1, 2, 3], [4, 5, 6, 7])
    weight, side = kernels.min_cut(g)
    assert weight == pytest.approx(0.1) and side in ({0, 1, 2, 3}, {4, 5, 6, 7})
    assert kernels.maximal_cliques(g) == [[0, 1, 2, 3], [3, 4], [4, 5, 6, 7]]
    assert kernels.forward_groups([(1, 3), (2, 3)], [1, 2, 3]) == {1: 1, 3: 1, 2: 2}
    assert set(kernels.graph_entropy(g)) == set(range(8))


def test_percolation(spark):
    frame = spark.createDataFrame([(a, b, w) for a, near in ring([0, 1, 2], [3, 4, 5]).items() for b, w in near.items() if a < b], "src long, dst long, weight double")
    got = {r["node_id"]: r["cluster_id"] for r in graph.k_clique_clusters(spark.range(7).toDF("node_id"), frame, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_identical_labels(spark):
    rows = spark.createDataFrame([(i % 3, i % 3) for i in range(9)], "t long, p long")
    assert quality.adjusted_rand(rows, "t", "p").first()["value"] == 1.0
    assert quality.v_measure(rows, "t", "p").first()["v_measure"] == 1.0
    assert quality.adjusted_mutual_information(rows, "t", "p") == pytest.approx(1.0)


def test_two_means(spark):
    assert tokens.two_means(spark.createDataFrame([(x,) for x in (1.0, 1.1, 1.2, 5.0, 5.5)], "d double"), "d") == 5.0


def test_search():
    score = lambda k, i: -abs(k - 3) - abs(i - 0.5)
    axes = {"k": [2, 3, 4], "i": [0.1, 0.5, 0.9]}
    assert search.grid(score, "calinski_harabasz", **axes)[0] == {"k": 3, "i": 0.5}
    assert search.anneal(score, "calinski_harabasz", seed=1, **axes) == search.anneal(score, "calinski_harabasz", seed=1, **axes)


def test_readers(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo; x\n")
    (tmp_path / "b.labeled").write_text("1; y\n")
    lines = readers.read_lines(spark, str(tmp_path), exclude=".labeled")
    assert sorted((r["line_id"], r["raw"]) for r in lines.collect()) == [(0, "one"), (1, "two; x")]
    assert [r["label"] for r in readers.labels(lines).orderBy("line_id").collect()] == ["one", "two"]
    (tmp_path / "run.conf").write_text("[main]\nmethod = a\n\tb\nk = 3\n")
    assert readers.read_config(str(tmp_path / "run.conf")) == {"main": {"method": ["a", "b"], "k": "3"}}


def test_grammar_rejects(spark):
    lines = spark.createDataFrame([(0, "no such format")], "line_id long, raw string")
    assert grammar.parse(lines, "auth").first()["message"] is None
    with pytest.raises(ValueError, match="unknown log type"):
        grammar.parse(lines, "nope")
