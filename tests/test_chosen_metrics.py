"""Choice of internal indices by name, the silhouette without a second cluster, and JSON truths."""

import pytest

from logloom.operators import quality
from logloom.sources import readers


def test_choice(spark):
    edges = spark.createDataFrame([(0, 1, 0.8), (1, 2, 0.3)], "src long, dst long, weight double")
    one = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "node_id long, cluster_id long")
    two = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node_id long, cluster_id long")
    found = {r["metric"]: r["value"] for r in quality.internal(["pair_dunn", "pair_silhouette", "pair_dunn"], edges=edges, membership=two).collect()}
    assert found == {"pair_dunn": 3.5, "pair_silhouette": pytest.approx((1 + ((0.7 - 0.2) / 0.7 - 1) / 2) / 2, abs=1e-3)}
    assert quality.pair_silhouette(edges, one).first()["value"] == 0
    for wrong in ([], ["nothing"], ["calinski_harabasz"]):
        with pytest.raises(ValueError):
            quality.internal(wrong, edges=edges, membership=two)


def test_json_truth(spark):
    texts = spark.createDataFrame([(0, '{"3": "normal", "x": "attack", "5": null}'), (1, None), (2, "broken")], "line_id long, json string")
    assert sorted((r["line_id"], r["label"]) for r in readers.json_truth(texts, "json").collect()) == [(3, "normal"), (5, None)]
