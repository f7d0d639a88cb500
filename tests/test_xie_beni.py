"""The index of Xie and Beni from counts of words."""

import contextlib
import io

from pyspark.sql import functions as F

from logloom.operators import quality


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_xie_beni_builds_no_centroid(spark):
    texts = [(0, "red nut"), (0, "red bolt"), (0, "rednut nut nut"), (1, "red nut"), (1, "blue bolt nut"), (1, "blue bolt nut")]
    frame = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(texts)], "line_id long, cluster_id long, event string")
    cosine = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(quality.pair_cosine(F.col("a"), F.col("b"), F.split("a", " "), F.split("b", " "))).first()[0]
    whole = {k: " ".join(t for c, t in texts if c == k) for k in (0, 1)}
    want = sum(cosine(t, whole[c]) ** 2 for c, t in texts) / (len(texts) * cosine(whole[0], whole[1]) ** 2)
    made = quality.xie_beni(frame)
    assert abs(made.first()["value"] - want) < 6e-4 and "collect_list" not in plan(made)
    apart = frame.where("cluster_id = 0").unionByName(frame.limit(1).selectExpr("9L line_id", "2L cluster_id", "'zz' event"))
    assert quality.xie_beni(apart).first()["value"] == 0.0
