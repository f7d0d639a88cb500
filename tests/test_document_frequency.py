"""Lines that contain a term: no nested loop, terms inside other words, odd terms and lines."""

import contextlib
import io

from pyspark.sql import functions as F

from logloom.operators import events as ev
from logloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_no_nested_loop_over_terms(spark):
    for name in ("pre_18_document_frequency", "pre_19_tf_idf", "pre_20_norms"):
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            QUERIES[name](spark, SF).explain()
        assert "contains(low" not in plan.getvalue().lower(), name


def test_terms_inside_lines(spark):
    long = "ab" * 60
    lines = ["the other", "The", "x" + long + "y", long[:80], "cafés", "", None, "a.b 10.0", "the the", long.upper()]
    terms = ["the", "he", "o", "cafs", "a.b", "10.0", long, long[:80], long[:64], "ab", ""]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, raw string")
    got = dict(map(tuple, ev.document_frequency(spark.createDataFrame([(t,) for t in terms + terms], "term string"), frame).collect()))
    assert got == {t: sum(x is not None and t in x.lower() for x in lines) for t in terms}


def test_term_frequency_of_one_row(spark):
    rows = spark.createDataFrame([(1, "b a b c b".split()), (2, []), (3, None), (4, ["z"])], "node_id long, w array<string>")
    got = {(r["node_id"], r["term"]): r["tf"] for r in ev.terms(rows, F.col("w")).collect()}
    assert got == {(1, "a"): 0.2, (1, "b"): 0.6, (1, "c"): 0.2, (4, "z"): 1.0}
