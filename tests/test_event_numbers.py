"""Events are numbered without a window over all of them."""

import contextlib
import io

from pyspark.sql import functions as F

from logloom.operators import events as ev


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def test_events_numbered_by_ranges(spark):
    lines = spark.range(5000).selectExpr("(id * 7919) % 5000 line_id", "cast((id * 7919) % 5000 % 1250 as string) event")
    made = ev.unique_events(lines.repartition(7), F.col("event"))
    assert "Window" not in plan(made.select("event", "members"))
    got = sorted((r["node_id"], r["event"], r["frequency"], r["first_line"], r["members"]) for r in made.collect())
    assert got == [(i, str(i), 4, i, [i, i + 1250, i + 2500, i + 3750]) for i in range(1250)]
    assert ev.unique_events(lines.where("false"), F.col("event")).count() == 0
