"""Every registered log-analytics query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import logloom.plans.more  # noqa: F401  registers its queries
from logloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())

    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.6g}" if isinstance(v, int | float) or hasattr(v, "quantize") else str(v)

    return [columns[i].lower() for i in order], sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert canon(frame.columns, [tuple(r) for r in frame.collect()]) == canon(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
