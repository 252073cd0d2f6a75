"""Every query with SQL against DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from tidemark import catalog
from tidemark.functions import evaluation

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(x) for x in frame.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or math.isclose(float(u), float(v), rel_tol=1e-9, abs_tol=1e-9), (x, y)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_learned_counts_are_close(spark):
    e = catalog.learned(spark, SF)
    t = catalog._tables(spark, SF)
    q = [r["q_error"] for r in evaluation.cardinalities(spark, e, evaluation.truths(e, t, catalog.COUNTS)).collect()]
    assert sorted(q)[len(q) // 2] < 1.5 and max(q) < 2, q
