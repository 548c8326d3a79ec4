"""Every registered query that has SQL, outside the training-data part, against it on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewright.jobs import catalog

from .test_queries import SOME

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def near(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return (math.isnan(a) and (b is None or math.isnan(b))) or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    return a == b or (isinstance(a, float) and math.isnan(a) and b is None)


def rank(row):
    """Exact columns first; doubles by five digits, so that rows with values that differ in the last bits lie alike."""
    return [repr(v) for v in row if not isinstance(v, float)], [float(f"{v:.5g}") if isinstance(v, float) and not math.isnan(v) else 0.0 for v in row]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE) - set(SOME)))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.ORACLE[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=rank)
    want = sorted((tuple(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at) for r in rel.fetchall()), key=rank)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(near(a, b) for a, b in zip(g, w)), (g, w)
