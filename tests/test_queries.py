"""Queries against their SQL on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["dfa1_box_sizes", "dfa2_dfa", "dfa3_dfa_short", "dfa4_acr", "dfa7_multifractal", "dfa21_conformal", "dfa22_time_to_threshold", "win11_autocorr_at_lag", "pre3_fill_gaps", "pre15_resample_hold", "pre20_compress_changes", "cal1_fit_ar1", "cal8_cusum_path", "leg6_missingness", "leg14_dedupe_alarms", "inc1_group_incidents", "inc4_context_active_at", "eva2_refractory_alarms", "eva3_window_detection", "eva10_auc_roc", "ar7_anomaly_sequences", "dom9_nearest_centroid_holdout"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert cols == sorted(rel.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
