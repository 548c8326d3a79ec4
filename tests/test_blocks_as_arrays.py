"""Exponents of blocks as arrays: no row is repeated by box size, and the values are those of the relational form."""

import os

import numpy as np
import pytest

from tidewright.functions import kernels
from tidewright.jobs import catalog, domain_queries
from tidewright.operators import domains, prepare, structure

SF = "/root/testdata/sf0.001"


def series(spark, n):
    rng = np.random.default_rng(7)
    made = {"noise": rng.normal(size=n), "walk": np.cumsum(rng.normal(size=n)), "flat": np.full(n, 3.0), "part": np.r_[np.full(n // 2, 1.0), rng.normal(size=n - n // 2)]}
    return spark.createDataFrame([(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)], "series_id string, tick long, value double")


def test_hrv_without_rows_by_box(spark):
    df = series(spark, 600)
    out = domains.hrv_features(df, ["series_id"], 64, 256)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.series_id: r for r in out.collect()}
    for c, n, fit in (("alpha1", 64, structure.dfa_short), ("alpha2", 256, structure.dfa)):
        alphas = {}
        for r in fit(df.selectExpr("series_id", f"tick div {n} AS b", f"tick % {n} AS tick", "value"), ["series_id", "b"]).where(f"n = {n}").collect():
            alphas.setdefault(r.series_id, []).append(r.alpha)
        for k, a in alphas.items():
            kept = [x for x in a if x is not None]
            assert (got[k][c] is None) if not kept else got[k][c] == pytest.approx(np.median(kept), abs=1e-9), (c, k)
    assert got["flat"].alpha1 is None and got["noise"].alpha1 is not None


def test_short_exponents_together():
    rng = np.random.default_rng(3)
    for n in (16, 17, 64, 301):
        x = np.vstack([rng.normal(size=(3, n)), np.full((1, n), 2.5), np.cumsum(rng.normal(size=(1, n)), -1), np.arange(n)[None] * 1.0])
        alpha, r2 = kernels.dfa_shorts(x)
        for k, row in enumerate(x):
            want = kernels.dfa_short(row)
            assert np.isnan(alpha[k]) if want is None else (alpha[k], r2[k]) == pytest.approx(want, abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_exponents_of_six_columns_are_measured_once(spark):
    plan = catalog.QUERIES["dom9_group_holdout"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan
    rows = {r.id: r["values"] for r in domain_queries.leg_vectors(spark, SF).collect()}
    placed = prepare.assign_ticks(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    blocks = {}
    for r in sorted(placed.collect(), key=lambda r: (r.l_suppkey, r.tick)):
        blocks.setdefault(f"{r.l_suppkey}/{r.tick // 128}", []).append([float(r[c]) for c in domain_queries.LEGS])
    whole = {k: np.array(v) for k, v in blocks.items() if len(v) == 128}
    assert rows.keys() == whole.keys() and whole
    for k, x in whole.items():
        assert rows[k] == pytest.approx([round(float(kernels.dfa(x[:, c])[0]), 6) for c in range(6)], abs=2e-6)
