"""Exponents of series with runs of equal values: boxes that are lines but for rounding, in every form against explicit residuals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels
from tidewright.operators import grouped, structure, windows


def plain(x, sizes, both=False):
    """(alpha, r2) from each point's own residual, in whole numbers of high precision."""
    from fractions import Fraction

    n = len(x)
    d = [Fraction(v) - Fraction(sum(map(Fraction, x)), n) for v in x]
    y, total = [], Fraction(0)
    for v in d:
        total += v
        y.append(total)
    floor = float(sum(v * v for v in y) / n) * 1e-24
    points = []
    for s in sizes:
        k, f2 = n // s, []
        for at in (range(0, k * s, s), range(n - k * s, n, s))[: 1 + both]:
            for a in at:
                seg = y[a : a + s]
                m, t = sum(seg) / s, Fraction(s - 1, 2)
                b = sum((i - t) * v for i, v in enumerate(seg)) / sum((i - t) ** 2 for i in range(s))
                f2.append(sum((v - m - b * (i - t)) ** 2 for i, v in enumerate(seg)) / s)
        f2 = float(sum(f2) / len(f2))
        if f2 > floor:
            points.append((math.log(s), math.log(math.sqrt(f2))))
    p = np.array(points)
    if len(p) < 3:
        return 0.5, 0.0
    dx, dy = p[:, 0] - p[:, 0].mean(), p[:, 1] - p[:, 1].mean()
    slope = (dx @ dy) / (dx @ dx)
    return slope, 1 - ((dy - slope * dx) ** 2).sum() / max(float(dy @ dy), 1e-15)


def series():
    rng = random.Random(6)
    out = {"stuck": [7.0] * 81 + [7.5] + [7.0] * 118, "steps": [float(v) for v in (60, 61, 3, 60) for _ in range(40)], "sentences": [33.0] * 30 + [20.0] * 25 + [90.0, 14.0, 33.0] + [33.0] * 40}
    out["quantised"] = [round(rng.gauss(0, 1) * 0.4) * 0.25 + 1e6 for _ in range(300)]
    out["flat"] = [5.0] * 128
    out["noise"] = [rng.gauss(0, 1) for _ in range(256)]
    tiny = [1000.0 + 1e-7 * rng.gauss(0, 1) for _ in range(160)]
    out["tiny"] = tiny[:80] + [2000.0] + tiny[81:]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, i, v) for k, x in series().items() for i, v in enumerate(x)], "series_id string, tick long, value double")


def check(got, both=False, but=()):
    for k, x in series().items():
        if k in but:
            continue
        want = plain(x, kernels.short_box_sizes(len(x)) if both else kernels.box_sizes(len(x)), both)
        if both and len(set(x)) == 1:
            assert got[k] is None or got[k][0] is None
            continue
        assert got[k] == pytest.approx(want, rel=2e-4, abs=2e-4), k


def test_kernels():
    check({k: tuple(float(v) for v in kernels.dfa(np.array(x))) for k, x in series().items()})
    check({k: kernels.dfa_short(np.array(x)) for k, x in series().items()}, both=True)


@pytest.mark.parametrize("refine", [False, True])
@pytest.mark.parametrize("chunk", [None, 50])
def test_relational(table, chunk, refine):
    check({r.series_id: (r.alpha, r.r2) for r in structure.dfa(table, ["series_id"], chunk=chunk, refine=refine).collect()}, but=() if refine else ("tiny",))


def test_relational_short_and_grouped(table):
    check({r.series_id: (r.alpha, r.r2) for r in structure.dfa_short(table, ["series_id"]).collect()}, both=True, but=("tiny",))
    check({r.series_id: (r.alpha, r.r2) for r in structure.dfa_short(table, ["series_id"], refine=True).collect()}, both=True)
    check({r.series_id: (r.alpha, r.r2) for r in grouped.dfa_by_key(table, ["series_id"]).collect()})


def test_windows(table):
    x = np.array([9.0] * 70 + [1.0, 9.0] + [9.0] * 100 + [2.0] * 40 + [3.0] * 88)
    rows = table.sparkSession.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, tick long, value double")
    for form in (windows.rolling_alpha, windows.rolling_alpha_fast):
        got = form(rows, ["series_id"], 96, 16).collect()
        assert len(got) == 13
        for r in got:
            assert (r.alpha, r.r2) == pytest.approx(plain(x[r.end_tick - 95 : r.end_tick + 1].tolist(), kernels.box_sizes(96)), rel=2e-4, abs=2e-4)


def test_only_doubtful_series_are_summed_again(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, i, rng.gauss(0, 1)) for k in range(20) for i in range(200)], "series_id long, tick long, value double")
    flags = structure._dfa(df, ["series_id"], None, False)
    assert flags.where("doubtful").count() == 0 and flags.count() == 20
    stuck = df.withColumn("value", F.when((F.col("series_id") == 3) & (F.col("tick") < 60), 0.25 + 1e-7 * F.col("value")).otherwise(F.col("value")))
    assert [r.series_id for r in structure._dfa(stuck, ["series_id"], None, False).where("doubtful").collect()] == [3]
    exact = {r.series_id: r.alpha for r in structure._dfa(stuck, ["series_id"], None, True).collect()}
    assert {r.series_id: r.alpha for r in structure.dfa(stuck, ["series_id"], refine=True).collect()} == pytest.approx(exact, rel=1e-9)


def test_series_of_one_length_are_measured_together():
    rng = np.random.default_rng(2)
    some = [rng.normal(size=n) for n in (100, 0, 100, 64, 100, 30, 64)] + [np.full(100, 3.0)]
    alpha, r2 = grouped.dfa_of_all(some)
    for x, a, r in zip(some, alpha, r2):
        want = kernels.dfa(x) if len(x) else (0.5, 0.0)
        assert (a, r) == (pytest.approx(float(want[0]), rel=1e-12), pytest.approx(float(want[1]), rel=1e-12))
