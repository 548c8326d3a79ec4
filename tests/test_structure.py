import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels
from tidewright.operators import grouped, prepare, structure, windows

from .test_kernels import noise


@pytest.fixture(scope="module")
def series(spark):
    data = {"white": noise(700, 3), "walk": np.cumsum(noise(900, 5)), "short": noise(40, 7), "flat": np.ones(200)}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return data, spark.createDataFrame(rows, "series_id string, tick long, value double").repartition(4).persist()


K = ["series_id"]


@pytest.mark.parametrize("chunk", [None, 100])
def test_relational_exponent_is_the_kernels(series, chunk):
    data, df = series
    for r in structure.dfa(df, K, chunk).collect():
        a, r2 = kernels.dfa(data[r.series_id])
        assert (r.alpha, r.r2) == pytest.approx((float(a), float(r2)), abs=1e-9)


def test_short_exponent_and_autocorrelation(series):
    data, df = series
    for r in structure.dfa_short(df, K).collect():
        want = kernels.dfa_short(data[r.series_id])
        assert (r.alpha is None) == (want is None)
        if want:
            assert r.alpha == pytest.approx(want[0], abs=1e-9)
    for r in structure.acr(df, K).collect():
        assert (r.acr_alpha, r.acr_r2) == pytest.approx(kernels.acr(data[r.series_id]), abs=1e-9)


def test_law_words(series):
    _, df = series
    law = {r.series_id: r for r in structure.analyze(df, K).collect()}
    assert law["flat"].quality == "Abstain" and law["flat"].hurst == 0.5
    assert law["walk"].quality in ("Exact", "Strong") and law["walk"].alpha > 1.2


def test_few_values_are_insufficient(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("a", 10, float("nan"))], "series_id string, tick long, value double")
    r = structure.analyze(df, K).first()
    assert (r.quality, r.n, r.alpha) == ("Insufficient", 10, 0.5)


def test_windows_relational_and_fast(series):
    _, df = series
    a = {(r.series_id, r.w): r.alpha for r in windows.rolling_alpha(df, K, 128, 60).collect()}
    b = {(r.series_id, r.w): r.alpha for r in windows.rolling_alpha_fast(df, K, 128, 60).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_changepoints(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=10 * 1024), np.cumsum(rng.normal(size=10 * 1024)), rng.normal(size=10 * 1024)])
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series_id string, tick long, value double")
    blocks = windows.block_alphas(df, K)
    assert [r.location for r in windows.find_changepoints(blocks, K).orderBy("location").collect()] == [10 * 1024, 20 * 1024]
    assert windows.find_changepoint(blocks, K).first().location in (10 * 1024, 20 * 1024)
    quiet = df.where(F.col("tick") < 10 * 1024)
    assert windows.find_changepoints(windows.block_alphas(quiet, K), K).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "series_id string, tick long, value double")
    assert structure.dfa(df, K).count() == 0 and structure.analyze(df, K).count() == 0
    assert windows.rolling_alpha(df, K, 64, 8).count() == 0 and prepare.fill_gaps(df, K).count() == 0


def test_shuffle_keeps_values(spark):
    x = noise(100)
    y = grouped.shuffled(x)
    assert sorted(x) == sorted(y) and not np.array_equal(x, y) and np.array_equal(y, grouped.shuffled(x))


def test_conformal_ties_and_empty_calibration(spark):
    cal = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0)], "series_id string, score double")
    new = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 9.0), ("b", 3, 1.0)], "series_id string, id long, score double")
    p = {r.id: r.p for r in structure.conformal(cal, new, K).collect()}
    assert p == {1: pytest.approx(3 / 4), 2: pytest.approx(1 / 4), 3: 1.0}
