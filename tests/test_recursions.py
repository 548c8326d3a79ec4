"""Blocked recursions against going through a series from its first value to its last."""

import numpy as np
import pytest

from tidewright.operators import forecast, guard, ranks, recursions

SERIES = {"a": 203, "b": 64, "c": 7, "d": 1, "e": 12}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(12)
    return {k: np.cumsum(rng.normal(size=n)) * 0.3 + rng.normal(size=n) + 5 for k, n in SERIES.items()}


def frame(spark, values, names="asset_id string, channel string, tick long, value double"):
    return spark.createDataFrame([(k, "x", i, float(v)) for k, x in values.items() for i, v in enumerate(x)], names)


@pytest.mark.parametrize("chunk", [8, 64, 65_536])
def test_weighted_means(spark, values, chunk):
    df = frame(spark, values)
    got = {(r.asset_id, r.tick): r.e for r in forecast.ewma(df, ["asset_id", "channel"], 30, "value", chunk).collect()}
    want = {(k, i): v for k, x in values.items() for i, v in enumerate(forecast.smoothed(x, 30))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


@pytest.mark.parametrize("chunk", [8, 65_536])
def test_charts(spark, values, chunk):
    healthy = {k: np.random.default_rng(1).normal(size=50) * 0.6 + 5 for k in values if k != "e"}
    e, c = set(), set()
    for k in healthy:
        m, s = healthy[k].mean(), healthy[k].std()
        z, up, down = m, 0.0, 0.0
        for i, v in enumerate(values[k]):
            z = 0.2 * v + 0.8 * z
            if abs(z - m) > 3 * s * (0.2 / 1.8) ** 0.5:
                e.add((k, i))
            up, down = max(0.0, up + v - m - 0.5 * s), max(0.0, down + m - v - 0.5 * s)
            if max(up, down) > 5 * s:
                c.add((k, i))
                up = down = 0.0
    df, h = frame(spark, values), frame(spark, healthy)
    assert {(r.asset_id, r.tick) for r in guard.ewma_chart(df, h, chunk=chunk).collect()} == e and e
    assert {(r.asset_id, r.tick) for r in guard.cusum_chart(df, h, chunk=chunk).collect()} == c and len(c) > 5
    assert guard.cusum_chart(df, h.limit(0), chunk=chunk).count() == 0 == guard.ewma_chart(df.limit(0), h, chunk=chunk).count()


@pytest.mark.parametrize("chunk", [50, 64, 65_536])
def test_autoregressions(spark, chunk):
    rng = np.random.default_rng(3)
    x = {}
    for k, n, lag in (("long", 700, 4), ("next", 400, 1), ("short", 30, 1), ("tiny", 15, 1)):
        v = rng.normal(size=n)
        for i in range(lag, n):
            v[i] += 0.8 * v[i - lag]
        x[k] = v + 3
    df = frame(spark, x)
    for p in (0, 3, 10):
        got = {r.asset_id: r for r in forecast.ar_models(df, ["asset_id", "channel"], p, chunk).collect()}
        want = {k: (q, fit) for k, v in x.items() if (fit := forecast.fit_ar(v, q := p or forecast.select_order(v)))}
        assert got.keys() == want.keys()
        for k, (q, (w, b)) in want.items():
            assert got[k].p == q and got[k].weights == pytest.approx(w.tolist(), rel=1e-8, abs=1e-10) and got[k].bias == pytest.approx(b, rel=1e-8)


def test_blocks_shorter_than_the_order_are_an_error(spark, values):
    with pytest.raises(ValueError):
        recursions.normal_equations(frame(spark, values), ["asset_id", "channel"], [10], 1e-4, 5)


def test_alpha_anomalies_against_the_kernel(spark):
    rng = np.random.default_rng(8)
    train = {k: rng.normal(size=n) for k, n in (("a", 900), ("b", 900), ("short", 200), ("c", 900))}
    test = {k: rng.normal(size=700) for k in train}
    test["a"][300:460] = np.cumsum(rng.normal(size=160))
    test["b"][500:] = np.cumsum(rng.normal(size=200))
    test["c"] = test["c"][:90]
    a, b = (frame(spark, x) for x in (train, test))
    got = sorted((r.asset_id, r.start, r.end) for r in forecast.detect_alpha_anomalies(a, b, ["asset_id", "channel"]).collect())
    assert got == sorted((k, s, t) for k in train for s, t in forecast.detect_alpha(train[k], test[k])) and len(got) >= 2


@pytest.mark.parametrize("p, chunk", [(0, 400), (0, 65_536), (5, 777)])
def test_forecast_anomalies_against_the_kernel(spark, p, chunk):
    rng = np.random.default_rng(21)
    sizes = {"long": (1200, 4700), "quiet": (700, 900), "lags": (900, 2301), "rest": (800, 2300), "short": (12, 500), "few": (300, 4), "flat": (300, 260), "alone": (400, 0)}
    train, test = ({k: rng.normal(size=n[i]) + 3 for k, n in sizes.items()} for i in (0, 1))
    for part in (train, test):
        for i in range(4, len(part["lags"])):
            part["lags"][i] += 0.7 * (part["lags"][i - 4] - 3)
        part["flat"][:] = 1.5
    test["long"][2200:2230] += 40
    test["long"][3900:3906] += 9
    test["lags"][1000:1100] *= 4
    test["rest"][2290:] += 30
    a, b = (frame(spark, x) for x in (train, test))
    got = sorted((r.asset_id, r.start, r.end) for r in forecast.detect_forecast_anomalies(a, b, ["asset_id", "channel"], p, chunk=chunk).collect())
    want = sorted((k, s, t) for k in train if len(test[k]) for s, t in forecast.detect(train[k], test[k], p))
    assert got == want and {"long", "lags", "rest"} <= {k for k, _, _ in got}


def test_forecast_anomalies_without_rows(spark, values):
    df = frame(spark, values)
    assert forecast.detect_forecast_anomalies(df.limit(0), df, ["asset_id", "channel"], 3).count() == 0
    with pytest.raises(ValueError):
        forecast.detect_forecast_anomalies(df, df, ["asset_id", "channel"], 3, chunk=100)


def test_nth_smallest(spark):
    rng = np.random.default_rng(5)
    x = {"a": rng.exponential(size=997) ** 4, "b": np.round(rng.normal(size=300), 1), "c": np.full(50, 2.0), "d": np.array([7.0]), "e": np.r_[np.zeros(90), 1e300, rng.random(20) * 1e-9]}
    df = frame(spark, {**x, "none": []}).unionByName(spark.createDataFrame([("a", "x", 9999, None)], "asset_id string, channel string, tick long, value double"))
    for nth, at in (("n div 2", lambda n: n // 2), ("0", lambda n: 0), ("n - 1", lambda n: n - 1)):
        for cells in (4, 65_536):
            got = {r.asset_id: r.value for r in ranks.nth_smallest(df, ["asset_id", "channel"], "value", nth, cells=cells).collect()}
            assert got == {k: np.sort(v)[at(len(v))] for k, v in x.items()}
