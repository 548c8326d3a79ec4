"""Binary splitting in rounds against a recursion that goes left first and stops at the cap."""

import numpy as np
import pytest

from tidewright.operators import windows


def best(alphas, least):
    n = len(alphas)
    if n < 2 * least:
        return None
    sigma = max(float(np.median(np.abs(np.diff(alphas)))) / 0.6745 / 2**0.5, 0.02)
    top = None
    for left in range(least, n - least + 1):
        a, b = float(np.mean(alphas[:left])), float(np.mean(alphas[left:]))
        z = abs(b - a) / (sigma * (1 / left + 1 / (n - left)) ** 0.5)
        if abs(b - a) >= 0.10 and z > 4 and (top is None or z > top[1] + 1e-12):
            top = (left, z, a, b)
    return top


def recursion(alphas, most):
    found = []

    def go(lo, hi):
        if len(found) >= most:
            return
        cut = best(alphas[lo:hi], 3)
        if cut:
            found.append(((lo + cut[0]) * 1024, *cut[1:]))
            go(lo, lo + cut[0])
            go(lo + cut[0], hi)

    go(0, len(alphas))
    return sorted(found)


@pytest.mark.parametrize("most", [10, 3, 1])
def test_rounds_are_the_recursion(spark, most):
    rng = np.random.default_rng(6)
    levels = {"steps": [0.5] * 9 + [0.9] * 7 + [1.3] * 8 + [0.6] * 12 + [1.0] * 5 + [0.5] * 10, "flat": [0.5] * 20, "short": [0.5, 0.9, 0.5], "one": [0.5] * 6 + [0.9] * 6}
    alphas = {k: (np.array(v) + rng.normal(size=len(v)) * 0.02).tolist() for k, v in levels.items()}
    rows = [(k, i, a) for k, v in alphas.items() for i, a in enumerate(v)]
    got = windows.find_changepoints(spark.createDataFrame(rows, "series_id string, block long, alpha double"), ["series_id"], max_points=most)
    assert got.columns == ["series_id", "location", "z", "before", "after"]
    mine = {}
    for r in got.collect():
        mine.setdefault(r.series_id, []).append((r.location, r.z, r.before, r.after))
    for k, v in alphas.items():
        want = recursion(v, most)
        assert [p[0] for p in sorted(mine.get(k, []))] == [p[0] for p in want]
        for a, b in zip(sorted(mine.get(k, [])), want):
            assert a == pytest.approx(b, rel=1e-9)
    assert len(mine["steps"]) == min(most, 5) and "flat" not in mine


def test_no_blocks(spark):
    assert windows.find_changepoints(spark.createDataFrame([], "series_id string, block long, alpha double"), ["series_id"]).count() == 0


@pytest.mark.parametrize("most", [10, 3])
def test_rounds_do_not_follow_the_number_of_cuts(spark, monkeypatch, most):
    rng = np.random.default_rng(3)
    alphas = (np.tile([0.5] * 4 + [1.2] * 4, 12) + rng.normal(size=96) * 0.02).tolist()
    rounds, one = [], windows.find_changepoint
    monkeypatch.setattr(windows, "find_changepoint", lambda *a: rounds.append(1) or one(*a))
    got = windows.find_changepoints(spark.createDataFrame([("s", i, a) for i, a in enumerate(alphas)], "series_id string, block long, alpha double"), ["series_id"], max_points=most)
    want = recursion(alphas, most)
    assert len(want) == most and sorted(r.location for r in got.collect()) == [p[0] for p in want]
    assert len(rounds) <= most + 1
