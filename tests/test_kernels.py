import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.functions import kernels


def noise(n: int, seed: int = 42) -> np.ndarray:
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append((seed >> 33) / 2**31 - 0.5)
    return np.array(out)


def test_golden_exponents():
    white, walk = noise(4096), np.cumsum(noise(4096))
    assert kernels.dfa(white) == (pytest.approx(0.5246244706, abs=1e-9), pytest.approx(0.9853682683, abs=1e-9))
    assert kernels.dfa(walk) == (pytest.approx(1.4180278792, abs=1e-9), pytest.approx(0.9894368223, abs=1e-9))


@pytest.mark.parametrize("n,last", [(96, 24), (112, 27), (136, 34), (1032, 258)])
def test_last_box_size(n, last):
    assert kernels.box_sizes(n)[-1] == last
    assert kernels.box_sizes(n) == sorted(set(kernels.box_sizes(n)))


def test_placeholder_and_refusals():
    assert kernels.dfa(np.zeros(10)) == (0.5, 0.0)
    assert kernels.dfa(noise(71)) == (0.5, 0.0)
    assert kernels.dfa_short(noise(15)) is None
    assert kernels.dfa_short(np.ones(40)) is None
    assert kernels.dfa_short(noise(24)) is not None


def test_units_do_not_matter():
    x = noise(2000)
    assert kernels.dfa(x * 1e6 + 5)[0] == pytest.approx(kernels.dfa(x)[0], abs=1e-9)


def test_windows_agree_with_single_series():
    x = noise(600)
    alpha, r2 = kernels.rolling_alpha(x, 96, 2)
    assert len(alpha) == (600 - 96) // 2 + 1
    for k in (0, 17, len(alpha) - 1):
        assert (alpha[k], r2[k]) == pytest.approx([float(v) for v in kernels.dfa(x[2 * k : 2 * k + 96])], abs=1e-12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=0, max_size=300))
def test_any_series_gives_a_number(values):
    a, r = kernels.dfa(np.array(values, float)) if values else (0.5, 0.0)
    assert math.isfinite(a) and r <= 1 + 1e-9


def test_windows_share_their_boxes(monkeypatch):
    """A box is fitted once for all windows that hold it, and windows in which rounding counts are done apart."""
    base = noise(1500, 5)
    stuck, spike = base.copy(), base.copy()
    stuck[500:900], stuck[1200:1260], spike[700] = stuck[500], 7.0, 1e12
    for x in (base, np.cumsum(base), stuck, spike, np.full(1500, 3.3), 1e8 + 1e-6 * base, np.where(np.arange(1500) == 40, np.nan, base)):
        for window, step in ((256, 1), (96, 2), (128, 64), (60, 1)):
            got, want = kernels.rolling_alpha(x, window, step), kernels.dfa(kernels.windows(x, window, step))
            assert np.allclose(got[0], want[0], atol=1e-9, equal_nan=True) and np.allclose(got[1], want[1], atol=1e-9, equal_nan=True)
    both = kernels.rolling_alpha(np.stack([base, stuck]), 96, 2)[0]
    assert np.allclose(both[1], kernels.rolling_alpha(stuck, 96, 2)[0])
    seen, fit = [], kernels._box_rss
    monkeypatch.setattr(kernels, "_box_rss", lambda boxes: seen.append(boxes.size) or fit(boxes))
    kernels.rolling_alpha(base, 256, 1)
    assert sum(seen) < 0.2 * (1500 - 255) * 12 * 256


def test_windows_over_runs_of_equal_values_share_their_boxes(monkeypatch):
    """Boxes within a run are lines, in every window; only windows that are lines throughout are done apart, equal ones once."""
    rng = np.random.default_rng(4)
    apart, whole = [], kernels.dfa
    monkeypatch.setattr(kernels, "dfa", lambda x: apart.append(len(x)) or whole(x))
    for run in (3, 16, 60, 64, 255, 360, 900):
        x = np.repeat(rng.normal(size=1800 // run + 1) * 40, run)[:1800]
        for window, step in ((256, 1), (96, 2)):
            got, want = kernels.rolling_alpha(x, window, step), whole(kernels.windows(x, window, step))
            assert np.allclose(got[0], want[0], atol=1e-8) and np.allclose(got[1], want[1], atol=1e-8)
    assert sum(apart) < 300
