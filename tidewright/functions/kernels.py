"""Numpy kernels over one series, called per key inside Spark tasks."""

from __future__ import annotations

import math

import numpy as np

LAGS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


def power(r: float, k: int) -> float:
    """r**k by repeated squaring, low bit first."""
    out, square = 1.0, r
    while k:
        if k & 1:
            out *= square
        square *= square
        k >>= 1
    return out


def _steps(low: int, high: int, values: list[float]) -> list[int]:
    out: list[int] = []
    for v in values:
        s = int(v)
        if s <= high and s >= low and (not out or s != out[-1]):
            out.append(s)
    return out


def box_sizes(n: int) -> list[int]:
    low, high = max(16, n // 50), n // 4
    if low >= high:
        return []
    ratio = math.pow(high / low, 1.0 / 11.0)
    return _steps(low, high, [low * power(ratio, k) for k in range(12)])


def short_box_sizes(n: int) -> list[int]:
    high = max(n // 4, 5)
    ratio = math.pow(high / 4.0, 1.0 / 9.0)
    return _steps(4, high, [4.0 * power(ratio, k) + 1e-9 for k in range(10)])


def spectrum_box_sizes(n: int) -> list[int]:
    low, high = max(16, n // 50), n // 4
    if low >= high:
        return []
    ratio = math.pow(high / low, 1.0 / 7.0)
    return _steps(low, high, [low * math.pow(ratio, float(k)) for k in range(8)])


def profiles(x: np.ndarray) -> np.ndarray:
    """Cumulative distances from the mean along the last axis."""
    return np.cumsum(x - x.mean(axis=-1, keepdims=True), axis=-1)


#: A residual under this share of the variation it is the rest of may be rounding: it is summed again, point by point.
REFINE = 1e-9


def _box_rss(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residual sums of squares of linear fits along the last axis, and which of them are more than rounding. Boxes hold the
    distances from a value within them, so that their moments lose no digits."""
    s = boxes.shape[-1]
    t = np.arange(s) - (s - 1) / 2
    total, slope = boxes @ np.ones(s), boxes @ t
    syy = np.einsum("...i,...i->...", boxes, boxes) - total * total / s
    rss = syy - slope * slope / (t @ t)
    return rss, rss > REFINE * syy


def _boxes_rss(y: np.ndarray, sizes: list[int], step: int) -> tuple[np.ndarray, np.ndarray]:
    """(residual sums of squares, which of them are more than rounding) of the boxes of all sizes that begin every `step`: (size, ...,
    place). What reaches over the end means nothing."""
    edge = np.concatenate([y, np.repeat(y[..., -1:], max(sizes) - min(sizes), axis=-1)], -1)
    w = windows(edge, max(sizes), step)
    shape, w = w.shape[:-1], (w - w[..., min(sizes) // 2, None]).reshape(-1, max(sizes))
    rss, sure = zip(*(_box_rss(w[:, :s]) for s in sizes))
    return np.stack(rss).reshape(-1, *shape), np.stack(sure).reshape(-1, *shape)


def box_rss(boxes: np.ndarray) -> np.ndarray:
    """Residual sums of squares of linear fits along the last axis."""
    s = boxes.shape[-1]
    t = np.arange(s) - (s - 1) / 2
    centred = boxes - boxes.mean(axis=-1, keepdims=True)
    slope = centred @ t
    syy = (centred * centred).sum(axis=-1)
    rss = syy - slope * slope / (t @ t)
    doubtful = rss <= REFINE * syy
    if doubtful.any():
        left = centred[doubtful] - (slope[doubtful] / (t @ t))[:, None] * t
        rss[doubtful] = (left * left).sum(axis=-1)
    return rss


def line(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slope and r2 of y (..., n) on x (n), over the points where w is 1."""
    w = np.ones_like(y) if w is None else w
    n = np.maximum(w.sum(-1, keepdims=True), 1)
    dx, dy = x - (w * x).sum(-1, keepdims=True) / n, y - (w * y).sum(-1, keepdims=True) / n
    sxx, sxy, syy = (w * dx * dx).sum(-1), (w * dx * dy).sum(-1), (w * dy * dy).sum(-1)
    slope = sxy / np.where(sxx > 0, sxx, 1)
    return slope, 1 - (syy - slope * sxy) / np.maximum(syy, 1e-15)


def _alphas(y: np.ndarray, sizes: list[int], both_ways: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, f2 = y.shape[-1], []
    for s in sizes:
        k = n // s
        rss = box_rss(y[..., : k * s].reshape(*y.shape[:-1], k, s)).mean(-1)
        if both_ways:
            rss = (rss + box_rss(y[..., n - k * s :].reshape(*y.shape[:-1], k, s)).mean(-1)) / 2
        f2.append(rss / s)
    f2 = np.stack(f2, -1)
    good = f2 > 1e-24 * (y * y).mean(-1, keepdims=True)
    slope, r2 = line(np.log(np.array(sizes, float)), np.where(good, np.log(np.sqrt(np.where(good, f2, 1))), 0), good.astype(float))
    return slope, r2, good.sum(-1)


def dfa(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, r2) of series along the last axis, all of one length; placeholder (0.5, 0)."""
    x = np.asarray(x, float)
    sizes = box_sizes(x.shape[-1])
    if x.shape[-1] < 64 or not sizes:
        return np.full(x.shape[:-1], 0.5), np.zeros(x.shape[:-1])
    slope, r2, pts = _alphas(profiles(x), sizes, False)
    return np.where(pts >= 3, slope, 0.5), np.where(pts >= 3, r2, 0.0)


def dfa_short(x: np.ndarray) -> tuple[float, float] | None:
    x = np.asarray(x, float)
    if len(x) < 16 or (x == x[0]).all():
        return None
    slope, r2, pts = _alphas(profiles(x), short_box_sizes(len(x)), True)
    return (float(slope), float(r2)) if pts >= 3 else None


def dfa_shorts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, r2) of short series along the last axis, all of one length of 16 or more; not a number where `dfa_short` has none."""
    slope, r2, pts = _alphas(profiles(x), short_box_sizes(x.shape[-1]), True)
    good = (pts >= 3) & (x != x[..., :1]).any(-1)
    return np.where(good, slope, np.nan), np.where(good, r2, np.nan)


def acr(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    if n < 20:
        return 0.0, 0.0
    d = x - x.mean()
    var = d @ d
    if flat(math.sqrt(var / n), x.mean()):
        return 0.0, 0.0
    points = [(math.log(k), math.log(r)) for k in LAGS if k < n // 2 and (r := float(d[:-k] @ d[k:]) / var) > 0.001]
    if len(points) < 3:
        return 0.0, 0.0
    a = np.array(points)
    slope, r2 = line(a[:, 0], a[:, 1])
    return float(slope), float(r2)


def flat(sd: float, mean: float) -> bool:
    return sd == 0 or sd <= 1e-12 * abs(mean)


def windows(x: np.ndarray, window: int, step: int) -> np.ndarray:
    """All full windows along the last axis, a view: (..., number, window)."""
    if x.shape[-1] < window:
        return np.zeros((*x.shape[:-1], 0, window))
    return np.lib.stride_tricks.sliding_window_view(x, window, axis=-1)[..., ::step, :]


def rolling_alpha(x: np.ndarray, window: int, step: int, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, r2) of each full window along the last axis; a thousand windows in memory at a time."""
    x = np.asarray(x, float)
    n = windows(x, window, step).shape[-2]
    if not n:
        return np.zeros((*x.shape[:-1], 0)), np.zeros((*x.shape[:-1], 0))
    parts = [_rolled(x[..., k * step : (min(k + at_once, n) - 1) * step + window], window, step) for k in range(0, n, at_once)]
    return np.concatenate([p[0] for p in parts], -1), np.concatenate([p[1] for p in parts], -1)


def _rolled(x: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """A box has the same residual in every window that it lies in, since a fit takes away what their means add to the
    profile: it is summed once. A box whose steps are all equal is a line and has none; a size that has only such boxes lies at the flat
    floor, unless all sizes do. Windows with another box whose residual may be rounding, or with lines alone, are done apart."""
    w, sizes = windows(x, window, step), box_sizes(window)
    if window < 64 or not sizes or not np.isfinite(x).all() or any(step > math.gcd(step, s) * (window // s) for s in sizes):  # windows share few boxes
        return dfa(w)
    y, many, every = profiles(x), w.shape[-2], math.gcd(step, *sizes)
    top = np.abs(y).max(-1, keepdims=True)
    f2, good = np.zeros((*w.shape[:-1], len(sizes))), np.zeros((*w.shape[:-1], len(sizes)), bool)
    plain = np.ones(w.shape[:-1], bool)
    all_rss, all_sure = _boxes_rss(y, sizes, every)
    place = np.arange(x.shape[-1])
    run = place - np.maximum.accumulate(np.where(np.diff(x, prepend=x[..., :1]) != 0, place, 0), axis=-1)  # equal values before each
    for i, s in enumerate(sizes):
        rss, total = all_rss[i], 0.0
        sure = all_sure[i] & (rss > s * (2e-7 * top) ** 2)
        some = not sure.all()
        if some:
            line_ = run[..., np.minimum(np.arange(rss.shape[-1]) * every + s - 1, x.shape[-1] - 1)] >= s - 2
            sure &= ~line_
            rss = np.where(line_, 0.0, rss)
        for k in range(window // s):  # the k-th boxes of all windows
            at = slice(k * s // every, (k * s + (many - 1) * step) // every + 1, step // every)
            total = total + rss[..., at]
            if some:
                plain &= (sure | line_)[..., at]
                good[..., i] |= sure[..., at]
        f2[..., i] = total / (window // s * s)
        if not some:
            good[..., i] = True
    plain &= good.any(-1)
    slope, r2 = line(np.log(np.array(sizes, float)), np.where(good, np.log(np.sqrt(np.where(good & (f2 > 0), f2, 1))), 0), good.astype(float))
    few = good.sum(-1) < 3
    slope, r2 = np.where(few, 0.5, slope), np.where(few, 0.0, r2)
    if not plain.all():
        apart = w[~plain]
        same = (apart == apart[:, :1]).all(-1)
        _, first, which = np.unique(apart[same, 0], return_index=True, return_inverse=True)
        for rows, found, back in ((~same, apart[~same], slice(None)), (same, apart[same][first], which)):  # equal windows once
            if rows.any():
                at = tuple(k[rows] for k in np.nonzero(~plain))
                a, b = dfa(found)
                slope[at], r2[at] = a[back], b[back]
    return slope, r2
