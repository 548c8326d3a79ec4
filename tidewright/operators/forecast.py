"""Forecast residuals: autoregression, smoothed errors, thresholds, sequences and their pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import stored
from . import ranks, recursions, windows
from .prepare import by_tick, islands

ORDERS, RIDGE, LOCAL, LEAST = (3, 5, 10, 25, 50), 1e-4, 2100, 200
#: Ticks of a band in which sequences and ticks meet.
BAND = 4096


def fit_ar(train: np.ndarray, p: int) -> tuple[np.ndarray, float] | None:
    """(weights, bias) of a ridge autoregression on standardized values; None for a short series."""
    n = len(train)
    if n < 3 * p + 10:
        return None
    m, s = train.mean(), max(train.std(), 1e-9)
    z = (train - m) / s
    lags = np.lib.stride_tricks.sliding_window_view(z, p)[:-1, ::-1]
    w = np.linalg.solve(lags.T @ lags + RIDGE * (n - p) * np.eye(p), lags.T @ z[p:])
    return w, m * (1 - w.sum())


def residuals(x: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    p, out = len(w), np.zeros(len(x))
    if len(x) > p:
        out[p:] = np.abs(x[p:] - (bias + np.lib.stride_tricks.sliding_window_view(x, p)[:-1, ::-1] @ w))
    return out


def select_order(train: np.ndarray) -> int:
    """The order whose fit on the first four fifths forecasts the last fifth best."""
    cut, best = len(train) * 4 // 5, (np.inf, 5)
    for p in ORDERS:
        fit = fit_ar(train[:cut], p)
        if fit is not None:
            r = residuals(train[cut:], *fit)
            mse = float((r[p:] ** 2).sum()) / max(1, len(r))
            if mse < best[0]:
                best = (mse, p)
    return best[1]


def smoothed(x: np.ndarray, span: int) -> np.ndarray:
    """Exponentially weighted mean with the first value as its start."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def trailing_variance(x: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros(len(x))
    if len(x) > w:
        out[w:] = np.lib.stride_tricks.sliding_window_view(x, w)[1:].var(axis=1)
    return out


def epsilon(e: np.ndarray, z_min: float = 2.5) -> float:
    mean, sd = float(e.mean()), max(float(e.std()), 1e-12)
    best = (-np.inf, mean + 12 * sd)
    for z in np.arange(z_min, 12.0 + 1e-9, 0.5):
        eps = mean + z * sd
        above = e >= eps
        k = int(above.sum())
        if k:
            below = e[~above]
            runs = int((above & ~np.r_[False, above[:-1]]).sum())
            score = ((mean - below.mean()) / mean + (sd - below.std()) / sd) / (k + runs * runs)
            score = round(score, 9)  # equal candidates must tie, whatever the order of their sums
            if score > best[0]:
                best = (score, eps)
    return best[1]


def sequences(e: np.ndarray, eps: float, buffer: int) -> list[tuple[int, int]]:
    above = np.r_[False, e >= eps, False]
    edge = np.flatnonzero(above[1:] != above[:-1])
    n = len(e)
    return merged([(max(s - buffer, 0), n - 1 if t == n else min(t - 1 + buffer, n - 1)) for s, t in zip(edge[::2], edge[1::2])])


def merged(seqs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, t in seqs:
        if out and s <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], t))
        else:
            out.append((int(s), int(t)))
    return out


def pruned(e: np.ndarray, seqs: list[tuple[int, int]], share: float) -> list[tuple[int, int]]:
    """Sequences in falling order of their largest error, up to the first whose drop to the next is under `share`."""
    if not seqs:
        return []
    ranked = sorted(((float(e[s : t + 1].max()), (s, t)) for s, t in seqs), key=lambda x: -x[0])
    outside = np.ones(len(e), bool)
    for s, t in seqs:
        outside[s : t + 1] = False
    tops = [m for m, _ in ranked] + [float(e[outside].max(initial=0.0))]
    keep = len(ranked)
    for i in range(len(ranked)):
        if (tops[i] - tops[i + 1]) / tops[i] < share if tops[i] > 1e-12 else True:
            keep = i
            break
    return sorted(st for _, st in ranked[:keep])


def detect(train: np.ndarray, test: np.ndarray, p: int = 0, z_min: float = 2.5, share: float = 0.13, buffer: int = 50) -> list[tuple[int, int]]:
    p = p or select_order(train)
    fit = fit_ar(train, p)
    if fit is None or len(test) <= p:
        return []
    span = min(max(len(test) // 30, 10), 300)
    width = max(span, 20)
    r, tr = residuals(test, *fit), residuals(train, *fit)
    known = smoothed(trailing_variance(tr, width), span)[p:]
    mean, sd = known.mean(), max(known.std(), 1e-12)
    boost = np.maximum((smoothed(trailing_variance(r, width), span) - mean) / sd, 0) * sd * 0.3
    e = smoothed(r, span) + boost
    order = np.sort(e[p:])
    med = order[len(order) // 2]
    floor = med + 3 * 1.4826 * np.sort(np.abs(order - med))[len(order) // 2]
    found = sequences(e, epsilon(e[p:], z_min), buffer)
    for at in range(p, len(e), LOCAL):
        part = e[at : at + LOCAL]
        if len(part) >= LEAST:
            found += [(at + s, min(at + t, len(e) - 1)) for s, t in sequences(part, max(epsilon(part, z_min), floor), buffer)]
    return pruned(e, merged(sorted(found)), share)


def detect_alpha(train: np.ndarray, test: np.ndarray, window: int = 96, z_min: float = 2.5, buffer: int = 50) -> list[tuple[int, int]]:
    if len(train) < 3 * window or len(test) < window:
        return []
    a, b = kernels.rolling_alpha(train, window, 8)[0], kernels.rolling_alpha(test, window, 8)[0]
    z = np.abs(b - a.mean()) / max(a.std(), 1e-6)
    found = pruned(z, sequences(z, epsilon(z, max(z_min, 4.0)), buffer // 8), 0.13)
    return [(s * 8, min(t * 8 + window - 1, len(test) - 1)) for s, t in found]


def ar_models(train: DataFrame, keys: list[str], p: int = 0, chunk: int = recursions.CHUNK, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """(keys, p, bias, weights) per channel; p 0 selects the one of `orders`. Channels too short for it give no row. Blocks of a
    channel add up its normal equations, so that no task holds it whole; ticks run from 0 without gaps."""
    if p:
        return recursions.normal_equations(train, keys, [p], RIDGE, chunk).select(*keys, "p", "bias", "weights")
    chosen = recursions.best_order(train, keys, orders, RIDGE, 5, chunk)
    return recursions.normal_equations(train, keys, orders, RIDGE, chunk).join(chosen, [*keys, "p"]).select(*keys, "p", "bias", "weights")


def ar_residuals(df: DataFrame, models: DataFrame, keys: list[str], p: int) -> DataFrame:
    """(keys, tick, e): |x - forecast| by p lags; the first p are 0."""
    w = by_tick(keys)
    lags = F.array(*[F.lag("value", k).over(w) for k in range(1, p + 1)])
    d = df.withColumn("_l", lags).join(models, keys)
    said = F.aggregate(F.zip_with("_l", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.col("bias")
    return d.select(*keys, "tick", F.when(F.col("tick") < p, 0.0).otherwise(F.abs(F.col("value") - said)).alias("e"))


def ewma(df: DataFrame, keys: list[str], span: int, value: str = "e", chunk: int = recursions.CHUNK) -> DataFrame:
    """(keys, tick, e): exponentially weighted means from the first value on, in blocks of ticks."""
    return recursions.smoothed(df, keys, value, 2 / (span + 1), chunk=chunk).withColumnRenamed("y", "e")


def rolling_variance(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    v = F.var_pop("value").over(by_tick(keys).rowsBetween(-(width - 1), 0))
    return df.select(*keys, "tick", F.when(F.col("tick") < width, 0.0).otherwise(v).alias("variance"))


def find_epsilon(errors: DataFrame, keys: list[str], z_min: float = 2.5) -> DataFrame:
    """(keys, eps): the grid is exploded, every candidate is one group of conditional aggregates. Scores that agree
    in nine decimals tie, and the least z wins."""
    stats = errors.groupBy(*keys).agg(F.avg("e").alias("_m"), F.greatest(F.stddev_pop("e"), F.lit(1e-12)).alias("_s"))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int((12 - z_min) / 0.5))), lambda i: F.lit(z_min) + i * 0.5)).alias("z")
    d = errors.withColumn("_p", F.lag("e").over(by_tick(keys))).join(stats, keys).select(*keys, "e", "_p", "_m", "_s", grid).withColumn("eps", F.col("_m") + F.col("z") * F.col("_s"))
    above, under = F.col("e") >= F.col("eps"), F.when(F.col("e") < F.col("eps"), F.col("e"))
    g = d.groupBy(*keys, "z", "eps", "_m", "_s").agg(F.count_if(above).alias("_k"), F.count_if(above & (F.col("_p").isNull() | (F.col("_p") < F.col("eps")))).alias("_r"), F.avg(under).alias("bm"), F.stddev_pop(under).alias("bs"))
    score = ((F.col("_m") - F.col("bm")) / F.nullif("_m", F.lit(0.0)) + (F.col("_s") - F.col("bs")) / F.col("_s")) / F.nullif(F.col("_k") + F.col("_r") * F.col("_r"), F.lit(0))
    best = g.where("_k > 0").withColumn("score", F.round(score, 9)).groupBy(*keys).agg(F.max(F.struct("score", -F.col("z"), "eps"))["eps"].alias("eps"))
    return stats.join(best, keys, "left").select(*keys, F.coalesce("eps", F.col("_m") + 12 * F.col("_s")).alias("eps"))


def anomaly_sequences(errors: DataFrame, eps: DataFrame, keys: list[str], buffer: int = 50) -> DataFrame:
    """(keys, start, end): runs of ticks over eps, widened (a run open at the end is not), merged where they touch. Only what
    lies over eps is put in order."""
    n = errors.groupBy(*keys).agg(F.max("tick").alias("_last"))
    e = errors.join(eps, keys).where(F.col("e") >= F.col("eps")).select(*keys, "tick")
    runs = islands(e, keys, F.col("tick") == F.lag("tick").over(by_tick(keys)) + 1).groupBy(*keys, "island").agg(F.min("tick").alias("s"), F.max("tick").alias("t")).join(n, keys)
    return merge_ranges(runs.select(*keys, F.greatest(F.col("s") - buffer, F.lit(0)).alias("start"), F.when(F.col("t") == F.col("_last"), F.col("t")).otherwise(F.least(F.col("t") + buffer, F.col("_last"))).alias("end")), keys)


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): ranges that overlap or touch are one."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col("start") > far + 1), 1).otherwise(0)
    g = ranges.select(*keys, "start", "end").withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def prune_sequences(errors: DataFrame, seqs: DataFrame, keys: list[str], share: float = 0.13) -> DataFrame:
    """(keys, start, end, top) that stay: a first drop under `share` cuts all from there on. Sequences do not overlap; they meet
    the ticks within bands."""
    band = lambda c: F.floor(F.col(c) / BAND)
    spread = seqs.select(*keys, "start", "end", F.explode(F.sequence(band("start"), band("end"))).alias("_band"))
    e = errors.select(*keys, "tick", "e", band("tick").alias("_band")).alias("e")
    met = [F.col(f"e.{k}") == F.col(f"q.{k}") for k in [*keys, "_band"]] + [F.col("tick").between(F.col("start"), F.col("end"))]
    tops = e.join(spread.alias("q"), met, "left").groupBy(*[F.col(f"e.{k}").alias(k) for k in keys], "start", "end").agg(F.max("e.e").alias("top"))
    w = Window.partitionBy(*keys).orderBy(F.desc("top"), "start")
    r = tops.withColumn("_out", F.max(F.when(F.col("start").isNull(), F.col("top"))).over(Window.partitionBy(*keys))).where("start IS NOT NULL")
    r = r.withColumn("_next", F.coalesce(F.lead("top").over(w), F.greatest("_out", F.lit(0.0)), F.lit(0.0)))
    drop = F.when(F.col("top") > 1e-12, (F.col("top") - F.col("_next")) / F.nullif("top", F.lit(0.0))).otherwise(0.0)
    low = F.max((drop < share).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_cut", low).where("_cut = 0").select(*keys, "start", "end", "top")


def smoothed_errors(train: DataFrame, test: DataFrame, keys: list[str], p: int = 0, chunk: int = recursions.CHUNK) -> DataFrame:
    """(keys, p, tick, e) of test: weighted means of the forecast errors, raised where the variance of the last ones stands out
    from that of train. The model, its order (p 0) and the deviations come from train. Channels too short give no rows."""
    by, span = [*keys, "_test"], F.least(F.greatest(F.expr("_n div 30"), F.lit(10)), F.lit(300))
    parts = [d.select(*keys, F.lit(k).alias("_test"), F.col("tick").cast("long").alias("tick"), F.col("value").cast("double").alias("value")) for k, d in enumerate((train, test))]
    both = stored(parts[0].unionByName(parts[1]))  # read six times
    sizes = both.where("_test = 1").groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, "_n", span.alias("_span"))
    models = ar_models(both.where("_test = 0").drop("_test"), keys, p, chunk).join(sizes, keys).where("_n > p")
    models = stored(models.select(*keys, "p", "bias", "weights", F.greatest("_span", F.lit(20)).alias("width"), (2 / (F.col("_span") + 1)).alias("_gain")))
    raw = recursions.forecast_errors(both, models, by, keys, max([p, *ORDERS]) + 300, chunk).join(models.select(*keys, "_gain"), keys)
    even = stored(recursions.smoothed(raw, by, ["e", "variance"], "_gain", chunk=chunk).join(models.select(*keys, "p"), keys))
    known = even.where("_test = 0 AND tick >= p").groupBy(*keys).agg(F.avg("variance").alias("_m"), F.greatest(F.stddev_pop("variance"), F.lit(1e-12)).alias("_s"))
    boost = F.greatest((F.col("variance") - F.col("_m")) / F.col("_s"), F.lit(0.0)) * F.col("_s") * 0.3
    return even.where("_test = 1").join(known, keys).select(*keys, "p", "tick", (F.col("e") + boost).alias("e"))


def detect_forecast_anomalies(train: DataFrame, test: DataFrame, keys: list[str], p: int = 0, z_min: float = 2.5, share: float = 0.13, buffer: int = 50, chunk: int = recursions.CHUNK) -> DataFrame:
    """(keys, start, end) in rows of test: sequences of smoothed forecast errors over the threshold of the whole channel, or over that of
    their LOCAL ticks and a robust floor (the middle error and three deviations), that pruning leaves.

    Ticks of both tables run from 0 without gaps. Models, errors, means and thresholds are made in blocks of a channel; what is put in
    order for a whole channel is its errors' runs. Channels without a model, or with no more test values than its order, give none.
    """
    errors = stored(smoothed_errors(train, test, keys, p, chunk))
    late = errors.where("tick >= p")
    med = ranks.nth_smallest(late, keys, "e", "n div 2").withColumnRenamed("e", "_med")
    off = late.join(med, keys).select(*keys, F.abs(F.col("e") - F.col("_med")).alias("_mad"))
    floor = med.join(ranks.nth_smallest(off, keys, "_mad", "n div 2"), keys).select(*keys, (F.col("_med") + 3 * 1.4826 * F.col("_mad")).alias("_floor"))
    whole = anomaly_sequences(errors, find_epsilon(late, keys, z_min), keys, buffer)
    part = [*keys, "_part"]
    cut = late.select(*keys, "p", F.expr(f"(tick - p) div {LOCAL}").alias("_part"), F.expr(f"(tick - p) % {LOCAL}").alias("tick"), "e")
    sizes = cut.groupBy(*part, "p").count().where(F.col("count") >= LEAST).select(*part, "p")
    local = cut.join(sizes.drop("p"), part).select(*part, "tick", "e")
    eps = find_epsilon(local, part, z_min).join(floor, keys).select(*part, F.greatest("eps", "_floor").alias("eps"))
    begin = F.col("p") + F.col("_part") * LOCAL
    near = anomaly_sequences(local, eps, part, buffer).join(sizes, part).select(*keys, (F.col("start") + begin).alias("start"), (F.col("end") + begin).alias("end"))
    found = stored(merge_ranges(whole.unionByName(near), keys))
    return prune_sequences(errors, found, keys, share).select(*keys, "start", "end")


def detect_alpha_anomalies(train: DataFrame, test: DataFrame, keys: list[str], window: int = 96, step: int = 8, z_min: float = 4.0, buffer: int = 50, share: float = 0.13) -> DataFrame:
    """(keys, start, end) in rows of test: sequences of its trailing exponents, every `step` ticks, far from the mean of train's in their
    deviations. Series with a train of under 3 windows, or a test of under one, give none. Exponents are measured in stretches, all else is
    windows over one row an exponent."""
    long = train.groupBy(*keys).count().where(F.col("count") >= 3 * window).select(*keys)
    known = windows.rolling_alpha_fast(train.join(long, keys, "left_semi"), keys, window, step).groupBy(*keys).agg(F.avg("alpha").alias("_m"), F.greatest(F.stddev_pop("alpha"), F.lit(1e-6)).alias("_s"))
    z = windows.rolling_alpha_fast(test, keys, window, step).join(known, keys).select(*keys, F.col("w").alias("tick"), (F.abs(F.col("alpha") - F.col("_m")) / F.col("_s")).alias("e"))
    found = anomaly_sequences(z, find_epsilon(z, keys, z_min), keys, buffer // step)
    kept = prune_sequences(z, found, keys, share).join(test.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    return kept.select(*keys, (F.col("start") * step).alias("start"), F.least(F.col("end") * step + window - 1, F.col("_n") - 1).alias("end"))
