"""Correlation structure of ordered series, as window sums, boxes and regressions.

A series table has key columns, `tick` from 0 without gaps and `value`, all finite. Everything
here is Spark's own operators; for many short series tidewright.operators.grouped does the same per
key in numpy.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import kernels, verdicts
from ..sources.shared import stored
from .prepare import assign_ticks, by_tick, sanitize

#: Lags of the autocorrelation fit.
LAGS = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


def powers(r: Column, n: int) -> list[Column]:
    """r**0 ... r**(n-1) by repeated squaring, low bit first."""
    squares = [r]
    while 2 ** len(squares) < n:
        squares.append(squares[-1] * squares[-1])
    return [reduce(lambda a, b: a * b, [s for k, s in enumerate(squares) if e >> k & 1], F.lit(1.0)) for e in range(n)]


@F.pandas_udf(ArrayType(LongType()))
def box_sizes(n: pd.Series) -> pd.Series:
    """Box sizes of a series of n values: 12 steps from max(16, n/50) to n/4, without repeats.

    They depend on the last bit of the ratio, which the JVM's power function rounds its own way; so
    this one small step runs in Python, on one row per series."""
    return n.map(kernels.box_sizes)


@F.pandas_udf(ArrayType(LongType()))
def spectrum_box_sizes(n: pd.Series) -> pd.Series:
    """Eight steps for the generalized exponents."""
    return n.map(kernels.spectrum_box_sizes)


def short_box_sizes(n: Column) -> Column:
    """Ten steps from 4 to max(n/4, 5)."""
    high = F.greatest(F.floor(n / 4), F.lit(5))
    ratio = F.pow(high / 4.0, F.lit(1.0 / 9.0))
    sizes = F.array_distinct(F.array(*[F.floor(p * 4.0 + 1e-9) for p in powers(ratio, 10)]))
    return F.filter(sizes, lambda s: (s >= 4) & (s <= high))


def profile(df: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """(keys, tick, n, d, y): the values' distances from their mean, and their cumulative sum.

    With `chunk`, a series is summed in pieces of so many ticks, and the pieces' totals are
    summed before them: a series of any length is spread over the cluster."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("_m"))
    moved = df.join(stats, keys).select(*keys, "tick", "n", (F.col("value") - F.col("_m")).alias("_d"))
    if chunk is None:
        return moved.select(*keys, "tick", "n", F.col("_d").alias("d"), F.sum("_d").over(by_tick(keys).rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
    piece = F.expr(f"tick div {chunk}")
    moved = moved.withColumn("_c", piece)
    totals = moved.groupBy(*keys, "_c").agg(F.sum("_d").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_c", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_o"))
    inner = F.sum("_d").over(Window.partitionBy(*keys, "_c").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn("_y", inner).join(offsets, [*keys, "_c"]).select(*keys, "tick", "n", F.col("_d").alias("d"), (F.col("_y") + F.col("_o")).alias("y"))


def residual(y: str, t: str) -> Column:
    """Residual sum of squares of a linear fit within a group."""
    syy, sxy, sxx = F.regr_syy(y, t), F.regr_sxy(y, t), F.regr_sxx(y, t)
    return F.greatest(syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))


def fitted(points: DataFrame, keys: list[str], x: str, y: str, *more: Column) -> DataFrame:
    """(keys, pts, slope, r2, more...) of y on x; r2 against a variation of at least 1e-15. Points without x or y do not count."""
    left = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    return points.groupBy(*keys).agg(F.count(F.when(F.col(y).isNotNull(), F.col(x))).alias("pts"), F.regr_slope(y, x).alias("slope"), (1 - left / F.greatest(F.regr_syy(y, x), F.lit(1e-15))).alias("r2"), *more)


def _squares(each: DataFrame, keys: list[str], within: str, exact: bool, *more: Column) -> DataFrame:
    """(keys, f2, doubtful, more...) of boxes: rows (keys, s, y, d, tick) -> mean squared residual of each group. `within`
    says whether a row's step from the one before lies in its box.

    One pass takes what the fit explains off the variation, which says nothing where next to nothing is left. Steps that are
    all equal make a line, with nothing left; other boxes of that kind are doubtful. The exact form sums each point's own
    residual in a second pass."""
    if not exact:
        step = F.when(F.expr(within), F.col("d"))
        rss = F.when(F.min(step) < F.max(step), residual("y", "tick")).otherwise(0.0)
        doubtful = (F.min(step) < F.max(step)) & (residual("y", "tick") <= kernels.REFINE * F.regr_syy("y", "tick"))
        return each.groupBy(*keys).agg((rss / F.first("s")).alias("f2"), doubtful.alias("doubtful"), *more)
    fit = each.groupBy(*keys).agg(F.avg("y").alias("_ym"), F.avg("tick").alias("_tm"), F.regr_slope("y", "tick").alias("_b"))
    left = F.col("y") - F.col("_ym") - F.col("_b") * (F.col("tick") - F.col("_tm"))
    return each.join(fit, keys).groupBy(*keys).agg((F.sum(left * left) / F.first("s")).alias("f2"), F.lit(False).alias("doubtful"), *more)


def _settled(df: DataFrame, keys: list[str], refine: bool, measure) -> DataFrame:
    """measure(df, exact) for every series: in one pass, and if asked to refine, again exactly for the series with a
    doubtful box. For that the first result is exchanged by an expression of the keys, so that it is computed once for both
    uses (an exchange by the keys themselves would be left out)."""
    if not refine:
        return measure(df, False).drop("doubtful")
    held = measure(df, False).repartition(F.xxhash64(*keys))
    columns = [c for c in held.columns if c not in (*keys, "doubtful")]
    # the whole row is unfolded, which keeps both uses of the exchange alike
    doubtful = held.select(F.inline(F.filter(F.array(F.struct(*held.columns)), lambda x: x["doubtful"]))).select(*keys).repartition(*keys)
    again = measure(df.join(doubtful, keys, "left_semi"), True).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return held.join(again, keys, "left").select(*keys, *[F.when(F.col("doubtful"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def _boxes(prof: DataFrame, df: DataFrame, keys: list[str], sizes, exact: bool = False) -> DataFrame:
    """(keys, s, box, f2, doubtful): mean squared residual of each box. sizes: of the number of values, once per series."""
    laid = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, sizes(F.col("_n")).alias("_sizes"))
    each = prof.join(laid, keys).select(*keys, "tick", "n", "d", "y", F.explode("_sizes").alias("s")).where("tick < s * (n div s)")
    return _squares(each.withColumn("box", F.expr("tick div s")), [*keys, "s", "box"], "tick % s > 0", exact)


def _exponent(sizes: DataFrame, floor: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pts, slope, r2, doubtful): fit of ln F on ln s over the sizes whose F2 is above the flat floor."""
    return _fit_of(sizes.join(floor, keys), keys)


def _fit_of(f2: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pts, slope, r2, doubtful) of rows (keys, s, f2, doubtful, _q): a size at the floor gives no point, but its
    doubt counts."""
    above = F.col("f2") > F.col("_q")
    x, y = F.when(above, F.ln("s")), F.when(above, F.ln(F.sqrt("f2")))
    return fitted(f2.select(*keys, x.alias("ls"), y.alias("lf"), "doubtful"), keys, "ls", "lf", F.bool_or("doubtful").alias("doubtful"))


def _floor(prof: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _q): the mean square of the profile under which a box is flat."""
    return prof.groupBy(*keys).agg((F.avg(F.col("y") * F.col("y")) * 1e-24).alias("_q"))


def dfa(df: DataFrame, keys: list[str], chunk: int | None = None, refine: bool = False) -> DataFrame:
    """(keys, n, alpha, r2): scaling exponent of each series.

    Under 64 values, or with under three usable box sizes, the placeholder 0.5 with r2 0. Without `chunk` a series is
    put in order once, and all that is known of it (number, mean, floor, boxes) comes from that one partitioning. Boxes
    within a run of equal values have no residual. What is left of boxes that are lines but for a 10^9th is summed point by
    point with `refine`, at twice the cost; without it, it is exact to about 10^-16 of the box's variation."""
    return _settled(df, keys, refine, lambda some, exact: _dfa(some, keys, chunk, exact))


def _dfa(df: DataFrame, keys: list[str], chunk: int | None, exact: bool) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    if chunk is None:
        whole = Window.partitionBy(*keys)
        moved = df.select(*keys, "tick", F.count("*").over(whole).alias("n"), (F.col("value") - F.avg("value").over(whole)).alias("_d"))
        summed = moved.select(*keys, "tick", "n", F.col("_d").alias("d"), F.sum("_d").over(by_tick(keys).rowsBetween(Window.unboundedPreceding, 0)).alias("y"))
        prof = summed.withColumn("_q", F.avg(F.col("y") * F.col("y")).over(whole) * 1e-24)
        laid = prof.join(sizes.select(*keys, box_sizes(F.col("n")).alias("_sizes")), keys)
        each = laid.select(*keys, "tick", "n", "d", "y", "_q", F.explode("_sizes").alias("s")).where("tick < s * (n div s)")
        boxes = _squares(each.withColumn("box", F.expr("tick div s")), [*keys, "s", "box"], "tick % s > 0", exact, F.first("_q").alias("_q"))
        fit = _fit_of(boxes.groupBy(*keys, "s").agg(F.avg("f2").alias("f2"), F.bool_or("doubtful").alias("doubtful"), F.first("_q").alias("_q")), keys)
    else:
        prof = profile(df, keys, chunk)
        fit = _exponent(_boxes(prof, df, keys, box_sizes, exact).groupBy(*keys, "s").agg(F.avg("f2").alias("f2"), F.bool_or("doubtful").alias("doubtful")), _floor(prof, keys), keys)
    good = (F.col("n") >= 64) & (F.coalesce("pts", F.lit(0)) >= 3)
    doubt = (F.col("n") >= 64) & F.coalesce("doubtful", F.lit(False))
    return sizes.join(fit, keys, "left").select(*keys, "n", F.when(good, F.col("slope")).otherwise(0.5).alias("alpha"), F.when(good, F.col("r2")).otherwise(0.0).alias("r2"), doubt.alias("doubtful"))


def dfa_short(df: DataFrame, keys: list[str], refine: bool = False) -> DataFrame:
    """(keys, n, alpha, r2) from small boxes laid from both ends; null under 16 values, for constant
    series and with under three usable sizes. `refine` as in dfa."""
    return _settled(df, keys, refine, lambda some, exact: _dfa_short(some, keys, exact))


def _dfa_short(df: DataFrame, keys: list[str], exact: bool) -> DataFrame:
    prof = profile(df, keys)
    each = prof.select(*keys, "tick", "n", "d", "y", F.explode(short_box_sizes(F.col("n"))).alias("s"))
    ways = each.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    at = F.when(F.col("way") == 0, F.col("tick")).otherwise(F.col("n") - 1 - F.col("tick"))
    boxed = _squares(ways.withColumn("_t", at).where("_t < s * (n div s)").withColumn("box", F.expr("_t div s")), [*keys, "s", "way", "box"], "_t % s <> CASE WHEN way = 0 THEN 0 ELSE s - 1 END", exact)
    f2 = boxed.groupBy(*keys, "s").agg(F.avg("f2").alias("f2"), F.bool_or("doubtful").alias("doubtful"))
    fit = _exponent(f2, _floor(prof, keys), keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("_a"), F.max("value").alias("_b"))
    long = (F.col("n") >= 16) & (F.col("_a") < F.col("_b"))
    good = long & (F.col("pts") >= 3)
    return sizes.join(fit, keys, "left").select(*keys, "n", F.when(good, F.col("slope")).alias("alpha"), F.when(good, F.col("r2")).alias("r2"), (long & F.coalesce("doubtful", F.lit(False))).alias("doubtful"))


def autocorrelations(df: DataFrame, keys: list[str], lags: tuple[int, ...]) -> DataFrame:
    """(keys, n, flat, lag, r): autocorrelation at each lag, over the whole series' mean and variation."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"))
    d = df.join(stats, keys).withColumn("_d", F.col("value") - F.col("_m"))
    w = by_tick(keys)
    led = d.select("*", *[F.lead("_d", k).over(w).alias(f"_l{k}") for k in lags])
    sums = led.groupBy(*keys, "n").agg(F.first("_m").alias("_m"), F.first("_sd").alias("_sd"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in lags])
    flat = (F.col("_sd") == 0) | (F.col("_sd") <= 1e-12 * F.abs("_m"))
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / F.nullif(F.col("_v"), F.lit(0.0))).alias("r")) for k in lags])).alias("x")
    return sums.select(*keys, "n", flat.alias("flat"), one).select(*keys, "n", "flat", "x.lag", "x.r")


def acr(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acr_alpha, acr_r2): decay of the autocorrelation; zeros if short, flat or with under three lags."""
    r = autocorrelations(df, keys, LAGS)
    # lags stop at the first that reaches half the length; they grow, so a plain filter does it
    points = r.where((F.col("n") >= 20) & ~F.col("flat") & (F.col("lag") < F.floor(F.col("n") / 2)) & (F.col("r") > 0.001))
    fit = fitted(points.select(*keys, F.ln("lag").alias("x"), F.ln("r").alias("y")), keys, "x", "y")
    good = F.coalesce("pts", F.lit(0)) >= 3
    return df.select(*keys).distinct().join(fit, keys, "left").select(*keys, F.when(good, F.col("slope")).otherwise(0.0).alias("acr_alpha"), F.when(good, F.col("r2")).otherwise(0.0).alias("acr_r2"))


def moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, mean, sd, kurtosis, p99, max); kurtosis is the plain fourth moment, p99 an order statistic."""
    order = Window.partitionBy(*keys).orderBy("value")
    ranked = df.select(*keys, "value", F.row_number().over(order).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    place = F.least(F.floor(F.col("_n") * 0.99), F.col("_n") - 1) + 1
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), (F.kurtosis("value") + 3).alias("kurtosis"),
        F.max(F.when(F.col("_r") == place, F.col("value"))).alias("p99"), F.max("value").alias("max"))


def analyze(df: DataFrame, keys: list[str]) -> DataFrame:
    """One structural law per series: moments, both exponents, hurst and quality."""
    good = sanitize(df, keys)
    law = moments(good, keys).join(dfa(good, keys).drop("n"), keys).join(acr(good, keys), keys)
    few = F.col("n") < 20
    flat = ~few & ((F.col("sd") == 0) | (F.col("sd") <= 1e-12 * F.abs("mean")))
    pick = lambda c, short, still: F.when(few, F.lit(short)).when(flat, still if isinstance(still, Column) else F.lit(still)).otherwise(F.col(c))
    law = law.select(
        *keys, "n", pick("mean", 0.0, F.col("mean")).alias("mean"), pick("sd", 0.0, 0.0).alias("sd"), pick("kurtosis", 0.0, 0.0).alias("kurtosis"),
        pick("p99", 0.0, F.col("mean")).alias("p99"), pick("max", 0.0, F.col("mean")).alias("max"), pick("alpha", 0.5, 0.5).alias("alpha"), pick("r2", 0.0, 0.0).alias("r2"),
        pick("acr_alpha", 0.0, 0.0).alias("acr_alpha"), pick("acr_r2", 0.0, 0.0).alias("acr_r2"), few.alias("_few"), flat.alias("_flat"))
    hurst = F.when(F.col("_few") | F.col("_flat"), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + F.col("acr_alpha") / 2)))
    words = F.when(F.col("_few"), "Insufficient").when(F.col("_flat"), "Abstain").otherwise(verdicts.quality(F.greatest("r2", "acr_r2")))
    return law.withColumn("hurst", hurst).withColumn("quality", words).drop("_few", "_flat")


def multifractal_points(df: DataFrame, keys: list[str], qs: tuple[float, ...], refine: bool = False) -> DataFrame:
    """(keys, q, h, r2): generalized exponents; (0.5, 0) with under three sizes. A box at the flat floor counts as 1e-30."""
    def run(some: DataFrame, exact: bool) -> DataFrame:
        """(keys, points, doubtful): all points of a series in one row."""
        prof = profile(some, keys)
        boxes = _boxes(prof, some, keys, spectrum_box_sizes, exact).join(_floor(prof, keys), keys)
        each = boxes.select(*keys, "s", "doubtful", F.when(F.col("f2") > F.greatest("_q", F.lit(1e-30)), F.col("f2")).otherwise(1e-30).alias("f2"), F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
        mean = F.avg(F.when(F.col("q") == 0, F.ln("f2") / 2).otherwise(F.pow("f2", F.col("q") / 2)))
        fq = each.groupBy(*keys, "q", "s").agg(mean.alias("_m"), F.bool_or("doubtful").alias("doubtful")).withColumn("fq", F.when(F.col("q") == 0, F.exp("_m")).otherwise(F.pow("_m", 1 / F.when(F.col("q") != 0, F.col("q")))))
        fit = fitted(fq.where("fq > 0").select(*keys, "q", F.ln("s").alias("x"), F.ln("fq").alias("y"), "doubtful"), [*keys, "q"], "x", "y", F.bool_or("doubtful").alias("doubtful"))
        return fit.groupBy(*keys).agg(F.collect_list(F.struct("q", "pts", "slope", "r2")).alias("points"), F.bool_or("doubtful").alias("doubtful"))

    fit = _settled(df, keys, refine, run).select(*keys, F.inline("points"))
    every = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    good = F.coalesce("pts", F.lit(0)) >= 3
    return every.join(fit, [*keys, "q"], "left").select(*keys, "q", F.when(good, F.col("slope")).otherwise(0.5).alias("h"), F.when(good, F.col("r2")).otherwise(0.0).alias("r2"))


def multifractal(df: DataFrame, keys: list[str], qs: tuple[float, ...] = (-3, -1, 0, 1, 2, 3)) -> DataFrame:
    """(keys, width, h2, reliable, multifractal) of the spectrum of generalized exponents."""
    sure = F.when(F.col("r2") > 0.5, F.col("h"))
    out = multifractal_points(df, keys, qs).groupBy(*keys).agg(F.count(sure).alias("reliable"), F.max(sure).alias("_b"), F.min(sure).alias("_a"), F.max(F.when(F.col("q") == 2, F.col("h"))).alias("_h2"))
    width = F.when(F.col("reliable") >= 2, F.col("_b") - F.col("_a")).otherwise(0.0)
    return out.select(*keys, width.alias("width"), F.coalesce("_h2", F.lit(0.5)).alias("h2"), "reliable", ((width > 0.05) & (F.col("reliable") >= 4)).alias("multifractal"))


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    law, mf = analyze(df, keys), multifractal(sanitize(df, keys), keys)
    return law.join(mf, keys).select(*keys, "n", "alpha", "r2", "hurst", "kurtosis", "width", "multifractal", verdicts.signal_class(F.col("alpha"), F.col("r2")).alias("signal"))


def _distance(pairs: DataFrame) -> DataFrame:
    """(a, b, distance, verdict) of rows with both fingerprints' measures under a_ and b_."""
    gap = {c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in MEASURES}
    dk = gap["kurtosis"] / F.greatest("a_kurtosis", "b_kurtosis", F.lit(1.0))
    d = F.sqrt(gap["alpha"] * gap["alpha"] + gap["width"] * gap["width"] + 0.1 * dk * dk + gap["hurst"] * gap["hurst"])
    out = pairs.select("a", "b", d.alias("distance"))
    return out.withColumn("verdict", verdicts.bands(F.col("distance"), [(0.05, "near-identical"), (0.2, "similar")], "different"))


MEASURES = ["alpha", "width", "kurtosis", "hurst"]


def _side(fps: DataFrame, key: str, side: str) -> DataFrame:
    return fps.select(F.col(key).alias(side), *[F.col(c).alias(f"{side}_{c}") for c in MEASURES])


def fingerprint_distances(fps: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """(a, b, distance, verdict): each fingerprint and the one that `others` holds under the same key."""
    a, b = _side(fps, key, "a"), _side(others, key, "b")
    return _distance(a.join(b, F.col("a") == F.col("b")))


def similar_fingerprints(fps: DataFrame, key: str, near: float, groups: int = 64) -> DataFrame:
    """(a, b, distance, verdict) of all pairs nearer than `near`: exponents, widths or hurst values apart by more rule a pair
    out, so pairs meet in cells of that width in all three; exponents alone lie too close to one another. Series that are alike
    lie in few cells, so one side of a cell is dealt to `groups` and the other meets each of them. The fingerprints are measured
    once for both sides."""
    fps = stored(fps.select(key, *MEASURES))
    a, b = _side(fps, key, "a"), _side(fps, key, "b")
    axes = ("alpha", "width", "hurst")
    left = a.withColumn("_g", F.pmod(F.xxhash64("a"), F.lit(groups)))
    right = b.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    for c in axes:
        at = F.floor(F.col(f"a_{c}") / near)
        left = left.withColumn(f"_{c}", F.explode(F.array(at - 1, at, at + 1)))
        right = right.withColumn(f"_{c}", F.floor(F.col(f"b_{c}") / near))
    cell = ["_g", *[f"_{c}" for c in axes]]
    pairs = left.join(right, cell).where("a < b").drop(*cell)
    return _distance(pairs).where(F.col("distance") < near)


def subsample_windows(df: DataFrame, keys: list[str], resamples: int) -> DataFrame:
    """Series of contiguous windows: keys and `_w`, ticks from 0."""
    k = max(resamples, 2)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    m = F.least(F.greatest(F.floor(F.col("_n") / 4), F.lit(64)), F.col("_n"))
    at = n.withColumn("_m", m).select(*keys, "_m", "_n", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_w"))
    at = at.withColumn("_from", F.when(F.col("_n") > F.col("_m"), F.expr(f"(_w * (_n - _m)) div {k - 1}")).otherwise(F.lit(0)))
    cut = df.join(at, keys).where("tick >= _from AND tick < _from + _m")
    return cut.select(*keys, "_w", (F.col("tick") - F.col("_from")).alias("tick"), "value")


def alpha_interval(df: DataFrame, keys: list[str], resamples: int = 20) -> DataFrame:
    """(keys, alpha, low, high, used, se): subsampling interval of the exponent."""
    some = dfa(subsample_windows(df, keys, resamples), [*keys, "_w"]).where("r2 > 0.3")
    spread = some.groupBy(*keys).agg(F.count("*").alias("used"), F.stddev_samp("alpha").alias("_sd"))
    se = F.when(F.coalesce("used", F.lit(0)) >= 2, F.col("_sd")).otherwise(0.0)
    out = dfa(df, keys).join(spread, keys, "left").withColumn("se", se)
    return out.select(*keys, "n", "alpha", (F.col("alpha") - 1.96 * F.col("se")).alias("low"), (F.col("alpha") + 1.96 * F.col("se")).alias("high"), F.coalesce("used", F.lit(0)).alias("used"), "se")


def halves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each series as two: `half` 0 (the first n/2 values) and 1, ticks from 0."""
    n = df.groupBy(*keys).agg(F.expr("count(*) div 2").alias("_h"))
    return df.join(n, keys).select(*keys, (F.col("tick") >= F.col("_h")).cast("int").alias("half"), F.when(F.col("tick") >= F.col("_h"), F.col("tick") - F.col("_h")).otherwise(F.col("tick")).alias("tick"), "value")


def split_half(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_alpha, second_alpha, difference, consistent)."""
    each = dfa(halves(df, keys), [*keys, "half"])
    out = each.groupBy(*keys).agg(F.max(F.when(F.col("half") == 0, F.col("alpha"))).alias("first_alpha"), F.max(F.when(F.col("half") == 1, F.col("alpha"))).alias("second_alpha"))
    out = out.withColumn("difference", F.abs(F.col("first_alpha") - F.col("second_alpha")))
    return out.withColumn("consistent", F.col("difference") < 0.1)


def compare(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of laws (analyze) -> shift, verdict, confidence, degraded, changed per key."""
    a = baseline.select(*keys, F.col("alpha").alias("alpha_before"), F.col("r2").alias("_ra"))
    b = current.select(*keys, F.col("alpha").alias("alpha_now"), F.col("r2").alias("_rb"))
    out = a.join(b, keys).withColumn("shift", F.col("alpha_now") - F.col("alpha_before")).withColumn("confidence", F.least("_ra", "_rb"))
    verdict = verdicts.health(F.col("shift"))
    return out.select(*keys, "alpha_before", "alpha_now", "shift", verdict.alias("verdict"), "confidence", (verdict != "Healthy").alias("degraded"), ((F.abs("shift") > 0.01) & (F.col("confidence") > 0.5)).alias("changed"))


def compare_significance(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """z of the change of exponents of two series tables, from subsampling errors; series of 256 values and more."""
    a, b = (alpha_interval(x, keys).where("n >= 256").select(*keys, F.col("alpha").alias(f"{s}_alpha"), F.col("se").alias(f"{s}_se")) for x, s in ((baseline, "a"), (current, "b")))
    both = a.join(b, keys)
    error = F.sqrt(F.col("a_se") * F.col("a_se") + F.col("b_se") * F.col("b_se"))
    z = F.when(error > 0, F.abs(F.col("b_alpha") - F.col("a_alpha")) / error)
    return both.select(*keys, (F.col("b_alpha") - F.col("a_alpha")).alias("shift"), z.alias("z"), F.when(z >= 3, "significant").otherwise("inconclusive").alias("finding"))


def alert(compared: DataFrame, threshold: float = 0.08) -> DataFrame:
    return compared.where(F.abs("shift") > threshold)


def prove_structure(df: DataFrame, shuffled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alpha, shuffled_alpha, confirmed): structure is order if shuffling brings the exponent nearer 0.5."""
    a, b = dfa(df, keys).select(*keys, "alpha"), dfa(shuffled, keys).select(*keys, F.col("alpha").alias("shuffled_alpha"))
    return a.join(b, keys).withColumn("confirmed", F.abs(F.col("shuffled_alpha") - 0.5) < F.abs(F.col("alpha") - 0.5))


def conformal(cal: DataFrame, scores: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Scores (keys, id, score) with p, anomalous and confidence, from calibration scores (keys, score).

    p = (number of calibration scores at least as large + 1) / (n + 1); 1 without calibration. One sort
    per key of both tables together, no pairs."""
    both = cal.select(*keys, F.lit(None).cast("long").alias("id"), "score", F.lit(1).alias("_c")).unionByName(scores.select(*keys, F.col("id").cast("long").alias("id"), "score", F.lit(0).alias("_c")))
    above = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0))
    counted = both.select("*", above.alias("_k"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n")).where("_c = 0")
    p = F.when(F.col("_n") == 0, 1.0).otherwise((F.col("_k") + 1) / (F.col("_n") + 1))
    return counted.select(*keys, "id", "score", p.alias("p"), (p < alpha).alias("anomalous"), (1 - p).alias("confidence"))


def conformal_threshold(cal: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("score")
    ranked = cal.select(*keys, "score", F.row_number().over(order).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return ranked.where(F.col("_r") == F.least(F.floor(F.col("_n") * (1 - alpha)), F.col("_n") - 1) + 1).select(*keys, F.col("score").alias("threshold"))


def time_to_threshold(df: DataFrame, keys: list[str], window: int, threshold: float) -> DataFrame:
    """(keys, eta, eta_low, eta_high, slope): ticks until the trend of the last `window` values meets the
    threshold; null if it moves away, or its slope is within its error."""
    if window < 8:
        raise ValueError("a trend needs 8 values at least")
    last = Window.partitionBy(*keys).orderBy(F.desc("tick"))
    cut = df.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= window).withColumn("_x", (window - F.col("_r")).cast("double"))
    fit = cut.groupBy(*keys).agg(F.count("*").alias("_n"), F.regr_slope("value", "_x").alias("b"), F.regr_intercept("value", "_x").alias("a"), residual("value", "_x").alias("_ss"), F.regr_sxx("value", "_x").alias("_sxx"))
    fit = fit.where(F.col("_n") == window).withColumn("_se", F.sqrt(F.col("_ss") / max(window - 2, 1) / F.greatest("_sxx", F.lit(1e-12))))
    fit = fit.withColumn("_left", threshold - (F.col("a") + F.col("b") * (window - 1)))
    ok = (F.abs("b") > F.col("_se")) & (F.signum("_left") == F.signum("b"))
    one, two = F.col("_left") / (F.col("b") + F.col("_se")), F.col("_left") / (F.col("b") - F.col("_se"))
    return fit.select(*keys, F.when(ok, F.col("_left") / F.col("b")).alias("eta"), F.when(ok, F.least(one, two)).alias("eta_low"), F.when(ok, F.greatest(one, two)).alias("eta_high"), F.col("b").alias("slope"))


