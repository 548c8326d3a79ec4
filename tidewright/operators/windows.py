"""Sliding and block-wise exponents, and the change points in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources.shared import stored
from .grouped import dfa_by_key
from .structure import autocorrelations, dfa, fitted

BLOCK = 1024
#: Ticks of a stretch that one task analyses.
CHUNK = 8192


def window_rows(df: DataFrame, keys: list[str], window: int, step: int) -> DataFrame:
    """Each row once for every full window that holds it: keys, `w` (its number), `tick` within it."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    last = F.expr(f"least(tick div {step}, (_n - {window}) div {step})")
    first = F.expr(f"greatest(0, (tick - {window} + {step}) div {step})")
    some = df.join(n, keys).where(F.col("_n") >= window).withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    each = some.select(*keys, "tick", "value", F.explode(F.sequence("_a", "_b")).alias("w"))
    return each.select(*keys, "w", (F.col("tick") - F.col("w") * step).alias("tick"), "value").where(f"tick BETWEEN 0 AND {window - 1}")


def rolling_alpha(df: DataFrame, keys: list[str], window: int, step: int) -> DataFrame:
    """(keys, w, end_tick, alpha, r2) of each full window, in Spark's own operators."""
    return dfa(window_rows(df, keys, window, step), [*keys, "w"]).select(*keys, "w", (F.col("w") * step + window - 1).alias("end_tick"), "alpha", "r2")


def rolling_alpha_fast(df: DataFrame, keys: list[str], window: int, step: int, chunk: int = CHUNK) -> DataFrame:
    """The same by a numpy kernel, for steps that would repeat each row very often. A series is cut into stretches of
    about `chunk` ticks that overlap by a window, so that no task holds a whole series; ticks run from 0 without gaps.
    A series shorter than the window gives no rows."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", w long, end_tick long, alpha double, r2 double"
    each = max(1, chunk // step)  # windows of a stretch
    span = each * step
    # a row belongs to the stretches whose windows begin at most window - 1 ticks before it
    first = F.expr(f"greatest(0, (tick - {window - 1} + {step - 1}) div {span})")
    placed = df.select(*keys, "tick", "value", F.explode(F.sequence(first, F.expr(f"tick div {span}"))).alias("_c"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("tick")["value"].to_numpy()
        alpha, r2 = kernels.rolling_alpha(x, window, step)
        alpha, r2, w = alpha[:each], r2[:each], key[-1] * each + np.arange(min(len(alpha), each))
        same = {k: pd.Series([v] * len(w), dtype=object) for k, v in zip(keys, key)}
        return pd.DataFrame({**same, "w": w, "end_tick": w * step + window - 1, "alpha": alpha, "r2": r2})

    return placed.groupBy(*keys, "_c").applyInPandas(run, schema)


def anomaly_scores(rolled: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, w, score): distance from the mean of the first third of windows (3 at least)."""
    n = rolled.groupBy(*keys).agg(F.count("*").alias("_n"))
    learn = F.least(F.greatest(F.expr("_n div 3"), F.lit(3)), F.col("_n"))
    base = rolled.join(n, keys).where(F.col("w") < learn).groupBy(*keys).agg(F.avg("alpha").alias("_b"), F.greatest(F.stddev_pop("alpha"), F.lit(0.1 * threshold)).alias("_s"))
    return rolled.join(base, keys).select(*keys, "w", (F.abs(F.col("alpha") - F.col("_b")) / (F.col("_s") + threshold)).alias("score"))


def row_scores(df: DataFrame, scores: DataFrame, keys: list[str], window: int, step: int) -> DataFrame:
    """(keys, tick, score): each row's largest score over all windows and channels that cover it; 0 where none does."""
    rows = scores.select(*keys, F.explode(F.sequence(F.col("w") * step, F.col("w") * step + window - 1)).alias("tick"), "score")
    cover = rows.groupBy(*keys, "tick").agg(F.max("score").alias("score"))
    return df.select(*keys, "tick").distinct().join(cover, [*keys, "tick"], "left").fillna({"score": 0.0})


def alpha_trend(rolled: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, used, slope, r2, direction, alpha_start, alpha_end) of the trusted windows' exponents."""
    sure = rolled.where("r2 > 0.3")
    i = (F.row_number().over(Window.partitionBy(*keys).orderBy("w")) - 1).cast("double")
    used = sure.withColumn("_i", i)
    fit = fitted(used, keys, "_i", "alpha")
    ends = used.groupBy(*keys).agg(F.min_by("alpha", "w").alias("alpha_start"), F.max_by("alpha", "w").alias("alpha_end"))
    out = rolled.select(*keys).distinct().join(fit, keys, "left").join(ends, keys, "left")
    ok = F.coalesce("pts", F.lit(0)) >= 3
    slope = F.when(ok, F.col("slope") / step).otherwise(0.0)
    word = F.when(F.abs(slope) < 0.0001, "Stable").when(slope < 0, "Degrading").otherwise("Improving")
    return out.select(*keys, F.coalesce("pts", F.lit(0)).alias("used"), slope.alias("slope"), F.when(ok, F.col("r2")).otherwise(0.0).alias("r2"), word.alias("direction"), F.coalesce("alpha_start", F.lit(0.5)).alias("alpha_start"), F.coalesce("alpha_end", F.lit(0.5)).alias("alpha_end"))


def block_alphas(df: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, block, alpha, r2) of full blocks with r2 over 0.3. A series of any length: blocks are keys, and a block is
    an array of `block` values at most."""
    cut = df.select(*keys, F.expr(f"tick div {block}").alias("block"), F.expr(f"tick % {block}").alias("tick"), "value")
    return dfa_by_key(cut, [*keys, "block"]).where(f"n = {block} AND r2 > 0.3").drop("n")


def find_changepoint(blocks: DataFrame, keys: list[str], min_segment: int = 3 * BLOCK, block: int = BLOCK) -> DataFrame:
    """(keys, location, z, before, after): the best split of the block exponents into two means, if z > 4.

    sigma is the median step over 0.6745 sqrt 2, 0.02 at least; splits leave max(3, segment/block)
    blocks on each side and differ by 0.1 at least; the earliest of equals wins."""
    w = Window.partitionBy(*keys).orderBy("block")
    whole = Window.partitionBy(*keys)
    b = blocks.select(*keys, "block", "alpha", F.abs(F.col("alpha") - F.lag("alpha").over(w)).alias("_d"), F.row_number().over(w).alias("_l"), F.count("*").over(whole).alias("_n"), F.sum("alpha").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_s"), F.sum("alpha").over(whole).alias("_t"), F.lead("block").over(w).alias("_next"))
    sigma = b.groupBy(*keys).agg(F.greatest(F.expr("median(_d)") / 0.6745 / (2**0.5), F.lit(0.02)).alias("_sg"))
    least = max(3, -(-min_segment // block))
    left, right = F.col("_s") / F.col("_l"), (F.col("_t") - F.col("_s")) / (F.col("_n") - F.col("_l"))
    cut = b.join(sigma, keys).where((F.col("_l") >= least) & (F.col("_n") - F.col("_l") >= least)).withColumn("before", left).withColumn("after", right)
    z = F.abs(F.col("after") - F.col("before")) / (F.col("_sg") * F.sqrt(1 / F.col("_l") + 1 / (F.col("_n") - F.col("_l"))))
    good = cut.withColumn("z", z).where((F.abs(F.col("after") - F.col("before")) >= 0.10) & (F.col("z") > 4))
    best = good.groupBy(*keys).agg(F.max(F.struct("z", -F.col("_l"), (F.col("_next") * block).alias("location"), "before", "after")).alias("x"))
    return best.select(*keys, "x.location", "x.z", "x.before", "x.after")


def find_changepoints(blocks: DataFrame, keys: list[str], min_segment: int = 3 * BLOCK, max_points: int = 10, block: int = BLOCK) -> DataFrame:
    """(keys, location, z, before, after): binary splitting, left part first, until nothing splits or `max_points` are found.

    All open segments of all series are split at once, round by round; a segment is named by its way down (0 left, 1 right), whose
    order is that of a search that goes left first. A segment that comes after `max_points` cuts of its series is not read
    again: its cuts would come after them too. A cut has one cut before it a level above it, so there are `max_points` rounds at
    most, however many cuts a series would have without the cap. A round is windows over what is left of the block table by
    series and segment; a series that splits no more is not read again."""
    by = [*keys, "_seg"]
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_seg"))
    open_ = stored(blocks.select(*keys, "block", "alpha", F.lit("").alias("_seg")))
    found = None
    while True:
        cut = stored(find_changepoint(open_, by, min_segment, block))
        if not cut.limit(1).count():
            break
        every = cut if found is None else found.unionByName(cut)
        found = stored(every.withColumn("_r", order).where(F.col("_r") <= max_points).drop("_r"))
        full = found.groupBy(*keys).agg(F.max("_seg").alias("_last"), F.count("*").alias("_found")).where(F.col("_found") == max_points).drop("_found")
        side = F.concat("_seg", F.when(F.col("block") * block < F.col("location"), "0").otherwise("1"))
        parts = open_.join(cut.select(*by, "location"), by).select(*keys, "block", "alpha", side.alias("_seg")).join(full, keys, "left")
        open_ = stored(parts.where("_last IS NULL OR _seg < _last").drop("_last"))
    return (cut if found is None else found).select(*keys, "location", "z", "before", "after")


def score_changepoints(points: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Points with in_truth: inside one of the true intervals [start, end] of their key."""
    p = points.select(*keys, "location").distinct()
    hit = p.join(truth, [p[k] == truth[k] for k in keys] + [p["location"].between(truth["start"], truth["end"])], "left_semi").withColumn("_h", F.lit(True))
    return points.join(hit, [*keys, "location"], "left").withColumn("in_truth", F.coalesce("_h", F.lit(False))).drop("_h")


def shared_changepoints(points: DataFrame, asset: str, channel: str, block: int = BLOCK) -> DataFrame:
    """(asset, start, end, channels): points within one block of the one before, of two channels at least."""
    w = Window.partitionBy(asset).orderBy("location", channel)
    new = F.coalesce((F.col("location") - F.lag("location").over(w) > block).cast("int"), F.lit(1))
    g = points.withColumn("_g", new)
    g = g.withColumn("_i", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = g.groupBy(asset, "_i").agg(F.min("location").alias("start"), F.max("location").alias("end"), F.count_distinct(channel).alias("channels"))
    return out.where("channels >= 2").drop("_i")


def autocorr_at_lag(df: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """(keys, r): autocorrelation at one lag; null for short or constant series."""
    r = autocorrelations(df, keys, (lag,))
    return r.select(*keys, F.when((F.col("n") > lag) & ~F.col("flat"), F.col("r")).alias("r"))
