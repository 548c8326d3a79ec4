"""Detector legs without memory of alarms: thresholds, runs and persistence as window functions.

Inputs are score tables (asset_id, channel, tick, ...). Each returns the ticks at which the leg
would alarm; tidewright.operators.guard adds the latch, quarantine and re-learning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import ID, REPEAT_MARGIN, ROLL, by, said_of
from .prepare import islands

RES_SPAN, ROLL_PERSIST, MISS_HITS, MISS_SPAN = 20, 10, 4, 32


def twice_within(scores: DataFrame, threshold: DataFrame, leg: str, span: int = RES_SPAN) -> DataFrame:
    """Ticks of a score over its asset's threshold less than `span` after the hit before (residual and parity legs)."""
    hits = scores.join(threshold, "asset_id").where(F.abs("z") > F.col("threshold"))
    gap = F.col("tick") - F.lag("tick").over(by())
    return hits.withColumn("hit_gap", gap).where(F.col("hit_gap") < span).select(*ID, "tick", F.lit(leg).alias("leg"), F.abs("z").alias("observed"), "threshold", "hit_gap")


def leg_repeated(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Ticks at which a run of equal values is REPEAT_MARGIN longer than any healthy one, where the leg is on."""
    run = islands(df, ID, F.col("value") == F.lag("value").over(by()))
    length = F.row_number().over(Window.partitionBy(*ID, "island").orderBy("tick"))
    long = run.withColumn("observed", length).join(runs.where("repeat_enabled"), ID)
    return long.where(F.col("observed") >= F.col("max_run") + REPEAT_MARGIN).select(*ID, "tick", F.lit("repeated").alias("leg"), F.col("observed").cast("double").alias("observed"), (F.col("max_run") + REPEAT_MARGIN).cast("double").alias("threshold"))


def persistent(df: DataFrame, hit: Column, n: int, keys: list[str] = ID) -> DataFrame:
    """Rows at which `hit` has held for n rows at least; `run` is for how many."""
    marked = df.withColumn("_h", F.coalesce(hit, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("tick")
    runs = islands(marked, keys, F.col("_h") == F.lag("_h").over(w)).where("_h")
    return runs.withColumn("run", F.row_number().over(Window.partitionBy(*keys, "island").orderBy("tick"))).where(F.col("run") >= n).drop("_h", "island")


def leg_level_shift(df: DataFrame, mean: DataFrame, threshold: DataFrame) -> DataFrame:
    """Ticks at which the rolling mean has been off its channel's for ROLL_PERSIST ticks."""
    roll = df.withColumn("_r", F.avg("value").over(by().rowsBetween(-(ROLL - 1), 0))).where(F.col("tick") >= ROLL)
    dev = roll.join(mean, ID).join(threshold, ID).withColumn("observed", F.abs(F.col("_r") - F.col("mean")))
    out = persistent(dev, F.col("observed") > F.col("threshold"), ROLL_PERSIST)
    return out.select(*ID, "tick", F.lit("level_shift").alias("leg"), "observed", "threshold")


def leg_dfa(alphas: DataFrame, stats: DataFrame, threshold: DataFrame, n: int = 3) -> DataFrame:
    """Window ends (asset, channel, tick, alpha) at which the exponent has been off for n evaluations."""
    z = alphas.join(stats, ID).join(threshold, "asset_id").withColumn("observed", F.abs(F.col("alpha") - F.col("alpha_mean")) / F.col("alpha_sd"))
    return persistent(z, F.col("observed") > F.col("threshold"), n).select(*ID, "tick", F.lit("dfa").alias("leg"), "observed", "threshold")


def leg_cusum(path: DataFrame, threshold: DataFrame) -> DataFrame:
    top = F.greatest("pos", "neg")
    return path.join(threshold, "asset_id").where(top > F.col("threshold")).select(*ID, "tick", F.lit("cusum").alias("leg"), top.alias("observed"), "threshold")


def leg_missing(df: DataFrame) -> DataFrame:
    """Ticks of a missing sample that is the fourth in under 32 ticks."""
    bad = df.where(~F.col("valid"))
    far = F.col("tick") - F.lag("tick", MISS_HITS - 1).over(by())
    return bad.withColumn("_g", far).where(F.col("_g") < MISS_SPAN).select(*ID, "tick", F.lit("missing").alias("leg"), F.lit(float(MISS_HITS)).alias("observed"), F.lit(float(MISS_HITS)).alias("threshold"))


def window_statistic(name: str, v: str, window: int) -> Column:
    """One statistic of the last `window` values; null before there are so many."""
    w = by().rowsBetween(-(window - 1), 0)
    x = F.row_number().over(by()).cast("double")
    stat = {
        "mean": F.avg(v).over(w), "sd": F.stddev_pop(v).over(w), "max_abs": F.max(F.abs(v)).over(w), "range": F.max(v).over(w) - F.min(v).over(w),
        "slope": F.regr_slope(F.col(v), F.col("_x")).over(w),
    }[name]
    return F.when(x >= window, stat)


def leg_grid(df: DataFrame, baseline: int, genes: list[tuple[str, str, int, int]]) -> DataFrame:
    """Legs of a detector grammar (source raw/diff/residual column, statistic, window, persistence): per gene and
    channel the mean and deviation of the statistic on the first `baseline` ticks, and the alarms after it at
    z over 4, evaluated at every second tick."""
    base = df.withColumn("_x", F.col("tick").cast("double")).withColumn("raw", F.col("value")).withColumn("diff", F.coalesce(F.col("value") - F.lag("value").over(by()), F.lit(0.0)))
    parts = None
    for source, stat, window, persist in genes:
        s = base.withColumn("stat", window_statistic(stat, source, window)).where("stat IS NOT NULL AND tick % 2 = 0")
        cal = s.where(F.col("tick") < baseline).groupBy(*ID).agg(F.avg("stat").alias("_m"), F.greatest(F.stddev_pop("stat"), F.lit(1e-9)).alias("_s"))
        z = s.where(F.col("tick") >= baseline).join(cal, ID).withColumn("z", F.abs(F.col("stat") - F.col("_m")) / F.col("_s"))
        hit = persistent(z, F.col("z") > 4, persist).groupBy(*ID).agg(F.count("*").alias("alarms"), F.min("tick").alias("first"))
        one = hit.withColumn("gene", F.lit(f"{source}/{stat}/{window}/{persist}"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def dedupe_alarms(alarms: DataFrame, quiet: int = 50) -> DataFrame:
    """Drop an alarm whose channel and leg alarmed under `quiet` ticks before, whether or not that one was kept."""
    w = Window.partitionBy(*ID, "leg").orderBy("tick")
    gap = F.col("tick") - F.lag("tick").over(w)
    return alarms.withColumn("_g", gap).where(F.col("_g").isNull() | (F.col("_g") >= quiet)).drop("_g")


def ranked_value(df: DataFrame, keys: list[str], value: str, place: Column) -> DataFrame:
    """(keys, x): the value at a place (from 0) of each key's sorted values; `place` may use `_n`."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.select(*keys, F.col(value).alias("x"), F.row_number().over(w).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return ranked.where(F.col("_r") == place + 1).select(*keys, "x")


def limit_check(df: DataFrame, healthy: DataFrame, runs: int = 3) -> DataFrame:
    """Ticks at which a value has been further from the healthy median than 1.5 times the healthy distances'
    95th percentile (nearest rank) for three ticks."""
    median = ranked_value(healthy, ID, "value", F.expr("_n div 2")).withColumnRenamed("x", "median")
    dev = healthy.join(median, ID).withColumn("_d", F.abs(F.col("value") - F.col("median")))
    p95 = ranked_value(dev, ID, "_d", F.greatest(F.ceil(F.col("_n") * 0.95) - 1, F.lit(0))).withColumnRenamed("x", "p95")
    z = df.join(median, ID).join(p95, ID)
    return persistent(z, F.abs(F.col("value") - F.col("median")) > 1.5 * F.col("p95"), runs).select(*ID, "tick", F.lit("limit").alias("leg"))


def amplitude_threshold(df: DataFrame, healthy: DataFrame) -> DataFrame:
    """(asset, channel, limit, first): first tick over 1.5 times the healthy 95th percentile of |value|."""
    p = ranked_value(healthy.withColumn("_a", F.abs("value")), ID, "_a", F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1))
    limit = p.select(*ID, (1.5 * F.col("x")).alias("limit"))
    first = df.join(limit, ID).where(F.abs("value") > F.col("limit")).groupBy(*ID).agg(F.min("tick").alias("first"))
    return limit.join(first, ID, "left")


def sigma_threshold(df: DataFrame, healthy: DataFrame, k: float = 3.0) -> DataFrame:
    """(asset, channel, false_rate, first): share of healthy values beyond mean +- k sigma, first later tick beyond."""
    s = healthy.groupBy(*ID).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    out = lambda d: d.join(s, ID).withColumn("_o", F.abs(F.col("value") - F.col("_m")) > k * F.col("_s"))
    false = out(healthy).groupBy(*ID).agg((F.count_if("_o") / F.count("*")).alias("false_rate"))
    return false.join(out(df).where("_o").groupBy(*ID).agg(F.min("tick").alias("first")), ID, "left")


def first_alarm_per_leg(alarms: DataFrame) -> DataFrame:
    """(leg, alarms, firsts): alarms of each leg, and assets in which it was the first to alarm."""
    first = alarms.groupBy("asset_id").agg(F.min(F.struct("tick", "leg"))["leg"].alias("leg")).groupBy("leg").agg(F.count("*").alias("firsts"))
    return alarms.groupBy("leg").agg(F.count("*").alias("alarms")).join(first, "leg", "left").fillna({"firsts": 0})


def virtual_values(df: DataFrame, recon: DataFrame) -> DataFrame:
    """(asset, channel, tick, predicted, sd, r2): what a quarantined channel would read."""
    return said_of(df, recon).select(*ID, "tick", "predicted", "sd", "r2")
