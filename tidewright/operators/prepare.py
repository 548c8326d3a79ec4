"""Series in order: ticks, gaps, splits, intervals, labels.

A series table has key columns, `tick` (its place, from 0) and `value`. The order of a series is
its meaning, so every function that orders takes the full order with tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def assign_ticks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("tick", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def by_tick(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("tick")


def sanitize(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop values that are not finite and close the gaps."""
    return assign_ticks(df.where(finite(F.col("value"))), keys, ["tick"])


def validity(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", finite(F.col("value")))


def fill_gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Forward fill; a leading gap takes the first valid value, a series without any is 0."""
    good = F.when(finite(F.col("value")), F.col("value"))
    before = F.last(good, ignorenulls=True).over(by_tick(keys).rowsBetween(Window.unboundedPreceding, 0))
    # only a leading gap looks ahead, and then to the first valid value of all: one pass, no growing frames
    after = F.first(good, ignorenulls=True).over(by_tick(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("value", F.coalesce(before, after, F.lit(0.0)))


def impute_calibration(df: DataFrame, keys: list[str], baseline: int, most: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Calibration samples that are not finite become the mean of the finite ones of their channel.
    Second: per channel the number imputed and whether it is rejected (none finite, or over `most` imputed)."""
    part = df.where(F.col("tick") < baseline)
    stats = part.groupBy(*keys).agg(F.avg(F.when(finite(F.col("value")), F.col("value"))).alias("mean"), F.count_if(~finite(F.col("value"))).alias("imputed"), F.count("*").alias("n"))
    stats = stats.withColumn("rejected", F.col("mean").isNull() | (F.col("imputed") > most * F.col("n")))
    filled = df.join(stats.select(*keys, "mean"), keys, "left")
    value = F.when((F.col("tick") < baseline) & ~finite(F.col("value")), F.col("mean")).otherwise(F.col("value"))
    return filled.select(*keys, "tick", value.alias("value")), stats


def data_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    bad, n = F.count_if(~finite(F.col("value"))), F.count("value")
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), bad.alias("bad"), (F.count("*") - bad).alias("good"))
    ready = F.when(F.col("good") == 0, "FAIL empty").when(F.col("good") < 20, "WARN <20").when(F.col("good") < 64, "WARN <64").otherwise("OK")
    return out.select(*keys, "n", "bad", (100.0 * F.col("bad") / F.col("n")).alias("bad_pct"), ready.alias("readiness"))


def calibration_length(n: Column, rule: str = "default") -> Column:
    """Ticks of the healthy prefix by one of three rules."""
    if rule == "default":
        return F.least(n, F.greatest(F.least(F.floor(n / 3), F.lit(100_000)), F.lit(192)))
    if rule == "evaluation":
        return F.greatest(F.least(F.greatest(F.round(n * 0.15).cast("long"), F.lit(768)), n - 1), F.lit(192))
    return F.least(F.floor(n * 0.3), F.lit(5000))


def calibration_split(df: DataFrame, keys: list[str], rule: str = "default") -> DataFrame:
    """Adds `calibration`: the tick lies in its series' healthy prefix."""
    sizes = df.groupBy(*keys).agg(calibration_length(F.count("*"), rule).alias("_n"))
    return df.join(sizes, keys).withColumn("calibration", F.col("tick") < F.col("_n")).drop("_n")


def islands(df: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """Adds `island`: a number that stays while `same` holds from row to row."""
    step = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_step", step).withColumn("island", F.sum("_step").over(by_tick(keys).rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def first_clean_block(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Start of the first run of at least n ticks whose `label` is 0."""
    clean = df.withColumn("_c", F.col("label") == 0)
    runs = islands(clean, keys, F.col("_c") & F.lag("_c").over(by_tick(keys))).where("_c").groupBy(*keys, "island").agg(F.min("tick").alias("start"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= n).groupBy(*keys).agg(F.min("start").alias("start"))


def log_returns(df: DataFrame, keys: list[str]) -> DataFrame:
    """ln(p / p before); 0 where the price before is not positive. Ticks start at 0 again."""
    before = F.lag("value").over(by_tick(keys))
    step = df.withColumn("_b", before).where(F.col("tick") > 0)
    value = F.when(F.col("_b") > 0, F.ln(F.col("value") / F.col("_b"))).otherwise(0.0)
    return step.select(*keys, (F.col("tick") - 1).alias("tick"), value.alias("value"))


def inter_event_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distances of consecutive times (`value`, seconds), without the zero ones, numbered anew."""
    gap = F.abs(F.col("value") - F.lag("value").over(by_tick(keys)))
    return assign_ticks(df.withColumn("value", gap).where("value > 0"), keys, ["tick"]).select(*keys, "tick", "value")


def nn_intervals(beats: DataFrame, keys: list[str], fs: float, normal: int = 1) -> DataFrame:
    """Seconds between consecutive normal beats (columns sample, code, tick), 0.3 to 2.0 s."""
    w = by_tick(keys)
    gap = (F.col("sample") - F.lag("sample").over(w)) / fs
    both = (F.col("code") == normal) & (F.lag("code").over(w) == normal)
    return assign_ticks(beats.withColumn("value", F.when(both, gap)).where("value BETWEEN 0.3 AND 2.0"), keys, ["tick"]).select(*keys, "tick", "value")


def first_difference(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("value", F.col("value") - F.lag("value", 1).over(by_tick(keys))).fillna({"value": 0.0})


def gc_windows(bases: DataFrame, keys: list[str], window: int = 1000) -> DataFrame:
    """(keys, tick, value): share of G and C of each full window of bases (columns pos, base);
    other letters are ignored, a window without ACGT gives no row and ticks close up."""
    b = F.upper("base")
    counts = bases.groupBy(*keys, F.expr(f"pos div {window}").alias("w")).agg(
        F.count("*").alias("n"), F.count_if(b.isin("G", "C")).alias("gc"), F.count_if(b.isin("A", "T")).alias("at"))
    full = counts.where((F.col("n") == window) & (F.col("gc") + F.col("at") > 0))
    return assign_ticks(full.withColumn("value", F.col("gc") / (F.col("gc") + F.col("at"))), keys, ["w"]).select(*keys, "tick", "value")


def resample_hold(df: DataFrame, keys: list[str], rule: int = 30) -> DataFrame:
    """Zero-order hold of (ts seconds, value) on the grid from floor(first) to ceil(last); the first grid
    row has the first sample. Grid rows are generated per series, values come as of the last sample."""
    span = df.groupBy(*keys).agg((F.floor(F.min("ts") / rule) * rule).alias("a"), (F.ceil(F.max("ts") / rule) * rule).alias("b"), F.min_by("value", "ts").alias("first"))
    grid = span.select(*keys, "first", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(rule))).alias("ts"))
    last = df.groupBy(*keys, (F.ceil(F.col("ts") / rule) * rule).alias("ts")).agg(F.max_by("value", "ts").alias("v"))
    held = grid.join(last, [*keys, "ts"], "left")
    value = F.coalesce(F.last("v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ts")), F.col("first"))
    return held.select(*keys, "ts", value.alias("value"))


def within(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points with each range of their keys that holds them, both ends included: the columns of both.

    A range lies in the one or two cells it touches of the least power of two over its length, a point in one cell of each
    length that occurs; so what meets is what a range spans, four times over at most."""
    whole = ranges.where(F.col(start) <= F.col(end)).withColumn("_a", F.floor(start).cast("long")).withColumn("_b", F.floor(end).cast("long"))
    sized = whole.withColumn("_size", F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int"))
    wide = stored(sized.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_a, _size), shiftright(_b, _size))"))).drop("_a", "_b"))
    placed = points.crossJoin(F.broadcast(wide.select("_size").distinct())).withColumn("_cell", F.expr(f"shiftright(cast(floor({at}) as bigint), _size)"))
    return placed.join(wide, [*keys, "_size", "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_size", "_cell")


def apply_interval_labels(df: DataFrame, labels: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """`code` of the last label row (by label_order) whose [start, end] holds the time; 0 without one. Times are whole numbers.

    A label is put together from cells of powers of two, at most two of a size; of each cell only the last label stays, and a
    time looks into one cell of each size. So the work does not grow with how many labels hold one time."""
    a, b, j = F.col("start").cast("long"), F.col("end").cast("long") + 1, F.expr("sequence(0, cast(ceil(log2(end - start + 1)) as int))")
    parts = labels.where("start <= end").select(*keys, "code", "label_order", a.alias("_a"), b.alias("_b"), F.explode(j).alias("_size"))
    first, last = F.expr("shiftright(_a + shiftleft(1L, _size) - 1, _size)"), F.expr("shiftright(_b, _size)")
    odd = lambda x: F.pmod(x, F.lit(2)) == 1
    ends = F.array_compact(F.array(F.when(odd(first), first), F.when(odd(last), last - 1)))
    cells = parts.where(first < last).withColumn("_cell", F.explode(ends)).groupBy(*keys, "_size", "_cell").agg(F.max("label_order").alias("_o"), F.max_by("code", "label_order").alias("code"))
    cells = stored(cells)
    times = df.select(*keys, at).distinct().crossJoin(F.broadcast(cells.select("_size").distinct())).withColumn("_cell", F.expr(f"shiftright(cast({at} as bigint), _size)"))
    best = times.join(cells, [*keys, "_size", "_cell"]).groupBy(*keys, at).agg(F.max_by("code", "_o").alias("code"))
    return df.join(best, [*keys, at], "left").fillna({"code": 0})


def restore_annotated(df: DataFrame, grid: DataFrame, keys: list[str], rule: int = 30) -> DataFrame:
    """Where a bin of several raw samples (ts, value, label) holds an anomaly but ends nominal, the grid row
    after it gets the bin's last annotated sample."""
    bins = df.groupBy(*keys, (F.floor(F.col("ts") / rule) * rule).alias("bin")).agg(
        F.count("*").alias("n"), F.max_by("label", "ts").alias("last"), F.max("label").alias("any"),
        F.max(F.when(F.col("label") > 0, F.struct("ts", "value", "label"))).alias("s"))
    fix = bins.where("n > 1 AND last = 0 AND any > 0").select(*keys, (F.col("bin") + rule).alias("ts"), F.col("s.value").alias("_v"), F.col("s.label").alias("_l"))
    out = grid.join(fix, [*keys, "ts"], "left")
    return out.select(*keys, "ts", F.coalesce("_v", "value").alias("value"), F.coalesce("_l", "label").alias("label"))


def align_channels(df: DataFrame, keys: list[str], rule: int) -> DataFrame:
    """Channels of an asset on one grid of `ts` from the least to the largest, forward, then backward filled."""
    span = df.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.lit(rule))).alias("ts"))
    each = grid.join(df.select(*keys, "channel").distinct(), keys)
    full = each.join(df.select(*keys, "channel", "ts", "value"), [*keys, "channel", "ts"], "left")
    w = Window.partitionBy(*keys, "channel").orderBy("ts")
    value = F.coalesce(F.last("value", ignorenulls=True).over(w), F.first("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return full.select(*keys, "channel", "ts", value.alias("value"))


def time_split(df: DataFrame, split) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("ts") <= F.lit(split)), df.where(F.col("ts") > F.lit(split))


def compress_changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row, rows that differ from the one before, last row."""
    w = by_tick(keys)
    keep = F.lag("tick").over(w).isNull() | F.lead("tick").over(w).isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(w))
    return df.withColumn("_k", keep).where("_k").drop("_k")


def minmax_scale(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each series to [0, 1] by its finite values; a constant one gives 0."""
    good = F.when(finite(F.col("value")), F.col("value"))
    lim = df.groupBy(*keys).agg(F.min(good).alias("_lo"), F.max(good).alias("_hi"))
    value = F.when(finite(F.col("value")), F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0))
    return df.join(lim, keys).select(*keys, "tick", value.alias("value"))


def shuffle_by_hash(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Values of a series in an order that only a hash of seed, keys and tick decides."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, "tick"), "tick")) - 1
    return df.withColumn("tick", rank.cast("long"))


def time_shift(df: DataFrame, keys: list[str], offset: int) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return df.join(n, keys).withColumn("tick", F.pmod(F.col("tick") + offset, F.col("_n"))).drop("_n")


def series_diagnostics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sampling and oddities of (ts seconds, value): median interval (upper of two), samples a day, repeats,
    gaps over 1.5 intervals, values apart from both neighbours, which agree, by over 6 deviations."""
    w = by_tick(keys)
    step = df.select(*keys, "tick", "value", (F.col("ts") - F.lag("ts").over(w)).alias("dt"), (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.lead("value").over(w) - F.col("value")).alias("dn"))
    rank = Window.partitionBy(*keys).orderBy("dt")
    ranked = step.where("dt IS NOT NULL").select(*keys, "dt", F.row_number().over(rank).alias("r"), F.count("*").over(Window.partitionBy(*keys)).alias("m"))
    median = ranked.where("r = m div 2 + 1").select(*keys, F.col("dt").alias("interval"))
    sd = step.groupBy(*keys).agg(F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    out = step.join(median, keys).join(sd, keys).groupBy(*keys, "interval", "n")
    spike = (F.abs("dv") > 6 * F.col("sd")) & (F.abs("dn") > 6 * F.col("sd")) & (F.col("dv") * F.col("dn") < 0)
    return out.agg(F.count_if(F.abs("dv") < 1e-12).alias("repeats"), F.count_if(F.col("dt") > 1.5 * F.col("interval")).alias("gaps"), F.count_if(spike).alias("spikes")).select(
        *keys, "n", "interval", F.when(F.col("interval") > 0, 86400.0 / F.col("interval")).alias("per_day"), "repeats", "gaps", "spikes")
