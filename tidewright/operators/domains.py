"""Jobs of one field each: text, prices, events, genomes, machines, hearts, ground."""

from __future__ import annotations

import math

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions import verdicts
from .evaluate import BAND, banded
from .grouped import dfa_by_key, dfa_of, dfa_short_by_key
from .prepare import assign_ticks, inter_event_intervals, log_returns, sanitize
from .structure import dfa, halves, time_to_threshold
from .windows import rolling_alpha


def sentence_ends(text: str) -> list[int]:
    """The lengths that `sentence_lengths` gives for one text, character by character."""
    t, out, since = text.replace("\r", ""), [], 0
    for i, c in enumerate(t):
        since += 1
        if c in ".!?" and since >= 3 and (i + 1 == len(t) or t[i + 1].isspace() or t[i + 1] in "\"'"):
            out.append(since)
            since = 0
    return out + [since] if since >= 10 else out


#: A sentence ends at a mark before white space, a quote or the end.
_MARK = re.compile(r"""[.!?](?=[\s"']|\Z)""")


def sentences_of(text: str | None) -> list[int]:
    t, lens, last = (text or "").replace("\r", ""), [], 0
    for m in _MARK.finditer(t):
        if m.end() - last >= 3:
            lens.append(m.end() - last)
            last = m.end()
    return lens + [len(t) - last] if len(t) - last >= 10 else lens


@F.pandas_udf(ArrayType(LongType()))
def sentence_lengths(text: pd.Series) -> pd.Series:
    """Lengths of sentences in characters. A sentence ends at . ! or ? before white space, a quote or the end,
    once it has three characters; what is left counts from ten on. Carriage returns do not count. A batch of texts
    is searched at once in Python: Java's search for the same pattern takes several times as long."""
    return text.map(sentences_of)


def text_structure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sentences, mean_length, alpha, r2, tag) of each document. A document's sentences are one short series, so
    its exponent is a column function of it and nothing is shuffled."""
    lens = docs.select(id_col, sentence_lengths(text_col).alias("_l"))
    fit = lens.select(id_col, "_l", dfa_of(F.transform("_l", lambda x: x.cast("double"))).alias("_d"))
    mean = F.when(F.size("_l") > 0, F.aggregate("_l", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size("_l")).otherwise(0.0)
    out = fit.select(id_col, F.size("_l").cast("long").alias("sentences"), mean.alias("mean_length"), F.col("_d.alpha").alias("alpha"), F.col("_d.r2").alias("r2"))
    return out.withColumn("tag", verdicts.text_tag(F.col("alpha"), F.col("r2"), F.col("sentences")))


def market_regime(prices: DataFrame, keys: list[str]) -> DataFrame:
    return dfa(log_returns(prices, keys), keys).withColumn("regime", verdicts.regime(F.col("alpha")))


def event_rhythm(times: DataFrame, keys: list[str]) -> DataFrame:
    gaps = inter_event_intervals(times, keys)
    mean = gaps.groupBy(*keys).agg(F.avg("value").alias("mean_interval"))
    return dfa(gaps, keys).join(mean, keys).withColumn("rhythm", verdicts.rhythm(F.col("alpha"), F.col("r2"), F.col("n")))


def genome_structure(windows: DataFrame, keys: list[str], block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Per sequence windows, mean GC, alpha, r2 (zeros under 64 windows); and the profile (keys, w, end_tick, alpha, r2) of
    half-overlapping blocks, for sequences of more windows than a block."""
    mean = windows.groupBy(*keys).agg(F.avg("value").alias("mean_gc"))
    few = F.col("n") < 64
    whole = dfa(windows, keys).join(mean, keys).select(*keys, F.col("n").alias("windows"), "mean_gc", F.when(few, 0.0).otherwise(F.col("alpha")).alias("alpha"), F.when(few, 0.0).otherwise(F.col("r2")).alias("r2"))
    long = windows.join(windows.groupBy(*keys).count().where(F.col("count") > block).select(*keys), keys, "left_semi")
    return whole, rolling_alpha(long, keys, block, max(1, block // 2))


def multi_channel_health(laws: DataFrame, baselines: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, alpha, shift, verdict, scaled) against given baselines (key, base_alpha)."""
    shift = F.col("alpha") - F.col("base_alpha")
    return laws.join(baselines, key).select(key, "alpha", shift.alias("shift"), verdicts.health(shift).alias("verdict"), verdicts.scaled_health(shift, threshold).alias("scaled"))


def half_split_shift(df: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The `top` series of 256 values and more whose halves differ most."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 256")
    h = dfa(halves(df.join(n, keys), keys), [*keys, "half"])
    pair = h.groupBy(*keys).agg(F.max(F.when(F.col("half") == 0, F.col("alpha"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("alpha"))).alias("b"))
    shift = F.abs(F.col("b") - F.col("a"))
    return pair.select(*keys, "a", "b", shift.alias("shift"), verdicts.health(shift).alias("verdict")).orderBy(F.desc("shift"), *keys).limit(top)


def train_test_shift(train: DataFrame, test: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """(keys, train_n, test_n, a, b, shift, verdict): the `top` series of 256 finite values and more on both sides whose
    exponents differ most."""
    one = lambda d, n, c: dfa(d, keys).where("n >= 256").select(*keys, F.col("n").alias(n), F.col("alpha").alias(c))
    pair = one(sanitize(train, keys), "train_n", "a").join(one(sanitize(test, keys), "test_n", "b"), keys)
    shift = F.abs(F.col("b") - F.col("a"))
    return pair.select(*keys, "train_n", "test_n", "a", "b", shift.alias("shift"), verdicts.health(shift).alias("verdict")).orderBy(F.desc("shift"), *keys).limit(top)


def terrain_blocks(samples: DataFrame, segments: DataFrame, leg: str, block: int = 1024) -> DataFrame:
    """(leg, segment, label, block, alpha, r2): full blocks of the samples (leg, ts, order, value) in each labelled time
    segment (leg, segment, start, end, label); both ends count, times are whole numbers."""
    s = samples.select(F.col(leg).alias("_k"), "ts", "order", "value", F.expr(f"ts div {BAND}").alias("_b"))
    g = banded(segments.select(leg, "segment", "start", "end", "label"))
    met = g.join(s, (g[leg] == s["_k"]) & (g["_band"] == s["_b"]) & s["ts"].between(g["start"], g["end"]))
    placed = assign_ticks(met.select(leg, "segment", "label", "ts", "order", "value"), [leg, "segment", "label"], ["ts", "order"])
    cut = placed.select(leg, "segment", "label", F.expr(f"tick div {block}").alias("block"), F.expr(f"tick % {block}").alias("tick"), "value")
    return dfa_by_key(cut, [leg, "segment", "label", "block"]).where(F.col("n") == block).drop("n")


def hrv_features(nn: DataFrame, keys: list[str], short: int = 64, long: int = 2048) -> DataFrame:
    """(keys, alpha1, alpha2, mean, sdnn, rmssd) of beat intervals: medians of the exponents of full blocks. A block is
    one array, so that no row is repeated by box size."""
    def blocks(n: int, fit) -> DataFrame:
        cut = nn.select(*keys, F.expr(f"tick div {n}").alias("_blk"), F.expr(f"tick % {n}").alias("tick"), "value")
        return fit(cut, [*keys, "_blk"]).where(F.col("n") == n).groupBy(*keys).agg(F.median("alpha").alias(f"alpha_{n}"))

    w = Window.partitionBy(*keys).orderBy("tick")
    step = nn.withColumn("_d", F.col("value") - F.lag("value").over(w))
    base = step.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"))
    out = base.join(blocks(short, dfa_short_by_key), keys, "left").join(blocks(long, dfa_by_key), keys, "left")
    return out.select(*keys, F.col(f"alpha_{short}").alias("alpha1"), F.col(f"alpha_{long}").alias("alpha2"), "mean", "sdnn", "rmssd")


def class_separation(vectors: DataFrame, label: str, leg: str, value: str) -> DataFrame:
    """(leg, a, b, d): Cohen's d of each pair of classes, from their means and sample deviations."""
    s = vectors.groupBy(leg, label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a, b = (s.select(leg, F.col(label).alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "m", "v")]) for x in ("a", "b"))
    pooled = F.sqrt(((F.col("a_n") - 1) * F.col("a_v") + (F.col("b_n") - 1) * F.col("b_v")) / F.nullif(F.col("a_n") + F.col("b_n") - 2, F.lit(0)))
    return a.join(b, leg).where("a < b").select(leg, "a", "b", ((F.col("a_m") - F.col("b_m")) / F.nullif(pooled, F.lit(0.0))).alias("d"))


def _class_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, s, c): each group's sums of vectors, dimension by dimension, and its rows."""
    sums = rows.select(*by, F.posexplode("values").alias("dim", "value")).groupBy(*by, "dim").agg(F.sum(F.col("value").cast("double")).alias("s"), F.count("*").alias("c"))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda x: x["s"]).alias("s"), F.max("c").alias("c"))


def _blocks_of(one: DataFrame, label: str, classes: int) -> tuple[DataFrame, int]:
    """Classes dealt to blocks (`_b`) of about `classes`, and the number of blocks."""
    blocks = max(1, math.ceil(one.select(label).distinct().count() / classes))
    return one.withColumn("_b", F.pmod(F.xxhash64(label), F.lit(blocks))), blocks


def _in_every_block(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))


def nearest_centroid_holdout(rows: DataFrame, classes: int = 1000) -> DataFrame:
    """(truth, predicted, n) leaving one row out: rows (id, label, values). A class's centroid is its sums less the
    row's own part; a class of one row cannot be assessed and is only met by others. Rows meet the classes in blocks of
    about `classes`, by an equal join on the block."""
    one, blocks = _blocks_of(_class_sums(rows, ["label"]), "label", classes)
    packed = one.groupBy("_b").agg(F.collect_list(F.struct(F.col("label").alias("to"), "s", "c")).alias("ks"))

    def far(k: Column) -> Column:
        own = (F.col("label") == k["to"]).cast("int")
        n = k["c"] - own
        gap = F.zip_with(F.transform("values", lambda v: v.cast("double")), k["s"], lambda v, s: F.pow(v - (s - own * v) / n, F.lit(2)))
        return F.when(n > 0, F.struct(F.round(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x), 9).alias("d"), k["to"].alias("to")))

    each = _in_every_block(rows, blocks).join(packed, "_b")
    best = each.select("id", "label", F.array_min(F.filter(F.transform("ks", far), lambda x: x.isNotNull())).alias("near"), F.exists("ks", lambda k: (k["to"] == F.col("label")) & (k["c"] > 1)).alias("_k"))
    near = best.groupBy("id", "label").agg(F.min("near")["to"].alias("predicted"), F.bool_or("_k").alias("_k")).where("_k")
    return near.groupBy(F.col("label").alias("truth"), "predicted").agg(F.count("*").alias("n"))


def group_holdout(rows: DataFrame, classes: int = 1000) -> DataFrame:
    """(id, truth, predicted, assessable) leaving out whole groups: rows (id, group, label, values).

    A row is put to the nearest centroid of the classes as they are without its group: each class's sums less what the group
    adds to them; of equal distances (to 9 digits) the smallest label. A class that no other group has cannot be
    assessed: its rows get a prediction, but are not counted as right or wrong; predicted is null where no other group
    has any class. Each group's centroids are made once and meet its rows in blocks of about `classes` of them."""
    total, blocks = _blocks_of(_class_sums(rows, ["label"]), "label", classes)
    own = _class_sums(rows, ["group", "label"]).select("group", F.col("label").alias("to"), F.col("s").alias("_os"), F.col("c").alias("_oc"))
    groups = _in_every_block(rows.select("group").distinct(), blocks)
    pairs = groups.join(total.withColumnRenamed("label", "to"), "_b").join(own, ["group", "to"], "left")
    n = F.col("c") - F.coalesce("_oc", F.lit(0))
    rest = F.when(F.col("_os").isNull(), F.col("s")).otherwise(F.zip_with("s", "_os", lambda a, b: a - b))
    left = pairs.withColumn("_n", n).where("_n > 0").select("group", "_b", F.struct("to", F.transform(rest, lambda x: x / F.col("_n")).alias("at")).alias("k"))
    packed = left.groupBy("group", "_b").agg(F.collect_list("k").alias("ks"))

    def far(k: Column) -> Column:
        gap = F.zip_with(F.transform("values", lambda v: v.cast("double")), k["at"], lambda v, m: F.pow(v - m, F.lit(2)))
        return F.struct(F.round(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x), 9).alias("d"), k["to"].alias("to"))

    each = _in_every_block(rows, blocks).join(packed, ["group", "_b"], "left")
    best = each.select("id", "label", F.array_min(F.transform("ks", far)).alias("near"), F.coalesce(F.exists("ks", lambda k: k["to"] == F.col("label")), F.lit(False)).alias("_k"))
    return best.groupBy("id", F.col("label").alias("truth")).agg(F.min("near")["to"].alias("predicted"), F.bool_or("_k").alias("assessable"))


def holdout_report(found: DataFrame, z: float = 1.96) -> DataFrame:
    """(truth, right, assessed, unassessable, low, high) of `group_holdout`: Wilson's interval of each class's share of
    right rows, null for a class without assessed rows."""
    some = F.col("assessable")
    by = found.groupBy("truth").agg(F.count_if(some & (F.col("predicted") == F.col("truth"))).alias("right"), F.count_if(some).alias("assessed"), F.count_if(~some).alias("unassessable"))
    low, high = wilson(F.col("right"), F.nullif("assessed", F.lit(0)), z)
    return by.select("truth", "right", "assessed", "unassessable", F.greatest(low, F.when(F.col("assessed") > 0, 0.0)).alias("low"), F.least(high, F.when(F.col("assessed") > 0, 1.0)).alias("high"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, q = k / n, z * z
    mid, half = (p + q / (2 * n)) / (1 + q / n), z * F.sqrt(p * (1 - p) / n + q / (4 * n * n)) / (1 + q / n)
    return mid - half, mid + half


def signal_quality(laws: DataFrame) -> DataFrame:
    return laws.withColumn("signal", F.when(F.col("alpha") > 0.7, "structured").otherwise("degraded"))


def run_to_failure(health: DataFrame, keys: list[str], baseline: int, factor: float = 4.0) -> DataFrame:
    """(keys, base, level, failure, share, eta, error): the first tick over `factor` times the mean of the first
    `baseline` values, and what the trend said at 50, 75 and 90 % of the way."""
    base = health.where(F.col("tick") < baseline).groupBy(*keys).agg(F.avg("value").alias("base"))
    over = health.join(base, keys).where(F.col("value") > factor * F.col("base")).groupBy(*keys, "base").agg(F.min("tick").alias("failure"))
    out = None
    for share in (0.5, 0.75, 0.9):
        part = health.join(over, keys).where(F.col("tick") <= F.floor(F.col("failure") * share)).select(*keys, "tick", (F.col("value") / (factor * F.col("base"))).alias("value"))
        eta = time_to_threshold(part, keys, 8, 1.0).select(*keys, "eta")
        one = over.join(eta, keys, "left").select(*keys, "base", (factor * F.col("base")).alias("level"), "failure", F.lit(share).alias("share"), "eta", (F.col("eta") - (F.col("failure") - F.floor(F.col("failure") * share))).alias("error"))
        out = one if out is None else out.unionByName(one)
    return out


def recording_rms(df: DataFrame) -> DataFrame:
    """(recording, channel, rms) over rows in which every channel has a number."""
    w = Window.partitionBy("recording", "tick")
    whole = df.withColumn("_k", F.count("value").over(w) == F.count("*").over(w)).where("_k")
    return whole.groupBy("recording", "channel").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


