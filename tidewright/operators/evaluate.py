"""Scores of detectors against labels."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alarm_episodes(alarms: DataFrame, keys: list[str], gap: int = 50) -> DataFrame:
    """First alarm of each episode: one that comes `gap` ticks or more after the alarm before it, of any leg."""
    w = Window.partitionBy(*keys).orderBy("tick")
    d = F.col("tick") - F.lag("tick").over(w)
    return alarms.withColumn("_d", d).where(F.col("_d").isNull() | (F.col("_d") >= gap)).drop("_d")


def refractory_alarms(alarms: DataFrame, keys: list[str], gap: int = 100) -> DataFrame:
    """(keys, tick): alarms `gap` or more after the last one kept. An alarm that far behind the alarm before it is kept
    in any case, so ticks are folded only between such places."""
    w = Window.partitionBy(*keys).orderBy("tick")
    apart = alarms.select(*keys, "tick").distinct().withColumn("_n", F.coalesce((F.col("tick") - F.lag("tick").over(w) >= gap).cast("int"), F.lit(1)))
    runs = apart.withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(F.sort_array(F.collect_list("tick")).alias("t"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))

    def fold(acc, x):
        take = acc["last"].isNull() | (x - acc["last"] >= gap)
        return F.struct(F.when(take, x).otherwise(acc["last"]).alias("last"), F.when(take, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    return runs.select(*keys, F.explode(F.aggregate("t", start, fold)["kept"]).alias("tick"))


#: Ticks of a band: points and intervals of one series meet within bands, so a hot series is spread over many keys.
BAND = 1024


def banded(intervals: DataFrame) -> DataFrame:
    """Each interval [start, end] once for every band that it reaches into; ends before starts reach nowhere."""
    return intervals.where("start <= end").withColumn("_band", F.explode(F.sequence(F.expr(f"start div {BAND}"), F.expr(f"end div {BAND}"))))


def inside(points: DataFrame, windows: DataFrame, key: str, how: str) -> DataFrame:
    """Points (key, tick, ...) semi or anti joined with the windows (key, start, end) of their series."""
    w = banded(windows.select(F.col(key).alias("_k"), "start", "end"))
    p = points.withColumn("_b", F.expr(f"tick div {BAND}"))
    on = (p[key] == w["_k"]) & (p["_b"] == w["_band"]) & p["tick"].between(w["start"], w["end"])
    return p.join(w, on, how).drop("_b")


def caught_windows(windows: DataFrame, points: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(keys, key, label_id): windows in which a point lies, once each; keys are columns of the points."""
    p = points.select(*keys, F.col(key).alias("_k"), F.col("tick").alias("_t"), F.expr(f"tick div {BAND}").alias("_b"))
    w = banded(windows.select(key, "label_id", "start", "end"))
    on = (w[key] == p["_k"]) & (w["_band"] == p["_b"]) & p["_t"].between(w["start"], w["end"])
    return w.join(p, on).select(*keys, key, "label_id").distinct()


def window_detection(alarms: DataFrame, windows: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """(category, series, windows, caught, false_alarms, per_1000): by category, with the total (null category).

    windows: key, label_id, start, end. samples: key, category, n. Both ends count."""
    caught = caught_windows(windows, alarms, [], key).groupBy(key).agg(F.count("*").alias("caught"))
    total = windows.groupBy(key).agg(F.count("*").alias("windows"))
    false = inside(alarms, windows, key, "left_anti").groupBy(key).agg(F.count("*").alias("false"))
    per = samples.join(total, key, "left").join(caught, key, "left").join(false, key, "left").fillna(0)
    rolled = per.rollup("category").agg(F.count("*").alias("series"), F.sum("windows").alias("windows"), F.sum("caught").alias("caught"), F.sum("false").alias("false_alarms"), (1000 * F.sum("false") / F.sum("n")).alias("per_1000"))
    return rolled


def leg_breakdown(alarms: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(leg, alarms, false_alarms)."""
    false = inside(alarms, windows, key, "left_anti").groupBy("leg").agg(F.count("*").alias("false_alarms"))
    return alarms.groupBy("leg").agg(F.count("*").alias("alarms")).join(false, "leg", "left").fillna(0)


def top_false_alarm_series(false: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k series with the most false alarms; ties by key."""
    return false.groupBy(key).agg(F.count("*").alias("false_alarms")).orderBy(F.desc("false_alarms"), key).limit(k)


def sequence_detection(predicted: DataFrame, labels: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Interval overlap: labels hit, predictions that hit none, precision, recall, F1, rolled up over `groups` of the
    labels (the first group also belongs to the predictions)."""
    p = banded(predicted.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), "start", "end")).select("_k", "_s", "_e", F.col("_band").alias("_b"))
    w = banded(labels.select(key, "label_id", "start", "end"))
    met = w.join(p, (w[key] == p["_k"]) & (w["_band"] == p["_b"]) & (p["_s"] <= w["end"]) & (p["_e"] >= w["start"]))
    hit = met.select(key, "label_id").distinct().withColumn("_h", F.lit(1))
    right = met.select(F.col("_k").alias(key), F.col("_s").alias("start"), F.col("_e").alias("end")).distinct()
    each = labels.join(hit, [key, "label_id"], "left")
    found = each.rollup(*groups).agg(F.count("*").alias("labels"), F.count("_h").alias("hits"))
    false = predicted.join(right, [key, "start", "end"], "left_anti").rollup(groups[0]).agg(F.count("*").alias("false_alarms")).withColumnRenamed(groups[0], "_g")
    out = found.join(false, F.col(groups[0]).eqNullSafe(F.col("_g")), "left").drop("_g").fillna({"false_alarms": 0})
    precision, recall = F.col("hits") / F.nullif(F.col("hits") + F.col("false_alarms"), F.lit(0)), F.col("hits") / F.col("labels")
    return out.select(*groups, "labels", "hits", "false_alarms", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1"))


def timestep_confusion(scores: DataFrame, threshold: float) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1, false_rate) of rows (score, label) at a threshold."""
    p, y = F.col("score") > threshold, F.col("label") == 1
    n = scores.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))).withColumn("false_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def event_latency(scores: DataFrame, labels: DataFrame, key: str, threshold: float, window: int) -> DataFrame:
    """(key, label_id, detected, latency): an event counts from its start to `window` ticks after its end."""
    hits = scores.where(F.col("score") > threshold)
    near = labels.join(hits, (labels[key] == hits[key]) & (hits["tick"] >= labels["start"]) & (hits["tick"] < labels["end"] + 1 + window)).groupBy(labels[key], "label_id", "start").agg(F.min("tick").alias("_t"))
    return labels.select(key, "label_id").join(near.select(key, "label_id", (F.col("_t") - F.col("start")).alias("latency")), [key, "label_id"], "left").withColumn("detected", F.col("latency").isNotNull())


def score_quantile(scores: DataFrame, keys: list[str], q: float = 0.99) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("score")
    r = scores.select(*keys, "score", F.row_number().over(w).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_n"))
    return r.where(F.col("_r") == F.least(F.floor(F.col("_n") * q), F.col("_n") - 1) + 1).select(*keys, F.col("score").alias("threshold"))


def robust_train_z(features: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, id, f, train, nominal) with z: distance from the median of nominal training rows over their
    sample deviation; 0 where that is undefined."""
    fit = features.where("train AND nominal").groupBy(*keys).agg(F.median("f").alias("_m"), F.stddev_samp("f").alias("_s"))
    return features.join(fit, keys, "left").withColumn("z", F.coalesce(F.abs(F.col("f") - F.col("_m")) / F.nullif("_s", F.lit(0.0)), F.lit(0.0))).drop("_m", "_s")


def by_score(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, pos, neg): labels counted per distinct score, before anything is sorted."""
    return df.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))


def auc_roc(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc) of rows (score, label 0/1): ties count half. Null without both labels."""
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = by_score(df, keys).withColumn("_b", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return s.groupBy(*keys).agg((F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def auc_pr(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc_pr): average precision, tied scores as one step."""
    above = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    s = by_score(df, keys).withColumn("_p", F.sum("pos").over(above)).withColumn("_n", F.sum(F.col("pos") + F.col("neg")).over(above))
    return s.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("_p") / F.col("_n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("auc_pr"))


def bootstrap_auc(df: DataFrame, keys: list[str], replicates: int = 200, seed: int = 42) -> DataFrame:
    """(keys, low, high, used): percentile interval of the AUC over resamples in which each row (id) has a weight
    drawn from Poisson(1) by a hash, so that no row is copied; only resamples with both labels count."""
    b = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "id"), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    cdf, p, steps = 0.0, math.exp(-1), []
    for k in range(6):
        cdf += p
        steps.append(cdf)
        p /= k + 1
    weight = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in steps), F.lit(0))
    drawn = df.select(*keys, "id", "score", "label", b).select("*", u).withColumn("w", weight).where("w > 0")
    s = drawn.groupBy(*keys, "rep", "score").agg(F.sum(F.col("label") * F.col("w")).alias("pos"), F.sum((1 - F.col("label")) * F.col("w")).alias("neg"))
    below = Window.partitionBy(*keys, "rep").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_b", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    auc = s.groupBy(*keys, "rep").agg((F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc")).where("auc IS NOT NULL")
    return auc.groupBy(*keys).agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"), F.count("*").alias("used"))


#: Steps of the Poisson(1) distribution function that a draw of 32 bits can tell apart.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def drawn(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Every row (with an id) in every replicate (`rep` from 1) it is drawn for, `w` times: Poisson(1) of the first 32
    bits of md5(seed|rep|id), which any engine can compute. Rows that share an id are drawn together."""
    each = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    weight = sum((F.when(F.col("_u") >= int(c * 2**32), 1).otherwise(0) for c in POISSON), F.lit(0))
    return each.withColumn("_u", u).withColumn("w", weight).where("w > 0").drop("_u")


def weighted_auc(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, auc) of rows (label 0 or 1, weight w): ties count half; null without both labels."""
    s = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col("label") * F.col("w")).alias("pos"), F.sum((1 - F.col("label")) * F.col("w")).alias("neg"))
    below = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_b", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return s.groupBy(*keys).agg((F.sum(F.col("pos") * (F.col("_b") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def bootstrap_difference(df: DataFrame, keys: list[str], replicates: int = 200, seed: int = 42) -> DataFrame:
    """(keys, a, b, difference, low, high, used): AUC of two scores (score_a, score_b) of the same rows (id, label), and the
    95 % percentile interval of a - b over resamples in which both scores see the same draw; only resamples with both
    labels count. A replicate is counts of labels by score, not rows."""
    def both(rows: DataFrame, by: list[str]) -> DataFrame:
        a, b = weighted_auc(rows, by, "score_a").withColumnRenamed("auc", "a"), weighted_auc(rows, by, "score_b").withColumnRenamed("auc", "b")
        return a.join(b, by).where("a IS NOT NULL AND b IS NOT NULL").withColumn("difference", F.col("a") - F.col("b"))

    each = both(drawn(df, replicates, seed), [*keys, "rep"])
    interval = each.groupBy(*keys).agg(F.percentile("difference", 0.025).alias("low"), F.percentile("difference", 0.975).alias("high"), F.count("*").alias("used"))
    return both(df.withColumn("w", F.lit(1)), keys).join(interval, keys, "left").fillna({"used": 0})


def location_hit(predicted: DataFrame, truth: DataFrame, key: str, tolerance: int = 100) -> DataFrame:
    """(series, hits, none, accuracy, by_chance): locations within `tolerance` rows of [begin, end] (1-based)."""
    j = truth.join(predicted, key, "left")
    hit = F.coalesce(F.col("location").between(F.col("begin") - tolerance, F.col("end") + tolerance), F.lit(False))
    chance = F.least(F.lit(1.0), (F.col("end") - F.col("begin") + 1 + 2 * tolerance) / (F.col("n") - F.col("train_end")))
    return j.agg(F.count("*").alias("series"), F.count_if(hit).alias("hits"), F.count_if(F.col("location").isNull()).alias("none"), (F.count_if(hit) / F.count("*")).alias("accuracy"), F.avg(chance).alias("by_chance"))


def locate_anomaly(df: DataFrame, key: str, train_end: str) -> DataFrame:
    """(key, by_difference, by_value): places (1-based) after the training part of the largest |step| and of the
    largest |z| against the training part; the first of equals."""
    w = Window.partitionBy(key).orderBy("tick")
    d = df.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(w)))
    fit = df.where(F.col("tick") < F.col(train_end)).groupBy(key).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = d.join(fit, key).where(F.col("tick") >= F.col(train_end)).withColumn("_z", F.abs(F.col("value") - F.col("_m")) / F.greatest("_s", F.lit(1e-12)))
    pick = lambda c: (-F.max(F.struct(F.col(c), -F.col("tick")))["col2"] + 1)
    return z.groupBy(key).agg(pick("_d").alias("by_difference"), pick("_z").alias("by_value"))


def mcnemar_exact(hits: DataFrame) -> DataFrame:
    """(only_a, only_b, p) of rows (a, b booleans): two-sided exact test on the discordant pairs."""
    r = hits.agg(F.count_if(F.col("a") & ~F.col("b")).alias("x"), F.count_if(~F.col("a") & F.col("b")).alias("y")).first()
    n, k = r.x + r.y, min(r.x, r.y)
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    p = min(1.0, 2 * sum(math.exp(log(i)) for i in range(k + 1))) if n else 1.0
    return hits.sparkSession.createDataFrame([(r.x, r.y, p)], "only_a long, only_b long, p double")


def shift_p_value(scores: DataFrame) -> DataFrame:
    """(shifts, p) of rows (observed, shifted score or null): (1 + shifts at least as good) / (1 + shifts)."""
    return scores.agg(F.count("shifted").alias("shifts"), ((1 + F.count_if(F.col("shifted") >= F.col("observed"))) / (1 + F.count("shifted"))).alias("p"))


def delay_stats(df: DataFrame) -> DataFrame:
    """(early, detected, median_delay) of rows (first_alarm or null, change); the median is the upper one."""
    delays = df.select((F.col("first_alarm") - F.col("change")).alias("delay"))
    n = delays.where("delay >= 0").count()
    rank = (n // 2 + 0.5) / max(1, n)  # of the value with n div 2 others below it
    late = F.when(F.col("delay") >= 0, F.col("delay"))
    median = F.expr(f"percentile_disc({rank!r}D) WITHIN GROUP (ORDER BY late)")
    out = delays.withColumn("late", late).agg(F.count_if(F.col("delay") < 0).alias("early"), F.count("late").alias("detected"), median.alias("median_delay"))
    return out.withColumn("median_delay", F.col("median_delay").cast(df.schema["change"].dataType))


def isolation_score(alarms: DataFrame, truth: DataFrame) -> DataFrame:
    """(bin, detections, false_alarms) per 500 ticks: an alarm on a true channel at or after its onset is right."""
    t = truth.select("asset_id", "channel", F.col("onset"))
    j = alarms.join(t, ["asset_id", "channel"], "left").withColumn("_ok", F.coalesce(F.col("tick") >= F.col("onset"), F.lit(False)))
    return j.groupBy(F.expr("tick div 500").alias("bin")).agg(F.count_if("_ok").alias("detections"), F.count_if(~F.col("_ok")).alias("false_alarms"))


def self_check_table(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """(warned, spoiled, n): self-check warnings against calibration stretches [0, n) that overlap a label."""
    over = checks.join(labels, (checks["asset_id"] == labels["asset_id"]) & (labels["start"] < checks["n"]), "left_semi").select("asset_id").distinct().withColumn("_s", F.lit(True))
    return checks.join(over, "asset_id", "left").groupBy(F.col("first_alarm").isNotNull().alias("warned"), F.coalesce("_s", F.lit(False)).alias("spoiled")).agg(F.count("*").alias("n"))


def detector_comparison(alarms: DataFrame, windows: DataFrame, samples: DataFrame, key: str, gap: int = 50) -> DataFrame:
    """(detector, caught, false_alarms, per_1000): the same episodes and windows for each detector."""
    eps = alarm_episodes(alarms, ["detector", key], gap)
    caught = caught_windows(windows, eps, ["detector"], key).groupBy("detector").agg(F.count("*").alias("caught"))
    false = inside(eps, windows, key, "left_anti").groupBy("detector").agg(F.count("*").alias("false_alarms"))
    n = samples.agg(F.sum("n")).first()[0]
    out = alarms.select("detector").distinct().join(caught, "detector", "left").join(false, "detector", "left").fillna(0)
    return out.withColumn("per_1000", 1000.0 * F.col("false_alarms") / n)


def scored_settings(windows: DataFrame, settings: list) -> DataFrame:
    """(candidate, window_id, hit, clean): the monitor under each of the settings (their number is `candidate`) on every stretch.

    windows: window_id, channel, tick, value, onset (null on clean stretches), baseline. hit: an alarm from the onset on;
    clean: alarms before it, or at all on a clean stretch. A stretch is one task's work under all settings: it is read and put in
    order once. One that is too short to calibrate on has no hit and no alarm."""
    from ..functions import monitor as mon
    from .guard import filled, matrix

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, x = matrix(pdf)
        one, rows = pdf.iloc[0], []
        n = int(one["baseline"])
        late, ahead = x[:, n:], mon.Ahead(x[:, n:])
        onset = one["onset"] - n if pd.notna(one["onset"]) else late.shape[1]
        for number, cal in enumerate(mon.Calibration.each(filled(x[:, :n]), settings)):
            at = mon.alarm_columns(cal, late, ahead) if cal is not None else []
            clean = sum(k < onset for k in at)
            rows.append((number, one["window_id"], clean < len(at), clean))
        return pd.DataFrame(rows, columns=["candidate", "window_id", "hit", "clean"])

    return windows.groupBy("window_id").applyInPandas(run, "candidate int, window_id string, hit boolean, clean long")


def policy_search(windows: DataFrame, policies: list[tuple[str, float, float]]) -> DataFrame:
    """(policy, detected, clean_alarms): each policy (name, horizon, cusum_k) on each labelled stretch of `scored_settings`."""
    from ..functions import monitor as mon

    each = scored_settings(windows, [mon.Config(float(horizon), float(k)) for _, horizon, k in policies])
    named = F.element_at(F.array(*[F.lit(name) for name, _, _ in policies]), F.col("candidate") + 1)
    return each.groupBy(named.alias("policy")).agg(F.count_if("hit").alias("detected"), F.sum("clean").alias("clean_alarms"))


def mutated(config, rng):
    """One setting of a policy changed by a random factor, within its bounds."""
    from dataclasses import replace

    u = rng.random()
    k = int(u * 5)
    if k == 0:
        return replace(config, res_span=max(4, round(config.res_span * (0.6 + u))))
    if k == 1:
        return replace(config, dfa_persist=max(1, round(config.dfa_persist * (0.6 + u))))
    if k == 2:
        return replace(config, roll_persist=max(1, round(config.roll_persist * (0.6 + u))))
    if k == 3:
        return replace(config, cusum_k=min(3.0, max(0.4, config.cusum_k * (0.7 + 0.6 * u))))
    return replace(config, horizon=min(1e8, max(1e4, config.horizon * (0.25 + 1.5 * u))))


def better(detected: int, clean: int, best: tuple[int, int]) -> bool:
    """More stretches at no more clean alarms, or no fewer stretches at fewer."""
    return (detected > best[0] and clean <= best[1]) or (detected >= best[0] and clean < best[1])


def policy_rounds(windows: DataFrame, fired: DataFrame, rounds: int = 3, mutations: int = 4, seed: int = 42) -> DataFrame:
    """(round, candidate, detected, clean_alarms, accepted, coverage): a search over settings of the monitor and added legs.

    Each round scores the settings in force and `mutations` changes of them on all stretches at once, takes every one that is
    better than the best before it, and then the leg of the grammar that finds most stretches still missed and never alarms
    on a clean one. windows as for `scored_settings`; fired (gene, window_id, labelled, hit, early) as for
    `grammar.leg_search`. A stretch counts as detected by the monitor or by a taken leg; coverage is the share of labelled stretches.
    Stretches stay where they are: a round brings one small row a candidate, and one for its leg, to the driver."""
    import random

    from ..functions import monitor as mon
    from ..sources.shared import stored
    from .grammar import fresh_hits

    spark, rng = windows.sparkSession, random.Random(seed)
    labelled = windows.where("onset IS NOT NULL").select("window_id").distinct()
    total = labelled.count()
    inforce, taken, out = mon.Config(), [], []
    for k in range(rounds):
        candidates = [inforce] + [mutated(inforce, rng) for _ in range(mutations)]
        scored = stored(scored_settings(windows, candidates))
        by_leg = fired.where(F.col("gene").isin(taken) & F.col("hit")).select("window_id").distinct().withColumn("_leg", F.lit(True))
        found = scored.join(by_leg, "window_id", "left").withColumn("hit", F.col("hit") | F.coalesce("_leg", F.lit(False)))
        counts = {r.candidate: (r.detected, r.clean) for r in found.groupBy("candidate").agg(F.count_if("hit").alias("detected"), F.sum("clean").alias("clean")).collect()}
        best, at = counts.get(0, (0, 0)), 0
        for number, config in enumerate(candidates):
            detected, clean = counts.get(number, (0, 0))
            accepted = number > 0 and better(detected, clean, best)
            if accepted:
                best, at, inforce = (detected, clean), number, config
            out.append((k, "in force" if number == 0 else f"{config.res_span}/{config.dfa_persist}/{config.roll_persist}/{config.cusum_k:.4f}/{config.horizon:.0f}", detected, clean, accepted, detected / max(total, 1)))
        missed = labelled.join(found.where((F.col("candidate") == at) & F.col("hit")).select("window_id"), "window_id", "left_anti")
        leg = fresh_hits(fired, missed).first()
        if leg is not None:
            taken.append(leg.gene)
            out.append((k, leg.gene, best[0] + leg.n, best[1], True, (best[0] + leg.n) / max(total, 1)))
    return spark.createDataFrame(out, "round int, candidate string, detected long, clean_alarms long, accepted boolean, coverage double")
