"""The monitor over many assets: one ordered pass per asset inside a grouped Spark task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import monitor as mon
from ..sources.shared import stored
from . import recursions
from .legs import dedupe_alarms

EVENTS = "asset_id {id}, tick long, kind string, channel string, leg string, observed double, threshold double, hit_gap long, class string"


def matrix(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(channels, ticks, values (channels, ticks)) of one asset's long rows."""
    channels, row = np.unique(pdf["channel"].to_numpy(str), return_inverse=True)
    ticks, col = np.unique(pdf["tick"].to_numpy(), return_inverse=True)
    x = np.full((len(channels), len(ticks)), np.nan)
    x[row, col] = pdf["value"].to_numpy(float)
    return channels.tolist(), ticks, x


def filled(x: np.ndarray) -> np.ndarray:
    """Gaps forward, leading ones backward, 0 for a channel without values."""
    d = pd.DataFrame(np.where(np.isfinite(x), x, np.nan))
    return d.ffill(axis=1).bfill(axis=1).fillna(0.0).to_numpy()


def default_baseline(n: int) -> int:
    return min(n, max(min(n // 3, 100_000), 192))


def _rows(asset, tick: int, channels: list[str], events: list[tuple]) -> list[tuple]:
    out = []
    for kind, alarm, ch, fault in events:
        a = (alarm.leg, float(alarm.observed), float(alarm.threshold), alarm.hit_gap) if alarm else (None, None, None, None)
        out.append((asset, tick, kind, channels[ch] if ch is not None else None, *a, fault))
    return out


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("tick", "hit_gap"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def _per_asset(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    kind = df.schema["asset_id"].dataType.simpleString()
    return df.select("asset_id", "channel", "tick", "value").groupBy("asset_id").applyInPandas(run, schema.format(id=kind))


CALIBRATION = "asset_id {id}, channel string, ar_a double, ar_b double, ar_sd double, alpha_mean double, alpha_sd double, mean double, roll_thr double, max_run long, repeat_enabled boolean, recon_sd double, recon_r2 double, res_thr double, cusum_thr double, dfa_thr double, parity_thr double"


def _calibrated(asset, channels: list[str], cal: mon.Calibration | None) -> list[tuple]:
    return [] if cal is None else [
        (asset, c, *(float(getattr(cal, f)[i]) for f in ("a", "b", "sd", "alpha_mean", "alpha_sd", "mean", "roll_thr")), int(cal.max_run[i]), bool(cal.repeats[i]), float(cal.recon_sd[i]), float(cal.recon_r2[i]), cal.res_thr, cal.cusum_thr, cal.dfa_thr, cal.parity_thr)
        for i, c in enumerate(channels)]


def calibrate(df: DataFrame, baseline: Callable[[int], int] = default_baseline, config: mon.Config = mon.Config()) -> DataFrame:
    """One row per asset and channel with all that the healthy prefix teaches; none for assets under 192 ticks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, _, x = matrix(pdf)
        rows = _calibrated(pdf["asset_id"].iloc[0], channels, mon.Calibration.of(filled(x[:, : baseline(x.shape[1])]), config))
        return pd.DataFrame(rows, columns=[p.split()[0] for p in CALIBRATION.split(", ")])

    return _per_asset(df, run, CALIBRATION)


def watched(df: DataFrame, baseline: Callable[[int], int] = default_baseline, config: mon.Config = mon.Config(), carry_config: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events of `autopilot`, rows of `calibrate`), both of one pass over the assets; stored."""
    events, learned = (s.split(", ") for s in (EVENTS, CALIBRATION))
    extra = [p for p in learned if p not in events and p != "channel string"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, ticks, x = matrix(pdf)
        asset, n, rows = pdf["asset_id"].iloc[0], baseline(x.shape[1]), []
        cal = mon.Calibration.of(filled(x[:, :n]), config)
        fit = _calibrated(asset, channels, cal)  # before the guard adopts parts of others
        if cal is not None:
            for k, found in mon.Guard(cal, carry_config).run(x[:, n:]):
                rows += _rows(asset, int(ticks[n + k]), channels, found)
        taught = [(r[0], None, None, r[1], *[None] * (len(events) - 4), *r[2:]) for r in fit]
        out = _frame(taught + [(*r, *[None] * len(extra)) for r in rows], [p.split()[0] for p in [*events, *extra]])
        return out.astype({"max_run": "Int64", "repeat_enabled": "boolean"})

    both = stored(_per_asset(df, run, ", ".join([*events, *extra])))
    return both.where("kind IS NOT NULL").select(*[p.split()[0] for p in events]), both.where("kind IS NULL").select(*[p.split()[0] for p in learned])


def hybrid_monitor(df: DataFrame, baseline: Callable[[int], int] = default_baseline, config: mon.Config = mon.Config(), legs: set[str] | None = None) -> DataFrame:
    """First alarm of each asset after its prefix (the monitor latches), ticks as in the recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, ticks, x = matrix(pdf)
        n = baseline(x.shape[1])
        cal, rows = mon.Calibration.of(filled(x[:, :n]), config), []
        if cal is not None:
            for k, alarm in mon.Monitor(cal, legs).alarms(x[:, n:]):
                rows = _rows(pdf["asset_id"].iloc[0], int(ticks[n + k]), channels, [("alarm", alarm, alarm.channel, alarm.fault)])
                break
        return _frame(rows, [p.split()[0] for p in EVENTS.split(", ")])

    return _per_asset(df, run, EVENTS)


def multi_rate_monitor(df: DataFrame, baseline: DataFrame, config: mon.Config = mon.Config()) -> DataFrame:
    """Alarms where channels report at their own rates: rows (asset_id, channel, tick, value) in the order of tick and
    channel, each one reading of one channel; the latch is cleared after every alarm. baseline: aligned healthy rows."""
    both = baseline.select("asset_id", "channel", "tick", "value", F.lit(0).alias("part")).unionByName(df.select("asset_id", "channel", "tick", "value", F.lit(1).alias("part")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, _, x = matrix(pdf[pdf["part"] == 0])
        cal, rows = mon.Calibration.of(filled(x), config) if len(channels) else None, []
        if cal is not None:
            late = pdf[(pdf["part"] == 1) & pdf["channel"].isin(channels)].sort_values(["tick", "channel"])
            at = np.searchsorted(channels, late["channel"].to_numpy(str))
            for k, alarm in mon.Monitor(cal).readings(at, late["value"].to_numpy(float)):
                rows += _rows(late["asset_id"].iloc[k], int(late["tick"].iloc[k]), channels, [("alarm", alarm, alarm.channel, alarm.fault)])
        return _frame(rows, [p.split()[0] for p in EVENTS.split(", ")])

    kind = df.schema["asset_id"].dataType.simpleString()
    return both.groupBy("asset_id").applyInPandas(run, EVENTS.format(id=kind))


def autopilot(df: DataFrame, baseline: Callable[[int], int] = default_baseline, config: mon.Config = mon.Config(), carry_config: bool = False) -> DataFrame:
    """All events of the guarded monitor after each asset's prefix, ticks as in the recording.

    One asset is one task's work, in order; assets run in parallel. Non-finite values are missing
    samples; assets with a prefix under 192 ticks give no events."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, ticks, x = matrix(pdf)
        n = baseline(x.shape[1])
        cal, rows = mon.Calibration.of(filled(x[:, :n]), config), []
        if cal is not None:
            for k, events in mon.Guard(cal, carry_config).run(x[:, n:]):
                rows += _rows(pdf["asset_id"].iloc[0], int(ticks[n + k]), channels, events)
        return _frame(rows, [p.split()[0] for p in EVENTS.split(", ")])

    return _per_asset(df, run, EVENTS)


def self_check(df: DataFrame, baseline: Callable[[int], int] = default_baseline) -> DataFrame:
    """(asset_id, checked, first_alarm): does a calibration on half of the prefix alarm on its other half?"""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, ticks, x = matrix(pdf)
        n = baseline(x.shape[1])
        at = mon.self_check(filled(x[:, :n]))
        out = pd.DataFrame([(pdf["asset_id"].iloc[0], n // 2 >= 768, int(ticks[at]) if at is not None else None)], columns=["asset_id", "checked", "first_alarm"])
        out["first_alarm"] = out["first_alarm"].astype("Int64")
        return out

    return _per_asset(df, run, "asset_id {id}, checked boolean, first_alarm long")


def guard(df: DataFrame, sensitivity: str = "default", quiet: int = 50, baseline: Callable[[int], int] = default_baseline) -> tuple[DataFrame, DataFrame]:
    """(events, summary): events of the autopilot without alarms that repeat within `quiet` ticks; per asset the
    numbers of alarms, adaptations and quarantines, and a verdict."""
    config = mon.Config(horizon=1e5 if sensitivity == "high" else 1e6)
    # alarms and the rest are two branches: the fleet is watched once for both
    events = stored(autopilot(df, baseline, config))
    alarms = dedupe_alarms(events.where("kind = 'alarm'"), quiet)
    kept = alarms.unionByName(events.where("kind <> 'alarm'"))
    counts = kept.groupBy("asset_id").agg(F.count_if(F.col("kind") == "alarm").alias("alarms"), F.count_if(F.col("kind") == "recalibrated").alias("adaptations"), F.count_if(F.col("kind") == "quarantined").alias("quarantines"))
    sizes = df.groupBy("asset_id").agg(F.count_distinct("tick").alias("samples"), F.count_distinct("channel").alias("channels"))
    out = sizes.join(counts, "asset_id", "left").fillna(0, ["alarms", "adaptations", "quarantines"])
    return kept, out.withColumn("verdict", F.when(F.col("alarms") == 0, "healthy").otherwise("alarms"))


def _healthy(df: DataFrame, healthy: DataFrame) -> DataFrame:
    """Rows with the mean and deviation of their channel's healthy values; channels without any are left out."""
    known = healthy.groupBy("asset_id", "channel").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    return df.select("asset_id", "channel", "tick", "value").join(known, ["asset_id", "channel"])


def ewma_chart(df: DataFrame, healthy: DataFrame, weight: float = 0.2, chunk: int = recursions.CHUNK) -> DataFrame:
    """(asset, channel, tick, leg) where the weighted mean, from the healthy mean on, is further than three of its deviations off."""
    rows, keys = _healthy(df, healthy), ["asset_id", "channel"]
    path = recursions.smoothed(rows, keys, "value", weight, "_mean", chunk)
    limits = rows.groupBy(*keys).agg(F.first("_mean").alias("_mean"), (3 * F.first("_sd") * (weight / (2 - weight)) ** 0.5).alias("_limit"))
    return path.join(limits, keys).where(F.abs(F.col("y") - F.col("_mean")) > F.col("_limit")).select(*keys, "tick", F.lit("ewma").alias("leg"))


def cusum_chart(df: DataFrame, healthy: DataFrame, chunk: int = recursions.CHUNK) -> DataFrame:
    """(asset, channel, tick, leg) of a two-sided sum with slack half a healthy deviation and limit five, begun again after each alarm."""
    return recursions.cusum_alarms(_healthy(df, healthy), ["asset_id", "channel"], "_mean", "_sd", chunk).withColumn("leg", F.lit("cusum_chart"))
