"""Incidents from alarm and policy events, their context, and the comparison of two runs.

Event tables: asset_id, tick, kind, channel, leg, observed, threshold. Evidence of an incident is
kept as rows (asset_id, incident_id, ...); arrays are built only for reports.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prepare

GAP, LOOKBACK, TOLERANCE = 10, 20, 5


def by() -> Window:
    return Window.partitionBy("asset_id").orderBy("tick", "_o")


def group_incidents(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Evidence rows with incident_id: an alarm over `gap` ticks after the end of the incident before opens a
    new one; a roll-back extends the one that is open, and never opens one."""
    e = events.where(F.col("kind").isin("alarm", "rolled_back")).withColumn("_o", (F.col("kind") != "alarm").cast("int"))
    seen = F.max(F.when(F.col("kind") == "alarm", 1)).over(by().rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("_seen", seen).where("_seen = 1")
    last = F.lag("tick").over(by())
    new = (F.col("kind") == "alarm") & (last.isNull() | (F.col("tick") > last + gap))
    return e.withColumn("_n", new.cast("int")).withColumn("incident_id", F.sum("_n").over(by().rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_o", "_seen", "_n")


def spans(evidence: DataFrame) -> DataFrame:
    """(asset_id, incident_id, start_tick, end_tick, evidence, channels)."""
    return evidence.groupBy("asset_id", "incident_id").agg(F.min("tick").alias("start_tick"), F.max("tick").alias("end_tick"), F.count("*").alias("evidence"), F.array_sort(F.collect_set("channel")).alias("channels"))


def as_of(events: DataFrame, incidents: DataFrame, keep: list[str]) -> DataFrame:
    """Events with the id of the last incident that starts at or before them; events before the first go."""
    a = incidents.select("asset_id", F.col("start_tick").alias("tick"), "incident_id", F.lit(0).alias("_side"), *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in keep])
    b = events.select("asset_id", "tick", F.lit(None).cast("long").alias("incident_id"), F.lit(1).alias("_side"), *keep)
    w = Window.partitionBy("asset_id").orderBy("tick", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("incident_id", F.last("incident_id", ignorenulls=True).over(w))
    return both.where("_side = 1 AND incident_id IS NOT NULL").drop("_side")


def fold_policy_events(events: DataFrame, incidents: DataFrame) -> DataFrame:
    """(asset_id, incident_id, context, resolution, unresolved): what the policies did in each incident."""
    acts = events.where(F.col("kind").isin("quarantined", "unquarantined", "recalibrated", "rolled_back"))
    at = as_of(acts, incidents, ["kind", "channel"])
    tick = F.col("tick").cast("string")
    said = F.when(F.col("kind") == "quarantined", F.concat(F.lit("channel "), "channel", F.lit(" quarantined at tick "), tick)).when(F.col("kind") == "recalibrated", F.concat(F.lit("recalibrated at tick "), tick))
    return at.groupBy("asset_id", "incident_id").agg(F.count("*").alias("context"), F.max_by(said, F.when(said.isNotNull(), F.col("tick"))).alias("resolution"), F.count_if(F.col("kind") == "rolled_back").alias("unresolved"))


def context_in_range(ranges: DataFrame, context: DataFrame, start: str = "start_tick", end: str = "end_tick") -> DataFrame:
    """Context events (asset_id, tick, kind, value) within each range, both ends included."""
    met = prepare.within(context.select("asset_id", "tick", "kind", "value"), ranges, ["asset_id"], "tick", start, end)
    return met.select(*ranges.columns, "tick", "kind", "value")


def attach_context(incidents: DataFrame, context: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    wide = incidents.select("asset_id", "incident_id", F.greatest(F.col("start_tick") - lookback, F.lit(0)).alias("start_tick"), "end_tick")
    return context_in_range(wide, context).select("asset_id", "incident_id", "tick", "kind", "value")


def context_active_at(ticks: DataFrame, context: DataFrame) -> DataFrame:
    """Each tick's last context event at or before it (columns asset_id, tick, order); ties: the last inserted."""
    a = context.select("asset_id", "tick", F.lit(0).alias("_s"), F.col("order").alias("_o"), F.struct("kind", "value").alias("_c"))
    b = ticks.select("asset_id", "tick", F.lit(1).alias("_s"), F.lit(None).cast("long").alias("_o")).distinct().withColumn("_c", F.lit(None).cast(a.schema["_c"].dataType))
    w = Window.partitionBy("asset_id").orderBy("tick", "_s", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_c", F.last("_c", ignorenulls=True).over(w))
    return both.where("_s = 1").select("asset_id", "tick", F.col("_c.kind").alias("kind"), F.col("_c.value").alias("value"))


def offset_ticks(df: DataFrame, offset: int) -> DataFrame:
    moved = [c for c in ("tick", "start_tick", "end_tick") if c in df.columns]
    return df.withColumns({c: F.col(c) + offset for c in moved})


def incident_report(evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Evidence with channel names (channel, name) and the ratio of observed to threshold."""
    named = evidence.join(names, "channel", "left")
    return named.select("asset_id", "incident_id", "tick", F.coalesce("name", "channel").alias("name"), "leg", (F.col("observed") / F.nullif("threshold", F.lit(0.0))).alias("ratio"))


def report_totals(incidents: DataFrame, folded: DataFrame) -> DataFrame:
    """(asset_id, incidents, channels, unresolved)."""
    c = incidents.select("asset_id", F.explode("channels").alias("c")).groupBy("asset_id").agg(F.count_distinct("c").alias("channels"))
    i = incidents.groupBy("asset_id").agg(F.count("*").alias("incidents")).join(c, "asset_id", "left").fillna({"channels": 0})
    u = folded.groupBy("asset_id").agg(F.sum("unresolved").alias("unresolved"))
    return i.join(u, "asset_id", "left").fillna({"unresolved": 0})


def diff_incidents(saved: DataFrame, fresh: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """(asset_id, saved_id, fresh_id, delta): greedy pairs in saved order, each the nearest unused with a common
    channel; unmatched incidents of either side have a null partner. Candidates meet in tick bands."""
    side = lambda d, p: d.select("asset_id", F.col("incident_id").alias(f"{p}_id"), F.col("start_tick").alias(f"{p}_start"), F.col("channels").alias(f"{p}_channels"))
    a, b = side(saved, "saved"), side(fresh, "fresh")
    band = lambda c: F.expr(f"{c} div {tolerance + 1}")
    near = a.withColumn("_b", F.explode(F.array(band("saved_start") - 1, band("saved_start"), band("saved_start") + 1))).join(b.withColumn("_b", band("fresh_start")), ["asset_id", "_b"])
    delta = F.col("fresh_start") - F.col("saved_start")
    cand = near.where((F.abs(delta) <= tolerance) & F.arrays_overlap("saved_channels", "fresh_channels")).select("asset_id", "saved_id", "fresh_id", delta.alias("delta"))
    kind = saved.schema["asset_id"].dataType.simpleString()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for s, rows in pdf.sort_values(["saved_id", "fresh_id"]).groupby("saved_id", sort=True):
            free = [(abs(r.delta), r.fresh_id, r.delta) for r in rows.itertuples() if r.fresh_id not in used]
            if free:
                best = min(free, key=lambda x: (x[0], x[1]))
                used.add(best[1])
                out.append((pdf["asset_id"].iloc[0], s, best[1], best[2]))
        return pd.DataFrame(out, columns=["asset_id", "saved_id", "fresh_id", "delta"])

    pairs = cand.groupBy("asset_id").applyInPandas(pick, f"asset_id {kind}, saved_id long, fresh_id long, delta long")
    left = a.select("asset_id", "saved_id").join(pairs, ["asset_id", "saved_id"], "left")
    new = b.select("asset_id", "fresh_id").join(pairs, ["asset_id", "fresh_id"], "left_anti").select("asset_id", F.lit(None).cast("long").alias("saved_id"), "fresh_id", F.lit(None).cast("long").alias("delta"))
    return left.unionByName(new)


def differs(a, b):
    """Beyond a relative tolerance of 1e-6, of 1 at least."""
    return F.abs(a - b) > 1e-6 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def diff_evidence(pairs: DataFrame, saved: DataFrame, fresh: DataFrame) -> DataFrame:
    """(asset_id, saved_id, added, removed, changed, new_channels) of matched incidents' evidence rows."""
    p = pairs.where("saved_id IS NOT NULL AND fresh_id IS NOT NULL").select("asset_id", "saved_id", "fresh_id")
    keys = ["asset_id", "saved_id", "channel", "leg", "tick"]
    a = saved.withColumnRenamed("incident_id", "saved_id").join(p.drop("fresh_id"), ["asset_id", "saved_id"]).select(*keys, F.col("observed").alias("ao"), F.col("threshold").alias("at"), F.lit(1).alias("a"))
    b = fresh.withColumnRenamed("incident_id", "fresh_id").join(p, ["asset_id", "fresh_id"]).select(*keys, F.col("observed").alias("bo"), F.col("threshold").alias("bt"), F.lit(1).alias("b"))
    both = a.join(b, keys, "full")
    change = F.col("a").isNotNull() & F.col("b").isNotNull() & (differs(F.col("ao"), F.col("bo")) | differs(F.col("at"), F.col("bt")))
    per_channel = both.groupBy("asset_id", "saved_id", "channel").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(change).alias("changed"), F.count("a").alias("_a"))
    return per_channel.groupBy("asset_id", "saved_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"), F.sum("changed").alias("changed"), F.count_if(F.col("_a") == 0).alias("new_channels"))


def diff_calibration(saved: DataFrame, fresh: DataFrame, keys: list[str] = ["asset_id", "channel"]) -> DataFrame:  # noqa: B006
    """(keys, field, saved, fresh) of numbers that differ, or that only one side has."""
    fields = [f for f, t in saved.dtypes if f not in keys and f in fresh.columns and t in ("double", "bigint", "int")]
    flat = lambda d, n: d.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot(keys, fields, "field", n)
    both = flat(saved, "saved").join(flat(fresh, "fresh"), [*keys, "field"], "full")
    return both.where((F.col("saved").isNull() != F.col("fresh").isNull()) | F.coalesce(differs(F.col("saved"), F.col("fresh")), F.lit(False)))
