"""Writers of events, incidents, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_json(columns: list[str]) -> Column:
    """One JSON object of the columns; nulls are left out."""
    return F.to_json(F.struct(*columns))


def write_events_json(events: DataFrame, summary: DataFrame, path: str) -> None:
    """One object per event, and one per summary row with `type` summary, as text lines."""
    lines = events.select(event_json(events.columns).alias("value"))
    last = summary.select(F.to_json(F.struct(F.lit("summary").alias("type"), *summary.columns)).alias("value"))
    lines.unionByName(last).write.mode("overwrite").text(path)


def incidents_to_json(incidents: DataFrame, evidence: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(asset_id, incident_id, json) with evidence and context as arrays."""
    rows = lambda d, name, cols: d.groupBy("asset_id", "incident_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = incidents.join(rows(evidence, "evidence_rows", ["tick", "channel", "leg", "observed", "threshold"]), ["asset_id", "incident_id"], "left")
    if context is not None:
        out = out.join(rows(context, "context_rows", ["tick", "kind", "value"]), ["asset_id", "incident_id"], "left")
    return out.select("asset_id", "incident_id", F.to_json(F.struct(*[c for c in out.columns])).alias("json"))


def write_row_scores(scores: DataFrame, path: str, keys: list[str]) -> None:
    """One line per row in order, six decimals; ranges of rows are files in order."""
    ordered = scores.repartitionByRange(*keys, "tick").sortWithinPartitions(*keys, "tick")
    ordered.select(F.format_string("%.6f", F.col("score")).alias("value")).write.mode("overwrite").text(path)


def report_table(laws: DataFrame, key: str, baseline: DataFrame | None = None) -> DataFrame:
    """(key, n, alpha, r2, quality, verdict) per series; TOO FEW under 20 samples, and against a registered
    baseline (key, base_alpha) the verdict of the shift."""
    from ..functions import verdicts

    out = laws.select(key, "n", "alpha", "r2", "quality")
    if baseline is not None:
        out = out.join(baseline.select(key, "base_alpha"), key, "left").withColumn("verdict", verdicts.health(F.col("alpha") - F.col("base_alpha"))).drop("base_alpha")
    else:
        out = out.withColumn("verdict", F.lit(None).cast("string"))
    return out.withColumn("quality", F.when(F.col("n") < 20, "TOO FEW").otherwise(F.col("quality")))
