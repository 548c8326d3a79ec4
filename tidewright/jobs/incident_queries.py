"""Queries of the guarded monitor (LEG10 to LEG20), incidents (INC) and cases (SNK)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import guard, incidents, replay
from ..operators.calibrate import siegmund_threshold
from .monitor_queries import _PTHR, FC, GUMBEL, R, frames
from .registry import DFA, EV, event_series, fleet, query, recording, round_all, table

ID = ["asset_id", "channel"]
#: Alarm and policy events made from the events table: five assets, ticks from the event numbers.
EVT = """evt AS (SELECT 'a' || user_id % 5 AS asset_id, event_id AS tick, CASE WHEN event_id % 11 = 0 THEN 'quarantined' WHEN event_id % 13 = 0 THEN 'rolled_back' WHEN event_id % 17 = 0 THEN 'recalibrated' ELSE 'alarm' END AS kind,
event_type AS channel, 'leg' || event_id % 3 AS leg, value AS observed, 40e0 AS threshold FROM events WHERE value > 60)"""
GRP = f"""{EVT}, ge AS (SELECT *, (kind <> 'alarm')::INT AS o FROM evt WHERE kind IN ('alarm', 'rolled_back')),
gs AS (SELECT * FROM (SELECT *, max(CASE WHEN kind = 'alarm' THEN 1 END) OVER (PARTITION BY asset_id ORDER BY tick, o ROWS UNBOUNDED PRECEDING) AS seen FROM ge) WHERE seen = 1),
gl AS (SELECT *, lag(tick) OVER (PARTITION BY asset_id ORDER BY tick, o) AS p FROM gs),
evi AS (SELECT asset_id, tick, kind, channel, leg, observed, threshold, (sum(CASE WHEN kind = 'alarm' AND (p IS NULL OR tick > p + 10) THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY tick, o ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS incident_id FROM gl),
inc AS (SELECT asset_id, incident_id, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS evidence, list_sort(list(DISTINCT channel)) AS channels FROM evi GROUP BY asset_id, incident_id)"""
CTX = "ctx AS (SELECT 'a' || user_id % 5 AS asset_id, event_id AS tick, 'sign' AS kind, props AS value, event_id AS o FROM events WHERE event_type = 'signup')"


def events(spark, sf):
    e = table(spark, sf, "events").where("value > 60")
    kind = F.when(F.col("event_id") % 11 == 0, "quarantined").when(F.col("event_id") % 13 == 0, "rolled_back").when(F.col("event_id") % 17 == 0, "recalibrated").otherwise("alarm")
    return e.select(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("asset_id"), F.col("event_id").alias("tick"), kind.alias("kind"), F.col("event_type").alias("channel"), F.concat(F.lit("leg"), (F.col("event_id") % 3).cast("string")).alias("leg"), F.col("value").alias("observed"), F.lit(40.0).alias("threshold"))


def context(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'signup'")
    return e.select(F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("asset_id"), F.col("event_id").alias("tick"), F.lit("sign").alias("kind"), F.col("props").alias("value"), F.col("event_id").alias("order"))


def _found(spark, sf):
    evidence = incidents.group_incidents(events(spark, sf))
    return evidence, incidents.spans(evidence)


@query("inc1_group_incidents", f"WITH {GRP} SELECT asset_id, incident_id, start_tick, end_tick, evidence, array_to_string(channels, ',') AS channels FROM inc")
def inc1(spark, sf):
    return _found(spark, sf)[1].withColumn("channels", F.array_join("channels", ","))


@query("inc2_fold_policy_events", f"""WITH {GRP}, act AS (SELECT * FROM evt WHERE kind <> 'alarm'), aof AS (SELECT a.*, i.incident_id FROM act a ASOF JOIN inc i ON a.asset_id = i.asset_id AND a.tick >= i.start_tick),
s AS (SELECT *, CASE kind WHEN 'quarantined' THEN 'channel ' || channel || ' quarantined at tick ' || tick WHEN 'recalibrated' THEN 'recalibrated at tick ' || tick END AS said FROM aof)
SELECT asset_id, incident_id, count(*) AS context, max_by(said, tick) FILTER (said IS NOT NULL) AS resolution, count(*) FILTER (kind = 'rolled_back') AS unresolved FROM s GROUP BY asset_id, incident_id""")
def inc2(spark, sf):
    return incidents.fold_policy_events(events(spark, sf), _found(spark, sf)[1])


@query("inc3_attach_context", f"WITH {GRP}, {CTX} SELECT i.asset_id, i.incident_id, c.tick, c.kind, c.value FROM inc i JOIN ctx c ON c.asset_id = i.asset_id AND c.tick BETWEEN greatest(start_tick - 20, 0) AND end_tick")
def inc3(spark, sf):
    return incidents.attach_context(_found(spark, sf)[1], context(spark, sf))


@query("inc4_context_active_at", f"WITH {GRP}, {CTX}, t AS (SELECT DISTINCT asset_id, tick FROM evi) SELECT t.asset_id, t.tick, c.kind, c.value FROM t ASOF LEFT JOIN ctx c ON c.asset_id = t.asset_id AND t.tick >= c.tick")
def inc4(spark, sf):
    return incidents.context_active_at(_found(spark, sf)[0], context(spark, sf))


@query("inc5_context_in_range", f"WITH {GRP}, {CTX} SELECT i.asset_id, incident_id, count(*) AS n FROM inc i JOIN ctx c ON c.asset_id = i.asset_id AND c.tick BETWEEN start_tick AND end_tick GROUP BY ALL")
def inc5(spark, sf):
    return incidents.context_in_range(_found(spark, sf)[1], context(spark, sf)).groupBy("asset_id", "incident_id").agg(F.count("*").alias("n"))


@query("inc6_offset_ticks", f"WITH {GRP} SELECT asset_id, incident_id, start_tick + 666 AS start_tick, end_tick + 666 AS end_tick FROM inc")
def inc6(spark, sf):
    return incidents.offset_ticks(_found(spark, sf)[1].select("asset_id", "incident_id", "start_tick", "end_tick"), 666)


@query("inc8_incident_report", f"WITH {GRP}, nm AS (SELECT event_type AS channel, upper(event_type) AS name FROM events WHERE event_type <> 'view' GROUP BY ALL) SELECT asset_id, incident_id, tick, coalesce(name, channel) AS name, leg, round(observed / threshold, 6) AS ratio FROM evi LEFT JOIN nm USING (channel)")
def inc8(spark, sf):
    names = table(spark, sf, "events").where("event_type <> 'view'").select(F.col("event_type").alias("channel"), F.upper("event_type").alias("name")).distinct()
    return round_all(incidents.incident_report(_found(spark, sf)[0], names))


@query("inc8_report_totals", f"WITH {GRP}, act AS (SELECT * FROM evt WHERE kind = 'rolled_back'), u AS (SELECT a.asset_id, count(*) AS u FROM act a ASOF JOIN inc i ON a.asset_id = i.asset_id AND a.tick >= i.start_tick GROUP BY 1) SELECT asset_id, count(DISTINCT incident_id) AS incidents, count(DISTINCT c) AS channels, coalesce(max(u), 0) AS unresolved FROM (SELECT asset_id, incident_id, unnest(channels) AS c FROM inc) LEFT JOIN u USING (asset_id) GROUP BY asset_id")
def inc8_totals(spark, sf):
    found = _found(spark, sf)[1]
    return incidents.report_totals(found, incidents.fold_policy_events(events(spark, sf), found))


def _again(spark, sf):
    """The same events a little later and with some missing, as a second run."""
    e = events(spark, sf).where("tick % 19 <> 0")
    return e.withColumn("tick", F.col("tick") + F.when(F.col("tick") % 7 == 0, 1).otherwise(0)).withColumn("observed", F.col("observed") * F.when(F.col("tick") % 5 == 0, 1.1).otherwise(1.0))


def _second_run(sql: str) -> str:
    """The CTEs of GRP behind evt, over ev2 and under names of their own."""
    return re.sub(r"\b(evt|ge|gs|gl|evi|inc)\b", r"\g<1>2", sql[len(EVT) + 2 :])


EV2 = "evt2 AS (SELECT asset_id, t AS tick, kind, channel, leg, observed * CASE WHEN t % 5 = 0 THEN 1.1e0 ELSE 1 END AS observed, threshold FROM (SELECT *, tick + CASE WHEN tick % 7 = 0 THEN 1 ELSE 0 END AS t FROM evt WHERE tick % 19 <> 0))"
#: Pairs of incidents: saved ones in turn take the nearest that is not taken; used holds what is.
PAIRS = f"""{GRP}, {EV2}, {_second_run(GRP)},
cand AS MATERIALIZED (SELECT a.asset_id, a.incident_id AS saved_id, b.incident_id AS fresh_id, b.start_tick - a.start_tick AS delta FROM inc a JOIN inc2 b ON a.asset_id = b.asset_id AND abs(b.start_tick - a.start_tick) <= 5 AND list_has_any(a.channels, b.channels)),
sv AS MATERIALIZED (SELECT asset_id, saved_id, row_number() OVER (PARTITION BY asset_id ORDER BY saved_id) AS r FROM (SELECT DISTINCT asset_id, saved_id FROM cand)),
tk AS (SELECT DISTINCT asset_id, 0::BIGINT AS r, []::BIGINT[] AS used, NULL::BIGINT AS saved_id, NULL::BIGINT AS fresh_id, NULL::BIGINT AS delta FROM cand UNION ALL
SELECT asset_id, r, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.f) END, saved_id, b.f, b.d FROM (SELECT tk.asset_id, sv.r, tk.used, sv.saved_id, min({{'a': abs(c.delta), 'f': c.fresh_id, 'd': c.delta}}) FILTER (NOT list_contains(tk.used, c.fresh_id)) AS b
FROM tk JOIN sv ON sv.asset_id = tk.asset_id AND sv.r = tk.r + 1 JOIN cand c ON c.asset_id = sv.asset_id AND c.saved_id = sv.saved_id GROUP BY tk.asset_id, sv.r, tk.used, sv.saved_id)),
pr AS (SELECT asset_id, saved_id, fresh_id, delta FROM tk WHERE fresh_id IS NOT NULL)"""


@query("inc9_diff_incidents", f"WITH RECURSIVE {PAIRS} SELECT i.asset_id, i.incident_id AS saved_id, fresh_id, delta FROM inc i LEFT JOIN pr ON pr.asset_id = i.asset_id AND pr.saved_id = i.incident_id UNION ALL SELECT asset_id, NULL, incident_id, NULL FROM inc2 WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.asset_id = inc2.asset_id AND pr.fresh_id = inc2.incident_id)")
def inc9(spark, sf):
    return incidents.diff_incidents(_found(spark, sf)[1], incidents.spans(incidents.group_incidents(_again(spark, sf))))


@query("inc10_diff_evidence", f"""WITH RECURSIVE {PAIRS}, ea AS (SELECT e.asset_id, p.saved_id, channel, leg, tick, observed, threshold FROM evi e JOIN pr p ON p.asset_id = e.asset_id AND p.saved_id = e.incident_id), eb AS (SELECT e.asset_id, p.saved_id, channel, leg, tick, observed, threshold FROM evi2 e JOIN pr p ON p.asset_id = e.asset_id AND p.fresh_id = e.incident_id),
j AS (SELECT asset_id, saved_id, channel, ea.observed IS NULL AS n, eb.observed IS NULL AS o, abs(ea.observed - eb.observed) > 1e-6 * greatest(abs(ea.observed), abs(eb.observed), 1) AS d FROM ea FULL JOIN eb USING (asset_id, saved_id, channel, leg, tick)),
g AS (SELECT asset_id, saved_id, channel, count(*) FILTER (n) AS added, count(*) FILTER (o) AS removed, count(*) FILTER (NOT n AND NOT o AND d) AS changed, count(*) FILTER (NOT n) AS a FROM j GROUP BY ALL)
SELECT asset_id, saved_id, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(changed)::BIGINT AS changed, count(*) FILTER (a = 0) AS new_channels FROM g GROUP BY ALL""")
def inc10(spark, sf):
    a, b = incidents.group_incidents(events(spark, sf)), incidents.group_incidents(_again(spark, sf))
    return incidents.diff_evidence(incidents.diff_incidents(incidents.spans(a), incidents.spans(b)), a, b)


@query("inc7_investigate")
def inc7(spark, sf):
    """Incidents of the fleet; each asset's first 192 ticks are its baseline."""
    return replay.investigate(fleet(spark, sf), 192)["incidents"].withColumn("channels", F.array_join("channels", ","))


@query("leg10_hybrid_monitor")
def leg10(spark, sf):
    return round_all(guard.hybrid_monitor(fleet(spark, sf)))


@query("leg11_multi_rate_monitor")
def leg11(spark, sf):
    """Every reading alone, in the order that it comes in; missing ones never come."""
    r = fleet(spark, sf)
    return round_all(guard.multi_rate_monitor(r.where("tick >= 192 AND value IS NOT NULL"), r.where("tick < 192")))


@query("leg12_autopilot")
def leg12(spark, sf):
    return round_all(guard.autopilot(fleet(spark, sf)))


@query("leg15_guard")
def leg15(spark, sf):
    return guard.guard(fleet(spark, sf))[1]


_CAL12 = f"""WITH {FC}, {_PTHR}, fp AS (SELECT k, c, t, v AS y, lag(v) OVER (PARTITION BY k, c ORDER BY t) AS x FROM pf),
fa0 AS (SELECT k, c, CASE WHEN regr_sxx(y, x) > 1e-12 THEN regr_sxy(y, x) / regr_sxx(y, x) ELSE 0 END AS b, avg(x) AS mx, avg(y) AS my FROM fp WHERE x IS NOT NULL GROUP BY k, c),
fa AS (SELECT k, c, b, my - b * mx AS a, greatest(sqrt(avg(pow(y - (my - b * mx + b * x), 2))), 1e-9) AS sd FROM fp JOIN fa0 USING (k, c) WHERE x IS NOT NULL GROUP BY k, c, b, mx, my),
fr AS (SELECT k, c, t, (y - (a + b * x)) / sd AS z FROM fp JOIN fa USING (k, c) WHERE x IS NOT NULL),
aw AS (SELECT k, unnest(range(0, m - 95, 2)) // 2 AS w FROM fm), ax AS (SELECT pf.k || '|' || c || '|' || w AS k, t - w * 2 AS t, v FROM pf JOIN aw ON pf.k = aw.k AND t BETWEEN w * 2 AND w * 2 + 95), {DFA('ax', 'ad')},
al AS (SELECT split_part(k, '|', 1) AS k, split_part(k, '|', 2) AS c, split_part(k, '|', 3)::BIGINT AS w, alpha FROM ad), ast AS (SELECT k, c, avg(alpha) AS am, greatest(stddev_pop(alpha), 1e-6) AS asd FROM al GROUP BY k, c),
rd AS (SELECT k, c, t - 96 AS i, abs(r - m) AS score FROM (SELECT k, c, t, avg(v) OVER (PARTITION BY k, c ORDER BY t ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS r FROM pf) JOIN fst USING (k, c) WHERE t >= 96), {GUMBEL('rd', 'rt', 'k, c', '1e6')},
ri AS (SELECT k, c, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY k, c ORDER BY t) AS i FROM (SELECT k, c, t, v, lag(v) OVER (PARTITION BY k, c ORDER BY t) AS p FROM pf)), rn AS (SELECT k, c, max(n) AS max_run FROM (SELECT k, c, i, count(*) AS n FROM ri GROUP BY k, c, i) GROUP BY k, c),
zx AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, max(abs(z)) AS score FROM fr GROUP BY k, t), {GUMBEL('zx', 'zt', 'k', '1e6')},
cw AS (SELECT k, c, t, sum(z - 1) OVER w AS u, sum(-z - 1) OVER w AS d FROM fr WINDOW w AS (PARTITION BY k, c ORDER BY t)), cp AS (SELECT k, c, t, greatest(u - least(0, min(u) OVER w), d - least(0, min(d) OVER w)) AS s FROM cw WINDOW w AS (PARTITION BY k, c ORDER BY t)),
cx AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, max(s) AS score FROM cp GROUP BY k, t), {GUMBEL('cx', 'ct', 'k', '1e6')},
dx AS (SELECT k, w AS i, max(abs(alpha - am) / asd) AS score FROM al JOIN ast USING (k, c) GROUP BY k, w), {GUMBEL('dx', 'dt', 'k', '5e5')}
SELECT k AS asset_id, c AS channel, round(a, 6) AS ar_a, round(b, 6) AS ar_b, round(fa.sd, 6) AS ar_sd, round(am, 6) AS alpha_mean, round(asd, 6) AS alpha_sd, round(fst.m, 6) AS mean, round(greatest(rt.threshold, 1e-9), 6) AS roll_thr, max_run, max_run <= 4 AS repeat_enabled,
round(frs.sd, 6) AS recon_sd, round(r2, 6) AS recon_r2, round(zt.threshold, 6) AS res_thr, round(greatest(ct.threshold, {siegmund_threshold()!r}), 6) AS cusum_thr, round(dt.threshold, 6) AS dfa_thr, round(fpt.threshold, 6) AS parity_thr
FROM fa JOIN ast USING (k, c) JOIN fst USING (k, c) JOIN rt USING (k, c) JOIN rn USING (k, c) JOIN frs USING (k, c) JOIN zt USING (k) JOIN ct USING (k) JOIN dt USING (k) JOIN fpt USING (k)"""


@query("cal12_calibrate", _CAL12)
def cal12(spark, sf):
    return round_all(guard.calibrate(fleet(spark, sf)))


_FIELDS = ["ar_a", "ar_b", "ar_sd", "alpha_mean", "alpha_sd", "mean", "roll_thr", "max_run", "recon_sd", "recon_r2", "res_thr", "cusum_thr", "dfa_thr", "parity_thr"]


def _UNPIVOTED(source: str) -> str:  # noqa: N802
    return f"SELECT asset_id, channel, unnest([{', '.join(repr(f) for f in _FIELDS)}]) AS field, unnest([{', '.join(f + '::DOUBLE' for f in _FIELDS)}]) AS v FROM ({source})"


_EXACT = _CAL12.replace(", 6) AS", ", 15) AS")
_QUARTER = _EXACT.replace("least(n, greatest(least(n // 3, 100000), 192)) AS m", "least(n, greatest(192, n // 4)) AS m")


@query("inc11_diff_calibration", f"""WITH sa AS ({_UNPIVOTED(_EXACT)}), fh AS ({_UNPIVOTED(_QUARTER)})
SELECT asset_id, channel, field, round(sa.v, 6) AS saved, round(fh.v, 6) AS fresh FROM sa FULL JOIN fh USING (asset_id, channel, field) WHERE (sa.v IS NULL) <> (fh.v IS NULL) OR abs(sa.v - fh.v) > 1e-6 * greatest(abs(sa.v), abs(fh.v), 1)""")
def inc11(spark, sf):
    """The fleet calibrated on a third of each asset, against a quarter."""
    r = fleet(spark, sf)
    return settled(incidents.diff_calibration(guard.calibrate(r), guard.calibrate(r, lambda n: max(192, n // 4))))


def settled(df):
    """Doubles rounded as the SQL does: to 15 digits, so that a tie of the seventh (means of hundredths over 192 ticks) is one
    whatever the order of the sum, then to six."""
    return round_all(round_all(df, 15))


@query("cal13_self_check")
def cal13(spark, sf):
    """Assets whose prefix is too short for two halves of 768 are not checked, and say so."""
    return guard.self_check(fleet(spark, sf), lambda n: min(n, 1600))


#: Both charts over the rest mx(c, t, v, m, sd), value by value.
CHARTS = f"""{R}, mx AS MATERIALIZED (SELECT c, t, v, m, sd FROM mf JOIN (SELECT c, avg(v) AS m, stddev_pop(v) AS sd FROM pf GROUP BY c) USING (c)),
ew AS (SELECT c, t, 0.2 * v + 0.8 * m AS z FROM mx WHERE t = 0 UNION ALL SELECT mx.c, mx.t, 0.2 * v + 0.8 * z FROM ew JOIN mx ON mx.c = ew.c AND mx.t = ew.t + 1),
ewh AS (SELECT c, t FROM ew JOIN mx USING (c, t) WHERE abs(z - m) > 3 * sd * sqrt(0.2 / 1.8)),
cu AS (SELECT c, t, greatest(0, v - m - 0.5 * sd) AS u, greatest(0, m - v - 0.5 * sd) AS d, 5 * sd AS h FROM mx WHERE t = 0 UNION ALL
SELECT mx.c, mx.t, greatest(0, CASE WHEN greatest(u, d) > h THEN 0 ELSE u END + v - m - 0.5 * sd), greatest(0, CASE WHEN greatest(u, d) > h THEN 0 ELSE d END + m - v - 0.5 * sd), h FROM cu JOIN mx ON mx.c = cu.c AND mx.t = cu.t + 1),
cuh AS (SELECT c, t FROM cu WHERE greatest(u, d) > h)"""


@query("leg19_ewma_chart", f"WITH RECURSIVE {CHARTS} SELECT 'events' AS asset_id, c AS channel, t AS tick, 'ewma' AS leg FROM ewh")
def leg19(spark, sf):
    _, p, m = frames(spark, sf)
    return guard.ewma_chart(m, p)


@query("leg20_cusum_chart", f"WITH RECURSIVE {CHARTS} SELECT 'events' AS asset_id, c AS channel, t AS tick, 'cusum_chart' AS leg FROM cuh")
def leg20(spark, sf):
    _, p, m = frames(spark, sf)
    return guard.cusum_chart(m, p)


@query("snk1_events_json", f"WITH {EVT} SELECT asset_id, tick, length('{{\"asset_id\":\"' || asset_id || '\",\"tick\":' || tick || ',\"kind\":\"' || kind || '\",\"channel\":\"' || channel || '\"}}') AS bytes FROM evt")
def snk1(spark, sf):
    from ..sources import sinks

    return events(spark, sf).select("asset_id", "tick", F.length(sinks.event_json(["asset_id", "tick", "kind", "channel"])).cast("long").alias("bytes"))


@query("snk4_content_fingerprint")
def snk4(spark, sf):
    return replay.content_fingerprint(recording(spark, sf), ["asset_id", "channel"])


@query("snk4_portable_fingerprint", f"""WITH {EV}, h AS (SELECT k, md5(t || '|' || coalesce((round(v * 1000000))::BIGINT::VARCHAR, 'none')) AS h FROM ev)
SELECT k AS series_id, count(*) AS rows, (sum(('0x' || substr(h, 1, 8))::BIGINT))::BIGINT AS total, bit_xor(('0x' || substr(h, 9, 8))::BIGINT) AS mixed FROM h GROUP BY k""")
def snk4_portable(spark, sf):
    return replay.portable_fingerprint(event_series(spark, sf), ["series_id"])
