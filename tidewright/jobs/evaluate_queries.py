"""Queries of evaluation (EVA) and of the forecast pipeline (AR)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate, forecast, grammar, guard, legs, prepare
from ..sources.shared import stored
from .incident_queries import CHARTS
from .monitor_queries import ALARMS, GRAMMAR, LIMIT, alarms, frames
from .registry import DFA, EV, FLEET, event_series, fleet, query, round_all, table

#: Labelled windows made from the error events of a high value: asset, label, [start, end], category.
LAB = "lab AS (SELECT 'a' || user_id % 7 AS asset_id, event_id AS label_id, event_id AS start, event_id + 40 AS end, 'c' || event_id % 3 AS category FROM events WHERE event_type = 'error' AND value > 150)"
SMP = "smp AS (SELECT 'a' || user_id % 7 AS asset_id, 'c' || (user_id % 7) % 2 AS category, count(*) AS n FROM events GROUP BY ALL)"
K = ["asset_id"]


def labels(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error' AND value > 150")
    return e.select(F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("asset_id"), F.col("event_id").alias("label_id"), F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("end"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("category"))


def samples(spark, sf):
    u = F.col("user_id") % 7
    return table(spark, sf, "events").groupBy(F.concat(F.lit("a"), u.cast("string")).alias("asset_id"), F.concat(F.lit("c"), (u % 2).cast("string")).alias("category")).agg(F.count("*").alias("n"))


@query("eva1_alarm_episodes", f"WITH {ALARMS}, g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY asset_id ORDER BY tick) AS g FROM am) SELECT asset_id, tick, leg FROM g WHERE g IS NULL OR g >= 50")
def eva1(spark, sf):
    return evaluate.alarm_episodes(alarms(spark, sf), K).select("asset_id", "tick", "leg")


@query("eva2_refractory_alarms", f"""WITH RECURSIVE {ALARMS}, k(asset_id, tick) AS (SELECT asset_id, min(tick) FROM am GROUP BY 1 UNION ALL
SELECT asset_id, nxt FROM (SELECT k.asset_id, (SELECT min(a.tick) FROM am a WHERE a.asset_id = k.asset_id AND a.tick >= k.tick + 100) AS nxt FROM k) WHERE nxt IS NOT NULL) SELECT asset_id, tick FROM k""")
def eva2(spark, sf):
    return evaluate.refractory_alarms(alarms(spark, sf), K)


_CAUGHT = "ca AS (SELECT asset_id, count(*) AS caught FROM lab WHERE EXISTS (SELECT 1 FROM am WHERE am.asset_id = lab.asset_id AND tick BETWEEN start AND lab.end) GROUP BY 1), fa AS (SELECT asset_id, count(*) AS f FROM am WHERE NOT EXISTS (SELECT 1 FROM lab WHERE am.asset_id = lab.asset_id AND tick BETWEEN start AND lab.end) GROUP BY 1), tw AS (SELECT asset_id, count(*) AS w FROM lab GROUP BY 1)"


@query("eva3_window_detection", f"WITH {ALARMS}, {LAB}, {SMP}, {_CAUGHT} SELECT category, count(*) AS series, sum(coalesce(w, 0))::BIGINT AS windows, sum(coalesce(caught, 0))::BIGINT AS caught, sum(coalesce(f, 0))::BIGINT AS false_alarms, round(1000 * sum(coalesce(f, 0)) / sum(n), 6) AS per_1000 FROM smp LEFT JOIN tw USING (asset_id) LEFT JOIN ca USING (asset_id) LEFT JOIN fa USING (asset_id) GROUP BY ROLLUP (category)")
def eva3(spark, sf):
    return round_all(evaluate.window_detection(alarms(spark, sf), labels(spark, sf).drop("category"), samples(spark, sf), "asset_id"))


@query("eva4_leg_breakdown", f"WITH {ALARMS}, {LAB}, f AS (SELECT leg, count(*) AS f FROM am WHERE NOT EXISTS (SELECT 1 FROM lab WHERE am.asset_id = lab.asset_id AND tick BETWEEN start AND lab.end) GROUP BY 1) SELECT leg, count(*) AS alarms, coalesce(max(f), 0) AS false_alarms FROM am LEFT JOIN f USING (leg) GROUP BY leg")
def eva4(spark, sf):
    return evaluate.leg_breakdown(alarms(spark, sf), labels(spark, sf), "asset_id")


@query("eva5_top_false_alarm_series", f"WITH {ALARMS} SELECT asset_id, count(*) AS false_alarms FROM am WHERE leg = 'dfa' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def eva5(spark, sf):
    return evaluate.top_false_alarm_series(alarms(spark, sf).where("leg = 'dfa'"), "asset_id")


_PRED = "pr AS (SELECT 'a' || user_id % 7 AS asset_id, event_id - 15 AS start, event_id + 15 AS end FROM events WHERE event_type = 'view' AND value > 120)"


@query("eva6_sequence_detection", f"""WITH {LAB}, {_PRED}, h AS (SELECT *, EXISTS (SELECT 1 FROM pr WHERE pr.asset_id = lab.asset_id AND pr.start <= lab.end AND pr.end >= lab.start) AS hit FROM lab),
f AS (SELECT asset_id AS g, count(*) AS fal FROM pr WHERE NOT EXISTS (SELECT 1 FROM lab WHERE pr.asset_id = lab.asset_id AND pr.start <= lab.end AND pr.end >= lab.start) GROUP BY ROLLUP (asset_id)),
r AS (SELECT asset_id, category, count(*) AS labels, count(*) FILTER (hit) AS hits FROM h GROUP BY ROLLUP (asset_id, category)),
p AS (SELECT r.*, coalesce(fal, 0) AS false_alarms, hits / nullif(hits + coalesce(fal, 0), 0) AS precision, hits / labels AS recall FROM r LEFT JOIN f ON r.asset_id IS NOT DISTINCT FROM f.g)
SELECT asset_id, category, labels, hits, false_alarms, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1 FROM p""")
def eva6(spark, sf):
    p = table(spark, sf, "events").where("event_type = 'view' AND value > 120").select(F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("asset_id"), (F.col("event_id") - 15).alias("start"), (F.col("event_id") + 15).alias("end"))
    return round_all(evaluate.sequence_detection(p, labels(spark, sf), "asset_id", ["asset_id", "category"]))


_SCORED = "sc AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, toxic AS label, quality FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"), "quality")


@query("eva7_timestep_confusion", f"WITH {_SCORED}, n AS (SELECT count(*) FILTER (score > 1500 AND label = 1) AS tp, count(*) FILTER (score > 1500 AND label <> 1) AS fp, count(*) FILTER (score <= 1500 AND label = 1) AS fn, count(*) FILTER (score <= 1500 AND label <> 1) AS tn FROM sc) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS false_rate FROM n")
def eva7(spark, sf):
    return round_all(evaluate.timestep_confusion(scored(spark, sf), 1500.0))


@query("eva7_event_latency", f"WITH {ALARMS}, {LAB}, h AS (SELECT l.asset_id, label_id, min(tick) - min(start) AS latency FROM lab l JOIN am ON am.asset_id = l.asset_id AND tick >= start AND tick < l.end + 21 AND observed > 30 GROUP BY 1, 2) SELECT lab.asset_id, lab.label_id, latency, latency IS NOT NULL AS detected FROM lab LEFT JOIN h USING (asset_id, label_id)")
def eva7_latency(spark, sf):
    return evaluate.event_latency(alarms(spark, sf).withColumn("score", F.col("observed")), labels(spark, sf), "asset_id", 30.0, 20)


@query("eva8_score_threshold_quantile", f"WITH {_SCORED}, r AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) AS r, count(*) OVER (PARTITION BY label) AS n FROM sc) SELECT label, score AS threshold FROM r WHERE r = least(floor(n * 0.99), n - 1) + 1")
def eva8(spark, sf):
    return evaluate.score_quantile(scored(spark, sf), ["label"])


@query("eva9_robust_train_z", f"WITH {_SCORED}, f AS (SELECT quality, median(score) AS m, stddev_samp(score) AS s FROM sc WHERE id % 2 = 0 AND label = 0 GROUP BY quality) SELECT quality, id, round(coalesce(abs(score - m) / nullif(s, 0), 0), 6) AS z FROM sc LEFT JOIN f USING (quality)")
def eva9(spark, sf):
    s = scored(spark, sf).select("quality", "id", F.col("score").alias("f"), (F.col("id") % 2 == 0).alias("train"), (F.col("label") == 0).alias("nominal"))
    return round_all(evaluate.robust_train_z(s, ["quality"]).select("quality", "id", "z"))


@query("eva10_auc_roc", f"WITH {_SCORED} SELECT a.quality, round(sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM sc a JOIN sc b ON a.quality = b.quality AND a.label = 1 AND b.label = 0 GROUP BY a.quality")
def eva10(spark, sf):
    return round_all(evaluate.auc_roc(scored(spark, sf), ["quality"]))


@query("eva11_auc_pr", f"WITH {_SCORED}, g AS (SELECT quality, score, sum(label) AS p, count(*) AS n FROM sc GROUP BY ALL), c AS (SELECT quality, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY quality ORDER BY score DESC)) SELECT quality, round(sum(p * cp / cn) / sum(p), 6) AS auc_pr FROM c GROUP BY quality")
def eva11(spark, sf):
    return round_all(evaluate.auc_pr(scored(spark, sf), ["quality"]))


@query("eva12_bootstrap_auc")
def eva12(spark, sf):
    return round_all(evaluate.bootstrap_auc(scored(spark, sf), ["quality"]))


def _AUC(src: str, by: str, score: str) -> str:  # noqa: N802
    return f"SELECT {by}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {by}, {score} AS s, sum(label * w) AS pos, sum((1 - label) * w) AS neg FROM {src} GROUP BY ALL)) GROUP BY {by}"


_DRAWS = " + ".join(f"(u >= {int(c * 2**32)})::INT" for c in evaluate.POISSON)


@query("eva12_paired_bootstrap", f"""WITH sc AS (SELECT doc_id AS id, n_chars::DOUBLE AS score_a, len(text) - len(replace(text, ' ', ''))::DOUBLE AS score_b, toxic AS label, quality FROM labels JOIN documents USING (doc_id)),
dr AS (SELECT *, {_DRAWS} AS w FROM (SELECT *, ('0x' || substr(md5('42|' || rep || '|' || id), 1, 8))::BIGINT AS u FROM sc, (SELECT unnest(range(1, 201)) AS rep))),
ra AS ({_AUC("(SELECT * FROM dr WHERE w > 0)", "quality, rep", "score_a")}), rb AS ({_AUC("(SELECT * FROM dr WHERE w > 0)", "quality, rep", "score_b")}),
rd AS (SELECT quality, ra.auc - rb.auc AS d FROM ra JOIN rb USING (quality, rep) WHERE ra.auc IS NOT NULL AND rb.auc IS NOT NULL),
iv AS (SELECT quality, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, count(*) AS used FROM rd GROUP BY quality),
wa AS ({_AUC("(SELECT *, 1 AS w FROM sc)", "quality", "score_a")}), wb AS ({_AUC("(SELECT *, 1 AS w FROM sc)", "quality", "score_b")})
SELECT quality, round(wa.auc, 6) AS a, round(wb.auc, 6) AS b, round(wa.auc - wb.auc, 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, coalesce(used, 0) AS used FROM wa JOIN wb USING (quality) LEFT JOIN iv USING (quality) WHERE wa.auc IS NOT NULL AND wb.auc IS NOT NULL""")
def eva12_paired(spark, sf):
    """Which tells toxic documents better: their length or their number of blanks."""
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score_a"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("double").alias("score_b"))
    rows = table(spark, sf, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), "score_a", "score_b", F.col("toxic").alias("label"), "quality")
    return round_all(evaluate.bootstrap_difference(rows, ["quality"]))


@query("eva13_group_medians_corr", f"WITH {_SCORED} SELECT quality, label, round(median(score), 6) AS median, round(corr(score, id), 6) AS r FROM sc GROUP BY ALL")
def eva13(spark, sf):
    return round_all(scored(spark, sf).groupBy("quality", "label").agg(F.median("score").alias("median"), F.corr("score", "id").alias("r")))


_LOC = f"{EV}, d AS (SELECT k, t, abs(v - lag(v) OVER (PARTITION BY k ORDER BY t)) AS d, v FROM ev), f AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM ev WHERE t < 500 GROUP BY k), z AS (SELECT d.k, t, d, abs(v - m) / greatest(s, 1e-12) AS z FROM d JOIN f USING (k) WHERE t >= 500)"


def _located(spark, sf):
    s = event_series(spark, sf).withColumn("train_end", F.lit(500))
    return evaluate.locate_anomaly(s, "series_id", "train_end")


@query("eva14_locate_anomaly", f"WITH {_LOC} SELECT k AS series_id, (SELECT t + 1 FROM z y WHERE y.k = z.k ORDER BY d DESC, t LIMIT 1) AS by_difference, (SELECT t + 1 FROM z y WHERE y.k = z.k ORDER BY z DESC, t LIMIT 1) AS by_value FROM z GROUP BY k")
def eva14(spark, sf):
    return _located(spark, sf)


@query("eva15_location_hit", f"WITH {_LOC}, p AS (SELECT k, t + 1 AS location FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY z DESC, t) AS r FROM z) WHERE r = 1), n AS (SELECT k, count(*) AS n FROM ev GROUP BY k) SELECT count(*) AS series, count(*) FILTER (location BETWEEN n // 2 - 400 AND n // 2 + 400) AS hits, count(*) FILTER (location IS NULL) AS none, round(count(*) FILTER (location BETWEEN n // 2 - 400 AND n // 2 + 400) / count(*), 6) AS accuracy, round(avg(least(1, 801 / (n - 500))), 6) AS by_chance FROM n LEFT JOIN p USING (k)")
def eva15(spark, sf):
    n = event_series(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    truth = n.select("series_id", "n", F.expr("n div 2 - 300").alias("begin"), F.expr("n div 2 + 300").alias("end"), F.lit(500).alias("train_end"))
    return round_all(evaluate.location_hit(_located(spark, sf).select("series_id", F.col("by_value").alias("location")), truth, "series_id"))


@query("eva16_mcnemar_exact", f"WITH {_SCORED}, h AS (SELECT score > 2000 AS a, quality = 1 AND score > 900 AS b FROM sc WHERE label = 1), c AS (SELECT count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (b AND NOT a) AS y FROM h) SELECT x AS only_a, y AS only_b, round(CASE WHEN x + y = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2e0))) FROM (SELECT unnest(range(0, least(x, y) + 1)) AS i))) END, 6) AS p FROM c")
def eva16(spark, sf):
    s = scored(spark, sf).where("label = 1").select((F.col("score") > 2000).alias("a"), ((F.col("quality") == 1) & (F.col("score") > 900)).alias("b"))
    return round_all(evaluate.mcnemar_exact(s))


@query("eva17_shift_p_value", f"WITH {_SCORED} SELECT count(*) FILTER (label = 1) AS shifts, round((1 + count(*) FILTER (label = 1 AND score >= 3000)) / (1 + count(*) FILTER (label = 1)), 6) AS p FROM sc")
def eva17(spark, sf):
    s = scored(spark, sf).select(F.lit(3000.0).alias("observed"), F.when(F.col("label") == 1, F.col("score")).alias("shifted"))
    return round_all(evaluate.shift_p_value(s))


@query("eva18_delay_stats", f"WITH {ALARMS}, f AS (SELECT asset_id, min(tick) FILTER (leg = 'dfa') AS a, 20 AS c FROM am GROUP BY 1), d AS (SELECT a - c AS d FROM f) SELECT count(*) FILTER (d < 0) AS early, count(*) FILTER (d >= 0) AS detected, (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM d WHERE d >= 0) WHERE r = n // 2 + 1) AS median_delay FROM d")
def eva18(spark, sf):
    f = alarms(spark, sf).groupBy("asset_id").agg(F.min(F.when(F.col("leg") == "dfa", F.col("tick"))).alias("first_alarm")).withColumn("change", F.lit(20))
    return evaluate.delay_stats(f)


@query("eva19_isolation_score", f"WITH {ALARMS}, t AS (SELECT 'a' || i AS asset_id, 'error' AS channel, 2000 + 100 * i AS onset FROM (SELECT unnest(range(7)) AS i)) SELECT tick // 500 AS bin, count(*) FILTER (tick >= onset) AS detections, count(*) FILTER (NOT coalesce(tick >= onset, false)) AS false_alarms FROM am LEFT JOIN t USING (asset_id, channel) GROUP BY 1")
def eva19(spark, sf):
    t = spark.range(7).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("asset_id"), F.lit("error").alias("channel"), (2000 + 100 * F.col("id")).alias("onset"))
    return evaluate.isolation_score(alarms(spark, sf), t)


@query("eva20_self_check_eval", f"WITH {ALARMS}, {LAB}, c AS (SELECT asset_id, min(tick) FILTER (observed > 120) AS first_alarm, 600 AS n FROM am GROUP BY 1) SELECT first_alarm IS NOT NULL AS warned, EXISTS (SELECT 1 FROM lab WHERE lab.asset_id = c.asset_id AND start < n) AS spoiled, count(*) AS n FROM c GROUP BY 1, 2")
def eva20(spark, sf):
    c = alarms(spark, sf).groupBy("asset_id").agg(F.min(F.when(F.col("observed") > 120, F.col("tick"))).alias("first_alarm")).withColumn("n", F.lit(600))
    return evaluate.self_check_table(c, labels(spark, sf))


@query("eva21_policy_search")
def eva21(spark, sf):
    """Three policies on every asset of the fleet: those with a planted fault have an onset, the others are clean."""
    r = fleet(spark, sf)
    last = r.groupBy("asset_id").agg((F.max("tick") + 1).alias("_n"))
    faulty = F.substring("asset_id", 2, 20).cast("long") % 4 < 2
    w = r.join(last, "asset_id").select(F.col("asset_id").alias("window_id"), "channel", "tick", "value", F.when(faulty, F.ceil(F.col("_n") * 3 / 4)).cast("long").alias("onset"), F.lit(192).alias("baseline"))
    return evaluate.policy_search(w, [("default", 1e6, 1.0), ("sensitive", 1e5, 1.0), ("slack", 1e6, 0.5)])


def fault_stretches(spark, sf):
    """Every asset of the fleet without gaps: labelled from three quarters on if a fault is planted there, else clean."""
    r = prepare.fill_gaps(fleet(spark, sf), ["asset_id", "channel"])
    n = F.max("tick").over(Window.partitionBy("asset_id", "channel")) + 1
    onset = F.ceil(n * 3 / 4).cast("long")
    faulty = F.substring("asset_id", 2, 20).cast("long") % 4 < 2
    return r.select("asset_id", "channel", "tick", "value", F.when(faulty, onset).alias("onset"), onset.alias("baseline"))


def fired_legs(w):
    """Which genes alarm on which of the stretches."""
    labelled = w.groupBy(F.col("asset_id").alias("window_id")).agg((F.count("onset") > 0).alias("labelled"))
    return stored(grammar.fired_on(grammar.leg_grammar(w), labelled))


def _LEG_ROUNDS(rounds: int) -> str:  # noqa: N802
    parts = [f"g{k} AS (SELECT gene, count(*) AS n FROM h WHERE " + (" AND ".join(f"id NOT IN (SELECT id FROM h JOIN g{j} USING (gene))" for j in range(k)) or "true") + " GROUP BY gene ORDER BY n DESC, gene LIMIT 1)" for k in range(rounds)]
    return ", ".join(parts) + ", al AS (" + " UNION ALL ".join(f"SELECT {k} AS round, gene, n FROM g{k}" for k in range(rounds)) + ")"


_STRETCHES = f"""{FLEET}, fm AS (SELECT k, ceil(n * 0.75)::BIGINT AS m FROM (SELECT k, max(t) + 1 AS n FROM fl GROUP BY k)),
fq AS (SELECT k, c, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k, c ORDER BY t), first_value(v IGNORE NULLS) OVER (PARTITION BY k, c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM fl),
pf AS MATERIALIZED (SELECT k, c, t, v FROM fq JOIN fm USING (k) WHERE t < m), mf AS MATERIALIZED (SELECT k, c, t - m AS t, v FROM fq JOIN fm USING (k) WHERE t >= m)"""


@query("eva21_leg_search", f"""WITH {GRAMMAR(_STRETCHES)}, fi AS (SELECT source || '/' || statistic || '/' || w || '/' || persistence AS gene, k AS id, substr(k, 2)::BIGINT % 4 < 2 AS labelled, bool_or(alarms > 0) AS a FROM gr GROUP BY ALL),
h AS (SELECT gene, id FROM fi WHERE labelled AND a AND gene NOT IN (SELECT gene FROM fi WHERE NOT labelled AND a)), {_LEG_ROUNDS(3)}
SELECT round, gene, (sum(n) OVER (ORDER BY round))::BIGINT AS detected, n AS gained, round((sum(n) OVER (ORDER BY round)) / (SELECT count(DISTINCT id) FROM fi WHERE labelled), 6) AS coverage FROM al""")
def eva21_legs(spark, sf):
    """Three rounds of legs that find planted faults and are quiet on clean assets."""
    return round_all(grammar.leg_search(fired_legs(fault_stretches(spark, sf)), 3))


@query("eva21_policy_rounds")
def eva21_rounds(spark, sf):
    """Two rounds of settings and legs on the same stretches."""
    w = fault_stretches(spark, sf)
    return round_all(evaluate.policy_rounds(w.withColumnRenamed("asset_id", "window_id"), fired_legs(w), rounds=2, mutations=3))


@query("eva22_detector_comparison", f"""WITH RECURSIVE {CHARTS}, {LIMIT}, b AS (SELECT 'ewma' AS detector, c, t FROM ewh UNION ALL SELECT 'cusum', c, t FROM cuh UNION ALL SELECT 'limit', c, t FROM lr WHERE r >= 3),
ep AS (SELECT detector, c, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY detector, c ORDER BY t) AS g FROM b) WHERE g IS NULL OR g >= 50), w AS (SELECT c, max(t) // 2 - 40 AS s, max(t) // 2 + 40 AS e FROM mf GROUP BY c),
x AS (SELECT detector, ep.c, t BETWEEN s AND e AS inside FROM ep JOIN w USING (c)), ca AS (SELECT detector, count(DISTINCT c) FILTER (inside) AS caught, count(*) FILTER (NOT inside) AS f FROM x GROUP BY detector)
SELECT detector, coalesce(caught, 0) AS caught, coalesce(f, 0) AS false_alarms, round(1000 * coalesce(f, 0) / (SELECT count(*) FROM mf), 6) AS per_1000 FROM (SELECT DISTINCT detector FROM b) LEFT JOIN ca USING (detector)""")
def eva22(spark, sf):
    _, p, m = frames(spark, sf)
    parts = {"limit": legs.limit_check(m, p), "ewma": guard.ewma_chart(m, p), "cusum": guard.cusum_chart(m, p)}
    both = None
    for name, d in parts.items():
        one = d.select(F.lit(name).alias("detector"), "channel", "tick")
        both = one if both is None else both.unionByName(one)
    lab = m.groupBy("channel").agg(F.max("tick").alias("n")).select("channel", F.lit(1).alias("label_id"), F.expr("n div 2 - 40").alias("start"), F.expr("n div 2 + 40").alias("end"))
    return round_all(evaluate.detector_comparison(both, lab, m.groupBy("channel").agg(F.count("*").alias("n")), "channel"))


S = ["series_id"]
_ERR = f"{EV}, er AS (SELECT k, t, abs(v - lag(v, 1, v) OVER (PARTITION BY k ORDER BY t)) AS e FROM ev)"


def errors(spark, sf):
    from .registry import event_series as series

    s = series(spark, sf)
    w = prepare.by_tick(S)
    return s.select("series_id", "tick", F.abs(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))).alias("e"))


def _RIDGE(p: int) -> str:  # noqa: N802
    """am(k, bias, w1 ... wp): the ridge autoregression of order p on the first 1000 values, its normal equations solved by
    elimination (the matrix is symmetric and positive, so no rows change places)."""
    one = range(1, p + 1)
    lags = ", ".join(f"lag((v - m) / s, {i}) OVER o AS x{i}" for i in one)
    sums = ", ".join([f"sum(x{i} * x{j}) + {'1e-4 * count(*)' if i == j else '0'} AS a{i}_{j}" for i in one for j in one if i <= j] + [f"sum(x{i} * y) AS b{i}" for i in one])
    steps = ""
    for k in one:
        kept = [f"a{i}_{j}" for i in one for j in one if i <= j and i <= k] + [f"b{i}" for i in one if i <= k]
        made = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in one for j in one if k < i <= j] + [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}" for i in one if i > k]
        steps += f", g{k} AS (SELECT k, {', '.join(kept + made)} FROM g{k - 1})"
    for k in reversed(one):
        rest = "".join(f" - a{k}_{j} * w{j}" for j in one if j > k)
        steps += f", s{k} AS (SELECT *, (b{k}{rest}) / a{k}_{k} AS w{k} FROM {f's{k + 1}' if k < p else f'g{p}'})"
    return f"""{EV}, tr AS (SELECT * FROM ev WHERE t < 1000), st AS (SELECT k, count(*) AS n, avg(v) AS m, greatest(stddev_pop(v), 1e-9) AS s FROM tr GROUP BY k),
lg AS (SELECT k, t, (v - m) / s AS y, {lags} FROM tr JOIN st USING (k) WINDOW o AS (PARTITION BY k ORDER BY t)), g0 AS (SELECT k, {sums} FROM lg WHERE t >= {p} GROUP BY k){steps},
am AS (SELECT k, {', '.join(f'w{i}' for i in one)}, m * (1 - {' - '.join(f'w{i}' for i in one)}) AS bias FROM s1 JOIN st USING (k) WHERE n >= {3 * p + 10})"""


@query("ar1_fit_ar_ridge", f"WITH {_RIDGE(5)} SELECT k AS series_id, 5 AS p, round(bias, 6) AS bias, unnest([0, 1, 2, 3, 4]) AS lag, round(unnest([w1, w2, w3, w4, w5]), 6) AS weight FROM am")
def ar1(spark, sf):
    m = forecast.ar_models(event_series(spark, sf).where("tick < 1000"), S, 5)
    return round_all(m.select("series_id", "p", "bias", F.posexplode("weights").alias("lag", "weight")))


_AR3 = f"""{EV}, tr AS (SELECT * FROM ev WHERE t < 1000), st AS (SELECT k, count(*) AS n, avg(v) AS m, greatest(stddev_pop(v), 1e-9) AS s FROM tr GROUP BY k),
lg AS (SELECT k, t, (v - m) / s AS y, lag((v - m) / s, 1) OVER o AS x1, lag((v - m) / s, 2) OVER o AS x2, lag((v - m) / s, 3) OVER o AS x3 FROM tr JOIN st USING (k) WINDOW o AS (PARTITION BY k ORDER BY t)),
g AS (SELECT k, sum(x1 * x1) + 1e-4 * count(*) AS a, sum(x1 * x2) AS b, sum(x1 * x3) AS c, sum(x2 * x2) + 1e-4 * count(*) AS d, sum(x2 * x3) AS e, sum(x3 * x3) + 1e-4 * count(*) AS f, sum(x1 * y) AS p, sum(x2 * y) AS q, sum(x3 * y) AS r FROM lg WHERE t >= 3 GROUP BY k),
dt AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g),
ar AS (SELECT k, (p * (d * f - e * e) - b * (q * f - r * e) + c * (q * e - r * d)) / det AS w1, (a * (q * f - r * e) - p * (b * f - c * e) + c * (b * r - c * q)) / det AS w2, (a * (d * r - e * q) - b * (b * r - c * q) + p * (b * e - c * d)) / det AS w3 FROM dt),
am AS (SELECT k, w1, w2, w3, m * (1 - w1 - w2 - w3) AS bias FROM ar JOIN st USING (k) WHERE n >= 19)"""


@query("ar1_fit_ar_ridge_3", f"WITH {_AR3} SELECT k AS series_id, 3 AS p, round(bias, 6) AS bias, unnest([0, 1, 2]) AS lag, round(unnest([w1, w2, w3]), 6) AS weight FROM am")
def ar1_three(spark, sf):
    m = forecast.ar_models(event_series(spark, sf).where("tick < 1000"), S, 3)
    return round_all(m.select("series_id", "p", "bias", F.posexplode("weights").alias("lag", "weight")))


@query("ar2_select_ar_order")
def ar2(spark, sf):
    return forecast.ar_models(event_series(spark, sf).where("tick < 1000"), S).select("series_id", "p")


def _said(p: int) -> str:
    return "bias + " + " + ".join(f"w{i} * x{i}" for i in range(1, p + 1))


#: Both orders are fitted on the first four fifths of the first 1000 values and forecast the rest.
_ORDERS = f"""{EV}, cu AS (SELECT k, count(*) AS n, count(*) * 4 // 5 AS cut FROM ev WHERE t < 1000 GROUP BY k),
{', '.join(f"m{p} AS (WITH {_RIDGE(p).replace('tr AS (SELECT * FROM ev WHERE t < 1000)', 'tr AS (SELECT ev.* FROM ev JOIN cu USING (k) WHERE t < cut)')} SELECT * FROM am)" for p in (3, 5))},
tl AS (SELECT k, t - cut AS t, v, {', '.join(f'lag(v, {i}) OVER o AS x{i}' for i in range(1, 6))}, count(*) OVER (PARTITION BY k) AS c FROM ev JOIN cu USING (k) WHERE t >= cut AND t < 1000 WINDOW o AS (PARTITION BY k ORDER BY t)),
ms AS ({' UNION ALL '.join(f"SELECT k, {p} AS p, sum(CASE WHEN t >= {p} THEN (v - ({_said(p)})) ** 2 ELSE 0 END) / any_value(c) AS mse FROM tl JOIN m{p} USING (k) GROUP BY k" for p in (3, 5))}),
od AS (SELECT cu.k, n, coalesce(p, 5) AS p FROM cu LEFT JOIN (SELECT k, p FROM ms QUALIFY row_number() OVER (PARTITION BY k ORDER BY mse, p) = 1) AS b ON b.k = cu.k)"""


@query("ar2_select_ar_order_3_5", f"WITH {_ORDERS} SELECT k AS series_id, p FROM od WHERE n >= 3 * p + 10")
def ar2_two(spark, sf):
    return forecast.ar_models(event_series(spark, sf).where("tick < 1000"), S, orders=(3, 5)).select("series_id", "p")


@query("ar3_ar_residuals", f"WITH {_AR3}, al AS (SELECT k, t, v, lag(v, 1) OVER o AS x1, lag(v, 2) OVER o AS x2, lag(v, 3) OVER o AS x3 FROM ev WINDOW o AS (PARTITION BY k ORDER BY t)) SELECT k AS series_id, t AS tick, round(CASE WHEN t < 3 THEN 0 ELSE abs(v - (bias + w1 * x1 + w2 * x2 + w3 * x3)) END, 6) AS e FROM al JOIN am USING (k)")
def ar3(spark, sf):
    s = event_series(spark, sf)
    return round_all(forecast.ar_residuals(s, forecast.ar_models(s.where("tick < 1000"), S, 3), S, 3))


@query("ar4_ewma", f"WITH RECURSIVE {_ERR}, w AS (SELECT k, t, e FROM er WHERE t = 0 UNION ALL SELECT er.k, er.t, er.e * 2 / 31 + w.e * 29 / 31 FROM w JOIN er ON er.k = w.k AND er.t = w.t + 1) SELECT k AS series_id, t AS tick, round(e, 6) AS e FROM w")
def ar4(spark, sf):
    return round_all(forecast.ewma(errors(spark, sf), S, 30))


@query("ar5_rolling_variance", f"WITH {EV} SELECT k AS series_id, t AS tick, round(CASE WHEN t < 30 THEN 0 ELSE var_pop(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END, 4) AS variance FROM ev")
def ar5(spark, sf):
    return round_all(forecast.rolling_variance(event_series(spark, sf), S, 30), 4)


_EPS = """st AS (SELECT k, avg(e) AS m, greatest(stddev_pop(e), 1e-12) AS s FROM er GROUP BY k), gr AS (SELECT 1e0 + i * 0.5 AS z FROM (SELECT unnest(range(23)) AS i)),
cd AS (SELECT er.k, z, m + z * s AS eps, m, s, e, lag(e) OVER (PARTITION BY er.k, z ORDER BY t) AS p FROM er JOIN st USING (k) CROSS JOIN gr),
ag AS (SELECT k, z, eps, m, s, count(*) FILTER (e >= eps) AS n, count(*) FILTER (e >= eps AND (p IS NULL OR p < eps)) AS r, avg(e) FILTER (e < eps) AS bm, stddev_pop(e) FILTER (e < eps) AS bs FROM cd GROUP BY k, z, eps, m, s),
bs AS (SELECT k, eps FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(((m - bm) / m + (s - bs) / s) / (n + r * r), 9) DESC, z) AS q FROM ag WHERE n > 0) WHERE q = 1), ep AS (SELECT st.k, coalesce(eps, m + 12 * s) AS eps FROM st LEFT JOIN bs USING (k))"""


@query("ar6_find_epsilon", f"WITH {_ERR}, {_EPS} SELECT k AS series_id, round(eps, 6) AS eps FROM ep")
def ar6(spark, sf):
    return round_all(forecast.find_epsilon(errors(spark, sf), S, 1.0))


_SEQ = """ab AS (SELECT er.k, t, e >= eps AS a FROM er JOIN ep USING (k)), la AS (SELECT k, max(t) AS z FROM er GROUP BY k), ru AS (SELECT k, min(t) AS s, max(t) AS e FROM (SELECT k, t, t - row_number() OVER (PARTITION BY k ORDER BY t) AS g FROM ab WHERE a) GROUP BY k, g),
wi AS (SELECT k, greatest(s - 5, 0) AS s, CASE WHEN e = z THEN e ELSE least(e + 5, z) END AS e FROM ru JOIN la USING (k)), fa AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM wi),
gp AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fa), sq AS (SELECT k, min(s) AS s, max(e) AS e FROM gp GROUP BY k, g)"""


@query("ar7_anomaly_sequences", f"WITH {_ERR}, {_EPS}, {_SEQ} SELECT k AS series_id, s AS start, e AS end FROM sq")
def ar7(spark, sf):
    e = errors(spark, sf)
    return forecast.anomaly_sequences(e, forecast.find_epsilon(e, S, 1.0), S, 5)


_CUT = """tp AS (SELECT sq.k, s, sq.e AS z, max(er.e) AS top FROM sq JOIN er ON er.k = sq.k AND t BETWEEN s AND sq.e GROUP BY 1, 2, 3),
ou AS (SELECT er.k, max(er.e) AS o FROM er WHERE NOT EXISTS (SELECT 1 FROM sq WHERE sq.k = er.k AND t BETWEEN s AND sq.e) GROUP BY 1), nx AS (SELECT *, coalesce(lead(top) OVER (PARTITION BY k ORDER BY top DESC, s), greatest(o, 0), 0) AS nxt FROM tp LEFT JOIN ou USING (k)),
cu AS (SELECT *, max((CASE WHEN top > 1e-12 THEN (top - nxt) / top ELSE 0 END < 0.03)::INT) OVER (PARTITION BY k ORDER BY top DESC, s ROWS UNBOUNDED PRECEDING) AS c FROM nx)"""


@query("ar8_prune_sequences", f"WITH {_ERR}, {_EPS}, {_SEQ}, {_CUT} SELECT k AS series_id, s AS start, z AS end, round(top, 6) AS top FROM cu WHERE c = 0")
def ar8(spark, sf):
    e = errors(spark, sf)
    return round_all(forecast.prune_sequences(e, forecast.anomaly_sequences(e, forecast.find_epsilon(e, S, 1.0), S, 5), S, 0.03))


def _train_test(spark, sf):
    s = event_series(spark, sf)
    v = F.when(F.col("tick").between(1500, 1560), F.col("value") + 150).otherwise(F.col("value"))
    return s.where("tick < 1000"), s.where("tick >= 1000").select("series_id", (F.col("tick") - 1000).alias("tick"), v.alias("value"))


@query("ar9_detect_forecast_anomalies")
def ar9(spark, sf):
    return forecast.detect_forecast_anomalies(*_train_test(spark, sf), S)


#: Errors er(k, t, e) of the second part by five lags: smoothed, and raised by what the variance of the last ones exceeds that of the first part.
_FORECAST = f"""{EV}, am AS (WITH {_RIDGE(5)} SELECT * FROM am), pa AS (SELECT 'a' AS q, k, t, v FROM ev WHERE t < 1000 UNION ALL SELECT 'b', k, t - 1000, CASE WHEN t BETWEEN 1500 AND 1560 THEN v + 150 ELSE v END FROM ev WHERE t >= 1000),
sz AS (SELECT k, least(greatest(count(*) // 30, 10), 300) AS span FROM pa WHERE q = 'b' GROUP BY k HAVING count(*) > 5),
ft AS (SELECT q, k, t, span, CASE WHEN t < 5 THEN 0 ELSE abs(v - (bias + {' + '.join(f'w{i} * lag(v, {i}) OVER o' for i in range(1, 6))})) END AS e FROM pa JOIN am USING (k) JOIN sz USING (k) WINDOW o AS (PARTITION BY q, k ORDER BY t)),
wd AS MATERIALIZED (SELECT q, k, t, span, e, CASE WHEN t < greatest(span, 20) THEN 0 ELSE var_pop(e) OVER (PARTITION BY q, k ORDER BY t ROWS BETWEEN greatest(span, 20) - 1 PRECEDING AND CURRENT ROW) END AS r FROM ft),
sm AS (SELECT q, k, t, span, e, r FROM wd WHERE t = 0 UNION ALL SELECT wd.q, wd.k, wd.t, wd.span, (wd.e * 2 + sm.e * (wd.span - 1)) / (wd.span + 1), (wd.r * 2 + sm.r * (wd.span - 1)) / (wd.span + 1) FROM sm JOIN wd ON wd.q = sm.q AND wd.k = sm.k AND wd.t = sm.t + 1),
kn AS (SELECT k, avg(r) AS m, greatest(stddev_pop(r), 1e-12) AS s FROM sm WHERE q = 'a' AND t >= 5 GROUP BY k),
er0 AS MATERIALIZED (SELECT k, t, e + greatest((r - m) / s, 0) * s * 0.3 AS e FROM sm JOIN kn USING (k) WHERE q = 'b')"""


#: The whole series and its stretches of 2100 ticks are one table of series er(k, t, e); sequences of both are merged and pruned.
_BOTH = f"""{_FORECAST}, lt AS (SELECT k, (t - 5) // 2100 AS g, (t - 5) % 2100 AS t, e, count(*) OVER (PARTITION BY k, (t - 5) // 2100) AS n FROM er0 WHERE t >= 5),
er AS MATERIALIZED (SELECT k || '|all' AS k, t, e FROM er0 WHERE t >= 5 UNION ALL SELECT k || '|' || g, t, e FROM lt WHERE n >= 200),
md AS (SELECT k, list_sort(list(e))[count(*) // 2 + 1] AS med FROM lt GROUP BY k), fl AS (SELECT k, any_value(med) + 3 * 1.4826 * list_sort(list(abs(e - med)))[count(*) // 2 + 1] AS floor FROM lt JOIN md USING (k) GROUP BY k),
{_EPS.replace('1e0 + i', '2.5e0 + i').replace('range(23)', 'range(20)').replace('ep AS (', 'e0 AS (')}, ep AS (SELECT e0.k, CASE WHEN e0.k LIKE '%|all' THEN eps ELSE greatest(eps, floor) END AS eps FROM e0 JOIN fl ON fl.k = split_part(e0.k, '|', 1)),
{_SEQ.replace('s - 5', 's - 50').replace('e + 5', 'e + 50')}, ps AS (SELECT split_part(k, '|', 1) AS k, s + o AS s, e + o AS e FROM (SELECT *, CASE WHEN k LIKE '%|all' THEN 0 ELSE 5 + 2100 * TRY_CAST(split_part(k, '|', 2) AS BIGINT) END AS o FROM sq)),
pf AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ps), pg AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM pf),
one AS (SELECT k, min(s) AS s, max(e) AS e FROM pg GROUP BY k, g)"""


@query("ar9_detect_forecast_anomalies_5", f"WITH RECURSIVE {_BOTH} SELECT * FROM (WITH sq AS (SELECT * FROM one), er AS (SELECT * FROM er0), {_CUT.replace('< 0.03', '< 0.13')} SELECT k AS series_id, s AS start, z AS end FROM cu WHERE c = 0)")
def ar9_five(spark, sf):
    return forecast.detect_forecast_anomalies(*_train_test(spark, sf), S, 5)


#: Exponents of the last 96 values every 8 ticks, of both parts, as distances er(k, t, e) of the second from the first.
_ALPHAS = f"""{EV}, pa AS (SELECT 'a' AS p, k, t, v FROM ev WHERE t < 1000 UNION ALL SELECT 'b', k, t - 1000, CASE WHEN t BETWEEN 1500 AND 1560 THEN v + 150 ELSE v END FROM ev WHERE t >= 1000),
pn AS (SELECT p, k, count(*) AS n FROM pa GROUP BY ALL), pw AS (SELECT p, k, unnest(range(0, n - 95, 8)) // 8 AS w FROM pn WHERE n >= CASE p WHEN 'a' THEN 288 ELSE 96 END),
wr AS (SELECT p || '|' || k || '|' || w AS k, t - w * 8 AS t, v FROM pa JOIN pw USING (p, k) WHERE t BETWEEN w * 8 AND w * 8 + 95), {DFA('wr', 'd')},
al AS (SELECT split_part(k, '|', 1) AS p, split_part(k, '|', 2) AS k, split_part(k, '|', 3)::BIGINT AS w, alpha FROM d), kn AS (SELECT k, avg(alpha) AS m, greatest(stddev_pop(alpha), 1e-6) AS s FROM al WHERE p = 'a' GROUP BY k),
er AS MATERIALIZED (SELECT k, w AS t, abs(alpha - m) / s AS e FROM al JOIN kn USING (k) WHERE p = 'b')"""


@query("ar10_detect_alpha_anomalies", f"WITH {_ALPHAS}, {_EPS.replace('1e0 + i', '4e0 + i').replace('range(23)', 'range(17)')}, {_SEQ.replace('s - 5', 's - 6').replace('e + 5', 'e + 6')}, {_CUT.replace('< 0.03', '< 0.13')} SELECT cu.k AS series_id, s * 8 AS start, least(z * 8 + 95, n - 1) AS end FROM cu JOIN pn ON pn.k = cu.k AND p = 'b' WHERE c = 0")
def ar10(spark, sf):
    return forecast.detect_alpha_anomalies(*_train_test(spark, sf), S)
