"""Queries of preparation (PRE1 to PRE24)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import prepare
from .registry import DAY, EV, REC, US, daily_orders, event_series, query, recording, round_all, table

K = ["series_id"]
C = ["channel"]
#: Series with holes: values over 150 are NaN, those of every 17th tick infinite, of every 11th null.
HOLES = f"{EV}, ho AS (SELECT k, t, CASE WHEN v > 150 THEN 'nan'::DOUBLE WHEN t % 17 = 0 THEN 'inf'::DOUBLE WHEN t % 11 = 0 THEN NULL ELSE v END AS v FROM ev), hg AS (SELECT k, t, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN NULL ELSE v END AS v FROM ho)"


def holes(spark, sf):
    v = F.when(F.col("value") > 150, float("nan")).when(F.col("tick") % 17 == 0, float("inf")).when(F.col("tick") % 11 == 0, None).otherwise(F.col("value"))
    return event_series(spark, sf).withColumn("value", v)


@query("pre1_sanitize", f"WITH {HOLES} SELECT k AS series_id, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS tick, round(v, 6) AS value FROM hg WHERE v IS NOT NULL")
def pre1(spark, sf):
    return round_all(prepare.sanitize(holes(spark, sf), K))


@query("pre2_validity", f"WITH {HOLES} SELECT k AS series_id, t AS tick, v IS NOT NULL AS valid FROM hg")
def pre2(spark, sf):
    return prepare.validity(holes(spark, sf)).select("series_id", "tick", "valid")


@query("pre3_fill_gaps", f"WITH {HOLES} SELECT k AS series_id, t AS tick, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t), first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS value FROM hg")
def pre3(spark, sf):
    return round_all(prepare.fill_gaps(holes(spark, sf), K))


@query("pre4_impute_calibration", f"WITH {HOLES} SELECT k AS series_id, round(avg(v), 6) AS mean, count(*) FILTER (v IS NULL) AS imputed, count(*) AS n, avg(v) IS NULL OR count(*) FILTER (v IS NULL) > 0.2 * count(*) AS rejected FROM hg WHERE t < 300 GROUP BY k")
def pre4(spark, sf):
    return round_all(prepare.impute_calibration(holes(spark, sf), K, 300)[1])


@query("pre4_imputed_series", f"WITH {HOLES}, m AS (SELECT k, avg(v) AS m FROM hg WHERE t < 300 GROUP BY k) SELECT k AS series_id, t AS tick, round(coalesce(v, m), 6) AS value FROM hg JOIN m USING (k) WHERE t < 300")
def pre4_series(spark, sf):
    return round_all(prepare.impute_calibration(holes(spark, sf), K, 300)[0].where("tick < 300"))


@query("pre5_data_quality", f"WITH {HOLES}, q AS (SELECT k, count(*) AS n, count(*) FILTER (v IS NULL) AS bad FROM hg GROUP BY k) SELECT k AS series_id, n, bad, round(100.0 * bad / n, 6) AS bad_pct, CASE WHEN n = bad THEN 'FAIL empty' WHEN n - bad < 20 THEN 'WARN <20' WHEN n - bad < 64 THEN 'WARN <64' ELSE 'OK' END AS readiness FROM q")
def pre5(spark, sf):
    return round_all(prepare.data_quality(holes(spark, sf), K))


@query("pre6_assign_ticks", f"WITH {US} SELECT k AS series_id, t AS tick, round(v, 6) AS value FROM us")
def pre6(spark, sf):
    return round_all(event_series(spark, sf, "user_id"))


_CAL = "least(n, greatest(least(n // 3, 100000), 192))"


@query("pre7_calibration_split", f"WITH {EV}, n AS (SELECT k, count(*) AS n FROM ev GROUP BY k), c AS (SELECT k, n, {_CAL} AS d, greatest(least(greatest(round(n * 0.15)::BIGINT, 768), n - 1), 192) AS e, least(floor(n * 0.3)::BIGINT, 5000) AS p FROM n) SELECT k AS series_id, n, d AS by_default, e AS by_evaluation, p AS by_playground FROM c")
def pre7(spark, sf):
    n = event_series(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", *[prepare.calibration_length(F.col("n"), r).cast("long").alias(f"by_{r}") for r in ("default", "evaluation", "playground")])


@query("pre7_calibration_rows", f"WITH {EV}, n AS (SELECT k, count(*) AS n FROM ev GROUP BY k) SELECT k AS series_id, count(*) FILTER (t < {_CAL}) AS healthy, count(*) FILTER (t >= {_CAL}) AS monitored FROM ev JOIN n USING (k) GROUP BY k")
def pre7_rows(spark, sf):
    s = prepare.calibration_split(event_series(spark, sf), K)
    return s.groupBy("series_id").agg(F.count_if("calibration").alias("healthy"), F.count_if(~F.col("calibration")).alias("monitored"))


_RUNS = "r AS (SELECT k, t, t - row_number() OVER (PARTITION BY k ORDER BY t) AS g FROM ev WHERE v <= 100), l AS (SELECT k, g, min(t) AS a, count(*) AS n FROM r GROUP BY k, g)"


@query("pre8_first_clean_block", f"WITH {EV}, {_RUNS} SELECT k AS series_id, min(a) AS start FROM l WHERE n >= 8 GROUP BY k")
def pre8(spark, sf):
    s = event_series(spark, sf).withColumn("label", (F.col("value") > 100).cast("int"))
    return prepare.first_clean_block(s, K, 8)


@query("pre9_log_returns", f"WITH {DAY}, b AS (SELECT k, t, v, lag(v) OVER (ORDER BY t) AS p FROM od) SELECT k AS series_id, t - 1 AS tick, round(CASE WHEN p > 0 THEN ln(v / p) ELSE 0 END, 6) AS value FROM b WHERE t > 0")
def pre9(spark, sf):
    return round_all(prepare.log_returns(daily_orders(spark, sf), K))


_TIMES = "ti AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, epoch(ts) AS v FROM events)"


def event_times(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("value"))
    return prepare.assign_ticks(e, K, ["ts", "event_id"]).select("series_id", "tick", "value")


@query("pre10_inter_event_intervals", f"WITH {_TIMES}, d AS (SELECT k, t, abs(v - lag(v) OVER (PARTITION BY k ORDER BY t)) AS d FROM ti) SELECT k AS series_id, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS tick, round(d, 3) AS value FROM d WHERE d > 0")
def pre10(spark, sf):
    return prepare.inter_event_intervals(event_times(spark, sf), K).withColumn("value", F.round("value", 3))


@query("pre11_nn_intervals", """WITH b AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, event_id * 7 AS sample, event_id % 5 AS code FROM events),
d AS (SELECT k, t, (sample - lag(sample) OVER w) / 100.0 AS v, code <> 0 AND lag(code) OVER w <> 0 AS ok FROM (SELECT k, t, sample, (code <> 0)::INT AS code FROM b) WINDOW w AS (PARTITION BY k ORDER BY t))
SELECT k AS series_id, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS tick, round(v, 6) AS value FROM d WHERE ok AND v BETWEEN 0.3 AND 2.0""")
def pre11(spark, sf):
    b = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", (F.col("event_id") * 7).alias("sample"), (F.col("event_id") % 5 != 0).cast("int").alias("code"))
    return round_all(prepare.nn_intervals(prepare.assign_ticks(b, K, ["ts", "event_id"]), K, 100.0))


@query("pre12_first_difference", f"WITH {EV} SELECT k AS series_id, t AS tick, round(coalesce(v - lag(v) OVER (PARTITION BY k ORDER BY t), 0), 6) AS value FROM ev")
def pre12(spark, sf):
    return round_all(prepare.first_difference(event_series(spark, sf), K))


@query("pre14_gc_windows", """WITH b AS (SELECT doc_id AS k, unnest(range(length(text))) AS pos, upper(unnest(string_split(text, ''))) AS base FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT k, pos // 100 AS w, count(*) AS n, count(*) FILTER (base IN ('G', 'C')) AS gc, count(*) FILTER (base IN ('A', 'T')) AS ta FROM b GROUP BY ALL)
SELECT k AS series_id, row_number() OVER (PARTITION BY k ORDER BY w) - 1 AS tick, round(gc / (gc + ta), 6) AS value FROM w WHERE n = 100 AND gc + ta > 0""")
def pre14(spark, sf):
    """Letters of all documents that have an id as a symbol stream."""
    bases = table(spark, sf, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("series_id"), F.posexplode(F.split("text", "")).alias("pos", "base"))
    return round_all(prepare.gc_windows(bases, K, 100))


_HOLD = """e AS (SELECT event_type AS k, floor(epoch(ts))::BIGINT AS ts, event_id, value AS v FROM events WHERE value IS NOT NULL),
u AS (SELECT k, ts, max_by(v, event_id) AS v FROM e GROUP BY k, ts)"""


def seconds(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), F.unix_timestamp("ts").alias("ts"), "event_id", "value")
    return e.groupBy("series_id", "ts").agg(F.max_by("value", "event_id").alias("value"))


@query("pre15_resample_hold", f"""WITH {_HOLD}, s AS (SELECT k, (min(ts) // 3600) * 3600 AS a, ceil(max(ts) / 3600)::BIGINT * 3600 AS b, min_by(v, ts) AS first FROM u GROUP BY k),
g AS (SELECT k, first, unnest(range(a, b + 1, 3600)) AS ts FROM s), l AS (SELECT k, ceil(ts / 3600)::BIGINT * 3600 AS ts, max_by(v, ts) AS v FROM u GROUP BY ALL)
SELECT g.k AS series_id, g.ts, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY g.k ORDER BY g.ts), first), 6) AS value FROM g LEFT JOIN l ON g.k = l.k AND g.ts = l.ts""")
def pre15(spark, sf):
    return round_all(prepare.resample_hold(seconds(spark, sf), K, 3600))


@query("pre16_apply_interval_labels", f"""WITH {_HOLD}, lab AS (SELECT event_type AS k, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + 7200 AS b, event_id AS o, (event_id % 3 + 1)::INT AS code FROM events WHERE value > 150),
h AS (SELECT u.k, u.ts, max_by(code, o) AS code FROM u JOIN lab ON u.k = lab.k AND u.ts BETWEEN a AND b GROUP BY ALL)
SELECT u.k AS series_id, u.ts, coalesce(code, 0) AS code FROM u LEFT JOIN h ON u.k = h.k AND u.ts = h.ts""")
def pre16(spark, sf):
    e = table(spark, sf, "events").where("value > 150")
    lab = e.select(F.col("event_type").alias("series_id"), F.unix_timestamp("ts").alias("start"), (F.unix_timestamp("ts") + 7200).alias("end"), F.col("event_id").alias("label_order"), (F.col("event_id") % 3 + 1).cast("int").alias("code"))
    return prepare.apply_interval_labels(seconds(spark, sf).select("series_id", "ts"), lab, K).select("series_id", "ts", "code")


@query("pre17_restore_annotated", """WITH u AS (SELECT event_type AS k, floor(epoch(ts))::BIGINT AS ts, max_by(value, event_id) AS v, max_by((value > 120)::INT, event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY ALL),
b AS (SELECT k, (ts // 36000) * 36000 AS bin, count(*) AS n, max_by(l, ts) AS last, max(l) AS any_, max(ts) FILTER (l > 0) AS ats FROM u GROUP BY ALL),
f AS (SELECT b.k, bin + 36000 AS ts, v AS fv, l AS fl FROM b JOIN u ON u.k = b.k AND u.ts = ats WHERE n > 1 AND last = 0 AND any_ > 0),
g AS (SELECT k, bin AS ts, 0e0 AS v, 0 AS l FROM b)
SELECT g.k AS series_id, g.ts, round(coalesce(fv, g.v), 6) AS value, coalesce(fl, g.l)::INT AS label FROM g LEFT JOIN f ON g.k = f.k AND g.ts = f.ts""")
def pre17(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), F.unix_timestamp("ts").alias("ts"), "event_id", "value")
    u = e.groupBy("series_id", "ts").agg(F.max_by("value", "event_id").alias("value"), F.max_by((F.col("value") > 120).cast("int"), "event_id").alias("label"))
    grid = u.select("series_id", (F.floor(F.col("ts") / 36000) * 36000).alias("ts")).distinct().withColumn("value", F.lit(0.0)).withColumn("label", F.lit(0))
    return round_all(prepare.restore_annotated(u, grid, K, 36000))


@query("pre18_align_channels", f"""WITH {_HOLD}, c AS (SELECT 'a' AS asset, k AS channel, (ts // 21600) * 21600 AS ts, max_by(v, ts) AS v FROM u GROUP BY ALL),
s AS (SELECT asset, unnest(range(min(ts), max(ts) + 1, 21600)) AS ts FROM c GROUP BY asset),
f AS (SELECT s.asset, n.channel, s.ts, c.v FROM s JOIN (SELECT DISTINCT asset, channel FROM c) n USING (asset) LEFT JOIN c ON c.asset = s.asset AND c.channel = n.channel AND c.ts = s.ts)
SELECT asset AS asset_id, channel, ts, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY asset, channel ORDER BY ts), first_value(v IGNORE NULLS) OVER (PARTITION BY asset, channel ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM f""")
def pre18(spark, sf):
    c = seconds(spark, sf).groupBy(F.lit("a").alias("asset_id"), F.col("series_id").alias("channel"), (F.floor(F.col("ts") / 21600) * 21600).alias("ts2")).agg(F.max_by("value", "ts").alias("value"))
    return round_all(prepare.align_channels(c.withColumnRenamed("ts2", "ts"), ["asset_id"], 21600))


@query("pre19_time_split", f"WITH {_HOLD}, m AS (SELECT (min(ts) + max(ts)) // 2 AS m FROM u) SELECT k AS series_id, count(*) FILTER (ts <= m) AS train, count(*) FILTER (ts > m) AS test FROM u CROSS JOIN m GROUP BY k")
def pre19(spark, sf):
    u = seconds(spark, sf)
    m = u.agg(F.expr("(min(ts) + max(ts)) div 2")).first()[0]
    a, b = prepare.time_split(u, m)
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.groupBy("series_id").agg(F.count_if(F.col("side") == 0).alias("train"), F.count_if(F.col("side") == 1).alias("test"))


@query("pre20_compress_changes", f"WITH {EV}, b AS (SELECT k, t, floor(v / 50)::BIGINT AS v FROM ev), l AS (SELECT *, lag(v) OVER w AS p, lag(t) OVER w AS pt, lead(t) OVER w AS nt FROM b WINDOW w AS (PARTITION BY k ORDER BY t)) SELECT k AS series_id, t AS tick, v AS value FROM l WHERE pt IS NULL OR nt IS NULL OR v IS DISTINCT FROM p")
def pre20(spark, sf):
    s = event_series(spark, sf).withColumn("value", F.floor(F.col("value") / 50))
    return prepare.compress_changes(s, K)


@query("pre21_minmax_scale", f"WITH {HOLES}, l AS (SELECT k, min(v) AS a, max(v) AS b FROM hg GROUP BY k) SELECT k AS series_id, t AS tick, round(CASE WHEN v IS NOT NULL THEN CASE WHEN b > a THEN (v - a) / (b - a) ELSE 0 END END, 6) AS value FROM hg JOIN l USING (k)")
def pre21(spark, sf):
    return round_all(prepare.minmax_scale(holes(spark, sf), K))


@query("pre22_shuffle_series", f"WITH {EV} SELECT k AS series_id, count(*) AS n, round(sum(v), 4) AS total, min(t) AS first_tick, max(t) AS last_tick, true AS moved FROM ev GROUP BY k")
def pre22(spark, sf):
    """What a shuffle keeps: values and places, not their order."""
    s = event_series(spark, sf)
    both = prepare.shuffle_by_hash(s, K).join(s.withColumnRenamed("value", "was"), ["series_id", "tick"])
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), (F.count_if(F.col("value") == F.col("was")) < F.count("*") / 10).alias("moved"))


@query("pre23_time_shift_control", f"WITH {EV}, n AS (SELECT k, count(*) AS n FROM ev GROUP BY k) SELECT k AS series_id, (t + 137) % n AS tick, round(v, 6) AS value FROM ev JOIN n USING (k)")
def pre23(spark, sf):
    return round_all(prepare.time_shift(event_series(spark, sf), K, 137))


@query("pre24_series_diagnostics", f"""WITH e AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, floor(epoch(ts))::BIGINT AS ts, value AS v FROM events WHERE value IS NOT NULL),
d AS (SELECT k, t, v, ts - lag(ts) OVER w AS dt, v - lag(v) OVER w AS dv, lead(v) OVER w - v AS dn FROM e WINDOW w AS (PARTITION BY k ORDER BY t)),
m AS (SELECT k, dt AS i FROM (SELECT k, dt, row_number() OVER (PARTITION BY k ORDER BY dt) AS r, count(*) OVER (PARTITION BY k) AS m FROM d WHERE dt IS NOT NULL) WHERE r = m // 2 + 1),
s AS (SELECT k, stddev_pop(v) AS sd, count(*) AS n FROM d GROUP BY k)
SELECT k AS series_id, n, i AS interval, round(CASE WHEN i > 0 THEN 86400.0 / i END, 6) AS per_day, count(*) FILTER (abs(dv) < 1e-12) AS repeats, count(*) FILTER (dt > 1.5 * i) AS gaps, count(*) FILTER (abs(dv) > 6 * sd AND abs(dn) > 6 * sd AND dv * dn < 0) AS spikes
FROM d JOIN m USING (k) JOIN s USING (k) GROUP BY k, n, i""")
def pre24(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), F.unix_timestamp("ts").alias("sec"), "ts", "event_id", "value")
    s = prepare.assign_ticks(e, K, ["ts", "event_id"]).select("series_id", "tick", F.col("sec").alias("ts"), "value")
    return round_all(prepare.series_diagnostics(s, K))
