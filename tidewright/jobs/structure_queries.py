"""Queries of the structure measures (DFA1 to DFA22) over event, supplier and order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import prepare, structure
from .registry import ACR, BOXES, DAY, DFA, DFA_SHORT, EV, FIT, FLEET, HEALTH, LAW, PROFILE, REC, RSS, SIGNAL, SU, US, daily_orders, event_series, fleet, query, recording, round_all, supplier_series, table  # noqa: F401

K = ["series_id"]


@query("dfa1_box_sizes", f"""
WITH n AS (SELECT DISTINCT doc_id + 60 AS n FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT n, greatest(16, n // 50) AS a, n // 4 AS b FROM n), r AS (SELECT *, pow(b / a, 1e0 / 11e0) AS r FROM g WHERE a < b),
q AS (SELECT *, r4 * r4 AS r8 FROM (SELECT *, r2 * r2 AS r4 FROM (SELECT *, r * r AS r2 FROM r)))
SELECT DISTINCT n, s FROM (SELECT n, b, floor(a * unnest([1e0, r, r2, r * r2, r4, r * r4, r2 * r4, (r * r2) * r4, r8, r * r8, r2 * r8, (r * r2) * r8]))::BIGINT AS s FROM q) WHERE s <= b
""")
def dfa1(spark, sf):
    n = table(spark, sf, "documents").where("doc_id IS NOT NULL").select((F.col("doc_id") + 60).alias("n")).distinct()
    return n.select("n", F.explode(structure.box_sizes(F.col("n"))).alias("s"))


@query("dfa2_dfa", f"WITH {EV}, {DFA('ev', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dfa2(spark, sf):
    return round_all(structure.dfa(event_series(spark, sf), K))


@query("dfa2_dfa_many_series", f"WITH {SU}, {DFA('su', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dfa2_many(spark, sf):
    return round_all(structure.dfa(supplier_series(spark, sf), K))


_LONG = "lo AS (SELECT 'lineitem' AS k, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS t, l_quantity AS v FROM lineitem)"


@query("dfa2_dfa_long_series", f"WITH {_LONG}, {DFA('lo', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dfa2_long(spark, sf):
    """One series of all line items: places by range partitions and offsets, sums by pieces."""
    return round_all(structure.dfa(long_series(spark, sf), K, chunk=16384))


def long_series(spark, sf):
    """Ticks of one global order without one task that sees all rows: ordered by day first, so that a
    day's rows are counted before it and ranked within it."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").select("l_shipdate", *cols, F.col("l_quantity").alias("value"))
    from pyspark.sql import Window

    per_day = rows.groupBy("l_shipdate").agg(F.count("*").alias("c"))
    before = per_day.select("l_shipdate", F.coalesce(F.sum("c").over(Window.orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    inner = F.row_number().over(Window.partitionBy("l_shipdate").orderBy(*cols)) - 1
    return rows.withColumn("_i", inner).join(before, "l_shipdate").select(F.lit("lineitem").alias("series_id"), (F.col("_i") + F.col("_o")).alias("tick"), "value")


@query("dfa3_dfa_short", f"WITH {US}, {DFA_SHORT('us', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dfa3(spark, sf):
    return round_all(structure.dfa_short(event_series(spark, sf, "user_id"), K))


@query("dfa4_acr", f"WITH {SU}, {ACR('su', 'a')} SELECT k AS series_id, round(acr_alpha, 6) AS acr_alpha, round(acr_r2, 6) AS acr_r2 FROM a")
def dfa4(spark, sf):
    return round_all(structure.acr(supplier_series(spark, sf), K))


_LAWS = "round(mean, 4) AS mean, round(sd, 4) AS sd, round(kurtosis, 6) AS kurtosis, round(p99, 4) AS p99, round(max, 4) AS max, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(acr_alpha, 6) AS acr_alpha, round(acr_r2, 6) AS acr_r2, round(hurst, 6) AS hurst, quality"


@query("dfa5_analyze", f"WITH {EV}, {LAW('ev', 'w')} SELECT k AS series_id, n, {_LAWS} FROM w")
def dfa5(spark, sf):
    law = round_all(structure.analyze(event_series(spark, sf), K))
    return law.select("series_id", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "kurtosis", *[F.round(c, 4).alias(c) for c in ("p99", "max")], "alpha", "r2", "acr_alpha", "acr_r2", "hurst", "quality")


@query("dfa6_quality_reliable_healthy", f"WITH {SU}, {LAW('su', 'w')} SELECT k AS series_id, quality, r2 > 0.7 AS is_reliable, quality NOT IN ('Abstain', 'Insufficient') AS is_healthy FROM w")
def dfa6(spark, sf):
    law = structure.analyze(supplier_series(spark, sf), K)
    return law.select("series_id", "quality", verdicts.reliable(F.col("r2")).alias("is_reliable"), (~F.col("quality").isin("Abstain", "Insufficient")).alias("is_healthy"))


def MF(src: str, o: str) -> str:  # noqa: N802
    return f"""{PROFILE(src, o)},
{o}_r AS (SELECT *, pow(b / a, 1e0 / 7e0) AS r FROM (SELECT k, n, greatest(16, n // 50) AS a, n // 4 AS b FROM {o}_n) WHERE a < b),
{o}_s AS (SELECT DISTINCT k, n, s FROM (SELECT k, n, b, floor(a * pow(r, unnest([0e0, 1e0, 2e0, 3e0, 4e0, 5e0, 6e0, 7e0])))::BIGINT AS s FROM {o}_r) WHERE s <= b),
{o}_l AS (SELECT k, greatest(avg(y * y) * 1e-24, 1e-30) AS lowest FROM {o}_p GROUP BY k),
{o}_b AS (SELECT k, s, CASE WHEN f2 > lowest THEN f2 ELSE 1e-30 END AS f2 FROM ({BOXES(f"SELECT k, s, t // s AS box, t, y FROM {o}_p JOIN {o}_s USING (k, n) WHERE t < s * (n // s)", "k, s, box")}) JOIN {o}_l USING (k)),
{o}_g AS (SELECT unnest([-3e0, -1e0, 0e0, 1e0, 2e0, 3e0]) AS q),
{o}_f AS (SELECT k, q, s, avg(CASE WHEN q = 0 THEN ln(f2) / 2 ELSE pow(f2, q / 2) END) AS m FROM {o}_b CROSS JOIN {o}_g GROUP BY k, q, s),
{o}_h AS (SELECT k, q, s, CASE WHEN q = 0 THEN exp(m) ELSE pow(m, 1 / CASE WHEN q <> 0 THEN q END) END AS fq FROM {o}_f),
{o}_t AS (SELECT k, q, {FIT('x', 'y')} FROM (SELECT k, q, ln(s) AS x, ln(fq) AS y FROM {o}_h WHERE fq > 0) GROUP BY k, q),
{o}_a AS (SELECT k, q, CASE WHEN pts >= 3 THEN slope ELSE 0.5 END AS h, CASE WHEN pts >= 3 THEN r2 ELSE 0 END AS r2 FROM {o}_n CROSS JOIN {o}_g LEFT JOIN {o}_t USING (k, q)),
{o}_c AS (SELECT k, count(*) FILTER (r2 > 0.5) AS reliable, max(h) FILTER (r2 > 0.5) - min(h) FILTER (r2 > 0.5) AS w, max(h) FILTER (q = 2) AS h2 FROM {o}_a GROUP BY k),
{o} AS (SELECT k, CASE WHEN reliable >= 2 THEN w ELSE 0 END AS width, h2, reliable, CASE WHEN reliable >= 2 THEN w ELSE 0 END > 0.05 AND reliable >= 4 AS multifractal FROM {o}_c)"""


@query("dfa7_multifractal", f"WITH {EV}, {MF('ev', 'x')} SELECT k AS series_id, round(width, 6) AS width, round(h2, 6) AS h2, reliable, multifractal FROM x")
def dfa7(spark, sf):
    return round_all(structure.multifractal(event_series(spark, sf), K))


@query("dfa7_multifractal_points", f"WITH {EV}, {MF('ev', 'x')} SELECT k AS series_id, q, round(h, 6) AS h, round(r2, 6) AS r2 FROM x_a")
def dfa7_points(spark, sf):
    return round_all(structure.multifractal_points(event_series(spark, sf), K, (-3, -1, 0, 1, 2, 3)))


@query("dfa8_classify_signal", f"WITH {SU}, {DFA('su', 'd')} SELECT k AS series_id, round(alpha, 6) AS alpha, {SIGNAL} AS signal FROM d")
def dfa8(spark, sf):
    d = structure.dfa(supplier_series(spark, sf), K)
    return round_all(d.select("series_id", "alpha", verdicts.signal_class(F.col("alpha"), F.col("r2")).alias("signal")))


@query("dfa9_interpret_alpha", f"""WITH {SU}, {DFA('su', 'd')} SELECT k AS series_id, CASE WHEN alpha < 0.4 THEN 'anti-correlated / mean-reverting' WHEN alpha < 0.55 THEN 'uncorrelated / random'
WHEN alpha < 0.75 THEN 'weakly correlated' WHEN alpha < 1.05 THEN 'strongly correlated (1/f)' WHEN alpha < 1.4 THEN 'highly persistent' ELSE 'unbounded walk' END AS meaning FROM d""")
def dfa9(spark, sf):
    return structure.dfa(supplier_series(spark, sf), K).select("series_id", verdicts.meaning(F.col("alpha")).alias("meaning"))


def FP(src: str, o: str) -> str:  # noqa: N802
    return f"{LAW(src, o + 'w')}, {MF(src, o + 'm')}, {o} AS (SELECT k, n, alpha, r2, hurst, kurtosis, width, multifractal, {SIGNAL} AS signal FROM {o}w JOIN {o}m USING (k))"


@query("dfa10_fingerprint", f"WITH {EV}, {FP('ev', 'f')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(hurst, 6) AS hurst, round(kurtosis, 6) AS kurtosis, round(width, 6) AS width, multifractal, signal FROM f")
def dfa10(spark, sf):
    return round_all(structure.fingerprint(event_series(spark, sf), K))


_DIST = """p AS (SELECT a.k AS a, b.k AS b, sqrt(pow(a.alpha - b.alpha, 2) + pow(a.width - b.width, 2) + 0.1 * pow((a.kurtosis - b.kurtosis) / greatest(a.kurtosis, b.kurtosis, 1), 2) + pow(a.hurst - b.hurst, 2)) AS d
FROM f a JOIN f b ON a.k < b.k)"""
_SIM = "CASE WHEN d < 0.05 THEN 'near-identical' WHEN d < 0.2 THEN 'similar' ELSE 'different' END"


@query("dfa11_fingerprint_distance", f"WITH {EV}, rb AS (SELECT * FROM ev WHERE t < 700), rc AS (SELECT k, t - 700 AS t, v FROM ev WHERE t >= 700), {FP('rb', 'x')}, {FP('rc', 'f')}, p AS (SELECT a.k AS a, b.k AS b, sqrt(pow(a.alpha - b.alpha, 2) + pow(a.width - b.width, 2) + 0.1 * pow((a.kurtosis - b.kurtosis) / greatest(a.kurtosis, b.kurtosis, 1), 2) + pow(a.hurst - b.hurst, 2)) AS d FROM f a JOIN x b ON a.k = b.k) SELECT a, b, round(d, 6) AS distance, {_SIM} AS verdict FROM p")
def dfa11(spark, sf):
    """What a series is now against what it was in its first 700 values."""
    s = event_series(spark, sf)
    was = structure.fingerprint(s.where("tick < 700"), K)
    now = structure.fingerprint(s.where("tick >= 700").withColumn("tick", F.col("tick") - 700), K)
    return round_all(structure.fingerprint_distances(now, was, "series_id"))


@query("dfa11_similar_fingerprints", f"WITH {SU}, {FP('su', 'f')}, {_DIST} SELECT a, b, round(d, 6) AS distance, {_SIM} AS verdict FROM p WHERE d < 0.2")
def dfa11_near(spark, sf):
    """Pairs that are similar at least, met in bands of the exponent instead of all pairs."""
    return round_all(structure.similar_fingerprints(structure.fingerprint(supplier_series(spark, sf), K), "series_id", 0.2))


@query("dfa13_alpha_interval", f"""WITH {EV}, w AS (SELECT k, count(*) AS n, least(greatest(count(*) // 4, 64), count(*)) AS m FROM ev GROUP BY k),
st AS (SELECT k, i, m, CASE WHEN n > m THEN (i * (n - m)) // 19 ELSE 0 END AS a FROM w CROSS JOIN (SELECT unnest(range(20)) AS i)),
sub AS (SELECT ev.k || '|' || i AS k, t - a AS t, v FROM ev JOIN st ON ev.k = st.k AND t >= a AND t < a + m), {DFA('sub', 'x')}, {DFA('ev', 'd')},
s AS (SELECT split_part(k, '|', 1) AS k, count(*) AS used, stddev_samp(alpha) AS sd FROM x WHERE r2 > 0.3 GROUP BY 1)
SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(alpha - 1.96 * e, 6) AS low, round(alpha + 1.96 * e, 6) AS high, used, round(e, 6) AS se
FROM (SELECT d.*, coalesce(used, 0) AS used, CASE WHEN used >= 2 THEN sd ELSE 0 END AS e FROM d LEFT JOIN s USING (k))""")
def dfa13(spark, sf):
    return round_all(structure.alpha_interval(event_series(spark, sf), K))


_HALVES = "hn AS (SELECT k, count(*) // 2 AS h FROM ev GROUP BY k), hv AS (SELECT k || '|' || (CASE WHEN t >= h THEN 1 ELSE 0 END) AS k, CASE WHEN t >= h THEN t - h ELSE t END AS t, v FROM ev JOIN hn USING (k))"


@query("dfa14_split_half", f"""WITH {EV}, {_HALVES}, {DFA('hv', 'd')}, p AS (SELECT split_part(k, '|', 1) AS k, max(alpha) FILTER (k LIKE '%|0') AS a, max(alpha) FILTER (k LIKE '%|1') AS b FROM d GROUP BY 1)
SELECT k AS series_id, round(a, 6) AS first_alpha, round(b, 6) AS second_alpha, round(abs(a - b), 6) AS difference, abs(a - b) < 0.1 AS consistent FROM p""")
def dfa14(spark, sf):
    return round_all(structure.split_half(event_series(spark, sf), K))


@query("dfa15_health_verdict", f"""WITH {EV}, {_HALVES}, {DFA('hv', 'd')}, p AS (SELECT split_part(k, '|', 1) AS k, max(alpha) FILTER (k LIKE '%|1') - max(alpha) FILTER (k LIKE '%|0') AS s FROM d GROUP BY 1)
SELECT k AS series_id, round(s, 6) AS shift, {HEALTH.format('s')} AS verdict, CASE WHEN abs(s) < 0.1 * 0.375 THEN 'Healthy' WHEN abs(s) < 0.1 THEN 'Watch' WHEN abs(s) < 0.1 * 1.875 THEN 'Warning' ELSE 'Critical' END AS scaled FROM p""")
def dfa15(spark, sf):
    s = structure.split_half(event_series(spark, sf), K).withColumn("shift", F.col("second_alpha") - F.col("first_alpha"))
    return round_all(s.select("series_id", "shift", verdicts.health(F.col("shift")).alias("verdict"), verdicts.scaled_health(F.col("shift"), 0.1).alias("scaled")))


_HALF_LAWS = f"{EV}, {_HALVES}, h0 AS (SELECT split_part(k, '|', 1) AS k, t, v FROM hv WHERE k LIKE '%|0'), h1 AS (SELECT split_part(k, '|', 1) AS k, t, v FROM hv WHERE k LIKE '%|1'), {LAW('h0', 'a')}, {LAW('h1', 'b')}"
_COMPARED = f"c AS (SELECT a.k, a.alpha AS a0, b.alpha AS a1, b.alpha - a.alpha AS s, least(a.r2, b.r2) AS conf FROM a JOIN b USING (k))"


def _half_series(spark, sf):
    h = structure.halves(event_series(spark, sf), K)
    return [h.where(F.col("half") == i).drop("half") for i in (0, 1)]


@query("dfa16_compare", f"WITH {_HALF_LAWS}, {_COMPARED} SELECT k AS series_id, round(a0, 6) AS alpha_before, round(a1, 6) AS alpha_now, round(s, 6) AS shift, {HEALTH.format('s')} AS verdict, round(conf, 6) AS confidence, abs(s) >= 0.03 AS degraded, abs(s) > 0.01 AND conf > 0.5 AS changed FROM c")
def dfa16(spark, sf):
    a, b = _half_series(spark, sf)
    return round_all(structure.compare(structure.analyze(a, K), structure.analyze(b, K), K))


def _interval(src: str, o: str) -> str:
    return f"""{o}_w AS (SELECT k, count(*) AS n, least(greatest(count(*) // 4, 64), count(*)) AS m FROM {src} GROUP BY k),
{o}_i AS (SELECT k, i, m, CASE WHEN n > m THEN (i * (n - m)) // 19 ELSE 0 END AS a FROM {o}_w CROSS JOIN (SELECT unnest(range(20)) AS i)),
{o}_u AS (SELECT s.k || '|' || i AS k, t - a AS t, v FROM {src} s JOIN {o}_i i ON s.k = i.k AND t >= a AND t < a + m), {DFA(o + '_u', o + 'x')}, {DFA(src, o + 'z')},
{o}_e AS (SELECT split_part(k, '|', 1) AS k, CASE WHEN count(*) >= 2 THEN stddev_samp(alpha) ELSE 0 END AS se FROM {o}x WHERE r2 > 0.3 GROUP BY 1),
{o} AS (SELECT k, n, alpha, coalesce(se, 0) AS se FROM {o}z LEFT JOIN {o}_e USING (k) WHERE n >= 256)"""


@query("dfa17_compare_significance", f"""WITH {EV}, {_HALVES}, h0 AS (SELECT split_part(k, '|', 1) AS k, t, v FROM hv WHERE k LIKE '%|0'), h1 AS (SELECT split_part(k, '|', 1) AS k, t, v FROM hv WHERE k LIKE '%|1'), {_interval('h0', 'a')}, {_interval('h1', 'b')},
z AS (SELECT k, b.alpha - a.alpha AS s, sqrt(a.se * a.se + b.se * b.se) AS e FROM a JOIN b USING (k))
SELECT k AS series_id, round(s, 6) AS shift, round(CASE WHEN e > 0 THEN abs(s) / e END, 6) AS z, CASE WHEN e > 0 AND abs(s) / e >= 3 THEN 'significant' ELSE 'inconclusive' END AS finding FROM z""")
def dfa17(spark, sf):
    return round_all(structure.compare_significance(*_half_series(spark, sf), K))


@query("dfa18_alert", f"WITH {_HALF_LAWS}, {_COMPARED} SELECT k AS series_id, round(s, 6) AS shift, {HEALTH.format('s')} AS verdict FROM c WHERE abs(s) > 0.02")
def dfa18(spark, sf):
    a, b = _half_series(spark, sf)
    return round_all(structure.alert(structure.compare(structure.analyze(a, K), structure.analyze(b, K), K), 0.02).select("series_id", "shift", "verdict"))


@query("dfa21_conformal", """WITH u AS (SELECT event_type AS k, event_id AS id, value AS score FROM events WHERE value IS NOT NULL),
c AS (SELECT * FROM u WHERE id % 2 = 0), s AS (SELECT * FROM u WHERE id % 2 = 1),
p AS (SELECT s.k, s.id, s.score, (SELECT count(*) FROM c WHERE c.k = s.k AND c.score >= s.score) AS m, (SELECT count(*) FROM c WHERE c.k = s.k) AS n FROM s)
SELECT k AS series_id, id, round(score, 6) AS score, round((m + 1) / (n + 1), 6) AS p, (m + 1) / (n + 1) < 0.05 AS anomalous, round(1 - (m + 1) / (n + 1), 6) AS confidence FROM p""")
def dfa21(spark, sf):
    u = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return round_all(structure.conformal(u.where("id % 2 = 0").drop("id"), u.where("id % 2 = 1"), K))


@query("dfa21_conformal_threshold", """WITH u AS (SELECT event_type AS k, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT k AS series_id, round(v, 6) AS threshold FROM u WHERE r = least(floor(n * (1 - 0.05)), n - 1) + 1""")
def dfa21_threshold(spark, sf):
    u = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("series_id"), F.col("value").alias("score"))
    return round_all(structure.conformal_threshold(u, K))


@query("dfa22_time_to_threshold", f"""WITH {EV}, w AS (SELECT k, v, 500 - row_number() OVER (PARTITION BY k ORDER BY t DESC) AS x, count(*) OVER (PARTITION BY k) AS n FROM ev),
f AS (SELECT k, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, {RSS('v', 'x')} AS ss, regr_sxx(v, x) AS sxx FROM (SELECT k, v, x FROM w WHERE x >= 0 AND n >= 500) GROUP BY k),
g AS (SELECT *, sqrt(ss / 498 / greatest(sxx, 1e-12)) AS se, 200 - (a + b * 499) AS rest FROM f), h AS (SELECT *, abs(b) > se AND sign(rest) = sign(b) AS ok FROM g)
SELECT k AS series_id, round(CASE WHEN ok THEN rest / b END, 4) AS eta, round(CASE WHEN ok THEN least(rest / (b + se), rest / (b - se)) END, 4) AS eta_low, round(CASE WHEN ok THEN greatest(rest / (b + se), rest / (b - se)) END, 4) AS eta_high, round(b, 6) AS slope FROM h""")
def dfa22(spark, sf):
    t = structure.time_to_threshold(event_series(spark, sf), K, 500, 200.0)
    return t.select("series_id", *[F.round(c, 4).alias(c) for c in ("eta", "eta_low", "eta_high")], F.round("slope", 6).alias("slope"))


@query("dfa2_dfa_refined", f"WITH {FLEET}, sq AS (SELECT k, t, v FROM fl WHERE c = 'quantity'), {DFA('sq', 'x')} SELECT k AS asset_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM x")
def dfa2_refined(spark, sf):
    """Deliveries of every supplier, of which a fourth stay at one value from some tick on."""
    stuck = fleet(spark, sf).where("channel = 'quantity'").select("asset_id", "tick", "value")
    return round_all(structure.dfa(stuck, ["asset_id"], refine=True))
