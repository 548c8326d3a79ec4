"""Queries of windows and change points (WIN1 to WIN11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import prepare, windows
from .registry import DAY, DFA, EV, FIT, daily_orders, event_series, query, round_all, table
from .structure_queries import _LONG, long_series

K = ["series_id"]
#: Windows of 256 values every 64, and every 128, of the event series.
W64 = f"{EV}, wn AS (SELECT k, count(*) AS n FROM ev GROUP BY k), wi AS (SELECT k, unnest(range(0, n - 255, 64)) // 64 AS w FROM wn WHERE n >= 256), wr AS (SELECT ev.k || '|' || w AS k, t - w * 64 AS t, v FROM ev JOIN wi ON ev.k = wi.k AND t BETWEEN w * 64 AND w * 64 + 255), {DFA('wr', 'd')}, r AS (SELECT split_part(k, '|', 1) AS k, split_part(k, '|', 2)::BIGINT AS w, alpha, r2 FROM d)"
BASE = "b AS (SELECT k, avg(alpha) AS b, greatest(stddev_pop(alpha), 0.005) AS s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM r) WHERE w < least(greatest(n // 3, 3), n) GROUP BY k), sc AS (SELECT k, w, abs(alpha - b) / (s + 0.05) AS score FROM r JOIN b USING (k))"


def _rolled(spark, sf):
    return windows.rolling_alpha(event_series(spark, sf), K, 256, 64)


@query("win1_rolling_alpha", f"WITH {W64} SELECT k AS series_id, w, w * 64 + 255 AS end_tick, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM r")
def win1(spark, sf):
    return round_all(_rolled(spark, sf))


@query("win1_rolling_alpha_fast", f"WITH {W64} SELECT k AS series_id, w, w * 64 + 255 AS end_tick, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM r")
def win1_fast(spark, sf):
    return round_all(windows.rolling_alpha_fast(event_series(spark, sf), K, 256, 64))


@query("win2_anomaly_scores", f"WITH {W64}, {BASE} SELECT k AS series_id, w, round(score, 6) AS score FROM sc")
def win2(spark, sf):
    return round_all(windows.anomaly_scores(_rolled(spark, sf), K, 0.05))


@query("win3_row_scores", f"WITH {W64}, {BASE} SELECT ev.t AS tick, round(coalesce(max(score), 0), 6) AS score FROM (SELECT DISTINCT t FROM ev) ev LEFT JOIN sc ON t BETWEEN w * 64 AND w * 64 + 255 GROUP BY ev.t")
def win3(spark, sf):
    s = event_series(spark, sf)
    scores = windows.anomaly_scores(_rolled(spark, sf), K, 0.05).drop("series_id")
    return round_all(windows.row_scores(s, scores, [], 256, 64))


@query("win4_alpha_trend", f"""WITH {W64}, s AS (SELECT k, w, alpha, row_number() OVER (PARTITION BY k ORDER BY w) - 1 AS i FROM r WHERE r2 > 0.3),
f AS (SELECT k, {FIT('i', 'alpha')}, min_by(alpha, w) AS a, max_by(alpha, w) AS z FROM s GROUP BY k),
g AS (SELECT k, coalesce(pts, 0) AS used, CASE WHEN pts >= 3 THEN slope / 64 ELSE 0 END AS slope, CASE WHEN pts >= 3 THEN r2 ELSE 0 END AS r2, coalesce(a, 0.5) AS a, coalesce(z, 0.5) AS z FROM (SELECT DISTINCT k FROM r) LEFT JOIN f USING (k))
SELECT k AS series_id, used, round(slope, 8) AS slope, round(r2, 6) AS r2, CASE WHEN abs(slope) < 0.0001 THEN 'Stable' WHEN slope < 0 THEN 'Degrading' ELSE 'Improving' END AS direction, round(a, 6) AS alpha_start, round(z, 6) AS alpha_end FROM g""")
def win4(spark, sf):
    t = windows.alpha_trend(_rolled(spark, sf), K, 64)
    return t.select("series_id", "used", F.round("slope", 8).alias("slope"), *[F.round(c, 6).alias(c) if c != "direction" else F.col(c) for c in ("r2", "direction", "alpha_start", "alpha_end")])


_BLOCKS = f"{_LONG}, bl AS (SELECT t // 1024 AS k, t % 1024 AS t, v FROM lo), {DFA('bl', 'd')}, b AS (SELECT 'lineitem' AS k, k AS block, alpha, r2 FROM d WHERE n = 1024 AND r2 > 0.3)"


@query("win5_block_alphas", f"WITH {_BLOCKS} SELECT k AS series_id, block, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM b")
def win5(spark, sf):
    return round_all(windows.block_alphas(long_series(spark, sf), K))


def _mixed(spark, sf):
    """The long series with its middle made persistent, so that it has change points."""
    from pyspark.sql import Window

    s = long_series(spark, sf).withColumn("_c", F.expr("tick div 8192"))
    walk = F.sum(F.col("value") - 25.5).over(Window.partitionBy("series_id", "_c").orderBy("tick"))
    return s.select("series_id", "tick", F.when(F.expr("tick div 16384 % 2 = 1"), walk).otherwise(F.col("value")).alias("value"))


_MIXED = f"{_LONG}, mx AS (SELECT k, t, CASE WHEN t // 16384 % 2 = 1 THEN sum(v - 25.5) OVER (PARTITION BY t // 8192 ORDER BY t) ELSE v END AS v FROM lo), bl AS (SELECT t // 1024 AS k, t % 1024 AS t, v FROM mx), {DFA('bl', 'd')}, b AS (SELECT 'lineitem' AS k, k AS block, alpha FROM d WHERE n = 1024 AND r2 > 0.3)"


@query("win6_find_changepoint", f"""WITH {_MIXED}, w AS (SELECT *, abs(alpha - lag(alpha) OVER (ORDER BY block)) AS d, row_number() OVER (ORDER BY block) AS l, count(*) OVER () AS n, sum(alpha) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) AS s, sum(alpha) OVER () AS tot, lead(block) OVER (ORDER BY block) AS nxt FROM b),
g AS (SELECT greatest(median(d) / 0.6745 / sqrt(2e0), 0.02) AS sg FROM w),
c AS (SELECT k, nxt * 1024 AS location, s / l AS a, (tot - s) / (n - l) AS z, l, n FROM w WHERE l >= 3 AND n - l >= 3),
x AS (SELECT k, location, abs(z - a) / (sg * sqrt(1e0 / l + 1e0 / (n - l))) AS score, a, z, l FROM c CROSS JOIN g WHERE abs(z - a) >= 0.1)
SELECT k AS series_id, location, round(score, 6) AS z, round(a, 6) AS before, round(z, 6) AS after FROM x WHERE score > 4 ORDER BY score DESC, l LIMIT 1""")
def win6(spark, sf):
    return round_all(windows.find_changepoint(windows.block_alphas(_mixed(spark, sf), K), K))


#: p(k, seg, location, score, a, z): binary splitting of b(k, block, alpha), round by round until nothing splits; needs WITH RECURSIVE. A row
#: of sp is a block, the segment it has come to, and the cut that led there (of segment cut).
_SPLITS = """sp AS (SELECT k, block, alpha, '' AS seg, NULL::VARCHAR AS cut, NULL::BIGINT AS location, NULL::DOUBLE AS score, NULL::DOUBLE AS a, NULL::DOUBLE AS z FROM b UNION ALL
SELECT k, block, alpha, seg || CASE WHEN block * 1024 < best.location THEN '0' ELSE '1' END, seg, best.location, best.score, best.a, best.z FROM (
SELECT k, block, alpha, seg, first_value({'location': nxt * 1024, 'score': score, 'a': a, 'z': z}) OVER (PARTITION BY k, seg ORDER BY CASE WHEN score > 4 THEN score END DESC NULLS LAST, l) AS best FROM (
SELECT *, CASE WHEN l >= 3 AND n - l >= 3 AND abs(z - a) >= 0.1 THEN abs(z - a) / (greatest(sg, 0.02) * sqrt(1e0 / l + 1e0 / (n - l))) END AS score FROM (
SELECT *, median(d) OVER (PARTITION BY k, seg) / 0.6745 / sqrt(2e0) AS sg, s / l AS a, CASE WHEN n > l THEN (tot - s) / (n - l) END AS z FROM (
SELECT k, block, alpha, seg, abs(alpha - lag(alpha) OVER o) AS d, row_number() OVER o AS l, count(*) OVER (PARTITION BY k, seg) AS n, sum(alpha) OVER (PARTITION BY k, seg ORDER BY block ROWS UNBOUNDED PRECEDING) AS s, sum(alpha) OVER (PARTITION BY k, seg) AS tot, lead(block) OVER o AS nxt
FROM sp WINDOW o AS (PARTITION BY k, seg ORDER BY block))))) WHERE best.score > 4),
p AS (SELECT k, cut AS seg, location, score, a, z FROM (SELECT DISTINCT k, cut, location, score, a, z FROM sp WHERE cut IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY k ORDER BY cut) <= 10)"""


@query("win7_find_changepoints", f"WITH RECURSIVE {_MIXED}, {_SPLITS} SELECT k AS series_id, location, round(score, 6) AS z, round(a, 6) AS before, round(z, 6) AS after FROM p")
def win7(spark, sf):
    return round_all(windows.find_changepoints(windows.block_alphas(_mixed(spark, sf), K), K))


@query("win8_score_changepoints", f"""WITH RECURSIVE {_MIXED}, {_SPLITS}, tr AS (SELECT unnest(range(1, greatest(max(t), 16384) // 16384 + 1)) * 16384 AS middle FROM lo)
SELECT k AS series_id, location, round(score, 6) AS z, round(a, 6) AS before, round(z, 6) AS after, EXISTS (SELECT 1 FROM tr WHERE location BETWEEN middle - 1024 AND middle + 1024) AS in_truth FROM p""")
def win8(spark, sf):
    points = windows.find_changepoints(windows.block_alphas(_mixed(spark, sf), K), K)
    # ticks run from 0 without gaps, so the last one is known without their order
    n = table(spark, sf, "lineitem").where("l_shipdate IS NOT NULL").groupBy(F.lit("lineitem").alias("series_id")).agg((F.count("*") - 1).alias("n"))
    truth = n.select("series_id", F.explode(F.sequence(F.lit(16384), F.greatest("n", F.lit(16384)), F.lit(16384))).alias("at")).select("series_id", (F.col("at") - 1024).alias("start"), (F.col("at") + 1024).alias("end"))
    return round_all(windows.score_changepoints(points, truth, K))


@query("win9_shared_changepoints", """WITH p AS (SELECT 'a' AS asset, event_type AS c, event_id * 60 AS location FROM events WHERE value > 150),
w AS (SELECT *, CASE WHEN location - lag(location) OVER (ORDER BY location, c) > 1024 THEN 1 WHEN lag(location) OVER (ORDER BY location, c) IS NULL THEN 1 ELSE 0 END AS s FROM p),
g AS (SELECT *, sum(s) OVER (ORDER BY location, c ROWS UNBOUNDED PRECEDING) AS i FROM w)
SELECT asset AS asset_id, min(location) AS start, max(location) AS end, count(DISTINCT c) AS channels FROM g GROUP BY asset, i HAVING count(DISTINCT c) >= 2""")
def win9(spark, sf):
    p = table(spark, sf, "events").where("value > 150").select(F.lit("a").alias("asset_id"), F.col("event_type").alias("channel"), (F.col("event_id") * 60).alias("location"))
    return windows.shared_changepoints(p, "asset_id", "channel")


@query("win10_regime_windows", f"""WITH {DAY}, re AS (SELECT k, t - 1 AS t, CASE WHEN p > 0 THEN ln(v / p) ELSE 0 END AS v FROM (SELECT k, t, v, lag(v) OVER (ORDER BY t) AS p FROM od) WHERE t > 0),
n AS (SELECT count(*) AS n FROM re), wi AS (SELECT unnest(range(0, n - 127)) AS w FROM n), wr AS (SELECT w AS k, t - w AS t, v FROM re JOIN wi ON t BETWEEN w AND w + 127), {DFA('wr', 'd')}
SELECT 'orders' AS series_id, k AS w, round(alpha, 6) AS alpha, CASE WHEN alpha > 0.6 THEN 'Trending' WHEN alpha < 0.45 THEN 'MeanReverting' ELSE 'RandomWalk' END AS regime FROM d""")
def win10(spark, sf):
    r = windows.rolling_alpha_fast(prepare.log_returns(daily_orders(spark, sf), K), K, 128, 1)
    return round_all(r.select("series_id", "w", "alpha", verdicts.regime(F.col("alpha")).alias("regime")))


@query("win11_autocorr_at_lag", f"WITH {EV}, m AS (SELECT k, avg(v) AS m FROM ev GROUP BY k), d AS (SELECT k, t, v - m AS d FROM ev JOIN m USING (k)), l AS (SELECT k, d, lead(d, 24) OVER (PARTITION BY k ORDER BY t) AS l FROM d) SELECT k AS series_id, round(sum(d * l) / sum(d * d), 6) AS r FROM l GROUP BY k")
def win11(spark, sf):
    return round_all(windows.autocorr_at_lag(event_series(spark, sf), K, 24))
