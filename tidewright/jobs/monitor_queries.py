"""Queries of monitor calibration (CAL) and of the legs (LEG) over the event recording."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import calibrate as cal
from ..operators import grammar, legs, prepare, windows
from .registry import DFA, FLEET, REC, fleet, query, recording, round_all, table

ID = ["asset_id", "channel"]
A = "'events' AS asset_id"
R = f"""{REC(60)},
rf AS (SELECT c, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY c ORDER BY t), first_value(v IGNORE NULLS) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM rec),
nn AS (SELECT least(n, greatest(least(n // 3, 100000), 192)) AS m, n FROM (SELECT max(t) + 1 AS n FROM rec)),
pf AS (SELECT c, t, v FROM rf, nn WHERE t < m), mf AS (SELECT c, t - m AS t, v FROM rf, nn WHERE t >= m),
pp AS (SELECT c, t, v AS y, lag(v) OVER (PARTITION BY c ORDER BY t) AS x FROM pf),
ar0 AS (SELECT c, CASE WHEN regr_sxx(y, x) > 1e-12 THEN regr_sxy(y, x) / regr_sxx(y, x) ELSE 0 END AS b, avg(x) AS mx, avg(y) AS my FROM pp WHERE x IS NOT NULL GROUP BY c),
ar AS (SELECT c, b, my - b * mx AS a, greatest(sqrt(avg(pow(y - (my - b * mx + b * x), 2))), 1e-9) AS sd FROM pp JOIN ar0 USING (c) WHERE x IS NOT NULL GROUP BY c, b, mx, my),
pz AS (SELECT c, t, (y - (a + b * x)) / sd AS z FROM pp JOIN ar USING (c) WHERE x IS NOT NULL),
mz AS (SELECT c, t, (v - (a + b * p)) / sd AS z FROM (SELECT c, t, v, lag(v) OVER (PARTITION BY c ORDER BY t) AS p FROM mf) JOIN ar USING (c) WHERE p IS NOT NULL)"""


def GUMBEL(src: str, o: str, keys: str, horizon: str) -> str:  # noqa: N802
    """src(keys, i, score) -> o(keys, threshold)."""
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""{o}_n AS (SELECT *, count(*) OVER ({part}) AS n FROM {src}),
{o}_b AS (SELECT {k}n, CASE WHEN n < 64 THEN 0 ELSE i // greatest(n // 16, 1) END AS b, max(score) AS x FROM {o}_n GROUP BY ALL),
{o}_s AS (SELECT {k}n, avg(x) AS m, stddev_pop(x) AS s, max(x) AS top FROM {o}_b WHERE b < 16 GROUP BY {k}n),
{o}_t AS (SELECT *, greatest(s * sqrt(6e0) / pi(), 1e-9) AS beta, greatest({horizon} / greatest(n // 16, 1), 2e0) AS t FROM {o}_s),
{o} AS (SELECT {k}CASE WHEN n < 64 THEN 1.5 * greatest(top, 0) ELSE m - 0.5772156649015329 * beta - beta * ln(-ln(1 - 1 / t)) END AS threshold FROM {o}_t)"""


def frames(spark, sf, minutes: int = 60):
    """(filled, prefix, rest): the recording without gaps, its healthy prefix and what follows, ticks from 0."""
    return parts(prepare.fill_gaps(recording(spark, sf, minutes), ID))


def parts(r):
    """(r, prefix, rest) of a recording without gaps, whose channels all have their asset's ticks."""
    cut = with_baseline(r).withColumnRenamed("baseline", "_m")
    prefix = cut.where("tick < _m").drop("_m")
    rest = cut.where("tick >= _m").withColumn("tick", F.col("tick") - F.col("_m")).drop("_m")
    return r, prefix, rest

_SOURCES = "CASE c WHEN 'discount' THEN ['price', 'quantity', 'tax'] WHEN 'price' THEN ['discount', 'quantity', 'tax'] WHEN 'quantity' THEN ['discount', 'price', 'tax'] ELSE ['discount', 'price', 'quantity'] END"
#: The fleet (k, c, t, v): prefix pf and rest mf without gaps; AR(1) fits, residuals and CUSUM paths by channel, and each channel
#: rebuilt from the other three: fst (mean, deviation), fwr (raw weights), frs (bias, sd, r2).
FC = f"""{FLEET}, fm AS (SELECT k, least(n, greatest(least(n // 3, 100000), 192)) AS m FROM (SELECT k, max(t) + 1 AS n FROM fl GROUP BY k)),
fq AS (SELECT k, c, t, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY k, c ORDER BY t), first_value(v IGNORE NULLS) OVER (PARTITION BY k, c ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM fl),
pf AS MATERIALIZED (SELECT k, c, t, v FROM fq JOIN fm USING (k) WHERE t < m), mf AS MATERIALIZED (SELECT k, c, t - m AS t, v FROM fq JOIN fm USING (k) WHERE t >= m),
fst AS (SELECT k, c, avg(v) AS m, greatest(stddev_pop(v), 1e-12) AS s FROM pf GROUP BY k, c),
fz AS (SELECT k, t, max((v - m) / s) FILTER (c = 'discount') AS d, max((v - m) / s) FILTER (c = 'price') AS p, max((v - m) / s) FILTER (c = 'quantity') AS q, max((v - m) / s) FILTER (c = 'tax') AS x FROM pf JOIN fst USING (k, c) GROUP BY k, t),
fu AS MATERIALIZED (SELECT k, t, 'discount' AS c, d AS y, p AS x1, q AS x2, x AS x3 FROM fz UNION ALL SELECT k, t, 'price', p, d, q, x FROM fz UNION ALL SELECT k, t, 'quantity', q, d, p, x FROM fz UNION ALL SELECT k, t, 'tax', x, d, p, q FROM fz),
fg AS (SELECT k, c, sum(x1 * x1) + 1e-4 * count(*) AS g1, sum(x1 * x2) AS g2, sum(x1 * x3) AS g3, sum(x2 * x2) + 1e-4 * count(*) AS g4, sum(x2 * x3) AS g5, sum(x3 * x3) + 1e-4 * count(*) AS g6, sum(x1 * y) AS h1, sum(x2 * y) AS h2, sum(x3 * y) AS h3 FROM fu GROUP BY k, c),
fd AS (SELECT *, g1 * (g4 * g6 - g5 * g5) - g2 * (g2 * g6 - g3 * g5) + g3 * (g2 * g5 - g3 * g4) AS det FROM fg),
fw AS (SELECT k, c, (h1 * (g4 * g6 - g5 * g5) - g2 * (h2 * g6 - h3 * g5) + g3 * (h2 * g5 - h3 * g4)) / det AS w1, (g1 * (h2 * g6 - h3 * g5) - h1 * (g2 * g6 - g3 * g5) + g3 * (g2 * h3 - g3 * h2)) / det AS w2, (g1 * (g4 * h3 - g5 * h2) - g2 * (g2 * h3 - g3 * h2) + h1 * (g2 * g5 - g3 * g4)) / det AS w3 FROM fd),
fe AS (SELECT k, c, count(*) AS n, sum(pow(y - w1 * x1 - w2 * x2 - w3 * x3, 2)) AS rss, sum(y * y) AS tss FROM fu JOIN fw USING (k, c) GROUP BY k, c),
fwr AS (SELECT f.k, f.c, src, a.s * w / b.s AS weight, b.m AS mean FROM (SELECT k, c, unnest({_SOURCES}) AS src, unnest([w1, w2, w3]) AS w FROM fw) f JOIN fst a ON a.k = f.k AND a.c = f.c JOIN fst b ON b.k = f.k AND b.c = f.src),
frs AS (SELECT k, c, a.m - b.moved AS bias, greatest(sqrt(rss / n) * a.s, 1e-9) AS sd, 1 - rss / tss AS r2 FROM fe JOIN fst a USING (k, c) JOIN (SELECT k, c, sum(weight * mean) AS moved FROM fwr GROUP BY k, c) b USING (k, c))"""


def PARITY(src: str, o: str) -> str:  # noqa: N802
    """o(k, c, t, predicted, z): what the other channels say of src, and how far off it is."""
    return f"{o} AS MATERIALIZED (SELECT r.k, r.c, y.t, r.bias + s.said AS predicted, abs(y.v - r.bias - s.said) / r.sd AS z FROM frs r JOIN {src} y ON y.k = r.k AND y.c = r.c JOIN (SELECT w.k, w.c, x.t, sum(w.weight * x.v) AS said FROM fwr w JOIN {src} x ON x.k = w.k AND x.c = w.src GROUP BY ALL) s ON s.k = r.k AND s.c = r.c AND s.t = y.t)"


_PTHR = f"{PARITY('pf', 'fpp')}, fpx AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i, max(z) AS score FROM fpp GROUP BY k, t), {GUMBEL('fpx', 'fpt', 'k', '1e6')}"


def fleet_parts(spark, sf):
    return parts(prepare.fill_gaps(fleet(spark, sf), ID))


@query("cal1_fit_ar1", f"WITH {R} SELECT {A}, c AS channel, round(a, 6) AS a, round(b, 6) AS b, round(sd, 6) AS sd FROM ar")
def cal1(spark, sf):
    return round_all(cal.fit_ar1(frames(spark, sf)[1]))


@query("cal2_ar1_residual_z", f"WITH {R} SELECT {A}, c AS channel, t AS tick, round(z, 6) AS z FROM pz")
def cal2(spark, sf):
    p = frames(spark, sf)[1]
    return round_all(cal.ar1_residual_z(p, cal.fit_ar1(p)))


_ALPHAS = f"aw AS (SELECT c, unnest(range(0, m - 95, 2)) // 2 AS w FROM (SELECT DISTINCT c FROM pf), nn), ax AS (SELECT pf.c || '|' || w AS k, t - w * 2 AS t, v FROM pf JOIN aw ON pf.c = aw.c AND t BETWEEN w * 2 AND w * 2 + 95), {DFA('ax', 'ad')}, al AS (SELECT split_part(k, '|', 1) AS c, split_part(k, '|', 2)::BIGINT AS w, alpha FROM ad), ast AS (SELECT c, avg(alpha) AS am, greatest(stddev_pop(alpha), 1e-6) AS asd FROM al GROUP BY c)"


def alphas(df):
    return windows.rolling_alpha_fast(df, ID, cal.WINDOW, cal.DFA_STRIDE)


def alpha_stats(rolled):
    return rolled.groupBy(*ID).agg(F.avg("alpha").alias("alpha_mean"), F.greatest(F.stddev_pop("alpha"), F.lit(1e-6)).alias("alpha_sd"))


@query("cal3_window_alpha_stats", f"WITH {R}, {_ALPHAS} SELECT {A}, c AS channel, round(am, 6) AS alpha_mean, round(asd, 6) AS alpha_sd FROM ast")
def cal3(spark, sf):
    return round_all(alpha_stats(alphas(frames(spark, sf)[1])))


_DEV = "pm AS (SELECT c, avg(v) AS m FROM pf GROUP BY c), rd AS (SELECT c, t, abs(r - m) AS dev FROM (SELECT c, t, avg(v) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS r FROM pf) JOIN pm USING (c) WHERE t >= 96)"


@query("cal4_rolling_mean_dev", f"WITH {R}, {_DEV} SELECT {A}, c AS channel, t AS tick, round(dev, 6) AS dev FROM rd")
def cal4(spark, sf):
    return round_all(cal.rolling_mean_dev(frames(spark, sf)[1]))


_RUN = "ri AS (SELECT c, t, v, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY t) AS i FROM (SELECT c, t, v, lag(v) OVER (PARTITION BY c ORDER BY t) AS p FROM pf)), rn AS (SELECT c, max(n) AS max_run FROM (SELECT c, i, count(*) AS n FROM ri GROUP BY c, i) GROUP BY c)"


@query("cal5_max_repeat_run", f"WITH {R}, {_RUN} SELECT {A}, c AS channel, max_run, max_run <= 4 AS repeat_enabled FROM rn")
def cal5(spark, sf):
    return cal.max_repeat_run(frames(spark, sf)[1])


_ROLLTHR = f"{_DEV}, rdi AS (SELECT c, t - 96 AS i, dev AS score FROM rd), {GUMBEL('rdi', 'rt', 'c', '1e6')}"


@query("cal6_gumbel_return_level", f"WITH {R}, {_ROLLTHR} SELECT {A}, c AS channel, round(threshold, 6) AS threshold FROM rt")
def cal6(spark, sf):
    d = cal.rolling_mean_dev(frames(spark, sf)[1]).select(*ID, (F.col("tick") - cal.ROLL).alias("i"), F.col("dev").alias("score"))
    return round_all(cal.gumbel_return_level(d, ID, cal.HORIZON))


@query("cal7_siegmund_threshold", f"WITH RECURSIVE h AS (SELECT k, 4 * k * k * 1e6 AS c FROM (SELECT DISTINCT 0.5 + l_linenumber / 4e0 AS k FROM lineitem)), s AS (SELECT k, c, 0 AS i, ln(c + 1) / (2 * k) AS b FROM h UNION ALL SELECT k, c, i + 1, ln(c + 2 * k * b + 1) / (2 * k) FROM s WHERE i < 32) SELECT k, round(greatest(b - 1.166, 0), 6) AS threshold FROM s WHERE i = 32")
def cal7(spark, sf):
    """The threshold for a handful of slacks that the table gives."""
    ks = [r.k for r in table(spark, sf, "lineitem").select((0.5 + F.col("l_linenumber") / 4).alias("k")).distinct().collect()]
    return spark.createDataFrame([(k, round(cal.siegmund_threshold(k), 6)) for k in ks], "k double, threshold double")


_CUSUM = "cw AS (SELECT c, t, sum(z - 1) OVER w AS u, sum(-z - 1) OVER w AS d FROM pz WINDOW w AS (PARTITION BY c ORDER BY t)), cp AS (SELECT c, t, u - least(0, min(u) OVER w) AS pos, d - least(0, min(d) OVER w) AS neg FROM cw WINDOW w AS (PARTITION BY c ORDER BY t))"


@query("cal8_cusum_path", f"WITH {R}, {_CUSUM} SELECT {A}, c AS channel, t AS tick, round(pos, 5) AS pos, round(neg, 5) AS neg FROM cp")
def cal8(spark, sf):
    p = frames(spark, sf)[1]
    return round_all(cal.cusum_path(cal.ar1_residual_z(p, cal.fit_ar1(p))), 5)


@query("cal9_residual_scale", f"WITH {R}, zb AS (SELECT c, (row_number() OVER (PARTITION BY c ORDER BY t) - 1) // 32 AS g, count(*) OVER (PARTITION BY c) // 32 AS b, z FROM pz), zm AS (SELECT c, b, g, avg(z) AS m FROM zb WHERE g < b GROUP BY c, b, g), zr AS (SELECT c, b, var_samp(m) * 32 AS r FROM zm GROUP BY c, b) SELECT {A}, c AS channel, round(CASE WHEN b >= 8 AND r > 1 + 3 * sqrt(2e0 / (b - 1)) THEN sqrt(r) ELSE 1 END, 6) AS scale FROM zr")
def cal9(spark, sf):
    p = frames(spark, sf)[1]
    return round_all(cal.residual_scale(cal.ar1_residual_z(p, cal.fit_ar1(p))))


@query("cal10_gram_matrix", f"WITH {R}, st AS (SELECT c, avg(v) AS m, greatest(stddev_pop(v), 1e-12) AS s FROM pf GROUP BY c), zz AS (SELECT c, t, (v - m) / s AS z FROM pf JOIN st USING (c)) SELECT {A}, a.c AS x, b.c AS y, count(*) AS n, round(sum(a.z * b.z), 5) AS sxy FROM zz a JOIN zz b USING (t) GROUP BY a.c, b.c")
def cal10_gram(spark, sf):
    return round_all(cal.gram(frames(spark, sf)[1]), 5)


@query("cal10_fit_reconstructor", f"WITH {FC} SELECT k AS asset_id, c AS channel, src AS source, round(weight, 6) AS weight, round(bias, 6) AS bias, round(sd, 6) AS sd, round(r2, 6) AS r2 FROM fwr JOIN frs USING (k, c)")
def cal10(spark, sf):
    return round_all(cal.fit_reconstructors(fleet_parts(spark, sf)[1]))


@query("cal11_parity_z", f"WITH {FC}, {PARITY('mf', 'fpm')} SELECT k AS asset_id, c AS channel, t AS tick, round(predicted, 6) AS predicted, round(z, 6) AS z FROM fpm")
def cal11(spark, sf):
    _, p, rest = fleet_parts(spark, sf)
    return round_all(cal.parity_z(rest, cal.fit_reconstructors(p)))


_RES = f"zx AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, max(abs(z)) AS score FROM pz GROUP BY t), {GUMBEL('zx', 'zt', '', '1e6')}"
_CTHR = f"{_CUSUM}, cx AS (SELECT row_number() OVER (ORDER BY t) - 1 AS i, max(greatest(pos, neg)) AS score FROM cp GROUP BY t), {GUMBEL('cx', 'ct0', '', '1e6')}, ct AS (SELECT greatest(threshold, {cal.siegmund_threshold()!r}) AS threshold FROM ct0)"
_DTHR = f"{_ALPHAS}, dx AS (SELECT w AS i, max(abs(alpha - am) / asd) AS score FROM al JOIN ast USING (c) GROUP BY w), {GUMBEL('dx', 'dt', '', '5e5')}"


def thresholds(p):
    """(asset, residual, cusum, dfa) thresholds of a prefix."""
    z = cal.ar1_residual_z(p, cal.fit_ar1(p))
    one = lambda df, h: cal.gumbel_return_level(df, ["asset_id"], h)
    res = one(cal.channel_max(z, F.abs("z")), cal.HORIZON)
    cus = one(cal.channel_max(cal.cusum_path(z), F.greatest("pos", "neg")), cal.HORIZON)
    a = alphas(p).withColumn("tick", F.col("w"))
    dfa = one(cal.channel_max(a.join(alpha_stats(a), ID), F.abs(F.col("alpha") - F.col("alpha_mean")) / F.col("alpha_sd")), cal.HORIZON / cal.DFA_STRIDE)
    return res, cus.withColumn("threshold", F.greatest("threshold", F.lit(cal.siegmund_threshold()))), dfa


@query("cal12_calibrate_thresholds", f"WITH {R}, {_RES}, {_CTHR}, {_DTHR} SELECT {A}, round(zt.threshold, 6) AS residual, round(ct.threshold, 6) AS cusum, round(dt.threshold, 6) AS dfa FROM zt, ct, dt")
def cal12(spark, sf):
    res, cus, dfa = thresholds(frames(spark, sf)[1])
    return round_all(res.withColumnRenamed("threshold", "residual").join(cus.withColumnRenamed("threshold", "cusum"), "asset_id").join(dfa.withColumnRenamed("threshold", "dfa"), "asset_id"))


@query("cal14_trending_channel", f"WITH {R}, vv AS (SELECT c, var_pop(v) AS v FROM pf GROUP BY c) SELECT {A}, c AS channel, b > 0.98 OR v < 1e-12 AS trending FROM ar JOIN vv USING (c)")
def cal14(spark, sf):
    p = frames(spark, sf)[1]
    return cal.trending_channels(cal.fit_ar1(p), p)


@query("cal15_constant_baseline_flag", f"WITH {R} SELECT {A}, c AS channel, sd <= 1e-9 AS constant FROM ar")
def cal15(spark, sf):
    return cal.constant_baselines(cal.fit_ar1(frames(spark, sf)[1]))


_SHIFT = "sh AS (SELECT event_type AS c, event_id AS id, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM events WHERE value IS NOT NULL), cl AS (SELECT c, abs(s) AS a FROM sh WHERE id % 2 = 0 AND s IS NOT NULL), rk AS (SELECT c, a, row_number() OVER (PARTITION BY c ORDER BY a) AS r, count(*) OVER (PARTITION BY c) AS n FROM cl), th AS (SELECT c, a FROM rk WHERE r = least(floor(n * (1 - 0.05 / 5)), n - 1) + 1)"


def _shifts(spark, sf):
    e = table(spark, sf, "events").where("value IS NOT NULL")
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    s = e.select(F.col("event_type").alias("channel"), "event_id", (F.col("value") - F.lag("value").over(w)).alias("shift")).where("shift IS NOT NULL")
    return s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1").withColumn("id", F.expr("event_id div 20"))


@query("cal16_null_shift_thresholds", f"WITH {_SHIFT} SELECT c AS channel, round(a, 6) AS threshold FROM th")
def cal16(spark, sf):
    return round_all(cal.null_shift_thresholds(*_shifts(spark, sf), 5)[0])


@query("cal16_family_decision", f"WITH {_SHIFT} SELECT id // 20 AS id, bool_or(abs(s) > a) AS shifted FROM sh JOIN th USING (c) WHERE id % 2 = 1 AND s IS NOT NULL GROUP BY 1")
def cal16_family(spark, sf):
    return cal.null_shift_thresholds(*_shifts(spark, sf), 5)[1]


# legs over what follows the prefix; thresholds are halved so that ordinary data alarm


@query("leg1_residual", f"WITH {R}, {_RES}, hi AS (SELECT c, t, abs(z) AS o, threshold / 4 AS th FROM mz, zt WHERE abs(z) > threshold / 4), hg AS (SELECT *, t - lag(t) OVER (PARTITION BY c ORDER BY t) AS g FROM hi) SELECT {A}, c AS channel, t AS tick, 'residual' AS leg, round(o, 6) AS observed, round(th, 6) AS threshold, g AS hit_gap FROM hg WHERE g < 20")
def leg1(spark, sf):
    _, p, m = frames(spark, sf)
    res, _, _ = thresholds(p)
    return round_all(legs.twice_within(cal.ar1_residual_z(m, cal.fit_ar1(p)), res.withColumn("threshold", F.col("threshold") / 4), "residual"))


_COARSE = "mfc AS (SELECT c, t, floor(v / 40) AS v FROM mf), pfc AS (SELECT c, t, floor(v / 40) AS v FROM pf), rj AS (SELECT c, t, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY t) AS i FROM (SELECT c, t, v, lag(v) OVER (PARTITION BY c ORDER BY t) AS p FROM mfc)), rk AS (SELECT c, t, row_number() OVER (PARTITION BY c, i ORDER BY t) AS o FROM rj), rl AS (SELECT c, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY t) AS i FROM (SELECT c, t, v, lag(v) OVER (PARTITION BY c ORDER BY t) AS p FROM pfc)), rm AS (SELECT c, max(n) - 4 AS max_run FROM (SELECT c, i, count(*) AS n FROM rl GROUP BY c, i) GROUP BY c)"


@query("leg2_repeated", f"WITH {R}, {_COARSE} SELECT {A}, c AS channel, t AS tick, 'repeated' AS leg, o::DOUBLE AS observed, (max_run + 4)::DOUBLE AS threshold FROM rk JOIN rm USING (c) WHERE o >= max_run + 4")
def leg2(spark, sf):
    """On coarse values, so that runs occur; the healthy run length is lowered for the same reason."""
    _, p, m = frames(spark, sf)
    coarse = lambda d: d.withColumn("value", F.floor(F.col("value") / 40).cast("double"))
    runs = cal.max_repeat_run(coarse(p)).select(*ID, (F.col("max_run") - 4).alias("max_run"), F.lit(True).alias("repeat_enabled"))
    return legs.leg_repeated(coarse(m), runs)


@query("leg3_dfa", f"""WITH {R}, {_DTHR}, mw AS (SELECT c, unnest(range(0, n - m - 95, 2)) // 2 AS w FROM (SELECT DISTINCT c FROM mf), nn), mx AS (SELECT mf.c || '|' || w AS k, t - w * 2 AS t, v FROM mf JOIN mw ON mf.c = mw.c AND t BETWEEN w * 2 AND w * 2 + 95), {DFA('mx', 'md')},
ma AS (SELECT split_part(k, '|', 1) AS c, split_part(k, '|', 2)::BIGINT AS w, alpha FROM md), mo AS (SELECT c, w, abs(alpha - am) / asd AS o, threshold / 2 AS th FROM ma JOIN ast USING (c), dt),
mh AS (SELECT *, w - row_number() OVER (PARTITION BY c ORDER BY w) AS g FROM mo WHERE o > th), mr AS (SELECT *, row_number() OVER (PARTITION BY c, g ORDER BY w) AS r FROM mh)
SELECT {A}, c AS channel, w * 2 + 95 AS tick, 'dfa' AS leg, round(o, 5) AS observed, round(th, 5) AS threshold FROM mr WHERE r >= 3""")
def leg3(spark, sf):
    _, p, m = frames(spark, sf)
    thr = thresholds(p)[2].withColumn("threshold", F.col("threshold") / 2)
    a = alphas(m).select(*ID, F.col("end_tick").alias("tick"), "alpha")
    return round_all(legs.leg_dfa(a, alpha_stats(alphas(p)), thr), 5)


@query("leg4_level_shift", f"""WITH {R}, {_ROLLTHR}, mr AS (SELECT c, t, abs(r - m) AS o, threshold / 3 AS th FROM (SELECT c, t, avg(v) OVER (PARTITION BY c ORDER BY t ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS r FROM mf) JOIN pm USING (c) JOIN rt USING (c) WHERE t >= 96),
mh AS (SELECT *, t - row_number() OVER (PARTITION BY c ORDER BY t) AS g FROM mr WHERE o > th), mq AS (SELECT *, row_number() OVER (PARTITION BY c, g ORDER BY t) AS r FROM mh)
SELECT {A}, c AS channel, t AS tick, 'level_shift' AS leg, round(o, 6) AS observed, round(th, 6) AS threshold FROM mq WHERE r >= 10""")
def leg4(spark, sf):
    _, p, m = frames(spark, sf)
    dev = cal.rolling_mean_dev(p).select(*ID, (F.col("tick") - cal.ROLL).alias("i"), F.col("dev").alias("score"))
    thr = cal.gumbel_return_level(dev, ID, cal.HORIZON).withColumn("threshold", F.col("threshold") / 3)
    return round_all(legs.leg_level_shift(m, p.groupBy(*ID).agg(F.avg("value").alias("mean")), thr))


@query("leg5_cusum", f"""WITH {R}, {_CTHR}, mw AS (SELECT c, t, sum(z - 1) OVER w AS u, sum(-z - 1) OVER w AS d FROM mz WINDOW w AS (PARTITION BY c ORDER BY t)), mp AS (SELECT c, t, u - least(0, min(u) OVER w) AS pos, d - least(0, min(d) OVER w) AS neg FROM mw WINDOW w AS (PARTITION BY c ORDER BY t))
SELECT {A}, c AS channel, t AS tick, 'cusum' AS leg, round(greatest(pos, neg), 5) AS observed, round(threshold / 3, 5) AS threshold FROM mp, ct WHERE greatest(pos, neg) > threshold / 3""")
def leg5(spark, sf):
    _, p, m = frames(spark, sf)
    thr = thresholds(p)[1].withColumn("threshold", F.col("threshold") / 3)
    return round_all(legs.leg_cusum(cal.cusum_path(cal.ar1_residual_z(m, cal.fit_ar1(p))), thr), 5)


@query("leg6_missingness", f"WITH {REC(20)}, b AS (SELECT c, t, t - lag(t, 3) OVER (PARTITION BY c ORDER BY t) AS g FROM rec WHERE v IS NULL) SELECT {A}, c AS channel, t AS tick, 'missing' AS leg, 4e0 AS observed, 4e0 AS threshold FROM b WHERE g < 32")
def leg6(spark, sf):
    return legs.leg_missing(prepare.validity(recording(spark, sf, 20)))


@query("leg7_parity", f"WITH {FC}, {_PTHR}, {PARITY('mf', 'fpm')}, hi AS (SELECT k, c, t, z, threshold / 2 AS th FROM fpm JOIN fpt USING (k) WHERE z > threshold / 2), hg AS (SELECT *, t - lag(t) OVER (PARTITION BY k, c ORDER BY t) AS g FROM hi) SELECT k AS asset_id, c AS channel, t AS tick, 'parity' AS leg, round(z, 6) AS observed, round(th, 6) AS threshold, g AS hit_gap FROM hg WHERE g < 20")
def leg7(spark, sf):
    """On the fleet, where a delivery's price goes with its quantity until a fault parts them."""
    _, p, m = fleet_parts(spark, sf)
    recon = cal.fit_reconstructors(p)
    top = cal.gumbel_return_level(cal.channel_max(cal.parity_z(p, recon), F.col("z")), ["asset_id"], cal.HORIZON).withColumn("threshold", F.col("threshold") / 2)
    return round_all(legs.twice_within(cal.parity_z(m, recon), top, "parity"))


def _gene(source: str, stat: str, n: int, persist: int) -> str:
    s = {"mean": "avg({v})", "sd": "stddev_pop({v})", "range": "max({v}) OVER w - min({v})"}[stat].format(v=source)
    return f"""(WITH s AS (SELECT c, t, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY t) >= {n} THEN {s} OVER w END AS x FROM src WINDOW w AS (PARTITION BY c ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
e AS (SELECT * FROM s WHERE x IS NOT NULL AND t % 2 = 0), k AS (SELECT c, avg(x) AS m, greatest(stddev_pop(x), 1e-9) AS sd FROM e, nn WHERE t < m GROUP BY c),
h AS (SELECT e.c, t, t // 2 - row_number() OVER (PARTITION BY e.c ORDER BY t) AS g FROM e JOIN k USING (c), nn WHERE t >= nn.m AND abs(x - k.m) / sd > 4),
r AS (SELECT c, t, row_number() OVER (PARTITION BY c, g ORDER BY t) AS r FROM h)
SELECT {A}, c AS channel, count(*) AS alarms, min(t) AS first, '{source}/{stat}/{n}/{persist}' AS gene FROM r WHERE r >= {persist} GROUP BY c)"""


GENES = [("raw", "mean", 16, 1), ("raw", "sd", 32, 2), ("diff", "range", 8, 1), ("diff", "sd", 64, 4)]


@query("leg8_leg_grid", f"WITH {R}, src AS (SELECT c, t, v AS raw, coalesce(v - lag(v) OVER (PARTITION BY c ORDER BY t), 0) AS diff FROM rf) " + " UNION ALL ".join(_gene(*g) for g in GENES))
def leg8(spark, sf):
    r = frames(spark, sf)[0]
    n = r.agg(prepare.calibration_length(F.max("tick") + 1)).first()[0]
    return legs.leg_grid(r, n, GENES).select("asset_id", "channel", "alarms", "first", "gene")


#: The whole grammar on the fleet in SQL: gr (k, c, source, statistic, w, persistence, threshold, alarms, first, last); of stretches pf and mf (k, c, t, v).
def GRAMMAR(head: str) -> str:  # noqa: N802
    frame = "(PARTITION BY k, c, part, source ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    stats = " UNION ALL ".join(
        f"SELECT k, c, part, source, t, r, {w} AS w, unnest(['mean', 'sd', 'max_abs', 'range', 'slope']) AS statistic, unnest([avg(v) OVER f, stddev_pop(v) OVER f, max(abs(v)) OVER f, max(v) OVER f - min(v) OVER f, regr_slope(v, r) OVER f]) AS x FROM gsr WINDOW f AS {frame.format(w - 1)}"
        for w in grammar.WINDOWS)
    persist = " UNION ALL ".join(f"SELECT k, c, source, statistic, w, {p} AS persistence, any_value(threshold) AS threshold, count(*) FILTER (run >= {p}) AS alarms, min(t) FILTER (run >= {p}) AS first, max(t) FILTER (run >= {p}) AS last FROM gru GROUP BY ALL" for p in grammar.PERSISTENCE)
    return f"""{head},
gba AS (SELECT *, lag(v) OVER (PARTITION BY k, c, part ORDER BY t) AS p FROM (SELECT k, c, 0 AS part, t, v FROM pf UNION ALL SELECT k, c, 1, t, v FROM mf)),
gf0 AS (SELECT k, c, CASE WHEN regr_sxx(v, p) > 1e-12 THEN regr_sxy(v, p) / regr_sxx(v, p) ELSE 0 END AS b, avg(p) AS mx, avg(v) AS my FROM gba WHERE part = 0 AND p IS NOT NULL GROUP BY k, c),
gar AS (SELECT k, c, b, my - b * mx AS a, greatest(sqrt(avg(pow(v - (my - b * mx + b * p), 2))), 1e-9) AS sd FROM gba JOIN gf0 USING (k, c) WHERE part = 0 AND p IS NOT NULL GROUP BY k, c, b, mx, my),
gsr AS MATERIALIZED (SELECT k, c, part, t, t + 1 AS r, unnest(['raw', 'residual', 'diff']) AS source, unnest([v, coalesce((v - (a + b * p)) / sd, 0), coalesce(v - p, 0)]) AS v FROM gba JOIN gar USING (k, c)),
gce AS MATERIALIZED (SELECT *, (r - w) // 2 AS i FROM ({stats}) WHERE r >= w AND r % 2 = 0),
gcm AS (SELECT k, c, source, statistic, w, avg(x) AS m, greatest(stddev_pop(x), 1e-9) AS sd FROM gce WHERE part = 0 GROUP BY ALL HAVING max(r) >= 4 * w),
gcz AS MATERIALIZED (SELECT gce.*, abs(x - m) / sd AS score FROM gce JOIN gcm USING (k, c, source, statistic, w)),
gc0 AS (SELECT k, c, source, statistic, w, i, score FROM gcz WHERE part = 0), {GUMBEL('gc0', 'gth', 'k, c, source, statistic, w', '1e6')},
gru AS MATERIALIZED (SELECT k, c, source, statistic, w, t, threshold, i - coalesce(max(CASE WHEN score <= threshold THEN i END) OVER (PARTITION BY k, c, source, statistic, w ORDER BY i), -1) AS run FROM gcz JOIN gth USING (k, c, source, statistic, w) WHERE part = 1),
gr AS ({persist})"""


_FLEET_PARTS = FC.split("fst AS")[0].rstrip().rstrip(",")


def with_baseline(r):
    """A recording with the length of its healthy prefix beside each row."""
    # the frame that gaps are filled by: no sort of its own
    n = F.max("tick").over(prepare.by_tick(ID).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1
    return r.withColumn("baseline", prepare.calibration_length(n))


@query("leg8_leg_grammar", f"WITH {GRAMMAR(_FLEET_PARTS)} SELECT k AS asset_id, c AS channel, source, statistic, w AS \"window\", persistence, round(threshold, 4) AS threshold, alarms, first FROM gr WHERE alarms > 0")
def leg8_grammar(spark, sf):
    """Every gene that alarms on a channel of the fleet."""
    r = with_baseline(prepare.fill_gaps(fleet(spark, sf), ID))
    return grammar.leg_grammar(r).where("alarms > 0").select(*ID, "source", "statistic", "window", "persistence", F.round("threshold", 4).alias("threshold"), "alarms", "first")


ALARMS = "am AS (SELECT 'a' || user_id % 7 AS asset_id, event_type AS channel, event_id AS tick, ['residual', 'parity', 'repeated', 'dfa', 'cusum', 'level_shift', 'missing'][event_id % 7 + 1] AS leg, value AS observed, 40e0 AS threshold, event_id % 13 AS hit_gap FROM events WHERE value > 40)"


def alarms(spark, sf):
    """A table of alarms: the events whose value lies above a threshold of 40."""
    e = table(spark, sf, "events").where("value > 40")
    leg = F.element_at(F.array(*[F.lit(x) for x in ("residual", "parity", "repeated", "dfa", "cusum", "level_shift", "missing")]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("asset_id"), F.col("event_type").alias("channel"), F.col("event_id").alias("tick"), leg.alias("leg"), F.col("value").alias("observed"), F.lit(40.0).alias("threshold"), (F.col("event_id") % 13).alias("hit_gap"))


@query("leg9_classify_alarm", f"""WITH {ALARMS} SELECT asset_id, channel, tick, leg, CASE leg WHEN 'missing' THEN 'packet_loss' WHEN 'repeated' THEN 'stuck' WHEN 'dfa' THEN 'drift' WHEN 'cusum' THEN 'drift'
WHEN 'parity' THEN CASE WHEN observed > 80 THEN 'spike' ELSE 'cross_channel_inconsistency' END WHEN 'level_shift' THEN CASE WHEN observed > 80 THEN 'spike' ELSE 'regime_shift' END ELSE CASE WHEN hit_gap >= 8 THEN 'spike' ELSE 'correlation_change' END END AS class FROM am""")
def leg9(spark, sf):
    return alarms(spark, sf).select("asset_id", "channel", "tick", "leg", verdicts.alarm_class(F.col("leg"), F.col("observed"), F.col("threshold"), F.col("hit_gap")).alias("class"))


@query("leg13_virtual_values", f"WITH {FC}, {PARITY('mf', 'fpm')} SELECT k AS asset_id, c AS channel, t AS tick, round(predicted, 6) AS predicted, round(sd, 6) AS sd, round(r2, 6) AS r2 FROM fpm JOIN frs USING (k, c)")
def leg13(spark, sf):
    _, p, m = fleet_parts(spark, sf)
    return round_all(legs.virtual_values(m, cal.fit_reconstructors(p)))


@query("leg14_dedupe_alarms", f"WITH {ALARMS}, g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY asset_id, channel, leg ORDER BY tick) AS g FROM am) SELECT asset_id, channel, tick, leg FROM g WHERE g IS NULL OR g >= 500")
def leg14(spark, sf):
    return legs.dedupe_alarms(alarms(spark, sf), 500).select("asset_id", "channel", "tick", "leg")


LIMIT = """md AS (SELECT c, v AS med FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS r, count(*) OVER (PARTITION BY c) AS n FROM pf) WHERE r = n // 2 + 1),
dv AS (SELECT c, abs(v - med) AS d FROM pf JOIN md USING (c)), p9 AS (SELECT c, d AS p FROM (SELECT c, d, row_number() OVER (PARTITION BY c ORDER BY d) AS r, count(*) OVER (PARTITION BY c) AS n FROM dv) WHERE r = greatest(ceil(n * 0.95) - 1, 0) + 1),
lh AS (SELECT c, t, t - row_number() OVER (PARTITION BY c ORDER BY t) AS g FROM mf JOIN md USING (c) JOIN p9 USING (c) WHERE abs(v - med) > 1.5 * p), lr AS (SELECT c, t, row_number() OVER (PARTITION BY c, g ORDER BY t) AS r FROM lh), lmh AS (SELECT c, t FROM lr WHERE r >= 2)"""


@query("leg16_limit_check", f"WITH {R}, {LIMIT} SELECT {A}, c AS channel, t AS tick, 'limit' AS leg FROM lmh")
def leg16(spark, sf):
    _, p, m = frames(spark, sf)
    return legs.limit_check(m, p, 2)


@query("leg17_amplitude_threshold", f"""WITH {R}, p AS (SELECT c, 1.5 * a AS lim FROM (SELECT c, abs(v) AS a, row_number() OVER (PARTITION BY c ORDER BY abs(v)) AS r, count(*) OVER (PARTITION BY c) AS n FROM pf) WHERE r = least(floor(n * 0.95), n - 1) + 1)
SELECT {A}, p.c AS channel, round(lim, 6) AS limit, min(t) AS first FROM p LEFT JOIN mf ON mf.c = p.c AND abs(v) > lim GROUP BY p.c, lim""")
def leg17(spark, sf):
    _, p, m = frames(spark, sf)
    return round_all(legs.amplitude_threshold(m, p))


@query("leg18_sigma_threshold", f"""WITH {R}, s AS (SELECT c, avg(v) AS m, stddev_pop(v) AS sd FROM pf GROUP BY c), f AS (SELECT c, count(*) FILTER (abs(v - m) > 3 * sd) / count(*) AS fr FROM pf JOIN s USING (c) GROUP BY c), o AS (SELECT c, min(t) AS first FROM mf JOIN s USING (c) WHERE abs(v - m) > 3 * sd GROUP BY c)
SELECT {A}, c AS channel, round(fr, 6) AS false_rate, first FROM f LEFT JOIN o USING (c)""")
def leg18(spark, sf):
    _, p, m = frames(spark, sf)
    return round_all(legs.sigma_threshold(m, p))


@query("leg21_first_alarm_per_leg", f"WITH {ALARMS}, f AS (SELECT leg, count(*) AS firsts FROM (SELECT asset_id, leg, row_number() OVER (PARTITION BY asset_id ORDER BY tick, leg) AS r FROM am) WHERE r = 1 GROUP BY leg) SELECT leg, count(*) AS alarms, coalesce(max(firsts), 0) AS firsts FROM am LEFT JOIN f USING (leg) GROUP BY leg")
def leg21(spark, sf):
    return legs.first_alarm_per_leg(alarms(spark, sf))
