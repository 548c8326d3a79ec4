"""Queries of domain jobs (DOM), batch reports (DFA12, DFA19, DFA20), sources (SRC) and reports (SNK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts
from ..operators import domains, grouped, prepare, structure, windows
from ..sources import sinks
from ..sources.shared import stored
from .prepare_queries import _TIMES, event_times
from .registry import DAY, DFA, DFA_SHORT, EV, RSS, HEALTH, LAW, SIGNAL, SU, US, daily_orders, event_series, query, round_all, supplier_series, table

K = ["series_id"]


@query("dfa2_dfa_grouped", f"WITH {SU}, {DFA('su', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dfa2_grouped(spark, sf):
    return round_all(grouped.dfa_by_key(supplier_series(spark, sf), K))


@query("dfa12_prove_structure")
def dfa12(spark, sf):
    """The fixed shuffle walks a series from its end, so a series is one array: users' series, which are short."""
    return round_all(grouped.prove_structure(event_series(spark, sf, "user_id"), K))


@query("dfa12_prove_structure_by_hash", f"WITH {EV}, {DFA('ev', 'd')} SELECT k AS series_id, round(alpha, 6) AS alpha, true AS shuffled FROM d")
def dfa12_hash(spark, sf):
    s = event_series(spark, sf)
    p = structure.prove_structure(s, prepare.shuffle_by_hash(s, K), K)
    return round_all(p.select("series_id", "alpha", F.col("shuffled_alpha").between(0.3, 0.7).alias("shuffled")))


_REG = f"{EV}, rb AS (SELECT * FROM ev WHERE t < 700), rc AS (SELECT k, t - 700 AS t, v FROM ev WHERE t >= 700), {LAW('rb', 'a')}, {LAW('rc', 'b')}"


@query("dfa19_health_report", f"WITH {_REG}, r AS (SELECT b.*, b.alpha - a.alpha AS s FROM b JOIN a USING (k)) SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2, quality, {SIGNAL} AS signal, round(s, 6) AS shift, {HEALTH.format('s')} AS verdict FROM r")
def dfa19(spark, sf):
    s = event_series(spark, sf)
    base = structure.analyze(s.where("tick < 700"), K).select("series_id", F.col("alpha").alias("base_alpha"))
    law = structure.analyze(s.where("tick >= 700").withColumn("tick", F.col("tick") - 700), K).join(base, K)
    shift = F.col("alpha") - F.col("base_alpha")
    return round_all(law.select("series_id", "n", "alpha", "r2", "quality", verdicts.signal_class(F.col("alpha"), F.col("r2")).alias("signal"), shift.alias("shift"), verdicts.health(shift).alias("verdict")))


@query("dfa20_baseline_registry", f"WITH {_REG} SELECT b.k AS series_id, round(a.alpha, 6) AS base_alpha, round(a.kurtosis, 6) AS base_kurtosis, a.n AS base_n, round(b.alpha - a.alpha, 6) AS shift FROM a JOIN b USING (k)")
def dfa20(spark, sf):
    s = event_series(spark, sf)
    reg = structure.analyze(s.where("tick < 700"), K).select("series_id", F.col("alpha").alias("base_alpha"), F.col("kurtosis").alias("base_kurtosis"), F.col("n").alias("base_n"))
    now = structure.dfa(s.where("tick >= 700").withColumn("tick", F.col("tick") - 700), K).select("series_id", "alpha")
    return round_all(now.join(reg, K, "left").select("series_id", "base_alpha", "base_kurtosis", "base_n", (F.col("alpha") - F.col("base_alpha")).alias("shift")))


@query("snk6_report_table", f"WITH {US}, {LAW('us', 'w')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2, CASE WHEN n < 20 THEN 'TOO FEW' ELSE quality END AS quality, NULL::VARCHAR AS verdict FROM w")
def snk6(spark, sf):
    return round_all(sinks.report_table(structure.analyze(event_series(spark, sf, "user_id"), K), "series_id"))


#: Sentence lengths: candidates are folded so that no sentence is under three characters.
_SL = r"""sl0 AS (SELECT doc_id AS k, replace(coalesce(text, ''), chr(13), '') AS t FROM documents),
sl1 AS (SELECT k, length(t) AS n, string_split(t, '') AS c FROM sl0),
sl2 AS (SELECT k, n, list_filter(range(1, n + 1), lambda i: c[i] IN ('.', '!', '?') AND (i = n OR c[i + 1] IN ('"', chr(39)) OR regexp_full_match(c[i + 1], '[\s\x0B\x85\p{Z}]'))) AS ends FROM sl1),
sl3 AS (SELECT k, n, list_reduce(list_concat([[0::BIGINT]], list_transform(ends, lambda x: [x])), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 3 THEN list_concat(a, x) ELSE a END) AS e FROM sl2),
sl4 AS (SELECT k, CASE WHEN n - e[len(e)] >= 10 THEN list_append(e, n) ELSE e END AS e FROM sl3),
sl AS (SELECT k, i - 1 AS t, (e[i + 1] - e[i])::DOUBLE AS v FROM (SELECT k, e, unnest(range(1, len(e))) AS i FROM sl4))"""


TEXT_TAG = "CASE WHEN c >= 64 AND r2 > 0.5 THEN CASE WHEN alpha > 0.7 THEN 'strong' WHEN alpha > 0.55 THEN 'moderate' ELSE 'uniform' END END"


@query("pre13_sentence_lengths", f"WITH {_SL} SELECT k AS doc_id, count(*) AS sentences, sum(v)::BIGINT AS characters, max(v)::BIGINT AS longest FROM sl GROUP BY k")
def pre13(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(domains.sentence_lengths("text")).alias("tick", "length"))
    return d.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("length").alias("characters"), F.max("length").alias("longest"))


@query("dom1_text_structure", f"WITH {_SL}, {DFA('sl', 'd')}, m AS (SELECT k, count(*) AS c, avg(v) AS m FROM sl GROUP BY k), j AS (SELECT doc_id, coalesce(c, 0) AS c, coalesce(m, 0) AS m, coalesce(alpha, 0.5) AS alpha, coalesce(r2, 0) AS r2 FROM documents LEFT JOIN m ON m.k = doc_id LEFT JOIN d ON d.k = doc_id) SELECT doc_id, c AS sentences, round(m, 6) AS mean_length, round(alpha, 6) AS alpha, round(r2, 6) AS r2, {TEXT_TAG} AS tag FROM j")
def dom1(spark, sf):
    return round_all(domains.text_structure(table(spark, sf, "documents"), "doc_id", "text"))


_RET = f"{DAY}, re AS (SELECT k, t - 1 AS t, CASE WHEN p > 0 THEN ln(v / p) ELSE 0 END AS v FROM (SELECT k, t, v, lag(v) OVER (ORDER BY t) AS p FROM od) WHERE t > 0)"


@query("dom2_market_regime", f"WITH {_RET}, {DFA('re', 'd')} SELECT k AS series_id, n, round(alpha, 6) AS alpha, round(r2, 6) AS r2, CASE WHEN alpha > 0.6 THEN 'Trending' WHEN alpha < 0.45 THEN 'MeanReverting' ELSE 'RandomWalk' END AS regime FROM d")
def dom2(spark, sf):
    return round_all(domains.market_regime(daily_orders(spark, sf), K))


@query("dom3_event_rhythm", f"WITH {_TIMES}, g AS (SELECT k, t, abs(v - lag(v) OVER (PARTITION BY k ORDER BY t)) AS v FROM ti), gi AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS t, v FROM g WHERE v > 0), {DFA('gi', 'd')}, m AS (SELECT k, avg(v) AS m FROM gi GROUP BY k) SELECT k AS series_id, n, round(alpha, 5) AS alpha, round(r2, 5) AS r2, round(m, 3) AS mean_interval, CASE WHEN r2 < 0.3 OR n < 64 THEN 'Random' WHEN alpha > 0.7 THEN 'Bursty' WHEN alpha > 0.55 THEN 'Natural' WHEN alpha > 0.45 THEN 'Random' ELSE 'Metronomic' END AS rhythm FROM d JOIN m USING (k)")
def dom3(spark, sf):
    r = domains.event_rhythm(event_times(spark, sf), K)
    return r.select("series_id", "n", F.round("alpha", 5).alias("alpha"), F.round("r2", 5).alias("r2"), F.round("mean_interval", 3).alias("mean_interval"), "rhythm")


_GC = "gb AS (SELECT page_id AS k, unnest(range(length(html))) AS pos, upper(unnest(string_split(html, ''))) AS base FROM pages), gw AS (SELECT k, pos // 20 AS w, count(*) AS n, count(*) FILTER (base IN ('G', 'C')) AS gc, count(*) FILTER (base IN ('A', 'T')) AS ta FROM gb GROUP BY ALL), gs AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY w) - 1 AS t, gc / (gc + ta) AS v FROM gw WHERE n = 20 AND gc + ta > 0)"


@query("dom4_genome_structure", f"WITH {_GC}, {DFA('gs', 'd')}, m AS (SELECT k, avg(v) AS m FROM gs GROUP BY k) SELECT k AS series_id, n AS windows, round(m, 6) AS mean_gc, round(CASE WHEN n < 64 THEN 0 ELSE alpha END, 6) AS alpha, round(CASE WHEN n < 64 THEN 0 ELSE r2 END, 6) AS r2 FROM d JOIN m USING (k)")
def dom4(spark, sf):
    """The letters of pages as a symbol stream, in windows of 20."""
    bases = table(spark, sf, "pages").select(F.col("page_id").alias("series_id"), F.posexplode(F.split("html", "")).alias("pos", "base"))
    return round_all(domains.genome_structure(prepare.gc_windows(bases, K, 20), K)[0])


@query("dom4_genome_profile", f"WITH {_GC}, wn AS (SELECT k, count(*) AS n FROM gs GROUP BY k HAVING count(*) > 128), ws AS (SELECT k || '|' || w AS k, t - w * 64 AS t, v FROM (SELECT gs.k, t, v, n, unnest(range(greatest(t - 64, 0) // 64, t // 64 + 1)) AS w FROM gs JOIN wn USING (k)) WHERE t >= w * 64 AND t < w * 64 + 128 AND w * 64 + 128 <= n), {DFA('ws', 'd')} SELECT split_part(k, '|', 1)::BIGINT AS series_id, split_part(k, '|', 2)::BIGINT AS w, split_part(k, '|', 2)::BIGINT * 64 + 127 AS end_tick, round(alpha, 6) AS alpha, round(r2, 6) AS r2 FROM d")
def dom4_profile(spark, sf):
    """Exponents of half-overlapping blocks of 128 windows, of pages with more windows than that."""
    bases = table(spark, sf, "pages").select(F.col("page_id").alias("series_id"), F.posexplode(F.split("html", "")).alias("pos", "base"))
    return round_all(domains.genome_structure(prepare.gc_windows(bases, K, 20), K, 128)[1])


@query("dom5_multi_channel_health", f"WITH {EV}, {DFA('ev', 'd')} SELECT k AS series_id, round(alpha, 6) AS alpha, round(alpha - 0.45, 6) AS shift, {HEALTH.format('(alpha - 0.45)')} AS verdict, CASE WHEN abs(alpha - 0.45) < 0.08 * 0.375 THEN 'Healthy' WHEN abs(alpha - 0.45) < 0.08 THEN 'Watch' WHEN abs(alpha - 0.45) < 0.08 * 1.875 THEN 'Warning' ELSE 'Critical' END AS scaled FROM d")
def dom5(spark, sf):
    d = structure.dfa(event_series(spark, sf), K)
    return round_all(domains.multi_channel_health(d, d.select("series_id", F.lit(0.45).alias("base_alpha")), "series_id", 0.08))


@query("dom6_half_split_shift", f"WITH {SU}, n AS (SELECT k, count(*) AS n FROM su GROUP BY k HAVING count(*) >= 256), hv AS (SELECT su.k || '|' || (CASE WHEN t >= n // 2 THEN 1 ELSE 0 END) AS k, CASE WHEN t >= n // 2 THEN t - n // 2 ELSE t END AS t, v FROM su JOIN n USING (k)), {DFA('hv', 'd')}, p AS (SELECT split_part(k, '|', 1)::BIGINT AS k, max(alpha) FILTER (k LIKE '%|0') AS a, max(alpha) FILTER (k LIKE '%|1') AS b FROM d GROUP BY 1) SELECT k AS series_id, round(a, 6) AS a, round(b, 6) AS b, round(abs(b - a), 6) AS shift, {HEALTH.format('(b - a)')} AS verdict FROM p ORDER BY abs(b - a) DESC, k LIMIT 10")
def dom6(spark, sf):
    return round_all(domains.half_split_shift(supplier_series(spark, sf), K))


@query("dom6_train_test_shift", f"WITH {SU}, n AS (SELECT k, count(*) AS n FROM su GROUP BY k), tr AS (SELECT su.* FROM su JOIN n USING (k) WHERE t < n // 2 + 20), te AS (SELECT k, t - (n // 2 + 20) AS t, v FROM su JOIN n USING (k) WHERE t >= n // 2 + 20), {DFA('tr', 'a')}, {DFA('te', 'b')} SELECT a.k AS series_id, a.n AS train_n, b.n AS test_n, round(a.alpha, 6) AS a, round(b.alpha, 6) AS b, round(abs(b.alpha - a.alpha), 6) AS shift, {HEALTH.format('(b.alpha - a.alpha)')} AS verdict FROM a JOIN b USING (k) WHERE a.n >= 256 AND b.n >= 256 ORDER BY abs(b.alpha - a.alpha) DESC, a.k LIMIT 10")
def dom6_train_test(spark, sf):
    s = supplier_series(spark, sf)
    cut = s.groupBy(*K).agg((F.expr("count(*) div 2") + 20).alias("_c"))
    both = s.join(cut, K)
    test = both.where("tick >= _c").select("series_id", (F.col("tick") - F.col("_c")).alias("tick"), "value")
    return round_all(domains.train_test_shift(both.where("tick < _c").drop("_c"), test, K))


_WEEKS = f"""sm AS (SELECT event_type AS leg, floor(epoch(ts))::BIGINT // 604800 AS w, row_number() OVER (PARTITION BY event_type, floor(epoch(ts))::BIGINT // 604800 ORDER BY floor(epoch(ts)), event_id) - 1 AS i, value AS v FROM events WHERE value IS NOT NULL),
sb AS (SELECT leg || '|' || w || '|' || i // 128 AS k, i % 128 AS t, v FROM sm), {DFA('sb', 'sd')}, tb AS (SELECT split_part(k, '|', 1) AS leg, split_part(k, '|', 2)::BIGINT AS segment, split_part(k, '|', 2)::BIGINT % 2 AS label, split_part(k, '|', 3)::BIGINT AS block, alpha, r2 FROM sd WHERE n = 128)"""


def _week_blocks(spark, sf):
    """Event values in weeks, odd and even ones as two classes, in blocks of 128."""
    e = table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_type").alias("leg"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("order"), "value")
    week = F.expr("ts div 604800")
    weeks = e.select("leg", week.alias("segment")).distinct()
    return domains.terrain_blocks(e, weeks.select("leg", "segment", (F.col("segment") * 604800).alias("start"), (F.col("segment") * 604800 + 604799).alias("end"), (F.col("segment") % 2).alias("label")), "leg", 128)


@query("dom8_terrain_blocks", f"WITH {_WEEKS} SELECT leg, label, count(*) AS blocks, round(avg(alpha), 6) AS mean, round(stddev_samp(alpha), 6) AS sd FROM tb GROUP BY ALL")
def dom8_blocks(spark, sf):
    return round_all(_week_blocks(spark, sf).groupBy("leg", "label").agg(F.count("*").alias("blocks"), F.avg("alpha").alias("mean"), F.stddev_samp("alpha").alias("sd")))


@query("dom8_block_separation", f"WITH {_WEEKS}, s AS (SELECT leg, label, count(*) AS n, avg(alpha) AS m, var_samp(alpha) AS q FROM tb GROUP BY ALL) SELECT a.leg, a.label AS a, b.label AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2)), 6) AS d FROM s a JOIN s b ON a.leg = b.leg AND a.label < b.label")
def dom8_separation(spark, sf):
    return round_all(domains.class_separation(_week_blocks(spark, sf), "label", "leg", "alpha"))


@query("dom7_hrv_features", f"WITH {SU}, d AS (SELECT k, v, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM su) SELECT k AS series_id, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sdnn, round(sqrt(avg(d * d)), 4) AS rmssd FROM d GROUP BY k")
def dom7(spark, sf):
    h = domains.hrv_features(supplier_series(spark, sf), K, 64, 256)
    return h.where("alpha1 IS NOT NULL OR alpha2 IS NULL OR alpha2 IS NOT NULL").select("series_id", *[F.round(c, 4).alias(c) for c in ("mean", "sdnn", "rmssd")])


@query("dom7_hrv_exponents", f"WITH {SU}, sb AS (SELECT k || '|' || t // 64 AS k, t % 64 AS t, v FROM su), lb AS (SELECT k || '|' || t // 256 AS k, t % 256 AS t, v FROM su), {DFA_SHORT('sb', 'ds')}, {DFA('lb', 'dl')}, a AS (SELECT split_part(k, '|', 1)::BIGINT AS k, median(alpha) AS a FROM ds WHERE n = 64 GROUP BY 1), b AS (SELECT split_part(k, '|', 1)::BIGINT AS k, median(alpha) AS b FROM dl WHERE n = 256 GROUP BY 1) SELECT k AS series_id, round(a, 6) AS alpha1, round(b, 6) AS alpha2 FROM (SELECT DISTINCT k FROM su) LEFT JOIN a USING (k) LEFT JOIN b USING (k)")
def dom7_exponents(spark, sf):
    return round_all(domains.hrv_features(supplier_series(spark, sf), K, 64, 256).select("series_id", "alpha1", "alpha2"))


_TER = "tb AS (SELECT event_type AS leg, label, v FROM (SELECT event_type, user_id % 3 AS label, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id))"


@query("dom8_class_separation", f"WITH {_TER}, s AS (SELECT leg, label, count(*) AS n, avg(v) AS m, var_samp(v) AS q FROM tb GROUP BY ALL) SELECT a.leg, a.label AS a, b.label AS b, round((a.m - b.m) / sqrt(((a.n - 1) * a.q + (b.n - 1) * b.q) / (a.n + b.n - 2)), 6) AS d FROM s a JOIN s b ON a.leg = b.leg AND a.label < b.label")
def dom8(spark, sf):
    v = table(spark, sf, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("leg"), "user_id").agg(F.avg("value").alias("v")).withColumn("label", F.col("user_id") % 3)
    return round_all(domains.class_separation(v, "label", "leg", "v"))


@query("dom9_nearest_centroid_holdout", """WITH r AS (SELECT vec_id AS id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings), s AS (SELECT label AS to_, dim, sum(value) AS s, count(*) AS c FROM r GROUP BY ALL),
e AS (SELECT id, label, to_, value, s, c, (label = to_)::INT AS o FROM r JOIN s USING (dim)), f AS (SELECT id, label, to_, round(sum(pow(value - (s - o * value) / (c - o), 2)), 9) AS d FROM e WHERE c - o > 0 GROUP BY ALL),
n AS (SELECT id, label, to_, row_number() OVER (PARTITION BY id ORDER BY d, to_) AS q, max((label = to_)::INT) OVER (PARTITION BY id) AS k FROM f) SELECT label AS truth, to_ AS predicted, count(*) AS n FROM n WHERE q = 1 AND k = 1 GROUP BY ALL""")
def dom9(spark, sf):
    return domains.nearest_centroid_holdout(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("values")))


LEGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_orderkey"]


def leg_vectors(spark, sf):
    """(id, group, label, values): the exponents of six columns over every full block of 128 deliveries of a supplier; the
    supplier is the group, its nation's region the class."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", *LEGS)
    placed = prepare.assign_ticks(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    # a block is one row with its six columns as arrays: no delivery is repeated by column
    blocks = placed.groupBy("l_suppkey", F.expr("tick div 128").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.expr("tick % 128").alias("tick"), *LEGS))).alias("_s")).where("size(_s) = 128")
    alphas = [grouped.dfa_of(F.col("_s")[c].cast("array<double>"))["alpha"] for c in LEGS]
    # read three times by the holdout, measured once
    vectors = stored(blocks.select("l_suppkey", "block", F.array(*[F.round(a, 6) for a in alphas]).alias("values")))
    regions = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("label"))
    return vectors.join(regions, "l_suppkey").select(F.concat_ws("/", "l_suppkey", "block").alias("id"), F.col("l_suppkey").alias("group"), "label", "values")


_LEGS = "lg AS (SELECT l_suppkey || '/' || t // 128 || '/' || leg AS k, t % 128 AS t, v FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t, unnest(range(6)) AS leg, unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_orderkey])::DOUBLE AS v FROM lineitem))"


@query("dom9_group_holdout", f"""WITH {_LEGS}, {DFA('lg', 'd')}, al AS (SELECT split_part(k, '/', 1)::BIGINT AS g, split_part(k, '/', 2)::BIGINT AS b, split_part(k, '/', 3)::BIGINT AS dim, round(alpha, 6) AS x FROM d WHERE n = 128),
rw AS (SELECT g, b, dim, x, n_regionkey AS y FROM al JOIN supplier ON g = s_suppkey JOIN nation ON s_nationkey = n_nationkey), tt AS (SELECT y AS z, dim, sum(x) AS s, count(*) AS c FROM rw GROUP BY ALL), ow AS (SELECT g, y AS z, dim, sum(x) AS s, count(*) AS c FROM rw GROUP BY ALL),
ce AS (SELECT gg.g, tt.z, tt.dim, (tt.s - coalesce(ow.s, 0)) / (tt.c - coalesce(ow.c, 0)) AS m FROM (SELECT DISTINCT g FROM rw) gg CROSS JOIN tt LEFT JOIN ow ON ow.g = gg.g AND ow.z = tt.z AND ow.dim = tt.dim WHERE tt.c > coalesce(ow.c, 0)),
fa AS (SELECT rw.g, b, y, z, round(sum(pow(x - m, 2)), 9) AS far FROM rw JOIN ce ON ce.g = rw.g AND ce.dim = rw.dim GROUP BY ALL), ne AS (SELECT g, b, y, min_by(z, (far, z)) AS p, bool_or(z = y) AS ok FROM fa GROUP BY ALL),
co AS (SELECT y, count(*) FILTER (ok AND p = y) AS r, count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS u FROM ne GROUP BY y)
SELECT y AS truth, r AS "right", a AS assessed, u AS unassessable, CASE WHEN a > 0 THEN round(greatest((r / a + 1.96 * 1.96 / (2 * a)) / (1 + 1.96 * 1.96 / a) - 1.96 * sqrt(r / a * (1 - r / a) / a + 1.96 * 1.96 / (4 * a * a)) / (1 + 1.96 * 1.96 / a), 0), 6) END AS low,
CASE WHEN a > 0 THEN round(least((r / a + 1.96 * 1.96 / (2 * a)) / (1 + 1.96 * 1.96 / a) + 1.96 * sqrt(r / a * (1 - r / a) / a + 1.96 * 1.96 / (4 * a * a)) / (1 + 1.96 * 1.96 / a), 1), 6) END AS high FROM co""")
def dom9_groups(spark, sf):
    """Which region a supplier is of, by the exponents of its deliveries, from the other suppliers alone."""
    return round_all(domains.holdout_report(domains.group_holdout(leg_vectors(spark, sf))))


@query("dom10_signal_quality", f"WITH {SU}, {LAW('su', 'w')} SELECT k AS series_id, CASE WHEN alpha > 0.7 THEN 'structured' ELSE 'degraded' END AS signal FROM w")
def dom10(spark, sf):
    return domains.signal_quality(structure.analyze(supplier_series(spark, sf), K)).select("series_id", "signal")


@query("dom11_run_to_failure", f"""WITH {SU}, h AS (SELECT k, t, v / 10000 + pow(t / 120e0, 2) AS v FROM su), b AS (SELECT k, avg(v) AS base FROM h WHERE t < 50 GROUP BY k), o AS (SELECT k, base, min(t) AS failure FROM h JOIN b USING (k) WHERE v > 4 * base GROUP BY k, base),
sh AS (SELECT *, unnest([0.5e0, 0.75e0, 0.9e0]) AS share FROM o), pt AS (SELECT k, share, v / (4 * base) AS v, 8 - row_number() OVER (PARTITION BY k, share ORDER BY t DESC) AS x, count(*) OVER (PARTITION BY k, share) AS n FROM h JOIN sh USING (k) WHERE t <= floor(failure * share)),
f AS (SELECT k, share, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, {RSS('v', 'x')} AS ss, regr_sxx(v, x) AS sxx FROM pt WHERE x >= 0 AND n >= 8 GROUP BY k, share),
e AS (SELECT k, share, CASE WHEN abs(b) > sqrt(ss / 6 / greatest(sxx, 1e-12)) AND sign(1 - (a + b * 7)) = sign(b) THEN (1 - (a + b * 7)) / b END AS eta FROM f)
SELECT sh.k AS series_id, round(base, 6) AS base, round(4 * base, 6) AS level, failure, share, round(eta, 6) AS eta, round(eta - (failure - floor(failure * share)), 6) AS error FROM sh LEFT JOIN e USING (k, share)""")
def dom11(spark, sf):
    """A growing wear added to supplier series."""
    s = supplier_series(spark, sf).withColumn("value", F.col("value") / 10000 + F.pow(F.col("tick") / 120.0, F.lit(2)))
    return round_all(domains.run_to_failure(s, K, 50))


@query("src5_select_sensor_columns", "WITH s AS (SELECT 'events' AS asset_id, event_id, value, user_id FROM events), c AS (SELECT event_id, event_id - lag(event_id) OVER (ORDER BY event_id) AS a FROM s) SELECT 'event_id' AS column_name, 'index' AS reason FROM c HAVING count(DISTINCT a) = 1")
def src5(spark, sf):
    from ..sources import readers

    e = table(spark, sf, "events").select(F.lit("events").alias("asset_id"), F.col("event_id").alias("tick"), F.col("event_id").cast("double").alias("event_id"), "value", F.col("user_id").cast("double").alias("user_id"))
    return readers.dropped_columns(e, ["event_id", "value", "user_id"]).select("column_name", "reason")


@query("src8_label_rows", """WITH r AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick, floor(epoch(ts))::BIGINT AS ts FROM events),
l AS (SELECT event_id AS id, event_type AS channel, floor(epoch(ts))::BIGINT + 5 AS a FROM events WHERE value > 150), z AS (SELECT channel, max(tick) AS z FROM r GROUP BY 1)
SELECT l.id, l.channel, coalesce((SELECT min(tick) FROM r WHERE r.channel = l.channel AND r.ts >= l.a), z) AS start_row FROM l JOIN z USING (channel)""")
def src8(spark, sf):
    from ..sources import readers

    e = table(spark, sf, "events").select(F.col("event_type").alias("channel"), F.unix_timestamp("ts").alias("sec"), "ts", "event_id")
    rec = prepare.assign_ticks(e, ["channel"], ["ts", "event_id"]).select("channel", "tick", F.col("sec").alias("ts"))
    lab = table(spark, sf, "events").where("value > 150").select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), (F.unix_timestamp("ts") + 5).alias("at"))
    return readers.rows_at(lab, rec, "channel").select("id", "channel", F.col("row").alias("start_row"))


@query("src14_recording_rms", "WITH e AS (SELECT user_id AS recording, event_type AS channel, event_id // 50 AS tick, value AS v FROM events), w AS (SELECT *, count(v) OVER (PARTITION BY recording, tick) = count(*) OVER (PARTITION BY recording, tick) AS k FROM e) SELECT recording, channel, round(sqrt(avg(v * v)), 6) AS rms FROM w WHERE k GROUP BY ALL")
def src14(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), F.expr("event_id div 50").alias("tick"), "value")
    return round_all(domains.recording_rms(e))


@query("str2_baseline_tracker", f"""WITH {EV}, n AS (SELECT k, count(*) AS n FROM ev GROUP BY k), wi AS (SELECT k, unnest(range(0, n - 255)) AS w FROM n WHERE n >= 256), wr AS (SELECT ev.k || '|' || w AS k, t - w AS t, v FROM ev JOIN wi ON ev.k = wi.k AND t BETWEEN w AND w + 255), {DFA('wr', 'd')},
r AS (SELECT split_part(k, '|', 1) AS k, split_part(k, '|', 2)::BIGINT + 255 AS e, alpha, r2 FROM d), b AS (SELECT k, max_by(alpha, e) AS b FROM r WHERE e < 1000 AND r2 > 0.7 GROUP BY k)
SELECT k AS series_id, e AS end_tick, round(alpha, 6) AS alpha, round(alpha - b, 6) AS shift, {HEALTH.format('(alpha - b)')} AS verdict FROM r JOIN b USING (k) WHERE e >= 1000""")
def str2(spark, sf):
    """Batch twin of the streaming tracker, evaluated at every sample."""
    r = windows.rolling_alpha_fast(event_series(spark, sf), K, 256, 1)
    base = r.where("end_tick < 1000 AND r2 > 0.7").groupBy("series_id").agg(F.max_by("alpha", "end_tick").alias("_b"))
    shift = F.col("alpha") - F.col("_b")
    return round_all(r.where("end_tick >= 1000").join(base, K).select("series_id", "end_tick", "alpha", shift.alias("shift"), verdicts.health(shift).alias("verdict")))


@query("str4_pipe", f"""WITH {EV}, n AS (SELECT k, count(*) AS n FROM ev GROUP BY k), wi AS (SELECT k, unnest(range(0, n - 255)) AS w FROM n WHERE n >= 256), wr AS (SELECT ev.k || '|' || w AS k, t - w AS t, v FROM ev JOIN wi ON ev.k = wi.k AND t BETWEEN w AND w + 255), {DFA('wr', 'd')},
r AS (SELECT split_part(k, '|', 1) AS k, split_part(k, '|', 2)::BIGINT + 255 AS e, alpha, r2 FROM d), s AS (SELECT *, alpha - first_value(alpha) OVER (PARTITION BY k ORDER BY e) AS s FROM r)
SELECT k AS series_id, e AS end_tick, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(s, 6) AS shift, {HEALTH.format('s')} AS verdict FROM s""")
def str4(spark, sf):
    from pyspark.sql import Window

    r = windows.rolling_alpha_fast(event_series(spark, sf), K, 256, 1)
    shift = F.col("alpha") - F.first("alpha").over(Window.partitionBy("series_id").orderBy("end_tick"))
    return round_all(r.select("series_id", "end_tick", "alpha", "r2", shift.alias("shift"), verdicts.health(shift).alias("verdict")))
