"""Named queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.prepare import assign_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order give the same row."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def event_series(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Series of events.value by a key, in the order of time."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col(key).alias("series_id"), "ts", "event_id", "value")
    return assign_ticks(e, ["series_id"], ["ts", "event_id"]).select("series_id", "tick", "value")


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of lineitem prices by supplier, in the order of shipping."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_extendedprice").alias("value"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return assign_ticks(rows, ["series_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "value"]).select("series_id", "tick", "value")


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series: the orders' total of each day."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return assign_ticks(days.withColumn("series_id", F.lit("orders")), ["series_id"], ["day"]).select("series_id", "tick", "value")


def recording(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """One asset of as many channels as event types: mean values of time buckets, with real gaps (null)."""
    s = 60 * minutes
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", F.floor(F.unix_timestamp("ts") / s).alias("b"))
    cells = e.groupBy(F.col("event_type").alias("channel"), "b").agg(F.avg("value").alias("value"))
    span = e.agg(F.min("b").alias("a"), F.max("b").alias("z"))
    grid = span.select(F.explode(F.sequence("a", "z")).alias("b"), "a").join(F.broadcast(e.select(F.col("event_type").alias("channel")).distinct()))
    full = grid.join(cells, ["channel", "b"], "left")
    return full.select(F.lit("events").alias("asset_id"), "channel", (F.col("b") - F.col("a")).alias("tick"), "value")


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many assets of four channels: every supplier's deliveries in the order of shipping. A price under 5000 is a missing
    sample. Faults are planted in the last quarter: every fourth supplier's quantity stays at one value, every other
    fourth's price moves up.

    Rows are dealt out by asset once; what follows by asset, or by asset and more, finds them where they are."""
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("asset_id"), F.col("l_suppkey").alias("s"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    r = assign_ticks(rows, ["asset_id"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    r = r.withColumn("_n", F.count("*").over(Window.partitionBy("asset_id")))
    late = F.col("tick") >= F.col("_n") * 3 / 4
    quantity = F.when(late & (F.col("s") % 4 == 0), 7.0).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_extendedprice") >= 5000, F.col("l_extendedprice") + F.when(late & (F.col("s") % 4 == 1), 60000.0).otherwise(0.0))
    named = [("quantity", quantity), ("price", price), ("discount", F.col("l_discount")), ("tax", F.col("l_tax"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), v.alias("value")) for c, v in named])).alias("x")
    return r.select("asset_id", "tick", each).select("asset_id", "x.channel", "tick", "x.value")


def days(c: str) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01"))


#: The same series for DuckDB, as common table expressions (k, t, v).
EV = "ev AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS v FROM events WHERE value IS NOT NULL)"
US = "us AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events WHERE value IS NOT NULL)"
SU = "su AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t, l_extendedprice AS v FROM lineitem)"
FLEET = """f0 AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS t, count(*) OVER (PARTITION BY l_suppkey) AS n, * FROM lineitem),
fl AS (SELECT 's' || s AS k, unnest(['quantity', 'price', 'discount', 'tax']) AS c, t, unnest([CASE WHEN t >= n * 0.75 AND s % 4 = 0 THEN 7 ELSE l_quantity END, CASE WHEN l_extendedprice >= 5000 THEN l_extendedprice + CASE WHEN t >= n * 0.75 AND s % 4 = 1 THEN 60000 ELSE 0 END END, l_discount, l_tax]) AS v FROM f0)"""
DAY = "od AS (SELECT 'orders' AS k, row_number() OVER (ORDER BY day) - 1 AS t, v FROM (SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1))"


def REC(minutes: int = 60) -> str:  # noqa: N802
    """rec(c, t, v): channel, tick, value or null."""
    s = 60 * minutes
    return f"""
re AS (SELECT event_type AS c, value AS v, floor(epoch(ts) / {s})::BIGINT AS b FROM events WHERE value IS NOT NULL),
rg AS (SELECT unnest(range(min(b), max(b) + 1)) AS b, min(b) AS a FROM re),
rec AS (SELECT c, b - a AS t, v FROM rg CROSS JOIN (SELECT DISTINCT c FROM re) LEFT JOIN (SELECT c, b, avg(v) AS v FROM re GROUP BY c, b) USING (c, b))"""


def FIT(x: str, y: str) -> str:  # noqa: N802
    """slope and r2 aggregates."""
    return f"count(*) AS pts, regr_slope({y}, {x}) AS slope, 1 - (regr_syy({y}, {x}) - regr_sxy({y}, {x}) * regr_sxy({y}, {x}) / regr_sxx({y}, {x})) / greatest(regr_syy({y}, {x}), 1e-15) AS r2"


def RSS(y: str, t: str) -> str:  # noqa: N802
    return f"greatest(regr_syy({y}, {t}) - regr_sxy({y}, {t}) * regr_sxy({y}, {t}) / regr_sxx({y}, {t}), 0)"


def BOXES(rows: str, by: str) -> str:  # noqa: N802
    """(by, f2): mean squared residual of the linear fit of each group of rows (s, y, t), each point's own residual summed."""
    return f"""SELECT {by}, sum((y - ym - b * (t - tm)) * (y - ym - b * (t - tm))) / any_value(s) AS f2
      FROM (SELECT *, avg(y) OVER g AS ym, avg(t) OVER g AS tm, regr_slope(y, t) OVER g AS b FROM ({rows}) WINDOW g AS (PARTITION BY {by})) GROUP BY {by}"""


_POWERS = "[1e0, r, r2, r * r2, r4, r * r4, r2 * r4, (r * r2) * r4, r8, r * r8, r2 * r8, (r * r2) * r8]"


def PROFILE(src: str, o: str) -> str:  # noqa: N802
    return f"""
{o}_n AS (SELECT k, count(*) AS n, avg(v) AS m FROM {src} GROUP BY k),
{o}_p AS (SELECT k, t, n, sum(v - m) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS y FROM {src} JOIN {o}_n USING (k))"""


def DFA(src: str, o: str) -> str:  # noqa: N802
    """CTEs that end in o(k, n, alpha, r2)."""
    return f"""{PROFILE(src, o)},
{o}_r AS (SELECT *, pow(b / a, 1e0 / 11e0) AS r FROM (SELECT k, n, greatest(16, n // 50) AS a, n // 4 AS b FROM {o}_n) WHERE a < b),
{o}_q AS (SELECT *, r4 * r4 AS r8 FROM (SELECT *, r2 * r2 AS r4 FROM (SELECT *, r * r AS r2 FROM {o}_r))),
{o}_s AS (SELECT DISTINCT k, n, s FROM (SELECT k, n, b, floor(a * unnest({_POWERS}))::BIGINT AS s FROM {o}_q) WHERE s <= b),
{o}_b AS ({BOXES(f"SELECT k, s, t // s AS box, t, y FROM {o}_p JOIN {o}_s USING (k, n) WHERE t < s * (n // s)", "k, s, box")}),
{o}_f AS (SELECT k, s, avg(f2) AS f2 FROM {o}_b GROUP BY k, s),
{o}_l AS (SELECT k, avg(y * y) * 1e-24 AS q FROM {o}_p GROUP BY k),
{o}_t AS (SELECT k, {FIT('ls', 'lf')} FROM (SELECT k, ln(s) AS ls, ln(sqrt(f2)) AS lf FROM {o}_f JOIN {o}_l USING (k) WHERE f2 > q) GROUP BY k),
{o} AS (SELECT k, n, CASE WHEN n >= 64 AND pts >= 3 THEN slope ELSE 0.5 END AS alpha, CASE WHEN n >= 64 AND pts >= 3 THEN r2 ELSE 0 END AS r2
        FROM {o}_n LEFT JOIN {o}_t USING (k))"""


def DFA_SHORT(src: str, o: str) -> str:  # noqa: N802
    return f"""{PROFILE(src, o)},
{o}_r AS (SELECT *, pow(b / 4e0, 1e0 / 9e0) AS r FROM (SELECT k, n, greatest(n // 4, 5) AS b FROM {o}_n)),
{o}_q AS (SELECT *, r4 * r4 AS r8 FROM (SELECT *, r2 * r2 AS r4 FROM (SELECT *, r * r AS r2 FROM {o}_r))),
{o}_s AS (SELECT DISTINCT k, n, s FROM (SELECT k, n, b, floor(unnest({_POWERS.replace(', r2 * r8, (r * r2) * r8', '')}) * 4e0 + 1e-9)::BIGINT AS s FROM {o}_q) WHERE s BETWEEN 4 AND b),
{o}_w AS (SELECT k, s, n, y, t, 0 AS way, t AS x FROM {o}_p JOIN {o}_s USING (k, n) UNION ALL SELECT k, s, n, y, t, 1, n - 1 - t FROM {o}_p JOIN {o}_s USING (k, n)),
{o}_b AS ({BOXES(f"SELECT k, s, way, x // s AS box, t, y FROM {o}_w WHERE x < s * (n // s)", "k, s, way, box")}),
{o}_f AS (SELECT k, s, avg(f2) AS f2 FROM {o}_b GROUP BY k, s),
{o}_l AS (SELECT k, avg(y * y) * 1e-24 AS q FROM {o}_p GROUP BY k),
{o}_t AS (SELECT k, {FIT('ls', 'lf')} FROM (SELECT k, ln(s) AS ls, ln(sqrt(f2)) AS lf FROM {o}_f JOIN {o}_l USING (k) WHERE f2 > q) GROUP BY k),
{o}_c AS (SELECT k, min(v) < max(v) AS varies FROM {src} GROUP BY k),
{o} AS (SELECT k, n, CASE WHEN n >= 16 AND varies AND pts >= 3 THEN slope END AS alpha, CASE WHEN n >= 16 AND varies AND pts >= 3 THEN r2 END AS r2
        FROM {o}_n JOIN {o}_c USING (k) LEFT JOIN {o}_t USING (k))"""


def ACR(src: str, o: str) -> str:  # noqa: N802
    lags = "[1, 2, 3, 5, 8, 13, 21, 34, 55, 89]"
    return f"""
{o}_n AS (SELECT k, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM {src} GROUP BY k),
{o}_d AS (SELECT k, t, v - m AS d FROM {src} JOIN {o}_n USING (k)),
{o}_v AS (SELECT k, sum(d * d) AS vv FROM {o}_d GROUP BY k),
{o}_g AS (SELECT unnest({lags}) AS lag),
{o}_r AS (SELECT a.k, lag, sum(a.d * b.d) AS num FROM {o}_d a CROSS JOIN {o}_g g JOIN {o}_d b ON a.k = b.k AND b.t = a.t + g.lag GROUP BY a.k, lag),
{o}_t AS (SELECT k, {FIT('x', 'y')} FROM (SELECT k, ln(lag) AS x, ln(num / vv) AS y FROM {o}_r JOIN {o}_v USING (k) JOIN {o}_n USING (k)
          WHERE n >= 20 AND NOT (sd = 0 OR sd <= 1e-12 * abs(m)) AND lag < n // 2 AND num / vv > 0.001) GROUP BY k),
{o} AS (SELECT k, CASE WHEN pts >= 3 THEN slope ELSE 0 END AS acr_alpha, CASE WHEN pts >= 3 THEN r2 ELSE 0 END AS acr_r2 FROM {o}_n LEFT JOIN {o}_t USING (k))"""


def LAW(src: str, o: str) -> str:  # noqa: N802
    """o(k, n, mean, sd, kurtosis, p99, max, alpha, r2, acr_alpha, acr_r2, hurst, quality)."""
    return f"""{DFA(src, o + 'd')},{ACR(src, o + 'a')},
{o}_k AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS r, count(*) OVER (PARTITION BY k) AS c FROM {src}),
{o}_m AS (SELECT k, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd, kurtosis_pop(v) + 3 AS kurtosis,
                 max(CASE WHEN r = least(floor(c * 0.99), c - 1) + 1 THEN v END) AS p99, max(v) AS max FROM {o}_k GROUP BY k),
{o}_x AS (SELECT *, n < 20 AS few, n >= 20 AND (sd = 0 OR sd <= 1e-12 * abs(mean)) AS flat, greatest(r2, acr_r2) AS best
          FROM {o}_m JOIN (SELECT k, alpha, r2 FROM {o}d) USING (k) JOIN {o}a USING (k)),
{o} AS (SELECT k, n, CASE WHEN few THEN 0 ELSE mean END AS mean, CASE WHEN few OR flat THEN 0 ELSE sd END AS sd, CASE WHEN few OR flat THEN 0 ELSE kurtosis END AS kurtosis,
        CASE WHEN few THEN 0 WHEN flat THEN mean ELSE p99 END AS p99, CASE WHEN few THEN 0 WHEN flat THEN mean ELSE max END AS max,
        CASE WHEN few OR flat THEN 0.5 ELSE alpha END AS alpha, CASE WHEN few OR flat THEN 0 ELSE r2 END AS r2,
        CASE WHEN few OR flat THEN 0 ELSE acr_alpha END AS acr_alpha, CASE WHEN few OR flat THEN 0 ELSE acr_r2 END AS acr_r2,
        CASE WHEN few OR flat THEN 0.5 ELSE greatest(0, least(1, 1 + acr_alpha / 2)) END AS hurst,
        CASE WHEN few THEN 'Insufficient' WHEN flat THEN 'Abstain' WHEN best > 0.95 THEN 'Exact' WHEN best > 0.85 THEN 'Strong' WHEN best > 0.7 THEN 'Good' WHEN best > 0.3 THEN 'Approx' ELSE 'Abstain' END AS quality
        FROM {o}_x)"""


HEALTH = "CASE WHEN abs({0}) < 0.03 THEN 'Healthy' WHEN abs({0}) < 0.08 THEN 'Watch' WHEN abs({0}) < 0.15 THEN 'Warning' ELSE 'Critical' END"
SIGNAL = "CASE WHEN r2 < 0.3 THEN 'UNCLASSIFIABLE' WHEN alpha < 0.3 THEN 'ANTI-CORRELATED' WHEN alpha < 0.6 THEN 'WHITE NOISE' WHEN alpha < 0.85 THEN 'CORRELATED' WHEN alpha < 1.15 THEN '1/f NOISE' WHEN alpha < 1.65 THEN 'BROWNIAN MOTION' ELSE 'PERSISTENT' END"
