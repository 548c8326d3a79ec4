"""Forms for large tables: files in order whatever Spark makes of a plan, ranges and labels that meet in cells, all of it against plain versions."""

import glob
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.jobs import incident_queries, source_queries, window_queries
from tidewright.operators import calibrate, incidents, prepare

from .test_changepoints import recursion


@pytest.fixture
def small_partitions(spark):
    """Shuffles of a few rows in as many partitions as those of large tables have."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1200b", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_key_is_one_file_in_order(spark, tmp_path, small_partitions):
    rows = [(f"k{i % 5}", i, i) for i in range(3000)]
    e = prepare.assign_ticks(spark.createDataFrame(rows, "series_id string, at long, x long").repartition(3), ["series_id"], ["at"])
    body = e.select("series_id", "tick", F.col("x").cast("string").alias("value"))
    top = [e.select("series_id").distinct().select("series_id", F.lit(t).alias("tick"), F.lit(v).alias("value")) for t, v in ((-2, "# note"), (-1, "head"))]
    source_queries.written(body.unionByName(top[0]).unionByName(top[1]), "series_id", ["tick"], f"{tmp_path}/out")
    for k in range(5):
        (only,) = glob.glob(f"{tmp_path}/out/k=k{k}/*.txt")
        assert open(only).read().split() == ["#", "note", "head", *[str(x) for _, _, x in rows if x % 5 == k]]


def test_context_in_ranges_of_any_length(spark):
    rng = random.Random(4)
    ranges = [(f"a{rng.randrange(2)}", i, s, s + rng.choice([0, 1, 3, 17, 900, 40_000, -2])) for i, s in ((i, rng.randrange(-50, 50_000)) for i in range(60))]
    points = [(f"a{rng.randrange(3)}", rng.randrange(-50, 60_000), "k", str(i)) for i in range(800)] + [(a, t, "k", f"e{i}{t}") for a, i, s, e in ranges for t in (s, e, e + 1)]
    r = spark.createDataFrame(ranges, "asset_id string, incident_id long, start_tick long, end_tick long")
    got = incidents.context_in_range(r, spark.createDataFrame(points, "asset_id string, tick long, kind string, value string"))
    assert got.columns == ["asset_id", "incident_id", "start_tick", "end_tick", "tick", "kind", "value"]
    want = sorted((a, i, s, e, *p[1:]) for a, i, s, e in ranges for p in points if p[0] == a and s <= p[1] <= e)
    assert sorted(map(tuple, got.collect())) == want
    assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString()


def test_labels_that_overlap(spark):
    rng = random.Random(5)
    labels = [("s", s, s + rng.choice([0, 1, 5, 64, 777, -1]), o, rng.randrange(1, 4)) for o, s in enumerate(rng.randrange(-30, 3000) for _ in range(150))]
    times = sorted({rng.randrange(-40, 4000) for _ in range(900)} | {e for _, s, e, *_ in labels} | {e + 1 for _, s, e, *_ in labels} | {s for _, s, *_ in labels})
    df = spark.createDataFrame([(k, t) for k in "su" for t in times], "series_id string, ts long")
    got = prepare.apply_interval_labels(df, spark.createDataFrame(labels, "series_id string, start long, end long, label_order long, code int"), ["series_id"])
    want = {("s", t): next((c for _, s, e, _, c in reversed(labels) if s <= t <= e), 0) for t in times} | {("u", t): 0 for t in times}
    assert {(x.series_id, x.ts): x.code for x in got.collect()} == want
    # one label a cell: what meets a time does not grow with the labels that hold it
    assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString()


def test_ties_of_a_mean_round_alike(spark):
    values = [0.0403125, 0.040312499999999994, 0.040312500000000015]
    rows = incident_queries.settled(spark.createDataFrame([(v,) for v in values], "saved double")).collect()
    assert {r.saved for r in rows} == {0.040313}


def test_change_points_in_sql_of_any_depth():
    """A staircase that comes apart step by step, deeper than seven levels."""
    rng = np.random.default_rng(3)
    alphas = (np.repeat(0.5 + 1.7 ** np.arange(14), 4) + rng.normal(size=56) * 0.005).tolist()
    con = duckdb.connect()
    con.execute("CREATE TABLE given (k VARCHAR, block BIGINT, alpha DOUBLE)")
    con.executemany("INSERT INTO given VALUES ('s', ?, ?)", list(enumerate(alphas)))
    got = con.execute(f"WITH RECURSIVE b AS (SELECT * FROM given), {window_queries._SPLITS} SELECT location, seg FROM p").fetchall()
    every = con.execute(f"WITH RECURSIVE b AS (SELECT * FROM given), {window_queries._SPLITS} SELECT max(length(seg)) FROM sp").fetchall()
    assert sorted(x for x, _ in got) == [p[0] for p in recursion(alphas, 10)]
    assert every[0][0] > 7, every


def test_other_channels_speak_where_they_are(spark):
    """Predictions by asset against a loop over ticks, with channels that are not always there."""
    rng = random.Random(6)
    rows = [(a, c, t, rng.gauss(3, 2) + t % 7) for a in "xy" for c in "pqr" for t in range(120) if c == "p" or (t + len(a + c)) % 5]
    rows += [("z", "p", t, float(t)) for t in range(9)]
    df = spark.createDataFrame(rows, "asset_id string, channel string, tick long, value double")
    recon = calibrate.fit_reconstructors(df)
    weights = {}
    for r in recon.collect():
        weights.setdefault((r.asset_id, r.channel), []).append(r)
    value = {(a, c, t): v for a, c, t, v in rows}
    want = {}
    for (a, c, t), v in value.items():
        there = [r.weight * value[a, r.source, t] for r in weights[a, c] if r.source and (a, r.source, t) in value]
        if there:
            want[a, c, t] = weights[a, c][0].bias + sum(there)
    parity = calibrate.parity_z(df, recon)
    got = {(r.asset_id, r.channel, r.tick): r.predicted for r in parity.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # one read of the rows serves all channels that ask
    assert parity._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
