"""Readers on awkward files, cases, greedy folds, stretches of series and centroids in blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels
from tidewright.jobs import catalog
from tidewright.operators import domains, evaluate, forecast, guard, replay, windows
from tidewright.sources import readers

from .test_kernels import noise
from .test_monitor import base, long


def put(path, text):
    path.write_text(text)
    return str(path)


def test_separators_are_no_patterns_and_quotes_hold(spark, tmp_path):
    p = put(tmp_path / "a.csv", '"a|b"|x|v\n"1|2"|7|1.5\n"say ""hi"""|8|2.5\n')
    assert [r.value for r in readers.read_series(spark, p, 1, "|").orderBy("tick").collect()] == [7.0, 8.0]
    assert [r.value for r in readers.read_series(spark, p, "V", "|").orderBy("tick").collect()] == [1.5, 2.5]
    q = put(tmp_path / "s.csv", "a|b\n1|2\n3|4|5\n")
    assert [(r.a, r.b, r.invalid_row) for r in readers.read_strict_csv(spark, q, ["a", "b"], "|").orderBy("tick").collect()] == [(1, 2, False), (None, None, True)]


def test_each_header_orders_its_own_files(spark, tmp_path):
    put(tmp_path / "one.csv", "time,p,q\n0,1,2\n1,3,4\n")
    put(tmp_path / "two.csv", "time,q,p\n0,2,1\n1,4,3\n")
    put(tmp_path / "bare.csv", "5;6\n7;8\n")
    got = {(r.asset_id.rsplit("/", 1)[-1], r.tick, r.channel): r.value for r in readers.read_telemetry(spark, str(tmp_path / "*.csv")).collect()}
    for f in ("one.csv", "two.csv"):
        assert [got[f, t, "p"] for t in (0, 1)] == [1, 3] and [got[f, t, "q"] for t in (0, 1)] == [2, 4]
    assert got["bare.csv", 1, "ch0"] == 7 and got["bare.csv", 1, "ch1"] == 8


def test_short_series_and_stretches(spark):
    x, y = noise(700, 3), noise(40, 4)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, tick long, value double")
    for step, chunk in ((1, 64), (7, 100), (8, 8192), (128, 64)):
        got = sorted((r.w, r.end_tick, r.alpha) for r in windows.rolling_alpha_fast(df, ["series_id"], 128, step, chunk).collect())
        want = kernels.rolling_alpha(x, 128, step)[0]
        assert [g[0] for g in got] == list(range(len(want))) and [g[1] for g in got] == [w * step + 127 for w in range(len(want))]
        assert [g[2] for g in got] == pytest.approx(want.tolist())
    assert windows.rolling_alpha_fast(df.where("series_id = 'b'"), ["series_id"], 128, 1).count() == 0
    assert forecast.ewma(df.limit(0).withColumnRenamed("value", "e"), ["series_id"], 5).count() == 0
    assert windows.find_changepoints(df.select("series_id", F.col("tick").alias("block"), F.col("value").alias("alpha")).where("tick < 3"), ["series_id"]).count() == 0


def test_equal_candidates_take_the_least_threshold(spark):
    e = np.r_[np.tile([0.0, 1.0, 0.3, 0.7], 200), 50.0]
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(e)], "k string, tick long, e double")
    assert forecast.find_epsilon(df, ["k"]).first().eps == pytest.approx(e.mean() + 2.5 * e.std()) == pytest.approx(forecast.epsilon(e))


def test_greedy_alarms_over_quiet_stretches(spark):
    rng = random.Random(3)
    ticks = sorted({rng.randint(0, 9000) for _ in range(200)} | {5000 + k for k in range(0, 900, 7)})
    kept, last = [], None
    for t in ticks:
        if last is None or t - last >= 100:
            kept.append(t)
            last = t
    df = spark.createDataFrame([("x", t) for t in ticks] + [("x", ticks[0])], "k string, tick long")
    assert sorted(r.tick for r in evaluate.refractory_alarms(df, ["k"]).collect()) == kept
    d = spark.createDataFrame([(5, 3), (9, 3), (1, 3), (13, 3), (None, 3), (4, 3)], "first_alarm long, change long")
    r = evaluate.delay_stats(d).first()
    assert (r.early, r.detected, r.median_delay) == (1, 4, 6)


def test_centroids_in_blocks_are_those_at_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 5, [float(v) for v in rng.normal(size=4) + i % 5]) for i in range(60)] + [(99, 77, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, label int, values array<double>")
    one, many = (sorted(map(tuple, domains.nearest_centroid_holdout(df, c).collect())) for c in (1000, 2))
    assert one == many and sum(n for *_, n in one) == 60


def test_sentences_of_awkward_texts(spark):
    rng = random.Random(5)
    texts = ["", "short", 'Ab. Cd! "E?" rest of it\r', "...!?. \"x\". y", None] + ["".join(rng.choice("ab .!?\"'\n\r") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", domains.sentence_lengths("t").alias("l"))
    assert {r.i: r.l for r in df.collect()} == {i: domains.sentence_ends(t or "") for i, t in enumerate(texts)}


def test_case_keeps_context_and_settings(spark, tmp_path):
    import pandas as pd

    x = base(1500)
    x[1, 1000:1100] = x[1, 1000]
    df = spark.createDataFrame(pd.concat([long(x)]))
    context = spark.createDataFrame([("a", t, "mode", f"m{t}", t) for t in range(0, 1500, 10)], "asset_id string, tick long, kind string, value string, order long")
    path = str(tmp_path / "case")
    replay.save_case(path, df, replay.investigate(df, 700, context), 700, context, {"operator": "x"})
    again = replay.replay(spark, path)
    assert {r.name: (r.saved, r.now) for r in again["config"].collect()} == {"operator": ("x", "None")}
    assert again["context"].count() > 0 and again["changed"].count() == 0 and replay.load_case(spark, path)["context"].count() == 150
    twice = spark.createDataFrame([("a", 1, 2.0)] * 2, "asset_id string, tick long, value double")
    four = twice.unionByName(twice).unionByName(twice)
    h = [replay.content_fingerprint(d, ["asset_id"]).first() for d in (twice, four)]
    assert h[0].hash == h[1].hash == 0 and h[0].total != h[1].total


SF = "/root/testdata/sf0.001"


def test_planted_faults_of_the_fleet_are_found(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    from tidewright.jobs.registry import fleet

    r = fleet(spark, SF)
    n = r.groupBy("asset_id").agg(F.count_distinct("tick").alias("n")).orderBy(F.desc("n")).first()
    assert r.select("asset_id").distinct().count() > 1 and n.n > 0
    for name in ("leg15_guard", "cal12_calibrate", "inc7_investigate", "leg11_multi_rate_monitor"):
        assert catalog.QUERIES[name](spark, SF).columns
    assert guard.guard(r)[1].count() == r.select("asset_id").distinct().count()
