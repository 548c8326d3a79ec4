"""Holding out whole groups, paired resampling, sequence profiles, and replay under other settings, against plain versions."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels
from tidewright.operators import domains, evaluate, replay


def vectors(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 3))
    rows = []
    for i in range(160):
        label = int(rng.integers(0, 6))
        rows.append((i, int(rng.integers(0, 9)), label, (centres[label] + rng.normal(size=3) * 0.9).round(6).tolist()))
    return [*rows, (900, 3, 6, [0.0, 0.0, 0.0]), (901, 3, 6, [0.1, 0.0, 0.0]), (902, 3, 6, [0.1, 0.0, 0.0])]


@pytest.mark.parametrize("classes", [1000, 2])
def test_group_holdout(spark, classes):
    rows = vectors(3)
    got = {r.id: (r.truth, r.predicted, r.assessable) for r in domains.group_holdout(spark.createDataFrame(rows, "id long, group long, label int, values array<double>"), classes).collect()}
    want = {}
    for i, g, y, v in rows:
        far = []
        for k in sorted({r[2] for r in rows}):
            others = [r[3] for r in rows if r[2] == k and r[1] != g]
            if others:
                far.append((round(float(((np.array(v) - np.mean(others, axis=0)) ** 2).sum()), 9), k))
        want[i] = (y, min(far)[1], any(k == y for _, k in far))
    assert got == want and sum(not w[2] for w in want.values()) == 3
    report = {r.truth: r for r in domains.holdout_report(domains.group_holdout(spark.createDataFrame(rows, "id long, group long, label int, values array<double>"), classes)).collect()}
    assert (report[6].assessed, report[6].unassessable, report[6].low, report[6].high) == (0, 3, None, None)
    for y, r in report.items():
        n = sum(w[2] for w in want.values() if w[0] == y)
        k = sum(w[2] and w[1] == y for w in want.values() if w[0] == y)
        assert (r.right, r.assessed) == (k, n)
        if n:
            p, z = k / n, 1.96
            mid, half = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
            assert (r.low, r.high) == pytest.approx((max(mid - half, 0), min(mid + half, 1)))


def test_group_holdout_of_one_group(spark):
    got = domains.group_holdout(spark.createDataFrame([(1, 1, 0, [1.0]), (2, 1, 1, [2.0])], "id long, group long, label int, values array<double>")).collect()
    assert sorted((r.id, r.predicted, r.assessable) for r in got) == [(1, None, False), (2, None, False)]


def auc(rows, k):
    up = [(r[k], r[-1]) for r in rows if r[3] == 1]
    down = [(r[k], r[-1]) for r in rows if r[3] == 0]
    total = sum(w for _, w in up) * sum(w for _, w in down)
    return sum(((a > b) + 0.5 * (a == b)) * v * w for a, v in up for b, w in down) / total if total else None


def test_paired_bootstrap(spark):
    rng = random.Random(2)
    rows = [(i, round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1), int(rng.random() < 0.3)) for i in range(60)]
    got = evaluate.bootstrap_difference(spark.createDataFrame([("k", *r) for r in rows], "key string, id long, score_a double, score_b double, label int"), ["key"], 40, 7).first()
    gaps, totals = [], []
    for rep in range(1, 41):
        drawn = []
        for r in rows:
            u = int(hashlib.md5(f"7|{rep}|{r[0]}".encode()).hexdigest()[:8], 16)
            drawn.append((*r, sum(u >= int(c * 2**32) for c in evaluate.POISSON)))
        totals.append(sum(r[-1] for r in drawn))
        a, b = auc(drawn, 1), auc(drawn, 2)
        if a is not None:
            gaps.append(a - b)
    one = [(*r, 1) for r in rows]
    assert (got.a, got.b, got.used) == (pytest.approx(auc(one, 1)), pytest.approx(auc(one, 2)), len(gaps))
    assert (got.low, got.high) == pytest.approx((np.percentile(gaps, 2.5), np.percentile(gaps, 97.5)))
    assert abs(np.mean(totals) - 60) < 4 and evaluate.POISSON[-1] > 1 - 2**-28


def test_paired_bootstrap_with_one_label_only(spark):
    df = spark.createDataFrame([("k", i, 1.0, 2.0, 1) for i in range(5)], "key string, id long, score_a double, score_b double, label int")
    assert evaluate.bootstrap_difference(df, ["key"], 5).count() == 0


def test_sequence_profile(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(v)) for k, n in ((1, 128), (2, 129), (3, 400)) for i, v in enumerate(rng.normal(size=n))]
    got = {(r.k, r.w): (r.alpha, r.end_tick) for r in domains.genome_structure(spark.createDataFrame(rows, "k long, tick long, value double"), ["k"], 128)[1].collect()}
    x = {k: np.array([v for q, _, v in rows if q == k]) for k in (2, 3)}
    want = {(k, w): (float(kernels.dfa(v[w * 64 : w * 64 + 128])[0]), w * 64 + 127) for k, v in x.items() for w in range((len(v) - 128) // 64 + 1)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def recording(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 700))
    x[0, 320:324] += 30
    x[0, 345:349] += 30
    x[1, 600:640] += 25
    return spark.createDataFrame([("a", c, i, float(v)) for c, row in zip("pq", x) for i, v in enumerate(row)], "asset_id string, channel string, tick long, value double")


def test_replay_applies_settings(spark, tmp_path):
    r = recording(spark)
    context = spark.createDataFrame([("a", 290, "mode", "eclipse")], "asset_id string, tick long, kind string, value string")
    found = replay.investigate(r, 250, context)
    path = str(tmp_path / "case")
    replay.save_case(path, r, found, 250, context)
    same = replay.replay(spark, path)
    n = same["fresh"].count()
    assert same["config"].count() == 0 and same["pairs"].where("saved_id IS NULL OR fresh_id IS NULL").count() == 0
    wide = replay.replay(spark, path, config={"gap": 500, "lookback": 100})
    assert wide["fresh"].count() < n
    assert {x.name: (x.saved, x.now) for x in wide["config"].collect()} == {"gap": ("10", "500"), "lookback": ("20", "100")}
    assert wide["context"].count() > 0 and same["context"].count() < wide["context"].count()
    slack = replay.replay(spark, path, config={"horizon": 1e7})
    assert slack["calibration"].count() > 0


def test_settings_travel_with_the_case(spark, tmp_path):
    r, path = recording(spark), str(tmp_path / "case")
    mine = {"gap": 500, "horizon": 1e7, "operator": "x"}
    replay.save_case(path, r, replay.investigate(r, 250, settings=replay.Settings.of(mine)), 250, config=mine)
    again = replay.replay(spark, path)
    assert again["pairs"].where("saved_id IS NULL OR fresh_id IS NULL").count() == 0 and again["calibration"].count() == 0
    assert {x.name for x in again["config"].collect()} == {"operator"}
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("config", F.lit(json.dumps({"gap": "ten"})))
    rows = manifest.collect()
    spark.createDataFrame(rows, manifest.schema).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError):
        replay.replay(spark, path)


@pytest.mark.parametrize("wrong", [{"gap": "10"}, {"gap": 1.5}, {"gap": True}, {"horizon": None}, {"quiet_drift": 1}, {"cusum_k": -1.0}, {"lookback": float("nan")}])
def test_settings_that_do_not_parse(wrong):
    with pytest.raises(ValueError):
        replay.Settings.of(wrong)


def test_portable_fingerprint(spark):
    rows = [("a", 0, 1.5), ("a", 1, 2.0), ("a", 2, None)]
    of = lambda r: tuple(replay.portable_fingerprint(spark.createDataFrame(r, "k string, tick long, value double"), ["k"]).first())
    cells = ["0|1500000", "1|2000000", "2|none"]
    h = [hashlib.md5(c.encode()).hexdigest() for c in cells]
    mixed = 0
    for x in h:
        mixed ^= int(x[8:16], 16)
    assert of(rows) == ("a", 3, sum(int(x[:8], 16) for x in h), mixed) == of(rows[::-1])
    assert of([("a", 0, 2.0), ("a", 1, 1.5), ("a", 2, None)])[2:] != of(rows)[2:]
