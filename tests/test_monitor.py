import numpy as np
import pandas as pd
import pytest

from tidewright.functions import monitor as mon
from tidewright.operators import calibrate, guard, incidents, legs, replay


def base(n=4000, c=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(c, n))
    x[1] += x[0]
    return x


def run(x, start=1500):
    g = mon.Guard(mon.Calibration.of(x[:, :start]))
    return [(t, e[0], e[2], e[3]) for t in range(start, x.shape[1]) for e in g.push(x[:, t].tolist(), np.isfinite(x[:, t]).tolist())]


def test_clean_stream_is_silent():
    assert run(base()) == []


def test_stuck_sensor_is_quarantined_and_comes_back():
    x = base()
    x[2, 2000:2100] = x[2, 2000]
    kinds = [(k, c) for _, k, c, _ in run(x)]
    assert kinds == [("alarm", 2), ("quarantined", 2), ("unquarantined", 2)]


def test_missing_samples():
    x = base()
    x[0, 2000:2010] = np.nan
    found = run(x)
    assert found[0][1:] == ("alarm", 0, "packet_loss") and found[1][1] == "quarantined"


def test_level_shift_is_learned():
    x = base()
    x[0, 2000:] += 1.2
    kinds = [k for _, k, _, _ in run(x)]
    assert "adaptation_started" in kinds and "recalibrated" in kinds


def test_too_short_to_calibrate():
    assert mon.Calibration.of(base(150)) is None


def long(x, asset="a"):
    return pd.DataFrame([(asset, f"c{c}", t, float(v)) for c, row in enumerate(x) for t, v in enumerate(row)], columns=["asset_id", "channel", "tick", "value"])


def test_relational_calibration_is_the_kernels(spark):
    x = base(640)
    df = spark.createDataFrame(long(x))
    cal = mon.Calibration.of(x)
    fit = {r.channel: r for r in calibrate.fit_ar1(df).collect()}
    for i in range(3):
        assert (fit[f"c{i}"].a, fit[f"c{i}"].b, fit[f"c{i}"].sd) == pytest.approx((cal.a[i], cal.b[i], cal.sd[i]), abs=1e-9)
    z = calibrate.ar1_residual_z(df, calibrate.fit_ar1(df))
    from pyspark.sql import functions as F

    thr = calibrate.gumbel_return_level(calibrate.channel_max(z, F.abs("z")), ["asset_id"], 1e6).first().threshold
    assert thr == pytest.approx(cal.res_thr, abs=1e-9)
    recon = {(r.channel, r.source): r for r in calibrate.fit_reconstructors(df).collect()}
    assert recon["c0", "c1"].weight == pytest.approx(cal.weights[0, 1], abs=1e-9) and recon["c0", "c1"].sd == pytest.approx(cal.recon_sd[0], abs=1e-6)


def test_guard_incidents_case_and_replay(spark, tmp_path):
    x = base(2400)
    x[2, 1800:1900] = x[2, 1800]
    df = spark.createDataFrame(pd.concat([long(x), long(base(2400, seed=4), "b")]))
    kept, summary = guard.guard(df, baseline=lambda n: 1200)
    by = {r.asset_id: r for r in summary.collect()}
    assert by["a"].quarantines == 1 and by["b"].verdict == "healthy"
    found = replay.investigate(df, 1200)
    assert found["incidents"].count() == 1
    replay.save_case(str(tmp_path / "case"), df, found, 1200)
    again = replay.replay(spark, str(tmp_path / "case"))
    pair = again["pairs"].collect()
    assert len(pair) == 1 and pair[0].delta == 0
    assert again["calibration"].count() == 0 and again["changed"].count() == 0
    assert again["evidence"].where("added + removed + changed > 0").count() == 0


def test_dedupe_looks_at_raw_alarms(spark):
    a = spark.createDataFrame([("a", "c", t, "dfa") for t in (0, 40, 80, 200)], "asset_id string, channel string, tick long, leg string")
    assert sorted(r.tick for r in legs.dedupe_alarms(a).collect()) == [0, 200]


def test_incidents_gap(spark):
    e = spark.createDataFrame([("a", t, k, "c", "l", 1.0, 1.0) for t, k in ((1, "rolled_back"), (5, "alarm"), (14, "alarm"), (20, "rolled_back"), (29, "alarm"), (50, "alarm"))], "asset_id string, tick long, kind string, channel string, leg string, observed double, threshold double")
    got = [(r.start_tick, r.end_tick) for r in incidents.spans(incidents.group_incidents(e)).orderBy("start_tick").collect()]
    assert got == [(5, 29), (50, 50)]


def faulty(seed, n=1800):
    """Channels that stick, shift, drift, drop out, widen and jump at random."""
    r = np.random.default_rng(seed)
    c = 2 + seed % 4
    x = r.normal(size=(c, n))
    x[1] += x[0]
    for _ in range(r.integers(2, 9)):
        a, ch, what = int(r.integers(500, n)), r.integers(c), r.integers(6)
        b = min(n, a + int(r.integers(10, 900)))
        x[ch, a:b] = {0: x[ch, a] + np.zeros(b - a), 1: x[ch, a:b] + 2, 2: np.where(r.random(b - a) < 0.3, np.nan, x[ch, a:b]), 3: x[ch, a:b] + np.arange(b - a) * 0.01, 4: x[ch, a:b] * 5, 5: x[ch, a:b] + 30 * (np.arange(b - a) == 0)}[int(what)]
    if seed % 3 == 0:
        x[0, 300:305] = np.nan
    return x


def told(found):
    return [(k, kind, ch, fault, *((a.leg, a.hit_gap, round(a.observed, 7)) if a else ())) for k, events in found for kind, a, ch, fault in events]


@pytest.mark.parametrize("config", [mon.Config(), mon.Config(1e4, 0.5, True, 10, 2, 3), mon.Config(1e3)])
def test_blocks_of_ticks_are_ticks_one_by_one(config):
    """The guard over a recording, and over batches of it, against one tick after another; and it skips most of them."""
    seen = 0
    for seed in range(5):
        x = faulty(seed)
        cal = lambda: mon.Calibration.of(guard.filled(x[:, :300]), config)
        g = mon.Guard(cal(), seed % 2 == 0)
        want = told([(k, g.push(col.tolist(), np.isfinite(col).tolist())) for k, col in enumerate(x[:, 300:].T)])
        assert told(mon.Guard(cal(), seed % 2 == 0).run(x[:, 300:])) == want
        g, got, at = mon.Guard(cal(), seed % 2 == 0), [], 300
        while at < x.shape[1]:
            size = int(np.random.default_rng(at).integers(1, 500))
            got += told([(at - 300 + k, e) for k, e in g.run(x[:, at : at + size])])
            at += size
        assert got == want
        seen += len(want)
    assert seen > 20


def test_quiet_ticks_are_not_walked(monkeypatch):
    x, walked, push = base(), [], mon.Monitor.push
    monkeypatch.setattr(mon.Monitor, "push", lambda *a: walked.append(1) or push(*a))
    assert list(mon.Guard(mon.Calibration.of(x[:, :1500])).run(x[:, 1500:])) == [] and len(walked) < 100


def test_readings_know_their_windows_ahead(monkeypatch):
    """Channels on their own clocks: alarms as reading by reading, without a fit for each."""
    x, rng = faulty(3), np.random.default_rng(1)
    cal = mon.Calibration.of(guard.filled(x[:, :300]))
    order = np.sort(rng.permutation(x[:, 300:].size)[:2500])
    ch, v = order % len(x), x[:, 300:].T.reshape(-1)[order]
    slow, want = mon.Monitor(cal), []
    for k, (c, value) in enumerate(zip(ch.tolist(), v.tolist())):
        if alarm := slow.feed(c, value if np.isfinite(value) else None):
            want.append((k, alarm.leg, alarm.channel, round(alarm.observed, 7)))
            slow.clear()
    fits, dfa = [], mon.kernels.dfa
    monkeypatch.setattr(mon.kernels, "dfa", lambda w: fits.append(1) or dfa(w))
    got = [(k, a.leg, a.channel, round(a.observed, 7)) for k, a in mon.Monitor(cal).readings(ch, v)]
    assert got == want and want and len(fits) < 100


def test_alarms_of_a_recording():
    for seed in range(3):
        x = faulty(seed)
        cal = mon.Calibration.of(guard.filled(x[:, :300]))
        m, want = mon.Monitor(cal), []
        for k, col in enumerate(x[:, 300:].T):
            if alarm := m.push(col.tolist(), np.isfinite(col).tolist()):
                want.append((k, alarm.leg, alarm.channel))
                m.clear()
        assert [(k, a.leg, a.channel) for k, a in mon.Monitor(cal).alarms(x[:, 300:])] == want


def test_a_case_makes_its_recording_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    plain = spark.createDataFrame(long(base(300, c=2)))

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    none = spark.createDataFrame([], "asset_id string")
    replay.save_case(str(tmp_path / "case"), plain.mapInPandas(count, plain.schema), dict.fromkeys(("events", "evidence", "incidents", "calibration"), none), 192)
    saved = replay.load_case(spark, str(tmp_path / "case"))
    assert made.value == 600 and saved["manifest"].first().rows == 600 and saved["channels"].count() == 2
    assert saved["manifest"].select("hash", "total").first() == replay.content_fingerprint(plain, ["asset_id"]).select("hash", "total").first()
