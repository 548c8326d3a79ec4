"""What reads a fleet once for all that it gives."""

import numpy as np
import pandas as pd

from tidewright.operators import guard, prepare, replay

from .test_monitor import base, long


def test_the_guard_watches_once_for_alarms_and_the_rest(spark):
    df = spark.createDataFrame(long(base(900)))
    plan = guard.guard(df)[1]._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan


def test_one_pass_gives_events_and_calibration(spark):
    x = base(1200)
    x[1, 900:] += 9
    df = spark.createDataFrame(long(x))
    events, learned = guard.watched(df, lambda n: 400)
    for one, other in ((events, guard.autopilot(df, lambda n: 400)), (learned, guard.calibrate(df, lambda n: 400))):
        assert one.dtypes == other.dtypes and sorted(map(str, one.collect())) == sorted(map(str, other.collect())) and one.count()


def test_an_investigation_runs_no_pass_for_its_calibration(spark):
    found = replay.investigate(spark.createDataFrame(long(base(900))), 400)
    assert found["calibration"].count() == 3
    assert "Pandas" not in found["calibration"]._jdf.queryExecution().executedPlan().toString()


def test_fit_assets_are_those_of_the_imputed_recording(spark):
    x = base(60)
    x[0, 3] = np.nan
    y = base(60, seed=1)
    y[2, :9] = np.nan
    late = base(60, seed=2)
    late[1, 30:] = np.nan
    df = spark.createDataFrame(pd.concat([long(x, "x"), long(y, "y"), long(late, "z")]))
    fit, bad = replay.fit_assets(df, 30)
    filled, quality = prepare.impute_calibration(df, ["asset_id", "channel"], 30)
    assert [r.asset_id for r in bad.collect()] == ["y"] == [r.asset_id for r in quality.where("rejected").collect()]
    want = sorted((r.asset_id, r.channel, r.tick, str(round(r.value, 9))) for r in filled.where("asset_id <> 'y'").collect())
    assert sorted((r.asset_id, r.channel, r.tick, str(round(r.value, 9))) for r in fit.collect()) == want
