import json

from pyspark.sql import functions as F

from tidewright.operators import domains, evaluate, forecast, prepare
from tidewright.sources import readers, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_series(spark, tmp_path):
    p = put(tmp_path / "a.csv", "# note\nt,Value\n0,1.5\n\n1,x\n2,3\n")
    assert [(r.tick, r.value) for r in readers.read_series(spark, p).orderBy("tick").collect()] == [(0, 1.5), (1, 3.0)]
    assert [r.value for r in readers.read_series(spark, p, "T").orderBy("tick").collect()] == [0.0, 1.0, 2.0]
    assert readers.read_series(spark, p, 0).count() == 3


def test_telemetry(spark, tmp_path):
    p = put(tmp_path / "w.csv", '"Temp, C";mode;b\n1;on;\n;off;\n2;on;7\n')
    got = sorted((r.tick, r.channel, r.value) for r in readers.read_telemetry(spark, p).collect() if r.value is not None)
    assert got == [(0, "Temp, C", 1.0), (1, "Temp, C", 2.0), (1, "b", 7.0)]


def test_strict_csv_keeps_all_rows(spark, tmp_path):
    p = put(tmp_path / "s.csv", "time,a,b\n0,1,2\n1,5\n2,x,4\n3,1,2,9\n")
    rows = readers.read_strict_csv(spark, p, ["time", "a", "b"]).orderBy("tick").collect()
    assert [(r.a, r.b, r.invalid_row) for r in rows] == [(1, 2, False), (None, None, True), (None, 4, False), (None, None, True)]


def test_roles_and_dropped_columns(spark):
    assert readers.column_roles(["Timestamp", "op_mode", "cmd_x", "v"]) == {"Timestamp": "timestamp", "op_mode": "mode", "cmd_x": "command", "v": "measurement"}
    df = spark.createDataFrame([("a", i, float(i), 100.0 + i * i, float(i % 3)) for i in range(20)], "asset_id string, tick long, row double, my_time double, v double")
    assert {r.column_name: r.reason for r in readers.dropped_columns(df, ["row", "my_time", "v"]).collect()} == {"row": "index", "my_time": "time"}
    assert readers.dropped_columns(df, ["row"]).count() == 0


def test_labels(spark, tmp_path):
    p = put(tmp_path / "l.json", json.dumps({"s1": [["2020-01-01 00:00:00", "2020-01-01 01:00:00"]], "s2": []}))
    assert readers.read_label_windows(spark, p).count() == 1
    q = put(tmp_path / "seq.csv", 'chan_id,spacecraft,anomaly_sequences,class,num_values\nP-1,SMAP,"[[1, 5], [7, 9]]","[contextual, point]",100\n')
    rows = readers.read_label_sequences(spark, q).orderBy("seq").collect()
    assert [(r.start, r.end, r["class"]) for r in rows] == [(1, 5, "contextual"), (7, 9, "point")]
    rec = spark.createDataFrame([("c", i, 10 * i) for i in range(5)], "channel string, tick long, ts long")
    lab = spark.createDataFrame([(1, "c", 11), (2, "c", 999), (3, "c", 20)], "id long, channel string, at long")
    assert {r.id: r.row for r in readers.rows_at(lab, rec, "channel").collect()} == {1: 2, 2: 4, 3: 2}


def test_context_errors(spark, tmp_path):
    good = put(tmp_path / "c.csv", "tick,kind,value\n5,mode,a\n5,mode,b\n")
    assert readers.read_context(spark, good).count() == 2
    bad = put(tmp_path / "d.csv", "tick,kind,value\nx,mode,a\n")
    try:
        readers.read_context(spark, bad)
        raise AssertionError
    except ValueError:
        pass


def test_archive_and_fasta(spark, tmp_path):
    p = put(tmp_path / "001_UCR_x_100_150_160.txt", " 1.0 2.0\n3.0\n")
    r = readers.read_archive_series(spark, p).orderBy("tick").collect()
    assert [x.value for x in r] == [1, 2, 3] and (r[0].train_end, r[0].begin, r[0].end) == (100, 150, 160)
    f = put(tmp_path / "g.fa", ">x\nGGCC\nAATT\n>y\nNN\n")
    bases = readers.read_fasta(spark, f)
    assert "".join(x.base for x in bases.orderBy("pos").collect()) == "GGCCAATTNN"
    w = prepare.gc_windows(bases, ["contig"], 4).orderBy("tick").collect()
    assert [x.value for x in w] == [1.0, 0.0]


def test_sinks(spark, tmp_path):
    ev = spark.createDataFrame([("a", 1, "alarm")], "asset_id string, tick long, kind string")
    sinks.write_events_json(ev, spark.createDataFrame([("a", 10)], "asset_id string, samples long"), str(tmp_path / "j"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert {"asset_id": "a", "tick": 1, "kind": "alarm"} in lines and any(x.get("type") == "summary" for x in lines)
    sinks.write_row_scores(spark.createDataFrame([("s", 1, 0.5), ("s", 0, 0.25)], "k string, tick long, score double"), str(tmp_path / "r"), ["k"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["0.250000", "0.500000"]


def test_sentences():
    assert domains.sentence_ends('Ab. Cd! "E?" rest of it\r') == [3, 4, 4, 12]
    assert domains.sentence_ends("") == [] and domains.sentence_ends("short") == []


def test_greedy_fold_and_auc(spark):
    a = spark.createDataFrame([("x", t) for t in (0, 60, 99, 100, 150, 205)], "k string, tick long")
    assert sorted(r.tick for r in evaluate.refractory_alarms(a, ["k"]).collect()) == [0, 100, 205]
    s = spark.createDataFrame([("x", 0.9, 1), ("x", 0.8, 0), ("x", 0.8, 1), ("x", 0.1, 0)], "k string, score double, label int")
    assert evaluate.auc_roc(s, ["k"]).first().auc == 0.875


def test_forecast_finds_a_planted_burst(spark):
    import numpy as np

    x = np.random.default_rng(2).normal(size=3000)
    for t in range(1, 3000):
        x[t] += 0.7 * x[t - 1]
    y = x[1500:].copy()
    y[700:730] += 12
    found = forecast.detect(x[:1500], y)
    assert any(s <= 715 <= e for s, e in found)
    e = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0.1] * 50 + [5.0, 6.0] + [0.1] * 50)], "k string, tick long, e double")
    eps = forecast.find_epsilon(e, ["k"])
    seqs = forecast.anomaly_sequences(e, eps, ["k"], 3)
    assert [(r.start, r.end) for r in seqs.collect()] == [(47, 54)]
    arr = np.array([0.1] * 50 + [5.0, 6.0] + [0.1] * 50)
    assert abs(eps.first().eps - forecast.epsilon(arr)) < 1e-9 and forecast.sequences(arr, forecast.epsilon(arr), 3) == [(47, 54)]
    assert forecast.prune_sequences(e, seqs, ["k"]).select(F.count("*")).first()[0] == len(forecast.pruned(arr, [(47, 54)], 0.13))
