"""Operator 13 against a version that looks at every start and period."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import periods

SF = "/root/testdata/sf0.001"


def slow_runs(ws):
    n, out = len(ws), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if ws[i] != ws[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and ws[e] == ws[e + q]:
                e += 1
            length = e - i + q
            if length >= max(24, 3 * q) and not any(all(ws[k] == ws[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text, plant=True):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(ws)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(ws) if k not in gone))


def sequences(rng, count, most):
    """Words with planted runs, runs within runs, runs that touch, and single letters."""
    for _ in range(count):
        letters = [f"w{k}" for k in range(rng.choice([1, 2, 3, 30]))]
        ws = []
        while len(ws) < rng.randrange(1, most):
            unit = rng.choices(letters, k=rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))
            unit = unit * rng.choice([1, 1, 2])
            ws += (unit * rng.randrange(1, 7))[: rng.randrange(1, 200)]
            if rng.random() < 0.5:
                ws += rng.choices(letters, k=rng.randrange(9))
        yield ws[:most]


def test_kernel_finds_all_runs():
    rng = random.Random(5)
    for ws in sequences(rng, 250, 400):
        code = {w: i for i, w in enumerate(dict.fromkeys(ws))}
        x = np.array([code[w] for w in ws], np.int64)
        assert sorted(periods.stitched(periods.fragments(x, len(x))), key=lambda r: (r[0], r[2])) == slow_runs(ws)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.choices([0, 1], k=rng.randrange(1, 40))
        want = [0] + [next((k for k in range(len(a) - i) if a[k] != a[i + k]), len(a) - i) for i in range(1, len(a))]
        assert periods.z_function(a, len(a)) == want


def test_short_and_long_paths_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(periods, "TILE", 64)
    rng = random.Random(9)
    rows = [(i, " ".join(ws), i, "r") for i, ws in enumerate(sequences(rng, 60, 500))]
    rows += [(None, "a " * 40, 1, "x"), (None, "a " * 40, 1, "x"), (3, None, 0, "x"), (4, "", 0, "x"), (5, " \t\n\x0b ", 0, "x"), (6, "one", 0, "x"), (7, "a b a b " * 12, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long, row string")
    want = sorted((slow_row(i, t, plant=False) for i, t, _, _ in rows), key=repr)
    for long in (10**6, 100, 0):
        found = periods.periodic_runs(df, long=long)
        assert set(found.select("row.*").columns) == {"doc_id", "text", "runs", "row"}
        assert sorted(map(tuple, periods.digest(found).collect()), key=repr) == want
    assert periods.periodic_runs(df.limit(0)).count() == 0


def test_long_documents_of_few_words(spark):
    rng = random.Random(2)
    unit = rng.choices(["x", "y"], k=3000)
    rows = [(1, "same " * 60_000), (2, " ".join(unit * 4 + ["end"])), (3, " ".join(["b", "a"] + unit * 3))]
    got = {r["row"]["doc_id"]: [tuple(x) for x in r.runs] for r in periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), long=1000).collect()}
    assert got[1] == [(0, 60_000, 1)]
    assert [r for r in got[2] if r[2] == 3000] == [(0, 12_000, 3000)] and [r for r in got[3] if r[2] == 3000][0][1] >= 9000


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_against_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, periods.op13_periodic_runs(spark, SF).collect()))
    fast = {i: t for i, t in some if len((t or "").split()) <= 1500}
    assert len(got) == len(some) and [g for g in got if g[0] in fast] == sorted(slow_row(i, t) for i, t in fast.items())
    assert sum(g[1] > 0 for g in got) >= 5


def test_planting(spark):
    rows = [(i, " ".join(f"t{k}" for k in range(i % 37))) for i in range(400)] + [(None, "a b c"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = periods.digest(periods.periodic_runs(df.withColumn("text", periods.planted(F.col("doc_id"), F.col("text"))))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((slow_row(i, t) for i, t in rows), key=repr)
