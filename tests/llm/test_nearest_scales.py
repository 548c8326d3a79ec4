"""Operator 3 on vectors of extreme magnitudes and other lengths, and what its search reads."""

import numpy as np
import pytest

from tidewright.llm import ann


def test_magnitudes_do_not_matter(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    size = [1.0, 1e-200, 1e200, 1e-300, 1e300, 5e-310]
    rows = [(i, [float(v) for v in r * size[i % 6]]) for i, r in enumerate(x)]
    rows += [(1000, [float(v) for v in x[50, :3]] + [0.0] * 5), (1001, [float(v) for v in x[50, :3]]), (1050, [0.0] * 8), (1051, []), (1052, None), (1053, [float("inf")] * 8)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = {i: np.array(list(x[i]) if i < 300 else [*x[50, :3], 0, 0, 0, 0, 0]) for i in [*range(300), 1000]}
    assert sorted(got) == [0, 50, 100, 150, 200, 250, 1000]
    for q, found in got.items():
        cos = {i: whole[q] @ v / np.sqrt((whole[q] @ whole[q]) * (v @ v)) for i, v in whole.items() if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[:5]
        assert [i for _, i, _ in sorted(found)] == want
        assert [s for _, _, s in sorted(found)] == pytest.approx([cos[i] for i in want], rel=1e-9)


def test_scaling_changes_no_bit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 16)) * np.exp(rng.normal(size=(40, 1)) * 20)
    y = ann.scaled(x)
    assert ((np.abs(y).max(1) < 1) & (np.abs(y).max(1) >= 0.5)).all()
    cos = lambda a: (a[:1] * a).sum(1) / (np.sqrt((a[:1] * a[:1]).sum(1)) * np.sqrt((a * a).sum(1)))
    assert (cos(x) == cos(y)).all()
    assert ann.scaled(np.zeros((1, 4))).tolist() == [[0.0] * 4]


def test_fewest_chunks_are_read():
    rng = np.random.default_rng(0)
    own, chunks = rng.integers(0, 40, (200, ann.CURVES)), np.full(ann.CURVES, 40)
    # neighbours anywhere: one whole curve is the least; neighbours beside each other on some curve: several narrow windows
    anywhere = ann.Trials(np.abs(own - rng.integers(0, 40, own.shape)), own, chunks)
    assert ann.cheapest(anywhere) == 1 and anywhere.read(1, ann.window(anywhere, 1)) <= 40
    gaps = rng.integers(10, 40, own.shape)
    gaps[np.arange(200), rng.integers(0, ann.CURVES, 200)] = 0
    apart = ann.Trials(gaps, own, chunks)
    assert ann.cheapest(apart) == ann.CURVES and apart.read(ann.CURVES, ann.window(apart, ann.CURVES)) == ann.CURVES
