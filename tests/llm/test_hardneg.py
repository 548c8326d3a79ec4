"""Operator 12 against all pairs."""

import random

import numpy as np
import pytest

from tidewright.llm import hardneg

SCHEMA = "vec_id long, label int, embedding array<long>, score string, anchor long"


def plain(rows, every, share=(50, 95)):
    kept = {}
    for i, y, x, *_ in rows:
        if i is not None and y is not None and x is not None and None not in x:
            kept[i] = min(kept.get(i, (y, x)), (y, x))
    out = []
    for a in kept:
        if a % every:
            continue
        s = {i: sum(p * q for p, q in zip(kept[a][1], x)) for i, (_, x) in kept.items() if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if kept[i][0] == kept[a][0]][:5]:
            hard = [i for i in order if kept[i][0] != kept[a][0] and share[0] * s[p] <= 100 * s[i] <= share[1] * s[p]][:3]
            out += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(hard)]
    return sorted(out)


def run(spark, rows, every=5):
    return sorted(map(tuple, hardneg.hard_negatives(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA), every).collect()))


@pytest.mark.parametrize("big", [1, 2**22])
def test_blocks_and_cells_against_all_pairs(spark, monkeypatch, big):
    monkeypatch.setattr(hardneg, "BLOCK", 7)
    monkeypatch.setattr(hardneg, "CHUNK", 16)
    monkeypatch.setattr(hardneg, "CELL", 300)
    rng = np.random.default_rng(big)
    centres = rng.integers(-200, 200, (6, 8))
    rows = [(i, int(rng.integers(0, 3)), ((centres[i % 6] + rng.integers(-20, 20, 8)) * big).tolist()) for i in range(400)]
    rows += [(1000 + i, i % 2, (centres[0] * big).tolist()) for i in range(60)]
    rows += [(2000, None, [1] * 8), (2005, 1, None), (2010, 1, [1, None, 2, 3, 4, 5, 6, 7]), (2015, 1, [7, 7]), (2020, 1, []), (None, 1, [1] * 8), (2025, 2, [0] * 8)]
    rows += [(5, 1, [9] * 8), (5, 0, [8] * 8), (10, 2, rows[10][2])]
    want = plain(rows, 5)
    assert run(spark, rows) == want and len(want) > 200


def test_negative_scores_and_few_rows(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [rng.randrange(-9, 3) for _ in range(3)]) for i in range(40)]
    assert run(spark, rows) == plain(rows, 5)
    assert run(spark, rows[:1]) == [] and run(spark, []) == [] and run(spark, [(1, 0, [1])]) == []
    with pytest.raises(ValueError):
        run(spark, [(0, 1, [2**40]), (1, 1, [1])])


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (12, 16))
    x = (np.repeat(centres, 8, axis=0) + rng.integers(-3, 4, (96, 16))).astype(float)
    order, parent, edge = hardneg.spanning_tree(x)
    assert sorted(order.tolist()) == list(range(96)) and all(list(order).index(parent[v]) < list(order).index(v) for v in order[1:])
    # as light as Prim's is to be: no edge is longer than the shortest between two halves of any cut along the order
    for k in range(1, 96):
        done, left = order[:k], order[k:]
        assert edge[order[k]] == pytest.approx(np.sqrt(((x[done][:, None] - x[left][None]) ** 2).sum(-1).min()))
    chunk = (np.repeat(centres, 30, axis=0) + rng.integers(-3, 4, (360, 16))).astype(float)
    true, scored = chunk @ x.T, 0

    def wanted(v, low, high):
        assert (low - 1e-9 <= true[:, v]).all() and (true[:, v] <= high + 1e-9).all()
        return high >= np.sort(true[:, v])[-5]

    for v, rows, scores in hardneg.Bounds(x, order, parent, edge).visit(chunk, wanted):
        assert (scores == true[rows, v]).all() and set(np.argsort(-true[:, v])[:1]) <= set(rows)
        scored += len(rows)
    assert scored < 0.5 * true.size


def test_no_cartesian_product(spark):
    df = spark.createDataFrame([(i, i % 2, [i, 1]) for i in range(50)], "vec_id long, label int, embedding array<long>")
    plan = hardneg.hard_negatives(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
