"""Operator 11 against a plain version that compares every block with every template."""

import random
import re

from tidewright.llm import licenses


def plain(rows, phrases, notices, step):
    out = []
    for i, text in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        at = [(k, label) for label, p in phrases for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        held = []
        for k in range(0, len(ws), step):
            part = set(ws[k : k + 2 * step])
            for label, share, t in notices:
                same = len(set(t.split()) & part) / len(set(t.split()))
                if same >= share - 1e-9:
                    held.append((same, label))
        base, all_ = {x for _, x in at}, {x for _, x in at} | {x for _, x in held}
        score = max([1.0] * bool(at) + [s for s, _ in held], default=0.0)
        out.append((i, len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(all_)), round(score, 9)))
    return sorted(out, key=repr)


def run(spark, rows, phrases, notices, step):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, token int, label string")
    got = licenses.license_scan(df, phrases, notices, step).collect()
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in got), key=repr)


def test_blocks_against_every_template(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e", "f", "g", "é", "10", "zz"]
    phrases = (("P", "a b a"), ("Q", "c"), ("P", "d e"))
    notices = (("N", 0.8, "a b c d e f g a"), ("M", 1.0, "é 10"), ("K", 0.5, "e f zz 10 d"))
    rows = [(i, " ".join(rng.choices(words + ["other", "Word"] * rng.randrange(9), k=rng.randrange(60))).replace("d", rng.choice("dD"))) for i in range(150)]
    rows += [(None, "a b a"), (None, "a b a"), (5, "a b a"), (5, "a b a"), (7, None), (8, ""), (9, "  --\n"), (10, "A-B\x00a,b`a"), (11, "x " * 31 + "a b a c" + " y" * 20)]
    rows += [(12, " ".join(rng.choices(words + ["w"] * 20, k=5000)))]
    assert run(spark, rows, phrases, notices, 8) == plain(rows, phrases, notices, 8)


def test_notices_reworded_and_apart(spark):
    text = "Permission is hereby granted, free of charge, to any person getting a copy of this software and its documentation files"
    cut = "Licensed under the\n   * Apache License, Version 2.0\nand some words"
    rows = [(1, text), (2, cut), (3, "the mozilla license is not under mit"), (4, "word " * 40 + text)]
    got = {r[0]: r for r in run(spark, rows, licenses.PHRASES, licenses.NOTICES, licenses.STEP)}
    assert got[1][6] == got[4][6] == "mit" and got[1][5] == "" and 0.8 <= got[1][7] < 1
    assert got[2][2:7] == (1, 3, 3, "apache-2", "apache-2") and got[3][6] == ""
    assert sorted(got.values(), key=repr) == plain(rows, licenses.PHRASES, licenses.NOTICES, licenses.STEP)


def test_empty_table_and_plan(spark):
    assert run(spark, [], licenses.PHRASES, licenses.NOTICES, licenses.STEP) == []
    df = spark.createDataFrame([(1, "under the MIT license")], "doc_id long, text string")
    plan = licenses.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_bounds_are_errors(spark):
    import pytest

    with pytest.raises(ValueError):
        licenses.license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), (("L", "a b c d e"),), (), 4)
