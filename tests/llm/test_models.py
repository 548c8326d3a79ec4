"""Operators 4, 7 and 9: kernels and likelihoods against plain versions, held-out accuracy, edge cases."""

import math
import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import hmm, langid, toxicity
from tidewright.llm.common import held_out


def slow_kernel(a, b):
    total = 0.0
    for i in combinations(range(len(a)), toxicity.ORDER):
        for j in combinations(range(len(b)), toxicity.ORDER):
            if [a[k] for k in i] == [b[k] for k in j]:
                total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel():
    words = ["^idiot", "idxiot", "moron$", "abc", "^trash"]
    x = toxicity.coded(words)
    k = toxicity.kernel(x, x)
    for i, j in product(range(len(words)), repeat=2):
        assert k[i, j] == pytest.approx(slow_kernel(words[i], words[j]), rel=1e-4)
    assert toxicity.own_kernel(x) == pytest.approx(np.diag(k), rel=1e-4)


def test_folded_table_is_the_expansion():
    m = toxicity.Machine(["^idiot", "idiot$", "^the$"])
    words = ["^idiot", "^idxio", "zzzzzz", "^the$", "^tho$"]
    rng = np.random.default_rng(0)
    m.train(rng.random((20, 3)), np.r_[np.ones(5), np.zeros(15)])
    want = toxicity.normalised(words, m.marks, m.own) @ m.weights + m.bias
    assert m.decide(words) == pytest.approx(want, abs=1e-4)


def test_units_join_spelled_out_words():
    assert "^idiot" in toxicity.units("you i d i o t here") and "^idiot" in toxicity.units("An I.D.I.O.T!")
    assert toxicity.units("") == set()


def toxic_corpus(n=900, seed=2):
    rng = random.Random(seed)
    syll = ["ba", "ke", "lo", "mi", "nu", "ra", "te", "so", "vi", "du"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["idiot", "worthless", "moron"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus()
    df = spark.createDataFrame(docs + [(5000, None), (5001, ""), (5002, "what an i d i o t"), (5003, "an idiiot"), (3, docs[3][1])], "doc_id long, text string").withColumn("toxic", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    apart = held_out(F.col("doc_id"), 4)
    m = toxicity.train(df.where(~apart), lab)
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, m).select("row.doc_id", "score", "f").collect()}
    wrong = sum((got[i].score >= toxicity.THRESHOLD) != bool(y) for i, y in labels)
    assert wrong <= 0.02 * len(labels)
    assert got[5000].score < 0.3 and got[5001].score < 0.3 and got[5002].score > 0.3 and got[5003].f > got[5000].f
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.train(df.limit(0), lab) is None and toxicity.train(df, lab.limit(0)) is None
    assert [r.score for r in toxicity.score_toxicity(df.limit(2), None).collect()] == [0, 0]


def test_language_held_out(spark):
    rng = random.Random(1)
    parts = {"aa": ["thi", "ing", "and", "wh"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["eau", "oui", "que", "é"]}
    rows = []
    for i in range(450):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 120))), lang))
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, "que oui eau", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(5.0)).withColumn("row", F.lit(1))
    net = langid.train(df.where(~held_out(F.col("doc_id"), 4)))
    got = {r.doc_id: r for r in langid.identify(df, net).select("row.doc_id", "lang_pred", "score").collect()}
    assert sum(got[i].lang_pred != lang for i, _, lang in rows) <= 5
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "cc"
    assert langid.train(df.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def test_windows_hold_the_whole_text():
    t = bytes(range(1, 250)) * 3
    w = langid.windows(t)
    assert w.tobytes().rstrip(b"\0") == t and w.shape[1] == langid.WINDOW


def small_model():
    known = [(f"w{i}".encode(), 50 - i) for i in range(30)]
    shared = np.zeros((hmm.BUCKETS, 2))
    for w, c in known:
        shared[hmm.bucket(w) - hmm.SINGLE - 1] += (c, 1)
    m = hmm.Model(known, shared, sum(c for _, c in known) + 10, 31, 10)
    rng = np.random.default_rng(5)
    m.move = rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    m.start = rng.dirichlet(np.ones(hmm.STATES))
    m.emit = m.emit * rng.uniform(0.2, 2, m.emit.shape)
    m.emit /= m.emit.sum(1, keepdims=True)
    return m


def forward(m, seq):
    a, log = m.start * m.emit[:, seq[0]], 0.0
    for c in [None, *seq[1:]]:
        if c is not None:
            a = (a @ m.move) * m.emit[:, c]
        s = a.sum()
        a, log = a / s, log + math.log10(s)
    return log


def test_blocks_give_the_forward_recursion():
    m, rng = small_model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 31, n).astype(np.int32) for n in (1, 2, 127, 128, 129, 700, 5)]
    assert m.likelihoods(seqs) == pytest.approx([forward(m, s) for s in seqs], rel=1e-12)


def test_expected_counts_by_enumeration():
    m = small_model()
    seq = np.array([1, 4, 2], np.int32)
    start, move, emit = m.expected([seq, np.array([3], np.int32)], [True, False])
    want, total = np.zeros((hmm.STATES, hmm.STATES)), 0.0
    for path in product(range(hmm.STATES), repeat=3):
        p = m.start[path[0]] * m.emit[path[0], 1] * m.move[path[0], path[1]] * m.emit[path[1], 4] * m.move[path[1], path[2]] * m.emit[path[2], 2]
        total += p
        for a, b in zip(path, path[1:]):
            want[a, b] += p
    assert move == pytest.approx(want / total, rel=1e-9)
    assert start.sum() == pytest.approx(1) and emit.sum() == pytest.approx(4)


def test_scores_with_rare_words(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["Aa", "b", "c.", "d"] + [f"r{k}" for k in range(300)]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "new newer"), (7, docs[7][1]), (None, "aa b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).repartition(3)
    train = df.where(~held_out(F.col("doc_id"), 7))

    def scores(known):
        monkeypatch.setattr(hmm, "KNOWN", known)
        m, c = hmm.train(train)
        return m, sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 6)) for r in hmm.score_texts(df, m, c).collect())

    m, few = scores(10)
    _, all_ = scores(100_000)
    assert [x[:4] for x in few] == [x[:4] for x in all_] and len(few) == len(docs)
    assert {x[0]: x[1] for x in few}["100"] == 1
    empty, counts = hmm.train(df.limit(0))
    assert hmm.score_texts(df.limit(0), empty, counts).count() == 0
    r = hmm.score_texts(df.where("doc_id = 102"), empty, counts).first()
    assert (r.n_tokens, r.n_known, r.base_score) == (3, 0, 0.0)


def test_labels_beyond_the_sample_go_by_their_documents(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 3)
    rows = [(i, f"{lang} words of {lang} number {i}", lang) for i, lang in enumerate("aaaabbbccde")]
    net = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.labels == ["a", "b", "c"]


def test_whole_texts_are_learned_until_the_likelihood_settles(spark, monkeypatch):
    rng = random.Random(8)
    docs = [" ".join(w + str(rng.randrange(20)) for _ in range(rng.randint(1, 40)) for w in "abc") for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, "", None])], "doc_id long, text string")
    found = []
    for length in (128, 2):
        monkeypatch.setattr(hmm, "SEGMENT", length)
        m, _ = hmm.train(df)
        found.append((m.start, m.move, m.emit))
    for a, b in zip(*found):  # transitions over cuts count, wherever they fall
        assert b == pytest.approx(a, rel=1e-6, abs=1e-12)
    place = {w: i for i, w in enumerate(m.known.to_pylist())}
    seqs = [np.array([*(m.cls[place[w.encode()]] for w in t.split()), hmm.END]) for t in [*docs, "", ""]]
    whole = [m.expected([s], [True]) for s in seqs]
    got = m.expected_whole(np.concatenate(seqs), np.array([len(s) for s in seqs]))
    for k in range(3):
        assert got[k] == pytest.approx(sum(w[k] for w in whole), rel=1e-9, abs=1e-12)
    assert got[3] == pytest.approx(sum(forward(m, s) for s in seqs), rel=1e-12)
    m.update(*got[:3])
    assert m.likelihoods(seqs).sum() - got[3] < hmm.SETTLED * m.tokens
