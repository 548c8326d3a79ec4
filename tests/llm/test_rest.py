"""Operators 3, 6, 8, 10 and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import ann, packing, quotes, tokens


def test_hilbert_visits_every_cell_by_unit_steps():
    x = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = ann.hilbert(x, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(x[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[40:60] = x[40]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (None, rows[3][1]), (7, rows[7][1])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    df = spark.createDataFrame(rows + bad, schema).withColumn("cell", F.lit(1)).withColumn("v", F.lit("x"))
    got = ann.nearest(df, 50).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -np.round(s, 12)))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == pytest.approx(sorted((s[m[1]] for m in mine), reverse=True))
        hit += len(set(want) & {m[1] for m in mine})
    assert hit >= 0.9 * 150
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 50), key=lambda r: r.rank)] == [40, 41, 42, 43, 44]
    assert ann.nearest(df.limit(0), 50).count() == 0


def test_quotes(spark):
    rows = [(1, 0, "u", "Hello there. How are you?\nFine day."), (1, 1, "a", "> How are you?\nI am well!"), (1, 2, "u", "Bob wrote:\n> > How are you?\n> I am well!\n\nGood to hear."), (1, 3, "u", "> Fine day.\n> How are\n> you?\nYes"), (1, 4, "x", None), (1, 5, "x", "> never said"), (2, 1, None, "> How are you?"), (None, 1, "a", "> x"), (1, 6, "u", "> good to hear\n:)"), (1, 4, "x", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parent", F.lit(7)).withColumn("h", F.lit(1))
    got = quotes.link_quotes(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].parent, by[1, t].depth, by[1, t].root) for t in range(7)] == [(None, 0, 0), (0, 1, 0), (1, 2, 0), (0, 1, 0), (None, 0, 4), (None, 0, 5), (2, 3, 0)]
    assert by[1, 2].own_text == "Good to hear." and by[1, 3].n_linked == 2 and by[1, 5].n_quoted == 1 and by[2, 1].parent is None
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.reply_path)]
    assert order.index(6) == order.index(2) + 1
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_native_operators_run_no_python(spark):
    df = spark.createDataFrame([(1, 0, "u", "> a b c\nd")], "conv_id long, turn long, role string, text string")
    plan = quotes.link_quotes(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ODD = "x" * 4000 + "   " * 2000 + "<|endoftext|>" * 200 + "\n\n \n" * 400 + "don't we'll " * 300 + "é" * 2000 + "1234567890" * 200 + "!?" * 800


def test_spliced_counts(spark):
    tok = tokens.tokenizer("byte_bpe_50k.json")
    rng = random.Random(0)
    texts = [ODD] + ["".join(rng.choice(["ab ", " c", "\n", "  ", "é", "9", "'s", "<|endoftext|>", " ", "x" * 50]) for _ in range(900)) for _ in range(6)]
    for t in texts:
        want = len(tok.encode(t, add_special_tokens=False))
        for chunk, overlap in ((300, 60), (500, 100), (2000, 200)):
            assert tokens.spliced_count(tok, t, chunk, overlap) == want
    df = spark.createDataFrame([(1, None), (2, ""), (3, ODD), (3, ODD), (None, "a b")], "doc_id long, text string").withColumn("n_tokens", F.lit(1)).withColumn("row", F.lit(2))
    got = sorted(((r["row"]["doc_id"] or 0), r["n_tokens"]) for r in tokens.count_tokens(df, "byte_bpe_50k.json", chunk=600, overlap=100).collect())
    n = len(tok.encode(ODD, add_special_tokens=False))
    assert got == [(0, 2), (1, 0), (2, 0), (3, n), (3, n)]
    assert tokens.count_tokens(df.limit(0), "byte_bpe_50k.json").count() == 0


def test_best_fit_and_bound():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = rng.integers(1, 101, rng.integers(1, 200))
        where, offset = packing.best_fit(n, 100)
        fill = np.bincount(where, n)
        assert fill.max() <= 100
        for b in range(len(fill)):
            o = np.sort(offset[where == b])
            assert o[0] == 0 and set(o) == set(np.r_[0, np.cumsum(n[where == b][np.argsort(offset[where == b])])[:-1]])
        assert -(-n.sum() // 100) <= packing.bound(np.bincount(n, minlength=101), 100) <= len(fill)
    assert packing.bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.bound(np.bincount([34] * 9, minlength=101), 100) == 5


def test_packing_whole(spark):
    tok = tokens.tokenizer("word_bpe_49k.json")
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["One,", "two.", "thrée", "don't", "ΙΣ", "5!", "x y", "<|endoftext|>"]) for _ in range(rng.randint(0, 400)))) for i in range(300)] + [(1000, None), (1001, ""), (4, "again"), (2000, "word " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("piece", F.lit("x"))
    packed = packing.pack(packing.pieces(df, "word_bpe_49k.json", 512), 512, partition=150)
    rows = packed.collect()
    want = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 512]), zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 512
    made, least = packing.certificate(packed, 512)
    assert least <= made <= 1.02 * least + 1
    assert packing.pack(packing.pieces(df.limit(0), "word_bpe_49k.json")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(6)
    syll = {"en": ["the", "ing", "and", "wh", "er"], "de": ["sch", "ung", "ein", "der", "ch"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syll[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    item = text("en", 30)
    shared = text("en", 80)
    rows = [(i, text("en" if i % 2 else "de", rng.randint(60, 150)), "en" if i % 2 else "de", "s", 1) for i in range(120)]
    rows[10] = (10, rows[3][1], "en", "s", 1)
    rows[21] = (21, rows[21][1] + " " + shared, "en", "s", 1)
    rows[33] = (33, rows[33][1] + " " + shared, "en", "s", 1)
    rows[45] = (45, rows[45][1] + " " + item, "en", "s", 1)
    rows += [(500, None, "en", "s", None), (501, "12 34", "de", "s", 5), (502, None, None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, ids = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, sf), name)
        ids.append({r.doc_id for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = set(range(120))
    assert ids[0] == every and ids[1] == every - {10} and ids[2] == every - {10} and ids[3] == every - {10, 45}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert shared in kept[21] and shared not in kept[33] and kept[33] == " ".join(rows[33][1].split()[: -80])
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == ids[3]
