"""Operators 1, 2, 3, 6, 8, 9 and 10 where keys are hot, labels many, texts unbroken or numbers large."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import ann, graph, langid, packing, quotes, simhash, substring, tokens
from tidewright.llm.common import spanning

from .test_dedup import corpus, frame, slow_substring


@pytest.mark.parametrize("k", [4, 5, 6])
def test_orders_keep_all_bits_and_meet_three_differences(k):
    rng = np.random.default_rng(k)
    ways = simhash.orders(0, k)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for lead, fields in ways:
        assert sum(w for _, w in fields) == 64 and sorted(fields)[0][0] == 0
        place = np.concatenate([np.arange(a, a + w) for a, w in fields])
        bits = np.unpackbits(x[:, None].view(np.uint8)[:, ::-1], axis=1)
        turned = np.packbits(bits[:, place], axis=1)[:, ::-1].copy().view(np.uint64)[:, 0]
        assert (simhash.restored(turned, fields) == x).all()
    for _ in range(300):
        bad = set(rng.choice(64, 3, replace=False).tolist())
        assert any(not bad & {p for a, w in fields[: k - 3] for p in range(a, a + w)} for _, fields in ways)


@pytest.mark.parametrize("k", [5, 6])
def test_links_by_more_fields_and_groups(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 9)).astype(np.uint64)) if i else np.uint64(0) for i in range(1500)]
    x = np.unique(np.array([base[i % 4] ^ np.uint64(f) for i, f in enumerate(flips)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    real = simhash.orders
    monkeypatch.setattr(simhash, "orders", lambda n: real(n, k))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "GROUP", 3)
    root = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
    c, r = spanning(i, j, len(x))
    lab = np.arange(len(x))
    lab[c] = r
    mine, theirs = {}, {}
    for q, v in enumerate(x.view(np.int64).tolist()):
        mine.setdefault(int(lab[q]), set()).add(v)
        theirs.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_hot_fingerprints_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rows = [(i, "the same text again") for i in range(9)] + [(20, "another text here"), (None, "the same text again"), (None, "only null ids here"), (None, "only null ids here")] + [(None, None)] * 5
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 9} == {0}
    assert sum(r.component_id is None for r in got) == 7


def test_hot_shards_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 1)
    rng = random.Random(8)
    words = [f"v{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(70)]
    context = [[rng.choice(words) for _ in range(30)] for _ in range(6)]
    rows = corpus() + [(300 + k, " ".join(context[k % 6] + passage + context[(k // 6) % 6] + [rng.choice(words) for _ in range(k)])) for k in range(40)]
    got = substring.substring_dedup(frame(spark, rows)).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    import hashlib

    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == slow_substring(rows, 50)
    only = substring.substring_dedup(frame(spark, rows), carry=["doc_id"], only_cut=True).where("kept IS NULL AND n_removed > 0 OR kept IS NOT NULL AND n_removed = 0")
    assert only.count() == 0


def test_windows_shrink_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 16)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(60, 12)), 30, axis=0) + 0.02 * rng.normal(size=(1800, 12))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, [1.0] * 3), (9050, [2.0] * 3), (9100, [])], "vec_id long, embedding array<double>")
    seen = []
    real = ann.window
    monkeypatch.setattr(ann, "window", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {}
    for r in ann.nearest(df, 50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1800, 50):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5].tolist()) & got[q])
    assert hit >= 0.9 * 5 * 36 and seen[0] <= 4 and 9050 not in got


def test_turns_of_any_size(spark):
    big = 10**13
    rows = [(1, -5, "u", "First thing."), (1, 3, "a", "> First thing.\nSecond."), (1, big + 1, "u", "> Second.\nThird."), (1, big + 2, "a", "> Third.\nEnd.")]
    by = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert by[big + 2].reply_path == [-5, 3, big + 1, big + 2] and by[big + 2].depth == 3 and by[big + 2].root == -5
    long = [(2, 0, "u", "Hello there."), (2, 1, "a", "x" * 500 + " wrote:\n> Hello there.\nMine.")]
    assert {r.turn: r.own_text for r in quotes.link_quotes(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()}[1] == "Mine."


def test_unbroken_texts_cost_linear_work():
    tok = tokens.tokenizer("byte_bpe_50k.json")

    class Counting:
        said = 0

        def encode(self, text, **how):
            Counting.said += len(text)
            return tok.encode(text, **how)

        def get_added_tokens_decoder(self):
            return tok.get_added_tokens_decoder()

    rng = random.Random(1)
    word = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    for text in (word, word[:9000] + " " + word[:9000] + " end of it " + word[:700] + " " + word[:20_000], " ".join(word[k : k + 600] for k in range(0, 60_000, 600))):
        Counting.said = 0
        assert tokens.spliced_count(Counting(), text, 2000, 200) == len(tok.encode(text, add_special_tokens=False))
        assert Counting.said <= 8 * len(text)


def test_many_labels_null_ids_and_repeats(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else i, "".join(rng.choice("abcdefgh ") for _ in range(300)) + f" label{i % 300}", f"l{i % 300:03d}") for i in range(900)]
    rows += [(None, "the very same text", "l000")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df, per_lang=3)
    assert len(net.labels) == 300
    got = langid.identify(df, net, carry=["doc_id"])
    assert got.count() == len(rows) and set(got.select("row.*").columns) == {"doc_id"}
    assert langid.identify(df.limit(5).withColumn("x", langid.certain(F.lit(1.0), net)), net).where("row.x").count() == 5


def test_other_vocabularies_and_certificates(spark):
    tok = tokens.tokenizer("byte_bpe_50k.json")
    known = packing.WordIds("byte_bpe_50k.json")
    assert not known.apart and packing.WordIds("word_bpe_49k.json").apart
    for t in ("Two words.", "", "  a\n\nb <|endoftext|>"):
        assert next(known.texts(pa.array([t]))).tolist() == tok.encode(t, add_special_tokens=False).ids + [0]
    words, plain = packing.WordIds("word_bpe_49k.json"), tokens.tokenizer("word_bpe_49k.json")
    rng = random.Random(2)
    texts = ["A <|ENDOFTEXT|> b, c.", None, "", "  x..  Y!? \x0bz;\x1c z. \u00a0Q.", "The End."] + ["".join(rng.choice(["Ab", "c.", " ", "\n", "\x0b", "É", "e\u0301", "'s", "9", ",", "<|", "?!", "\u2003"]) for _ in range(80)) for _ in range(200)]
    for batch in (pa.array(texts), pa.array(texts).slice(3, 50)):
        for t, ids in zip(batch.to_pylist(), words.texts(batch), strict=True):
            assert ids.tolist() == plain.encode(t or "", add_special_tokens=False).ids + [0], t
    cut = spark.createDataFrame([(i, 0, 0, 16 + i % 3 * 16, i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(cut, 64, partition=500)
    made, least = packing.certificate(packed, 64)
    assert packed.count() == 3000 and made <= 1.01 * least and made == packed.select("sequence_id").distinct().count()
    assert packed.where("made < bound").count() == 0 and packed.where("made = bound").count() > 0
    # what fills its sequences to the last id is certified at once and exchanged no more
    full = packing.pack(spark.createDataFrame([(i, 0, 0, 32, i) for i in range(2000)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3), 64, partition=500)
    assert packing.certificate(full, 64)[1] == 1000 and packing.certificate(full, 64)[0] <= 1001
