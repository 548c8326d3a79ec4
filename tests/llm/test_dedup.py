"""Operators 1, 2 and 5 against brute force, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, graph, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 160))) for _ in range(n)]
    shared = " ".join(rng.choice(vocab) for _ in range(70))
    rows = []
    for i, t in enumerate(texts):
        if i % 5 == 1:
            t = t + "\n" + shared + " \t" + texts[0]
        if i % 7 == 3:
            t = texts[i - 1]
        if i % 9 == 4:
            t = " ".join(w if k % 40 else "other" for k, w in enumerate(texts[i - 2].split()))
        rows.append((i, t))
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "One two"), (n + 4, shared.upper()), (5, rows[5][1]), (None, shared)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("fp", F.lit(1)).withColumn("th", F.lit("x")).withColumn("row", F.lit(None).cast("string")).repartition(5)


def slow_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    rows = corpus()
    got = simhash.simhash_components(frame(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{f:016x}") for (i, _), f in zip(rows, fps))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), 10**9), i)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted((str(i), least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_simhash_links_of_crowded_fingerprints(spark):
    """Thousands of fingerprints in few upper nodes: blocks, boundaries and rotations."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 9)).astype(np.uint64)) if k else np.uint64(0) for k in range(3000)]
    x = np.unique(np.array([base[k % 3] ^ np.uint64(f) for k, f in enumerate(flips)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    root = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    lab = np.arange(len(x))
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
    from tidewright.llm.common import spanning

    c, r = spanning(i, j, len(x))
    lab[c] = r
    mine = {}
    for k, v in enumerate(x.view(np.int64).tolist()):
        mine.setdefault(int(lab[k]), set()).add(v)
    theirs = {}
    for v in x.view(np.int64).tolist():
        theirs.setdefault(root.get(v, v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def slow_substring(rows, span):
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - span + 1):
            if i is not None:
                k = tuple(w[s : s + span])
                first[k] = min(first.get(k, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - span + 1):
            if i is not None and first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark):
    rows = corpus() + [(200 + k, " ".join(["same"] * (45 + 3 * k))) for k in range(6)]
    got = substring.substring_dedup(frame(spark, rows)).select("row.doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == slow_substring(rows, 50)
    assert substring.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_matches_like_a_set_of_windows():
    rng = random.Random(5)
    a, seen = substring.Automaton(), set()
    for _ in range(40):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        want = [i for i in range(len(w)) if i >= 3 and tuple(w[i - 3 : i + 1]) in seen]
        assert a.ends(w, 4) == want
        a.add(w)
        seen.update(tuple(w[i : i + 4]) for i in range(len(w) - 3))


def test_decontamination(spark):
    rng = random.Random(7)
    words = [f"tok{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((30, 14, 20, 7, 25))] + [(9, None), (0, None)]
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    two = items[0][1].split()
    for k in (3, 9, 16, 22):
        two[k] = "changed"
    docs = [(1, fill(300) + " " + items[0][1].upper() + "! " + fill(50)), (2, fill(100) + " " + " ".join(two)), (3, fill(400)), (4, items[1][1]), (5, " ".join(items[2][1].split()[:9])), (6, None), (7, ""), (8, items[3][1]), (1, fill(9)), (10, "a b, " + "; ".join(items[4][1].split()))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(99)).withColumn("words", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (10, 4)}
    assert got[1, 0].overlap == 1.0 and got[1, 0].n_equal == 30 and got[1, 0].at == 300 and got[2, 0].n_equal == 26
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_masks_meet_any_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(13), 2):
        assert any(not {i + p for p in m} & set(bad) for m in decontaminate.MASKS for i in range(13 - m[-1]))


def test_ids_that_are_no_numbers_are_an_error(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError):
        substring.substring_dedup(docs)
    small = docs.select(F.ascii("doc_id").cast("int").alias("doc_id"), "text")
    assert [r.n_removed for r in substring.substring_dedup(small, span=2).orderBy("row.doc_id").collect()] == [0, 2]
