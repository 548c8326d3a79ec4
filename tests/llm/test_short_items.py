"""Operator 5 on items of every length up to 14 tokens, against side-by-side comparison."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidewright.llm import decontaminate


def allowed(n):
    return max(k for k in range(n) if (n - k) / n >= decontaminate.SHARE)


def test_masks_meet_every_allowed_substitution():
    for n in range(1, 14):
        for bad in combinations(range(n), allowed(n)):
            assert any(not {i + p for p in m} & set(bad) for m in decontaminate.masks_of(n) for i in range(n - m[-1])), (n, bad)


def test_short_items_with_every_substitution(spark):
    rng = random.Random(5)
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in range(1, 15)}
    docs, want, doc = [], {}, 0
    for n, words in items.items():
        for k in range(allowed(min(n, 13)) + 2):
            for bad in rng.sample(list(combinations(range(n), k)), min(25, len(list(combinations(range(n), k))))):
                text = ["changed" if i in bad else w for i, w in enumerate(words)]
                docs.append((doc, " ".join([f"before{doc}"] + text + ["after"])))
                wide = min(n, 13)
                share = max(sum(i not in bad for i in range(a, a + wide)) / wide for a in range(n - wide + 1))
                if share >= 0.8:
                    want[doc, n] = (round(share, 6), n - k, 1)
                doc += 1
    docs += [(doc, " ".join(items[10][:8])), (doc + 1, " ".join(items[4])), (doc + 2, "")]
    want |= {(doc, 10): (0.8, 8, 0), (doc + 1, 4): (1.0, 4, 0)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(0, "..."), (99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.overlap, 6), r.n_equal, r.at) for r in decontaminate.contaminated(df, bench, least=1).collect()}
    assert got == want
    default = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert default == {k for k in want if k[1] >= decontaminate.SPAN}
    assert decontaminate.contaminated(df, bench.where(F.col("item_id") == 99), least=1).count() == 0
