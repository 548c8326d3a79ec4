"""The registered queries on the smallest given tables: against their SQL, the contracts' formulas, or brute force."""

import math
import os

import duckdb
import numpy as np
import pytest

from tidewright.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(registry.ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_quoted_replies_link(spark):
    rows = registry.QUERIES["quoted_replies"](spark, SF).collect()
    assert sum(r.n_linked for r in rows) > 50 and max(r.depth for r in rows) >= 2
    assert any(r.parent is not None and r.parent < r.turn - 1 for r in rows)  # a quotation of level 2 only


def test_toxicity_learns_from_few_labels(spark, duck):
    rows = registry.QUERIES["op4_toxicity"](spark, SF).collect()
    toxic = dict(duck.sql("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    assert len(rows) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    up = [r.score for r in rows if toxic.get(r.doc_id) == 1]
    down = [r.score for r in rows if toxic.get(r.doc_id) == 0]
    better = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    assert better > 0.8 and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_lm_base_columns(spark, duck):
    got = {r.doc_id: r for r in registry.QUERIES["op7_lm_scoring"](spark, SF).collect()}
    docs = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    import re
    import zlib
    from collections import Counter

    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t)) + [None]
    count = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t in docs:
        ws, r = tokens(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in count for w in ws), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_language_of_held_out_documents(spark, duck):
    lang = dict(duck.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = [r for r in registry.QUERIES["op9_language_id"](spark, SF).collect() if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) > 20 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.9


def test_nearest_recall_on_embeddings(spark, duck):
    got = {}
    for r in registry.QUERIES["op3_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, x = zip(*duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall())
    ids, x = np.array(ids), np.array(x, float)
    norm, hit = np.sqrt((x * x).sum(1)), 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norm * norm[q])
        s[q] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]].tolist())
        mine = sorted(got[int(ids[q])])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and [m[2] for m in mine] == pytest.approx([s[np.flatnonzero(ids == m[1])[0]] for m in mine], abs=1e-14)
        hit += len(want & {m[1] for m in mine})
    assert hit >= 0.9 * 5 * (ids % 50 == 0).sum()
