"""Queries that take every row of their table, against brute force."""

from tidewright.jobs.catalog import QUERIES


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_gc_windows_of_all_documents(spark, tmp_path):
    texts = {3: "gATc" * 30, 70: "GC" * 2600, 71: "a" * 99, 5000: "cAt" * 1700}
    got = {(r.series_id, r.tick): r.value for r in QUERIES["pre14_gc_windows"](spark, documents(spark, tmp_path, [*texts.items(), (72, None)])).collect()}
    want = {}
    for k, t in texts.items():
        for w in range(len(t) // 100):
            part = t[w * 100 : w * 100 + 100].upper()
            want[k, w] = round(sum(c in "GC" for c in part) / 100, 6)
    assert got == want and {k for k, _ in got} == {3, 70, 5000}


def test_box_sizes_of_all_documents(spark, tmp_path):
    got = QUERIES["dfa1_box_sizes"](spark, documents(spark, tmp_path, [(5, "x"), (1999, "x"), (2000, "x"), (90000, "x")])).collect()
    assert {r.n for r in got} == {65, 2059, 2060, 90060} - ({65} if 65 // 4 <= 16 else set())
