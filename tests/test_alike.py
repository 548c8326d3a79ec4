"""Series that are all alike: their pairs meet in many tasks, not in the few cells that hold them."""

import math
import random

from pyspark.sql import functions as F

from tidewright.operators import structure


def test_pairs_of_one_cell_are_dealt_out(spark):
    rng = random.Random(8)
    rows = [(i, 0.5 + rng.random() * 0.1, 0.3 + rng.random() * 0.3, 3 + rng.random(), 0.5 + rng.random() * 0.02) for i in range(90)]
    fps = spark.createDataFrame(rows, "series_id long, alpha double, width double, kurtosis double, hurst double")
    near = structure.similar_fingerprints(fps, "series_id", 0.2)
    want = set()
    for a in rows:
        for b in rows:
            d = math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + 0.1 * ((a[3] - b[3]) / max(a[3], b[3], 1)) ** 2 + (a[4] - b[4]) ** 2)
            if a[0] < b[0] and d < 0.2:
                want.add((a[0], b[0]))
    got = [(r.a, r.b) for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        tasks = structure.similar_fingerprints(fps, "series_id", 0.2).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(r["count"] for r in tasks) < len(want) / 4


def test_fingerprints_are_measured_once_for_both_sides(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measured(v):
        seen.add(1)
        return v

    rows = [(i, 0.5 + i / 1000, 0.3, 3.0, 0.5) for i in range(40)]
    fps = spark.createDataFrame(rows, "series_id long, alpha double, width double, kurtosis double, hurst double").withColumn("alpha", measured("alpha"))
    assert structure.similar_fingerprints(fps, "series_id", 0.2).count() == 40 * 39 // 2
    assert seen.value == 40
