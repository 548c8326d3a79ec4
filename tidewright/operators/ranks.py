"""Order statistics of series that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a round; two rounds part values by their range into the square of it.
CELLS = 65_536


def nth_smallest(df: DataFrame, keys: list[str], value: str, nth: str, rounds: int = 2, cells: int = CELLS) -> DataFrame:
    """(keys, value): of each series the value with the number `nth` in rising order, from 0; `nth` is SQL over the count `n`.

    Exact. Counts in cells of equal width lead to the cell that holds it, `rounds` times over; what that cell still holds is
    counted value by value. Nulls take no part; values are finite. A number the series does not have gives no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    at = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).select(*keys, "_lo", "_hi", F.expr(nth).alias("_k"))

    def holding(counts: DataFrame, order: str) -> DataFrame:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumn("_b", before).where("_k >= _b AND _k < _b + _n")

    for _ in range(rounds):
        share = (F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        cell = F.coalesce(F.least(F.floor(share * cells), F.lit(cells - 1)), F.lit(0)).alias("_cell")
        inside = rows.join(at, keys).where("_x BETWEEN _lo AND _hi")
        counts = inside.groupBy(*keys, "_k", cell).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        at = holding(counts, "_cell").select(*keys, "_lo", "_hi", (F.col("_k") - F.col("_b")).alias("_k"))
    left = rows.join(at, keys).where("_x BETWEEN _lo AND _hi").groupBy(*keys, "_k", "_x").agg(F.count("*").alias("_n"))
    return holding(left, "_x").select(*keys, F.col("_x").alias(value))
