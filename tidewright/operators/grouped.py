"""Per-key numpy twins of the structure measures, for many short series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import kernels

#: Series of one length that are measured together.
AT_ONCE = 512

_PAIR = StructType([StructField("alpha", DoubleType()), StructField("r2", DoubleType())])


def dfa_of_all(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, r2) of each array; those of one length are measured together."""
    alpha, r2 = np.full(len(arrays), 0.5), np.zeros(len(arrays))
    sizes = np.array([len(x) for x in arrays])
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            alpha[part], r2[part] = kernels.dfa(np.stack([arrays[k] for k in part]))
    return alpha, r2


@F.pandas_udf(_PAIR)
def dfa_of(values: pd.Series) -> pd.DataFrame:
    """(alpha, r2) of arrays in order: a column function. Non-finite values close up."""
    arrays = [np.asarray(v if v is not None else [], float) for v in values]
    alpha, r2 = dfa_of_all([x if np.isfinite(x).all() else x[np.isfinite(x)] for x in arrays])
    return pd.DataFrame({"alpha": alpha, "r2": r2})


@F.pandas_udf(_PAIR)
def dfa_short_of(values: pd.Series) -> pd.DataFrame:
    arrays = [x[np.isfinite(x)] for x in (np.asarray(v if v is not None else [], float) for v in values)]
    alpha, r2 = np.full(len(arrays), np.nan), np.full(len(arrays), np.nan)
    sizes = np.array([len(x) for x in arrays])
    for n in np.unique(sizes[sizes >= 16]):
        rows = np.flatnonzero(sizes == n)
        for at in range(0, len(rows), AT_ONCE):
            part = rows[at : at + AT_ONCE]
            alpha[part], r2[part] = kernels.dfa_shorts(np.stack([arrays[k] for k in part]))
    none = np.isnan(alpha)
    return pd.DataFrame({c: pd.Series(v).astype(object).where(~none, None) for c, v in (("alpha", alpha), ("r2", r2))})


@F.pandas_udf(ArrayType(DoubleType()))
def shuffled_of(values: pd.Series) -> pd.Series:
    """A fixed permutation of each array (seed 42): values stay, order goes."""
    return values.map(lambda v: shuffled(np.asarray(v, float)).tolist())


def shuffled(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Fisher and Yates' shuffle, from the end, driven by a 64-bit linear congruential generator."""
    x, s = x.copy(), seed
    for i in range(len(x) - 1, 0, -1):
        s = (s * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        j = (s >> 33) % (i + 1)
        x[i], x[j] = x[j], x[i]
    return x


def vectors(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values): each series as one array in the order of ticks; for series that fit one task."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tick", "value"))).alias("_s")).select(*keys, F.transform("_s", lambda x: x["value"]).alias("values"))


def dfa_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, alpha, r2), one shuffle and no row repeated per box size."""
    v = vectors(df, keys).withColumn("_d", dfa_of("values"))
    return v.select(*keys, F.size("values").cast("long").alias("n"), "_d.alpha", "_d.r2")


def dfa_short_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, alpha, r2) as of `structure.dfa_short`, in the same way."""
    v = vectors(df, keys).withColumn("_d", dfa_short_of("values"))
    return v.select(*keys, F.size("values").cast("long").alias("n"), "_d.alpha", "_d.r2")


def prove_structure(df: DataFrame, keys: list[str]) -> DataFrame:
    v = vectors(df, keys).select(*keys, dfa_of("values").alias("_a"), dfa_of(shuffled_of("values")).alias("_b"))
    out = v.select(*keys, F.col("_a.alpha").alias("alpha"), F.col("_b.alpha").alias("shuffled_alpha"))
    return out.withColumn("confirmed", F.abs(F.col("shuffled_alpha") - 0.5) < F.abs(F.col("alpha") - 0.5))


@F.pandas_udf(DoubleType())
def dfa_udaf(values: pd.Series) -> float:
    """Grouped aggregate: the exponent of a group's values in the order given."""
    x = values.to_numpy(float)
    return float(kernels.dfa(x[np.isfinite(x)])[0])
