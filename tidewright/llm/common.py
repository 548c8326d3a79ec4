"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every word-based contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where a local session names none."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jdir.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = jdir.get() if jdir.isDefined() else "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def run_dir(spark: SparkSession) -> str:
    """This application's folder of intermediate tables below the shared one; it is deleted when the driver ends."""
    where = f"{shared_dir(spark)}/tidewright-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return where


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and
    the table survives the loss of any executor."""
    path = f"{run_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of bounded rows and bytes, unless the session says how large they should be:
    whole texts of very different lengths are in a batch, and both sides hold it whole."""
    given = spark.sparkContext.getConf()
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not given.contains(key):
            spark.conf.set(key, most)


def with_text(docs: DataFrame, text_col: str, carry: list[str] | None, *more: Column) -> DataFrame:
    """(row, more..., text): the struct `row` of the columns to carry, and the text beside it only if it is not one of them."""
    small_batches(docs.sparkSession)
    names = docs.columns if carry is None else carry
    apart = [] if text_col in names else [F.col(text_col).alias("text")]
    return docs.select(F.struct(*names).alias("row"), *more, *apart)


def text_of(batch: pa.RecordBatch, text_col: str, kind: pa.DataType = pa.binary()) -> pa.Array:
    """The texts of a batch of `with_text`, as bytes if not said otherwise."""
    here = batch.schema.get_field_index("text")
    return (batch.column(here) if here >= 0 else batch.column(0).field(text_col)).cast(kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row, also where `use` reads it within its own lambdas: an expression that
    stands in a lambda is evaluated again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text leaves 2 when divided by folds; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 2, F.lit(False))


def batches(rows: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none has over `most` rows."""
    for b in rows:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (child, root) over nodes 0..n-1 with the same components as the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        nxt = root.copy()
        np.minimum.at(nxt, root[i], low)
        np.minimum.at(nxt, root[j], low)
        while not np.array_equal(nxt, nxt[nxt]):
            nxt = nxt[nxt]
        root = nxt[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]
