"""Operator 3: approximate nearest neighbours along shifted Hilbert curves.

Unit vectors are projected to AXES random directions, once for each of CURVES curves; every
curve has directions and a shift of its own. Coordinates become ranks in a bounded sample,
then BITS bits, then the place on a Hilbert curve. Spark range-partitions all vectors by curve
and place and packs neighbours into chunks of bounded size, numbered along their curve; a query
looks at the chunks of its window on every curve, and the windows' best candidates are merged
and scored again. How wide the windows must be, and on how many of the curves, is measured: a bounded
number of trial vectors is held against all rows in one pass, which tells the least window that
reaches the aimed share of their true neighbours for each number of curves; the number that reads
the fewest chunks is searched. Vectors are scaled by powers of two first, which changes no cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, shared_dir, stored, table

CURVES, AXES, BITS, TOP = 6, 5, 8, 5
#: Bounds of the fit: vectors in the sample, trial vectors; share of the trials' true neighbours that lie in the windows.
SAMPLE, TRIALS, AIM = 4096, 256, 0.97
#: Vectors of a chunk.
CHUNK, SEED = 1024, 17


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points x (n, axes) with coordinates under 2**bits (Skilling's transpose form)."""
    x = x.astype(np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.view(np.int64)


class Curves:
    """Directions, shifts and rank tables of all curves."""

    def __init__(self, sample: np.ndarray) -> None:
        """sample: (n, d) unit vectors."""
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.axes = min(AXES, d)
        self.directions = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : self.axes] for _ in range(CURVES)]
        self.ranks = [np.sort(sample @ w, axis=0) for w in self.directions]
        self.shifts = rng.uniform(0, 1, (CURVES, self.axes))

    def keys(self, unit: np.ndarray, c: int) -> np.ndarray:
        p, n = unit @ self.directions[c], len(self.ranks[c])
        share = np.stack([np.searchsorted(self.ranks[c][:, a], p[:, a]) / n for a in range(self.axes)], 1)
        return hilbert(((share + self.shifts[c]) / 2 * (1 << BITS)).astype(np.int64).clip(0, (1 << BITS) - 1), BITS)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows whose vector is not null, not zero, without null or non-finite components, and of the length
    that most such rows have (of two, the shorter)."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (usual.d if usual else 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings the largest component to between 1/2 and 1: squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def matrix(column) -> np.ndarray:
    """A record batch's list column as scaled rows of doubles."""
    lists = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return scaled(lists.reshape(len(column), -1)) if len(lists) else lists.reshape(len(column), 0)


def fit(rows: DataFrame) -> Curves | None:
    n = rows.count()
    few = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(10**9)) < min(1.0, SAMPLE / max(1, n)) * 1e9).orderBy("vec_id").limit(2 * SAMPLE).collect()
    if not few:
        few = rows.orderBy("vec_id").limit(SAMPLE).collect()
    if not few:
        return None
    x = scaled(np.array([r.v for r in few], float))
    return Curves(x / np.linalg.norm(x, axis=1, keepdims=True))


def _keyed(curves: Curves):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 4096):
            x = matrix(b.column(1))
            unit = x / np.sqrt((x * x).sum(1))[:, None]
            for c in range(CURVES):
                k = curves.keys(unit, c)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c, np.int32)), pa.array(k), *b.columns], ["curve", "key", "vec_id", "v", "asked"])

    return run


def _chunked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one row for each chunk: its curve, partition and number there, ids and vectors as bytes, and the
    places of those that are asked for."""
    from pyspark import TaskContext

    part, at, serial, held = TaskContext.get().partitionId(), None, 0, []

    def chunk():
        nonlocal serial, held
        i, x, asked = (np.concatenate(c) for c in zip(*held))
        held = []
        serial += 1
        return pa.RecordBatch.from_pydict({"curve": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "serial": pa.array([serial - 1], pa.int64()), "ids": [i.tobytes()], "vectors": [x.tobytes()], "asked": [np.flatnonzero(asked).astype(np.int32).tobytes()]})

    for b in batches(rows, CHUNK):
        curve, i, x, asked = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)), b.column(3).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(curve) != 0) + 1
        for s, e in zip([0, *cut], [*cut, len(i)]):
            if held and (at != int(curve[s]) or sum(len(h[0]) for h in held) + e - s > CHUNK):
                yield chunk()
            if at != int(curve[s]):
                at, serial = int(curve[s]), 0
            held.append((i[s:e], x[s:e], asked[s:e]))
    if held:
        yield chunk()


def chunks(rows: DataFrame, curves: Curves) -> DataFrame:
    """(curve, place, ids, vectors, asked): chunks numbered along each curve, over the borders of partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("vec_id", "v", "asked").mapInArrow(_keyed(curves), "curve int, key long, vec_id long, v array<double>, asked boolean")
    ordered = keyed.repartitionByRange(n, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    packed = stored(ordered.select("curve", "vec_id", "v", "asked").mapInArrow(_chunked, "curve int, part int, serial long, ids binary, vectors binary, asked binary"), "chunks")
    # one row a partition and curve: how many chunks lie before its own
    counts = packed.groupBy("curve", "part").count()
    before = F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("curve", "part", F.coalesce(before, F.lit(0)).alias("start"))
    placed = packed.join(F.broadcast(starts), ["curve", "part"])
    return placed.select("curve", (F.col("start") + F.col("serial")).alias("place"), "ids", "vectors", "asked")


def best_pairs(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vector ids, cosines): for each query at least its `top` nearest among x, itself too if it is there.
    Products find them; the value is then computed pair by pair, so that equal vectors score the same anywhere."""
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    near = (q / qn[:, None]) @ (x / xn[:, None]).T
    if near.shape[1] > top:
        least = -np.partition(-near, top - 1, axis=1)[:, top - 1]
    else:
        least = np.full(len(q), -2.0)
    i, j = np.nonzero(near >= (least - 1e-12)[:, None])
    score = (q[i] * x[j]).sum(1) / (qn[i] * xn[j])
    order = np.lexsort((xi[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(q)), "left")
    keep = np.arange(len(i)) - first[i] < top
    return qi[i[keep]], xi[j[keep]], score[keep]


def _held(batch: pa.RecordBatch, k: int, ids: int, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(batch.column(ids)[k].as_py(), np.int64)
    return i, np.frombuffer(batch.column(vectors)[k].as_py(), float).reshape(len(i), -1)


FOUND = "query_id long, vec_id long, score double"


def _searched(top: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                (qi, q), (xi, x) = _held(b, k, 0, 1), _held(b, k, 2, 3)
                a, v, s = best_pairs(q, x, qi, xi, top)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _against_all(qi: np.ndarray, q: np.ndarray, top: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest of a partition's vectors for each of a few queries: one row each at the end."""
        a, v, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in rows:
            for k in range(b.num_rows):
                xi, x = _held(b, k, 0, 1)
                found = best_pairs(q, x, qi, xi, top)
                a, v, s = (np.concatenate(c) for c in zip((a, v, s), found))
                order = np.lexsort((v, -s, a))
                a, v, s = a[order], v[order], s[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a, "left") < top
                a, v, s = a[keep], v[keep], s[keep]
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _where(ids: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(curve, place, vec_id) of a few vectors."""
        for b in rows:
            for k in range(b.num_rows):
                here = np.intersect1d(np.frombuffer(b.column(2)[k].as_py(), np.int64), ids)
                if len(here):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), b.column(0)[k].as_py(), np.int32)), pa.array(np.full(len(here), b.column(1)[k].as_py(), np.int64)), pa.array(here)], ["curve", "place", "vec_id"])

    return run


class Trials:
    """Where trial vectors and their true neighbours lie: chunks between each pair on every curve, the trials'
    own chunks, and the number of chunks of each curve."""

    def __init__(self, gaps: np.ndarray, own: np.ndarray, chunks: np.ndarray) -> None:
        self.gaps, self.own, self.chunks = gaps, own, chunks

    def read(self, curves: int, w: int) -> float:
        """Chunks that a query reads on the first `curves` curves, on average."""
        at, last = self.own[:, :curves], self.chunks[:curves] - 1
        return float((np.minimum(at + w, last) - np.maximum(at - w, 0) + 1).sum(1).mean())


def trials(index: DataFrame, some: DataFrame, top: int) -> Trials | None:
    """What the index has of the `top` true neighbours of `some` vectors (vec_id, v; at most TRIALS). All rows are
    compared with them, in one pass."""
    few = some.limit(TRIALS).collect()
    if not few:
        return None
    qi, q = np.array([r.vec_id for r in few], np.int64), scaled(np.array([r.v for r in few], float))
    order = np.argsort(qi)
    true = index.where("curve = 0").select("ids", "vectors").mapInArrow(_against_all(qi[order], q[order], top), FOUND)
    ranked = true.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= top)
    pairs = np.array([(r.query_id, r.vec_id) for r in ranked.collect()], np.int64).reshape(-1, 2)  # TRIALS * top at most
    at = {}
    for r in index.select("curve", "place", "ids").mapInArrow(_where(np.unique(pairs)), "curve int, place long, vec_id long").collect():
        at.setdefault(r.vec_id, [0] * CURVES)[r.curve] = r.place
    chunks = {r.curve: r["count"] for r in index.groupBy("curve").count().collect()}
    places = {i: np.array(p) for i, p in at.items()}
    gaps = np.array([np.abs(places[a] - places[b]) for a, b in pairs.tolist()])
    return Trials(gaps, np.array([places[i] for i in qi.tolist() if i in places]), np.array([chunks[c] for c in range(CURVES)]))


def _least(known: Trials, curves: int, aim: float) -> int:
    near = np.sort(known.gaps[:, :curves].min(1))
    return int(near[min(len(near) - 1, int(np.ceil(aim * len(near))))])


def window(known: Trials | None, curves: int, aim: float = AIM) -> int:
    """Chunks to each side that must be searched, so that `aim` of the trials' neighbours lie in a window of the
    first `curves` curves."""
    if known is None:
        return 0
    return _least(known, curves, aim)


def cheapest(known: Trials | None) -> int:
    """The number of curves whose windows read the fewest chunks; one curve's window never reads more than all chunks."""
    if known is None:
        return 1
    at = range(1, CURVES + 1)
    return min(at, key=lambda c: known.read(c, _least(known, c, AIM)))


def nearest(vectors: DataFrame, every: int, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of the rows whose id `every` divides.

    All rows but the query's own are candidates. Nearness is the cosine of the original vectors in
    double precision, ties to the smaller id; with fewer candidates in the windows there are fewer
    rows. Rows with a null id, or whose vector is null, zero or not finite, take no part, nor do rows of
    another length than most: a cosine needs two of one length. Finite components of any size give their cosine. Of equal vectors the top + 1 with the smallest ids are indexed: the others could
    only tie behind them; the first of them is searched for, and all queries with that vector share what it finds.
    Rows that repeat an id count once.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    good = stored(usable(vectors, id_col, vector_col).dropDuplicates(["vec_id"]), "vectors")
    curves = fit(good)
    if curves is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a hot vector's copies are thinned in two steps, the first one dealt out by the id
    salted = Window.partitionBy("v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    some = good.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= top + 1)
    queries = good.where(F.col("vec_id") % every == 0)
    wanted = queries.select("v").distinct().withColumn("q", F.lit(True))
    few = some.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    flagged = few.join(wanted, "v", "left").select("vec_id", "v", (F.col("q").isNotNull() & (F.col("k") == 1)).alias("asked"))
    marked = stored(flagged, "marked")
    index = stored(chunks(marked, curves), "index")
    heads = marked.where("asked")
    known = trials(index, heads.orderBy(F.xxhash64("vec_id", F.lit(SEED))).select("vec_id", "v"), top + 1)
    used = cheapest(known)
    w = window(known, used)
    index = index.where(F.col("curve") < used)

    def asking(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                i, x = _held(b, k, 2, 3)
                at = np.frombuffer(b.column(4)[k].as_py(), np.int32)
                yield pa.RecordBatch.from_pydict({"curve": pa.array([b.column(0)[k].as_py()], pa.int32()), "place": pa.array([b.column(1)[k].as_py()], pa.int64()), "q_ids": [i[at].tobytes()], "q_vectors": [x[at].tobytes()]})

    asked = index.where(F.length("asked") > 0).mapInArrow(asking, "curve int, place long, q_ids binary, q_vectors binary")
    reach = asked.select("curve", F.explode(F.sequence(F.col("place") - w, F.col("place") + w)).alias("place"), "q_ids", "q_vectors")
    met = reach.join(index.select("curve", "place", "ids", "vectors").hint("shuffle_merge"), ["curve", "place"]).select("q_ids", "q_vectors", "ids", "vectors")
    found = met.mapInArrow(_searched(top + 1), FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= top + 1)
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("list"))
    # every query has the list of its vector's first copy, without itself
    shared = heads.join(lists, heads["vec_id"] == lists["query_id"]).select("v", "list")
    own = queries.join(shared, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("vec_id")), 1, top).alias("list"))
    each = own.select("query_id", F.posexplode("list").alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 50)
