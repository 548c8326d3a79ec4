"""Operator 12: hard negatives by bounds along spanning trees of anchors.

Anchors are put in the order of a Hilbert curve and cut into blocks, each with a minimum spanning
tree. A candidate's score with a child differs from its score with the parent by at most the
edge's length times the candidate's norm, so intervals of scores go down the tree; only candidates whose
interval meets what the child looks for are scored, and their interval is a point from there on. Positives are
looked for above the last score that still counts, negatives in the windows that the positives set. Blocks
meet all rows in cells of a grid of blocks and groups of rows, so that neither side is held whole anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ann
from .common import batches, shared_dir, small_batches, stored, table

#: Anchors of a block, rows of a chunk, and pairs of an anchor and a row that make a cell worth a shuffle of its own.
BLOCK, CHUNK, CELL = 256, 1024, 4_000_000
#: Cells for each shuffle partition at most: more would only repeat both sides.
CELLS = 16
#: Allowance for the rounding of bounds, relative to the largest score that can be; scores themselves are exact.
SLACK = 1e-12


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of the minimum spanning tree of points from the first: parents come before their children."""
    n = len(x)
    order, parent, edge = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    near, by = np.full(n, np.inf), np.zeros(n, np.int32)
    left = np.ones(n, bool)
    at = 0
    for k in range(n):
        order[k] = at
        left[at] = False
        d = ((x - x[at]) ** 2).sum(1)
        closer = left & (d < near)
        near[closer], by[closer] = d[closer], at
        if k + 1 < n:
            at = int(np.where(left, near, np.inf).argmin())
            parent[at], edge[at] = by[at], math.sqrt(near[at])
    return order, parent, edge


class Bounds:
    """A block of anchors: intervals of the scores of a chunk's rows, down the block's tree."""

    def __init__(self, x: np.ndarray, order: np.ndarray, parent: np.ndarray, edge: np.ndarray) -> None:
        self.x, self.order, self.parent, self.edge = x, order, parent, edge
        self.reach = np.zeros(len(x))
        for v in order[1:].tolist():
            self.reach[v] = self.reach[parent[v]] + edge[v]
        self.span = float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0))) + float(self.reach.max(initial=0))

    def visit(self, chunk: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores), parents first. wanted(anchor, low, high) says which rows to score from their intervals."""
        norm = np.sqrt((chunk.astype(float) ** 2).sum(1))
        slack = SLACK * norm * self.span + 1e-6
        low, high = np.empty((len(self.x), len(chunk))), np.empty((len(self.x), len(chunk)))
        for k, v in enumerate(self.order.tolist()):
            if k:
                wide = self.edge[v] * norm + slack
                low[v], high[v] = low[self.parent[v]] - wide, high[self.parent[v]] + wide
                rows = np.flatnonzero(wanted(v, low[v], high[v]))
                scores = chunk[rows] @ self.x[v]
            else:
                scores = chunk @ self.x[v]
                low[v] = high[v] = scores
                rows = np.flatnonzero(wanted(v, low[v], high[v]))
                scores = scores[rows]
            low[v, rows] = high[v, rows] = scores
            if len(rows):
                yield v, rows, scores


def first(ids: np.ndarray, scores: np.ndarray, held: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` best of new and held ones: higher scores, then smaller ids."""
    i, s = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
    best = np.lexsort((i, -s))[:most]
    return i[best], s[best]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Positives:
    """The best rows of each anchor's own label so far."""

    def __init__(self, block: Block, most: int) -> None:
        self.block, self.most = block, most
        self.held = [_NONE] * len(block.ids)

    def add(self, ids: np.ndarray, labels: np.ndarray, chunk: np.ndarray) -> None:
        def wanted(v, low, high):
            s = self.held[v][1]
            some = (labels == self.block.labels[v]) & (ids != self.block.ids[v])
            return some & (high >= s[-1]) if len(s) == self.most else some

        for v, rows, scores in self.block.bounds.visit(chunk, wanted):
            self.held[v] = first(ids[rows], scores.astype(np.int64), self.held[v], self.most)

    def rows(self) -> Iterator[tuple]:
        for a, (ids, scores) in zip(self.block.ids.tolist(), self.held):
            yield from ((self.block.number, a, i, s) for i, s in zip(ids.tolist(), scores.tolist()))


class Negatives:
    """The best rows of other labels so far in the window of each anchor and positive."""

    def __init__(self, block: Block, most: int, share: tuple[int, int]) -> None:
        self.block, self.most = block, most
        self.asked: list[list[list]] = [[] for _ in block.ids]
        at = {a: k for k, a in enumerate(block.ids.tolist())}
        for a, p, s in block.positives:
            low, high = -(-share[0] * s // 100), share[1] * s // 100
            if low <= high:
                self.asked[at[a]].append([p, s, low, high, _NONE])

    def add(self, ids: np.ndarray, labels: np.ndarray, chunk: np.ndarray) -> None:
        def wanted(v, low, high):
            if not self.asked[v]:
                return np.zeros(len(ids), bool)
            least, most = min(w[2] for w in self.asked[v]), max(w[3] for w in self.asked[v])
            return (labels != self.block.labels[v]) & (high >= least) & (low <= most)

        for v, rows, scores in self.block.bounds.visit(chunk, wanted):
            scores = scores.astype(np.int64)
            for w in self.asked[v]:
                good = (scores >= w[2]) & (scores <= w[3])
                if good.any():
                    w[4] = first(ids[rows][good], scores[good], w[4], self.most)
                    if len(w[4][1]) == self.most:
                        w[2] = int(w[4][1][-1])

    def rows(self) -> Iterator[tuple]:
        for a, each in zip(self.block.ids.tolist(), self.asked):
            for p, ps, _, _, (ids, scores) in each:
                yield from ((a, p, ps, i, s) for i, s in zip(ids.tolist(), scores.tolist()))


class Block:
    def __init__(self, row: dict, d: int, kind: type) -> None:
        self.number, self.ids, self.labels = row["block"], np.frombuffer(row["b_ids"], np.int64), np.frombuffer(row["b_labels"], np.int64)
        x = np.frombuffer(row["b_vectors"], np.int64).reshape(len(self.ids), d)
        self.bounds = Bounds(x.astype(kind), *(np.frombuffer(row[c], t) for c, t in (("b_order", np.int32), ("b_parent", np.int32), ("b_edge", float))))
        self.positives = [(r["a"], r["p"], r["s"]) for r in row.get("positives") or []]


def padded(column: pa.Array, d: int) -> np.ndarray:
    """A list column as rows of d whole numbers; what a shorter vector lacks counts as zero."""
    out = np.zeros((len(column), d), np.int64)
    size = np.diff(column.offsets.to_numpy())
    out[np.arange(d)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _chunks(d: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, label, v) -> chunks of ids, labels and vectors as bytes."""
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        for b in batches(rows, CHUNK):
            named = {"part": pa.array([part], pa.int64()), "serial": pa.array([serial], pa.int64()), "ids": [b.column(0).to_numpy().tobytes()], "labels": [b.column(1).to_numpy().tobytes()], "vectors": [padded(b.column(2), d).tobytes()]}
            serial += 1
            yield pa.RecordBatch.from_pydict(named)

    return run


def _keyed(curves: ann.Curves | None, d: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor's place on the curve before it."""
        for b in batches(rows, 4096):
            x = padded(b.column(2), d).astype(float)
            key = np.zeros(len(x), np.int64) if curves is None else curves.keys(x / np.maximum(np.sqrt((x * x).sum(1)), 1)[:, None], 0)
            yield pa.RecordBatch.from_arrays([pa.array(key), *b.columns], ["key", "vec_id", "label", "v"])

    return run


BLOCKS = "block long, b_ids binary, b_labels binary, b_vectors binary, b_order binary, b_parent binary, b_edge binary"


def _blocks(d: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (key, vec_id, label, v) -> blocks with their trees."""
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def block():
            nonlocal number
            ids, labels, x = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order, parent, edge = spanning_tree(x.astype(float))
            number += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "b_ids": [ids.tobytes()], "b_labels": [labels.tobytes()], "b_vectors": [x.tobytes()], "b_order": [order.tobytes()], "b_parent": [parent.tobytes()], "b_edge": [edge.tobytes()]})

        for b in batches(rows, BLOCK):
            if held and sum(len(h[0]) for h in held) + b.num_rows > BLOCK:
                yield block()
            held.append((b.column(1).to_numpy(), b.column(2).to_numpy(), padded(b.column(3), d)))
        if held:
            yield block()

    return run


def _searched(d: int, kind: type, begin, names: list[str]):
    """Pairs of a block and a chunk, a block's together -> rows of what its search held in the end."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None

        def told():
            found = list(search.rows())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names)

        for b in rows:
            for k in range(b.num_rows):
                number = b.column("block")[k].as_py()
                if search is None or search.block.number != number:
                    if search is not None:
                        yield from told()
                    head = ["block", "b_ids", "b_labels", "b_vectors", "b_order", "b_parent", "b_edge", "positives"]
                    search = begin(Block({c: b.column(c)[k].as_py() for c in head if c in b.schema.names}, d, kind))
                ids = np.frombuffer(b.column("ids")[k].as_py(), np.int64)
                x = np.frombuffer(b.column("vectors")[k].as_py(), np.int64).reshape(len(ids), d)
                search.add(ids, np.frombuffer(b.column("labels")[k].as_py(), np.int64), x.astype(kind))
        if search is not None:
            yield from told()

    return run


def grid(n: int, m: int, partitions: int) -> tuple[int, int]:
    """(parts of the anchors, parts of the rows): so many cells that each has about CELL pairs, CELLS for each
    partition at most, cut so that least is repeated."""
    cells = max(1, min(math.ceil(n * m / CELL), CELLS * partitions))
    a = max(1, round(math.sqrt(cells * m / max(n, 1))))
    return a, math.ceil(cells / a)


def hard_negatives(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows whose id `every` divides.

    vectors holds whole numbers; a score is an inner product. An anchor's positives are the first `positives`
    other rows of its label, higher scores first, ties by smaller id; for each, rank counts the first `negatives` rows of
    other labels whose score is between share[0] and share[1] per cent of the positive's. Rows with a null id, label,
    vector or component take no part; components that a shorter vector lacks count as zero; of rows with one id the one
    with the smallest label, then vector, is taken. An anchor without positives, or a positive without
    negatives, gives no row. Exact at any size; scores beyond 64 bits are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    small_batches(spark)
    v = F.col("v")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"))
    whole = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    rows = stored(whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("m"), F.max(F.size("v")).alias("d"), F.max(F.array_max(v)).alias("b"), F.min(F.array_min(v)).alias("a")).first()
    if not size.m:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d = size.d
    largest = d * max(abs(size.a or 0), abs(size.b or 0)) ** 2
    if largest >= 2**63:
        raise ValueError("scores do not fit 64 bits")
    # doubles where all scores and their parts are exact in them
    kind = float if largest < 2**53 else np.int64
    curves = ann.fit(anchors.where(F.exists(v, lambda x: x != 0) & (F.size(v) == d)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = anchors.mapInArrow(_keyed(curves, d), "key long, vec_id long, label long, v array<long>")
    ordered = placed.repartitionByRange(n, "key", "vec_id").sortWithinPartitions("key", "vec_id")
    blocks = stored(ordered.mapInArrow(_blocks(d), BLOCKS), "blocks")
    a, g = grid(size.n, size.m, n)
    chunks = stored(rows.mapInArrow(_chunks(d), "part long, serial long, ids binary, labels binary, vectors binary"), "chunks")
    dealt = chunks.select(F.pmod(F.xxhash64("part", "serial"), F.lit(g)).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("a"), "ids", "labels", "vectors")

    def met(some: DataFrame) -> DataFrame:
        each = some.select("*", F.pmod(F.xxhash64("block"), F.lit(a)).alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("g"))
        return each.join(dealt.hint("shuffle_merge"), ["a", "g"]).drop("a", "g")

    near = met(blocks).mapInArrow(_searched(d, kind, lambda b: Positives(b, positives), ["block", "anchor", "vec_id", "score"]), "block long, anchor long, vec_id long, score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    chosen = near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    known = chosen.groupBy("block").agg(F.collect_list(F.struct(F.col("anchor").alias("a"), F.col("vec_id").alias("p"), F.col("score").alias("s"))).alias("positives"))
    asked = stored(blocks.join(known, "block"), "asked")
    found = met(asked).mapInArrow(_searched(d, kind, lambda b: Negatives(b, negatives, share), ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    last = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) as the contract has them: components are floor(256 * x), labels of ids that 7 divides
    move on by one of ten; vectors with a component that is not finite are null."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), F.when(~F.coalesce(bad, F.lit(False)), F.transform(e, lambda x: F.floor(256 * x))).alias("embedding"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(scaled(table(spark, sf_dir, "embeddings")), 50)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor, a.label = c.label AS same, c.vec_id AS id, list_inner_product(a.e, c.e)::BIGINT AS s FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, id AS positive_id, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5),
n AS (SELECT anchor, positive_id, ps, id, s, row_number() OVER (PARTITION BY anchor, positive_id ORDER BY s DESC, id) AS rank FROM p JOIN s USING (anchor) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps)
SELECT anchor AS anchor_id, positive_id, rank::INTEGER AS rank, id AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE rank <= 3
"""
