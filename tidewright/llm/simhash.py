"""Operator 1: near-duplicates by SimHash, found with a Gray-order hierarchical index.

The 64 bits are cut into fields, and put in order so that each choice of all but three fields
leads once: two fingerprints with at most three differing bits agree in one such choice at
least. Four fields of 16 bits do while an upper node (a mask and pattern of the leading
fields) has about a thousand members; more fingerprints take five fields (25 leading bits or
more, ten orders) or six (31, twenty). In each order the distinct fingerprints are sorted by
Gray rank, so all that share the leading fields are neighbours. Runs of a node become leaf
blocks, which keep the mask of the bits that all their members share and those bits' pattern.
A search goes down pairs of blocks, then pairs of 32-member nodes inside them, and leaves out
a whole pair once the differing bits counted in the common masks exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, spanning, stored, table
from .graph import components

SEED, SHINGLE, MAX_DIFF = 42, 3, 3
#: Members that an upper node should have at most, on average; blocks of a node that one task meets at once.
CROWD, GROUP = 1024, 64
BLOCK, NODE = 512, 32
#: A fingerprint of more rows than this gets its class by a broadcast, or of a hundred-thousandth of all rows where that
#: is more: at most 100,000 fingerprints.
HOT = 1000


def fingerprint(text: bytes | None) -> int:
    """SimHash of a whole text: bits set in over half of the hashes of its 3-word shingles.

    A-Z are lower-cased; texts under three words have one shingle, the whole sequence; null
    and wordless texts have fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    counts, n, digest = np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + SHINGLE - 1]
        shingles = [b" ".join(part)] if len(words) < SHINGLE else map(b"%b %b %b".__mod__, zip(part, part[1:], part[2:]))
        h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. One row per input row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def orders(n: int, k: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """The orders of k fields, by default as many as n fingerprints take: (leading bits, fields in order as (first bit from the top, width))."""
    k = k or next((k for k, lead in ((4, 16), (5, 25)) if n <= CROWD << lead), 6)
    widths = [64 // k + (i < 64 % k) for i in range(k)]
    fields = [(sum(widths[:i]), w) for i, w in enumerate(widths)]
    out = []
    for chosen in combinations(range(k), k - 3):
        out.append((sum(widths[i] for i in chosen), [fields[i] for i in chosen] + [fields[i] for i in range(k) if i not in chosen]))
    return out


def arranged(fp: Column, fields: list[tuple[int, int]]) -> Column:
    """The bits of fp with its fields in another order."""
    parts, at = [], 64
    for first, width in fields:
        at -= width
        part = F.shiftrightunsigned(fp, 64 - first - width).bitwiseAND(F.lit((1 << width) - 1))
        parts.append(F.call_function("shiftleft", part, F.lit(at)))
    return reduce(Column.bitwiseOR, parts)


def restored(bits: np.ndarray, fields: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints whose bits were arranged."""
    out, at = np.zeros(len(bits), np.uint64), 64
    for first, width in fields:
        at -= width
        out |= ((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(64 - first - width)
    return out


def gray_rank(bits: Column) -> Column:
    """Place of a 64-bit word in the reflected Gray order, as a signed long in the same order."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, s))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(members: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Mask of the bits in which all members agree, and those bits."""
    mask = ~(np.bitwise_or.reduce(members) ^ np.bitwise_and.reduce(members))
    return mask, members[0] & mask


def close_pairs(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of members of a and b with at most `most` differing bits, by pruned descent."""

    def nodes(x):
        starts = np.arange(0, len(x), NODE)
        ones, common = np.bitwise_or.reduceat(x, starts), np.bitwise_and.reduceat(x, starts)
        mask = ~(ones ^ common)
        padded = np.append(x, np.repeat(x[-1], len(starts) * NODE - len(x))).reshape(-1, NODE)
        return mask, common & mask, padded

    (ma, pa_, xa), (mb, pb, xb) = nodes(a), nodes(b)
    ni, nj = np.nonzero(np.bitwise_count((pa_[:, None] ^ pb[None]) & ma[:, None] & mb[None]) <= most)
    out_i, out_j = [], []
    for at in range(0, len(ni), 2048):
        p, q = ni[at : at + 2048], nj[at : at + 2048]
        k, i, j = np.nonzero(np.bitwise_count(xa[p][:, :, None] ^ xb[q][:, None, :]) <= most)
        out_i.append(p[k] * NODE + i)
        out_j.append(q[k] * NODE + j)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_i, out_j))
    real = (i < len(a)) & (j < len(b))
    return i[real], j[real]


#: field: number of the order of fields; top: the leading bits.
_LEAF = "kind int, a long, b long, field int, top long, block string, mask long, pattern long, members binary"


def _leaves(most: int, fields: list[list[tuple[int, int]]]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order (field, Gray rank). Yields links inside a block, and the blocks
        of each upper node that has several or may go on in a neighbouring partition."""
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        key, held, waiting, first = None, np.zeros(0, np.uint64), [], True
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def block(members):
            nonlocal serial
            i, j = close_pairs(members, members, most)
            c, r = spanning(i[i < j], j[i < j], len(members))
            turned = restored(members, fields[key[0]])
            edges.append((turned[c].view(np.int64), turned[r].view(np.int64)))
            mask, pattern = shared_bits(members)
            serial += 1
            return (2, None, None, key[0], key[1], f"{part:08d}-{serial:012d}", int(mask.view(np.int64)), int(pattern.view(np.int64)), members.tobytes())

        def flush(last):
            nonlocal held, waiting, first
            if key is not None:
                if len(held):
                    waiting.append(block(held))
                if len(waiting) > 1 or first or last:
                    yield from waiting
                first = False
            held, waiting = np.zeros(0, np.uint64), []

        def table_of(blocks):
            n = [len(a) for a, _ in edges]
            a = np.concatenate([x for x, _ in edges]) if edges else np.zeros(0, np.int64)
            b = np.concatenate([x for _, x in edges]) if edges else np.zeros(0, np.int64)
            edges.clear()
            cols = [[1] * sum(n) + [x[0] for x in blocks], [*a.tolist(), *[None] * len(blocks)], [*b.tolist(), *[None] * len(blocks)]]
            cols += [[None] * sum(n) + [x[k] for x in blocks] for k in range(3, 9)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["kind", "a", "b", "field", "top", "block", "mask", "pattern", "members"])

        for b in rows:
            out = []
            field, top, bits = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.flatnonzero((field[1:] != field[:-1]) | (top[1:] != top[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(bits)]):
                if s == e:
                    continue
                if key != (int(field[s]), int(top[s])):
                    out += flush(False)
                    key = (int(field[s]), int(top[s]))
                held = np.concatenate([held, bits[s:e].view(np.uint64)])
                while len(held) > BLOCK:
                    waiting.append(block(held[:BLOCK]))
                    held = held[BLOCK:]
                    if len(waiting) > 1:
                        out, waiting = out + waiting[:-1], waiting[-1:]
                        first = True  # the node's last block goes out too
            if out or len(edges) > 256:
                yield table_of(out)
        yield table_of(list(flush(True)))

    return run


def links(distinct: DataFrame, most: int = MAX_DIFF) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links.

    Exact: nothing is sampled or capped, an upper node of any size is split into blocks over
    the range partitions, and block pairs are met by an equi-join on the node with the masked
    difference as its condition. A node of more than GROUP blocks is dealt to groups, each of which
    meets all its blocks in a task of its own. Each block or pair of blocks gives a spanning forest of
    its links, so that thousands of near copies give thousands of edges and not their square.
    """
    if most > 3:
        raise ValueError("all but three fields find up to three differing bits")
    ways = orders(distinct.count())
    fields = [f for _, f in ways]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lit(64 - lead).alias("rest"), arranged(F.col("fp"), f).alias("bits")) for k, (lead, f) in enumerate(ways)])).alias("w")
    turned = distinct.select(each).select("w.field", "w.rest", "w.bits")
    ranked = turned.select("field", F.call_function("shiftrightunsigned", F.col("bits"), F.col("rest")).alias("top"), "bits", gray_rank(F.col("bits")).alias("rank"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ranked.repartitionByRange(n, "field", "rank").sortWithinPartitions("field", "rank").select("field", "top", "bits")
    leaves = stored(ordered.mapInArrow(_leaves(most, fields), _LEAF), "simhash-leaves")
    near = leaves.where("kind = 1").select("a", "b")
    blocks = leaves.where("kind = 2").select("field", "top", "block", "mask", "pattern", "members")
    sizes = blocks.groupBy("field", "top").count().where(F.col("count") > 1).withColumn("groups", F.ceil(F.col("count") / GROUP).cast("int")).drop("count")
    dealt = blocks.join(sizes, ["field", "top"]).withColumn("own", F.pmod(F.xxhash64("block"), F.col("groups")).cast("int"))
    x = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).alias("x")
    y = dealt.withColumn("to", F.col("own")).alias("y")
    pruned = F.bit_count(F.expr("(x.pattern ^ y.pattern) & x.mask & y.mask")) <= most
    met = x.join(y, (F.col("x.field") == F.col("y.field")) & (F.col("x.top") == F.col("y.top")) & (F.col("x.to") == F.col("y.to")) & (F.col("x.block") < F.col("y.block")) & pruned)

    def across(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for k in range(b.num_rows):
                f, one, two = (b.column(c)[k].as_py() for c in range(3))
                p, q = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                i, j = close_pairs(p, q, most)
                both = restored(np.concatenate([p, q]), fields[f])
                c, r = spanning(i, j + len(p), len(both))
                yield pa.RecordBatch.from_arrays([pa.array(both[c].view(np.int64)), pa.array(both[r].view(np.int64))], ["a", "b"])

    far = met.select("x.field", F.col("x.members"), F.col("y.members").alias("others")).mapInArrow(across, "a long, b long")
    return near.unionByName(far)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_DIFF) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of at most `most` differing bits;
    null ids are not chosen unless a component has no other. Null, empty and wordless texts share
    fingerprint zero and are linked like any other. Other columns, whatever their names, are not
    read. An empty table gives no rows.
    """
    shared_dir(docs.sparkSession)
    fps = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    star = components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    group = star.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("of_root"))
    named = star.join(group, "root").select("fp", "of_root")
    classes = stored(distinct.join(named, "fp", "left").select("fp", "rows", F.coalesce("of_root", "least").alias("component_id")), "simhash-classes")
    # the few fingerprints of very many rows do not meet their rows by a shuffle
    many = F.col("rows") > max(HOT, fps.count() // 100_000)
    marked = fps.join(F.broadcast(classes.where(many).select("fp", "component_id", F.lit(True).alias("hot"))), "fp", "left")
    rest = marked.where("hot IS NULL").select("doc_id", "fp").join(classes.where(~many).select("fp", "component_id"), "fp")
    found = marked.where("hot").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
