"""Operator 13: runs of periodic words, by tiles for each octave of periods.

A run of period q has q words that stand at least three times in a row, so the places i where word
i equals word i + q form a stretch of 2q places and more. For the octave of periods from L to 2L
such a stretch covers a whole step of L places from a multiple of L, a boundary. A tile is the
words around some boundaries, L before the first to 4L from the last. Hashes of L words, doubled
from octave to octave, tell which boundaries may lie in a run at all; only these are solved, by the
Z-function of the words from the boundary on, which gives all periods' reach at once, and by what
equals before it. Tiles overlap, so a long run comes as fragments that are stitched by document and
period. Short documents are solved many at a time, as one sequence with a mark of its own after each,
and stitched where they are; the tiles of long ones are dealt to all tasks and their fragments
meet in a shuffle by document and period.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, shared_dir, small_batches, table

#: A run has LEAST words and TIMES periods at least.
LEAST, TIMES = 24, 3
#: Periods under FIRST are compared place by place; FIRST is the first octave's L.
FIRST = 8
#: Characters of a text beyond which its tiles are dealt to other tasks, and boundaries' words in such a tile.
LONG, TILE = 65_536, 32_768

RUNS = "array<struct<start:long,length:long,period:long>>"
Fragment = tuple[int, int, int]


def z_function(a: list, upto: int) -> list[int]:
    """For each place under `upto`, how many elements from there on equal those from the start on."""
    n, z, left, right = len(a), [0] * upto, 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def short_periods(x: np.ndarray) -> Iterator[Fragment]:
    """(q, s, e) of the stretches [s, e) of places that equal the one q on, for smallest periods q under FIRST."""
    for q in range(1, min(FIRST, len(x))):
        same = np.flatnonzero(x[q:] == x[:-q])
        if len(same) < LEAST - q:
            continue
        cut = np.flatnonzero(np.diff(same) > 1)
        s, e = same[np.r_[0, cut + 1]], same[np.r_[cut, len(same) - 1]] + 1
        for a, b in zip(s[e - s >= LEAST - q].tolist(), e[e - s >= LEAST - q].tolist()):
            if not any(q % r == 0 and (x[a : a + q - r] == x[a + r : a + q]).all() for r in range(1, q)):
                yield q, a, b


def octaves(x: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(L, boundaries, gaps): the multiples of L whose L words come again L to 2L - 1 places on, as far as hashes tell,
    for all L that a document of `longest` words has room for; gaps are the first two such places' distance (0: one only)."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    length = 1
    while TIMES * length <= longest:
        if length >= FIRST and len(h) > length:
            m = len(h) // length
            rows = h[: m * length].reshape(m, length)
            at = np.flatnonzero((rows[1:] == rows[:-1, :1]).ravel())
            rest = np.flatnonzero(h[m * length :] == rows[-1, 0]) + (m - 1) * length
            at = np.concatenate([at, rest])
            if len(at):
                k, first = np.unique(at // length, return_index=True)
                second = np.minimum(first + 1, len(at) - 1)
                gap = np.where(at[second] // length == k, at[second] - at[first], 0)
                yield length, k * length, gap
        if len(h) <= length:
            return
        h = h[:-length] * np.uint64(0xD6E8FEB86659FD93) + h[length:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        length *= 2


def at_boundary(x: np.ndarray, b: int, length: int, gap: int) -> Iterator[Fragment]:
    """The fragments (q, s, e) around boundary b of all smallest periods q from length to 2 * length - 1; x reaches
    `length` words before b and 4 * length from it, or is all there is."""
    a = x[b : b + 4 * length]
    # words of a smaller period all through: whatever comes again here is a multiple of it
    if 0 < gap < length and (a[gap:] == a[:-gap]).all():
        return
    upto = min(2 * length, len(a))
    z = np.array(z_function(a.tolist(), upto))
    open_ = np.flatnonzero(z[length:] >= length) + length
    for r in (np.flatnonzero(z[1:length] + np.arange(1, min(length, upto)) >= length) + 1).tolist():
        if not len(open_):
            return
        open_ = open_[(open_ % r != 0) | (z[r] + r < open_)]
    low = max(0, b - length)
    for q in open_.tolist():
        other = np.flatnonzero(x[low:b] != x[low + q : b + q])
        yield q, (low + int(other[-1]) + 1 if len(other) else low), b + int(z[q])


def fragments(x: np.ndarray, longest: int) -> Iterator[Fragment]:
    """All fragments of a sequence that one task holds."""
    yield from short_periods(x)
    for length, bs, gaps in octaves(x, longest):
        for b, gap in zip(bs.tolist(), gaps.tolist()):
            yield from at_boundary(x, b, length, gap)


def stitched(found: Iterable[Fragment]) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) from fragments in any order."""
    q0, s0, e0 = 0, 0, -1
    for q, s, e in [*sorted(found), (0, 0, 0)]:
        if q == q0 and s <= e0:
            e0 = max(e0, e)
            continue
        if q0 and e0 - s0 + q0 >= max(LEAST, TIMES * q0):
            yield s0, e0 - s0 + q0, q0
        q0, s0, e0 = q, s, e


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words, ends): all words of all texts as numbers of a dictionary, and the texts' bounds among them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    coded = lists.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    keep = number != pc.index(coded.dictionary, "").as_py()
    ends = np.r_[0, np.cumsum(keep)][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return pa.DictionaryArray.from_arrays(pa.array(number[keep], pa.int32()), coded.dictionary), ends


def marked(number: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each with a number of its own behind it, and their starts there."""
    n = len(ends) - 1
    out = np.empty(len(number) + n, np.int64)
    at = np.arange(len(number)) + np.repeat(np.arange(n), np.diff(ends))
    out[at] = number
    out[ends[1:] + np.arange(n)] = -1 - np.arange(n)
    return out, ends[:-1] + np.arange(n)


def solved(words: pa.DictionaryArray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each text, by start, then period."""
    number = words.indices.to_numpy(zero_copy_only=False)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(ends) - 1)]
    if len(number):
        x, starts = marked(number, ends)
        for s, n, q in stitched(fragments(x, int(np.diff(ends).max()))):
            k = int(np.searchsorted(starts, s, "right")) - 1
            out[k].append((s - int(starts[k]), n, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: pa.DictionaryArray, ends: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Each text's words, joined by a space, without those that repeat a period of a run."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, each in zip(ends[:-1].tolist(), runs):
        for s, n, q in each:
            step[start + s + q] += 1
            step[start + s + n] -= 1
    keep = np.cumsum(step[:-1]) == 0
    left = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)][ends], pa.int32()), words.filter(pa.array(keep)).dictionary_decode())
    return pc.binary_join(left, " ")


def _rows(batch: pa.RecordBatch, words: pa.DictionaryArray, ends: np.ndarray, runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    flat = np.array([r for each in runs for r in each], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), values)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, collapsed(words, ends, runs)], ["row", "n_words", "runs", "collapsed"])


def _at_once(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, n_words, runs, collapsed)."""
    for b in rows:
        words, ends = split(b.column(1))
        yield _rows(b, words, ends, solved(words, ends))


def _with_runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, runs) -> (row, n_words, runs, collapsed)."""
    for b in rows:
        words, ends = split(b.column(1))
        yield _rows(b, words, ends, [[(r["start"], r["length"], r["period"]) for r in each or []] for each in b.column(2).to_pylist()])


TILES = "th long, len int, octave long, base long, n long, q long, s long, e long, bounds binary, words binary"


def _tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, len, text) -> tiles of each octave, and short periods' stretches as fragments."""
    for b in rows:
        for k in range(b.num_rows):
            th, ln = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            words, _ = split(b.column(2).slice(k, 1))
            x = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            done = [(0, 0, 0, *f, b"", b"") for f in short_periods(x)]
            for length, bs, gaps in octaves(x, len(x)):
                # boundaries of a tile lie within TILE words; one tile at least holds one boundary
                for group in np.split(np.arange(len(bs)), np.flatnonzero(np.diff(bs // max(TILE, length))) + 1):
                    low = max(0, int(bs[group[0]]) - length)
                    high = min(len(x), int(bs[group[-1]]) + 4 * length)
                    pairs = np.stack([bs[group] - low, gaps[group]], 1).astype(np.int64)
                    done.append((length, low, high - low, 0, 0, 0, pairs.tobytes(), x[low:high].astype(np.int32).tobytes()))
                    if len(done) >= 64:
                        yield _table(th, ln, done)
                        done = []
            if done:
                yield _table(th, ln, done)


def _table(th: int, ln: int, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    names = ["octave", "base", "n", "q", "s", "e", "bounds", "words"]
    return pa.RecordBatch.from_arrays([pa.array([th] * len(rows), pa.int64()), pa.array([ln] * len(rows), pa.int32()), *columns], ["th", "len", *names])


def _from_tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles -> (th, len, q, s, e)."""
    for b in rows:
        out = []
        for r in b.to_pylist():
            if not r["octave"]:
                out.append((r["th"], r["len"], r["q"], r["s"], r["e"]))
                continue
            x = np.frombuffer(r["words"], np.int32).astype(np.int64)
            for at, gap in np.frombuffer(r["bounds"], np.int64).reshape(-1, 2).tolist():
                out += [(r["th"], r["len"], q, s + r["base"], e + r["base"]) for q, s, e in at_boundary(x, at, r["octave"], gap)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["th", "len", "q", "s", "e"])


def _stitch(found: DataFrame) -> DataFrame:
    """(th, len, q, s, e) -> (th, len, runs): fragments that meet are one, by document and period."""
    order = Window.partitionBy("th", "len", "q").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= reach, 0).otherwise(1)).over(order)
    whole = found.distinct().withColumn("_i", island).groupBy("th", "len", "q", "_i").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    runs = whole.select("th", "len", F.struct(F.col("s").alias("start"), (F.col("e") - F.col("s") + F.col("q")).alias("length"), F.col("q").alias("period")).alias("r"))
    good = runs.where(F.col("r.length") >= F.greatest(F.lit(LEAST), TIMES * F.col("r.period")))
    by = good.groupBy("th", "len").agg(F.sort_array(F.collect_list(F.struct("r.start", "r.period", "r.length"))).alias("_r"))
    return by.select("th", "len", F.transform("_r", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))


def periodic_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, long: int = LONG) -> DataFrame:
    """(row, n_words, runs, collapsed) of each document: row is a struct of the columns to carry (all, if not said).

    runs lists (start, length, period) by start, then period: words from start on, `length` of them, of which those
    `period` apart are equal; period is the smallest such, length max(24, 3 * period) at least, and no word beside
    them goes on with it. collapsed has the words, joined by a space, but those that a run holds after its first
    period. Words are runs of anything but ASCII white space. A null or empty text has no words, no runs and an empty
    collapsed text. Each row gives one row, repeated ones too; names of other columns do not matter, as all are in `row`.
    Texts of over `long` characters are cut into tiles that go to other tasks.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    small_batches(spark)
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, runs {RUNS}, collapsed string"
    large = F.coalesce(F.length("text"), F.lit(0)) > long
    short = rows.where(~large).mapInArrow(_at_once, schema)
    keyed = rows.where(large).select("row", "text", F.xxhash64("text").alias("th"), F.length("text").alias("len"))
    tiles = keyed.select("th", "len", "text").mapInArrow(_tiles, TILES)
    # equal texts have equal tiles: one of them is dealt out
    dealt = tiles.dropDuplicates(["th", "len", "octave", "base", "n", "q", "s", "e"])
    found = dealt.mapInArrow(_from_tiles, "th long, len int, q long, s long, e long")
    known = keyed.join(_stitch(found), ["th", "len"], "left").select("row", "text", "runs")
    return short.unionByName(known.mapInArrow(_with_runs, schema))


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: with h = crc32 of the decimal id, where 10 divides h, the words from a = h / 10 % n on
    repeat the first p = 1 + (n - a) / (3 + h / 10 % 8) of them. Other texts, and those of null ids, stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def made(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = F.when(n > 0, g % n)

        def word(i: Column) -> Column:
            p = 1 + F.floor((n - a) / (3 + g % 8))
            return F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))

        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word), " ")).otherwise(F.lit(""))

    ws = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    return F.when(h % 10 == 0, let(ws, made)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of (row, n_words, runs, collapsed), whose row holds a doc_id."""
    def more(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        by = [(x > y, -1), (x < y, 1), (a["start"] < b["start"], -1), (a["start"] > b["start"], 1), (a["period"] < b["period"], -1), (a["period"] > b["period"], 1)]
        out = F.lit(0)
        for c, v in reversed(by):
            out = F.when(c, v).otherwise(out)
        return out

    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = F.get(F.array_sort("runs", more), F.lit(0))
    out = found.select(F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", F.expr("(1000 * _b.length) div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    return digest(periodic_runs(docs, carry=["doc_id"]))
