"""Operator 2: exact removal of word spans that an earlier document holds too.

The reference is the corpus itself, so no automaton of it is small enough to broadcast. It is
cut into shards by content instead: the least 8-word hash of a 50-word window is the same
wherever the window stands, so windows that can be equal meet in the shard of the first
document, and stretch of it, that holds their least hash. Each shard has its own suffix
automaton of what its earlier documents say; later documents stream through it, and their
matching statistics give the spans of at least 50 words to remove. A passage that stands
between other words in very many documents makes a shard of very many stretches; such a shard
is cut again by the hashes of its whole windows, each of which goes to the first document that
holds it, so that no automaton outgrows a stretch. Hashes choose the shard, and equal stretches
are known by their MD5; everything else that is removed was compared word by word.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, shared_dir, small_batches, stored, table, text_of, with_text

SPAN, GRAM, STRETCH = 50, 8, 256
#: A shard of more distinct stretches than this is cut again; a millionth of all stretches, where that is more.
HOT = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_hashes(words: list[bytes], span: int = SPAN, gram: int = GRAM) -> np.ndarray:
    """For each window of `span` words the least of its `gram`-word hashes; none if the text is shorter."""
    if len(words) < span:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], dtype=np.uint64)
    grams = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams = grams * _MIX + h[k : len(h) - gram + 1 + k]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    width, low, have = span - gram + 1, grams, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class Automaton:
    """Suffix automaton of several word sequences, grown one sequence at a time. Words are numbered; a
    state's first transition lies in arrays, only states with several have a dictionary of the others."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def add(self, words: list[bytes]) -> None:
        number, word, to, more, link, length, last = self.numbers, self.word, self.to, self.more, self.link, self.length, 0
        for x in words:
            w = number.setdefault(x, len(number))
            q = to[last] if word[last] == w else more[last].get(w, -1) if last in more else -1
            if q >= 0:
                last = q if length[q] == length[last] + 1 else self._split(last, q, w)
                continue
            cur, p = len(link), last
            word.append(-1)
            to.append(-1)
            link.append(0)
            length.append(length[last] + 1)
            while p >= 0:
                if word[p] < 0:
                    word[p], to[p] = w, cur
                elif word[p] == w:
                    q = to[p]
                    break
                elif (q := more.setdefault(p, {}).setdefault(w, cur)) != cur:
                    break
                p = link[p]
            if p >= 0:
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = cur

    def _split(self, p: int, q: int, w: int) -> int:
        word, to, more, link, length = self.word, self.to, self.more, self.link, self.length
        copy = len(link)
        word.append(word[q])
        to.append(to[q])
        if q in more:
            more[copy] = dict(more[q])
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0:
            if word[p] == w and to[p] == q:
                to[p] = copy
            elif p in more and more[p].get(w) == q:
                more[p][w] = copy
            else:
                break
            p = link[p]
        return copy

    def ends(self, words: list[bytes], span: int) -> list[int]:
        """Places i such that the `span` words ending at i occur in a sequence added before."""
        number, word, to, more, link, length, state, matched, out = self.numbers, self.word, self.to, self.more, self.link, self.length, 0, 0, []
        for i, x in enumerate(words):
            w = number.get(x, -2)
            while True:
                q = to[state] if word[state] == w else more[state].get(w, -1) if state in more else -1
                if q >= 0 or not state:
                    break
                state = link[state]
                matched = length[state]
            if q < 0:
                matched = 0
                continue
            state, matched = q, matched + 1
            while length[link[state]] >= span:  # a shorter suffix does
                state = link[state]
                matched = length[state]
            if matched >= span:
                out.append(i)
        return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last] of consecutive integers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


def _anchors(span: int, gram: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's distinct least hashes with the place of the first window that has it."""
        for b in batches(rows, 256):
            ids, hashes, at = [], [], []
            for i, t in zip(b.column(0), b.column(1)):
                low = least_hashes(t.as_py().split(), span, gram)
                if len(low):
                    change = np.r_[0, np.flatnonzero(low[1:] != low[:-1]) + 1]
                    kinds, first = np.unique(low[change], return_index=True)
                    ids.append(np.repeat(i.as_py(), len(kinds)))
                    hashes.append(kinds.view(np.int64))
                    at.append(change[first])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (hashes, ids, at)], ["anchor", "doc_id", "at"])

    return run


_STRETCH = pa.schema([("first", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def _stretches(span: int, gram: int, stretch: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Maximal runs of windows whose least hash is shared and belongs to one shard."""
        for b in batches(rows, 256):
            out: list[list] = [[] for _ in _STRETCH]
            for k in range(b.num_rows):
                doc, th, text = (b.column(c)[k].as_py() for c in range(3))
                words = text.split()
                low = least_hashes(words, span, gram)
                anchors, firsts, ats = (np.array(b.column(c)[k].as_py(), np.int64) for c in (3, 4, 5))
                order = np.argsort(anchors.view(np.uint64))
                known = anchors.view(np.uint64)[order]
                place = np.minimum(np.searchsorted(known, low), len(known) - 1)
                shared = np.flatnonzero(known[place] == low)
                if not len(shared):
                    continue
                one, two = firsts[order][place[shared]], ats[order][place[shared]] // stretch
                cut = np.flatnonzero((np.diff(shared) > 1) | (np.diff(one) != 0) | (np.diff(two) != 0))
                for s, e in zip(np.r_[0, cut + 1].tolist(), np.r_[cut, len(shared) - 1].tolist()):
                    start, end = int(shared[s]), int(shared[e]) + span
                    for col, v in zip(out, (int(one[s]), int(two[s]), doc, th, start, end - start, b" ".join(words[start:end]))):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _STRETCH)], schema=_STRETCH)

    return run


def _matched(span: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (first, shard, h, least, words) in the order (first, shard, least): the distinct
        stretches of a shard stream through its automaton, earlier documents first. A document's
        own stretches are added after all of them were matched."""
        key, doc, auto, later = None, None, None, []
        for b in batches(rows, 1024):
            keep: list[tuple] = []
            for k in range(b.num_rows):
                first, shard, h, least, text = (b.column(c)[k].as_py() for c in range(5))
                words = text.split()
                if key != (first, shard):
                    key, doc, auto, later = (first, shard), least, None, []
                elif doc != least:
                    auto = auto or Automaton()
                    for w in later:
                        auto.add(w)
                    doc, later = least, []
                starts = np.array(auto.ends(words, span), np.int64) - (span - 1) if auto else np.zeros(0, np.int64)
                for s, e in _runs(starts):
                    keep.append((first, shard, h, s, e + span))
                missing = np.setdiff1d(np.arange(len(words) - span + 1), starts, assume_unique=True)
                later += [words[s : e + span] for s, e in _runs(missing)]
            if keep:
                cols = list(zip(*keep))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["first", "shard", "h", "s", "e"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, th, s, e): word ranges [s, e) that lie in windows which a smaller doc_id has too.

    th is xxhash64 of the text and tells rows with the same id apart. Ranges may overlap. Ids that are
    not whole numbers are an error.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number: it says which document is the earlier one")
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    base = known.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return _spans(base, span, min(GRAM, span))


def _spans(base: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, th, s, e) over rows (doc_id, th, text). Hashes of `gram` words make the shards; with whole windows
    (gram = span) every shard holds parts of one stretch of one document."""
    spark = base.sparkSession
    anchors = stored(base.select("doc_id", "text").mapInArrow(_anchors(span, gram), "anchor long, doc_id long, at long"), "anchors")
    firsts = anchors.groupBy("anchor").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.max("doc_id").alias("m")).where("m > f.doc_id")
    lists = anchors.select("anchor", "doc_id").distinct().join(firsts.select("anchor", "f"), "anchor").groupBy("doc_id")
    lists = lists.agg(F.collect_list("anchor").alias("anchors"), F.collect_list("f.doc_id").alias("firsts"), F.collect_list("f.at").alias("ats"))
    cut = base.join(lists.hint("shuffle_merge"), "doc_id").select("doc_id", "th", "text", "anchors", "firsts", "ats").mapInArrow(_stretches(span, gram, STRETCH), "first long, shard long, doc_id long, th long, start long, n long, words binary")
    pieces = stored(cut.withColumn("h", F.md5("words")), "stretches")
    slim = pieces.select("first", "shard", "h", "doc_id", "th", "start", "n")
    least = stored(slim.groupBy("first", "shard", "h").agg(F.min("doc_id").alias("least")), "heads")
    heads = pieces.groupBy("first", "shard", "h").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")).select("first", "shard", "h", "least", "words")
    inner = None
    if gram < span:
        most = max(HOT, least.count() // 1_000_000)
        hot = stored(least.groupBy("first", "shard").count().where(F.col("count") > most).select("first", "shard"), "hot-shards")  # a million at most
        if not hot.isEmpty():
            crowded = stored(heads.join(F.broadcast(hot), ["first", "shard"], "left_semi").withColumn("th", F.monotonically_increasing_id()), "crowded")
            again = _spans(crowded.select(F.col("least").alias("doc_id"), "th", F.col("words").alias("text")), span, span)
            inner = crowded.select("first", "shard", "h", "th").join(again.select("th", "s", "e"), "th").select("first", "shard", "h", "s", "e")
            heads = heads.join(F.broadcast(hot), ["first", "shard"], "left_anti")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = heads.repartition(n, "first", "shard").sortWithinPartitions("first", "shard", "least", "h")
    matched = stored(ordered.mapInArrow(_matched(span), "first long, shard long, h string, s long, e long"), "matched")
    inner = matched if inner is None else matched.unionByName(inner)
    copies = slim.join(least, ["first", "shard", "h"]).where("doc_id > least").select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("n")).alias("e"))
    # a copy's whole stretch goes; the first document's stretch loses what its shard had before
    own = slim.join(inner, ["first", "shard", "h"]).select("doc_id", "th", (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    return copies.unionByName(own)


def _cut(text_col: str, only_cut: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 256):
            kept, n_words, n_removed, texts = [], [], [], text_of(b, text_col)
            for k in range(b.num_rows):
                words = (texts[k].as_py() or b"").split()
                spans = b.column(1)[k].as_py()
                n_words.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x in spans:
                        gone[x["s"]] += 1
                        gone[x["e"]] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
                    words = [words[i] for i in stay]
                n_removed.append(n_words[-1] - len(words))
                kept.append(None if only_cut and not n_removed[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, carry: list[str] | None = None, only_cut: bool = False) -> DataFrame:
    """The columns `carry` of each row (all, if not named) as the struct `row`, with n_words, n_removed and kept
    (the words left, joined by one space; with only_cut null where nothing was removed).

    A word goes if a window of `span` words that covers it also starts in a document with a
    smaller id; windows are judged on the input. Null texts have no words. Rows with a null id
    neither lose nor lend words; rows that repeat an id are not "smaller" than each other. Clashing
    column names do not matter: only id and text are read, the rest is carried as one struct.
    """
    spans = repeated_spans(docs, id_col, text_col, span).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    base = with_text(docs, text_col, carry, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"))
    rest = ["text"] if "text" in base.columns else []
    kept = base.join(spans.hint("shuffle_merge"), ["doc_id", "th"], "left").select("row", "spans", *rest)
    return kept.mapInArrow(_cut(text_col, only_cut), T.StructType([kept.schema["row"], *T._parse_datatype_string("n_words long, n_removed long, kept string")]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM p GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM p JOIN f USING (k) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
