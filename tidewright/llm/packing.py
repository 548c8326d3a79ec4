"""Operator 10: best-fit packing with certified bounds.

Partitions of bounded size pack their pieces by best-fit decreasing and hold the number of
their sequences against lower bounds from dual-feasible functions. If all together meet the
bound of the whole, nothing can be better and the packing is done. Otherwise partitions with a
gap (more sequences than their ids would fill) give up their least filled sequences, more of
them the further they are above their own bound, and the others pass on their remainder only;
what is given up is exchanged over fewer partitions and packed again, until one partition has
taken the last of it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, small_batches, stored, table
from .tokens import tokenizer

SEQUENCE, PARTITION = 2048, 40_000
#: Share of its sequences that a partition with a gap gives up each round, besides those above its bound.
SHARE = 0.1
#: Words whose ids a worker remembers, through all its tasks.
WORDS = 1_000_000
#: Marks after an ASCII letter at a word's end are a pre-token of their own, so they count as a word.
_TAIL = re.compile(rb"(?<=[A-Za-z])([.,!?;:]+)(?=\s|\Z)")

#: Normalizer and pre-tokenizer (fixed values of the vocabulary file) for which words_of is proven; texts for others are encoded whole.
PROVEN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}

PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def by_words(tok) -> bool:
    """Whether a text's ids are those of `words_of` it: nothing joins over white space, A-Z are lower-cased,
    runs of letters and of marks are pre-tokens of their own, and special tokens begin with '<|' and match as they
    stand: they take no white space beside them and do not ask for whole words."""
    said = json.loads(tok.to_str())
    first = ((said["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": PROVEN["pattern"]} and first.get("behavior") == "Removed" and first.get("invert") is True
    special = all(t["content"].startswith("<|") and not any(t[how] for how in ("normalized", "lstrip", "rstrip", "single_word")) for t in said["added_tokens"])
    return split and said["normalizer"] == PROVEN["normalizer"] and special


def word_lists(texts: pa.Array) -> pa.ListArray:
    """The words of `words_of` for an array of strings, by Arrow's kernels; empty strings may stand among them."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    marked = pc.match_substring(texts, "<|")
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"([a-z])([.,!?;:]+)([\x09-\x0D ]|\z)", replacement=r"\1 \2\3")
    if pc.any(marked).as_py():
        special = [b" ".join(words_of(t.as_py().encode())).decode() for t in texts.filter(marked)]
        plain = pc.replace_with_mask(plain, marked, pa.array(special, pa.string()))
    return pc.ascii_split_whitespace(plain)


def words_of(text: bytes) -> list[bytes]:
    """Pieces of a text whose ids do not depend on their neighbours. A-Z are lower-cased, as the vocabulary has it,
    but not in words with '<|': special tokens are matched as written, before the library lower-cases."""
    if b"<|" not in text:
        return _TAIL.sub(rb" \1", text.lower()).split()
    return [w if b"<|" in w else w.lower() for w in _TAIL.sub(rb" \1", text).split()]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class WordIds:
    """Token ids word by word, for a tokenizer whose pre-tokens never hold white space: a text's
    ids are those of its words in turn. Each word is encoded once by the library."""

    def __init__(self, path: str) -> None:
        self.tok, self.place = tokenizer(path), {}
        self.apart = by_words(self.tok)
        self.clear()

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, and the closing 0."""
        if not self.apart:
            for t in texts:
                yield np.array([*self.tok.encode(t.as_py() or "", add_special_tokens=False).ids, 0], np.uint32)
            return
        lists = word_lists(texts)
        coded = lists.flatten().dictionary_encode()
        number = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        size = self.size[number]
        ends = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(self.start[number] - ends[:-1], size) + np.arange(ends[-1])]
        at = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.append(ids[s:e], np.uint32(0))

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The ids of words in turn, and the closing 0."""
        number = self.learn(words)
        return np.concatenate([*(self.ids[a : a + n] for a, n in zip(self.start[number], self.size[number])), np.zeros(1, np.uint32)])

    def clear(self) -> None:
        self.place.clear()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, words: Iterable[str | bytes]) -> np.ndarray:
        """The numbers of words, those of new ones after they were encoded."""
        place, words = self.place, [w.decode() if isinstance(w, bytes) else w for w in words]
        new = list(dict.fromkeys(w for w in words if w not in place))
        if len(place) + len(new) > WORDS and place:
            self.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                ids, k = e.ids, len(place)
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                if k >= len(self.start):
                    self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
                self.ids[self.used : self.used + len(ids)] = ids
                place[w], self.start[k], self.size[k] = k, self.used, len(ids)
                self.used += len(ids)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

def _cut(path: str, most: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for b in batches(rows, 1024):
            out: list[list] = [[] for _ in range(5)]
            for i, ids in zip(b.column(0).to_pylist(), known.texts(b.column(1))):
                ids = ids.astype("<u4", copy=False)
                for piece, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    for col, v in zip(out, (i, piece, at, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            kinds = (b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str, most: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, then 0, cut into pieces of at most `most` ids. A null text is empty: one piece with the 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(_cut(vocabulary, most), PIECE.format(id=kind))


def best_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (sequence, offset) of each length. Linear in the items: open
    sequences are kept by the room that they have left, and those rooms as bits of one number."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    bits, made = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = bits >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            room, b, made = most, made, made + 1
        where[i], offset[i] = b, most - room
        if left := room - n:
            rooms[left].append(b)
            bits |= 1 << left
    return where, offset


def bound(histogram: np.ndarray, most: int) -> int:
    """A number of sequences below which nothing can pack: the largest over two families of
    dual-feasible functions. histogram[n]: pieces of length n. Whole-number arithmetic."""
    x = np.arange(len(histogram), dtype=object)
    h = histogram.astype(object)
    total = int((x * h).sum())
    best = -(-total // most)
    n = np.arange(len(histogram))
    weight, count = np.cumsum(histogram * n), np.cumsum(histogram)
    for small in range(1, most // 2 + 1):  # 1 above most - small, nothing below small, else its share
        big = int(count[-1] - count[most - small])
        middle = int(weight[most - small] - weight[small - 1])
        best = max(best, big + -(-middle // most))
    for k in range(1, 51):  # steps of 1 / k, but exact multiples keep their share
        steps, rest = np.divmod((k + 1) * n, most)
        value = int((np.where(rest == 0, n * k, steps * most) * histogram).sum())
        best = max(best, -(-value // (k * most)))
    return best


def _packed(most: int, turn: int, last: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in rows if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        lengths = t.column("length").to_numpy()
        where, offset = best_fit(lengths, most)
        n = int(where.max()) + 1
        least = bound(np.bincount(lengths, minlength=most + 1), most)
        free = np.zeros(n, bool)
        if not last:
            fill = np.bincount(where, lengths, minlength=n)
            given = 1 + (n - least) + int(SHARE * n) if n * most - int(lengths.sum()) >= most else 1
            free[np.argsort(fill, kind="stable")[: min(n, given)]] = True
        number = (turn << 50) + (TaskContext.get().partitionId() << 25) + where
        out = t.append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))
        for name, value in (("made", n), ("bound", least)):
            out = out.append_column(name, pa.array(np.full(len(lengths), value, np.int64)))
        out = out.append_column("open", pa.array(free[where]))
        yield from out.to_batches(max_chunksize=8192)

    return run


def pack(cut: DataFrame, most: int = SEQUENCE, partition: int = PARTITION) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, and the certificate of the
    partition that packed them last: the sequences that it made, and the bound below which it could not.

    Every piece lies in one sequence, gapless from 0, in sequences of at most `most` ids. Ties
    go by id, piece and checksum; equal rows are packed each. Partitions hold about `partition`
    pieces, whatever the input. What a round passes on falls off by SHARE, so that the twelfth has next to
    nothing left to pass on and keeps it. No pieces give no rows.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    left, done, turn = stored(cut, "pieces"), [], 0
    least, made = _bound_of(left, most), 0
    while True:
        n = left.count()
        if not n and done:
            break
        parts = max(1, -(-n // partition))
        last = parts == 1 or turn >= 12
        # what one partition holds at most needs no exchange; rows that repeat, or have no id, are dealt by their place in the stored table
        salted = left.withColumn("_row", F.monotonically_increasing_id())
        dealt = left.coalesce(1) if parts == 1 else salted.repartition(parts, F.xxhash64("doc_id", "piece", "length", "ids_crc32", "_row", F.lit(turn))).drop("_row")
        packed = stored(dealt.mapInArrow(_packed(most, turn, last), f"{schema}, sequence_id long, offset long, made long, bound long, open boolean"), f"packed-{turn}")
        # a sequence begins at offset 0 and is open or closed as a whole
        count = dict(packed.where("offset = 0").groupBy("open").count().collect())
        if last or made + sum(count.values()) <= least:
            done.append(packed.drop("open"))
            break
        done.append(packed.where("NOT open").drop("open"))
        made += count.get(False, 0)
        left, turn = packed.where("open").select(*cut.columns), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _bound_of(pieces: DataFrame, most: int) -> int:
    """The lower bound of all pieces, from the histogram of at most `most` lengths."""
    histogram = np.zeros(most + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        histogram[r[0]] = r[1]
    return bound(histogram, most)


def certificate(packed: DataFrame, most: int = SEQUENCE) -> tuple[int, int]:
    """(sequences, lower bound) of a whole packing."""
    return packed.where("offset = 0").count(), _bound_of(packed, most)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary))
