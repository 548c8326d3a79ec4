"""Operator 7: text likelihood under a hidden Markov model trained by Baum-Welch.

Hidden states emit word classes: each of the SINGLE commonest words and the end are classes of
their own, all other words share BUCKETS classes by hash. A word of a shared class has the
probability (c + 1) / (N_b + V_b + 1) within it, from exact counts over all training documents. Every
round collects the exact expected counts of all whole training texts, partition by partition, and Spark
adds them up, until a round gains little likelihood; the model has a fixed size. Texts go in blocks whose
transfer matrices multiply to the whole text's: they give likelihoods, and the messages that blocks begin and end with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, held_out, shared_dir, small_batches, stored, table

STATES, SINGLE, BUCKETS = 6, 4096, 256
#: Words that workers know by heart, at most; all others' counts come by a join.
KNOWN = 200_000
#: Length of blocks in tokens, and tokens (with filling) of blocks that are worked on at once.
SEGMENT, CELLS = 128, 1 << 17
#: Rounds over all training text end with one that gains less than this: log10 likelihood a token.
SETTLED = 1e-3
PRIOR, SEED = 100.0, 3
END = SINGLE
CLASSES = SINGLE + 1 + BUCKETS


def bucket(word: bytes) -> int:
    return SINGLE + 1 + (xxhash.xxh64_intdigest(word, 42) & (BUCKETS - 1))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, lower-cased A-Z, and how many each text has; nulls are empty."""
    plain = pc.fill_null(texts, b"").view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words, lengths = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word
    owner = np.repeat(np.arange(len(lengths)), lengths)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real).view(pa.binary()), np.bincount(owner, minlength=len(lengths))


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows, 1024):
        seen = pc.value_counts(words_of(b.column(0))[0])
        yield pa.RecordBatch.from_arrays([seen.field("values"), seen.field("counts").cast(pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over whole texts: lower-cased A-Z, words of anything but ASCII white space."""
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """What workers need: the known words, class of each, and the Markov model's parameters."""

    def __init__(self, known: list[tuple[bytes, int]], buckets: np.ndarray, tokens: int, types: int, ends: int) -> None:
        """known: (word, count), commonest first; buckets (BUCKETS, 2): tokens and types of all words by bucket."""
        self.known = pa.array([w for w, _ in known], pa.binary())
        self.count = np.array([c for _, c in known], np.int64)
        self.tokens, self.types, self.ends = tokens, types, ends
        self.cls = np.array([k if k < SINGLE else bucket(w) for k, (w, _) in enumerate(known)], np.int32)
        rest = buckets.astype(np.int64).copy()
        for w, c in known[:SINGLE]:
            rest[bucket(w) - SINGLE - 1] -= (c, 1)
        self.within = np.log10(rest.sum(1) + 1.0)  # of the shared classes: N_b + V_b + 1
        self.inside = np.where(np.arange(len(known)) < SINGLE, 0.0, np.log10(self.count + 1.0) - self.within[np.maximum(self.cls - SINGLE - 1, 0)])
        unigram = np.r_[np.zeros(SINGLE), ends, rest[:, 0]] + 1.0
        unigram[: min(SINGLE, len(known))] += self.count[:SINGLE]
        self.unigram = unigram / unigram.sum()
        rng = np.random.default_rng(SEED)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        self.move /= self.move.sum(1, keepdims=True)
        self.emit = self.unigram * rng.uniform(0.5, 1.5, (STATES, CLASSES))
        self.emit /= self.emit.sum(1, keepdims=True)

    def classes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(classes, places of known words or -1) of words; the distinct unknown ones, and the number among these of each unknown word."""
        k = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        rare = words.filter(pa.array(k < 0)).dictionary_encode()
        number = rare.indices.to_numpy(zero_copy_only=False)
        cls = np.empty(len(k), np.int32)
        cls[k >= 0] = self.cls[k[k >= 0]]
        cls[k < 0] = np.array([bucket(w) for w in rare.dictionary.to_pylist()], np.int32)[number]
        return cls, k, rare.dictionary, number

    def rest_state(self) -> np.ndarray:
        v = self.start
        for _ in range(200):
            v = v @ self.move
        return v / v.sum()

    def expected(self, segments: list[np.ndarray], firsts: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected (start, move, emit) counts of class sequences, each by itself; one that is no first begins in the resting state."""
        flat, size = np.concatenate(segments), np.array([len(x) for x in segments])
        order = np.argsort(-size, kind="stable")
        x, active = _columns(flat, (np.cumsum(size) - size)[order], size[order])
        rest = np.repeat(self.rest_state()[:, None], len(size), 1)
        first = np.array(firsts)[order]
        start, moved, emitted, _ = self._passes(x, active, size[order], first, rest, np.ones((STATES, len(size))), False)
        return start, moved, emitted

    def expected_whole(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected (start, move, emit) counts and log10 likelihood of whole texts, whose classes stand in `flat` one after another.

        Blocks are passed apart, from the exact messages of what lies before and after them; transitions into a block count with it."""
        at, size, first, last, wave = _blocks(lengths)
        n = len(at)
        before, after = np.full((STATES, n), 1 / STATES), np.ones((STATES, n))
        cut = np.flatnonzero(~(first & last))
        if len(cut):
            through, _ = self._transfers(flat, at, size, first, cut)
            rounds = [cut[wave[cut] == w] for w in range(int(wave.max()) + 1)]
            for k in rounds:
                k = k[~last[k]]
                v = np.einsum("in,jin->jn", np.where(first[k], self.start[:, None], before[:, k]), through[:, :, k])
                before[:, k + 1] = v / v.sum(0)
            for k in rounds[:0:-1]:
                u = np.einsum("jn,jin->in", after[:, k], through[:, :, k])
                after[:, k - 1] = u / u.max(0)
        total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES)), 0.0]
        for k in _groups(size, np.arange(n)):
            x, active = _columns(flat, at[k], size[k])
            total = [a + b for a, b in zip(total, self._passes(x, active, size[k], first[k], before[:, k], after[:, k], True))]
        return tuple(total)

    def _passes(self, x: np.ndarray, active: np.ndarray, size: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray, follows: bool) -> tuple:
        """Scaled forward and backward passes over columns of x, longest first. `before`: of columns that are no first, the state at
        the token before them if `follows`, else at their own first token. `after`: how likely what comes next is, in any scale."""
        (most, n), move, forth = x.shape, self.move, np.ascontiguousarray(self.move.T)
        alpha, seen, scale = np.empty((most, STATES, n)), np.empty((most, STATES, n)), np.ones((most, n))
        for t in range(most):
            m = active[t]
            e = np.take(self.emit, x[t, :m], axis=1)
            a = forth @ alpha[t - 1, :, :m] if t else np.where(first, self.start[:, None], forth @ before if follows else before)
            a *= e
            s = a.sum(0)
            alpha[t, :, :m], seen[t, :, :m], scale[t, :m] = a / s, e / s, s
        beta = after / (alpha[size - 1, :, np.arange(n)].T * after).sum(0)
        moved = np.zeros((STATES, STATES))
        for t in range(most - 1, -1, -1):
            m = active[t]
            later = seen[t, :, :m] * beta[:, :m]
            alpha[t, :, :m] *= beta[:, :m]
            if t:
                moved += alpha[t - 1, :, :m] @ later.T
                beta[:, :m] = move @ later
            elif follows:
                moved += before[:, ~first] @ later[:, ~first].T
        live = np.arange(n)[None] < active[:, None]
        c = x[live]
        emitted = np.stack([np.bincount(c, alpha[:, s][live], CLASSES) for s in range(STATES)])
        return alpha[0][:, first].sum(1), moved * move, emitted, float(np.log10(scale).sum())

    def _transfers(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(to, from, block) and the log10 of their scale: what leads from the state before a block (a first one: at its first token) to its end."""
        out, logs = np.empty((STATES, STATES, len(at))), np.zeros(len(at))
        forth = np.ascontiguousarray(self.move.T)
        for k in _groups(size, which):
            x, active = _columns(flat, at[k], size[k])
            done, log = np.empty((STATES, STATES, len(k))), np.zeros(len(k))
            step = np.where(first[k], np.eye(STATES)[:, :, None], forth[:, :, None]) * self.emit[:, None, x[0]]
            for t in range(1, len(x)):
                m = active[t]
                if m < step.shape[2]:
                    done[:, :, m : step.shape[2]] = step[:, :, m:]
                    step = np.ascontiguousarray(step[:, :, :m])
                step = (forth @ step.reshape(STATES, -1)).reshape(STATES, STATES, m)
                step *= np.take(self.emit, x[t, :m], axis=1)[:, None, :]
                if t % 8 == 0:
                    s = step.max((0, 1))
                    step /= s
                    log[:m] += np.log10(s)
            done[:, :, : step.shape[2]] = step
            out[:, :, k], logs[k] = done, log
        return out, logs

    def update(self, start: np.ndarray, moved: np.ndarray, emitted: np.ndarray) -> None:
        self.start = (start + 1 / STATES) / (start.sum() + 1)
        self.move = (moved + 1 / STATES) / (moved.sum(1, keepdims=True) + 1)
        self.emit = (emitted + PRIOR * self.unigram) / (emitted.sum(1, keepdims=True) + PRIOR)

    def likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities of whole class sequences (each of one class at least)."""
        return self.likelihoods_whole(np.concatenate(sequences), np.array([len(s) for s in sequences]))

    def likelihoods_whole(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at, size, first, last, wave = _blocks(lengths)
        through, logs = self._transfers(flat, at, size, first, np.arange(len(at)))
        of = np.cumsum(first) - 1
        out, v = np.zeros(len(lengths)), np.repeat(self.start[:, None], len(lengths), 1)
        for w in range(int(wave.max(initial=-1)) + 1):
            k = np.flatnonzero(wave == w) if w else np.flatnonzero(first)
            d = of[k]
            u = np.einsum("in,jin->jn", v[:, d], through[:, :, k])
            s = u.sum(0)
            v[:, d] = u / s
            out[d] += np.log10(s) + logs[k]
        return out


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, size, is first, is last, place in its text) of the blocks of texts that stand one after another."""
    number = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), number)
    wave = np.arange(len(doc)) - (np.cumsum(number) - number)[doc]
    begin = (np.cumsum(lengths) - lengths)[doc] + wave * SEGMENT
    return begin, np.minimum(SEGMENT, lengths[doc] - wave * SEGMENT), wave == 0, wave == number[doc] - 1, wave


def _groups(size: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks that are worked on at once, longest first."""
    order = which[np.argsort(-size[which], kind="stable")]
    for lo in range(0, len(order), CELLS // SEGMENT):
        yield order[lo : lo + CELLS // SEGMENT]


def _columns(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat as columns, longest first, and how many are longer than each row's number."""
    t = np.arange(int(size[0]))
    return flat[np.minimum(at + t[:, None], len(flat) - 1)], np.searchsorted(-size, -t, "left")


def with_ends(cls: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of texts with n words each, and an end after each text; their lengths."""
    out = np.full(len(cls) + len(n), END, np.int32)
    out[np.arange(len(cls)) + np.repeat(np.arange(len(n)), n)] = cls
    return out, n + 1


def _coding(model: Model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 1024):
            words, n = words_of(b.column(0))
            flat, lengths = with_ends(model.classes(words)[0], n)
            cuts = np.split(flat.astype("<i2"), np.cumsum(lengths)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in cuts], pa.binary())], ["classes"])

    return run


def _expecting(model: Model):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches(rows, 1024):
            lengths = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            if len(lengths):
                got = model.expected_whole(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i2"), lengths)
                flat = np.concatenate([np.ravel(g) for g in got])
                total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])

    return run


def train(docs: DataFrame, text_col: str = "text", settled: float = SETTLED) -> tuple[Model, DataFrame]:
    """The model, and the stored counts (word, c) of all training words, however many."""
    text = docs.select(F.col(text_col).cast("binary").alias("text"))
    shared_dir(docs.sparkSession)
    small_batches(docs.sparkSession)
    counts = stored(word_counts(docs, text_col), "word-counts")
    level = F.floor(F.log("c") * 16).cast("int")
    ends, sizes = docs.count(), counts.agg(F.sum("c"), F.count("*")).first()
    histogram = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    floor, n = histogram[0][0] + 1 if histogram else 0, 0
    for lv, k in histogram:  # whole levels while they fit
        if n + k > KNOWN:
            break
        floor, n = lv, n + k
    known = sorted(((bytes(r.word), r.c) for r in counts.where(level >= floor).collect()), key=lambda x: (-x[1], x[0]))
    shared = np.zeros((BUCKETS, 2))
    for r in counts.groupBy(F.expr(f"cast(xxhash64(word) & {BUCKETS - 1} as int)").alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        shared[r.b] = r.c, r.v
    model = Model(known, shared, (sizes[0] or 0) + ends, sizes[1] + (ends > 0), ends)
    if not ends:
        return model, counts
    coded, before = stored(text.mapInArrow(_coding(model), "classes binary"), "classes"), -math.inf
    while True:
        cells = coded.mapInArrow(_expecting(model), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
        flat = np.zeros(STATES + STATES**2 + STATES * CLASSES + 1)
        for r in cells.collect():  # as many as the model has parameters
            flat[r.cell] = r.n
        model.update(flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 : -1].reshape(STATES, CLASSES))
        reached = flat[-1] / model.tokens
        if not reached - before >= settled:
            return model, counts
        before = reached


def _scoring(model: Model):
    rate = math.log10(model.tokens + model.types + 1)
    known = np.log10(model.count + 1.0)
    end = math.log10(model.ends + 1)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 1024):
            words, n = words_of(b.column(1))
            cls, k, unknown, number = model.classes(words)
            owner = np.repeat(np.arange(len(n)), n)
            flat, lengths = with_ends(cls, n)
            hit, rare = k >= 0, k < 0
            add = lambda which, values: np.bincount(owner[which], values, len(n))
            base = add(hit, known[k[hit]]) + end - rate * lengths
            extra = add(hit, model.inside[k[hit]]) - add(rare, model.within[cls[rare] - SINGLE - 1])
            n_known = np.bincount(owner[hit], minlength=len(n)) + (model.ends > 0)
            score = model.likelihoods_whole(flat, lengths) + extra
            pair, times = np.unique(owner[rare] * max(1, len(unknown)) + number, return_counts=True)
            of, word = np.divmod(pair, max(1, len(unknown)))
            entries = pa.StructArray.from_arrays([unknown.take(pa.array(word, pa.int64())), pa.array(times, pa.int64())], ["word", "n"])
            asked = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(n) + 1)), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score), asked], ["row", "n_tokens", "n_known", "base", "score", "rare"])

    return run


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row's whole text.

    Tokens are the lower-cased words and one end; null and empty texts have the end alone. Words
    outside the known ones get their counts by a join, so that all counts are exact whatever the
    vocabulary. Rows that repeat are scored each; rows with a null id or text count as well.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th")).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = stored(rows.mapInArrow(_scoring(model), f"row {kind}, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"), "scored")
    flat = scored.select("row.doc_id", "row.th", "n_tokens", "n_known", "base", "score", "rare")
    asked = flat.where(F.size("rare") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("rare").alias("r")).select("doc_id", "th", "r.word", "r.n")
    met = asked.join(counts.hint("shuffle_merge"), "word").groupBy("doc_id", "th").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("found"))
    slim = flat.drop("rare")
    same = slim["doc_id"].eqNullSafe(met["doc_id"]) & (slim["th"] == met["th"])
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return slim.join(met, same, "left").select(slim["doc_id"], "n_tokens", (F.col("n_known") + found).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out: Column = held_out(F.col("doc_id"), 7)
    model, counts = train(docs.where(~out))
    found = score_texts(docs, model, counts)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
