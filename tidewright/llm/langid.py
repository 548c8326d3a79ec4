"""Operator 9: language identification by a byte convolutional network, trained in numpy.

Filters of widths 2, 3 and 4 run over the UTF-8 bytes of fixed-length windows, each filter's
largest value in the window goes through a rectifier to a softmax over the languages. A whole
text is cut into windows, and its probabilities are the means over its windows, weighted by
their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, small_batches, table, text_of, with_text

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 192
#: Bounds of the labelled sample: documents of a language (about), of all languages together, windows of a document.
DOCS, SAMPLE, WINDOWS = 300, 60_000, 6
EPOCHS, BATCH, RATE, SEED = 4, 128, 0.01, 11
#: A text is rejected if its mean probability lies above chance by less than this part of what is left to certainty.
REJECT = 0.03


class Network:
    """tables[w][k]: 256 x FILTERS weights of the k-th byte of filters of width w."""

    def __init__(self, labels: list[str]) -> None:
        rng = np.random.default_rng(SEED)
        self.labels = labels
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out = np.zeros(len(labels), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.dense, self.out]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the cross-entropy of windows x (n, WINDOW) with label numbers y; classes weigh alike."""
        rng = np.random.default_rng(SEED)
        count = np.bincount(y, minlength=len(self.labels))
        weight = (len(y) / np.maximum(1, count) / max(1, (count > 0).sum())).astype(np.float32)
        m, v, step = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                rows = order[at : at + BATCH]
                step += 1
                for p, g, a, b in zip(self.params(), self._gradients(x[rows], y[rows], weight), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x, y, weight):
        n, peaks, places = len(x), [], []
        for w, t in zip(WIDTHS, self.tables):
            conv = sum(t[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
            place = conv.argmax(axis=1)
            places.append(place)
            peaks.append(np.take_along_axis(conv, place[:, None], 1)[:, 0])
        pre = np.concatenate(peaks, 1) + self.bias
        hidden = np.maximum(pre, 0)
        logits = hidden @ self.dense + self.out
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[y][:, None] / n
        back = (p @ self.dense.T) * (pre > 0)
        grads = []
        for k, (w, t) in enumerate(zip(WIDTHS, self.tables)):
            g, part = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
            cols = np.broadcast_to(np.arange(FILTERS), part.shape)
            for j in range(w):
                np.add.at(g[j], (x[np.arange(n)[:, None], places[k] + j], cols), part)
            grads.append(g)
        return [*grads, back.sum(0), hidden.T @ p, p.sum(0)]

    def compiled(self) -> tuple:
        """Tables of byte pairs: a filter of width 2 or 4 costs one or two look-ups, width 3 two."""
        two, three, four = self.tables
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return pair(*two), pair(*three[:2]), three[2], pair(*four[:2]), pair(*four[2:])

    def probabilities(self, x: np.ndarray, tables: tuple) -> np.ndarray:
        two, three, tail, front, rear = tables
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        peaks = [two[pairs].max(1), (three[pairs[:, :-1]] + tail[x[:, 2:]]).max(1), (front[pairs[:, :-2]] + rear[pairs[:, 2:]]).max(1)]
        logits = np.maximum(np.concatenate(peaks, 1) + self.bias, 0) @ self.dense + self.out
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def windows(text: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last filled up with zero bytes."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def _sampled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows, 64):
        ids, langs, parts = [], [], []
        for i, t, lang in zip(*(b.column(k).to_pylist() for k in range(3))):
            w = windows(t)
            for k in sorted({round(x) for x in np.linspace(0, len(w) - 1, min(len(w), WINDOWS))} if len(w) else ()):
                ids.append(i)
                langs.append(lang)
                parts.append(w[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["doc_id", "lang", "part"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS) -> Network | None:
    """Fit on about `per_lang` documents of each language, chosen by a hash of id and text, one at least, and at most
    WINDOWS windows of each, spread over the text. Where labels are so many that the
    sample would exceed SAMPLE documents, each has fewer; of over SAMPLE labels, those of the most documents are learned. Rows with a null id count like any other, rows that
    repeat count once. None if nothing is labelled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang IS NOT NULL AND length(text) > 0").withColumn("pick", F.xxhash64("doc_id", "text"))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("pick").alias("n"), F.min("pick").alias("first")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()
    if not kinds:
        return None
    each = min(per_lang, max(1, SAMPLE // len(kinds)))
    shares = docs.sparkSession.createDataFrame([(r.lang, 1e9 * each / max(1, r.n), r.first) for r in kinds], "lang string, share double, first long")
    few = rows.join(F.broadcast(shares), "lang").where((F.pmod("pick", F.lit(10**9)) < F.col("share")) | (F.col("pick") == F.col("first")))
    once = few.groupBy("lang", "pick").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    got = once.select("pick", "text", "lang").mapInArrow(_sampled, "doc_id long, lang string, part binary").collect()
    got.sort(key=lambda r: (r.lang, r.doc_id, r.part))
    labels = sorted({r.lang for r in got})
    number = {lang: k for k, lang in enumerate(labels)}
    return Network(labels).fit(np.stack([np.frombuffer(r.part, np.uint8) for r in got]), np.array([number[r.lang] for r in got]))


def certain(score: Column, net: Network | None, least: float = REJECT) -> Column:
    """Whether a score lies above the chance of the network's labels by `least` of what is left; one label is always certain."""
    chance = 1.0 / len(net.labels) if net else 1.0
    return score >= F.lit(chance + least * (1.0 - chance))


def _predict(net: Network | None, text_col: str):
    tables = net.compiled() if net else ()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows, 512):
            texts = [t if ok and t else b"" for t, ok in zip(text_of(b, text_col).to_pylist(), b.column(1).to_pylist())]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            sizes = np.array([-(-len(t) // WINDOW) for t in texts])
            if net and sizes.sum():
                x = np.concatenate([windows(t) for t in texts if t])
                p = np.concatenate([net.probabilities(x[k : k + 96], tables) for k in range(0, len(x), 96)])
                p = p * (x != 0).sum(1)[:, None].clip(1)
                has = np.flatnonzero(sizes)
                mean = np.add.reduceat(p, np.r_[0, np.cumsum(sizes[has])[:-1]], axis=0)
                mean /= mean.sum(1, keepdims=True)
                for k, row in zip(has.tolist(), mean):
                    lang[k], score[k] = net.labels[int(row.argmax())], row.max()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of each row (all, if not named) as the struct `row`, with lang_pred and score.

    lang_pred is `und` with score 0 where the text is null or has no letter, or nothing was
    learned. Rows are predicted alone: repeated rows get the same prediction, and no column but
    the text is looked at, whatever others there are.
    """
    rows = with_text(docs, text_col, carry, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("ok"))
    return rows.mapInArrow(_predict(net, text_col), T.StructType([rows.schema["row"], *T._parse_datatype_string("lang_pred string, score double")]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(~held_out(F.col("doc_id"), 4)))
    found = identify(docs, net, carry=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id"), 4).alias("held_out"), "lang_pred", "score")
