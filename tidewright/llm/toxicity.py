"""Operator 4: toxicity by a subsequence string-kernel support vector machine.

The kernel of two strings sums, over all common subsequences of ORDER characters, DECAY to the
power of the stretch that they span in both (gaps and inserted characters weaken a match but
do not break it). Units are WIDTH-character windows of a sentence's words, between a mark for the
word's start and one for its end; words are stripped of anything but letters and digits, and
runs of spelled-out pieces are joined to words. Nyström landmarks map a unit to K(unit, landmarks)
K(landmarks, landmarks)^-1/2, where a linear support vector machine is trained: sentences carry
their document's label, and of a toxic document's sentences only the unit that the present
machine finds most toxic counts as its witness. A text scores as its most toxic unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, held_out, shared_dir, stored, table, text_of, with_text

ORDER, DECAY = 3, 0.6
WIDTH = 6
#: Bounds of the labelled sample and of the model: documents of a label (about), landmarks, clean units.
DOCS, LANDMARKS, CLEAN = 2500, 64, 8000
ROUNDS, EPOCHS, RATE, PENALTY, SEED = 3, 40, 0.5, 1e-4, 5
THRESHOLD = 0.3
#: Least likelihood ratio of a unit that may be a landmark or a first witness; half the best unit's where that is less.
SURE = 30.0
CACHE = 400_000

_DROP = re.compile(r"[\W_]+")


def words_of(text: str) -> set[str]:
    """Distinct words of a whole text, lower-cased, without anything but letters and digits; runs of
    more than two words of at most two characters also make one word together."""
    out, run = set(), []
    for x in text.lower().split():
        w = x if x.isalnum() else _DROP.sub("", x)
        if not w:
            continue
        out.add(w)
        if len(w) > 2:
            if len(run) > 2:
                out.add("".join(run))
            run = []
        else:
            run.append(w)
    if len(run) > 2:
        out.add("".join(run))
    return out


def units_of(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + WIDTH] for k in range(max(1, len(marked) - WIDTH + 1))]


def units(text: str) -> set[str]:
    """Distinct units of a whole text."""
    return {u for w in words_of(text) for u in units_of(w)}


def coded(words: list[str]) -> np.ndarray:
    """Code points, (n, LONGEST), filled up with -1."""
    out = np.full((len(words), max(map(len, words), default=1)), -1, np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Subsequence kernel of each row of a (n, s) with each row of b (m, t), without normalisation.

    The usual dynamic programme over prefixes, for all pairs of rows at once."""
    n, s, m, t = len(a), a.shape[1], len(b), b.shape[1]
    same = [[(a[:, i, None] == b[None, :, j]) & (a[:, i, None] >= 0) for j in range(t)] for i in range(s)]
    shape = (n, m)
    # inner[i][j]: subsequences in the first i and j characters, weighed up to the ends of both
    inner = [[np.ones(shape, np.float32)] * (t + 1) for _ in range(s + 1)]
    for _ in range(order - 1):
        nxt = [[np.zeros(shape, np.float32)] * (t + 1) for _ in range(s + 1)]
        for i in range(1, s + 1):
            row = np.zeros(shape, np.float32)
            for j in range(1, t + 1):
                row = decay * row + np.where(same[i - 1][j - 1], decay * decay * inner[i - 1][j - 1], 0)
                nxt[i][j] = decay * nxt[i - 1][j] + row
        inner = nxt
    total = np.zeros(shape, np.float32)
    for i in range(s):
        for j in range(t):
            total += np.where(same[i][j], decay * decay * inner[i][j], 0)
    return total


def own_kernel(a: np.ndarray) -> np.ndarray:
    """Each row's kernel with itself."""
    s = a.shape[1]
    same = [[(a[:, i] == a[:, j]) & (a[:, i] >= 0) for j in range(s)] for i in range(s)]
    inner = [[np.ones(len(a), np.float32)] * (s + 1) for _ in range(s + 1)]
    for _ in range(ORDER - 1):
        nxt = [[np.zeros(len(a), np.float32)] * (s + 1) for _ in range(s + 1)]
        for i in range(1, s + 1):
            row = np.zeros(len(a), np.float32)
            for j in range(1, s + 1):
                row = DECAY * row + np.where(same[i - 1][j - 1], DECAY**2 * inner[i - 1][j - 1], 0)
                nxt[i][j] = DECAY * nxt[i - 1][j] + row
        inner = nxt
    return sum(np.where(same[i][j], DECAY**2 * inner[i][j], 0) for i in range(s) for j in range(s))


def normalised(words: list[str], marks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Cosine-normalised kernel of words with landmarks; grouped by length to keep the tables small."""
    out = np.zeros((len(words), len(marks)), np.float32)
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            x = coded([words[k] for k in part])
            out[part] = kernel(x, marks) / np.sqrt(np.maximum(own_kernel(x)[:, None] * own[None], 1e-20))
    return out


class Machine:
    """Landmarks, and weights that already hold the Nyström map: f(u) = K(u, landmarks) @ weights + bias.

    To score, the sum over landmarks is folded into one table with a weight for every
    subsequence of ORDER characters: the same value, whatever the number of landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.marks = coded(landmarks)
        self.own = own_kernel(self.marks)
        values, vectors = np.linalg.eigh(normalised(landmarks, self.marks, self.own).astype(float))
        keep = values > 1e-6 * values.max()
        self.map = vectors[:, keep] / np.sqrt(values[keep])
        self.weights, self.bias, self.slope, self.shift = np.zeros(len(landmarks)), 0.0, 1.0, 0.0

    def train(self, k: np.ndarray, y: np.ndarray) -> None:
        """Linear machine with squared hinge loss on Nyström features, full gradient with momentum; classes weigh alike."""
        x, sign = k @ self.map, np.where(y > 0, 1.0, -1.0)
        cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
        w, b, mw, mb = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
        for _ in range(EPOCHS * 10):
            slack = np.maximum(0, 1 - sign * (x @ w + b))
            g = -2 * cost * slack * sign
            mw, mb = 0.9 * mw + (x.T @ g + PENALTY * w), 0.9 * mb + g.sum()
            w, b = w - RATE * mw, b - RATE * mb
        self.weights, self.bias = self.map @ w, b

        self.letters = np.unique(self.marks[self.marks >= 0])
        base = len(self.letters) + 1
        self.folded = np.zeros(base**ORDER, np.float32)
        for word, own, weight in zip(self.landmarks, self.own, self.weights):
            code = self._code(coded([word]))[0]
            for at in combinations(range(len(word)), ORDER):
                self.folded[sum(int(code[i]) * base**p for p, i in enumerate(at))] += weight / np.sqrt(own) * DECAY ** (at[-1] - at[0] + 1)

    def _code(self, points: np.ndarray) -> np.ndarray:
        """Places of characters in the landmarks' alphabet from 1; 0 for those that no landmark has."""
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[place] == points, place + 1, 0)

    def decide(self, words: list[str]) -> np.ndarray:
        out, lengths = np.zeros(len(words)), np.array([len(w) for w in words], np.int64)
        base = len(self.letters) + 1
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                points = coded([words[k] for k in part])
                code = np.ascontiguousarray(self._code(points).T)
                scaled = [code * base**p for p in range(ORDER)]
                total = np.zeros(len(part), np.float32)
                for at_ in combinations(range(n), ORDER):
                    total += self.folded[sum(scaled[p][i] for p, i in enumerate(at_))] * np.float32(DECAY ** (at_[-1] - at_[0] + 1))
                out[part] = total / np.sqrt(np.maximum(own_kernel(points), 1e-20)) + self.bias
        return out


def _units(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows, 256):
        bags = [sorted(units(t or "")) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.string()))], ["doc_id", "toxic", "units"])


def _bests(value):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            bags = b.column(2).to_pylist()
            pieces = sorted({u for bag in bags for u in bag})
            f = dict(zip(pieces, value(pieces)))
            top = [max(((float(f[u]), u) for u in bag), default=(-2.0, "")) for bag in bags]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([u for _, u in top], pa.string()), pa.array([v for v, _ in top], pa.float64())], ["toxic", "unit", "value"])

    return run


def _best(bags: DataFrame, value, floor: float) -> list:
    """Each document's unit of the highest value, where that is `floor` at least; ordered."""
    got = bags.mapInArrow(_bests(value), "toxic int, unit string, value double").where(F.col("value") >= floor).select("unit").collect()
    return sorted(got, key=lambda r: r.unit)


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS) -> Machine | None:
    """Learn from about `per_label` documents of each label, chosen by a hash of the id. None
    without both labels, or if no unit is commoner in toxic documents. Rows with null ids or labels are left out; ids labelled both ways count as toxic."""
    shared_dir(docs.sparkSession)
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    apart = marked.where(~held_out(F.col("doc_id"), 4))
    counts = dict(apart.groupBy("toxic").count().collect())
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / max(1, counts.get(1, 0)))).otherwise(min(1.0, per_label / max(1, counts.get(0, 0))))
    chosen_ids = apart.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) < share * 1e9).orderBy("doc_id").limit(4 * per_label)
    # few ids go to the texts, not the texts to the labels
    few = docs.select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id")
    bags = stored(few.select("doc_id", "toxic", "text").mapInArrow(_units, "doc_id long, toxic int, units array<string>"), "bags")
    seen = bags.select("doc_id", "toxic", F.explode("units").alias("unit"))
    stats = stored(seen.groupBy("unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")), "units")
    size = dict(bags.groupBy("toxic").count().collect())
    share_bad = size.get(1, 0) / max(1, sum(size.values()))
    n = F.col("bad") + F.col("good")
    # likelihood ratio of the labels of the documents that have the unit, against their usual proportion
    ratio = F.col("bad") * F.log(F.col("bad") / (n * share_bad)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (n * (1 - share_bad) + 1e-9))).otherwise(0)
    marked_units = stats.where("bad >= 1").select("unit", "bad", "good", F.when(F.col("bad") > n * share_bad, 2 * ratio).otherwise(0.0).alias("g"))
    best = marked_units.agg(F.max("g")).first()[0] or 0.0
    sure_from = min(SURE, best / 2)
    toxic = marked_units.where((F.col("g") >= sure_from) & (F.col("g") > 0)).orderBy(F.desc("g"), "unit").limit(4 * LANDMARKS).collect()
    clean = stats.where("good >= 1").orderBy(F.xxhash64("unit"), "unit").limit(CLEAN).collect()
    common = stats.where("good >= 1").orderBy(F.desc("good"), "unit").limit(CLEAN // 4).collect()
    mixed = marked_units.where((F.col("good") >= 1) & (F.col("g") < max(sure_from, 1e-9))).orderBy(F.desc("good"), "unit").limit(CLEAN).collect()
    if len(size) < 2 or not toxic:
        return None
    half = LANDMARKS * 3 // 4
    # of look-alike toxic units only some become landmarks: each next one is the least like those before
    pool = [r.unit for r in toxic]
    like = normalised(pool, coded(pool), own_kernel(coded(pool)))
    near, chosen = np.zeros(len(pool)), []
    for _ in range(min(half, len(pool))):
        k = int(np.argmax(np.where(near > 0.98, -1, np.log1p([r.g for r in toxic]) * (1 - near))))
        chosen.append(k)
        near = np.maximum(near, like[k])
    machine = Machine([pool[k] for k in chosen] + [r.unit for r in common[: LANDMARKS - len(chosen)]])
    sure = {r.unit: r.g for r in toxic}
    negative = sorted({r.unit for r in [*clean, *common, *mixed]} - sure.keys())
    k_neg = normalised(negative, machine.marks, machine.own)
    found = _best(bags.where("toxic = 1"), lambda pieces: [sure.get(u, 0.0) for u in pieces], 1e-9)
    for _ in range(ROUNDS):
        k_pos = normalised([r.unit for r in found], machine.marks, machine.own)
        machine.train(np.concatenate([k_pos, k_neg]), np.r_[np.ones(len(k_pos)), np.zeros(len(negative))])
        found = _best(bags.where("toxic = 1"), machine.decide, 0.0)
    every = bags.mapInArrow(_bests(machine.decide), "toxic int, unit string, value double").select("toxic", "value").collect()
    up, down = (np.sort([r.value for r in every if r.toxic == k]) for k in (1, 0))
    _calibrate(machine, up, down, counts)
    return machine


def _calibrate(machine: Machine, up: np.ndarray, down: np.ndarray, counts: dict) -> None:
    """Platt's logistic curve from machine values to probabilities, at the labels' own proportions."""
    x = np.r_[up, down]
    y = np.r_[np.full(len(up), (len(up) + 1) / (len(up) + 2)), np.full(len(down), 1 / (len(down) + 2))]
    w = np.r_[np.full(len(up), counts.get(1, 1) / max(1, len(up))), np.full(len(down), counts.get(0, 1) / max(1, len(down)))]
    a, b, w = 1.0, 0.0, w / w.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * x).sum() + 1e-6 * a, g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    machine.slope, machine.shift = a, b


def _scored(machine: Machine | None, text_col: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in batches(rows, 256):
            best = np.full(b.num_rows, -2.0)
            if machine is not None:
                bags = [words_of(t or "") for t in text_of(b, text_col, pa.string()).to_pylist()]
                new = set().union(*bags)
                if len(known) + len(new) > CACHE:
                    known.clear()
                new = sorted(new.difference(known))
                cut = [units_of(w) for w in new]
                pieces = sorted({u for us in cut for u in us})
                value = dict(zip(pieces, machine.decide(pieces).tolist()))
                known.update((w, max(map(value.__getitem__, us))) for w, us in zip(new, cut))
                get = known.__getitem__
                best = np.array([max(map(get, bag), default=-2.0) for bag in bags])
                score = 1 / (1 + np.exp(-np.clip(machine.slope * best + machine.shift, -30, 30)))
            else:
                score = np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(best)], ["row", "score", "f"])

    return run


def score_toxicity(docs: DataFrame, machine: Machine | None, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of each row (all, if not named) as the struct `row`, with score (0 to 1) and f, the machine's value.

    Null, empty and unit-less texts have the value of nothing toxic; without a machine (no
    labels) every score is 0. A row's score depends on its text alone.
    """
    rows = with_text(docs, text_col, carry)
    return rows.mapInArrow(_scored(machine, text_col), T.StructType([rows.schema["row"], *T._parse_datatype_string("score double, f double")]))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    apart = held_out(F.col("doc_id"), 4)
    machine = train(docs.where(~apart), labels)
    found = score_toxicity(docs, machine, carry=["doc_id"])
    score = F.col("score")
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id"), 4).alias("held_out"), "score", F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
