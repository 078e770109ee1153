"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: byte 2- and 3-grams, word 1- and 2-grams (hashed), and runs of one word said three
and four times. Each indicator is scaled by the log ratio of its smoothed shares in the two classes, rows get unit length,
and a linear model with hinge loss is fitted by dual coordinate descent. Margins of held-back folds fit the
sigmoid that turns a margin into a score.

The labelled rows used are a bounded sample: SAMPLE_ROWS at most, the smallest by a hash of doc_id, as long as their n-grams take
at most SAMPLE_BYTES in all (one that would pass the bound is passed over); only n-grams, never texts, are gathered on the
driver. Scoring covers every row, in one pass without a shuffle.

Defined cases: null text counts as empty, and gets a score like any other; labels that contradict each other for
one doc_id count as 1; null labels are not learned from; without any labels of one class the score is the other's
share (0.5 without labels); repeated documents each give a row; a very long text is scored whole; an empty table gives an empty
table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, materialize, smallest_by_hash, steps, texts_of

SAMPLE_ROWS, SAMPLE_BYTES, FOLDS, EPOCHS, COST, SMOOTHING = 4000, 64 << 20, 3, 12, 1.0, 1.0
#: Documents scored below this are predicted 0.
THRESHOLD = 0.3

_BIGRAMS, _TRIGRAMS, _WORDS = 1 << 16, 1 << 16, 1 << 17
_RUNS = _BIGRAMS + _TRIGRAMS + _WORDS
SIZE = _RUNS + 2


class Grams:
    """The n-gram indicators of texts; keeps the hashes of words seen before, up to a bound."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most
        self.flags = np.zeros(SIZE, bool)

    def __call__(self, text: str) -> np.ndarray:
        """The ids of the text's n-grams, ascending."""
        raw = text.encode()
        data = np.frombuffer(raw, np.uint8).astype(np.uint32)
        words = raw.split()
        on = self.flags
        if len(data) > 1:
            on[data[:-1] << 8 | data[1:]] = True
        if len(data) > 2:
            h = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
            on[_BIGRAMS + (h >> np.uint32(16))] = True
        if words:
            known = self.known
            if len(known) > self.most:
                known.clear()
            for w in {w for w in words if w not in known}:
                known[w] = xxhash.xxh32_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
            on[_BIGRAMS + _TRIGRAMS + (h >> np.uint32(15))] = True
            if len(h) > 1:
                pair = (h[:-1] * np.uint32(2246822519) + h[1:]) * np.uint32(2654435761)
                on[_BIGRAMS + _TRIGRAMS + (pair >> np.uint32(15))] = True
                same = h[1:] == h[:-1]
                triple = same[1:] & same[:-1]
                on[_RUNS] = triple.any()
                on[_RUNS + 1] = (triple[1:] & triple[:-1]).any()
        ids = np.flatnonzero(on).astype(np.int32)
        on[ids] = False
        return ids


@dataclass
class Model:
    """score(x) = sigmoid(slope * margin + offset); the weights already hold the log ratios."""

    weights: np.ndarray
    ratios_squared: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        norm = np.sqrt(self.ratios_squared[ids].sum()) or 1.0
        return float(self.weights[ids].sum() / norm) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of the ratio of each n-gram's smoothed share in class 1 and in class 0."""
    shares = []
    for c in (1, 0):
        count = np.full(SIZE, SMOOTHING)
        for r, y in zip(rows, labels, strict=True):
            if y == c:
                count[r] += 1
        shares.append(count / count.sum())
    return np.log(shares[0] / shares[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Dual coordinate descent: the weights, the bias (the weight of a feature that is always 1) and the dual variables of
    the least |w|^2 / 2 + bias^2 / 2 + sum of cost * max(0, 1 - sign * margin)."""
    w, bias, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            r, v, y = rows[i], values[i], sign[i]
            slope = y * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - slope / (v @ v + 1), 0.0), cost[i])
            if step := (new - alpha[i]) * y:
                w[r] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias, alpha


def scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    """The values of each row's indicators: log ratios, to unit length."""
    return [ratios[r] / (np.sqrt((ratios[r] ** 2).sum()) or 1.0) for r in rows]


def fit_linear(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Hinge loss by dual coordinate descent over scaled rows of unit length; the classes have equal total cost.
    Returns the weights (times the log ratios), the squared ratios, and the bias."""
    ratios = log_ratios(rows, labels)
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, len(labels) / (2 * max(1, (labels == 1).sum())), len(labels) / (2 * max(1, (labels == 0).sum()))) * COST
    w, bias, _ = descend(rows, scaled(rows, ratios), sign, cost)
    return w * ratios, ratios**2, bias


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid, by Newton steps on smoothed targets."""
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * theta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    n1 = int((labels == 1).sum())
    if n1 in (0, len(labels)):  # nothing to tell apart
        share = n1 / len(labels) if len(labels) else 0.5
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    fold = np.zeros(len(labels), int)
    for c in (0, 1):  # each class is dealt out evenly
        at = np.flatnonzero(labels == c)
        fold[at] = np.arange(len(at)) % FOLDS
    margins, seen = np.zeros(len(labels)), np.zeros(len(labels), bool)
    for f in range(FOLDS):
        train = np.flatnonzero(fold != f)
        if len({*labels[train].tolist()}) < 2:
            continue
        w, squared, bias = fit_linear([rows[i] for i in train], labels[train])
        part = Model(w, squared, bias, 1.0, 0.0)
        for i in np.flatnonzero(fold == f):
            margins[i], seen[i] = part.margin(rows[i]), True
    slope, offset = fit_sigmoid(margins[seen], labels[seen]) if seen.any() else (1.0, 0.0)
    w, squared, bias = fit_linear(rows, labels)
    return Model(w.astype(np.float32), squared.astype(np.float32), bias, slope, offset)


def within(sizes: list[int], most: int) -> list[int]:
    """The places, in order, of the sizes that fit into so much together; one that does not is passed over."""
    out, total = [], 0
    for i, n in enumerate(sizes):
        if total + n <= most:
            out.append(i)
            total += n
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    usable = labels.where((crc_mod("doc_id", 5) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    sample = smallest_by_hash(usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")), sample_rows, "doc_id")
    # The sample is bounded, so it can be sent to every executor; repeated documents are one row.
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([grams(t).tobytes() for t in texts_of(b.column("text"))], pa.binary())], ["doc_id", "quality", "grams"])

    found = materialize(held.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "doc_id long, quality int, grams binary"), "grams")
    sizes = found.select("doc_id", F.octet_length("grams").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()  # SAMPLE_ROWS at most
    if sum(r.size for r in sizes) > sample_bytes:
        kept = {sizes[i].doc_id for i in within([r.size for r in sizes], sample_bytes)}
        found = found.where(F.col("doc_id").isin(kept))
    got = sorted(found.collect())
    return fit([np.frombuffer(r.grams, np.int32) for r in got], np.array([r.quality for r in got], int))


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs, its columns renamed c0, c1, ..., with one more, the score of its text."""
    text_at = docs.columns.index("text")
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for b in steps(batches, text_at):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([shared.value.score(grams(t)) for t in texts_of(b.column(text_at))], pa.float64())], schema.names)

    return docs.toDF(*schema.names[:-1]).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = with_scores(docs.select(F.col("doc_id").cast("long"), "text"), train(docs, labels))
    return scored.select(F.col("c0").alias("doc_id"), (crc_mod("c0", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are predicted 1."""
    return with_scores(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score").toDF(*docs.columns)
