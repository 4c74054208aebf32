"""Quality scores by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words.  Each passage is encoded - shares of
character classes, repetition, word lengths, then a learned tanh layer - and a gated
attention network, trained from the document's label alone, weighs the passages.  The
weighted representation is scored by a logistic unit.  Training is full-batch Adam on the
driver over a bounded number of labelled documents and of passages of each, and ends when
the loss is flat; scoring is one pass over all passages of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, session
from .labelled import training_rows

PASSAGE = 64
#: Labelled documents to learn from, and passages of each, evenly spaced, at most.
TRAINING_ROWS, TRAINING_PASSAGES = 6_000, 64
HIDDEN, GATE, STEPS, RATE, DECAY = 24, 12, 400, 0.02, 1e-4
#: Training ends when so many steps have lowered the loss by less than this share.
PATIENCE, FLAT = 25, 1e-3
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"#$%&*", b"\"'()[]{}<>", b"@/\\_-+=~^`", bytes(range(128, 256)))
_CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _k, _chars in enumerate(CLASSES):
    _CLASS_OF[list(_chars)] = _k
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES + 6


def passage_features(text: str) -> np.ndarray:
    """passages x features of one text; an empty text is one empty passage."""
    words = text.encode().split()
    parts = [words[k : k + PASSAGE] for k in range(0, len(words), PASSAGE)] or [[]]
    out = np.zeros((len(parts), N_FEATURES))
    for row, part in zip(out, parts, strict=True):
        joined = b" ".join(part)
        size, n = max(1, len(joined)), max(1, len(part))
        row[:N_CLASSES] = np.bincount(_CLASS_OF[np.frombuffer(joined, np.uint8)], minlength=N_CLASSES) / size
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        row[N_CLASSES:] = (
            np.log1p(len(part)), len(set(part)) / n, lengths.sum() / n / 10, (lengths.std() if len(part) else 0.0) / 10,
            sum(a == b for a, b in zip(part, part[1:], strict=False)) / n, np.log1p(len(words)))
    return out


def spaced(n: int, most: int = TRAINING_PASSAGES) -> np.ndarray:
    """At most so many places, evenly spaced from the first on."""
    return np.arange(n) if n <= most else np.arange(most) * n // most


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    #: A constant score where there is nothing to learn from.
    constant: float | None = None

    def attention(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        h = np.tanh((x - self.mean) / self.scale @ w["enc"] + w["enc0"])
        v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (v * u) @ w["a"]
        bag = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(x))))
        e = np.exp(s - np.maximum.reduceat(s, begins)[bag])
        return h, v, u, e / np.add.reduceat(e, begins)[bag], bag

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        begins = np.cumsum([0] + [len(b) for b in bags[:-1]])
        h, _, _, a, _ = self.attention(np.concatenate(bags), begins)
        z = np.add.reduceat(a[:, None] * h, begins)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights["out"] + self.weights["out0"], -30, 30)))


def train(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> Model:
    """Gated attention learned by Adam on the mean cross-entropy of the documents."""
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(labels[0]) if len(labels) else 0.5)
    x = np.concatenate(bags)
    model = Model(x.mean(0), x.std(0) + 1e-6, {})
    rng = np.random.default_rng(seed)
    glorot = lambda *shape: rng.normal(0, (2 / sum(shape)) ** 0.5, shape)
    w = model.weights = {"enc": glorot(N_FEATURES, HIDDEN), "enc0": np.zeros(HIDDEN), "v": glorot(HIDDEN, GATE), "u": glorot(HIDDEN, GATE), "a": glorot(GATE, 1)[:, 0], "out": glorot(HIDDEN, 1)[:, 0], "out0": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    begins = np.cumsum([0] + [len(b) for b in bags[:-1]])
    best, since = np.inf, 0
    for t in range(1, steps + 1):
        loss, grads = loss_and_gradient(model, x, begins, labels)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        best, since = (loss, 0) if loss < best * (1 - FLAT) else (best, since + 1)
        if since >= PATIENCE:
            break
    return model


def loss_and_gradient(model: Model, x: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the documents with weight decay, and its gradient."""
    w = model.weights
    h, v, u, a, bag = model.attention(x, begins)
    z = np.add.reduceat(a[:, None] * h, begins)
    logit = np.clip(z @ w["out"] + w["out0"], -30, 30)
    p = 1 / (1 + np.exp(-logit))
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit) + DECAY / 2 * sum((m * m).sum() for m in w.values()))
    d_logit = (p - labels) / len(labels)
    d_z = d_logit[:, None] * w["out"]
    d_a = (d_z[bag] * h).sum(1)
    d_s = a * (d_a - np.add.reduceat(a * d_a, begins)[bag])
    d_gate = d_s[:, None] * w["a"]
    d_v, d_u = d_gate * u * (1 - v * v), d_gate * v * u * (1 - u)
    d_h = (a[:, None] * d_z[bag] + d_v @ w["v"].T + d_u @ w["u"].T) * (1 - h * h)
    grads = {"enc": ((x - model.mean) / model.scale).T @ d_h, "enc0": d_h.sum(0), "v": h.T @ d_v, "u": h.T @ d_u, "a": (v * u).T @ d_s, "out": z.T @ d_logit, "out0": d_logit.sum(keepdims=True)}
    return loss, {k: g + DECAY * w[k] for k, g in grads.items()}


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    """Learn from ``quality`` of at most ``most`` labelled documents; their passages are
    encoded on the executors and only numbers reach the driver."""
    session(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [passage_features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "label": batch.column(2), "features": pa.array([f[spaced(len(f))].astype("<f4").tobytes() for f in found], pa.binary())})

    rows = training_rows(docs, labels, "quality", most).select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(encode, "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    bags = [np.frombuffer(r[2], "<f4").reshape(-1, N_FEATURES).astype(float) for r in rows]
    return train(bags, np.array([r[1] for r in rows], float))


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted.

    Null text scores as empty; repeated rows stay repeated; an empty table gives an
    empty result.
    """
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([passage_features(t) for t in batch.column(1).to_pylist()]) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, columns as they are."""
    session(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                scores = model.score([passage_features(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
