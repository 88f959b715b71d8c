"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their (smoothed) class counts, and a linear model
with hinge loss is fitted to them by dual coordinate descent. Its margins are turned into
probabilities by a logistic curve fitted on margins of held-back parts of the sample, then shifted so
that the margin's own boundary, nought, stands at ``boundary``.

The sample is bounded by ``max_rows`` labelled rows; scoring reads whole texts, a slice at a time.

Edge cases: null and empty texts have no indicator and get the score of the model's constant. Where
only one class is known, every text gets that class's score (1 or 0), and 0.5 where nothing is known.
Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from driftwatch.llm.features import ngram_features, sigmoid
from driftwatch.llm.textops import annotate, slices

BITS = 18
MAX_ROWS = 6000


@dataclass
class Model:
    weights: np.ndarray
    constant: float
    slope: float
    shift: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.shift)


def collect_features(sample: DataFrame, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers and label of each row of a bounded sample, made by the tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, feature = ngram_features(part.column("text"), bits)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [feature[s:e].astype("<i4").tobytes() for s, e in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), part.column("label")], ["features", "label"])

    rows = sample.mapInArrow(run, "features binary, label int").collect()
    rows.sort(key=lambda r: (bytes(r["features"]), r["label"]))
    return [np.frombuffer(r["features"], "<i4") for r in rows], np.array([r["label"] for r in rows], int)


def log_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of class counts of each feature."""
    out = []
    for k in (1, 0):
        some = [r for r, v in zip(rows, y) if v == k]
        counts = np.bincount(np.concatenate(some), minlength=size) if some else np.zeros(size)
        out.append((counts + smoothing) / (len(some) + 2 * smoothing))
    return np.log(out[0] / out[1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear model with hinge loss, by dual coordinate descent.

    Row vectors are brought to unit length; classes weigh alike.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    bound = cost * 0.5 / np.maximum(share, 1e-9)
    values = [scale[r] for r in rows]
    norm = np.array([1 / max(np.sqrt((v * v).sum()), 1e-9) for v in values])
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i] * norm[i]
            gradient = sign[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                b += step
                alpha[i] = new
    return w, b


def margins_of(rows: list[np.ndarray], weights: np.ndarray, ratios: np.ndarray, constant: float) -> np.ndarray:
    out = np.full(len(rows), constant)
    for i, r in enumerate(rows):
        v = ratios[r]
        out[i] += (weights[r] * v).sum() / max(np.sqrt((v * v).sum()), 1e-9)
    return out


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels to margins, by Newton's method."""
    x = np.stack([margins, np.ones_like(margins)], 1)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ c)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        c += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(c[0]), float(c[1])


def fit(sample: DataFrame, bits: int = BITS, cost: float = 1.0, epochs: int = 8, folds: int = 3, boundary: float = 0.5) -> tuple[Model, np.ndarray]:
    """Model and log ratios from a bounded sample of ``text`` and ``label``."""
    rows, y = collect_features(sample, bits)
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        sure = 0.0 if not len(y) else 60.0 if y[0] else -60.0
        return Model(np.zeros(size), 0.0, 1.0, sure), np.zeros(size)
    fold = np.random.default_rng(5).permutation(len(y)) % folds
    held = np.zeros(len(y))
    for k in range(folds):
        own = [r for r, f in zip(rows, fold) if f != k]
        ratios = log_ratios(own, y[fold != k], size)
        w, b = dual_descent(own, y[fold != k], ratios, cost, epochs)
        held[fold == k] = margins_of([r for r, f in zip(rows, fold) if f == k], w, ratios, b)
    slope, _ = logistic_curve(held, y)
    ratios = log_ratios(rows, y, size)
    w, b = dual_descent(rows, y, ratios, cost, epochs)
    return Model(w, b, max(slope, 1e-3), float(np.log(boundary / (1 - boundary)))), ratios


def score(docs: DataFrame, model: Model, ratios: np.ndarray, keep: list[str], text: str = "text", bits: int = BITS) -> DataFrame:
    """``keep`` columns with ``score``, the chance of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype(np.float32) * ratios.astype(np.float32), (ratios * ratios).astype(np.float32), model.constant, model.slope, model.shift)
    )

    def work(texts: pa.Array) -> list[pa.Array]:
        product, square, constant, slope, shift = sent.value
        doc, feature = ngram_features(texts, bits)
        total = np.bincount(doc, product[feature], len(texts))
        length = np.sqrt(np.bincount(doc, square[feature], len(texts)))
        margin = constant + total / np.maximum(length, 1e-9)
        return [pa.array(sigmoid(slope * margin + shift), pa.float64())]

    return annotate(docs, text, keep, StructType([StructField("score", DoubleType())]), work)
