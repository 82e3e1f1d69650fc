"""Quality by Naive Bayes support vectors: n-gram indicators scaled by log-count ratios, hinge loss."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import prepared
from glosswork.llm.learning import fitted, held_out, remainder

BITS = 17
GRAMS = (1, 2, 3, 4)  # byte n-grams
REPEATS = 8  # indicators of words that follow themselves 1, 2, ... times
FEATURES = (1 << BITS) + REPEATS
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 20
CHUNK = 1 << 20  # bytes that are hashed at once


def indicators(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """Sorted numbers of the n-gram indicators that a whole text has; `scratch` is FEATURES zeros and stays so."""
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        key = np.zeros(len(part), np.uint32)
        for k in range(1, max(GRAMS) + 1):
            n = len(part) - k + 1
            if n < 1:
                break
            key = key[:n] * np.uint32(0x01000193) + part[k - 1 :][:n] + np.uint32(1)
            if k in GRAMS:
                scratch[(key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = True
    words = raw.split()
    run = longest = 0
    for same in map(eq, words, words[1:]):
        run = run + 1 if same else 0
        if run > longest:
            longest = run
    scratch[1 << BITS : (1 << BITS) + min(longest, REPEATS)] = True
    found = np.flatnonzero(scratch)
    scratch[found] = False
    return found


@dataclass
class QualityModel:
    ratios: np.ndarray
    weights: np.ndarray  # already times the ratios
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt(float((self.ratios[found] ** 2).sum())) or 1.0
        return float(self.weights[found].sum()) / length + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30))))


def descend(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS):
    """Dual coordinate descent for a linear hinge loss: weights of the scaled indicators, and bias."""
    signs = np.where(y == 1, 1.0, -1.0)
    values = []
    for r in rows:
        x = ratios[r]
        values.append(x / (np.sqrt((x * x).sum()) or 1.0))
    w, bias = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            r, x, s = rows[i], values[i], signs[i]
            slack = s * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - slack / (x @ x + 1.0), 0.0), cost[i])
            change = new - alpha[i]
            if change:
                alpha[i] = new
                w[r] += change * s * x
                bias += change * s
                largest = max(largest, abs(change))
        if largest < 1e-3:
            break
    return w, bias


def calibrated(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton's steps; slope positive."""
    a, b = 2.0, 0.0
    if len(set(y.tolist())) < 2:
        return a, b
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        g = x.T @ (weights * (p - target)) + np.array([1e-2 * (a - 2.0), 1e-2 * b])
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = max(a - np.clip(step[0], -2, 2), 1e-2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray) -> QualityModel:
    """Log-count ratios from all rows; hinge loss on four fifths, the curve from margin to score on the rest."""
    scratch = np.zeros(FEATURES, bool)
    rows = [indicators(t, scratch) for t in texts]
    count = [np.full(FEATURES, SMOOTHING), np.full(FEATURES, SMOOTHING)]
    for r, k in zip(rows, y, strict=True):
        count[k][r] += 1
    ratios = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return QualityModel(ratios, np.zeros(FEATURES), 0.0, 0.0, 30.0 if share > 0.5 else -30.0 if share < 0.5 else 0.0)
    rest = np.arange(len(rows)) % 5 == 4
    main = np.flatnonzero(~rest) if len(set(y[~rest].tolist())) == 2 else np.arange(len(rows))
    w, bias = descend([rows[i] for i in main], ratios, y[main], COST * np.sqrt(weights[main]))
    model = QualityModel(ratios, w * ratios, bias, 1.0, 0.0)
    other = np.flatnonzero(rest) if rest.any() else main
    margins = np.array([model.margin(rows[i]) for i in other])
    model.slope, model.shift = calibrated(margins, y[other], weights[other])
    return model


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None) -> QualityModel:
    """Fit on a bounded sample of the labelled rows where `training` holds (see `fitted`)."""
    return fitted(docs, labels, "quality", F.lit(True) if training is None else training, fit)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score at least 0.5) of whole texts.

    Null and empty texts have no n-grams and get the score of the bias alone. Repeated rows score
    alike; a null doc_id stays null; other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scratch = sent.value, np.zeros(FEATURES, bool)
        for batch in batches:
            scores = [known.score(indicators(t.as_py(), scratch)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def document_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Score all documents by a model that never saw a label of the held-out fold; adds held_out."""
    model = train(docs, labels, remainder(F.col("doc_id"), folds) != fold)
    return score_documents(docs, model).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
