"""Toxicity by multiple-instance learning: sentences score, documents are their noisy-or."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import prepared
from glosswork.llm.learning import fitted, held_out, remainder

FEATURES = 1 << 20
SENTENCE = re.compile(r"[^.!?\n]+")
MARKS = ".,;:!?()[]{}<>|*$%&#+=~^_/\\\"'`-\u2013\u2014\u2018\u2019\u201c\u201d\u00ab\u00bb\u2026\u00a1\u00bf"
STEPS = 150
MIN_DOCS = 6  # documents of the sample that a feature needs
RATE = 0.1
DECAY = 1e-4
START = -7.0  # log-odds of a sentence without any known word
WORDS_KEPT = 500_000


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first 3 to 6 letters."""
    raw = word.encode("utf-8", "replace")
    found = [zlib.crc32(raw) % FEATURES]
    return found + [zlib.crc32(word[:k].encode("utf-8", "replace"), k) % FEATURES for k in (3, 4, 5, 6) if len(word) >= k]


def bare(word: str) -> str:
    """A word in lower case without the marks around it."""
    return word.strip(MARKS).lower()


@dataclass
class SentenceModel:
    weights: np.ndarray
    bias: float

    def probability(self, z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _WordScores(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= WORDS_KEPT:
            self.clear()
        plain = bare(word)
        value = sum([self.weights[f] for f in word_features(plain)]) if plain else 0.0
        self[word] = value
        return value


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> SentenceModel:
    """Fit sentence weights to document labels by the noisy-or likelihood.

    With p_s the chance that a sentence offends, a document's chance is 1 - prod(1 - p_s). Its
    gradient pulls the likeliest sentences of a labelled document up and all of a clean one down.
    """
    vocabulary: dict[str, int] = {}
    word_of, sentence_of, document_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for match in SENTENCE.finditer(text):
            found = {bare(w) for w in match.group().split()} - {""}
            if found:
                ids = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
                word_of.extend(ids)
                sentence_of.extend([len(document_of)] * len(ids))
                document_of.append(d)
    weight, bias = np.zeros(FEATURES), START
    if not word_of or not (y == 1).any():
        return SentenceModel(weight.astype(np.float32), -30.0 if not (y == 1).any() else bias)
    feature, sizes = array("i"), array("i")
    for w in vocabulary:
        own = word_features(w)
        feature.extend(own)
        sizes.append(len(own))
    feature, sizes, word_of, sentence_of, document_of = (
        np.asarray(v) for v in (feature, sizes, word_of, sentence_of, document_of)
    )
    owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    # Only features of several documents, so that none stands for a document; numbered by use.
    in_docs = np.zeros(FEATURES, np.int64)
    edges = np.searchsorted(document_of[sentence_of], np.arange(len(texts) + 1))
    for low, high in zip(edges, edges[1:], strict=False):
        own = np.unique(word_of[low:high])
        many = sizes[own]
        in_docs[np.unique(feature[np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())])] += 1
    common = in_docs >= MIN_DOCS
    owner, feature = owner[common[feature]], feature[common[feature]]
    used, feature = np.unique(feature, return_inverse=True)
    w, m, v = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    n_words, n_sentences, n_docs = len(vocabulary), len(document_of), len(texts)
    scale = weights / weights.sum()
    for t in range(1, steps + 1):
        of_word = np.bincount(owner, w[feature], n_words)
        z = np.clip(bias + np.bincount(sentence_of, of_word[word_of], n_sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(document_of, np.log1p(-p), n_docs))  # no sentence offends
        pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * scale
        gz = pull[document_of] * p
        gw = np.bincount(feature, np.bincount(word_of, gz[sentence_of], n_words)[owner], len(used)) + DECAY * w
        g = np.append(gw, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, bias = w - step[:-1], bias - step[-1]
    weight[used] = w
    return SentenceModel(weight.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None) -> SentenceModel:
    """Fit on a bounded sample of the labelled rows where `training` holds (see `fitted`)."""
    return fitted(docs, labels, "toxic", F.lit(True) if training is None else training, fit)


def sentence_scores(text: str, words: _WordScores, bias: float) -> list[tuple[int, int, float]]:
    """Log-odds of each sentence that has a word, with its place in the text."""
    return [
        (s.start(), s.end(), bias + sum(map(words.__getitem__, set(s.group().split()))))
        for s in SENTENCE.finditer(text)
    ]


def _documents(model: SentenceModel):
    """A function of a text: its noisy-or score and its offending sentences."""
    words = _WordScores(model.weights)

    def of(text: str | None) -> tuple[float, list[dict]]:
        if not text or not text.strip():
            return 0.0, []
        found = sentence_scores(text, words, model.bias)
        p = model.probability(np.array([z for _, _, z in found]))
        if not len(p):
            return 0.0, []
        score = float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return score, [
            {"start": a, "end": b, "score": float(q)} for (a, b, _), q in zip(found, p, strict=True) if q >= 0.5
        ]

    return of


def score_documents(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score at least 0.5) and the offending sentences with places in the text.

    Null, empty and blank texts score 0. Repeated rows score alike; a null doc_id stays null;
    other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers, whatever the data
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _documents(sent.value)
        for batch in batches:
            made = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([x for _, x in made], kind)],
                ["doc_id", "score", "sentences"],
            )

    prepared(docs.sparkSession)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_kind}, score double, sentences array<struct<start int, end int, score double>>"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: SentenceModel) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below 0.5; rows without text stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _documents(sent.value)
        for batch in batches:
            keep = [of(t.as_py())[0] < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    prepared(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def document_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """Score all documents by a model that never saw a label of the held-out fold; adds held_out."""
    model = train(docs, labels, remainder(F.col("doc_id"), folds) != fold)
    return score_documents(docs, model).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
