"""A bounded sample of labelled documents, and held-out marks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import prepared

SAMPLE_DOCS = 3000  # labelled documents of each class that a model is fitted on, at most
SAMPLE_CHARS = 16_000_000  # characters of all their texts, at most


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by)).cast("int")


def fitted(
    docs: DataFrame, labels: DataFrame, label: str, training: Column, fit: Callable[[list[str], np.ndarray, np.ndarray], Any],
    per_class: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS,
) -> Any:
    """What `fit` makes of the texts, labels (0 or 1) and weights of a sample of the labelled rows where `training` holds.

    At most `per_class` documents of each label, the first by a hash of doc_id, with one text each
    (the shortest), are brought to one task, which fits the model; where the texts of a label exceed
    half of `max_chars` characters, its longest ones are left out. Weights give each
    label the share that it has among all training labels. Labels that are null or neither 0 nor 1
    and documents without text take no part; of repeated labels of a document the largest counts.
    Without any labelled document the model is fitted on none.
    """
    prepared(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(training)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    )
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("__label") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    picked = chosen[0].union(chosen[1])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("__text")).where("__text is not null")
    shape = F.struct(F.length("__text").alias("chars"), F.xxhash64("__text").alias("hash"))
    # At most 2 * per_class short rows are broadcast; texts stay where they are until their lengths have been added up.
    sizes = texts.select("doc_id", shape.alias("__shape")).join(
        F.broadcast(picked.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id")
    ).groupBy("doc_id", "__label").agg(F.min("__shape").alias("__shape"))
    # Shorter ones come first: an over-long text takes nothing from them.
    running = Window.partitionBy("__label").orderBy("__shape.chars", order, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = sizes.withColumn("__sum", F.sum("__shape.chars").over(running)).where(F.col("__sum") <= max_chars // 2).select(
        F.col("doc_id").alias("__id"), "__label", "__shape"
    )
    # One text of each document, reduced before the shuffle.
    rows = texts.join(F.broadcast(taken), (F.col("doc_id") == F.col("__id")) & (shape == F.col("__shape"))).groupBy(
        "doc_id", "__label"
    ).agg(F.min("__text").alias("__text")).select("__text", "__label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: list[str] = []
        marks: list[int] = []
        for batch in batches:
            given += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        y, weights = np.array(marks, np.int64), np.ones(len(marks))
        for k in (0, 1):
            if (y == k).any():
                weights[y == k] = counts[k] / sum(counts.values()) * len(y) / (y == k).sum()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(given, y, weights))], pa.binary())], ["model"])

    made = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit([], np.empty(0, np.int64), np.empty(0))


def held_out(doc_id: Column, by: int, rest: int) -> Column:
    return F.coalesce(remainder(doc_id, by) == rest, F.lit(False))
