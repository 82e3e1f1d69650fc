"""A training corpus from raw documents: toxicity, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import mixing, neardup, packing, pii, toxicity
from glosswork.llm.common import settled, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or toxicity, learned from all labels, is below one half."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8.

    Rows without doc_id stay. Rows of one doc_id are one document only where their texts are equal.
    """
    named = docs.withColumn("__text", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    judged = settled(neardup.near_duplicates(named, size=5, similar=80, carried=("__text",)))
    # Where the group's first doc_id has several texts in the group, one of them stays.
    first = judged.where("kept and component is not null").groupBy("component").agg(
        F.min("__text").alias("__least"), F.max("__text").alias("__most")
    ).where("__least <> __most")
    others = judged.where("kept").join(first, "component").where("__text <> __least")
    gone = judged.where("not kept").select("doc_id", "__text").union(others.select("doc_id", "__text")).distinct()
    rest = named.join(gone, ["doc_id", "__text"], "left_anti")
    # Repeated rows are copies too.
    once = rest.where("doc_id is not null").dropDuplicates(["doc_id", "__text"])
    return once.unionByName(rest.where("doc_id is null")).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: complete epochs, then a weighted part of each source."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a training sequence."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # models, registers and tokenizers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
