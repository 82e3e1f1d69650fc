"""Steps that several operators share: shared-folder checkpoints, Arrow batches, row numbers, components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.session import ship

BATCH_ROWS = 1000  # documents that a Python worker holds at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Send the package to the workers and keep Arrow batches of texts small; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; without `spark.checkpoint.dir` only a local session may choose one of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="glosswork-checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and read them from there.

    Cuts the lineage and survives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def map_texts(
    docs: DataFrame,
    keys: list[tuple[str, Column]],
    text: Column,
    of_text: Callable[[bytes | None], tuple],
    fields: list[tuple[str, pa.DataType]],
    schema: str,
) -> DataFrame:
    """The key columns of each row and what `of_text` gives for the UTF-8 bytes of its whole text."""
    n = len(keys)
    names = [k for k, _ in keys] + [f for f, _ in fields]
    kinds = [kind for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*[of_text(x) for x in batch.column(n).to_pylist()], strict=True)) or [()] * len(kinds)
            columns = [batch.column(i) for i in range(n)]
            columns += [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    prepared(docs.sparkSession)
    light = docs.select(*[c.alias(k) for k, c in keys], text.cast("string").cast("binary").alias("__text"))
    return light.mapInArrow(run, schema)


def numbered(df: DataFrame, *order: Column, name: str = "row_number") -> DataFrame:
    """Rows with their place, from 0, in the given order over the whole table.

    The rows are dealt by range and sorted there; only the number of rows of each partition is
    brought together. Rows equal in every order key may take either place; a random last key
    deals them over several partitions.
    """
    pid = F.spark_partition_id()
    ranged = (
        df.repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)
        .withColumns({"__pid": pid, "__at": F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)})
    )
    ranged = settled(ranged)
    counts = ranged.groupBy("__pid").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__pid"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # One row for each partition of the table: as few as there are tasks.
    joined = ranged.join(F.broadcast(starts), "__pid")
    return joined.withColumn(name, F.col("__start") + F.col("__at")).drop("__pid", "__at", "__start")


def components(edges: DataFrame) -> DataFrame:
    """`id`, `component` (smallest id reachable over the edges `a`, `b`) of all nodes that edges name.

    Every round gives each node the smallest label around it and then the label of its label, so
    rounds grow with the logarithm of a chain's length. Rows move as small pairs; a node with very
    many edges is reduced before the shuffle.
    """
    both = settled(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    )
    labels = settled(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        )
        # Written first, so that the next join deals both sides anew and can split a label that many share.
        step = settled(labels.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        ))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("above"))
        moved = settled(
            step.join(up, "component", "left")
            .select("id", "old", F.coalesce("above", "component").alias("component"))
        )
        labels = moved.select("id", "component")
        if moved.where("old <> component").isEmpty():
            return labels
