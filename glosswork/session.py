"""Session settings the jobs are designed for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Joins keep their large side on the left, where adaptive execution can split a hot key; the
# last setting lets it do so even when that costs an exchange before a following aggregation.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.exchange.reuse": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Lets JSON objects repeat a key, of which the last counts, as Python reads them.
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


# Rows and bytes of texts that a Python worker holds at once; smaller settings stay.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 256, "spark.sql.execution.arrow.maxBytesPerBatch": 4 * 1024 * 1024}


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers from growing with the rows of a task."""
    for key, limit in BATCH_LIMITS.items():
        given = spark.conf.get(key)
        if not (given.isdigit() and 0 < int(given) <= limit):
            spark.conf.set(key, str(limit))


# How Parquet writers hold long texts that many rows repeat: each once in a dictionary of up to 32 MiB, where by
# default 1 MiB ends it and all copies are buffered. Sizes are looked at after every few rows and not after 100.
REPEATED_TEXTS = {"parquet.dictionary.page.size": 32 * 1024 * 1024, "parquet.page.size.row.check.min": 8, "parquet.block.size.row.check.min": 8}


def write_repeated_texts(spark: SparkSession) -> None:
    """Called by the jobs that copy a list or its text to many rows; settings that were given stay."""
    for key, value in REPEATED_TEXTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def accept_repeated_keys(spark: SparkSession) -> None:
    """Called by the jobs that read run output and event lines, whatever the session's settings."""
    spark.conf.set(REPEATED_KEYS, "true")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to a running session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers, once for each application, so that they load its functions anywhere.

    Called by all jobs that hand texts to Python, whose batches it keeps small.
    """
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_glosswork_shipped", False):
        return spark
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="glosswork-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._glosswork_shipped = True
    return spark
