"""Reading source files, reference documents and run logs; writing results."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.paths import file_name, parent_folder, relative_path
from glosswork.functions.text import is_blank
from glosswork.functions.variants import is_object, lenient_json
from glosswork.languages import LANGUAGES, Language, known_extensions
from glosswork.operators.comments import filter_reviewable
from glosswork.operators.steps import compute_once
from glosswork.session import accept_repeated_keys

# Layout of an event log: one line of a run's output per record.
EVENT_SCHEMA = "request_id string, seq bigint, ts timestamp, line string"


def _extension_glob(registry: tuple[Language, ...]) -> str:
    """A listing filter for the known extensions in any case."""

    def any_case(text: str) -> str:
        return "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in text)

    return "*{" + ",".join(any_case(ext) for ext in known_extensions(registry)) + "}"


def _local_path() -> Column:
    return F.regexp_replace(F.col("path"), "^file:/*", "/")


# What opening a listed file counts as, in bytes, when files are dealt to tasks: Spark's 4 MB would make a task of a
# few small files each, so that their tasks cost more than their texts.
OPEN_BYTES = 64 * 1024


def deal_small_files(spark: SparkSession) -> None:
    """Give tasks many small files each; a smaller setting stays."""
    key = "spark.sql.files.openCostInBytes"
    given = spark.conf.get(key)
    if not (given.isdigit() and int(given) <= OPEN_BYTES):
        spark.conf.set(key, str(OPEN_BYTES))


def scan_source_files(
    spark: SparkSession,
    folder: str,
    recursive: bool = False,
    registry: tuple[Language, ...] = LANGUAGES,
    root: str | None = None,
) -> DataFrame:
    """Text of the supported files directly in a folder: ``path, content, err``.

    Unsupported names are skipped when files are listed, before any content is read. Line
    ends are unified. Files that are not UTF-8 have an ``err``. With ``root``, an absolute folder, paths are
    relative to it, and files outside of it keep their path and have an ``err`` instead of a text.
    Spark skips names that start with a dot or an underscore.
    """
    deal_small_files(spark)
    raw = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _extension_glob(registry))
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
    )
    text = F.try_validate_utf8(F.col("content").cast("string"))
    files = raw.select(
        _local_path().alias("path"),
        F.regexp_replace(text, "\r\n?", "\n").alias("content"),
        F.when(
            text.isNull(),
            F.concat(F.lit("Failed to read source file "), _local_path(), F.lit(": not UTF-8")),
        ).alias("err"),
    )
    if root is None:
        return files
    inner = compute_once(files, _rel=relative_path(F.col("path"), F.lit(root)))
    outside = F.col("_rel").isNull()
    return inner.select(
        F.coalesce("_rel", "path").alias("path"),
        F.when(~outside, F.col("content")).alias("content"),
        F.when(outside, outside_root(F.col("path"), root)).otherwise(F.col("err")).alias("err"),
    )


def outside_root(path: Column, root: str) -> Column:
    """The error of a file that lies outside of the working root."""
    return F.concat(F.lit("'"), path, F.lit(f"' is not in the subpath of '{root}'"))


def source_table(table: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Supported files of a table that already holds paths and texts."""
    return filter_reviewable(table.select(F.col(path).alias("path"), F.col(content).alias("content")))


def is_reference_doc(path: Column) -> Column:
    return F.endswith(path, F.lit(".md")) & ~F.endswith(path, F.lit(".REVIEW.md"))


def reference_docs(listing: DataFrame) -> DataFrame:
    """Reference documents of a file listing: ``folder, path``; reports are left out."""
    return listing.filter(is_reference_doc(F.col("path"))).select(
        parent_folder(F.col("path")).alias("folder"), "path"
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that has fewer splits than there are cores.

    For small inputs in one file or row group only, ahead of costly per-row work. Inputs with
    enough splits, that is all large ones, are returned as they are, without an exchange.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_reference_docs(
    spark: SparkSession, folder: str, recursive: bool = False, root: str | None = None
) -> DataFrame:
    """Markdown documents of a folder: ``folder, path``; contents are not read.

    With ``root``, an absolute folder, both are relative to it, and rows outside of it have an ``err``.
    """
    deal_small_files(spark)
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.md")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select(_local_path().alias("path"))
    )
    if root is None:
        return reference_docs(listing)
    rel = compute_once(listing, _rel=relative_path(F.col("path"), F.lit(root)))
    placed = rel.select(
        F.coalesce("_rel", "path").alias("path"), F.when(F.col("_rel").isNull(), outside_root(F.col("path"), root)).alias("err")
    )
    return placed.filter(is_reference_doc(F.col("path"))).select(
        parent_folder(F.col("path")).alias("folder"), "path", "err"
    )


def run_events(lines: DataFrame) -> DataFrame:
    """Keep the lines of an event log that are JSON objects."""
    accept_repeated_keys(lines.sparkSession)
    line = F.col("line")
    return lines.filter(~is_blank(line) & is_object(lenient_json(line)))


def scan_run_events(spark: SparkSession, path: str) -> DataFrame:
    """Event log in JSON lines (``request_id, seq, ts, line``); other lines are skipped."""
    return run_events(spark.read.schema(EVENT_SCHEMA).json(path))


def stream_run_events(spark: SparkSession, path: str) -> DataFrame:
    """The same on files arriving in a folder."""
    return run_events(spark.readStream.schema(EVENT_SCHEMA).json(path))


def scan_run_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded standard output, one file per run: ``request_id`` (name without extension), ``stdout``."""
    # File paths come percent-encoded; a plus sign stands for itself.
    name = F.url_decode(F.replace(file_name(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B")))
    return spark.read.text(folder, wholetext=True).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias("request_id"),
        F.col("value").alias("stdout"),
    )


def write_annotated_sources(df: DataFrame, path: str) -> None:
    """New file texts as a new snapshot; an existing one is never overwritten."""
    df.select("path", "content").write.mode("errorifexists").parquet(path)


def write_project_reports(df: DataFrame, path: str) -> None:
    """Folder reports; the parts of a report are ordered by ``part``."""
    df.select("folder", "part", "report").write.mode("errorifexists").parquet(path)


def write_attempt_failures(df: DataFrame, path: str) -> None:
    """Add failed attempts to a table, one directory per error class, each attempt once.

    Attempts that the table holds already, by request and number, are left out, so a repeated or resumed
    write gives the same table. Only their keys are read. An interrupted write adds
    nothing: files count from the job's commit on. One writer at a time.
    """
    keys = ["request_id", "attempt"]
    try:
        stored = df.sparkSession.read.schema(df.schema).parquet(path).select(*keys).distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = df
    else:
        fresh = df.join(stored, keys, "left_anti").select(*df.columns)
    fresh.write.mode("append").partitionBy("err_class").parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str | None:
    """A new folder name in the shared checkpoint directory; None when none is configured."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/glosswork-{name}-{uuid.uuid4().hex}" if shared else None
