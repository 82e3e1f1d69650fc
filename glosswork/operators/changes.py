"""Comparing snapshots: changed files, kinds of change, changed lines, affected folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.paths import parent_folder
from glosswork.functions.text import py_splitlines
from glosswork.operators.comments import with_language
from glosswork.operators.fingerprint import HIGH, with_prints
from glosswork.operators.grouping import likely_members


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    columns = ["path", "content"]
    return (
        old.select(*columns)
        .withColumn("_new", F.lit(False))
        .unionByName(new.select(*columns).withColumn("_new", F.lit(True)))
    )


def _on_side(is_new: bool, value: Column) -> Column:
    return F.max(F.when(F.col("_new") == is_new, value))


def _changes(per_path: DataFrame, *more: Column) -> DataFrame:
    """Changed paths of rows with the digests of both sides."""
    changed = F.col("_after").isNotNull() & ~F.col("_before").eqNullSafe(F.col("_after"))
    change = F.when(F.col("_before").isNull(), "added").otherwise("modified").alias("change")
    return per_path.filter(changed).select("path", change, *more)


def _digests() -> list[Column]:
    return [_on_side(False, F.col("_digest")).alias("_before"), _on_side(True, F.col("_digest")).alias("_after")]


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change``: ``modified`` or ``added``; deletions are left out.

    One pre-aggregated shuffle of paths and content hashes; the contents do not move.
    """
    digests = _sides(old, new).select("path", "_new", F.sha2("content", 256).alias("_digest"))
    return _changes(digests.groupBy("path").agg(*_digests()))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change, kind`` of new and modified files.

    ``kind`` of a modified file is ``comment_only`` or ``logic``, ``unsure`` where a side can be read
    in more than one way, ``unknown`` without a language; NULL for added files. Each
    snapshot is read once; hashes and fingerprints are taken there and meet in one
    pre-aggregated shuffle, which the contents do not enter.
    """
    sides = with_language(_sides(old, new)).withColumn("_digest", F.sha2("content", 256))
    sides = with_prints(sides, F.col("content"), F.col("language")).select(
        "path", "_new", "language", "_digest", "_print.*"
    )
    per_path = sides.groupBy("path").agg(
        *_digests(),
        F.max("language").alias("_language"),
        F.min("fingerprint").alias("_least"),
        F.max("fingerprint").alias("_most"),
        F.every(F.col("confidence") == HIGH).alias("_sure"),
    )
    kind = (
        F.when(F.col("_before").isNull(), None)
        .when(F.col("_language").isNull(), "unknown")
        .when(~F.col("_sure"), "unsure")
        .when(F.col("_least") == F.col("_most"), "comment_only")
        .otherwise("logic")
    )
    return _changes(per_path, kind.alias("kind"))


def line_changes(old: DataFrame, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Lines added to or removed from changed files, as multisets: ``path, line, side, n``.

    Lines count +1 in the new and -1 in the old snapshot; one pre-aggregated shuffle of the lines of
    changed files. Files are chosen where they lie, so no text is exchanged; what else
    passes has equal lines on both sides, or falls out at the end, where few rows are left. ``changed``
    names the changed paths where the caller has them already.
    """
    changed = (changed_files(old, new) if changed is None else changed).select("path")
    lines = likely_members(_sides(old, new), changed, "path").select(
        "path", "_new", F.explode(py_splitlines(F.col("content"))).alias("line")
    )
    return (
        lines.groupBy("path", "line")
        .agg(F.sum(F.when(F.col("_new"), 1).otherwise(-1)).alias("_delta"))
        .filter(F.col("_delta") != 0)
        .join(changed, "path", "left_semi")
        .select(
            "path",
            "line",
            F.when(F.col("_delta") > 0, "added").otherwise("removed").alias("side"),
            F.abs("_delta").alias("n"),
        )
    )


def union_changed_paths(*sources: DataFrame) -> DataFrame:
    """Changed paths of all sources without repeats: ``path, source, pos``.

    Sources come in order of precedence (modified, staged, untracked), each ``path, pos``.
    ``source`` and ``pos`` tell where a path occurs first; ordering by them gives the list.
    """
    ranked = [
        df.select("path", F.lit(rank).alias("source"), F.col("pos").cast("long").alias("pos"))
        for rank, df in enumerate(sources)
    ]
    return (
        reduce(DataFrame.unionByName, ranked)
        .groupBy("path")
        .agg(F.min(F.struct("source", "pos")).alias("_first"))
        .select("path", "_first.source", "_first.pos")
    )


def affected_folders(changed: DataFrame) -> DataFrame:
    """Distinct folders of changed files, longest path first: ``folder, length``."""
    folders = changed.select(parent_folder(F.col("path")).alias("folder")).distinct()
    return children_first(folders.withColumn("length", F.length("folder")))


def children_first(folders: DataFrame) -> DataFrame:
    """Order folders so that children precede their parents; ties by name."""
    return folders.orderBy(F.length("folder").desc(), "folder")
