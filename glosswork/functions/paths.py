"""Path expressions; purely lexical, POSIX separators, no symbolic links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import let


def file_extension(c: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots of a name are not extensions."""
    name = F.ltrim(F.substring_index(c, "/", -1), F.lit("."))
    return F.when(
        F.contains(name, F.lit(".")),
        F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1))),
    ).otherwise(F.when(name.isNotNull(), ""))


def parent_folder(c: Column) -> Column:
    """Parent directory: ``.`` for a bare name, ``/`` for a file under the root.

    The path occurs once in the expression: filters on folders are copied into scans, and
    nested folders would otherwise multiply it.
    """
    bare = F.regexp_replace(c, r"\A([^/]*)\z", "./$1")
    rooted = F.regexp_replace(bare, r"\A/([^/]*)\z", "//$1")
    return F.regexp_replace(rooted, r"/[^/]*\z", "")


def rooted_path(c: Column) -> Column:
    """The path with exactly one leading separator added if it has none."""
    return F.regexp_replace(c, r"\A/?", "/")


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def normalize_path(c: Column) -> Column:
    """Fold ``.``, ``..`` and repeated separators of an absolute path."""
    steps = F.aggregate(
        F.split(c, "/", -1),
        F.array().cast("array<string>"),
        lambda acc, step: F.when((step == "") | (step == "."), acc)
        .when(step == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(step))),
    )
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def relative_path(c: Column, prefix: Column) -> Column:
    """Path relative to the absolute ``prefix``; NULL when it lies outside of it."""
    joined = F.when(F.startswith(c, F.lit("/")), c).otherwise(F.concat(prefix, F.lit("/"), c))

    def inside(paths: Column) -> Column:
        path, base = paths[0], paths[1]
        root = F.when(base == "/", base).otherwise(F.concat(base, F.lit("/")))
        return F.when(path == base, ".").when(
            F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))
        )

    return let(F.array(normalize_path(joined), normalize_path(prefix)), inside)
