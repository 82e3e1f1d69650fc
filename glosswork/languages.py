"""The language dimension: which comment markers a file extension implies."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Language(NamedTuple):
    """One language; an empty marker means the language has no such comment form."""

    name: str
    extensions: tuple[str, ...]
    line_prefix: str = "//"
    block_prefix: str = "/*"
    block_suffix: str = "*/"


# Languages, extensions and comment markers.
LANGUAGES: tuple[Language, ...] = (
    Language("python", (".py",), "#", '"""', '"""'),
    Language("typescript", (".ts", ".js")),
    Language("java", (".java",)),
    Language("c", (".c", ".h")),
    Language("cpp", (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx")),
    Language("c_sharp", (".cs",)),
    Language("go", (".go",)),
    Language("rust", (".rs",)),
    Language("bash", (".sh", ".bash"), "#", "", ""),
    Language("html", (".html", ".htm"), "", "<!--", "-->"),
)

# The dimension is broadcast in joins, so its size is bounded here.
MAX_EXTENSIONS = 10_000


def check_registry(registry: tuple[Language, ...]) -> None:
    """Raise when a language or an extension is claimed twice, or the registry is oversized."""
    names = Counter(lang.name for lang in registry)
    extensions = Counter(ext.lower() for lang in registry for ext in lang.extensions)
    for what, counts in (("Language", names), ("Extension", extensions)):
        for value, n in counts.items():
            if n > 1:
                raise ValueError(f"{what} {value} is claimed {n} times")
    if len(extensions) > MAX_EXTENSIONS:
        raise ValueError(f"{len(extensions)} extensions exceed the limit of {MAX_EXTENSIONS}")


def known_extensions(registry: tuple[Language, ...] = LANGUAGES) -> list[str]:
    return [ext.lower() for lang in registry for ext in lang.extensions]


def _tag_markers(lang: Language) -> tuple[str, str]:
    return (lang.line_prefix, "") if lang.line_prefix else (lang.block_prefix, lang.block_suffix)


def languages(spark: SparkSession, registry: tuple[Language, ...] = LANGUAGES) -> DataFrame:
    """One row per extension, as a local relation the planner knows the size of.

    ``tag_open`` and ``tag_close`` are the markers around a tagged one-line comment.
    """
    check_registry(registry)

    def literal(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = ", ".join(
        "(" + ", ".join(map(literal, (lang.name, ext.lower(), *lang[2:], *_tag_markers(lang)))) + ")"
        for lang in registry
        for ext in lang.extensions
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} "
        "AS t(language, extension, line_prefix, block_prefix, block_suffix, tag_open, tag_close)"
    )
