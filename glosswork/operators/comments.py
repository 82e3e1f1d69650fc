"""Jobs over source files: languages, lines, tagged comments, edits, reviews, annotations.

All of them but the edits are narrow: one row per file in, one out, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import comments as c
from glosswork.functions.paths import file_extension
from glosswork.functions.render import render_review
from glosswork.functions.text import is_blank, py_splitlines, strip_newlines
from glosswork.operators.steps import compute_once
from glosswork.languages import LANGUAGES, Language, known_extensions, languages

MARKER_COLUMNS = [
    "language", "line_prefix", "block_prefix", "block_suffix", "tag_open", "tag_close",
]


def is_reviewable(path: Column, registry: tuple[Language, ...] = LANGUAGES) -> Column:
    """Whether a path ends with a known extension, in any case."""
    endings = "|".join(re.escape(ext) for ext in known_extensions(registry))
    return F.rlike(F.lower(path), F.lit(rf"(?:{endings})\z"))


def filter_reviewable(files: DataFrame, registry: tuple[Language, ...] = LANGUAGES) -> DataFrame:
    """Keep files whose name ends with a known extension."""
    return files.filter(is_reviewable(F.col("path"), registry))


def detect_language(files: DataFrame, registry: tuple[Language, ...] = LANGUAGES) -> DataFrame:
    """Add ``language``, the comment markers and ``err`` for unknown extensions."""
    # Bounded by the registry (languages.MAX_EXTENSIONS), not by the data.
    dimension = F.broadcast(languages(files.sparkSession, registry))
    extension = file_extension(F.col("path"))
    return (
        files.drop(*MARKER_COLUMNS, "err")
        .withColumn("extension", extension)
        .join(dimension, "extension", "left")
        .withColumn(
            "err",
            F.when(
                F.col("language").isNull(),
                F.concat(
                    F.lit("Extension "), F.col("extension"),
                    F.lit(" not supported for "), F.col("path"),
                ),
            ),
        )
        .drop("extension")
    )


def with_language(files: DataFrame) -> DataFrame:
    """``detect_language`` unless the markers are already there."""
    if set(MARKER_COLUMNS) <= set(files.columns):
        return files
    return detect_language(files)


def split_source_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 0."""
    return files.select(
        "path", F.posexplode(py_splitlines(F.col("content"))).alias("line_no", "line")
    )


def extract_tagged_comments(
    files: DataFrame, tag: str, first: int = 0, last: int = -1
) -> DataFrame:
    """Add ``comments`` and ``residual``: the tagged full-line comments of a line range.

    A negative ``last`` counts from the end. An empty range leaves the text untouched; every
    other result is re-joined with newlines, without a trailing one.
    """
    if first < 0:
        raise ValueError("Negative `first` indexes are not supported")
    kept = files.columns
    # Columns of their own, so that the text is split and searched once.
    df = compute_once(with_language(files), _lines=py_splitlines(F.col("content")))
    lines, n = F.col("_lines"), F.size("_lines")
    stop = n + last if last < 0 else F.least(F.lit(last), n - 1)
    whole = first == 0 and last == -1

    def taken(line: Column, i: Column) -> Column:
        tagged = c.is_tagged_line(line, tag)
        return tagged if whole else (i >= first) & (i <= stop) & tagged

    found = F.transform(F.filter(lines, taken), lambda line: c.tag_text(line, tag))
    rest = F.array_join(F.filter(lines, lambda line, i: ~taken(line, i)), "\n")
    empty = stop < first
    return df.select(
        *kept,
        *[name for name in [*MARKER_COLUMNS, "err"] if name not in kept and name in df.columns],
        F.when(F.col("language").isNotNull(), F.when(empty, F.array().cast("array<string>")).otherwise(found))
        .alias("comments"),
        F.when(F.col("language").isNotNull(), F.when(empty, F.col("content")).otherwise(rest))
        .alias("residual"),
    )


def tagged_comments(files: DataFrame, tag: str) -> DataFrame:
    """One row per tagged comment: ``path, tag, ord, line_no, comment``."""
    df = with_language(files).filter(F.col("language").isNotNull())
    # The line number is taken before filtering, the ordinal after it.
    numbered = F.filter(
        F.transform(
            py_splitlines(F.col("content")),
            lambda line, i: F.struct(i.alias("line_no"), c.match_tagged_line(line, tag).alias("comment")),
        ),
        lambda s: s["comment"].isNotNull(),
    )
    return df.select("path", F.posexplode(numbered).alias("ord", "_c")).select(
        "path", F.lit(tag).alias("tag"), "ord", "_c.line_no", "_c.comment"
    )


def _edit_rows(files: DataFrame, edits: DataFrame) -> DataFrame:
    # Edits on the left: a path with very many edits is then the splittable side of the join.
    return edits.drop("content").join(with_language(files.select("path", "content")), "path", "left").withColumn(
        "err", F.when(F.col("content").isNull() & F.col("err").isNull(), "File not found").otherwise(F.col("err"))
    )


def append_line_comments(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Append a comment to one line of a file, for each row of ``edits``.

    ``edits(path, line, comment, tag)``; a negative line counts from the end. Each edit is
    applied to the stored text and gives one row: the edit with ``content`` (NULL on error)
    and ``err``.
    """
    df = compute_once(_edit_rows(files, edits), _lines=py_splitlines(F.col("content")))
    n = F.size("_lines")
    at = F.when(F.col("line") < 0, F.col("line") + n).otherwise(F.col("line"))
    err = F.coalesce(
        F.col("err"),
        F.when(
            (at < 0) | (at >= n),
            F.concat(F.lit("Line "), at.cast("string"), F.lit(" is out of range")),
        ),
        c.comment_error(F.col("comment")),
    )
    df = df.withColumn("_at", at).withColumn("err", err).withColumn(
        "_text", c.line_comment(F.col("comment"), F.col("tag"))
    )
    edited = F.transform(
        F.col("_lines"),
        lambda line, i: F.when(
            i == F.col("_at"), F.concat(line, F.lit(" "), F.col("_text"))
        ).otherwise(line),
    )
    return df.select(
        *edits.columns,
        F.when(F.col("err").isNull(), F.array_join(edited, "\n")).alias("content"),
        "err",
    )


def insert_comments(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Insert a line or block comment before a line, for each row of ``edits``.

    ``edits(path, line, comment, tag, block)``; the line is clamped to the file.
    """
    df = _edit_rows(files, edits)
    text, tag, block = F.col("comment"), F.col("tag"), F.col("block")
    comment = F.when(block, c.block_comment(text, tag)).otherwise(c.line_comment(text, tag))
    df = df.withColumn(
        "err", F.coalesce(F.col("err"), c.comment_error(text, block))
    ).withColumn("_text", comment)
    return df.select(
        *edits.columns,
        F.when(
            F.col("err").isNull(), c.insert_line(F.col("content"), F.col("line"), F.col("_text"))
        ).alias("content"),
        "err",
    )


def extract_reviews(files: DataFrame) -> DataFrame:
    """Stored review of each file; NULL unless its comments hold a review section.

    Requirement comments follow under a heading of their own. Works on streams as well.
    """
    df = compute_once(with_language(files), _lines=py_splitlines(F.col("content")))
    # Requirements need no second pass over the residual: no line can carry both tags.
    df = compute_once(
        df,
        _reviews=c.tagged_lines(F.col("_lines"), c.REVIEW_TAG),
        _requirements=c.tagged_lines(F.col("_lines"), c.REQUIREMENT_TAG),
    )
    reviewed = F.exists(F.col("_reviews"), lambda r: F.startswith(r, F.lit(c.REVIEW_MARK)))
    heading = F.when(F.size("_requirements") > 0, F.array(F.lit(c.REQUIREMENTS_MARK))).otherwise(
        F.array().cast("array<string>")
    )
    review = F.when(
        F.col("language").isNotNull() & reviewed,
        F.array_join(F.concat(F.col("_reviews"), heading, F.col("_requirements")), "\n"),
    )
    return compute_once(df, review=review).select("path", "review", "err")


def apply_review_annotations(
    files: DataFrame, payloads: DataFrame, ai: Column | str, ts: Column | str, lang: str = ""
) -> DataFrame:
    """New text of each reviewed file: review header, requirements, then the reply's output.

    ``files`` as built by ``build_review_requests``;
    ``payloads(path, data)`` with the reply's ``output`` in ``data.output``.
    Returns ``path, content, review, err``.
    """
    asked = files.select("path", "request", *MARKER_COLUMNS)
    return annotate(asked.join(payloads.select("path", "data"), "path"), ai, ts, lang)


def annotate(rows: DataFrame, ai: Column | str, ts: Column | str, lang: str = "") -> DataFrame:
    """``apply_review_annotations`` on requests and replies that are already in one row.

    Columns besides ``path, request, data`` and the markers are kept; rows without data have
    neither content nor review.
    """
    kept = [n for n in rows.columns if n not in (*MARKER_COLUMNS, "path", "request", "data", "err")]
    language = c.language_override(lang, F.col("request.comment_language"))
    df = compute_once(
        rows,
        _lines=py_splitlines(F.col("data.output")),
        requirements=F.col("request.requirements"),
        review=F.when(F.col("data").isNotNull(), render_review(F.col("data"), ai, ts, language)),
    )
    code = strip_newlines(
        F.array_join(
            c.without_tagged_lines(F.col("_lines"), c.REVIEW_TAG, c.REQUIREMENT_TAG), "\n"
        )
    )
    required = F.concat(F.col("requirements"), F.lit("\n"))
    top = F.lit(0)
    df = compute_once(
        compute_once(df, _code=code),
        _body=F.when(
            F.col("requirements") != "",
            c.insert_line(F.col("_code"), top, c.line_comment(required, c.REQUIREMENT_TAG)),
        ).otherwise(F.col("_code")),
    )
    err = F.coalesce(
        c.comment_error(F.col("review")),
        F.when(F.col("requirements") != "", c.comment_error(required)),
    )
    return df.select(
        "path",
        *kept,
        F.when(
            err.isNull(),
            c.insert_line(F.col("_body"), top, c.line_comment(F.col("review"), c.REVIEW_TAG)),
        ).alias("content"),
        "review",
        err.alias("err"),
    )
