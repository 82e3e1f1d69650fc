"""Comment syntax as column expressions over a file's comment markers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import is_blank, let, py_splitlines, py_strip

# Tags that mark review and requirement comments.
REVIEW_TAG = "\\/"
REQUIREMENT_TAG = "\\%"
# Directive for the comment language, its default, and the section markers.
LANG_DIRECTIVE = "$lang:"
DEFAULT_LANGUAGE = "English"
REVIEW_MARK = "---------- [Review]"
ISSUES_MARK = "---------- [Issues]"
IMPEDIMENTS_MARK = "---------- [Impediments]"
REQUIREMENTS_MARK = "---------- [Requirements]"


class Markers(NamedTuple):
    """Comment markers of a row; the defaults are the columns ``detect_language`` adds.

    ``tag_open`` and ``tag_close`` are the markers around a tagged one-line comment: the line
    marker alone, or those of a block in languages without line comments.
    """

    line: Column
    open: Column
    close: Column
    tag_open: Column
    tag_close: Column

    @staticmethod
    def of_row() -> "Markers":
        names = ("line_prefix", "block_prefix", "block_suffix", "tag_open", "tag_close")
        return Markers(*map(F.col, names))

    @staticmethod
    def of(line: Column, open: Column, close: Column) -> "Markers":
        return Markers(
            line,
            open,
            close,
            F.when(line != "", line).otherwise(open),
            F.when(line != "", "").otherwise(close),
        )


def _lit(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _prefix_lines(c: Column, tag: Column, m: Markers) -> Column:
    return F.array_join(
        F.transform(
            F.split(c, "\n", -1),
            lambda line: F.when(is_blank(line), line).otherwise(
                F.concat(m.line, tag, F.lit(" "), line)
            ),
        ),
        "\n",
    )


def _wrap_block(c: Column, tag: Column, m: Markers) -> Column:
    space = F.when(F.contains(c, F.lit("\n")), "\n").otherwise(" ")
    return F.when(
        ~F.contains(c, m.close), F.concat(m.open, tag, space, c, space, m.close)
    )


def line_comment(c: Column, tag: Column | str = "", markers: Markers | None = None) -> Column:
    """Prefix every non-blank line; languages without line comments get one block.

    NULL where the comment cannot be written; ``comment_error`` says why.
    """
    m = markers or Markers.of_row()
    return F.when(m.line != "", _prefix_lines(c, _lit(tag), m)).when(
        m.open != "", _wrap_block(c, _lit(tag), m)
    )


def block_comment(c: Column, tag: Column | str = "", markers: Markers | None = None) -> Column:
    """Wrap in block markers; languages without them get line comments."""
    m = markers or Markers.of_row()
    return F.when(m.open != "", _wrap_block(c, _lit(tag), m)).when(
        m.line != "", _prefix_lines(c, _lit(tag), m)
    )


def comment_error(c: Column, block: Column | bool = False, markers: Markers | None = None) -> Column:
    """Why ``line_comment`` or ``block_comment`` has no result; NULL when it has one."""
    m = markers or Markers.of_row()
    block = block if isinstance(block, Column) else F.lit(block)
    as_block = (m.open != "") & (block | (m.line == ""))
    return F.when(
        as_block & F.contains(c, m.close),
        F.concat(F.lit("Block comment suffix '"), m.close, F.lit("' found in comment")),
    ).when(
        (m.line == "") & (m.open == ""),
        F.when(block, "Comment is not supported").otherwise("Line comment is not supported"),
    )


def is_tagged_line(line: Column, tag: Column | str, markers: Markers | None = None) -> Column:
    """Whether a line is a full-line comment carrying ``tag``."""
    m = markers or Markers.of_row()
    opening = F.concat(m.tag_open, _lit(tag))
    text = py_strip(line)
    # The containment test is implied; it spares most lines the strip.
    return (
        F.contains(line, opening)
        & F.startswith(text, opening)
        & F.endswith(text, m.tag_close)
        & (m.tag_open != "")
    )


def tag_text(line: Column, tag: Column | str, markers: Markers | None = None) -> Column:
    """What a tagged line says, without checking that it is one."""
    m = markers or Markers.of_row()
    text = py_strip(line)
    start = F.length(F.concat(m.tag_open, _lit(tag)))
    return py_strip(F.substring(text, start + 1, F.length(text) - start - F.length(m.tag_close)))


def match_tagged_line(line: Column, tag: Column | str, markers: Markers | None = None) -> Column:
    """Text of a full-line comment carrying ``tag``, stripped; NULL for any other line."""
    m = markers or Markers.of_row()
    return F.when(is_tagged_line(line, tag, m), tag_text(line, tag, m))


def tagged_lines(lines: Column, tag: Column | str, markers: Markers | None = None) -> Column:
    """Comment texts of all lines carrying ``tag``, in order."""
    m = markers or Markers.of_row()
    return F.transform(
        F.filter(lines, lambda line: is_tagged_line(line, tag, m)),
        lambda line: tag_text(line, tag, m),
    )


def without_tagged_lines(
    lines: Column, *tags: str, markers: Markers | None = None
) -> Column:
    """Lines left when the comments carrying any of ``tags`` are taken out."""
    m = markers or Markers.of_row()

    def kept(line: Column) -> Column:
        test = F.lit(False)
        for tag in tags:
            test = test | is_tagged_line(line, tag, m)
        return ~test

    return F.filter(lines, kept)


def insert_line(source: Column, line: Column, text: Column) -> Column:
    """Insert ``text`` before a line; negative counts from the end, clamped to the file."""

    def insert(lines: Column) -> Column:
        n = F.size(lines)
        at = F.greatest(F.lit(0), F.least(n, F.when(line < 0, line + n).otherwise(line)))
        return F.array_join(
            F.concat(F.slice(lines, F.lit(1), at), F.array(text), F.slice(lines, at + 1, n)), "\n"
        )

    return let(py_splitlines(source), insert)


def comment_language(reviews: Column) -> Column:
    """First word of the first ``$lang:`` comment; a blank directive means the default."""
    directive = F.get(F.filter(reviews, lambda r: F.startswith(r, F.lit(LANG_DIRECTIVE))), F.lit(0))
    return _first_word(directive)


def report_language(text: Column) -> Column:
    """Same, from a report that starts with the directive."""
    first = F.substring_index(text, "\n", 1)
    return _first_word(F.when(F.startswith(text, F.lit(LANG_DIRECTIVE)), first))


def _first_word(directive: Column) -> Column:
    rest = py_strip(F.substring(directive, F.lit(len(LANG_DIRECTIVE) + 1), F.length(directive)))
    word = F.substring_index(rest, " ", 1)
    return F.coalesce(F.nullif(word, F.lit("")), F.lit(DEFAULT_LANGUAGE))


def language_override(override: Column | str, default: Column) -> Column:
    """The stripped override unless it is empty."""
    return F.coalesce(F.nullif(py_strip(_lit(override)), F.lit("")), default)
