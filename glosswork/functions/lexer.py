"""Comment-insensitive token lists: a scanner with state first, then one pattern per language family.

The scanner drops comments and marks literals, in Arrow batches; names, numbers, signs and blanks
are what is left, and plain replacements cut them into tokens inside generated code. Tokens are
kept as one text, each preceded by a separator.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions.scanner import CLOSE, OPEN, SEPARATOR, SHIFT, STOPS, scan
from glosswork.functions.text import let

# Building blocks of the token patterns.
_LITERAL = f"{OPEN}[^{CLOSE}]*{CLOSE}"
_NAME = r"[A-Za-z_$\p{L}][0-9A-Za-z_$\p{L}\p{N}]*"
_NUMBER = r"[0-9][0-9A-Za-z_.]*"
_WORD = rf"[^ \t\n\r\f;&|()<>{OPEN}]+"
_OTHER = SHIFT + r"?[^ \t\n\r\f]"
_SIGN = r"[-+*/%=<>!&|^~?:.@]"

# Languages by what blanks and line breaks mean in them; the others ignore both.
PYTHON, SHELL, MARKUP = "python", "bash", "html"
BREAKING = ("go", "typescript")  # a line break can end a statement


_SCANNED = T.StructType([T.StructField("text", T.StringType()), T.StructField("sure", T.BooleanType())])


@F.pandas_udf(_SCANNED)
def _scanned(content: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None) if text is None or name not in STOPS else scan(text, name)
        for text, name in zip(content, language, strict=True)
    ]
    return pd.DataFrame(rows, columns=["text", "sure"])


def scanned(content: Column, language: Column) -> Column:
    """``STRUCT<text, sure>``: the text without comments, literals marked; NULLs without a language.

    ``sure`` is false where the text can be read in more than one way.
    """
    return _scanned(F.when(language.isNotNull(), content), language)


def token_text(text: Column, language: Column) -> Column:
    """All tokens of a scanned text, each preceded by the separator.

    Two signs with blanks between them are not the sign that they would be together, so the first
    keeps one blank.
    """

    def cut(c: Column, breaks: str, blanks: str) -> Column:
        # Every character but blanks belongs to a token, so one replacement that swallows the
        # blanks behind each token leaves nothing but tokens; no array of tokens is built.
        tokens = f"{_LITERAL}|{_NAME}|{_NUMBER}|{breaks}{_SIGN}[{blanks}]+(?={_SIGN})|{_OTHER}"
        spaced = F.regexp_replace(c, f"({tokens})[{blanks}]*", f"{SEPARATOR}$1")
        return F.regexp_replace(spaced, f"({SEPARATOR}{_SIGN})[{blanks}]+", "$1 ")

    def last_breaks(c: Column) -> Column:
        # Of consecutive line breaks only the last counts, with the indentation behind it.
        return F.regexp_replace(c, rf"{SEPARATOR}\n[ \t]*(?={SEPARATOR}\n)", "")

    def shell(c: Column) -> Column:
        # Blanks part words; those at the ends of lines and around ; and | do not count.
        pieces = F.regexp_replace(c, rf"({_LITERAL}|{_WORD}|[ \t\r\f]+|{_OTHER}|\n)", f"{SEPARATOR}$1")
        before = F.regexp_replace(pieces, rf"{SEPARATOR}[ \t\r\f]+(?={SEPARATOR}[\n;|])", "")
        after = F.regexp_replace(before, rf"({SEPARATOR}[\n;|]){SEPARATOR}[ \t\r\f]+", "$1")
        return last_breaks(F.regexp_replace(after, rf"{SEPARATOR}[ \t\r\f]+", f"{SEPARATOR} "))

    blanks = F.lit(" \t\r\n\f")
    framed = F.concat(F.lit("\n"), text, F.lit("\n"))
    trimmed = F.btrim(text, blanks)
    return (
        F.when(language == PYTHON, last_breaks(cut(framed, r"\n[ \t]*|", r" \t\r\f")))
        .when(language == SHELL, shell(framed))
        .when(language == MARKUP, F.regexp_replace(
            trimmed, rf"({_LITERAL}|{_NAME}|{_NUMBER}|{_OTHER})[ \t\r\n\f]*", f"{SEPARATOR}$1"
        ))
        .when(language.isin(*BREAKING), last_breaks(cut(trimmed, r"\n|", r" \t\r\f")))
        .when(language.isNotNull(), cut(trimmed, "", r" \t\r\n\f"))
    )


def decode(token: Column) -> Column:
    """The source text of a token."""

    def unshifted(t: Column) -> Column:
        for mark in (SEPARATOR, OPEN, CLOSE, SHIFT):
            t = F.replace(t, F.lit(SHIFT + chr(ord(mark) + 0x10)), F.lit(mark))
        return t

    bare = F.replace(F.replace(token, F.lit(OPEN), F.lit("")), F.lit(CLOSE), F.lit(""))
    return let(bare, lambda t: F.when(F.contains(t, F.lit(SHIFT)), unshifted(t)).otherwise(t))


def token_kind(token: Column) -> Column:
    """Class of a token, not yet decoded, by its first characters."""
    return (
        F.when(F.rlike(token, F.lit(f"^{OPEN}?\n")), "newline")
        .when(F.startswith(token, F.lit(" ")), "blank")
        .when(F.startswith(token, F.lit(OPEN)), "string")
        .when(F.rlike(token, F.lit(r"^[\p{L}_$]")), "name")
        .when(F.rlike(token, F.lit("^[0-9]")), "number")
        .otherwise("symbol")
    )
