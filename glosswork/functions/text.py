"""Whitespace, line-break and hashing expressions with Unicode-aware semantics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, and the line terminators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``.

    Inside higher-order functions Spark does not share common subexpressions, so a value
    used several times would be computed several times; a one-element ``transform`` binds it.
    """
    return F.transform(F.array(value), body)[0]


def py_strip(c: Column) -> Column:
    """Strip Unicode whitespace on both ends; linear in the stripped characters."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_newlines(c: Column) -> Column:
    return F.btrim(c, F.lit("\n"))


def is_blank(c: Column) -> Column:
    return py_strip(c) == ""


def py_splitlines(c: Column) -> Column:
    """Lines without terminators; a trailing terminator does not add an empty line."""
    return let(
        F.split(c, LINE_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def value_hash(c: Column) -> Column:
    """First 128 bits of SHA-256, as 32 hexadecimal characters."""
    return F.substring(F.sha2(c, 256), 1, 32)


def ordinal(i: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st, 111th and so on."""
    teen = (F.pmod(i, F.lit(100)) >= 11) & (F.pmod(i, F.lit(100)) <= 13)
    last = F.pmod(i, F.lit(10))
    suffix = (
        F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd")
        .otherwise("th")
    )
    return F.concat(i.cast("string"), suffix)


# Control characters whose JSON escapes contain hexadecimal letters.
_HEX_LETTER_ESCAPES = [f"{code:04X}" for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))]


def json_string(c: Column) -> Column:
    """``c`` as a quoted JSON string, non-ASCII kept, lower-case hexadecimal in escapes."""
    listed = F.to_json(F.array(c))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)

    def lower_hex(piece: Column) -> Column:
        for code in _HEX_LETTER_ESCAPES:
            piece = F.replace(piece, F.lit(f"\\u{code}"), F.lit(f"\\u{code.lower()}"))
        return piece

    # Splitting at escaped backslashes first keeps a literal "\u001F" in the text as it is.
    pair = "\\\\"
    lowered = F.array_join(F.transform(F.split(quoted, r"\\\\", -1), lower_hex), pair)
    return F.when(F.rlike(c, F.lit(r"[\x0b\x0e\x0f\x1a-\x1f]")), lowered).when(
        c.isNotNull(), quoted
    )


def json_members(members: list[tuple[str, Column]]) -> Column:
    """A JSON object with one member per line, two blanks of indentation; NULLs are left out."""
    parts = [
        F.concat(F.lit(f'  "{name}": '), value)
        for name, value in members
    ]
    body = F.array_join(F.array(*parts), ",\n")
    return F.when(body == "", "{}").otherwise(F.concat(F.lit("{\n"), body, F.lit("\n}")))


def json_list(items: Column) -> Column:
    """An array of strings as an indented JSON list nested one level deep."""
    body = F.array_join(F.transform(items, lambda s: F.concat(F.lit("    "), json_string(s))), ",\n")
    return F.when(F.size(items) == 0, "[]").otherwise(
        F.concat(F.lit("[\n"), body, F.lit("\n  ]"))
    )


def json_map(entries: Column) -> Column:
    """A string map as an indented JSON object nested one level deep, ordered by key."""
    body = F.array_join(
        F.transform(
            F.array_sort(F.map_entries(entries)),
            lambda e: F.concat(F.lit("    "), json_string(e["key"]), F.lit(": "), json_string(e["value"])),
        ),
        ",\n",
    )
    return F.when(F.size(entries) == 0, "{}").otherwise(
        F.concat(F.lit("{\n"), body, F.lit("\n  }"))
    )
