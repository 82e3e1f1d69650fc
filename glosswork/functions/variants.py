"""Strict JSON parsing and dynamic type tests on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.text import let

# A private-use character that marks the end of the input while parsing; a text that holds it
# is followed by its own hash instead.
_END = "\ue0ff"
# The next bare NaN or infinity, with all strings and other characters before it. The loops are
# possessive: linear, and without recursion on long texts.
_NEXT_BARE = r'(?s)\G((?:[^"NI-]++|"(?:[^"\\]++|\\.)*+"|-(?!Infinity))*+)-?(?:NaN|Infinity)'


# Characters from which the long strings of a text are set aside, as the parser takes strings of 20
# million characters and values of 16 MiB at most; and the length of strings that may stay.
LONG_TEXT, SHORT_STRING = 1 << 20, 64
_SET_ASIDE = "\ue0fe"  # stands before the number of a string set aside, with a hash where the text holds it
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"(?:\s*+:)?+'
_PIECES = rf'{_STRING}|[^"]++|"'
_ESCAPED = r"[^\\]++|\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\."
_PLAIN_ESCAPES = (("\\n", "\n"), ('\\"', '"'), ("\\\\", "\\"), ("\\/", "/"), ("\\t", "\t"), ("\\r", "\r"))


def set_aside(c: Column) -> Column:
    """``STRUCT<text, mark, longs>``: a JSON text with short numbered strings in place of long ones.

    Only texts of over ``LONG_TEXT`` characters are cut: at their strings, in one linear scan. Keys stay, and
    so does whatever is no well-formed string, for the parser to refuse.
    """

    def cut(pieces: Column) -> Column:
        def is_long(x: Column) -> Column:
            return (F.length(x) > SHORT_STRING) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))

        mark = F.when(F.contains(c, F.lit(_SET_ASIDE)), F.concat(F.lit(_SET_ASIDE), F.sha2(c, 256))).otherwise(_SET_ASIDE)

        def numbered(m: Column) -> Column:
            short = F.transform(pieces, lambda x, i: F.when(
                is_long(x), F.concat(F.lit('"'), m, i.cast("string"), F.lit('"'))
            ).otherwise(x))
            return F.struct(
                F.array_join(short, "").alias("text"), m.alias("mark"), F.transform(pieces, lambda x: F.when(is_long(x), x)).alias("longs")
            )

        return let(mark, numbered)

    whole = F.struct(c.alias("text"), F.lit(_SET_ASIDE).alias("mark"), F.array().cast("array<string>").alias("longs"))
    return F.when(F.length(c) > LONG_TEXT, let(F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0)), cut)).otherwise(whole)


def unescaped(literal: Column) -> Column:
    """The text of a JSON string of any length."""

    def one(x: Column) -> Column:
        found = F.when(F.startswith(x, F.lit("\\u")) | x.isin("\\b", "\\f"), F.try_variant_get(
            F.try_parse_json(F.concat(F.lit('"'), x, F.lit('"'))), "$", "string"
        ))
        for escape, plain in _PLAIN_ESCAPES:
            found = found.when(x == escape, plain)
        return found.otherwise(x)

    def text(body: Column) -> Column:
        return F.when(F.contains(body, F.lit("\\")), F.array_join(
            F.transform(F.regexp_extract_all(body, F.lit(f"(?s){_ESCAPED}"), F.lit(0)), one), ""
        )).otherwise(body)

    return let(F.substring(literal, F.lit(2), F.length(literal) - 2), text)


def whole_text(value: Column, aside: Column | None) -> Column:
    """A string value, put back if it was set aside; ``aside`` is the ``set_aside`` of the text that was parsed."""
    if aside is None:
        return value
    place = F.substring(value, F.length(aside["mark"]) + 1, F.length(value)).try_cast("int")
    kept = F.coalesce(F.get(aside["longs"], F.coalesce(place, F.lit(-1))), F.lit(""))
    return F.when(
        (F.size(aside["longs"]) > 0) & F.startswith(value, aside["mark"]) & (kept != ""), unescaped(kept)
    ).otherwise(value)


def strict_json(c: Column) -> Column:
    """Parse a whole text as one JSON value; NULL when anything follows the value.

    ``try_parse_json`` alone stops after the first value and ignores the rest of the text.
    Parsing the text as the first of two list items makes any rest a syntax error.
    """
    mark = F.when(F.contains(c, F.lit(_END)), F.sha2(c, 256)).otherwise(_END)

    def parsed(m: Column) -> Column:
        return let(
            F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), m, F.lit('"]'))),
            lambda v: F.when(
                F.try_variant_get(v, "$[1]", "string") == m,
                F.try_variant_get(v, "$[0]", "variant"),
            ),
        )

    return let(mark, parsed)


def lenient_json(c: Column) -> Column:
    """``strict_json`` that also reads NaN and infinities outside strings, as null."""
    plain = F.when(
        F.rlike(c, F.lit("NaN|Infinity")), F.regexp_replace(c, _NEXT_BARE, "$1null")
    ).otherwise(c)
    return let(plain, strict_json)


def field(v: Column, name: str) -> Column:
    """A member of an object; SQL NULL when missing, a VARIANT null when it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    """``STRING``, ``ARRAY``, ``OBJECT``, ``VOID``, ``BOOLEAN`` or a numeric type name."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def text_of(v: Column, aside: Column | None = None) -> Column:
    """The value when it is a string, else NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", whole_text(F.try_variant_get(v, "$", "string"), aside))


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def is_falsy(v: Column) -> Column:
    """Missing, null, empty text, zero, false, an empty list or an empty object."""
    shape = F.schema_of_variant(v)
    plain = F.to_json(v)
    return (
        v.isNull()
        | shape.isin("VOID", "OBJECT<>")
        | ((shape == "STRING") & (plain == '""'))
        | ((shape == "BOOLEAN") & (plain == "false"))
        | (F.startswith(shape, F.lit("ARRAY")) & (plain == "[]"))
        | (F.rlike(shape, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"))
           & (F.try_variant_get(v, "$", "double") == 0.0))
    )


def items(v: Column) -> Column:
    """Items of a list; an empty array for anything else."""
    return F.coalesce(
        F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")),
        F.array().cast("array<variant>"),
    )


def printed(v: Column, aside: Column | None = None) -> Column:
    """Display form of any value: text as it is, literals capitalised, the rest as JSON."""
    shape = F.schema_of_variant(v)
    return (
        F.when(shape == "STRING", whole_text(F.try_variant_get(v, "$", "string"), aside))
        .when(shape == "VOID", "None")
        .when(shape == "BOOLEAN", F.initcap(F.to_json(v)))
        .otherwise(F.to_json(v))
    )
