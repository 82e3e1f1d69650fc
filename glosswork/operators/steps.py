"""Evaluating costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read instead of recomputing.

    The optimizer pushes filters below projections by copying the projected expressions into
    them, so a filter on a parsed or extracted value would parse or extract twice, and a chain
    of such steps would grow without end. A one-row generator is where it stops.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*[F.col(f"`{name}`") for name in df.columns if name not in columns], F.inline(F.array(row)))
