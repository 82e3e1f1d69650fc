"""Gathering group members into arrays without unbounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Target size of one gathered array, in bytes of the gathered columns.
PART_BYTES = 32 * 1024 * 1024


def share(rows: DataFrame, *identity: str) -> DataFrame:
    """Exchange rows by their identity, evenly, so that several readers use one shuffle.

    The readers' plans are equal up to this exchange, so Spark runs what precedes it once, and
    the shuffle files outlive lost executors. Select the needed columns before.
    """
    return rows.repartition(*identity)


def place_in_parts(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str] | None = None,
    part_bytes: int = PART_BYTES,
    **summaries: Column,
) -> DataFrame:
    """Add ``part`` and ``parts``: where a row goes when its group is gathered.

    Group sizes come from a pre-aggregated count that moves keys only. The few oversized
    groups are joined back as a left join (its hot side can be split at run time) and their
    rows are spread by a hash of ``order``, so no task receives a whole oversized group.
    ``summaries`` are aggregates added to the rows of oversized groups, NULL for others.
    """
    columns = [*order, *(values or [])]
    rows = share(rows.select(*keys, *columns), *keys, *order)
    # Every item also costs its array slot.
    weight: Column = F.lit(16)
    for name in columns:
        weight = weight + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    oversized = (
        rows.groupBy(*keys)
        .agg(
            F.sum(weight.cast("long")).alias("_bytes"),
            *[value.alias(name) for name, value in summaries.items()],
        )
        .filter(F.col("_bytes") > part_bytes)
        .select(
            *[F.col(k).alias(f"_key_{k}") for k in keys],
            F.ceil(F.col("_bytes") * 2 / part_bytes).cast("int").alias("_parts"),
            *summaries,
        )
    )
    same_key = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    return rows.join(oversized, same_key, "left").select(
        *keys,
        *columns,
        parts.alias("parts"),
        F.when(parts == 1, 0)
        .otherwise(F.pmod(F.xxhash64(*order), parts))
        .cast("int")
        .alias("part"),
        *summaries,
    )


def collect_in_parts(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str] | None = None,
    part_bytes: int | None = PART_BYTES,
) -> DataFrame:
    """Gather ``order`` + ``values`` per key into sorted arrays of bounded size.

    Returns ``keys, part, parts, items``: one row per key, and several for a group larger
    than ``part_bytes`` (such as a folder holding a third of all files). Parts are disjoint
    and together hold every row; each is sorted. ``order`` must identify a row in its group.
    With None every group is one row, whatever its size: for arrays that go whole into rows anyway.
    """
    if part_bytes is None:
        items = F.array_sort(F.collect_list(F.struct(*order, *(values or []))))
        whole = rows.groupBy(*keys).agg(items.alias("items"))
        return whole.select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), "items")
    placed = place_in_parts(rows, keys, order, values, part_bytes)
    # An explicit exchange on key and part: the join's partitioning on the key alone would
    # also satisfy the aggregation, and would keep an oversized group in one task.
    return (
        placed.repartition(*keys, "part")
        .groupBy(*keys, "part", "parts")
        .agg(F.array_sort(F.collect_list(F.struct(*order, *(values or [])))).alias("items"))
    )


def ordered_pieces(rows: DataFrame, keys: list[str], order: list[str], text: str, piece_bytes: int = PART_BYTES) -> DataFrame:
    """The texts of each key, joined in ``order``, in pieces: ``keys, piece, text``.

    Joining a key's pieces by ``piece``, whose numbers ascend with gaps, gives all its texts in order; a
    piece holds about ``piece_bytes``, or one longer text. The rows are dealt by range of key and
    order, so a key of any size lies in several neighbouring partitions, whose number is the first part of
    ``piece``; within one, bytes are summed up to where the next piece begins.
    """
    pid = F.spark_partition_id().cast("long")
    ranged = rows.select(*keys, *order, text).repartitionByRange(*keys, *order).withColumn("_pid", pid)
    running = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(text).cast("long") + 16).over(running), F.lit(0))
    numbered = ranged.withColumn("_number", F.floor(before / piece_bytes).cast("long"))
    return numbered.groupBy(*keys, "_pid", "_number").agg(
        F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_items")
    ).select(
        *keys,
        (F.shiftleft("_pid", 40) + F.col("_number")).alias("piece"),
        F.array_join("_items._text", "").alias("text"),
    )


# Bits of the table that pre-selects rows by key: at most 2 ** (FILTER_BITS - 5) short rows are broadcast.
FILTER_BITS = 24


def likely_members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be among ``keys``, chosen where they lie: nothing of them is exchanged.

    Each key sets one bit, by its hash, in a table of fixed size. All rows with a key pass, and of the others a
    share as large as that of the bits set. For large rows of which few are needed, ahead of an exact join.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int"))
    words = keys.select(F.shiftright(bit, 5).alias("_word"), mask.alias("_mask")).groupBy("_word").agg(
        F.bit_or("_mask").alias("_bits")
    )
    marked = rows.withColumns({"_word": F.shiftright(bit, 5), "_mask": mask})
    hit = marked.join(F.broadcast(words), "_word")
    return hit.filter(F.col("_bits").bitwiseAND(F.col("_mask")) != 0).select(*rows.columns)
