"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import numbered, settled

PRIME = 2_147_483_647  # round values stay below it, so that products fit a long
ROUNDS = 6
WALK = 65  # steps of cycle walking: more than a domain of up to 4,096 rows can need


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    keys, state = [], seed % PRIME or 1
    for _ in range(rounds):
        row = []
        for _ in range(3):
            state = state * 48_271 % PRIME
            row.append(state)
        keys.append(tuple(row))
    return keys


def _whole(x: Column, by: int) -> Column:
    """Integer quotient; the division of a multiple has no rounding."""
    return ((x - x % by) / by).cast("long")


def permuted(row: Column, n: int, seed: int) -> Column:
    """Place of a row number under a permutation of 0 to n - 1.

    A Feistel network on pairs (left below a, right below b), a * b at least n by less than a:
    each round adds a mixed value of one half to the other. Results of n or more walk on through
    the network until they fall below n. The share of such results is below 1 / sqrt(n), so the
    fixed number of steps always suffices up to 4,096 rows, and beyond fails with a chance below
    64 to the power -64; a row that were left over would end the job, never be misplaced.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    keys = round_keys(seed)

    def once(x: Column) -> Column:
        # One struct per round keeps each half computed once.
        state = F.struct(_whole(x, b).alias("l"), (x % b).alias("r"))
        rounds = F.array(*[
            F.struct(F.lit(i % 2).alias("side"), *[F.lit(v).cast("long").alias(m) for v, m in zip(key, "kcd", strict=True)])
            for i, key in enumerate(keys)
        ])

        def turn(s: Column, r: Column) -> Column:
            value = F.when(r["side"] == 0, s["r"]).otherwise(s["l"])
            line = (value % PRIME * r["k"] + r["c"]) % PRIME
            add = (line * line + r["d"]) % PRIME
            return F.struct(
                F.when(r["side"] == 0, (s["l"] + add) % a).otherwise(s["l"]).alias("l"),
                F.when(r["side"] == 0, s["r"]).otherwise((s["r"] + add) % b).alias("r"),
            )

        return F.reduce(rounds, state, turn, lambda s: s["l"] * b + s["r"])

    start = F.struct(row.cast("long").alias("x"), F.lit(False).alias("done"))

    def walk(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(
            F.transform(F.array(once(s["x"])), lambda y: F.struct(y.alias("x"), (y < n).alias("done")))[0]
        )

    end = F.reduce(F.sequence(F.lit(1), F.lit(WALK)), start, walk)
    return F.transform(
        F.array(end), lambda s: F.when(s["done"], s["x"]).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))
    )[0]


def shard_rows(
    rows: DataFrame, order: list[Column], shards: int, seed: int = 1, keep: list[str] | None = None
) -> DataFrame:
    """`rows` with row_number, shard and slot: a shuffle that anyone can compute from the row number.

    Row numbers follow `order` over the whole table (ties in it: either way). With p the permuted
    row number, the shard is p % shards and the slot p / shards, so counts of shards differ by one
    at most and slots have no gap. Fewer rows than shards leave shards empty; an empty table gives
    an empty one. Columns of `rows` named row_number, shard or slot give way.
    """
    keep = [c for c in (keep or rows.columns) if c not in ("row_number", "shard", "slot")]
    placed = numbered(rows.select(*keep), *order)
    n = placed.count()
    p = F.col("__place")
    return placed.withColumn("__place", permuted(F.col("row_number"), n, seed)).select(
        *keep, "row_number", (p % shards).cast("int").alias("shard"), _whole(p, shards).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (null text: of no bytes), shard, slot.

    Documents are numbered by doc_id (null first), then by checksum and size; rows equal in all
    three have equal results in either order. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = settled(docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    ))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return shard_rows(light, order, shards, seed)


def write_shards(rows: DataFrame, path: str) -> None:
    """Write rows that have shard and slot as one folder for each shard, sorted by slot within its files."""
    (rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
