"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import numbered, settled

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
STEPS = 256  # steps for each doubling of the key in which sizes are summed before any sort
SALTS = 64  # documents of one source are joined in so many shares
WORD = r"[^\x20\x09-\x0D]+"


def text_quality(text: Column) -> Column:
    """Weight of a document from 0.1 to 1: the share of letters, marks and spaces in its text (null or empty: 1)."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s.,]+", ""))
    return F.lit(1.0) - 0.9 * F.coalesce(odd / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`sources` (source, source_size) with target: all sizes shared by weight, at most max_epochs times each size.

    Weights repeat over the sources by code point, null last. What a source cannot take is shared
    by weight among the others until none is above its limit.
    """
    ranked = settled(numbered(sources, F.col("source").asc_nulls_last(), name="__rank"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__w", pick).withColumn("__most", F.col("source_size").cast("double") * max_epochs)
    level = 0.0  # words for each unit of weight; rises as sources reach their limits
    while True:
        full = F.col("__most") < F.col("__w") * level
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("__most"))).alias("taken"), F.sum(F.when(~full, F.col("__w"))).alias("w"),
        ).first()
        next_level = (row["all"] - (row["taken"] or 0.0)) / row["w"] if row["w"] else level
        if next_level <= level:
            break
        level = next_level
    return ranked.select("source", "source_size", F.least(F.col("__most"), F.col("__w") * level).alias("target"))


BROADCAST_SOURCES = 100_000  # plans of more sources are joined in shares instead


def _keyed(docs: DataFrame, quality: Column | None, seed: int) -> DataFrame:
    """`docs` with the size, the key and the key's step of each document."""
    quality = text_quality(F.col("text")) if quality is None else quality
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(2**53))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    keyed = docs.withColumn("__size", size).withColumn("__key", -F.log(unit) / F.greatest(quality, F.lit(1e-6)))
    return keyed.withColumn("__step", F.floor(STEPS * F.log2("__key")).cast("int"))


def _plan(light: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """For each source: size, target, complete epochs, and the last document of the fractional part.

    The step of the keys in which a source's sizes pass what the complete epochs leave is found
    from sums by step; only the documents of that step are sorted.
    """
    steps = settled(light.groupBy("source", "__step").agg(F.sum("__size").alias("step_size")))
    sources = settled(targets(steps.groupBy("source").agg(F.sum("step_size").alias("source_size")), weights, max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    budget = sources.withColumn("epochs", epochs).withColumn("budget", F.when(F.col("epochs") >= max_epochs, 0.0).otherwise(left))
    named = budget.withColumnRenamed("source", "__source")
    before = Window.partitionBy("source").orderBy("__step").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.withColumn("__before", F.coalesce(F.sum("step_size").over(before), F.lit(0)))
    edge = settled(
        sums.join(named, F.col("source").eqNullSafe(F.col("__source")))
        .where((F.col("budget") > 0) & (F.col("__before") <= F.col("budget")) & (F.col("__before") + F.col("step_size") > F.col("budget")))
        .select("__source", F.col("__step").alias("__edge"), "__before", F.col("budget").alias("__budget"))
    )
    in_step = Window.partitionBy("source").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        light.join(edge, (F.col("__step") == F.col("__edge")) & F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__end", F.col("__before") + F.sum("__size").over(in_step))
        .where(F.col("__end") - F.col("__size") / 2 <= F.col("__budget"))
        .groupBy("__source").agg(F.max(F.struct("__key", "doc_id", "__size")).alias("__last"))
        .withColumnRenamed("__source", "__of")
    )
    bound = edge.select("__source", "__edge").withColumnRenamed("__source", "__s")
    return settled(
        named.join(bound, F.col("__source").eqNullSafe(F.col("__s")), "left")
        .join(last, F.col("__source").eqNullSafe(F.col("__of")), "left")
        .select("__source", "source_size", "target", "epochs", "budget", "__edge", "__last")
    )


def _taken(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """`keyed` documents with their source's plan and __copies, how often the mix takes them."""
    few = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    same = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        joined = keyed.join(F.broadcast(plan), same)
    else:
        shares = plan.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "__size"), F.lit(SALTS)).cast("int"))
        joined = salted.join(shares, same & (F.col("__salt") == F.col("__share")))
    within = F.struct("__key", "doc_id", "__size") <= F.col("__last")
    part = (F.col("budget") > 0) & (
        F.col("__edge").isNull() | (F.col("__step") < F.col("__edge"))
        | ((F.col("__step") == F.col("__edge")) & F.coalesce(within, F.lit(False)))
    )
    return joined.withColumn("__copies", F.col("epochs") + part.cast("long"))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None, seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes from the document, repeats counted).

    A source is taken in as many complete epochs as its target holds. For the rest every document
    draws an exponential key divided by its quality weight (fixed by doc_id and seed) and documents
    are taken whole in key order until their sizes reach the budget; the document on the edge is
    taken if that comes nearer. Null texts and texts without words have size 0 and nothing to take;
    a null doc_id draws the key of null; ties go by doc_id and size; rows equal in both are taken
    together; an empty table gives an empty one. Other columns are ignored.
    """
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    light = settled(_keyed(own, quality, seed).drop("text"))
    return _taken(light, _plan(light, weights, max_epochs)).select(
        "doc_id", "source", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
    quality: Column | None = None, seed: int = 7,
) -> DataFrame:
    """`docs`, all columns, each row as often as `mix_sources` takes it. Texts are read twice and not shuffled."""
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")
    plan = _plan(settled(_keyed(own, quality, seed).drop("text")), weights, max_epochs)
    named = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", F.col("source").cast("string").alias("source"), "text")
    keyed = _keyed(named, quality, seed).drop("text")
    taken = _taken(keyed, plan).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__doc.*")
