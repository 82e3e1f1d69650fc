"""Merkle manifest of a dataset: leaf places by bitmap rank, levels reduced by keyed slot arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import settled

WIDTH = 16  # nodes of a run
WORD_BITS = 6  # doc_ids of one 64-bit bitmap word
CONTAINER_BITS = 16  # doc_ids of one container, of which only words with a bit are stored
SPREAD = 4096  # copies of one leaf that a row is expanded to at once
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value; null as a dash."""
    parts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Left rows with the right rows' other columns, where the keys are equal or both null."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def running_starts(rows: DataFrame, order: list[str], weight: str, name: str) -> DataFrame:
    """Rows with the sum of `weight` over all rows before them in the order of the given columns, which differ in each row.

    The rows are dealt by range and summed there; only one sum of each partition is brought together.
    """
    dealt = settled(rows.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()))
    ahead = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the table: as few as there are tasks.
    starts = dealt.groupBy("__pid").agg(F.sum(weight).alias("__sum")).select(
        "__pid", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__start")
    )
    before = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__inside", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return summed.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__start") + F.col("__inside")).drop(
        "__pid", "__start", "__inside"
    )


def _bit(doc_id: Column) -> Column:
    return doc_id.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")


def rank_directory(ids: DataFrame) -> DataFrame:
    """grp, word, bits, extra, start, total: the doc_ids of each group as compressed bitmaps with the rows before each word.

    `ids` has one row for each grp and doc_id with its number of rows, `n`. Bitmap words of 64 ids
    are merged by OR; the words of 65,536 ids make a container, which keeps only words with a bit
    and their running row counts. `extra` (bit, n) lists the ids of a word that have more than one row;
    `total` is the number of the group's rows. Null ids are a word of their own, before all others.
    """
    bit = _bit(F.col("doc_id"))
    words = ids.groupBy("grp", F.shiftright("doc_id", WORD_BITS).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"),
        F.collect_list(F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("n")))).alias("extra"),
        F.sum("n").alias("rows"),
    )
    containers = words.groupBy("grp", F.shiftright("word", CONTAINER_BITS - WORD_BITS).alias("high")).agg(
        F.sort_array(F.collect_list(F.struct("word", "bits", "extra", "rows"))).alias("words"), F.sum("rows").alias("rows")
    )
    placed = running_starts(settled(containers), ["grp", "high"], "rows", "start")
    groups = placed.groupBy("grp").agg(F.min("start").alias("__first"), F.sum("rows").alias("total"))
    before = F.reduce(
        "words", F.array(F.lit(0).cast("long")), lambda sums, w: F.concat(sums, F.array(F.element_at(sums, -1) + w["rows"]))
    )
    each = matched(placed, groups, ["grp"]).withColumn("before", F.slice(before, 1, F.size("words"))).select(
        "grp", "total", (F.col("start") - F.col("__first")).alias("start"), F.explode(F.arrays_zip("words", "before")).alias("w")
    )
    return each.select(
        "grp", F.col("w.words.word").alias("word"), F.col("w.words.bits").alias("bits"), F.col("w.words.extra").alias("extra"),
        (F.col("start") + F.col("w.before")).alias("start"), "total",
    )


def leaf_places(leaves: DataFrame) -> DataFrame:
    """`leaves` (grp, doc_id, leaf, n: equal rows, and others) with `place` of the first of them in the group and its `total`.

    Leaves ascend by doc_id, null first, and rows of one doc_id by their leaf. Places come from
    bitmap ranks; only rows of doc_ids that occur with different contents are ranked by a sort.
    """
    ids = settled(leaves.groupBy("grp", "doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("contents")))
    directory = rank_directory(ids.select("grp", "doc_id", "n"))
    bit = _bit(F.col("doc_id"))
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    more = F.reduce(F.filter("extra", lambda x: x["bit"] < bit), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    rank = F.coalesce(F.bit_count(F.col("bits").bitwiseAND(below)) + more, F.lit(0))
    placed = matched(leaves.withColumn("word", F.shiftright("doc_id", WORD_BITS)), directory, ["grp", "word"]).select(
        *leaves.columns, (F.col("start") + rank).alias("place"), "total"
    )
    several = ids.where("contents > 1").select("grp", "doc_id")
    tied = matched(leaves.select("grp", "doc_id", "leaf", "n"), several, ["grp", "doc_id"], "left_semi")
    ordered = running_starts(tied, ["grp", "doc_id", "leaf"], "n", "at")
    first = ordered.groupBy("grp", "doc_id").agg(F.min("at").alias("first"))
    among = matched(ordered, first, ["grp", "doc_id"]).select("grp", "doc_id", "leaf", (F.col("at") - F.col("first")).alias("__among"))
    return matched(placed, among, ["grp", "doc_id", "leaf"], "left").select(
        *leaves.columns, (F.col("place") + F.coalesce("__among", F.lit(0))).alias("place"), "total"
    )


def _each_copy(placed: DataFrame) -> DataFrame:
    """One row for each of `n` equal leaves; the expansion of a much-repeated one is spread over tasks."""
    zero, step = F.lit(0).cast("long"), F.lit(SPREAD).cast("long")
    many = placed.where(F.col("n") > SPREAD).withColumn("__from", F.explode(F.sequence(zero, F.col("n") - 1, step)))
    many = many.repartition("grp", "place", "__from").withColumns(
        {"place": F.col("place") + F.col("__from"), "n": F.least(step, F.col("n") - F.col("__from"))}
    ).drop("__from")
    every = placed.where(F.col("n") <= SPREAD).unionByName(many)
    every = every.withColumn("__copy", F.explode(F.sequence(zero, F.col("n") - 1)))
    return every.withColumn("place", F.col("place") + F.col("__copy")).drop("n", "__copy")


def _joined(slots: Column) -> Column:
    return F.array_join(F.transform(slots, lambda s: s["node"]), "")


def _around(slots: Column, own: Column) -> Column:
    """The digests before and after the own slot of a run, as two texts."""
    return F.struct(
        _joined(F.filter(slots, lambda s: s["slot"] < own)).alias("before"),
        _joined(F.filter(slots, lambda s: s["slot"] > own)).alias("after"),
    )


def _runs(nodes: DataFrame, *carried: str) -> DataFrame:
    """The runs of 16 neighbours: grp, place, total (nodes of the group on this level), slots (slot, node and others, by slot)."""
    slot = F.struct((F.col("place") % WIDTH).cast("int").alias("slot"), "node", *carried)
    return nodes.groupBy("grp", "total", F.floor(F.col("place") / WIDTH).cast("long").alias("run")).agg(
        F.sort_array(F.collect_list(slot)).alias("slots")
    ).select("grp", F.col("run").alias("place"), "total", "slots")


def _above(runs: DataFrame, *carried: str) -> DataFrame:
    """Runs as nodes of the next level."""
    return runs.select(
        "grp", "place", digest(_joined(F.col("slots"))).alias("node"), F.ceil(F.col("total") / WIDTH).cast("long").alias("total"),
        *carried,
    )


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels above `nodes` (grp, place, node, total) and the top node of each group (grp, node).

    A level has a sixteenth of the rows below it, so that there are as many jobs as a logarithm says.
    """
    levels, tops = [], nodes.where("total = 1").select("grp", "node")
    while True:
        nodes = settled(_above(_runs(nodes.where("total > 1")), "slots"))
        if nodes.isEmpty():
            return levels, tops
        levels.append(nodes)
        tops = tops.unionByName(nodes.where("total = 1").select("grp", "node"))


def _paths(base: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """grp, place, path, subroot of each node of `base`: what surrounds it on its way up, lowest level first.

    `tops` has grp, subroot and the path of each group's top. Going down, a run gives each of its
    slots its own path, led by the slot's surroundings.
    """
    inner = None
    for nodes in [*reversed(levels), base]:
        paths = matched(nodes.where("total = 1").drop("node", "total"), tops, ["grp"])
        if inner is not None:
            paths = paths.unionByName(matched(nodes.where("total > 1").drop("node", "total"), inner, ["grp", "place"]))
        if nodes is not base:
            each = paths.withColumn("__slot", F.explode(F.transform("slots", lambda s: s["slot"])))
            paths = each.select(
                "grp", (F.col("place") * WIDTH + F.col("__slot")).alias("place"),
                F.concat(F.array(_around(F.col("slots"), F.col("__slot"))), F.col("path")).alias("path"), "subroot",
            )
            inner = settled(paths)
    return paths.select("grp", "place", "path", "subroot")


def manifest(
    rows: DataFrame, group: str = "source", altered: dict[str, Column] | None = None, where: Column | None = None,
    columns: tuple[str, ...] = LEAF_COLUMNS,
) -> DataFrame:
    """doc_id, grp, leaf, altered_leaf, subroot, root and proof of each row under a 16-ary Merkle tree.

    A leaf is the digest of the row's `columns`. The leaves of a group (null is one) ascend by
    doc_id, null first; rows of one doc_id ascend by leaf. Every 16 neighbours become the digest
    of their joined digests, up to one subroot of each group (a lone leaf itself); subroots, ordered
    by group (null first, bytewise), likewise become the root. `proof` holds for each level, from
    the leaf's to the root's, the digests before and after the own one as two texts. `altered_leaf`
    is the leaf with the columns of `altered` replaced where `where` holds, else null. Equal rows get
    neighbouring places, in either order; an empty table gives an empty one; other columns
    are ignored. Groups of any size are spread: only runs of 16 nodes and bitmap containers meet.
    """
    changed = [(altered or {}).get(c, F.col(c)) for c in columns]
    light = rows.select(
        F.col(group).cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of([F.col(c) for c in columns]).alias("leaf"),
        (F.when(where, leaf_of(changed)) if altered else F.lit(None).cast("string")).alias("altered"),
    )
    # Equal rows are one leaf with a count until their places are known.
    leaves = settled(light.groupBy("grp", "doc_id", "leaf", "altered").agg(F.count("*").alias("n")))
    first = _each_copy(leaf_places(leaves)).withColumnRenamed("leaf", "node")
    runs = settled(_runs(first, "doc_id", "altered"))
    # A lone leaf is its group's subroot; any other run is a node.
    lone = F.col("total") == 1
    base = settled(runs.select(
        "grp", "place", F.when(lone, F.col("slots")[0]["node"]).otherwise(digest(_joined(F.col("slots")))).alias("node"),
        F.ceil(F.col("total") / WIDTH).cast("long").alias("total"),
    ))
    levels, tops = _levels(base)
    ordered = running_starts(tops.withColumn("one", F.lit(1).cast("long")), ["grp"], "one", "place").drop("one")
    n_groups = ordered.count()
    subroots = settled(ordered.select(
        F.lit("").alias("grp"), "place", "node", F.lit(n_groups).cast("long").alias("total"), F.col("grp").alias("__group")
    ))
    upper, root = _levels(subroots.drop("__group"))
    found = root.first()
    step = "array<struct<before: string, after: string>>"
    end = root.select("grp", F.lit("").alias("subroot"), F.array().cast(step).alias("path"))
    above = matched(subroots, _paths(subroots.drop("__group"), upper, end).drop("subroot"), ["grp", "place"]).select(
        F.col("__group").alias("grp"), F.col("node").alias("subroot"), "path"
    )
    paths = _paths(base, levels, settled(above))
    each = matched(runs, paths, ["grp", "place"]).withColumn("__own", F.explode("slots"))
    own = F.array(_around(F.col("slots"), F.col("__own.slot")))
    return each.select(
        F.col("__own.doc_id").alias("doc_id"), "grp", F.col("__own.node").alias("leaf"), F.col("__own.altered").alias("altered_leaf"),
        "subroot", F.lit(found["node"] if found else None).cast("string").alias("root"),
        F.when(lone, F.col("path")).otherwise(F.concat(own, F.col("path"))).alias("proof"),
    )


def proof_digest(proof: Column) -> Column:
    """Digest of all sibling digests of a proof, level by level."""
    return digest(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.reduce(proof, leaf, lambda node, p: digest(F.concat(p["before"], node, p["after"])))
