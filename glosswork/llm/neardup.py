"""Near-duplicate documents by HyperMinHash registers, banded, and exact links on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import components, prepared, settled

BANDS, ROWS = 32, 4  # 128 registers; a pair at 0.8 shares no band with a chance of 5 in 100 million
MANTISSA = 10  # bits kept behind the leading one
EMPTY = 0xFFFF
_LENDERS = np.argsort(np.random.default_rng(11).random((BANDS * ROWS, BANDS * ROWS)), axis=1)  # where an empty bucket looks, in order
SIMILAR = 80  # percent of the union
COLLISION = 2.0**-MANTISSA / 3  # chance that two different minima fall into one register value
SIGMAS = 6  # pairs are verified unless their estimate lies this far below the threshold
CROWDED = 500  # pairs across components in a bucket from which its members are compared in blocks
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19  # members, and values of their sets, in a block
FILTER_BITS = 24  # log2 of the bits that pre-select documents whose sets are read
WORDS_KEPT = 400_000  # word hashes that a worker keeps


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_set(text: bytes | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit values of a text's word shingles, A-Z lowered; fewer words are one shingle, none is empty."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    take = min(size, len(words))
    with np.errstate(over="ignore"):
        value = np.full(n, take, np.uint64)
        for j in range(take):
            value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
            value ^= value >> np.uint64(32)
        return np.unique(_mix(value))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Per bucket of the value's top bits: leading zeros and mantissa bits of the smallest value.

    An empty bucket takes the register of the first filled one in an order of its own, so that
    short texts fill every band and a register agrees with the chance of the similarity. Without
    shingles all are EMPTY.
    """
    count = BANDS * ROWS
    top = count.bit_length() - 1
    out = np.full(count, EMPTY, np.uint16)
    if not len(shingles):
        return out
    bucket = (shingles >> np.uint64(64 - top)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    low = (shingles[first] << np.uint64(top)) >> np.uint64(12)  # 52 bits: exact as doubles
    fraction, bits = np.frexp(low.astype(np.float64))  # fraction in [1/2, 1)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    value = ((52 - bits).astype(np.int64) << MANTISSA) | np.where(low == 0, 0, mantissa)
    out[bucket[first]] = value.astype(np.uint16)
    if len(first) < count:
        filled = np.zeros(count, bool)
        filled[bucket[first]] = True
        bare = np.flatnonzero(~filled)
        out[bare] = out[_LENDERS[bare, filled[_LENDERS[bare]].argmax(1)]]
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, size: int = 2, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, digest of the shingle set, its registers as one long for each band, and the carried columns."""
    n = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(text.as_py(), size)
                counts.append(len(shingles))
                digests.append(_digest(shingles))
                bands.append(registers(shingles).view(np.int64))
            offsets = np.arange(len(bands) + 1, dtype=np.int32) * BANDS
            values = np.concatenate(bands) if bands else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), *batch.columns[2 : 2 + n]],
                ["doc_id", "n_shingles", "digest", "bands", *carried],
            )

    prepared(docs.sparkSession)
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *carried
    )
    more = "".join(f", {c} {light.schema[c].dataType.simpleString()}" for c in carried)
    return light.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>" + more)


def estimated(a: Column, b: Column) -> Column:
    """Jaccard estimate of two band arrays: equal registers of those in use, less the expected collisions."""

    def lanes(x: Column, value: int) -> Column:
        hits = [
            F.when(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) == value, 1).otherwise(0) for i in range(ROWS)
        ]
        return sum(hits[1:], hits[0])

    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    counted = F.reduce(
        both,
        F.struct(F.lit(0).alias("same"), F.lit(0).alias("empty")),
        lambda s, v: F.struct(
            (s["same"] + lanes(v["x"].bitwiseXOR(v["y"]), 0)).alias("same"),
            (s["empty"] + lanes(v["x"].bitwiseAND(v["y"]), EMPTY)).alias("empty"),
        ),
    )
    return F.transform(
        F.array(counted),
        lambda s: F.struct(
            (((s["same"] - s["empty"]) / (BANDS * ROWS - s["empty"]) - COLLISION) / (1 - COLLISION)).alias("jaccard"),
            (BANDS * ROWS - s["empty"]).alias("used"),
        ),
    )[0]


def _likely(pairs: DataFrame, classes: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) whose estimate does not lie SIGMAS standard errors below the threshold."""
    side = classes.select("id", "bands")
    at = similar / 100
    joined = pairs.join(side.select(F.col("id").alias("a"), F.col("bands").alias("__x")), "a").join(
        side.select(F.col("id").alias("b"), F.col("bands").alias("__y")), "b"
    ).withColumn("__e", estimated(F.col("__x"), F.col("__y")))
    error = SIGMAS * F.sqrt(F.lit(at * (1 - at)) / F.col("__e.used"))
    return joined.where(F.col("__e.jaccard") >= at - error).select("a", "b")


def _sets(docs: DataFrame, named: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """`id` and shingle set of the classes that `named` (column id) lists, read from one document of each.

    Documents are pre-selected by a bit for each hashed doc_id, in a table of fixed size; whatever
    else passes it, and other texts under the same doc_id, fall out of the join. Texts are not shuffled.
    """
    named = settled(named.distinct().join(classes.select("id", "doc_id", "digest"), "id"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = named.select(
        F.shiftright(bit, 5).cast("int").alias("w"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("m"),
    )
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # at most 2 ** (FILTER_BITS - 5) rows
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[rows.column("w").to_numpy()] = rows.column("m").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint32)
        for batch in batches:
            place = batch.column(1).to_numpy()
            hit = np.flatnonzero((table[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1))
            texts = batch.column(2)
            values = [shingle_set(texts[int(i)].as_py(), size) for i in hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hit)), pa.array([_digest(v) for v in values], pa.binary()),
                 pa.array([v.tobytes() for v in values], pa.binary())],
                ["doc_id", "digest", "shingles"],
            )

    light = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).select("doc_id", bit.alias("bit"), "text")
    found = light.mapInArrow(sets, "doc_id long, digest binary, shingles binary")
    # Repeated rows of a document count once.
    return settled(found.join(named, ["doc_id", "digest"]).select("id", "shingles").dropDuplicates(["id"]))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))


def _verified(pairs: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """Those of the pairs (a, b) of document ids whose full shingle sets are similar enough."""

    def similar_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= similar * (len(p) + len(q) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    both = pairs.join(found.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        found.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    return settled(both.select("a", "b", "x", "y").mapInArrow(similar_sets, "a long, b long"))


def block_links(
    ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, similar: int
) -> list[tuple[int, int]]:
    """Links between different labels among the documents of one block, or across the two sides if there are two.

    Every such pair is compared on its full sets, unless links found before have already joined
    its labels; so at most one link for each label comes out.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    flat = np.concatenate([sets[i] for i in order])
    values, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes[order])])
    group = np.unique(labels, return_inverse=True)[1][order]
    side, size, name = sides[order], sizes[order], ids[order]
    two = len(set(sides.tolist())) > 1
    mark = np.zeros(len(values), np.int64)
    links = []
    for i in range(len(order) - 1):
        # Sets are ordered by size: partners reach up to the size that still allows the similarity.
        end = int(np.searchsorted(size, 100 * size[i] / similar, "right"))
        if end <= i + 1:
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat[starts[i + 1] : starts[end]]], starts[i + 1 : end] - starts[i + 1])
        mark[own] = 0
        near = 100 * common >= similar * (size[i] + size[i + 1 : end] - common)
        for j in np.flatnonzero(near) + i + 1:
            if group[i] != group[j] and not (two and side[i] == side[j]):
                group[group == group[j]] = group[i]
                links.append((int(name[i]), int(name[j])))
    return links


def _crowded_links(members: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """Links across components among the members (key, id, n, component) of crowded buckets.

    A bucket's members are dealt into blocks of bounded size, and each pair of blocks meets in a
    task that gives no more links than it has members.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = members.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "component"
    )

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        links = block_links(pdf["id"].to_numpy(), pdf["component"].to_numpy(), sets, pdf["own"].to_numpy(), similar)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return settled(met.join(found, "id").groupBy("key", "low", "high").applyInPandas(compare, "a long, b long"))


def _crossing(members: DataFrame, similar: int) -> DataFrame:
    """Pairs (a < b) of members (key, id, n, component) of one bucket that lie in different components.

    Members are joined through the pairs of components in their bucket, so that a component of
    any size is never held against itself.
    """
    sides = members.select("key", "component").distinct()
    two = sides.withColumnRenamed("component", "ca").join(
        sides.withColumnRenamed("component", "cb"), "key"
    ).where("ca < cb")
    x = members.select("key", F.col("component").alias("ca"), F.col("id").alias("x"), F.col("n").alias("nx"))
    y = members.select("key", F.col("component").alias("cb"), F.col("id").alias("y"), F.col("n").alias("ny"))
    pairs = two.join(x, ["key", "ca"]).join(y, ["key", "cb"])
    near = (100 * F.least("nx", "ny") >= similar * F.greatest("nx", "ny"))
    return pairs.where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 2, similar: int = SIMILAR, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept and component, for every row of `docs`.

    Two documents are linked if the intersection of their shingle sets is at least `similar`
    percent of the union. Documents of one set are one class. Classes that share a band of
    compressed registers are candidates: first each class is held against the class of smallest
    id in the bucket that it shares most bands with; verified links form components. Then every
    pair of one bucket that still lies in different components is estimated from the registers
    and, unless clearly below the threshold, verified. Buckets where many such pairs meet are
    compared in blocks inside tasks, which hand out links only, one for each component at most.

    Null and empty texts have no shingles and are linked with nothing. Rows without a doc_id take
    no part: their component_id is null and they are kept. Rows of one doc_id with one set are one document;
    with different sets they are documents of their own, whose components may both bear that id. `component` numbers the
    components without regard to ids (null: takes no part). An empty table gives an empty one.
    Columns in `carried` come along; others are ignored.
    """
    light = settled(signatures(docs, size, carried))
    taking = light.where("doc_id is not null and n_shingles > 0")
    classes = settled(taking.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    ).withColumn("id", F.monotonically_increasing_id()))
    rows = classes.select("id", "n", F.posexplode("bands").alias("band", "value")).where("value <> -1").select(
        F.xxhash64("band", "value").alias("key"), "id", "n"
    )
    buckets = settled(rows.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("m")).where("m > 1").select("key", "center"))
    members = settled(rows.join(buckets, "key"))
    shares = members.where("id <> center").groupBy("id", "center").agg(F.count("*").alias("m"))
    stars = settled(
        shares.groupBy("id").agg(F.max_by("center", F.struct(F.col("m"), -F.col("center"))).alias("b"))
        .select(F.col("id").alias("a"), "b")
    )
    links = _verified(stars, _sets(docs, _ends(stars), classes, size), similar)
    found = components(links)

    labelled = settled(members.join(found.select(F.col("id").alias("__id"), "component"), F.col("id") == F.col("__id"), "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")
    ))
    shares = labelled.groupBy("key", "component").agg(F.count("*").alias("m"))
    meeting = shares.groupBy("key").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("across")).where("across > 0")
    open_rows = settled(labelled.join(meeting, "key"))
    crowded = open_rows.where(F.col("across") > 2 * CROWDED).drop("across")
    pairs = _crossing(open_rows.where(F.col("across") <= 2 * CROWDED).drop("across"), similar)
    # Pairs of the first round that are still apart were found unlike.
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = settled(_likely(pairs.join(tried, ["a", "b"], "left_anti"), classes, similar))
    sets = _sets(docs, _ends(likely).union(crowded.select("id")), classes, size)
    more = _verified(likely, sets, similar).union(_crowded_links(crowded, sets, similar))
    final = settled(components(links.union(more)).join(classes.select("id", "doc_id"), "id"))
    least = final.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = final.join(least, "component").select(F.col("id").alias("__id"), "component", "component_id")
    class_of = settled(classes.join(linked, F.col("id") == F.col("__id"), "left").select(
        F.col("digest").alias("__digest"), F.coalesce("component", "id").alias("component"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    ))
    light = light.select("doc_id", "n_shingles", "digest", *carried)
    joined = light.join(class_of, F.col("digest") == F.col("__digest"), "left")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id", "n_shingles", F.when(takes_part, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(takes_part, F.col("component")).alias("component"), *carried,
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
