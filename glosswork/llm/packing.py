"""Best-fit packing of token sequences, certified by lower bounds on the number of bins."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import numbered, prepared, settled

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
PART_PIECES = 32_768  # pieces that one task packs: large enough to lose less than a bin in thousands
ROUNDS = 3  # exchanges between partitions whose bin count is not certified
CACHE_WORDS = 1_000_000  # token ids of words that a worker keeps
CACHE_CHARS = 64  # longer words are not kept


class WordIds(dict):
    """Little-endian ids of a lower-case word without white space, made once for each word.

    The tokenizer splits at white space before anything else, so a text's ids are its words' ids.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, word: bytes) -> bytes:
        if not word:
            return b""
        text = word.decode("utf-8", "replace")
        stem = text.rstrip(".,")
        # Letters end where the marks begin, unless the last one gains a combining mark when it is normalized.
        if stem and len(stem) < len(text) and stem[-1].isalpha() and unicodedata.normalize("NFC", stem.lower())[-1].isalpha():
            ids = self[stem.encode()] + self[text[len(stem):].encode()]
        else:
            ids = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(text) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        plain = text.replace(b"\n", b" ").replace(b"\t", b" ").replace(b"\r", b" ")
        # Marks of special tokens are matched as written, before letters are lowered.
        words = (plain if b"<|" in plain else plain.lower()).split(b" ")
        return b"".join(map(self.__getitem__, words))


_WORDS: dict[str, WordIds] = {}


def _words(path: str) -> WordIds:
    if path not in _WORDS:
        from tokenizers import Tokenizer

        _WORDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORDS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text (null: empty) and then `end_id`. Documents longer than
    the capacity are cut into full pieces and a last one; others are one piece. Repeated rows give
    repeated pieces, a null doc_id stays null, other columns are ignored.
    """
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = words.of(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    chunk = raw[at : at + 4 * capacity]
                    values = (doc_id, piece, at // 4, len(chunk) // 4, zlib.crc32(chunk))
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
                    if with_ids:
                        rows[5].append(np.frombuffer(chunk, "<u4"))
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                kinds, names = [*kinds, pa.list_(pa.int64())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=False)], names)

    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def bins_needed(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound on bins that three families of dual feasible functions give.

    Each maps sizes so that no full bin's images pass 1; the sum of all images, rounded up, is a
    bound. Counted over the histogram of sizes: rounding to k parts, dropping sizes below a
    threshold while rounding their complements up, and counting small parts of the threshold.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        image = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in 1 / (capacity * k)
        best = max(best, -(-int((counts * image).sum()) // (capacity * k)))
    for low in range(1, capacity // 2 + 1):
        image = np.where(x > capacity - low, capacity, np.where(x < low, 0, x))
        best = max(best, -(-int((counts * image).sum()) // capacity))
        parts = capacity // low
        large = 2 * x > capacity
        image = np.where(large, parts - (capacity - x) // low, np.where(x < low, 0, 1))
        best = max(best, -(-int((counts * image).sum()) // parts))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}  # by room left
    rooms: list[int] = []
    used = 0
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del rooms[at]
        else:
            room, b, used = capacity, used, used + 1
        bin_of[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            same = open_bins.setdefault(left, [])
            if not same:
                insort(rooms, left)
            same.append(b)
    return bin_of, offset, used


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """`pieces` with sequence_id and offset: which sequence takes a piece and where.

    Pieces that fill a sequence take one each. The others are dealt at random into partitions of
    about `part_pieces`, packed there by best-fit decreasing, and each partition's bins are held
    against a lower bound. Partitions above their bound swap documents in pairs, by their rank in a new order in each
    round, the last of an odd number with a certified partition, and are packed again; a pair keeps the
    new packing if it needs fewer bins. Gaps that are left after `rounds` show in `certificates`. Only lengths are
    packed: token ids in a column `ids` are joined to their places afterwards. A piece longer than
    the capacity is an error. An empty table gives an empty one.
    """
    prepared(pieces.sparkSession)
    columns = pieces.columns
    carried = ["__row", *[c for c in columns if c != "ids"]]
    pieces = settled(pieces.withColumn("__row", F.monotonically_increasing_id()))
    n = pieces.where(F.col("length") < capacity).count()
    parts = max(1, -(-n // part_pieces))
    names = ["__part", "__bin", "__offset", "__gap"]
    schema = pieces.limit(0).select(*carried, *[F.lit(0).cast("long").alias(x) for x in names]).schema

    def fit(pdf: pd.DataFrame, part: int) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy(np.int64)
        if (lengths > capacity).any():
            raise ValueError("a piece is longer than a sequence")
        bin_of, offset, used = best_fit_decreasing(lengths, capacity)
        gap = used - bins_needed(lengths, capacity)
        return pdf.assign(__part=part, __bin=bin_of, __offset=offset, __gap=gap)

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fit(pdf.sort_values(["length", "__row"]), int(key[0]))[carried + names]

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="__group").sort_values(["__part", "__bin", "__offset"])
        owners = sorted(pdf["__part"].unique())
        before = sum(pdf.loc[pdf["__part"] == p, "__bin"].nunique() for p in owners)
        # Every second bin of each partition changes hands, then each side is packed anew.
        side = (pdf["__bin"].to_numpy() + np.searchsorted(owners, pdf["__part"].to_numpy())) % max(len(owners), 1)
        made = [fit(pdf[side == i], int(p)) for i, p in enumerate(owners) if (side == i).any()]
        whole = fit(pdf, int(owners[0]))
        swapped = sum(m["__bin"].nunique() for m in made)
        alone = whole["__bin"].nunique()
        if min(swapped, alone) < before:
            pdf = whole if alone <= swapped else pd.concat(made)
        return pdf[carried + names]

    # By the place in the written table, so that repeated rows spread too.
    dealt = pieces.where(F.col("length") != capacity).select(*carried).withColumn(
        "__part", F.pmod(F.xxhash64("__row"), F.lit(parts))
    )
    packed = settled(dealt.groupBy("__part").applyInPandas(first, schema))
    for k in range(rounds):
        states = settled(packed.select("__part", "__gap").distinct())
        gapped = states.where("__gap > 0").select("__part")
        n_gapped = gapped.count()
        certified = states.where("__gap <= 0").orderBy("__part").select("__part").first() if n_gapped % 2 else None
        if not n_gapped or (n_gapped == 1 and certified is None):
            break
        ranked = numbered(gapped, F.xxhash64("__part", F.lit(k)), F.col("__part"), name="__group")
        pairs = ranked.select("__part", F.floor(F.col("__group") / 2).cast("long").alias("__group"))
        if certified is not None:
            partner = gapped.sparkSession.range(1).select(
                F.lit(certified["__part"]).cast("long").alias("__part"), F.lit(n_gapped // 2).cast("long").alias("__group")
            )
            pairs = pairs.unionByName(partner)
        pairs = settled(pairs)
        redone = packed.join(pairs, "__part").select(*packed.columns, "__group").groupBy("__group").applyInPandas(again, schema)
        packed = settled(packed.join(pairs, "__part", "left_anti").select(*packed.columns).unionByName(redone))
    full = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = packed.select(
        *carried, (F.shiftleft(F.col("__part"), 40) + F.col("__bin")).alias("sequence_id"), F.col("__offset").alias("offset")
    )
    if "ids" in columns:
        rest = rest.join(pieces.select("__row", "ids"), "__row")
    return full.unionByName(rest.select(*full.columns))


def certificates(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """part, bins, bound and certified of each partition of a packing: its sequences, and how few its pieces could need.

    Full pieces need none. Only counts of lengths meet.
    """
    part = F.shiftright("sequence_id", 40)
    rows = packed.where("sequence_id >= 0").select(part.alias("part"), "sequence_id", "length")
    bins = rows.groupBy("part").agg(F.countDistinct("sequence_id").alias("bins"))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))

    def bound(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = np.repeat(pdf["length"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"part": [key[0]], "bound": [bins_needed(lengths, capacity)]})

    prepared(packed.sparkSession)
    bounds = counts.groupBy("part").applyInPandas(bound, "part long, bound long")
    return bins.join(bounds, "part").select("part", "bins", "bound", (F.col("bins") == F.col("bound")).alias("certified"))


def best_fit_packing(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
    part_pieces: int = PART_PIECES, with_ids: bool = False,
) -> DataFrame:
    """Pack whole documents into sequences: the pieces of `tokenized_pieces` with sequence_id and offset.

    With `with_ids` the token ids travel along and the rows of a sequence, by offset, are its content.
    """
    return pack(tokenized_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity, part_pieces)
