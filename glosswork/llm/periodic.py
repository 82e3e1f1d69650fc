"""Periodic runs of words in whole texts, found by block convolution at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import prepared

LEAST_LENGTH = 6  # words of a run
LEAST_TURNS = 4  # periods that a run holds
PRIME = 7_340_033  # 7 * 2**20 + 1: 128 products of residues still add up exactly in a double
ROOT = 3  # generates the residues of PRIME
RADIX = 128  # transforms up to this size are one matrix product
BLOCK = 1 << 13  # words of a block at most; beyond it a scale has several windows for each block
CELLS = 1 << 16  # numbers that one step of the convolution holds
WORDS = 1 << 18  # words of neighbouring texts that are searched at once; a longer text is searched alone


def _reduced(x: np.ndarray) -> np.ndarray:
    """Residues of whole doubles below 2**53; a multiple of the prime gives exactly 0, others may come as -1."""
    return x - PRIME * np.floor(x / PRIME)


@lru_cache(maxsize=64)
def _powers(root: int, rows: int, columns: int, order: int) -> np.ndarray:
    """root ** (row * column), where root has the given order."""
    row = np.ones(order, np.float64)
    for i in range(1, order):
        row[i] = int(row[i - 1]) * root % PRIME
    return row[np.outer(np.arange(rows), np.arange(columns)) % order]


def transform(x: np.ndarray, root: int) -> np.ndarray:
    """Number-theoretic transform of each row; `root` has the order of a row's length, a power of two."""
    rows, n = x.shape
    if n <= RADIX:
        return _reduced(x @ _powers(root, n, n, n))
    rest = n // RADIX
    y = np.matmul(_powers(pow(root, rest, PRIME), RADIX, RADIX, RADIX), x.reshape(rows, RADIX, rest))
    y = _reduced(_reduced(y) * _powers(root, RADIX, rest, n))
    y = transform(y.reshape(rows * RADIX, rest), pow(root, RADIX, PRIME)).reshape(rows, RADIX, rest)
    return y.transpose(0, 2, 1).reshape(rows, n)


@lru_cache(maxsize=64)
def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of small transforms: of rows that end in n / 2 zeros, and back to -2 times the first n / 2 places."""
    root = pow(ROOT, (PRIME - 1) // n, PRIME)
    there, back = _powers(root, n, n, n), _powers(pow(root, PRIME - 2, PRIME), n, n, n)
    return there[: n // 2].copy(), _reduced(back[:, : n // 2] * float(-2 * pow(n, PRIME - 2, PRIME) % PRIME))


def _spectra(blocks: np.ndarray) -> np.ndarray:
    """Transforms of rows of b residues followed by b zeros."""
    b = blocks.shape[1]
    if 2 * b <= RADIX:
        return _reduced(blocks @ _halves(2 * b)[0])
    return transform(np.pad(blocks, ((0, 0), (0, b))), pow(ROOT, (PRIME - 1) // (2 * b), PRIME))


def _minus_twice_products(block: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """-2 times the inner products of blocks with their windows (of two blocks each) at shifts 0 to b - 1, from spectra.

    The result is a whole number below 2**53, not reduced.
    """
    n = block.shape[1]
    signs = 1.0 - 2.0 * (np.arange(n) % 2)  # a shift by half the length
    mixed = _reduced(block[:, -np.arange(n) % n] * (one + signs * two))
    if n <= RADIX:
        return mixed @ _halves(n)[1]
    back = pow(ROOT, (PRIME - 1) // n * (n - 1), PRIME)
    return transform(mixed, back)[:, : n // 2] * float(-2 * pow(n, PRIME - 2, PRIME) % PRIME)


def _agreeing(codes: np.ndarray, at: np.ndarray, shift: np.ndarray, step: int) -> np.ndarray:
    """For how many places on from `at`, in direction `step`, a word equals the one `shift` later.

    A separator at either end of `codes` equals no other place, so every count ends before it.
    """
    count = np.zeros(len(at), np.int64)
    live, width = np.arange(len(at)), 16
    while len(live):
        going = []
        for part in np.array_split(live, max(1, len(live) * width // CELLS)):
            left = (at[part] + step * count[part])[:, None] + step * np.arange(width)
            last = len(codes) - 1
            right = np.clip(left + shift[part][:, None], 0, last)
            differs = codes[np.clip(left, 0, last)] != codes[right]
            found = differs.any(axis=1)
            count[part] += np.where(found, differs.argmax(axis=1), width)
            going.append(part[~found])
        live, width = np.concatenate(going), min(2 * width, CELLS)
    return count


def _verified(codes: np.ndarray, at: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """Whether `width` words from `at` equal those `shift` later, word for word."""
    good = np.ones(len(at), bool)
    steps = np.arange(width)
    for part in np.array_split(np.arange(len(at)), max(1, len(at) * width // CELLS)):
        left = at[part][:, None] + steps
        good[part] = (codes[left] == codes[left + shift[part][:, None]]).all(axis=1)
    return good


def _seeds(residues: np.ndarray, sums: np.ndarray, starts: np.ndarray, scale: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block starts and distances in [scale, 2 * scale) where a block meets the words after it with zero mismatch.

    The sum of squared differences is that of the block, plus that of the window's words, less
    twice their products, all modulo the prime: a place that truly has no mismatch is always among the
    results. `sums` are the running sums of squares.
    """
    # Texts are followed by as many separators as the farthest window needs.
    size = len(residues) - 3 * scale
    squares = _reduced(sums[block : block + size + 2 * scale] - sums[: size + 2 * scale])
    rows = residues[: len(residues) // block * block].reshape(-1, block)
    shifted = np.lib.stride_tricks.sliding_window_view(squares, block)
    for part in np.array_split(starts // block, max(1, len(starts) * 2 * block // CELLS)):
        for first in range(scale, 2 * scale, block):
            one = part + first // block
            least = part[0]
            wanted = np.zeros(one[-1] + 2 - least, bool)
            for blocks in (part, one, one + 1):
                wanted[blocks - least] = True
            spectra, place = _spectra(rows[least:][np.flatnonzero(wanted)]), np.cumsum(wanted) - 1
            own, near, far = (spectra[place[blocks - least]] for blocks in (part, one, one + 1))
            at = part * block
            total = _minus_twice_products(own, near, far) + shifted[at + first] + squares[at][:, None]
            k, shifts = np.nonzero(_reduced(total) == 0)
            found, distance = at[k], first + shifts
            inside = found + distance + block <= size
            yield found[inside], distance[inside]


def runs_of(codes: np.ndarray, room: np.ndarray, length: int = LEAST_LENGTH, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """start, end and smallest period of every maximal run in a row of texts with separators around each.

    `codes` are whole numbers, separators unlike each other and all words; `room` is the number of
    words of the text at each place. A run of period q holds, for the scale s that is the largest
    power of two up to q, a block that starts at a multiple of s and its copy q later: it has
    at least 4 q words, and s - 1 + s + q are fewer.
    """
    whole_residues = (codes % PRIME).astype(np.float64)
    period = np.zeros(len(codes), np.int64)  # of a run known at each place
    until = np.zeros(len(codes), np.int64)
    found: dict[tuple[int, int], int] = {}
    most, scale = int(room.max(initial=0)), 1
    while max(length, turns * scale) <= most:
        block = min(scale, BLOCK)
        starts = np.arange(0, len(codes), scale)
        starts = starts[room[starts] >= max(length, turns * scale)]
        residues = np.pad(whole_residues, (0, 3 * scale), mode="edge")
        sums = np.concatenate([[0.0], np.cumsum(_reduced(residues * residues))])
        pairs = list(_seeds(residues, sums, starts, scale, block))
        at, shift = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (starts[:0], starts[:0])
        # A seed inside a known run whose period divides the distance leads to that run again.
        known = (period[at] > 0) & (shift % np.maximum(period[at], 1) == 0) & (at + shift + block <= until[at])
        at, shift = at[~known], shift[~known]
        good = _verified(codes, at, shift, block)
        at, shift = at[good], shift[good]
        order = np.lexsort((at, shift))
        at, shift = at[order], shift[order]
        # Neighbouring blocks at one distance are one seed.
        joined = (np.diff(shift) == 0) & (np.diff(at) == block) if block == scale else np.zeros(max(len(at) - 1, 0), bool)
        first = np.flatnonzero(np.concatenate([[True], ~joined])) if len(at) else np.empty(0, np.int64)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        distance = shift[first]
        begin = at[first] - _agreeing(codes, at[first] - 1, distance, -1)
        end = at[last] + block + distance
        end = end + _agreeing(codes, end - distance, distance, 1)
        whole = end - begin >= np.maximum(length, turns * distance)
        for s, e, q in sorted(set(zip(begin[whole].tolist(), end[whole].tolist(), distance[whole].tolist(), strict=True)), key=lambda r: r[2]):
            if (s, e) not in found:  # one known already has a smaller period
                found[s, e] = q
                free = period[s:e] == 0
                period[s:e][free] = q
                until[s:e][free] = e
        scale *= 2
    return [(s, e, q) for (s, e), q in found.items()]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """start, length and period of each run of each text (a list of words), by start, then period."""
    ids: dict[bytes, int] = {}
    n = sum(map(len, texts)) + len(texts) + 1
    codes, room = np.empty(n, np.int64), np.zeros(n, np.int64)
    starts, at = [], 0
    for words in texts:
        codes[at] = -1 - len(starts)
        at += 1
        starts.append(at)
        new = [w for w in set(words) if w not in ids]
        ids.update(zip(new, count(len(ids)), strict=False))
        codes[at : at + len(words)] = list(map(ids.__getitem__, words))
        room[at : at + len(words)] = len(words)
        at += len(words)
    codes[at] = -1 - len(starts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = sorted(runs_of(codes, room), key=lambda r: (r[0], r[2]))
    place = np.searchsorted(starts, [s for s, _, _ in runs], side="right") - 1
    for (s, e, q), k in zip(runs, place.tolist(), strict=True):
        out[k].append((s - starts[k], e - s, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of every run's repeats, joined by one space: of each run its first period stays."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, text: Column) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: word numbers from 0) and collapsed text of each row.

    Words are separated by the six ASCII white-space characters. A run is a stretch of at least 6
    words and 4 times its smallest period that cannot be extended. Runs come by start, then period. In the
    collapsed text each run keeps its first period only. Null, empty and blank texts have no words,
    no runs and an empty collapsed text; repeated rows count each; an empty table gives an empty
    one; other columns are ignored. Whole texts are searched, neighbouring short ones of a batch at
    once; memory grows with the longest text.
    """
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < batch.num_rows:
                texts, words = [], 0
                while first + len(texts) < batch.num_rows and words < WORDS:
                    texts.append((batch.column(1)[first + len(texts)].as_py() or b"").split())
                    words += len(texts[-1])
                runs = runs_of_texts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs], kind),
                        pa.array([collapsed(t, rs) for t, rs in zip(texts, runs, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )
                first += len(texts)

    prepared(docs.sparkSession)
    light = docs.select("doc_id", text.cast("string").cast("binary").alias("__text"))
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return light.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, ties to the smallest start, then period; null without runs."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (x > y) | ((x == y) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))))

    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))


def with_planted_repeats(text: Column, doc_id: Column) -> Column:
    """The text, of which every tenth (by the checksum of doc_id) has its tail replaced by repeats of a part of it."""
    mark = F.crc32(doc_id.cast("string").cast("binary"))
    group = F.floor(mark / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        first = (group % n).cast("int")
        period = (F.floor((n - first) / (3 + group % 8)) + 1).cast("int")
        state = F.struct(words.alias("words"), first.alias("first"), period.alias("period"))
        # Arrays of one element keep the words and both numbers computed once.
        return F.transform(F.array(state), lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0), F.size(s["words"]) - 1),
            lambda i: F.get(s["words"], F.when(i < s["first"], i).otherwise(s["first"] + (i - s["first"]) % s["period"])),
        ), " "))[0]

    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return F.when(mark % 10 == 0, planted).otherwise(text)
