"""Exact top-k inner products: norm-sorted blocks, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glosswork.llm.common import prepared, settled

BLOCK = 8192  # candidates that a task holds at once
CHUNK = 2048  # queries that a task holds at once
SLICE = 1 << 16  # pairs whose remaining components are summed at once
STAGES = (1 / 8, 1 / 2)  # shares of the rotated components after which pairs are pruned


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id, v (floor of the scaled components) and norm2 of the rows that have an id and only finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, norms = [], [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    if len(v) and np.abs(v).max() >= 2.0**31 / max(1.0, np.sqrt(len(v))):
                        raise ValueError(f"components of vector {vec_id} are too large for exact scores")
                    ids.append(vec_id)
                    values.append(v.astype(np.int64))
                    norms.append(int((values[-1] * values[-1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.int64())), pa.array(norms, pa.int64())],
                ["vec_id", "v", "norm2"],
            )

    light = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return light.mapInArrow(run, "vec_id long, v array<long>, norm2 long")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as one matrix; shorter vectors end in zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all vectors, largest first, from their second moments summed in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "s"])

    sums = rows.select("v").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
    found = sums.toArrow()  # width * width numbers at most
    moments = np.zeros(width * width)
    moments[found.column("at").to_numpy()] = found.column("s").to_numpy()
    moments = moments.reshape(width, width)
    _, axes = np.linalg.eigh((moments + moments.T) / 2)
    return axes[:, ::-1]


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]]) if len(order) else np.empty(0, bool)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def search_block(
    qid: np.ndarray, q: np.ndarray, least: np.ndarray, xid: np.ndarray, x: np.ndarray, axes: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and exact score of the k best of a block for each query, without those below `least`.

    Partial sums over the leading rotated components plus the product of the remaining lengths
    bound a score from above; only pairs whose bound reaches `least` are summed on, and what is
    left is scored in whole numbers.
    """
    width = len(axes)
    cuts = sorted({max(1, round(width * s)) for s in STAGES} | {width}) if width else []
    qr, xr = q @ axes, x @ axes
    slack = 1e-9 * (1 + np.abs(qr).sum(1).max(initial=0) * (1 + np.abs(xr).sum(1).max(initial=0)))
    rest_q = {c: np.sqrt((qr[:, c:] ** 2).sum(1)) for c in cuts}
    rest_x = {c: np.sqrt((xr[:, c:] ** 2).sum(1)) for c in cuts}
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        rows = slice(at, min(at + 256, len(q)))
        c = cuts[0] if cuts else 0
        partial = qr[rows, :c] @ xr[:, :c].T
        bound = partial + (np.outer(rest_q[c][rows], rest_x[c]) if cuts else 0) + slack
        keep = (bound >= least[rows, None]) & (qid[rows, None] != xid[None, :])
        qi, xi = np.nonzero(keep)
        found = []
        for s in range(0, len(qi), SLICE):
            a, b = qi[s : s + SLICE] + at, xi[s : s + SLICE]
            so_far = partial[a - at, b]
            for low, high in zip(cuts, cuts[1:], strict=False):
                so_far = so_far + np.einsum("ij,ij->i", qr[a, low:high], xr[b, low:high])
                good = so_far + rest_q[high][a] * rest_x[high][b] + slack >= least[a]
                a, b, so_far = a[good], b[good], so_far[good]
            score = np.einsum("ij,ij->i", q[a], x[b])
            best = _best(a, xid[b], score, k)
            found.append((a[best], xid[b][best], score[best]))
        if found:
            a, i, score = (np.concatenate(v) for v in zip(*found, strict=True))
            best = _best(a, i, score, k)
            out.append((qid[a[best]], i[best], score[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _packed(rows: DataFrame, name: str, most: int, width: int) -> DataFrame:
    """Rows (vec_id, v, norm2, least) as blocks of at most `most`: number, largest norm2, ids, vectors, least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                ids, norms, least = (part.column(i).to_numpy() for i in (0, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(norms.max())]), pa.array([float(least.min())]), pa.array([ids.tobytes()]),
                     pa.array([_matrix(part.column(1), width).astype(np.int32).tobytes()]), pa.array([least.tobytes()])],
                    ["norm2", "low", "ids", "vectors", "least"],
                )

    packed = rows.select("vec_id", "v", "norm2", "least").mapInArrow(
        run, "norm2 long, low double, ids binary, vectors binary, least binary"
    )
    return settled(packed.withColumn(name, F.monotonically_increasing_id()))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors by exact whole inner product.

    Components x become floor(scale * x). Queries are the rows where `is_query` holds; candidates
    are all rows but those of the query's own vec_id; ties go to the smaller vec_id; fewer than k
    candidates give fewer rows. Rows without vec_id, without vector, or with null or non-finite
    components take no part; shorter vectors count as ending in zeros. Of repeated query ids the
    largest vector asks; repeated candidates are candidates each. An empty table gives an empty
    one; other columns are ignored. Components too large for exact scores end the job.

    Candidates are ranged by descending norm into blocks. The first block gives every query a
    score to beat. A block of queries meets a block of candidates only if the product of their
    largest norms reaches what its queries need.
    """
    prepared(vectors.sparkSession)
    rows = settled(whole_vectors(vectors, scale))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width, n = facts["width"] or 0, facts["n"]
    axes = principal_axes(rows, width) if width else np.zeros((0, 0))
    order = [F.col("norm2").desc(), F.col("vec_id")]
    blocks = max(1, -(-n // BLOCK))
    ranged = rows.withColumn("least", F.lit(float("-inf"))).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    candidates = _packed(ranged, "block", BLOCK, width)

    head = rows.orderBy(*order).limit(CHUNK).toArrow()  # the longest vectors: a fixed number
    head_id, head_v = head.column("vec_id").to_numpy(), _matrix(head.column("v").combine_chunks(), width)

    def to_beat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            least = np.full(len(ids), -np.inf)
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                scores = (q[part].astype(np.float64) @ head_v.T.astype(np.float64))
                scores[ids[part, None] == head_id[None, :]] = -np.inf
                if len(head_id) >= k:
                    least[part] = np.sort(scores, axis=1)[:, -k]
            # A little lower, so that rounding cannot raise it above a true score.
            least -= 1e-6 * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], ["vec_id", "v", "norm2", "least"])

    asked = vectors.where(is_query).select("vec_id", "embedding")
    asked = whole_vectors(asked, scale).groupBy("vec_id").agg(F.max(F.struct("v", "norm2")).alias("s"))
    asked = asked.select("vec_id", "s.v", "s.norm2").mapInArrow(to_beat, "vec_id long, v array<long>, norm2 long, least double")
    asked = asked.repartitionByRange(max(1, -(-n // (BLOCK * 8))), F.col("norm2").desc(), F.col("vec_id"))
    queries = _packed(asked, "chunk", CHUNK, width)

    # Which blocks meet: by their norms alone, a few bytes for thousands of rows.
    light_b = candidates.select("block", F.col("norm2").alias("bn"))
    light_q = queries.select("chunk", F.col("norm2").alias("qn"), "low")
    meets = F.sqrt(F.col("qn").cast("double")) * F.sqrt(F.col("bn").cast("double")) * (1 + 1e-9) >= F.col("low")
    pairs = light_q.join(F.broadcast(light_b), meets).select("chunk", "block")
    work = pairs.join(queries.select("chunk", F.col("ids").alias("qi"), F.col("vectors").alias("qv"), "least"), "chunk").join(
        candidates.select("block", F.col("ids").alias("xi"), F.col("vectors").alias("xv")), "block"
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qv, least, xi, xv = (batch.column(c)[i].as_py() for c in range(5))
                qid, xid = np.frombuffer(qi, np.int64), np.frombuffer(xi, np.int64)
                q = np.frombuffer(qv, np.int32).reshape(len(qid), width).astype(np.int64)
                x = np.frombuffer(xv, np.int32).reshape(len(xid), width).astype(np.int64)
                found = search_block(qid, q, np.frombuffer(least, np.float64), xid, x, axes, k)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["query_id", "vec_id", "score"])

    found = work.select("qi", "qv", "least", "xi", "xv").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
