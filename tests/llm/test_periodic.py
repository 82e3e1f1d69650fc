"""Periodic runs against a plain search at every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import periodic
from glosswork.llm.queries import QUERIES


def plain_runs(words):
    """All runs by comparing the words at every period; of equal stretches the smallest period counts."""
    ids, found = {}, {}
    a = np.array([ids.setdefault(w, len(ids)) for w in words])
    for q in range(1, len(words) // 4 + 1):
        steps = np.diff(np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(steps == 1).tolist(), (np.flatnonzero(steps == -1) + q).tolist(), strict=True):
            if e - s >= max(6, 4 * q):
                found.setdefault((s, e), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def figures(doc_id, text):
    """What the query returns for a document, by a plain computation of its contract."""
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join("%d,%d,%d\n" % r for r in runs).encode()
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *head, hashlib.sha256(lines).hexdigest(), hashlib.sha256(rest).hexdigest()


def mixed_words(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([0, 1, 5, 6, 7, 23, 64, 150]))]
    while len(words) > 8 and rng.random() < 0.7:
        p, s, m = rng.randint(1, len(words) // 4), rng.randrange(len(words)), rng.randint(1, len(words))
        for i in range(s + p, min(len(words), s + m)):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_neighbouring_texts(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [mixed_words(rng) for _ in range(rng.randint(1, 6))]
        assert periodic.runs_of_texts(texts) == [plain_runs(w) for w in texts]


@pytest.mark.parametrize("block", [1, 4, 16])
def test_blocks_shorter_than_their_scale(monkeypatch, block):
    """Past the largest block a scale has several windows for each block."""
    monkeypatch.setattr(periodic, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(40):
        texts = [mixed_words(rng) for _ in range(3)]
        assert periodic.runs_of_texts(texts) == [plain_runs(w) for w in texts]


@pytest.mark.parametrize("n", [2, 8, 64, 128, 256, 2048, 16384])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, periodic.PRIME, (2, n))
    root = pow(periodic.ROOT, (periodic.PRIME - 1) // n, periodic.PRIME)
    got = periodic.transform(x.astype(float), root).astype(np.int64) % periodic.PRIME
    for k in {0, 1, n // 2, n - 1}:
        powers = [pow(root, k * j % n, periodic.PRIME) for j in range(n)]
        assert [sum(int(a) * b for a, b in zip(row, powers, strict=True)) % periodic.PRIME for row in x] == got[:, k].tolist()


def test_long_texts():
    letters, more = [b"a"], [b"a", b"b"]
    while len(more) < 30_000:
        letters, more = more, more + letters
    assert periodic.runs_of_texts([more]) == [[]]  # a Fibonacci word holds no fourth power
    for words, runs in [
        ([b"x"] * 100_000, [(0, 100_000, 1)]),
        ([b"%d" % (i % 9_000) for i in range(36_000)], [(0, 36_000, 9_000)]),
        ([b"%d" % (i % 9_000) for i in range(35_999)], []),
        ([b"%d" % (i % 12_345) for i in range(60_000)] + [b"z"], [(0, 60_000, 12_345)]),
    ]:
        assert periodic.runs_of_texts([words]) == [runs]


def test_query_against_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if len(r.text or "") < 30_000:
            assert got[r.doc_id] == figures(r.doc_id, r.text)


def test_edges(spark, tmp_path):
    """Null and empty columns, ties, repeated rows, clashing and extra columns."""
    rows = [
        (None, None, "s"), (None, "a " * 8, "s"), (1, None, None), (2, "", "s"), (3, " \t\r\n", "s"),
        (4, "b " * 5, "s"), (4, "b  " * 6, "s"), (5, "x y x y x y x y tail", "s"), (5, "x y x y x y x y tail", "s"),
        (6, "éé " * 7 + "end", "s"),
    ] + [(i, "p q r s " * 9, "s") for i in range(100, 160)]
    docs = spark.createDataFrame(
        [(*r, 1, 2, "runs") for r in rows], "doc_id long, text string, source string, n_words int, start int, runs string"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((figures(i, t) for i, t, _ in rows), key=str)
    found = {tuple(r) for r in periodic.find_runs(docs, F.col("text")).select("doc_id", "collapsed").collect()}
    assert (5, "x y tail") in found and (None, "a") in found and (6, "éé end") in found
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_periodic_runs"](spark, f"{tmp_path}/none").count() == 0
