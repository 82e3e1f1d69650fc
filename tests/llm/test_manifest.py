"""The Merkle manifest against a plain computation."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from glosswork.llm import manifest
from glosswork.llm.queries import QUERIES

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = [None if v is None else str(v) for v in row]
    return h("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def tree(nodes):
    """The top of a list of nodes, and for each of them the runs on its way: (own slot, digests of the run)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(places):
            paths[k].append((p % 16, runs[p // 16]))
        places = [p // 16 for p in places]
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows):
    """What the query returns for rows of COLUMNS."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, upper = tree([tops[s][0] for s in order]) if order else (None, [])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (_, _, own, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), tops[s][1], strict=True):
            whole = path + above
            proof = h("".join(d for slot, run in whole for i, d in enumerate(run) if i != slot))
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                text = None if row[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf((*row[:4], text))
            for slot, run in whole:
                node = h("".join(run[:slot]) + node + "".join(run[slot + 1 :]))
            out.append((row[0], own, tops[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def got(spark, folder):
    return sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(folder)).collect()), key=str)


def test_query_against_plain_computation(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    assert got(spark, sf_dir) == plain(rows)


SHAPES = {
    "one": [(7, "s", "en", 1, "A")],
    "edges": [
        (None, None, None, None, None), (None, None, None, None, None), (None, "s", None, 1, "x"), (0, "", "en", 0, ""), (1, None, "en", 3, "ABC"),
        (-70_000, "s", "en", 1, "A"), (-1, "s", "en", 1, "É"), (3, "s", "en", 1, "B"), (3, "s", "en", 1, "C"), (3, "s", "en", 1, "B"),
        (2**62, "s", "fr", 2, "x" * 100_000), (2**62 + 63, "s", "fr", 2, "Z"), (-(2**63), "ß", "fr", 2, "Z"), (5, "Z", "fr", 2, "Z"), (5, "a", "fr", 2, "Z"),
    ],
    "sparse": [(i * i * 37 - 500, "abc"[i % 3] * (i % 7 > 0), "en", i, f"Text {i}") for i in range(300)],
    "many sources": [(i, f"host{i % 41}", "en", i, f"Text {i}") for i in range(90)],
    "one source": [(i, "s", "en", i, f"T{i % 4}") for i in range(273)],
    "copies": [(11, "s", "en", 1, "Same text")] * 50 + [(i, "s", "en", 1, "x") for i in range(30)],
    "ties": [(11, "s", "en", 1, f"Text {i % 23}") for i in range(60)] + [(i, "s", "en", 1, "x") for i in range(30)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, tmp_path, monkeypatch, shape):
    """Nulls, empty and long texts, ties and repeated rows, negative and sparse ids, extra columns with clashing names."""
    monkeypatch.setattr(manifest, "SPREAD", 8)
    rows = SHAPES[shape]
    table = spark.createDataFrame(
        [(*r, "grp", 3, "leaf") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, grp string, place int, leaf string"
    )
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(spark, tmp_path) == plain(rows)


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(spark, tmp_path) == []


def test_bitmap_ranks(spark):
    """Ranks of the directory against sorted lists, with repeated ids."""
    rows = [("a", i * 97 % 5_000 - 1_000, 1 + i % 3) for i in range(400)] + [("b", 1 << 40, 2), (None, None, 4), (None, 5, 1)]
    leaves = spark.createDataFrame([(g, d, f"{g}{d}", n) for g, d, n in rows], "grp string, doc_id long, leaf string, n long")
    places = {(r.grp, r.doc_id): r.place for r in manifest.leaf_places(leaves).collect()}
    for g in ("a", "b", None):
        at = 0
        for _, d, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0)):
            assert places[g, d] == at
            at += n


def test_proofs_lead_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = {"text": manifest.lower_ascii(F.col("text"))}
    proofs = manifest.manifest(docs, altered=changed, where=F.col("doc_id") % 2 == 0)
    ends = proofs.select(
        "root", manifest.folded(F.col("leaf"), F.col("proof")).alias("same"),
        manifest.folded(F.col("altered_leaf"), F.col("proof")).alias("other"), (F.col("altered_leaf") == F.col("leaf")).alias("equal"),
    ).collect()
    assert len({r.root for r in ends}) == 1 and all(r.same == r.root for r in ends)
    assert all((r.other == r.root) == r.equal for r in ends if r.other is not None)
