"""The registered queries of the operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import (
    hostrules, langid, manifest, mixing, neardup, packing, periodic, pii, quality, secrets, sharding, topk, toxicity,
)
from glosswork.llm.common import table

SHARDS = 40


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_sentences"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path=F.col("source"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hostrules.host_rules(table(spark, sf_dir, "documents"), F.col("source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.best_fit_packing(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic.find_runs(docs, periodic.with_planted_repeats(F.col("text").cast("string"), F.col("doc_id")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = periodic.strongest(F.col("runs"))
    named = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return named.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proofs = manifest.manifest(
        table(spark, sf_dir, "documents"), altered={"text": manifest.lower_ascii(F.col("text").cast("string"))}, where=chosen
    )
    found = proofs.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        manifest.folded(F.coalesce("altered_leaf", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.document_languages(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk, op2_toxicity, op3_mixing, op4_pii, op5_minhash, op6_secrets, op7_host_rules, op8_packing,
        op9_sharding, op10_quality, op11_periodic_runs, op12_merkle_manifest, op13_language_id,
    )
}

# SQL of the manifest: the checksum of doc_id bit by bit, a leaf, and one step of a walk to the root.
_BITS = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(c, b))"
_CRC32 = (
    "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), "
    f"lambda c, b: {_BITS}, 4294967295::BIGINT), 4294967295)"
)
_OTHERS = "array_to_string(list_filter(r.members, lambda x, i: i <> w.place % 16 + 1), '')"
_FOLD = "sha256(array_to_string(r.members[:w.place % 16], '') || w.node || array_to_string(r.members[w.place % 16 + 2:], ''))"


def _leaf(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p})::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"


ORACLES: dict[str, str] = {
    "op1_topk": """
WITH whole AS (
  SELECT vec_id, i, CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY q.vec_id, c.vec_id
),
ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
         CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS total, row_number() OVER () AS row
  FROM leaves
),
nodes AS (
  SELECT 0 AS level, source, place, total, leaf AS node FROM placed
  UNION ALL
  SELECT level + 1, source, place // 16, any_value((total + 15) // 16), sha256(string_agg(node, '' ORDER BY place))
  FROM nodes WHERE total > 1 GROUP BY level, source, place // 16
),
runs AS (
  SELECT level, source, place // 16 AS run, list(node ORDER BY place) AS members FROM nodes WHERE total > 1 GROUP BY ALL
),
subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE total = 1
),
upper_nodes AS (
  SELECT 0 AS level, place, total, node FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, any_value((total + 15) // 16), sha256(string_agg(node, '' ORDER BY place))
  FROM upper_nodes WHERE total > 1 GROUP BY level, place // 16
),
upper_runs AS (
  SELECT level, place // 16 AS run, list(node ORDER BY place) AS members FROM upper_nodes WHERE total > 1 GROUP BY ALL
),
walk AS (
  SELECT row, doc_id, source, leaf, 0 AS level, place, total, '' AS siblings, coalesce(altered, leaf) AS node FROM placed
  UNION ALL
  SELECT w.row, w.doc_id, w.source, w.leaf, w.level + 1, w.place // 16, (w.total + 15) // 16, w.siblings || {_OTHERS}, {_FOLD}
  FROM walk w JOIN runs r ON r.level = w.level AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.place // 16
  WHERE w.total > 1
),
upper_walk AS (
  SELECT w.row, w.doc_id, w.leaf, s.node AS subroot, 0 AS level, s.place, s.total, w.siblings, w.node
  FROM walk w JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source WHERE w.total = 1
  UNION ALL
  SELECT w.row, w.doc_id, w.leaf, w.subroot, w.level + 1, w.place // 16, (w.total + 15) // 16, w.siblings || {_OTHERS}, {_FOLD}
  FROM upper_walk w JOIN upper_runs r ON r.level = w.level AND r.run = w.place // 16
  WHERE w.total > 1
)
SELECT doc_id, leaf, subroot, top.node AS root, sha256(siblings) AS proof_sha256, w.node AS folded_root, w.node = top.node AS verified
FROM upper_walk w, (SELECT node FROM upper_nodes WHERE total = 1) top WHERE w.total = 1
""",
}
