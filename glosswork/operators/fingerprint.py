"""Structural fingerprints that ignore comments and layout, and checks built on them.

Two texts with one fingerprint differ in comments only, as far as both can be read in one way; a
text that cannot has the confidence ``low``, and no check certifies it as equal to another text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.lexer import decode, scanned, token_kind, token_text
from glosswork.functions.scanner import SEPARATOR
from glosswork.functions.text import value_hash
from glosswork.operators.comments import with_language
from glosswork.operators.grouping import PART_BYTES, collect_in_parts, share
from glosswork.operators.steps import compute_once
from glosswork.session import ship

# Version of the fingerprint layout, warning for changed code.
VERSION = 1
WARN_CHANGED = "[WARNING] _data_check: <output> does not match the input expected"
WARN_UNSURE = "[WARNING] _data_check: <output> can be read in several ways, so it may not match the input"

HIGH, LOW = "high", "low"
SAME, CHANGED, UNSURE = "same", "changed", "unsure"


def tokenize_sources(files: DataFrame) -> DataFrame:
    """Privacy-preserving tokens: ``path, pos, kind, length, value_hash``; comments dropped.

    Lengths are in bytes. The tokens are exploded before hashing, so that hashing runs in
    generated code.
    """
    ship(files.sparkSession)
    df = with_language(files).filter(F.col("language").isNotNull())
    df = df.select("path", "language", scanned(F.col("content"), F.col("language")).alias("_scan"))
    text = token_text(F.col("_scan.text"), F.col("language"))
    # Nothing stands before the first separator.
    tokens = F.array_remove(F.split(text, SEPARATOR, -1), "")
    return df.select("path", F.posexplode(tokens).alias("pos", "_token")).select(
        "path",
        "pos",
        token_kind(F.col("_token")).alias("kind"),
        F.octet_length(decode(F.col("_token"))).alias("length"),
        value_hash(decode(F.col("_token"))).alias("value_hash"),
    )


def with_prints(df: DataFrame, content: Column, language: Column, name: str = "_print") -> DataFrame:
    """Add ``STRUCT<fingerprint, confidence>`` of a text; NULLs without a text or a language.

    The fingerprint is the hash of language, version and token sequence. The tokens are hashed as
    one separated text: as telling as a hash of token hashes, since no token holds the
    separator, and one hash per text instead of one per token.
    """
    ship(df.sparkSession)
    df = df.withColumns({"_language": language, "_scan": scanned(content, language)})
    head = F.concat(F.col("_language"), F.lit(f"{SEPARATOR}{VERSION}"))
    tokens = token_text(F.col("_scan.text"), F.col("_language"))
    found = F.struct(
        F.sha2(F.concat(head, tokens), 256).alias("fingerprint"),
        F.when(F.col("_scan.sure"), HIGH).when(~F.col("_scan.sure"), LOW).alias("confidence"),
    )
    return compute_once(df, **{name: found}).drop("_language", "_scan")


def structural_fingerprints(files: DataFrame) -> DataFrame:
    """``path, language, version, fingerprint, confidence``. No shuffle.

    Equal when only comments differ; ``confidence`` is ``low`` where a text can be read in more
    than one way, so that an equal fingerprint proves nothing.
    """
    df = with_prints(with_language(files), F.col("content"), F.col("language"))
    return df.select(
        "path",
        "language",
        F.when(F.col("language").isNotNull(), VERSION).alias("version"),
        "_print.*",
    )


def verdict(one: Column, other: Column, same_text: Column) -> Column:
    """``same``, ``changed`` or ``unsure`` of two ``STRUCT<fingerprint, confidence>``.

    Equal texts are the same however they read; otherwise a verdict needs two texts that are read
    in one way. Texts without a language have no fingerprint and are the same only if equal.
    """
    sure = F.coalesce((one["confidence"] == HIGH) & (other["confidence"] == HIGH), F.lit(True))
    return (
        F.when(F.coalesce(same_text, F.lit(False)), SAME)
        .when(~sure, UNSURE)
        .when(F.coalesce(one["fingerprint"] == other["fingerprint"], F.lit(False)), SAME)
        .otherwise(CHANGED)
    )


def verify_logic_preserved(requests: DataFrame, payloads: DataFrame) -> DataFrame:
    """Compare the code sent with the code returned; anything but ``same`` is a WARNING, data is kept.

    ``requests`` come from ``build_review_requests`` (the request id is the path unless there
    is a ``request_id`` column); ``payloads(request_id, data, err, severity, ...)`` from
    ``validate_review_payloads``. Adds ``input``, the code sent, and ``verdict``: ``same``, ``changed`` or
    ``unsure``, NULL for replies with an error. The input is fingerprinted before the join,
    once per request. Replies are on the left, so that a request with very
    many attempts can be split at run time.
    """
    request_id = F.col("request_id") if "request_id" in requests.columns else F.col("path")
    sent = requests.filter(F.col("request").isNotNull()).select(
        request_id.alias("request_id"), "language", F.col("request.input").alias("input")
    )
    sent = with_prints(sent, F.col("input"), F.col("language"), "_expected")
    joined = payloads.join(sent, "request_id", "inner")
    good = F.col("err").isNull()
    output = F.col("data.output")
    joined = with_prints(joined, F.when(good, output), F.col("language"), "_returned")
    judged = verdict(F.col("_expected"), F.col("_returned"), output == F.col("input"))
    df = compute_once(joined, verdict=F.when(good, judged))
    warning = F.when(F.col("verdict") == CHANGED, WARN_CHANGED).when(F.col("verdict") == UNSURE, WARN_UNSURE)
    return df.select(
        *[name for name in payloads.columns if name not in ("err", "severity", "verdict")],
        "input",
        "verdict",
        F.coalesce(F.col("err"), warning).alias("err"),
        F.when(warning.isNotNull(), "WARNING").otherwise(F.col("severity")).alias("severity"),
    )


def clone_groups(fingerprints: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Structurally equal files: ``fingerprint, part, parts, paths, n, confidence`` for groups of 2 or more.

    ``n`` counts the whole group; ``confidence`` is ``low`` where that of a member is. The paths of
    a very large group come in several parts.
    """
    known = fingerprints.filter(F.col("fingerprint").isNotNull()).select("fingerprint", "path", "confidence")
    # Tokenizing is the costly step; counting and gathering read one exchange of its result.
    known = share(known, "fingerprint", "path")
    counts = known.groupBy("fingerprint").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence")  # low after high
    ).filter(F.col("n") > 1)
    # The count travels with the paths: a left side that can be split where a group is large.
    copies = known.drop("confidence").join(counts, "fingerprint")
    groups = collect_in_parts(copies, ["fingerprint", "n", "confidence"], ["path"], part_bytes=part_bytes)
    return groups.select("fingerprint", "part", "parts", F.col("items.path").alias("paths"), "n", "confidence")
