"""Quality rules of documents, and verdicts on hosts from shrunken failure rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import map_texts, settled

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
HOST_RATE = 0.5  # hosts above this shrunken rate lose all their documents
SALTS = 64  # rows of one host are joined in so many shares
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in SYMBOLS)
_WHITE = b" \t\n\v\f\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    key = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (seq + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for j in range(window):
            key = key * np.uint64(0xD6E8FEB86659FD93) + mixed[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    # Equal keys are held against the words themselves.
    left, right = order[:-1][same], order[1:][same]
    equal = np.ones(len(left), bool)
    for j in range(window):
        equal &= seq[left + j] == seq[right + j]
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.concatenate([left[equal], right[equal]]))
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + window, len(words)), -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def text_figures(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole UTF-8 text (null: zeros)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()  # bytes split at the six ASCII white-space characters only
    chars = len(text.translate(None, _WHITE).decode("utf-8", "replace"))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(_WHITE):
            seen.add(line)
    return len(words), chars, len(text.translate(None, _NOT_SYMBOLS)), again, repeated_words(words)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Empirical beta prior of failure rates by moments over all hosts (`n`, `fails`), each weighing its documents.

    The less the hosts differ beyond chance, the heavier the prior, up to the weight of all documents,
    which it has where they do not differ at all; without any host it is (1/2, 1/2).
    """
    total = hosts.agg(F.sum("n").alias("n"), F.sum("fails").alias("f"), F.count("*").alias("hosts")).first()
    if not total["n"]:
        return 0.5, 0.5
    mean = total["f"] / total["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n") - mean, 2)).alias("s"), F.sum(F.col("n") * F.col("n")).alias("n2")).first()
    n, k = total["n"], total["hosts"]
    noise = mean * (1 - mean)
    room = n - spread["n2"] / n  # what the variance between hosts is multiplied by
    between = (spread["s"] - (k - 1) * noise) / room if room > 0 else 0.0
    weight = float(n) if between <= 0 else min(max(noise / between - 1, 1.0), float(n))
    return max(mean * weight, 1e-6), max((1 - mean) * weight, 1e-6)


def host_verdicts(light: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """host, n, fails, rate (shrunk towards the prior) and host_failed of rows with host and base_failed."""
    hosts = settled(light.groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails")
    ))
    alpha, beta = beta_prior(hosts)
    shrunk = (F.col("fails") + alpha) / (F.col("n") + alpha + beta)
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", shrunk > rate)


def host_rules(docs: DataFrame, host: Column, rate: float = HOST_RATE) -> DataFrame:
    """Figures of each document, whether it fails the rules itself, its host's verdict, and whether it is kept.

    A document fails with fewer than 20 words or with over 30 percent of words in repeated windows.
    A host fails if its failure rate, shrunk by the empirical beta prior over all hosts, exceeds
    `rate`; its documents go too. Null hosts are one host of their own. Null and empty texts have
    no words and fail; repeated rows count each; an empty table gives an empty one; other columns
    are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    light = map_texts(
        docs, [("doc_id", F.col("doc_id")), ("host", host.cast("string"))], F.col("text"), text_figures,
        [(x, pa.int64()) for x in names], f"doc_id {kind}, host string, " + ", ".join(f"{x} long" for x in names),
    )
    light = settled(light.withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    ))
    verdicts = host_verdicts(light, rate).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "host_failed")
    shares = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = light.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        shares, (salted["__salt"] == shares["__salt"]) & salted["host"].eqNullSafe(shares["__host"]), "left"
    )
    return joined.select(
        "doc_id", "host", *names, "base_failed", "host_rate", "host_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
