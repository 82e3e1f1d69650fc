"""Secret scanning: wide patterns find candidates, a random forest removes false findings."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import settled
from glosswork.llm.pii import _let, matches
from glosswork.operators.steps import compute_once

# Candidates by shape, of every length: a run of the characters that keys are made of with a letter and a digit, a
# capital behind a small letter, or a mark between letters or digits; the whole value, of any characters, that
# is assigned to a key word; and private key blocks. Plain words and plain numbers elsewhere are none.
_SHAPES = r"(?=[A-Za-z+/=_-]*+[0-9])(?=[0-9+/=_-]*+[A-Za-z])|(?=[A-Z0-9+/=_-]*+(?:[a-z]++[0-9+/=_-]*+)*+[A-Z])|(?=[A-Za-z0-9]++[+/=_-]++[A-Za-z0-9])"
RUN = rf"(?<![A-Za-z0-9+/=_-])(?:{_SHAPES})[A-Za-z0-9+/=_-]++"
CONTEXT = 32  # characters looked at on either side
# Fixed lists: words near credentials, words of ordinary names, and forms with a known issuer.
KEY_WORDS = r"passw(?:or)?d|passwd|secret|token|api[_-]?key|credential|auth|bearer|private"
ASSIGNMENT = rf"(?:(?i:{KEY_WORDS}))[A-Za-z0-9_.-]{{0,256}}+[\"'`\])]{{0,2}}+\s{{0,64}}+(?::=|=>|==?|:)\s{{0,64}}+"
# Quoted values end on their line, with escapes; others end at white space.
ASSIGNED = ASSIGNMENT + r"""(?:"(?:[^"\\\r\n]|\\.)*+"|'(?:[^'\\\r\n]|\\.)*+'|`(?:[^`\\\r\n]|\\.)*+`|\S++)"""
PRIVATE_KEY = r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]*+(?:-(?!----END)[^-]*+)*+-----END [A-Z0-9\x20]{0,40}PRIVATE KEY(?: BLOCK)?-----"
SAFE_WORDS = r"example|sample|dummy|placeholder|test|fake|sha1|sha256|md5|commit|checksum|digest|uuid"
DICTIONARY = (
    "the and for with from that this have name user file path line text data code page list item value "
    "time date test type main self http https www com org html json image style class width height "
    "example sample config default string number table index public private return function version"
).split()
ISSUED = r"^(?:AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-|sk_live_|AIza[0-9A-Za-z_-]{35}$|eyJ[A-Za-z0-9_-]+|-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY)"
FEATURES = (
    "length", "digits", "uppers", "lowers", "marks", "turns", "runs", "distinct", "vowels", "words",
    "key_before", "assigned", "quoted", "safe_near", "path_test", "path_code",
)
TREES, DEPTH = 24, 6
MAX_TRAINING = 20_000  # labelled findings of each kind (true, plain words, other false ones) that the forest is fitted on, at most

_LETTERS = string.digits + string.ascii_lowercase + string.ascii_uppercase
_KINDS = "0" * 10 + "a" * 26 + "A" * 26


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _where(known: Column | None, test: Column) -> Column:
    return test if known is None else F.when(known, test).otherwise(False)


def _columns(value: Column, before: Column, after: Column, path: Column, keyed: Column | None = None, safe: Column | None = None) -> dict[str, Column]:
    # Where the whole text has no key word (safe word), no context has: most texts.
    low, left, place = F.lower(value), F.lower(before), F.lower(F.coalesce(path, F.lit("")))
    kinds = F.translate(value, _LETTERS, _KINDS)
    columns = {
        "length": F.length(value), "digits": _share(value, "[^0-9]"), "uppers": _share(value, "[^A-Z]"),
        "lowers": _share(value, "[^a-z]"), "marks": _share(value, "[A-Za-z0-9]"),
        # Places where the class of character changes, and the longest run of one letter class.
        "turns": F.length(F.regexp_replace(kinds, r"(?s)(.)\1*+", "x")) / F.length(value),
        "runs": F.array_max(F.transform(F.regexp_extract_all(kinds, F.lit(r"(?s)((.)\2*+)"), F.lit(0)), F.length)) / F.length(value),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(64)),
        "vowels": _share(low, "[^aeiou]"),
        "words": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / F.length(value),
        "key_before": _where(keyed, left.rlike(KEY_WORDS)), "assigned": left.rlike(r"[=:]\s*[\"'`]?$"),
        "quoted": before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]"),
        "safe_near": _where(safe, F.concat_ws(" ", left, low, F.lower(after)).rlike(SAFE_WORDS)),
        "path_test": place.rlike(r"test|example|fixture|sample|doc"), "path_code": place.rlike(r"\.(?:py|js|ts|java|go|rb|env|ya?ml|json|ini|cfg|conf|sh)$"),
    }
    return {k: c.cast("double") for k, c in columns.items()}


def described(value: Column, before: Column, after: Column, path: Column, *known: Column) -> Column:
    """Features of a candidate: length, character classes and transitions, dictionary coverage, path, neighbouring words."""
    return F.struct(*[c.alias(k) for k, c in _columns(value, before, after, path, *known).items()])


def _spans(text: Column) -> Column:
    """Candidates of a text: array of start, end (code points) and value, sorted, each span once."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

    def trimmed(m: Column) -> Column:
        # 'name=value' is one run: the value is the finding, the name is its left context.
        name = F.when(F.contains(m["value"], F.lit("=")), F.regexp_extract(m["value"], r"^[A-Za-z_-]+=+(?=[^=])", 0)).otherwise("")
        return span(m["start"] + F.length(name), m["end"], F.substring(m["value"], F.length(name) + 1, F.length(m["value"])))

    def assigned(m: Column) -> Column:
        rest = F.regexp_replace(m["value"], "^" + ASSIGNMENT, "")
        first = F.substring(rest, 1, 1)
        opened = first.isin('"', "'", "`").cast("int")
        closed = F.when((F.length(rest) > 1) & (opened == 1) & rest.endswith(first), 1).otherwise(0)
        inner = F.substring(rest, opened + 1, F.length(rest) - opened - closed)
        return span(m["end"] - F.length(rest) + opened, m["end"] - closed, inner)

    keyed = F.when(text.rlike(f"(?i:{KEY_WORDS})"), F.filter(
        F.transform(matches(text, ASSIGNED), assigned), lambda m: F.length(m["value"]) > 0
    )).otherwise(none)
    keys = F.when(F.contains(text, F.lit("PRIVATE KEY")), matches(text, PRIVATE_KEY)).otherwise(none)
    runs = F.transform(matches(text, RUN), trimmed)

    def once(both: Column) -> Column:
        ordered = _let(F.array_sort(F.concat(both["runs"], both["more"])), lambda a: F.filter(
            a, lambda m, i: (i == 0) | ~(F.get(a, i - 1)["start"] == m["start"]) | ~(F.get(a, i - 1)["end"] == m["end"])
        ))
        return F.when(F.size(both["more"]) == 0, both["runs"]).otherwise(ordered)

    return _let(F.struct(runs.alias("runs"), F.concat(keyed, keys).alias("more")), once)


def located(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """One row for each candidate of each text: doc_id, start, end (code points), value, before, after (its context), path, issued; keyed and safe: the text has a key word, a safe word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("__text"), (F.lit("") if path is None else path).alias("__path"))
    blocks = F.regexp_extract_all(F.col("__text"), F.lit(f"(?s).{{1,{CONTEXT}}}"), F.lit(0))

    rows = compute_once(rows, keyed=F.col("__text").rlike(f"(?i:{KEY_WORDS})"), safe=F.col("__text").rlike(f"(?i:{SAFE_WORDS})"))

    def block(both: Column, i: Column) -> Column:
        return F.coalesce(F.get(both["b"], i), F.lit(""))

    def around(both: Column):
        def of(m: Column) -> Column:
            # Cut from blocks of the text, so that the cost does not grow with its length.
            i, j = F.floor(m["start"] / CONTEXT).cast("int"), F.floor(m["end"] / CONTEXT).cast("int")
            past = (m["start"] % CONTEXT).cast("int")
            left = F.when(i == 0, F.substring(block(both, i), F.lit(1), past)).otherwise(
                F.substring(F.concat(block(both, i - 1), block(both, i)), past + 1, F.lit(CONTEXT))
            )
            right = F.substring(F.concat(block(both, j), block(both, j + 1)), (m["end"] % CONTEXT + 1).cast("int"), F.lit(CONTEXT))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), left.alias("before"), right.alias("after"))

        return of

    found = _let(F.struct(_spans(F.col("__text")).alias("s"), blocks.alias("b")), lambda both: F.transform(both["s"], around(both)))
    return (
        rows.select("doc_id", "__path", "keyed", "safe", F.explode(found).alias("f"))
        .select("doc_id", "f.*", F.col("__path").alias("path"), "keyed", "safe", F.col("f.value").rlike(ISSUED).alias("issued"))
    )


CONTEXTS = ("value", "before", "after", "path", "keyed", "safe")


def _featured(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.select("doc_id", "start", "end", "value", "issued", described(*[F.col(c) for c in CONTEXTS]).alias("features"), *kept)


def findings(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """One row for each candidate of each text: doc_id, start, end (code points), value, issued, features.

    Null and empty texts have none; repeated rows give repeated findings.
    """
    return _featured(located(docs, path))


def _label(f: Callable[[str], Column]) -> Column:
    keyed = (f("key_before") == 1) & (f("assigned") == 1) & (f("safe_near") == 0)
    sure = F.col("issued") | (keyed & ((f("digits") > 0.1) | ((f("quoted") == 1) & (f("length") >= 8) & (f("words") < 0.5))))
    clean = ~F.col("issued") & (f("key_before") == 0) & ((f("digits") == 0) | (f("safe_near") == 1) | (f("digits") == 1))
    return F.when(sure, 1.0).when(clean, 0.0)


def labelled(rows: DataFrame) -> DataFrame:
    """Label the findings that leave no doubt: of a known issuer or assigned to a key word (1), or far from both (0)."""
    return rows.withColumn("label", _label(lambda k: F.col("features")[k])).where("label is not null")


_KIND = "CASE WHEN label = 1 THEN 1 WHEN value RLIKE '^[A-Za-z]?[a-z]*$' THEN 2 ELSE 3 END"  # plain words are a kind of their own


def train(rows: DataFrame, seed: int = 3) -> PipelineModel | None:
    """A forest on at most MAX_TRAINING labelled findings (value, features, label) of each kind; None without both classes."""
    order = F.xxhash64("value", "doc_id", "start")
    rows = rows.withColumn("__kind", F.expr(_KIND))
    parts = [rows.where(F.col("__kind") == k).orderBy(order, "doc_id", "start").limit(MAX_TRAINING) for k in (1, 2, 3)]
    sample = settled(reduce(DataFrame.union, parts).select("label", "features.*"))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="vector", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8,
    )
    return PipelineModel([vectors, forest.fit(vectors.transform(sample))])


def scan(docs: DataFrame, labels: DataFrame | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, end, issued, score and secret of every candidate of every whole text.

    `labels` are labelled findings: rows of `findings` with a label, 1 for true and 0 for false
    ones; without them those that leave no doubt in `docs` itself teach the forest. Without both
    classes only forms of a known issuer score 1. Ties and repeated rows are treated alike; an
    empty table gives an empty one; other columns are ignored.
    """
    # Candidates are few by their shape, so they are written once, with their features, for training and scoring.
    found = settled(findings(docs, path))
    model = train(labelled(found) if labels is None else labels)
    if model is None:
        scored = found.withColumn("score", F.col("issued").cast("double"))
    else:
        wide = found.select("doc_id", "start", "end", "issued", "features.*")
        scored = model.transform(wide).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "issued", "score", (F.col("score") >= threshold).alias("secret"))
