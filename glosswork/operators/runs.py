"""From raw output of review runs to checked replies."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions import variants as v
from glosswork.functions.replies import (
    agent_message,
    may_be_message,
    strip_fence,
    text_before_last,
    unfenced,
)
from glosswork.functions.text import let, py_splitlines, py_strip
from glosswork.operators.steps import compute_once
from glosswork.session import accept_repeated_keys, ship

# Error texts of runs and replies.
ERR_TIMEOUT = "[ERR] subprocess.TimeoutExpired: "
ERR_EXCEPTION = "[ERR] subprocess.Exception: "
ERR_RETURNCODE = "[ERR] subprocess.run: returncode="
ERR_STDERR = ", stderr: "
NO_STDERR = "no stderr"
ERR_NO_MESSAGE = "[ERR] _parse_stdout: no target message found"
ERR_STDOUT_JSON = "[ERR] _parse_stdout: can't parse JSON from stdout"
ERR_STDOUT_KIND = "[ERR] _parse_stdout: not a dictionary"
ERR_NO_RESULT = "[ERR] _parse_stdout: string <result> not found"
ERR_EMPTY_RESULT = "[ERR] _parse_stdout: <result> is empty"
ERR_PROVIDER = "Unsupported AI: "
ERR_EMPTY_PAYLOAD = "[ERR] _extract_json: payload is empty"
ERR_NO_OPEN = "[ERR] _extract_json: can't find { in payload"
ERR_NO_CLOSE = "[ERR] _extract_json: can't find } in payload"
ERR_JSON = "[ERR] _extract_json: can't parse JSON"
ERR_NO_DATA = "[ERR] _extract_json: no data"
ERR_NOT_OBJECT = "[ERR] _data_check: <data> must be a dictionary"
ERR_REPORTED = "[ERR] _data_check: <error> = "
ERR_KEYS = "[ERR] _data_check: required keys not found"
ERR_TEXT = "[ERR] _data_check: <{}> must be a string"
ERR_LIST = "[ERR] _data_check: <{}> must be a string list"

# Fixed value: characters of stderr kept in an error.
STDERR_CHARS = 2000
LIST_FIELDS = ("notes", "issues", "imperfections", "impediments")


def classify_runs(ai_runs: DataFrame) -> DataFrame:
    """Add ``err``: timeout, other exception, or non-zero exit; NULL for a finished run."""
    columns = set(ai_runs.columns)
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False)) if "timed_out" in columns else F.lit(False)
    exception = F.col("exception") if "exception" in columns else F.lit(None).cast("string")
    stderr = F.nullif(F.col("stderr"), F.lit("")) if "stderr" in columns else F.lit(None).cast("string")
    return ai_runs.withColumn(
        "err",
        F.when(
            timed_out,
            F.concat(F.lit(ERR_TIMEOUT), F.coalesce(exception, F.lit(""))),
        )
        .when(exception.isNotNull(), F.concat(F.lit(ERR_EXCEPTION), exception))
        .when(
            F.col("returncode") != 0,
            F.concat(
                F.lit(ERR_RETURNCODE),
                F.col("returncode").cast("string"),
                F.lit(ERR_STDERR),
                F.coalesce(F.substring(stderr, 1, STDERR_CHARS), F.lit(NO_STDERR)),
            ),
        ),
    )


def event_stream_payload(stdout: Column) -> Column:
    """``STRUCT<payload, err>`` of an event stream: first agent message, else first fenced line."""

    def find(lines: Column) -> Column:
        messages = F.filter(
            F.transform(F.filter(lines, may_be_message), agent_message), lambda m: m.isNotNull()
        )
        fenced = F.filter(F.transform(lines, strip_fence), lambda m: m.isNotNull())
        return F.coalesce(F.get(messages, F.lit(0)), F.get(fenced, F.lit(0)))

    payload = let(py_splitlines(stdout), find)
    return let(
        payload,
        lambda p: F.struct(
            p.alias("payload"),
            F.when(p.isNull(), ERR_NO_MESSAGE).alias("err"),
        ),
    )


def result_object_payload(stdout: Column) -> Column:
    """``STRUCT<payload, err>`` of one JSON object whose ``result`` is the reply."""

    def find(data: Column, aside: Column) -> Column:
        result = py_strip(v.text_of(v.field(data, "result"), aside))
        err = (
            F.when(data.isNull(), ERR_STDOUT_JSON)
            .when(~v.is_object(data), ERR_STDOUT_KIND)
            .when(result.isNull(), ERR_NO_RESULT)
            .when(result == "", ERR_EMPTY_RESULT)
        )
        return F.struct(
            F.when(err.isNull(), unfenced(result)).alias("payload"), err.alias("err")
        )

    return let(v.set_aside(stdout), lambda aside: let(v.lenient_json(aside["text"]), lambda data: find(data, aside)))


# How each provider's standard output is read; add an entry for another provider.
PROVIDERS: dict[str, Callable[[Column], Column]] = {
    "codex": event_stream_payload,
    "claude": result_object_payload,
}
# Providers whose payload may be any JSON value, tried before the search for braces.
DIRECT_JSON = ("codex",)


def extract_run_payload(ai_runs: DataFrame) -> DataFrame:
    """Add ``payload``, ``err`` and ``used_fallback`` (fence searched in the whole output)."""
    accept_repeated_keys(ai_runs.sparkSession)
    df = ai_runs if "err" in ai_runs.columns else classify_runs(ai_runs)
    none = F.struct(
        F.lit(None).cast("string").alias("payload"),
        F.concat(F.lit(ERR_PROVIDER), F.col("provider")).alias("err"),
    )
    found = F.when(F.col("err").isNotNull(), None)
    for name, reader in PROVIDERS.items():
        found = found.when(F.col("provider") == name, reader(F.col("stdout")))
    df = compute_once(df, _found=found.otherwise(none)).withColumn(
        "_fallback",
        F.when(
            F.col("err").isNull() & F.col("_found.payload").isNull(), strip_fence(F.col("stdout"))
        ),
    )
    payload = F.coalesce(F.col("_found.payload"), F.col("_fallback"))
    return df.select(
        *ai_runs.drop("err").columns,
        payload.alias("payload"),
        F.coalesce(F.col("err"), F.when(payload.isNull(), F.col("_found.err"))).alias("err"),
        F.col("_fallback").isNotNull().alias("used_fallback"),
    )


def extract_json_objects(payloads: DataFrame) -> DataFrame:
    """Add ``json_text``: from the first ``{`` to the last ``}``, or a payload that is JSON."""
    direct = F.col("provider").isin(list(DIRECT_JSON))
    text = F.when(direct, py_strip(F.col("payload"))).otherwise(F.col("payload"))

    def braces(c: Column) -> Column:
        start = F.instr(c, F.lit("{"))
        rest = F.when(start > 0, F.substring(c, start, F.length(c)))
        body = let(rest, lambda r: F.concat(text_before_last(r, "}"), F.lit("}")))
        err = (
            F.when(c == "", ERR_EMPTY_PAYLOAD)
            .when(start == 0, ERR_NO_OPEN)
            .when(~F.contains(rest, F.lit("}")), ERR_NO_CLOSE)
        )
        return F.struct(F.when(err.isNull(), body).alias("json_text"), err.alias("err"))

    whole = F.struct(F.col("_text").alias("json_text"), F.lit(None).cast("string").alias("err"))
    # Text in braces is its own slice, so only other payloads need the trial parse.
    in_braces = F.startswith(F.col("_text"), F.lit("{")) & F.endswith(F.col("_text"), F.lit("}"))
    df = compute_once(
        compute_once(payloads, _text=text),
        _json=F.when(
            F.col("_text").isNotNull(),
            F.when(
                direct & (in_braces | let(v.set_aside(F.col("_text")), lambda a: v.lenient_json(a["text"])).isNotNull()), whole
            ).otherwise(braces(F.col("_text"))),
        ),
    )
    return df.select(
        *payloads.drop("err").columns,
        F.col("_json.json_text").alias("json_text"),
        F.coalesce(F.col("err"), F.col("_json.err")).alias("err"),
    )


_QUOTE = re.compile(r'(?<!\\)(\\*)"\s*')  # a run of backslashes is scanned from its start only
# What may follow a closing quote, and what precedes the opening quote of a key.
_AFTER_STRING = frozenset(",]}")
_BEFORE_KEY = frozenset("{,")


def escape_inner_quotes(text: str) -> str:
    """Escape the quotes of a JSON-like text that do not look like the end of a string."""
    pieces: list[str] = []
    copied = 0
    inside = key = False
    previous = ""  # last character before the quote that is not white space
    for m in _QUOTE.finditer(text):
        quote = m.end(1)
        before = text[copied:quote].rstrip()
        follower = text[m.end()] if m.end() < len(text) else ""
        replacement = '"'
        if not inside:
            inside = True
            key = (before[-1:] or previous) in _BEFORE_KEY
        elif len(m.group(1)) % 2 == 0:
            if follower == "" or follower in _AFTER_STRING or (key and follower == ":"):
                inside = key = False
            else:
                replacement = '\\"'
        pieces += (text[copied:quote], replacement)
        copied, previous = quote + 1, '"'
    return "".join(pieces) + text[copied:]


def _storable(value: object) -> object:
    # NaN and infinities have no JSON form; keep them as non-empty objects.
    if isinstance(value, float) and not math.isfinite(value):
        return {"float": str(value)}
    if isinstance(value, dict):
        return {k: _storable(x) for k, x in value.items()}
    if isinstance(value, list):
        return [_storable(x) for x in value]
    return value


def repair_json(text: str) -> tuple[str | None, bool]:
    """Valid JSON for a lenient or wrongly escaped text, and whether quotes were escaped."""
    for candidate, repaired in ((text, False), (None, True)):
        if candidate is None:
            candidate = escape_inner_quotes(text)
        try:
            return json.dumps(_storable(json.loads(candidate)), ensure_ascii=False), repaired
        except (ValueError, RecursionError):
            continue
    return None, False


_REPAIRED = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("repaired", T.BooleanType())]
)


@F.pandas_udf(_REPAIRED)
def _repair(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, False) if t is None else repair_json(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "repaired"])


def repair_json_rows(json_texts: DataFrame) -> DataFrame:
    """Add ``data`` (VARIANT), ``aside``, ``repaired`` and the error of texts beyond repair.

    Texts the strict parser accepts never reach Python: the function gets NULL for them. One
    scan serves both kinds, where a filter and a union would read the runs twice. In very long texts
    the strings of ``data`` are numbers of those in ``aside`` (``variants.set_aside``),
    which has none for all others; ``variants.text_of`` puts them back.
    """
    ship(json_texts.sparkSession)
    df = compute_once(json_texts, _cut=v.set_aside(F.col("json_text")))
    df = compute_once(df, _parsed=v.strict_json(F.col("_cut.text")))
    df = df.withColumn(
        "_fixed", _repair(F.when(F.col("_parsed").isNull(), F.col("json_text")))
    )
    df = compute_once(df, aside=F.when(F.col("_parsed").isNotNull(), F.col("_cut")).otherwise(v.set_aside(F.col("_fixed.text"))))
    df = compute_once(
        df, _data=F.coalesce(F.col("_parsed"), F.try_parse_json(F.col("aside.text")))
    )
    err = (
        F.when(F.col("err").isNotNull(), F.col("err"))
        .when(F.col("_data").isNull(), ERR_JSON)
        .when(v.kind(F.col("_data")) == "VOID", ERR_NO_DATA)
    )
    return df.select(
        *json_texts.drop("err").columns,
        F.when(err.isNull(), F.col("_data")).alias("data"),
        F.struct("aside.mark", "aside.longs").alias("aside"),
        (F.coalesce(F.col("_fixed.repaired"), F.lit(False)) & F.col("_data").isNotNull()).alias("repaired"),
        err.alias("err"),
    )


REPLY_FIELDS = ("error", "overview", "review", "design", *LIST_FIELDS, "output")


def _first_error(data: Column, fields: Column, check_output: Column | bool, aside: Column | None) -> Column:
    """First broken rule of a reply, as an error text; NULL when all hold."""
    error = fields["error"]
    said = v.printed(error, aside)
    err = (
        F.when(~v.is_object(data), ERR_NOT_OBJECT)
        .when(
            ~v.is_falsy(error) & (F.coalesce(py_strip(v.text_of(error, aside)), said) != ""),
            F.concat(F.lit(ERR_REPORTED), said),
        )
        .when(fields["overview"].isNull() | fields["review"].isNull(), ERR_KEYS)
    )
    design = fields["design"]
    err = err.when(
        ~v.is_falsy(design) & v.text_of(design).isNull(), ERR_TEXT.format("design")
    )
    for name in LIST_FIELDS:
        value = fields[name]
        err = err.when(
            ~v.is_falsy(value) & ~v.is_list(value), ERR_LIST.format(name)
        )
    if check_output is not False:
        asked = F.lit(True) if check_output is True else check_output
        err = err.when(asked & v.text_of(fields["output"]).isNull(), ERR_TEXT.format("output"))
    return err


def review_payload(fields: Column, aside: Column | None = None) -> Column:
    """Typed reply: text fields NULL unless they are strings, list items that are strings."""

    def text(name: str) -> Column:
        return v.text_of(fields[name], aside)

    def strings(name: str) -> Column:
        texts = F.transform(v.items(fields[name]), lambda x: v.text_of(x, aside))
        return F.filter(texts, lambda s: s.isNotNull()).alias(name)

    return F.struct(
        text("overview").alias("overview"),
        text("review").alias("review"),
        F.coalesce(text("design"), F.lit("")).alias("design"),
        *[strings(name) for name in LIST_FIELDS],
        text("output").alias("output"),
        text("error").alias("error"),
    )


def validate_review_payloads(payloads: DataFrame, check_output: Column | bool = False) -> DataFrame:
    """Check replies: ``raw`` (VARIANT), typed ``data``, ``err`` and ``severity``.

    The first broken rule makes the error; optional fields that are empty in any way get
    their defaults. Fix replies are checked without ``check_output``, which may be a condition on the row. Strings in the ``aside`` of
    ``repair_json_rows`` are put back in ``data``; ``aside`` goes on with ``raw``.
    """
    aside = F.col("aside") if "aside" in payloads.columns else None
    # Members are taken out once, so that the rules and the typed reply read plain columns.
    members = F.struct(*[v.field(F.col("data"), name).alias(name) for name in REPLY_FIELDS])
    df = compute_once(payloads, _fields=members)
    df = compute_once(
        df,
        _err=F.coalesce(
            F.col("err"),
            F.when(F.col("data").isNull(), ERR_NO_DATA),
            _first_error(F.col("data"), F.col("_fields"), check_output, aside),
        ),
    )
    good = F.col("_err").isNull()
    return df.select(
        *payloads.drop("err", "data").columns,
        F.when(good, F.col("data")).alias("raw"),
        F.when(good, review_payload(F.col("_fields"), aside)).alias("data"),
        F.col("_err").alias("err"),
        F.when(good, "OK").otherwise("ERROR").alias("severity"),
    )


def read_replies(ai_runs: DataFrame, check_output: Column | bool = False) -> DataFrame:
    """All steps from recorded runs to checked replies; narrow, no shuffle."""
    runs = extract_run_payload(classify_runs(ai_runs))
    return validate_review_payloads(
        repair_json_rows(extract_json_objects(runs)), check_output
    ).drop("stdout", "stderr", "payload", "json_text")


def first_agent_message(run_events: DataFrame) -> DataFrame:
    """First agent message of each run, by ``seq``: ``request_id, text``.

    Messages are found before the shuffle and pre-aggregated, so one row per run and input
    partition moves, also for a run that holds most events.
    """
    accept_repeated_keys(run_events.sparkSession)
    messages = compute_once(
        run_events.filter(may_be_message(F.col("line"))), text=agent_message(F.col("line"))
    )
    return (
        messages.filter(F.col("text").isNotNull())
        .groupBy("request_id")
        .agg(F.min_by("text", "seq").alias("text"))
    )
