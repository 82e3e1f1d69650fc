"""Run logs: payloads, repair, validation, attempts, fix loops."""

import json
import time

import pytest
from pyspark.sql import functions as F

from glosswork.operators import attempts as at
from glosswork.operators import runs as ru

RUN = "request_id string, attempt int, provider string, returncode int, stdout string, stderr string, timed_out boolean, exception string"


def runs(spark, *outputs, provider="codex"):
    rows = [(f"r{i}", 1, provider, 0, text, "", False, None) for i, text in enumerate(outputs)]
    return spark.createDataFrame(rows, RUN)


def by_id(df, *names):
    return [tuple(r[n] for n in names) for r in sorted(df.collect(), key=lambda r: r.request_id)]


def test_classify(spark):
    rows = [
        ("a", 1, "codex", 1, "", "", False, None),
        ("b", 1, "codex", 2, "", "x" * 3000, False, None),
        ("c", 1, "codex", None, None, None, True, "late"),
        ("d", 1, "codex", None, None, None, False, "boom"),
        ("e", 1, "codex", 0, "", "warn", False, None),
    ]
    got = by_id(ru.classify_runs(spark.createDataFrame(rows, RUN)), "err")
    assert got == [
        ("[ERR] subprocess.run: returncode=1, stderr: no stderr",),
        ("[ERR] subprocess.run: returncode=2, stderr: " + "x" * 2000,),
        ("[ERR] subprocess.TimeoutExpired: late",),
        ("[ERR] subprocess.Exception: boom",),
        (None,),
    ]


def message(text):
    return json.dumps({"type": "item.completed", "item": {"type": "agent_message", "text": text}})


def test_event_stream(spark):
    df = runs(
        spark,
        "noise\n\n[1]\n" + message("one") + "\n" + message("two"),
        message("") + "\n" + message("later"),
        "x ```json {1} ``` y\nz",
        "a ```json\n{}\n``` b",
        "nothing",
        json.dumps({"msg": {"type": "agent_message", "message": "```json {} ```"}}),
    )
    assert by_id(ru.extract_run_payload(df), "payload", "err", "used_fallback") == [
        ("one", None, False),
        ("", None, False),
        (" {1} ", None, False),
        ("\n{}\n", None, True),
        (None, "[ERR] _parse_stdout: no target message found", False),
        (" {} ", None, False),
    ]


def test_result_object(spark):
    df = runs(
        spark,
        json.dumps({"result": "  {} "}),
        json.dumps({"result": "x ```json {} ``` y"}),
        "[1]",
        json.dumps({"result": 5}),
        json.dumps({"result": " 　"}),
        "{} trailing",
        "bad ```json {} ```",
        provider="claude",
    )
    assert by_id(ru.extract_run_payload(df), "payload", "err", "used_fallback") == [
        ("{}", None, False),
        (" {} ", None, False),
        (None, "[ERR] _parse_stdout: not a dictionary", False),
        (None, "[ERR] _parse_stdout: string <result> not found", False),
        (None, "[ERR] _parse_stdout: <result> is empty", False),
        (None, "[ERR] _parse_stdout: can't parse JSON from stdout", False),
        (" {} ", None, True),
    ]


def test_unknown_provider(spark):
    got = ru.extract_run_payload(runs(spark, "x", provider="other")).first()
    assert got.err == "Unsupported AI: other"


def payloads(spark, *texts, provider="claude"):
    rows = [(f"r{i:02d}", provider, t, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "request_id string, provider string, payload string, err string")


def test_json_slices(spark):
    df = payloads(spark, "a {1} b {2} c", "", "no", "} {", "{ no")
    assert by_id(ru.extract_json_objects(df), "json_text", "err") == [
        ("{1} b {2}", None),
        (None, "[ERR] _extract_json: payload is empty"),
        (None, "[ERR] _extract_json: can't find { in payload"),
        (None, "[ERR] _extract_json: can't find } in payload"),
        (None, "[ERR] _extract_json: can't find } in payload"),
    ]
    direct = payloads(spark, " [1] ", "null", "x {} y", "  ", '{"a":1} {"b":2}', provider="codex")
    assert by_id(ru.extract_json_objects(direct), "json_text", "err") == [
        ("[1]", None), ("null", None), ("{}", None), (None, "[ERR] _extract_json: payload is empty"),
        ('{"a":1} {"b":2}', None),
    ]


def repaired(spark, *texts):
    rows = [(f"r{i:02d}", t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id string, json_text string, err string")
    got = ru.repair_json_rows(df).select("request_id", F.to_json("data").alias("data"), "repaired", "err")
    return [(json.loads(d) if d else None, r, e) for d, r, e in by_id(got, "data", "repaired", "err")]


def test_repair(spark):
    bad = (None, False, "[ERR] _extract_json: can't parse JSON")
    got = repaired(
        spark,
        '{"a":"say "hi" now"}', '{"a":"k": v"}', '{"a":"x "y", z"}', '{"a":["p","q": r"]}', '{"a":1}',
        '{"a":1,"a":2}', '{"a":NaN}', '{"a":"b\\"c "d" e"}', '{"a": 1} x {"b": 2}', '{"k "x" y":1}', "null",
        '{"a":"tail \\\\"}',
    )
    assert got == [
        ({"a": 'say "hi" now'}, True, None),
        ({"a": 'k": v'}, True, None),
        bad,
        bad,
        ({"a": 1}, False, None),
        ({"a": 2}, False, None),
        ({"a": {"float": "nan"}}, False, None),
        ({"a": 'b"c "d" e'}, True, None),
        bad,
        ({'k "x" y': 1}, True, None),
        (None, False, "[ERR] _extract_json: no data"),
        ({"a": "tail \\"}, False, None),
    ]


def test_repair_leaves_valid_text_alone():
    for text in ['{"a":"x","b":["y",{"c":"z"}]}', '{"a" : "q\\"r" , "b":""}']:
        assert ru.escape_inner_quotes(text) == text


def checked(spark, *texts, check_output=False):
    rows = [(f"r{i:02d}", t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id string, j string, err string")
    df = df.select("request_id", F.parse_json("j").alias("data"), "err")
    return ru.validate_review_payloads(df, check_output)


def test_validation(spark):
    fields = '"overview":"a","review":"b"'
    df = checked(
        spark,
        '{"overview":null,"review":null}',
        "{%s,\"notes\":0,\"issues\":{},\"design\":[]}" % fields,
        '{%s,"error":" "}' % fields,
        "[1]",
        '{"review":"b"}',
        '{%s,"design":["x"]}' % fields,
        '{%s,"notes":"x","issues":"y"}' % fields,
        '{%s,"error":"boom"}' % fields,
        '{%s,"error":5}' % fields,
        '{%s,"error":false,"notes":["x",1,null]}' % fields,
    )
    say = "[ERR] _data_check: "
    assert by_id(df, "err", "severity") == [
        (None, "OK"), (None, "OK"), (None, "OK"),
        (say + "<data> must be a dictionary", "ERROR"),
        (say + "required keys not found", "ERROR"),
        (say + "<design> must be a string", "ERROR"),
        (say + "<notes> must be a string list", "ERROR"),
        (say + "<error> = boom", "ERROR"),
        (say + "<error> = 5", "ERROR"),
        (None, "OK"),
    ]
    rows = {r.request_id: r.data for r in df.collect()}
    assert (rows["r00"].overview, rows["r00"].design, rows["r00"].notes) == (None, "", [])
    assert rows["r01"].notes == [] and rows["r01"].issues == [] and rows["r01"].design == ""
    assert rows["r09"].notes == ["x"]
    assert by_id(checked(spark, "{%s}" % fields, '{%s,"output":""}' % fields, check_output=True), "err") == [
        (say + "<output> must be a string",), (None,),
    ]


def attempts(spark, *rows):
    schema = "request_id string, attempt int, data struct<overview:string,output:string>, err string, input string"
    full = [("r", n, ("o", out) if out is not None else None, err, "source") for n, out, err in rows]
    return spark.createDataFrame(full, schema)


@pytest.mark.parametrize(
    "rows, retry, expected",
    [
        ([(1, "x", "[WARNING] w"), (2, None, "[ERR] e")], 2, ("FAILED", 2, None)),
        ([(1, None, "[ERR] e"), (2, "x", "[WARNING] w")], 2, ("METADATA_ONLY", 2, ("o", "source"))),
        ([(1, "x", None), (2, "y", None)], 2, ("OK", 1, ("o", "x"))),
        ([(1, "x", "[WARNING] w"), (2, "y", None)], 2, ("OK", 2, ("o", "y"))),
        ([(1, "x", "[WARNING] w"), (2, "y", None)], 1, ("METADATA_ONLY", 1, ("o", "source"))),
        ([(1, None, "[ERR] e")], 3, ("FAILED", 1, None)),
    ],
)
def test_attempts(spark, rows, retry, expected):
    got = at.resolve_attempts(attempts(spark, *rows), retry).first()
    assert (got.outcome, got.attempt, tuple(got.data) if got.data else None) == expected


ISSUES = "---------- [Review]\n---------- [Issues]\nx"
BLOCKED = ISSUES + "\n---------- [Impediments]\ny"
CLEAN = "---------- [Review]\nfine"


@pytest.mark.parametrize(
    "rows, budget, expected",
    [
        ([(1, True, True, None)], 3, ("FAILED", 1)),
        ([(1, True, True, ISSUES), (2, True, True, ISSUES)], 2, ("EXHAUSTED", 2)),
        ([(1, False, False, None), (2, True, True, CLEAN)], 3, ("RESOLVED", 2)),
        ([(1, True, False, None), (2, True, True, BLOCKED), (3, True, True, CLEAN)], 3, ("BLOCKED", 2)),
        ([(1, False, False, None), (2, False, False, None)], 2, ("FAILED", 2)),
        ([(0, None, None, CLEAN)], 2, ("RESOLVED", 0)),
        ([(0, None, None, "")], 2, ("EMPTY", 0)),
        ([(0, None, None, None)], 2, ("FAILED", 0)),
        ([(0, None, None, ISSUES), (1, True, True, ISSUES)], 3, ("OPEN", 1)),
    ],
)
def test_fix_passes(spark, rows, budget, expected):
    schema = "path string, pass_no int, fix_ok boolean, output_present boolean, review string"
    df = spark.createDataFrame([("p", *r) for r in rows], schema)
    got = at.resolve_fix_passes(df, budget).first()
    assert (got.outcome, got.passes_used) == expected


def test_fix_context(spark):
    schema = "path string, pass_no int, fix_ok boolean, output_present boolean, fix_overview string, fix_review string"
    rows = [("p", 1, True, True, "o1", "r1"), ("p", 2, False, False, "o2", "r2"), ("p", 3, True, True, "", "r3"), ("p", 4, True, True, "o4", "")]
    df = at.accumulate_fix_context(spark.createDataFrame(rows, schema), 4, "ctx")
    got = [r.context for r in df.orderBy("pass_no").collect()]
    first = "ctx\n[Bug fix]\no1\n[Discussion]\nr1\n"
    assert got == ["ctx", first, first, first + "\n[Discussion]\nr3\n"]


def test_fix_status(spark):
    rows = [("a", CLEAN), ("b", ISSUES), ("c", BLOCKED), ("d", "---------- [Issues]"), ("e", None)]
    got = at.fix_status(spark.createDataFrame(rows, "path string, review string"))
    assert {r.path: r.status for r in got.collect()} == {
        "a": "resolved", "b": "to_fix", "c": "blocked", "d": "never_reviewed", "e": "never_reviewed",
    }


def test_backslashes_are_scanned_once():
    start = time.time()
    assert ru.escape_inner_quotes("\\" * 400_000)
    assert time.time() - start < 5


def test_output_with_repeated_keys_and_nan(spark):
    claude = ['{"result":"x","cost":NaN,"result":"{}"}', '{"result":NaN}', "NaN", '{"result":"\ue0ff"}']
    assert by_id(ru.extract_run_payload(runs(spark, *claude, provider="claude")), "payload", "err") == [
        ("{}", None), (None, ru.ERR_NO_RESULT), (None, ru.ERR_STDOUT_KIND), ("\ue0ff", None),
    ]
    line = '{"type":"x","type":"item.completed","cost":NaN,"item":{"type":"agent_message","text":"hi"}}'
    assert by_id(ru.extract_run_payload(runs(spark, line)), "payload", "err") == [("hi", None)]
    events = spark.createDataFrame([("r", 1, line)], "request_id string, seq long, line string")
    assert ru.first_agent_message(events).first().text == "hi"
