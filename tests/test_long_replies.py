"""Replies beyond the parser's limits: every text comes out whole, by whatever way it went in."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import variants as v
from glosswork.operators import runs as ru

LONG = 25_000_000


def reply(n, special='\\ "quoted" é\n😀 \t/ '):
    text = (special + "x" * 990) * (n // (990 + len(special))) + "end"
    return {"overview": "o", "review": text, "output": text[::-1], "notes": [text[:200_000], "short"], "error": ""}


def runs_of(spark, rows):
    return spark.createDataFrame(rows, "request_id string, attempt int, provider string, returncode int, stdout string")


@pytest.mark.parametrize("provider", ["claude", "codex", "codex-legacy"])
def test_long_result_and_event_lines(spark, provider):
    data = reply(LONG)
    inner = json.dumps(data, ensure_ascii=provider == "claude")
    stdout = {
        "claude": lambda: json.dumps({"type": "result", "result": f"Here: ```json {inner} ```"}),
        "codex": lambda: 'x\n{"type":"start"}\n' + json.dumps({"type": "item.completed", "item": {"type": "agent_message", "text": inner}}),
        "codex-legacy": lambda: json.dumps({"msg": {"type": "agent_message", "message": inner}}, ensure_ascii=False),
    }[provider]()
    got = ru.read_replies(runs_of(spark, [("r", 1, provider.split("-")[0], 0, stdout)]), check_output=True)
    row = got.select("err", F.sha2("data.review", 256).alias("r"), F.sha2("data.output", 256).alias("o"), "data.overview", F.sha2(F.col("data.notes")[0], 256).alias("n"),
                     F.length("data.review").alias("chars")).first()
    from hashlib import sha256
    digest = lambda t: sha256(t.encode()).hexdigest()
    assert row.err is None and row.chars == len(data["review"]) and row.overview == "o"
    assert (row.r, row.o, row.n) == (digest(data["review"]), digest(data["output"]), digest(data["notes"][0]))


def test_long_repaired_texts(spark):
    body = "say so " * (LONG // 7)
    text = '{"overview": "o", "review": "' + body + '"inner" words", "output": "x"}'
    rows = spark.createDataFrame([("r", text, None), ("s", '{"overview": NaN, "review": "' + body + '"}', None)], "request_id string, json_text string, err string")
    got = {r.request_id: r for r in ru.repair_json_rows(rows).select(
        "request_id", "repaired", "err", F.sha2(v.text_of(v.field(F.col("data"), "review"), F.col("aside")), 256).alias("digest")
    ).collect()}
    from hashlib import sha256
    assert (got["r"].repaired, got["r"].err, got["r"].digest) == (True, None, sha256((body + '"inner" words').encode()).hexdigest())
    assert (got["s"].repaired, got["s"].err, got["s"].digest) == (False, None, sha256(body.encode()).hexdigest())


def test_long_errors_and_bad_texts(spark):
    big = "e" * (1 << 21)
    texts = {
        "error": json.dumps({"overview": "", "review": "", "error": big}), "list": json.dumps([big]), "bad": '{"a": "' + big, "control": '{"a": "' + big + '\x01"}',
        "key": json.dumps({"k" * 40_000: 1, "overview": "", "review": big}), "mark": json.dumps({"overview": "3", "review": big + ""}, ensure_ascii=False),
        "empty": json.dumps({"overview": big, "review": ""}),
    }
    rows = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "request_id string, json_text string, err string")
    got = {r.request_id: r for r in ru.validate_review_payloads(ru.repair_json_rows(rows)).select("request_id", "err", "data").collect()}
    assert got["error"].err == "[ERR] _data_check: <error> = " + big
    assert got["list"].err == ru.ERR_NOT_OBJECT and got["bad"].err == got["control"].err == ru.ERR_JSON
    assert got["key"].data.review == big and got["empty"].data.overview == big
    assert (got["mark"].data.overview, got["mark"].data.review) == ("3", big + "")


def test_strings_are_unescaped_as_the_parser_does(evaluate):
    texts = ["", "plain", 'a"b\\c/d\b\f\n\r\t', "é漢😀 \x7f", "😀 A", "\\u0041", "a" * 300]
    literals = [json.dumps(t, ensure_ascii=a) for t in texts for a in (True, False)] + ['"\\/\\u00e9\\uD83D\\uDE00"']
    assert evaluate(literals, v.unescaped(F.col("v"))) == [json.loads(x) for x in literals]
