"""Golden values of the scalar expressions."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.functions import comments as c
from glosswork.functions import paths as p
from glosswork.functions import render as r
from glosswork.functions import replies
from glosswork.functions import text as t
from glosswork.functions import variants as v
from glosswork.languages import LANGUAGES, Language, check_registry, languages

V = None
BY_NAME = {lang.name: lang for lang in LANGUAGES}


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    global V
    V = F.col("v")


def markers(name):
    lang = BY_NAME[name]
    return c.Markers.of(F.lit(lang.line_prefix), F.lit(lang.block_prefix), F.lit(lang.block_suffix))


def test_file_extension(evaluate):
    names = [".py", "a.py", "..py", "x.tar.gz", "a.", "d.x/Makefile", "d/.b.py", "A.PY", "a..", None]
    assert evaluate(names, p.file_extension(V)) == [
        "", ".py", "", ".gz", ".", "", ".py", ".py", ".", None,
    ]


def test_splitlines_matches_python(evaluate):
    texts = ["", "\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i", "x", "\r\n\r\n", "a\x1fb"]
    assert evaluate(texts, t.py_splitlines(V)) == [s.splitlines() for s in texts]


def test_strip_matches_python(evaluate):
    texts = ["", "  ", "\u3000a b\xa0\x1c", "\x1f\x85x \t\n", "\u200bx", "é "]
    assert evaluate(texts, t.py_strip(V)) == [s.strip() for s in texts]


def test_json_text_matches_python(evaluate):
    texts = ["", 'q"b\\n', "\x00\x0b\x1f\\u001F\\\\\x1a", "é\u2028/\t\r\n\x7f", "\\\x0b"]
    assert evaluate(texts, t.json_string(V)) == [json.dumps(s, ensure_ascii=False) for s in texts]


def test_ordinal(evaluate):
    n = [1, 2, 3, 4, 11, 12, 13, 21, 111, 112, 121]
    assert evaluate(n, t.ordinal(V), "v int") == (
        "1st 2nd 3rd 4th 11th 12th 13th 21st 111th 112th 121st".split()
    )


def test_value_hash(evaluate):
    assert evaluate(["abc"], t.value_hash(V)) == ["ba7816bf8f01cfea414140de5dae2223"]


@pytest.mark.parametrize(
    "language, text, expected",
    [
        ("python", "a\n\nb", "#\\/ a\n\n#\\/ b"),
        ("html", "a", "<!--\\/ a -->"),
        ("html", "a\nb", "<!--\\/\na\nb\n-->"),
        ("c", " \t", " \t"),
        ("html", "x --> y", None),
    ],
)
def test_line_comment(evaluate, language, text, expected):
    assert evaluate([text], c.line_comment(V, "\\/", markers(language))) == [expected]


def test_block_comment(evaluate):
    assert evaluate(["a"], c.block_comment(V, "", markers("bash"))) == ["# a"]
    assert evaluate(["a", "a\nb"], c.block_comment(V, "", markers("python"))) == [
        '""" a """', '"""\na\nb\n"""',
    ]
    assert evaluate(["x */ y", "x"], c.block_comment(V, "", markers("c"))) == [None, "/* x */"]
    assert evaluate(["x */ y", "x"], c.comment_error(V, True, markers("c"))) == [
        "Block comment suffix '*/' found in comment", None,
    ]
    assert evaluate(["x */ y"], c.comment_error(V, False, markers("c"))) == [None]


def test_match_tagged_line(evaluate):
    assert evaluate(["<!-->", "<!-- a -->", "x <!-- a -->", "<!-- a"], c.match_tagged_line(V, "", markers("html"))) == [
        "", "a", None, None,
    ]
    assert evaluate(["  #\\/B ", "#\\/ A", "y #\\/ no", "#\\% r"], c.match_tagged_line(V, "\\/", markers("python"))) == [
        "B", "A", None, None,
    ]


def test_comment_language(evaluate):
    lists = [["$lang: Simplified Chinese"], ["$lang:", "$lang: X"], [], ["a", "$lang:fr"]]
    assert evaluate(lists, c.comment_language(V), "v array<string>") == [
        "Simplified", "English", "English", "fr",
    ]
    texts = ["$lang: German\nx", "x\n$lang: German", "$lang:", "$lang:\nGerman"]
    assert evaluate(texts, c.report_language(V)) == ["German", "English", "English", "English"]


def test_language_override(evaluate):
    assert evaluate(["", " fr ", None], c.language_override(V, F.lit("English"))) == [
        "English", "fr", "English",
    ]


def test_relative_path(evaluate):
    paths = ["a/../b.py", "/w/p/c.py", "../x", "/w/p", "/w/pq/x", "./d//e.py", "/../w/p/z"]
    assert evaluate(paths, p.relative_path(V, F.lit("/w/p"))) == [
        "b.py", "c.py", None, ".", None, "d/e.py", "z",
    ]
    assert evaluate(["a", "/b/c"], p.relative_path(V, F.lit("/"))) == ["a", "b/c"]


def test_parent_folder(evaluate):
    assert evaluate(["a/b.py", "b.py", "/b.py", "/a/b/c"], p.parent_folder(V)) == [
        "a", ".", "/", "/a/b",
    ]


def test_strip_fence(evaluate):
    texts = [
        'x```json{"a":1}```y', '```json{"a":1}', "```json A``` m ```json B```", "", "``` x ```",
        "é```json{}``` ü",
    ]
    assert evaluate(texts, replies.strip_fence(V)) == [
        '{"a":1}', None, " A``` m ```json B", None, None, "{}",
    ]


def test_agent_message(evaluate):
    message = '{"type":"item.completed","item":{"type":"agent_message","text":%s}}'
    lines = [
        message % '"hi"', message % "5", message % '"x ```json {} ``` y"', message % '""',
        '{"msg":{"type":"agent_message","message":"old"}}',
        '{"type":"item.completed","item":{"type":"agent_message","text":1},'
        '"msg":{"type":"agent_message","message":"both"}}',
        '{"msg":{"type":"agent\\u005fmessage","message":"esc"}}',
        '{"type":"item.completed","item":{"type":"reasoning","text":"agent_message"}}',
        (message % '"x"') + " trailing", "noise agent_message", " " + (message % '"pad"') + "\u3000",
    ]
    assert evaluate(lines, replies.agent_message(V)) == [
        "hi", None, " {} ", "", "old", "both", "esc", None, None, None, "pad",
    ]


def test_strict_json(evaluate):
    texts = ['{"a":1} x', '{"a":1}\n', "[1]", "null", '{"a":1}{"b":2}', "1,2", "1],[2", "", " 1 ", "NaN", '"x', "{}"]
    assert evaluate(texts, v.strict_json(V).isNotNull()) == [
        False, True, True, True, False, False, False, False, True, False, False, True,
    ]


def test_run_budget(evaluate):
    rows = [(0, 0, 0), (1, 1024, 0), (2, 2047, 0), (3, 2048, 0), (4, 3072, -10), (5, 9999, 45)]
    texts = [("x" * n, timeout) for _, n, timeout in rows]
    got = evaluate(texts, r.run_budget(V["s"], F.lit(""), V["t"]), "v struct<s:string,t:int>")
    assert got == [300, 360, 360, 420, 330, 45]


def test_file_tree_and_list(evaluate):
    got = evaluate(
        [(["a.py", "b.py"], ["s/.REVIEW.md"]), (["a"], []), ([], [])],
        r.file_tree(V["f"], V["s"]),
        "v struct<f:array<string>,s:array<string>>",
    )
    assert got == [
        "    ├── a.py\n    ├── b.py\n    └──── s/.REVIEW.md\n", "    └── a\n", "",
    ]
    assert evaluate([["x", "1"], [], None], r.md_list(V, "Notes"), "v array<string>") == [
        "\n# Notes:\n- x\n- 1\n", "", "",
    ]


def test_fix_summary(evaluate):
    got = evaluate(
        [("b", "d"), ("", "d"), (None, None)], r.fix_summary(V["o"], V["r"]), "v struct<o:string,r:string>"
    )
    assert got == ["[Bug fix]\nb\n[Discussion]\nd\n", "[Discussion]\nd\n", ""]


def test_registry(spark):
    assert languages(spark).count() == 19
    check_registry(LANGUAGES)
    with pytest.raises(ValueError, match="Extension .py"):
        check_registry((*LANGUAGES, Language("other", (".PY",))))
    with pytest.raises(ValueError, match="Language go"):
        check_registry((*LANGUAGES, Language("go", (".x",))))


def test_lenient_json(evaluate):
    texts = ['{"a":NaN,"b":"NaN \\" -Infinity"}', "[-Infinity,Infinity]", "-NaN", "NaN", '{"a":"NaN}', '{"a":"\ue0ff"}', "NaN" * 3, None]
    assert evaluate(texts, F.to_json(v.lenient_json(V))) == [
        '{"a":null,"b":"NaN \\" -Infinity"}', "[null,null]", None, "null", None, '{"a":"\ue0ff"}', None, None,
    ]
    long = '{"a":"' + "x\\n" * 200_000 + '","b":[' + "NaN," * 20_000 + "1]}"
    assert evaluate([long], v.lenient_json(V).isNotNull()) == [True]
