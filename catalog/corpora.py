"""Source files, run logs and edits derived from the given tables.

Each corpus is a chain of projections in the common subset of Spark SQL and DuckDB, so the
same text builds it for the jobs and for their SQL counterparts. All chains are narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.sources.files import spread

_BS = "chr(92)"
_NL = "chr(10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those with long texts are spread over the cores when they are small."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def spark_steps(df: DataFrame, steps: list[list[str]], where: str | None = None) -> DataFrame:
    if where:
        df = df.filter(where)
    for step in steps:
        df = df.selectExpr(*step)
    return df


def sql_steps(relation: str, steps: list[list[str]], where: str | None = None) -> str:
    sql = f"SELECT * FROM {relation}" + (f" WHERE {where}" if where else "")
    for step in steps:
        sql = f"SELECT {', '.join(step)} FROM ({sql})"
    return sql


# Lines of code that a scanner without state reads wrongly, by file extension: literals that hold
# comment marks, comments that hold quotes. The second text has literals in marks and no comments.
MARKS = ("\ue001", "\ue002")
PLANTED = {
    ".py": ("f(a, # it's\n  b)", "f(a,    b)"),
    ".PY": ("f(a, # it's\n  b)", "f(a,    b)"),
    ".ts": ("r = /[/*]/g; // it's", "r = «/[/*]/g»;"),
    ".java": ('s = """\n // x "y"\n""";', 's = «"""\n // x "y"\n"""»;'),
    ".c": ("#include <a//b.h> // c", "«#include <a//b.h>»"),
    ".cpp": ('s = R"x(// ")x"; // c', 's = «R"x(// ")x"»;'),
    ".cs": ('s = @"a""//b"; /* " */', 's = «@"a""//b"»;'),
    ".go": ("s := `// x`; c := '\"' // d", "s := «`// x`»; c := «'\"'»"),
    ".rs": ("fn f<'a>(x: &'a str) { '\"' } /* it's /* nested */ */", "fn f<'a>(x: &'a str) { «'\"'» }"),
    ".sh": ('cat <<E\n# x "\nE', 'cat <<E\n«# x "\nE»'),
    ".html": ('<p title="<!--">x</p><script>a<!--b</script>', '<p title=«"<!--"»>x</p><script>«a<!--b»</script>'),
}
# Code that can be read in two ways, in every third file of two languages.
AMBIGUOUS = {
    13: ("function g() {} /x/g\n", "function g() {} «/x/g»\n"),
    5: ('s = $"{d["k"]}";\n', 's = «$"{d["»k«"]}"»;\n'),
}
IS_AMBIGUOUS = f"doc_id % 36 IN ({', '.join(map(str, sorted(AMBIGUOUS)))})"


def _text(value: str) -> str:
    """A text as an expression of both dialects, marks and special characters by their code."""
    value = value.replace("«", MARKS[0]).replace("»", MARKS[1])
    parts, plain = [], ""
    for ch in value:
        if ch in "'\\\n" or ord(ch) > 126:
            parts += [f"'{plain}'"] * bool(plain) + [f"chr({ord(ch)})" if ord(ch) < 127 else f"'{ch}'"]
            plain = ""
        else:
            plain += ch
    parts += [f"'{plain}'"] * bool(plain)
    return f"concat({', '.join(parts)})"


def _planted(k: int) -> str:
    cases = " ".join(f"WHEN '{ext}' THEN {_text(pair[k])}" for ext, pair in PLANTED.items())
    return f"CASE ext {cases} ELSE 'plain' END"


def _ambiguous(k: int) -> str:
    cases = " ".join(f"WHEN {n} THEN {_text(pair[k])}" for n, pair in AMBIGUOUS.items())
    return f"CASE doc_id % 36 {cases} ELSE '' END"


_LINE = (
    "CASE WHEN {i} % 7 = 3 THEN concat(pre, chr(92), '/ ', x, suf) "
    "WHEN {i} % 7 = 5 THEN concat('  ', pre, ' ', x, suf) WHEN {i} % 11 = 4 THEN " + _planted(0) + " ELSE x END"
)
SPARK_LINES = (
    "array_join(transform(split(text, '\\n'), (x, i) -> " + _LINE.replace("{i}", "i") + "), '\\n')"
)
SQL_LINES = (
    "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: "
    + _LINE.replace("{i}", "(i - 1)") + "), chr(10))"
)
# The same lines with comments left out and literals marked; `prose` marks those of the given texts.
SQL_MARKED_LINES = (
    "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 IN (3, 5) THEN '' "
    "WHEN (i - 1) % 11 = 4 THEN " + _planted(1) + " ELSE {prose} END), chr(10))"
)


def source_steps(lines: str) -> list[list[str]]:
    """Files in ten languages, some of them reviewed, with issues or with requirements."""
    return [
        [
            "doc_id", "text",
            "CASE doc_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' "
            "WHEN 3 THEN '.c' WHEN 4 THEN '.cpp' WHEN 5 THEN '.cs' WHEN 6 THEN '.go' "
            "WHEN 7 THEN '.rs' WHEN 8 THEN '.sh' WHEN 9 THEN '.html' WHEN 10 THEN '.PY' "
            "ELSE '.txt' END AS ext",
        ],
        [
            "*",
            "CASE WHEN ext IN ('.py', '.PY', '.sh', '.txt') THEN '#' "
            "WHEN ext = '.html' THEN '<!--' ELSE '//' END AS pre",
            "CASE WHEN ext = '.html' THEN ' -->' ELSE '' END AS suf",
        ],
        [
            "doc_id", "pre", "suf",
            "concat('p', doc_id % 5, '/m', doc_id % 3, '/f', doc_id, ext) AS path",
            "concat("
            f"CASE WHEN doc_id % 4 <> 0 THEN concat(pre, {_BS}, '/ ---------- [Review]', suf, {_NL}) ELSE '' END, "
            f"CASE WHEN doc_id % 6 = 1 THEN concat(pre, {_BS}, '/ ---------- [Issues]', suf, {_NL}) ELSE '' END, "
            f"CASE WHEN doc_id % 5 = 2 THEN concat(pre, {_BS}, '% keep order', suf, {_NL}) ELSE '' END, "
            f"{_ambiguous(0)}, {lines}) AS content",
        ],
    ]


def marked_steps(prose: str) -> list[list[str]]:
    """The same files without comments and with marked literals, for the SQL of token lists."""
    first, second, last = source_steps("''")
    return [first, second, [*last[:-1], "ext", f"concat({_ambiguous(1)}, {SQL_MARKED_LINES.replace("{prose}", prose)}) AS marked"]]


HTML_STEPS = [["concat('h/', page_id, '.html') AS path", "html AS content"]]

OLD_WHERE, NEW_WHERE = "doc_id % 10 <> 3", "doc_id % 10 <> 0"
NEW_STEPS = [
    [
        "path",
        f"CASE WHEN doc_id % 10 = 1 THEN concat(pre, ' note', suf, {_NL}, content) "
        f"WHEN doc_id % 10 = 2 THEN concat(content, {_NL}, 'zz') ELSE content END AS content",
    ]
]

# One edit per document, and a second one for every third; some lines are out of range.
EDIT_STEPS = [
    [
        "path",
        "CAST(doc_id % 41 - 20 AS INT) AS line",
        "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN concat('first ', doc_id, chr(10), 'second') "
        "WHEN doc_id % 7 = 2 THEN concat('stop */ and --> ', doc_id) ELSE concat('edit ', doc_id) END AS comment",
        f"CASE WHEN doc_id % 2 = 0 THEN concat({_BS}, '/') ELSE '' END AS tag",
        "doc_id % 3 = 0 AS block",
    ]
]

RUN_STEPS = [
    [
        "conv_id", "turn",
        "concat('c', conv_id) AS request_id",
        "CAST(turn + 1 AS INT) AS attempt",
        "CASE WHEN conv_id % 2 = 0 THEN 'claude' ELSE 'codex' END AS provider",
        "CAST(CASE WHEN conv_id % 17 = 5 THEN 2 ELSE 0 END AS INT) AS returncode",
        "CASE WHEN conv_id % 34 = 5 THEN concat('failed on ', repeat(text, 3)) ELSE '' END AS stderr",
        "conv_id % 23 = 7 AS timed_out",
        "CASE WHEN conv_id % 23 IN (7, 11) THEN concat('after ', turn, ' turns') END AS exception",
        f"replace(text, chr(10), concat({_BS}, 'n')) AS t",
    ],
    [
        "*",
        "CASE (conv_id + turn) % 6 "
        "WHEN 0 THEN concat('{\"overview\":\"', t, '\",\"review\":\"r\",\"issues\":[\"i1\",\"i2\"],\"output\":\"', t, '\",\"error\":\"\"}') "
        "WHEN 1 THEN concat('{\"overview\":\"', t, '\"}') "
        "WHEN 2 THEN concat('{\"overview\":\"', t, '\",\"review\":\"r\",\"error\":\"boom\"}') "
        "WHEN 3 THEN concat('{\"overview\":\"', t, '\",\"review\":\"r\",\"notes\":\"x\"}') "
        "WHEN 4 THEN 'no object here' "
        "ELSE concat('Here: ```json {\"overview\":\"', t, '\",\"review\":\"r\",\"notes\":[\"a\"],\"output\":\"o\"} ``` done') END AS message",
    ],
    [
        "*",
        f"replace(replace(message, {_BS}, concat({_BS}, {_BS})), '\"', concat({_BS}, '\"')) AS escaped",
    ],
    [
        "conv_id", "turn", "request_id", "attempt", "provider", "returncode", "stderr", "timed_out", "exception",
        "CASE WHEN conv_id % 26 = 4 THEN concat('plain ```json ', message, '```') "
        "WHEN conv_id % 2 = 0 THEN concat('{\"type\":\"result\",\"result\":\"', escaped, '\"}') "
        "WHEN conv_id % 13 = 3 THEN concat('plain', chr(10), 'Here ```json ', message, '```') "
        "WHEN turn % 2 = 0 THEN concat('noise', chr(10), '{\"type\":\"item.completed\",\"item\":{\"type\":\"agent_message\",\"text\":\"', escaped, '\"}}') "
        "ELSE concat('{\"type\":\"start\"}', chr(10), '{\"msg\":{\"type\":\"agent_message\",\"message\":\"', escaped, '\"}}') END AS stdout",
    ],
]

# Replies whose inner quotes were not escaped.
BROKEN_STEPS = [
    ["concat('c', conv_id, '-', turn) AS request_id", f"replace(text, chr(10), concat({_BS}, 'n')) AS t", "turn"],
    [
        "request_id", "turn",
        "CASE WHEN turn % 3 = 0 THEN concat('{\"overview\":\"say \"', t, '\" now\",\"n\":1}') "
        "WHEN turn % 3 = 1 THEN concat('{\"overview\":\"', t, '\",\"n\":1}') "
        "ELSE concat('{\"overview\":\"', t, ' \"x\", y\"}') END AS json_text",
        "CAST(NULL AS STRING) AS err",
    ],
]

EVENT_STEPS = [
    [
        "concat('u', user_id) AS request_id", "event_id AS seq", "ts",
        "CASE event_type "
        "WHEN 'purchase' THEN concat('{\"type\":\"item.completed\",\"item\":{\"type\":\"agent_message\",\"text\":\"m', event_id, '\"}}') "
        "WHEN 'signup' THEN concat('{\"msg\":{\"type\":\"agent_message\",\"message\":\"s', event_id, '\"}}') "
        "WHEN 'view' THEN concat('{\"type\":\"item.completed\",\"item\":{\"type\":\"reasoning\",\"text\":\"r', event_id, '\"}}') "
        "WHEN 'error' THEN 'not json' ELSE '' END AS line",
    ]
]

# Directory listing with reference documents, reports and other files.
LISTING_STEPS = [
    [
        "concat('p', doc_id % 5, '/m', doc_id % 3, '/', "
        "CASE doc_id % 4 WHEN 0 THEN concat('N', doc_id, '.md') WHEN 1 THEN concat('N', doc_id, '.REVIEW.md') "
        "WHEN 2 THEN concat('n', doc_id, '.txt') ELSE concat('Guide ', doc_id, '.md') END) AS path",
    ]
]

# Recorded fix loops of three passes per file.
PASS_STEPS = [
    [
        "path",
        "CAST(pass_no AS INT) AS pass_no",
        "(doc_id + pass_no) % 5 <> 0 AS fix_ok",
        "(doc_id + pass_no) % 7 <> 0 AS output_present",
        "CASE (doc_id * 3 + pass_no * 5) % 11 WHEN 0 THEN NULL WHEN 1 THEN '---------- [Review]' "
        "WHEN 2 THEN '' WHEN 3 THEN concat('---------- [Review]', chr(10), '---------- [Issues]', chr(10), '---------- [Impediments]') "
        "ELSE concat('---------- [Review]', chr(10), '---------- [Issues]', chr(10), 'left') END AS review",
        "CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('fixed ', pass_no) END AS fix_overview",
        "concat('about ', doc_id) AS fix_review",
    ]
]
