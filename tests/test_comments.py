"""Comment jobs: golden rows, properties, annotation round trip."""

import time

import pytest
from pyspark.sql import functions as F

from glosswork.functions import comments as fc
from glosswork.operators import comments as co
from glosswork.operators import fingerprint as fg
from glosswork.operators import requests as rq


def frame(spark, rows, schema="path string, content string"):
    return spark.createDataFrame(rows, schema)


def extract(spark, text, path="a.py", **kw):
    df = co.extract_tagged_comments(frame(spark, [(path, text)]), "\\/", **kw)
    row = df.first()
    return row["comments"], row["residual"]


def test_extract_goldens(spark):
    assert extract(spark, "#\\/ A\nx=1\n  #\\/B\ny #\\/ no\n") == (["A", "B"], "x=1\ny #\\/ no")
    assert extract(spark, "x\n") == ([], "x")
    assert extract(spark, "x\n", first=5) == ([], "x\n")
    assert extract(spark, "#\\/ A\n#\\/ B\n#\\/ C", first=1, last=1) == (["B"], "#\\/ A\n#\\/ C")
    assert extract(spark, "#\\/ A\n#\\/ B", last=9) == (["A", "B"], "")
    assert extract(spark, "#\\/ A\nb", last=-2) == (["A"], "b")
    assert extract(spark, "") == ([], "")
    assert extract(spark, "<!--\\/ a -->\n<!--\\/\nb\n-->", path="a.htm") == (["a"], "<!--\\/\nb\n-->")
    with pytest.raises(ValueError):
        extract(spark, "x", first=-1)


def test_tagged_comments_table(spark):
    rows = co.tagged_comments(frame(spark, [("a.c", "//\\/ one\nx\n  //\\/ two")]), "\\/").collect()
    assert [(r.ord, r.line_no, r.comment) for r in rows] == [(0, 0, "one"), (1, 2, "two")]


def test_append_goldens(spark):
    files = frame(spark, [("f.py", "a\nb\n"), ("g.py", "a"), ("h.html", "a")])
    edits = frame(
        spark,
        [("f.py", -1, "hi", ""), ("f.py", 2, "x", ""), ("f.py", -3, "x", ""), ("g.py", 0, "", ""),
         ("h.html", 0, "x --> y", ""), ("no.py", 0, "x", ""), ("f.txt", 0, "x", "")],
        "path string, line int, comment string, tag string",
    )
    got = {(r.path, r.line): (r.content, r.err) for r in co.append_line_comments(files, edits).collect()}
    assert got == {
        ("f.py", -1): ("a\nb # hi", None),
        ("f.py", 2): (None, "Line 2 is out of range"),
        ("f.py", -3): (None, "Line -1 is out of range"),
        ("g.py", 0): ("a ", None),
        ("h.html", 0): (None, "Block comment suffix '-->' found in comment"),
        ("no.py", 0): (None, "File not found"),
        ("f.txt", 0): (None, "File not found"),
    }


def test_insert_goldens(spark):
    files = frame(spark, [("f.py", "a\nb"), ("g.c", "")])
    edits = frame(
        spark,
        [("f.py", 99, "h", "", False), ("f.py", -99, "h", "", False), ("f.py", -1, "m\nn", "", True),
         ("g.c", 0, "x", "\\/", False), ("g.c", 1, "x */", "", True)],
        "path string, line int, comment string, tag string, block boolean",
    )
    got = {(r.path, r.line): (r.content, r.err) for r in co.insert_comments(files, edits).collect()}
    assert got == {
        ("f.py", 99): ("a\nb\n# h", None),
        ("f.py", -99): ("# h\na\nb", None),
        ("f.py", -1): ('a\n"""\nm\nn\n"""\nb', None),
        ("g.c", 0): ("//\\/ x", None),
        ("g.c", 1): (None, "Block comment suffix '*/' found in comment"),
    }


def test_reviewable_and_language_differ_on_dot_names(spark):
    files = frame(spark, [(".py", "x"), ("A.PY", "x"), ("a.txt", "x")])
    assert {r.path for r in co.filter_reviewable(files).collect()} == {".py", "A.PY"}
    got = {r.path: (r.language, r.err) for r in co.detect_language(files).collect()}
    assert got == {
        ".py": (None, "Extension  not supported for .py"),
        "A.PY": ("python", None),
        "a.txt": (None, "Extension .txt not supported for a.txt"),
    }


def test_extract_review(spark):
    mark = "#\\/ ---------- [Review]"
    files = frame(
        spark,
        [("a.py", f"{mark}\n#\\/ ok\n#\\% keep\nx"), ("b.py", "#\\/ note\nx"), ("c.py", f"{mark}\nx"), ("d.txt", mark)],
    )
    got = {r.path: r.review for r in co.extract_reviews(files).collect()}
    assert got == {
        "a.py": "---------- [Review]\nok\n---------- [Requirements]\nkeep",
        "b.py": None,
        "c.py": "---------- [Review]",
        "d.txt": None,
    }


@pytest.mark.parametrize("path", ["a.py", "b.go", "c.sh"])
def test_insert_then_extract_is_identity(spark, path):
    text = "first\n\n  second\nlast"
    edits = frame(spark, [(path, 2, "a remark", "\\/", False)], "path string, line int, comment string, tag string, block boolean")
    edited = co.insert_comments(frame(spark, [(path, text)]), edits).select("path", "content")
    row = co.extract_tagged_comments(edited, "\\/").first()
    assert (row.comments, row.residual) == (["a remark"], text)


PAYLOAD = (
    "path string, data struct<overview:string,review:string,design:string,notes:array<string>,"
    "issues:array<string>,imperfections:array<string>,impediments:array<string>,output:string,error:string>"
)


def annotate(spark, path, content, output, **kw):
    requests = rq.build_review_requests(frame(spark, [(path, content)]))
    data = ("all", "good", "", ["n", " "], [], [], [], output, "")
    payloads = spark.createDataFrame([(path, data)], PAYLOAD)
    return co.apply_review_annotations(requests, payloads, "ai", "2025-01-01 00:00:00", **kw).first()


HEADER = (
    "---------- Reviewed by: ai @ 2025-01-01 00:00:00\n$lang: English\n---------- [Overview]\nall\n"
    "---------- [Review]\ngood\n---------- [Notes]\nn\n----------\n"
)


def test_annotations(spark):
    row = annotate(spark, "a.py", "#\\% keep\n#\\% too\nx = 1\n", "#\\/ old\n\nx = 1  # note\n#\\% keep\n\n")
    assert row.review == HEADER
    tagged = "\n".join(f"#\\/ {line}" for line in HEADER.split("\n")[:-1])
    assert row.content == tagged + "\n\n#\\% keep\n#\\% too\n\nx = 1  # note"
    again = annotate(spark, "a.py", row.content, row.content)
    assert again.content == row.content
    assert annotate(spark, "a.py", "x", "", lang=" fr ").review.split("\n")[1] == "$lang: fr"
    assert annotate(spark, "a.py", "x", "").content == tagged + "\n"


def test_html_reviews_do_not_round_trip(spark):
    row = annotate(spark, "a.html", "<p>", "<p>")
    assert row.content == f"<!--\\/\n{HEADER}\n-->\n<p>"
    files = frame(spark, [("a.html", row.content)])
    assert co.extract_reviews(files).first().review is None


def prints(spark, language_path, *texts):
    rows = [(f"{i}/{language_path}", t) for i, t in enumerate(texts)]
    got = fg.structural_fingerprints(frame(spark, rows)).collect()
    return [r.fingerprint for r in sorted(got, key=lambda r: r.path)]


@pytest.mark.parametrize(
    "path, base, same, different",
    [
        ("a.py", "def f(x):\n    return x\n",
         ["def f(x):  # c\n    return x", "# c\n\ndef f(x):\n    # c\n    return x\n# end", "def f( x ):\n    return x"],
         ["def f(x):\n  return x", "def f(y):\n    return x", "def f(x):\n    return 'x'", "def f(x):\n    return x\n\"\"\" c \"\"\""]),
        ("a.ts", "let a = \"q\\\"//x\"; // c\nb(1)", ["let a=\"q\\\"//x\";/* c\n */ b ( 1 )", "let a = \"q\\\"//x\";\nb(1)"],
         ["let a = \"q\\\"//y\"; // c\nb(1)", "let a = \"q\\\"//x\"; b(2)", "let a = 'q\\\"//x'; b(1)"]),
        ("a.sh", "echo ${x#y} # c\nls", ["echo ${x#y}\nls # d", "# c\necho ${x#y}\n\nls"], ["echo ${x#z}\nls", "echo ${x#y} ls"]),
        ("a.html", "<p>a</p>", ["<p>a<!-- c --></p>", "<!-- c\n --><p>a</p>"], ["<p>b</p>", "<p>a</p><br>"]),
        ("a.c", "", ["// c", "/* c */", " \n"], ["x"]),
        ("a.rs", "a", [" a // c\n"], ["a", "a", "a"]),
    ],
)
def test_fingerprint_ignores_comments_only(spark, path, base, same, different):
    first, *rest = prints(spark, path, base, *same, *different)
    assert rest[: len(same)] == [first] * len(same)
    others = rest[len(same):]
    assert first not in others and len(set(others)) == len(others)


def test_fingerprint_of_long_texts(spark):
    texts = ["# c\n\n" * 40_000 + "x", 's = "' + '\\"' * 20_000 + '"', '"""' + '\\"' * 100_000 + '"""', '"' + "a" * 200_000 + '"']
    assert len(set(prints(spark, "a.py", *texts))) == 4


@pytest.mark.parametrize("path, opening", [("a.c", "/* "), ("a.html", "<!-- "), ("a.ts", "` "), ("a.py", "   \t x" * 3), ("a.sh", "' ")])
def test_unclosed_comments_and_quotes_stay_linear(spark, path, opening):
    text = opening * 100_000 + " " * 200_000 + "x"
    start = time.time()
    assert len(set(prints(spark, path, text, text + "y"))) == 2
    assert time.time() - start < 30


def test_unclosed_comment_is_code(spark):
    rows = [("a.c", "/* c */ a /* b"), ("b.c", "a /* b // d"), ("c.html", "<p> <!-- x")]
    files = frame(spark, rows)
    got = {}
    for r in fg.tokenize_sources(files).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append(r.length)
    assert got == {"a.c": [1, 1, 1, 1], "b.c": [1, 1, 1, 1], "c.html": [1, 1, 1, 1, 1, 1, 1, 1]}


def test_tokens_describe_source_bytes(spark):
    files = frame(spark, [("a.js", 'é = "a\\"b" // c')])
    rows = [(r.pos, r.kind, r.length) for r in fg.tokenize_sources(files).orderBy("pos").collect()]
    assert rows == [(0, "name", 2), (1, "symbol", 1), (2, "string", 6)]


def test_language_is_part_of_the_fingerprint(spark):
    got = fg.structural_fingerprints(frame(spark, [("a.c", "x"), ("a.go", "x"), ("a.txt", "x")])).collect()
    assert len({r.fingerprint for r in got}) == 3 and [r.fingerprint for r in got if r.path == "a.txt"] == [None]


@pytest.mark.parametrize("path, code, comment", [
    ("a.ts", 'a = "x/*";', "/* note */"), ("a.ts", 'a = "src/*.ts"; b = "*/";', "/* note */"),
    ("a.ts", "a = `image/*`;", "/* note */"), ("a.html", '<p title="<!--">x</p>', "<!-- note -->"),
    ("a.rs", "fn f<'a>(x: &'a str) {}", "// don't"), ("a.rs", "let c = '\\''; let d = 'x';", "// it's 'a"),
])
def test_comments_around_strings_that_hold_marks(spark, path, code, comment):
    texts = [code, f"{comment}\n{code}", f"{code}\n{comment}\n", f"{comment}\n{code} {comment}"]
    assert len(set(prints(spark, path, *texts))) == 1
    assert len(set(prints(spark, path, code, f"{code}\ny"))) == 2


def test_token_of_a_string_that_holds_an_opening(spark):
    rows = [(r.kind, r.length, r.value_hash) for r in fg.tokenize_sources(frame(spark, [("a.ts", '"x/*"')])).collect()]
    other = fg.tokenize_sources(frame(spark, [("a.ts", '"x/*" /* y */')])).collect()
    assert rows[0][:2] == ("string", 5) and [r.value_hash for r in other] == [rows[0][2]]
