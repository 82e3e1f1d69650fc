"""Scanning comments and literals with state: golden texts, certainty, and time in the length of a text."""

import random
import time

import pytest

from glosswork.functions.scanner import CLOSE, OPEN, STOPS, scan
from glosswork.operators import fingerprint as fg

PATHS = {"bash": "a.sh", "typescript": "a.ts", "rust": "a.rs", "cpp": "a.cpp", "c": "a.c", "c_sharp": "a.cs", "java": "a.java", "go": "a.go",
         "python": "a.py", "html": "a.html"}


def marked(text, language):
    got, sure = scan(text, language)
    return got.replace(OPEN, "«").replace(CLOSE, "»"), sure


@pytest.mark.parametrize("language, text, expected", [
    ("bash", "cat <<E\n# x=1\nE\n", "cat <<E\n«# x=1\nE»\n"),
    ("bash", "cat <<-\"E\" | grep x # c\n\tabc\n\tE\nls", "cat <<-\"E\" | grep x \n«\tabc\n\tE»\nls"),
    ("bash", "a <<X <<Y\n#1\nX\n#2\nY\nb", "a <<X <<Y\n«#1\nX»«\n#2\nY»\nb"),
    ("bash", "cat <<<x # c", "cat <<<x "),
    ("bash", 'echo "$(echo "x # y")" # c', 'echo «"$(echo "x # y")"» '),
    ("bash", "echo it\\'s # c", "echo it«\\'»s "),
    ("bash", "x=${#a}; y=$# # c", "x=${#a}; y=$# "),
    ("bash", "a$'\\'#' 'b # c' # d", "a«$'\\'#'» «'b # c'» "),
    ("typescript", "r = /[/*]/; a = 1; /* z */", "r = «/[/*]/»; a = 1;  "),
    ("typescript", "r=/\\/\\//; x=1", "r=«/\\/\\//»; x=1"),
    ("typescript", "r = /[//]/; y=2", "r = «/[//]/»; y=2"),
    ("typescript", "a = b / c; // d / e", "a = b / c;  "),
    ("typescript", "if (x) /re/.test(y); (a+b)/c/d; z[0]/e/f", "if (x) «/re/».test(y); (a+b)/c/d; z[0]/e/f"),
    ("typescript", "return /a\"b/g; o.return /a/ b", "return «/a\"b/g»; o.return /a/ b"),
    ("typescript", "a = /* c */ /x'/ // d", "a =   «/x'/»  "),
    ("typescript", "`a ${ b + `c ${d}` } // e` // f", "«`a ${» b + «`c ${»d«}`» «} // e`»  "),
    ("typescript", "const o = {a: 1} / 2; x++ / 3", "const o = {a: 1} / 2; x++ / 3"),
    ("typescript", "#!/usr/bin/env it's\nx", "«#!/usr/bin/env it's»\nx"),
    ("rust", "fn f<'a>(x: &'a str) { let c = 'x'; let q = '\\''; } // d", "fn f<'a>(x: &'a str) { let c = «'x'»; let q = «'\\''»; }  "),
    ("rust", 'let s = r#"a "/* b"#; /* x /* y */ z */ k', 'let s = «r#"a "/* b"#»;   k'),
    ("rust", 'let s = "a\n // b"; // c', 'let s = «"a\n // b"»;  '),
    ("cpp", "s = R\"x(// \")x\"; // c\nn = 1'000'000; // d", "s = «R\"x(// \")x\"»;  \nn = 1'000'000;  "),
    ("c", "#include <a//b.h>\n#define A 1 // x\nint b;", "«#include <a//b.h>»«\n»#define A 1  «\n»int b;"),
    ("c", "#define A \\\n 1\nb", "#define A  1«\n»b"),
    ("c", "x\n#endif // y", "x\n#endif  «\n»"),
    ("c", "// a \\\n b\nc", "\n\nc"),
    ("c_sharp", 's = @"a""//b"; t = $"{x}"; // c', 's = «@"a""//b"»; t = «$"{x}"»;  '),
    ("c_sharp", 's = """"\n"""//\n""""; // c', 's = «""""\n"""//\n""""»;  '),
    ("java", 's = """\n "x" // y\n """; // z', 's = «"""\n "x" // y\n """»;  '),
    ("go", "s := `// x`; c := '\"' // d", "s := «`// x`»; c := «'\"'»  "),
    ("python", 'f(a, # c\n  b)\nx = r"\\" # d"\n', 'f(a,    b)\nx = «r"\\" # d"»\n'),
    ("python", 's = """a # b\n"""  # c', 's = «"""a # b\n"""»  '),
    ("python", "x = a \\\n + rb'it\\'s' # e\n", "x = a   + «rb'it\\'s'» \n"),
    ("html", '<p a="<!-- x -->">t<!-- c --><script>if (a<!--b) "</p>"</script><!---->z', '<p a=«"<!-- x -->"»>t <script>«if (a<!--b) "</p>"»</script> z'),
    ("html", "it's <b>x</b> \"<!-- c -->\"", "it's <b>x</b> \" \""),
])
def test_scan(language, text, expected):
    assert marked(text, language) == (expected, True)


@pytest.mark.parametrize("language, text", [
    ("bash", "a=$((1<<2)); b"), ("bash", "cat <<E\nx"), ("bash", "echo 'x"), ("bash", 'echo "x'), ("bash", 'echo "`echo "x"`"'),
    ("typescript", "function f() {} /re/g"), ("typescript", "a = 'x"), ("typescript", "`a ${b"), ("typescript", "<p>it's</p>"), ("typescript", "f(/* x"),
    ("typescript", "<a>{b}</a>"), ("typescript", "f(x"), ("c_sharp", 's = $"{d["k"]}"; // c'), ("c", "/* x"), ("c", "don't"), ("rust", "/* /* x */"),
    ("rust", 'r#"x"'), ("cpp", 'R"y(x"'), ("python", 'x = f"{d["k"]}" # e'), ("python", "f(x"), ("python", "x)"), ("python", '"""x'), ("python", "'x\n"),
    ("html", "<!-- x"), ("html", "<p a='x"), ("html", "<script>x"), ("html", "<![CDATA[x]]>"),
])
def test_texts_that_read_in_more_than_one_way(language, text):
    assert not scan(text, language)[1]


def prints(spark, path, *texts):
    files = spark.createDataFrame([(f"{i}/{path}", t) for i, t in enumerate(texts)], "path string, content string")
    got = fg.structural_fingerprints(files).collect()
    return [(r.fingerprint, r.confidence) for r in sorted(got, key=lambda r: int(r.path.split("/")[0]))]


DIFFERENT = [
    ("a.sh", "cat <<E\n# x=1\nE", "cat <<E\n# x=2\nE"), ("a.ts", "r = /[/*]/; a = 1; /* z */", "r = /[/*]/; a = 2;"),
    ("a.ts", "r=/\\/\\//; x=1", "r=/\\/\\//; x=2"), ("a.ts", "r = /[//]/; y=2", "r = /[//]/; y=3"), ("a.rs", "/* /* a */ b */ c", "/* /* a */ b */ d"),
    ("a.rs", 's = r#"// 1"#', 's = r#"// 2"#'), ("a.cpp", 's = R"(// 1)"', 's = R"(// 2)"'), ("a.cs", 's = @"\\"; a', 's = @"\\"; b'),
    ("a.html", "<script>x <!-- 1 --></script>", "<script>x <!-- 2 --></script>"), ("a.c", "x = y-- - z", "x = y - --z"), ("a.ts", "return\nx", "return x"),
    ("a.go", "return\nx", "return x"), ("a.sh", 'a"b"', 'a "b"'), ("a.sh", '"a ; b"', '"a;b"'), ("a.c", "#define A 1\nb", "#define A 1 b"),
    ("a.py", 's = "a + - b"', 's = "a +- b"'), ("a.py", "if x:\n  a\n  b", "if x:\n  a\nb"),
]


def test_changed_code_has_another_fingerprint(spark):
    for path, one, other in DIFFERENT:
        (a, sure), (b, also) = prints(spark, path, one, other)
        assert a != b and sure == also == "high", (path, one)


SAME = [
    ("a.py", "f(a,\n  b)", "f(a, # c\n  # d\n  b)"), ("a.py", "x = -1", "x = -1  # c"), ("a.c", "x = -1", "x = /* c */ -1"), ("a.sh", "a; b | c", "a ;b|c # d"),
    ("a.sh", "cat <<E\nx\nE\nls", "cat <<E # c\nx\nE\n  ls"), ("a.ts", "a = /x/\nb", "a = /* c */ /x/ // d\n\n// e\nb"), ("a.go", "a\nb", "a // c\n\n\tb"),
    ("a.ts", "`${a}`", "`${a /* c */}`"), ("a.rs", "fn f<'a>() {}", "fn f<'a>() {} /* it's /* nested */ */"), ("a.c", "#define A 1\nb", "#define A 1 // c\nb"),
]


def test_comments_leave_the_fingerprint(spark):
    for path, one, other in SAME:
        (a, sure), (b, also) = prints(spark, path, one, other)
        assert (a, sure) == (b, also) and sure == "high", (path, one)


@pytest.mark.parametrize("language", sorted(STOPS))
def test_any_text_is_kept_but_for_comments(language):
    """Random mixes of marks: nothing but comments and joined lines goes, and a comment in front changes nothing."""
    rng = random.Random(language)
    marks = ["'", '"', "`", "/", "*", "#", "<<E", "\nE\n", "<!--", "-->", "\\", "\n", "${", "}", "{", "(", ")", "a", " ", "b1", "=", '"""', "r#", "<p ", ">", "$(", "//", "/*", "*/"]
    front = {"python": "# c\n", "bash": "# c\n", "html": "<!-- c -->"}.get(language, "/* c */")
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 25)))
        got, sure = scan(text, language)
        assert got.count(OPEN) == got.count(CLOSE)
        rest = iter(text)
        assert all(c in rest for c in got if c not in OPEN + CLOSE + " \n")  # in order, nothing made up
        if not text.startswith("#!"):
            again, also = scan(front + "\n" + text, language)
            assert also == sure and again.replace(" ", "").lstrip("\n") == got.replace(" ", "").lstrip("\n")


@pytest.mark.parametrize("language", sorted(STOPS))
def test_time_grows_with_the_length(language):
    for piece in ("/* ", "' ", '" ', "` ", '"""', "<<E ", "<!-- ", "<p ", "(", "${", "r#\"", 'R"x(', "\\\"", "a /b/ ", "$(", "\n# x", "{`${"):
        start = time.time()
        scan(piece * 10_000, language)
        assert time.time() - start < 3, piece
