"""Folder roll-ups, reports, changes, and groups too large for one row."""

import re

import pytest
from pyspark.sql import functions as F

from glosswork.operators import changes as ch
from glosswork.operators import fingerprint as fg
from glosswork.operators import projects as pj
from glosswork.operators import requests as rq
from glosswork.operators import reviews as rv
from glosswork.operators.grouping import collect_in_parts, likely_members

TS = "2025-01-01 00:00:00"


@pytest.fixture(scope="module")
def hot(spark):
    """One folder with a third of all files."""
    rows = [(f"hot/f{i:03d}.py", f"r{i}") for i in range(100)]
    rows += [(f"d{i}/a.py", "r") for i in range(200)]
    return spark.createDataFrame(rows, "path string, review string")


def test_collect_in_parts_is_whole_and_bounded(spark, hot):
    rows = hot.select(F.split("path", "/")[0].alias("folder"), "path", "review")
    got = collect_in_parts(rows, ["folder"], ["path"], ["review"], part_bytes=500)
    sizes = {(r.folder, r.part): len(r["items"]) for r in got.collect()}
    cut = [n for (folder, _), n in sizes.items() if folder == "hot"]
    assert len(cut) > 5 and sum(cut) == 100 and max(cut) < 40
    assert sum(1 for folder, _ in sizes if folder != "hot") == 200
    assert all(r["items"] == sorted(r["items"]) for r in got.collect())


def test_collect_in_parts_takes_null_keys(spark):
    rows = spark.createDataFrame([(None, f"p{i}") for i in range(50)], "k string, path string")
    got = collect_in_parts(rows, ["k"], ["path"], part_bytes=200).collect()
    assert len(got) > 1 and sum(len(r["items"]) for r in got) == 50


def test_project_reviews(spark, hot):
    whole = rv.project_reviews(hot)
    assert whole.filter("folder = 'hot'").count() == 1
    cut = rv.project_reviews(hot, part_bytes=600).filter("folder = 'hot'")
    assert cut.count() > 1
    pairs = {tuple(r) for r in cut.select(F.explode("reviews")).collect()}
    assert pairs == {(f"hot/f{i:03d}.py", f"r{i}") for i in range(100)}


def test_review_counts(spark):
    df = spark.createDataFrame([("a/x.py", ""), ("a/y.py", None), ("b/z.py", "r")], "path string, review string")
    assert {tuple(r) for r in rv.review_counts(df).collect()} == {("a", 1), ("b", 1)}


def test_references(spark):
    docs = spark.createDataFrame([("a", f"a/{i}.md") for i in range(30)] + [("b", "b/z.md")], "folder string, path string")
    files = spark.createDataFrame([("a/x.py",), ("b/y.py",), ("c/z.py",)], "path string")
    got = {r.path: r for r in rq.attach_references(files, docs).collect()}
    assert got["a/x.py"].references == sorted(f"a/{i}.md" for i in range(30))
    assert got["b/y.py"].references == ["b/z.md"] and got["c/z.py"].references == []
    assert got["c/z.py"].reference_parts == 0
    cut = {r.path: r for r in rq.attach_references(files, docs, part_bytes=200).collect()}
    assert cut["a/x.py"].references is None and cut["a/x.py"].reference_parts > 1
    parts = rq.folder_references(docs, part_bytes=200).filter("folder = 'a'").collect()
    assert sorted(x for r in parts for x in r.references) == got["a/x.py"].references


def test_submodules(spark):
    folders = spark.createDataFrame([(f,) for f in ["p", "p/a", "p/.git", "p/b", "p/a/x", "q"]], "folder string")
    reports = spark.createDataFrame([(f, "r") for f in ["p/a", "p/.git", "p/a/x", "z"]], "folder string, report string")
    got = {r.folder: r.sub_module_reviews for r in rv.submodule_reviews(folders, reports).collect()}
    assert got == {"p": ["p/a/.REVIEW.md"], "p/a": ["p/a/x/.REVIEW.md"]}


def replies(spark, **by_folder):
    rows = [(folder, text) for folder, text in by_folder.items()]
    return spark.createDataFrame(rows, "folder string, j string").select("folder", F.parse_json("j").alias("raw"))


def entries(spark, *rows):
    return spark.createDataFrame(rows, "folder string, kind int, path string")


def test_report(spark):
    listing = entries(spark, ("p", 0, "/p/b.py"), ("p", 0, "/p/a.py"), ("p", 1, "s/.REVIEW.md"))
    reply = replies(
        spark,
        p='{"overview":"o","review":"r","design":"","notes":["x",1],"issues":[],"imperfections":["i"]}',
        q='{"overview":null,"review":true}',
    )
    got = {r.folder: r.report for r in rv.render_project_reports(listing, reply, "ai", TS).collect()}
    assert got["p"] == (
        f"$lang: English\n---------- Reviewed by: ai @ {TS}\n\np/.REVIEW.md\n    ├── a.py\n    ├── b.py\n"
        "    └──── s/.REVIEW.md\n\n# Overview:\no\n\n# Review:\nr\n\n# Design:\n\n\n# Notes:\n- x\n- 1\n\n# Imperfections:\n- i\n"
    )
    assert got["q"] == (
        f"$lang: English\n---------- Reviewed by: ai @ {TS}\n\nq/.REVIEW.md\n\n# Overview:\nNone\n\n# Review:\nTrue\n\n# Design:\n\n"
    )


def test_report_uses_lists_of_the_reply(spark):
    listing = entries(spark, ("p", 0, "/p/a.py"), ("p", 1, "s/.REVIEW.md"), ("q", 0, "/q/a.py"), ("r", 1, "s/.REVIEW.md"))
    reply = replies(
        spark,
        p='{"overview":"","review":"","reviews":{"x/../z.py":"","/p/y.py":""},"sub_module_reviews":[]}',
        q='{"overview":"","review":"","reviews":{"../up.py":""}}',
        r='{"overview":"","review":"","reviews":{}}',
    )
    got = {r.folder: r for r in rv.render_project_reports(listing, reply, "ai", TS).collect()}
    assert "    ├── y.py\n    └── z.py\n\n# Overview" in got["p"].report
    assert got["q"].report is None and got["q"].err == "Some path is not in the prefix q"
    assert "    └──── s/.REVIEW.md\n" in got["r"].report


def test_large_report_comes_in_parts(spark):
    rows = [("p", 0, f"/p/f{i:03d}.py") for i in range(60)] + [("p", 1, f"m{i:02d}/.REVIEW.md") for i in range(20)]
    reply = replies(spark, p='{"overview":"o","review":"r"}', q='{"overview":"o","review":"r"}')
    parts = rv.render_project_reports(entries(spark, *rows), reply, "ai", TS, part_bytes=600)
    cut = parts.filter("folder = 'p'").orderBy("part").collect()
    assert len(cut) > 4 and parts.filter("folder = 'q'").count() == 1
    lines = "".join(r.report for r in cut).split("\n")
    whole = rv.render_project_reports(entries(spark, *rows), reply, "ai", TS).filter("folder = 'p'").first().report
    assert sorted(lines) == sorted(whole.split("\n"))
    assert lines[:4] == whole.split("\n")[:4] and lines[-10:] == whole.split("\n")[-10:]
    tree = [line for line in lines if "──" in line]
    assert tree[-1] == "    └──── m19/.REVIEW.md"
    assert ["REVIEW" in line for line in tree] == [False] * 60 + [True] * 20


def test_large_report_with_a_path_outside(spark):
    rows = [("p", 0, f"/p/f{i:03d}.py") for i in range(60)] + [("p", 0, "/other.py")]
    got = rv.render_project_reports(entries(spark, *rows), replies(spark, p='{"overview":"","review":""}'), "ai", TS, part_bytes=600).collect()
    assert [(r.report, r.err) for r in got] == [(None, "Some path is not in the prefix p")]


def test_pending(spark):
    mark = "#\\/ ---------- [Review]\n"
    files = spark.createDataFrame(
        [("a.py", mark + "x"), ("b.py", mark + "#\\/ ---------- [Issues]\nx"), ("c.py", "x"), ("d.txt", mark)],
        "path string, content string",
    )
    pending = lambda fix: {r.path: r.pending for r in rv.pending_reviews(files, fix).collect()}
    assert pending(False) == {"a.py": False, "b.py": False, "c.py": True}
    assert pending(True) == {"a.py": False, "b.py": True, "c.py": True}
    stored = spark.createDataFrame([("a.py", "---------- [Review]"), ("c.py", None)], "path string, review string")
    assert {r.path for r in rv.unreviewed(files, stored).collect()} == {"b.py", "c.py"}


def test_sections_and_headers(spark):
    text = f"---------- Reviewed by: ai @ {TS}\n$lang: French\n---------- [Review]\na\nb\n---------- [Issues]\n----------\n---------- [Requirements]\nk"
    df = spark.createDataFrame([("p.py", text), ("q.py", None)], "path string, review string")
    got = [(r.section, r.ord, r.text) for r in rv.parse_review_sections(df).collect()]
    assert got == [("Review", 0, "a"), ("Review", 1, "b"), ("Requirements", 0, "k")]
    head = rv.parse_review_headers(df).collect()
    assert [(r.path, r.ai, str(r.reviewed_at), r.lang) for r in head] == [("p.py", "ai", TS, "French")]


def test_audit(spark):
    from glosswork.languages import languages

    assert rv.audit_registry(languages(spark)).count() == 0
    claims = spark.createDataFrame([("a", ".x"), ("b", ".X"), ("a", ".y"), ("a", ".y")], "language string, extension string")
    assert {tuple(r) for r in rv.audit_registry(claims).collect()} == {("extension", ".x", 2), ("claim", "a .y", 2)}


def snapshot(spark, **files):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in files.items()], "path string, content string")


def test_changes(spark):
    old = snapshot(spark, a_py="x = 1", b_py="x = 1", c_py="y", d_py="z", e_txt="1")
    new = snapshot(spark, a_py="x = 1  # c", b_py="x = 2", c_py="y", f_py="new", e_txt="2")
    got = {r.path: (r.change, r.kind) for r in ch.snapshot_changes(old, new).collect()}
    assert got == {
        "a.py": ("modified", "comment_only"), "b.py": ("modified", "logic"), "f.py": ("added", None), "e.txt": ("modified", "unknown"),
    }


def test_line_changes(spark):
    old, new = snapshot(spark, a_py="x\nx\ny", b_py="s"), snapshot(spark, a_py="y\nx\nz\nz\n", b_py="s", c_py="n")
    got = {tuple(r) for r in ch.line_changes(old, new).collect()}
    assert got == {("a.py", "x", "removed", 1), ("a.py", "z", "added", 2), ("c.py", "n", "added", 1)}


def test_changed_paths_and_folders(spark):
    make = lambda *paths: spark.createDataFrame(list(enumerate(paths)), "pos long, path string")
    union = ch.union_changed_paths(make("b", "a"), make("a", "c"), make("d", "b"))
    assert [r.path for r in union.orderBy("source", "pos").collect()] == ["b", "a", "c", "d"]
    changed = spark.createDataFrame([("/a/x.py",), ("/a/bb/y.py",), ("/a/z.py",)], "path string")
    assert [r.folder for r in ch.affected_folders(changed).collect()] == ["/a/bb", "/a"]


def test_clones(spark):
    files = spark.createDataFrame([(f"h/{i}.c", "same // %d" % i) for i in range(50)] + [("o.c", "other"), ("t.txt", "same")], "path string, content string")
    prints = fg.structural_fingerprints(files)
    one = fg.clone_groups(prints).collect()
    assert len(one) == 1 and one[0].n == 50 and len(one[0].paths) == 50
    cut = fg.clone_groups(prints, part_bytes=200).collect()
    assert len(cut) > 1 and sorted(p for r in cut for p in r.paths) == one[0].paths and {r.n for r in cut} == {50}


def test_repeated_paths_of_a_folder(spark):
    rows = [("a/x.py", "old"), ("a/x.py", "zz new"), ("a/x.py", "zz new"), ("a/y.py", "r"), ("b/z.py", "r")]
    got = {r.folder: r.reviews for r in rv.project_reviews(spark.createDataFrame(rows, "path string, review string")).collect()}
    assert got == {"a": {"a/x.py": "zz new", "a/y.py": "r"}, "b": {"b/z.py": "r"}}


def whole(pieces, key):
    got = {}
    for r in pieces.collect():
        got.setdefault(r[key], []).append((r.piece, r.text))
    return {k: (len(v), "".join(t for _, t in sorted(v))) for k, v in got.items()}


def test_requests_of_any_size_in_pieces(spark):
    docs = spark.createDataFrame([("a", f"a/{i}\".md") for i in range(300)] + [("a", "a/1\".md"), ("c", "c/1.md")], "folder string, path string")
    files = spark.createDataFrame([("a/x.py", "x = 1"), ("a/y.py", "#\\/ [\n\ny"), ("b/z.py", "z"), ("c/w.py", "w"), ("n.txt", "n")], "path string, content string")
    expected = {r.path: r.user_prompt for r in rq.render_prompts(rq.build_review_requests(files, docs, "ctx"), "t", "French").collect() if r.user_prompt}
    asked = rq.build_review_requests(files, docs, "ctx", part_bytes=200)
    cut = {r.path: r for r in rq.render_prompts(asked, "t", "French").collect()}
    assert cut["a/x.py"].user_prompt is None and cut["a/x.py"].err is None and cut["a/x.py"].request.input == "x = 1"
    assert cut["b/z.py"].user_prompt == expected["b/z.py"]
    for size in (1, 200, 10**9):
        got = whole(rq.request_pieces(asked, docs, "French", size), "path")
        assert {k: t for k, (_, t) in got.items()} == expected
        assert size != 200 or got["a/x.py"][0] > 20
    seconds = {r.path: r.seconds for r in rq.piece_budgets(rq.request_pieces(asked, docs, "French", 200), "path", F.lit("t")).collect()}
    budget = {r.path: r.seconds for r in rq.estimate_run_budget(rq.render_prompts(rq.build_review_requests(files, docs, "ctx"), "t", "French")).collect() if r.seconds}
    assert seconds == budget


def test_gathered_pieces_are_joined_without_an_exchange(spark):
    from catalog.queries import _joined_pieces, _joined_requests

    docs = spark.createDataFrame([("a", f"a/{i}\".md") for i in range(300)] + [("c", "c/1.md"), (None, None)], "folder string, path string")
    rows = [("a/x.py", "x = 1"), ("a/y.py", "#\\/ [\n\ny"), ("a/y.py", "other"), ("b/z.py", "z"), ("c/w.py", "w"), ("c/v.py", "v"), ("c/v.py", "v"), (None, "n")]
    asked = rq.build_review_requests(spark.createDataFrame(rows, "path string, content string"), docs, "ctx", part_bytes=200)
    plain = rq.request_pieces(asked, docs, "French", 200)
    expected = sorted((r.path, r.whole) for r in _joined_pieces(plain, "path").collect())
    assert [x for x, _ in expected] == ["a/x.py", "a/y.py", "b/z.py", "c/v.py", "c/w.py"]
    for part_bytes, inside in ((10**9, {"a/x.py", "b/z.py", "c/w.py"}), (200, {"b/z.py", "c/w.py"})):
        got = rq.request_pieces(asked, docs, "French", 200, gathered=True, part_bytes=part_bytes)
        assert {r.path for r in got.filter("whole").collect()} == inside
        sizes = [x.groupBy("path").agg(F.sum(F.length("text"))).collect() for x in (got.select("path", F.inline("pieces")), plain)]
        assert sorted(sizes[0]) == sorted(sizes[1])
        assert sorted((r.path, r.whole) for r in _joined_requests(got).collect()) == expected
    # Files and lists are dealt by folder; no exchange moves what a file gets of its list.
    moved = exchanged(rq.request_pieces(asked, docs, "French", 200, gathered=True))
    assert moved and not any("path" in columns and ("text" in columns or "_list" in columns or "pieces" in columns) for columns in moved)


def test_lists_are_rendered_once_per_folder(spark):
    docs = spark.createDataFrame([("a", f"a/{i}\".md") for i in range(300)] + [("a", "a/1\".md"), ("c", "c/1.md")], "folder string, path string")
    rows = [("a/x.py", "x = 1"), ("a/x.py", "x = 1"), ("a/y.py", "#\\/ [\n\ny"), ("b/z.py", "z"), ("c/w.py", "w"), ("n.txt", "n"), (None, "n"), ("a/v.py", None)]
    files = spark.createDataFrame(rows, "path string, content string")
    for size in (10**9, 200):
        plain = rq.render_prompts(rq.build_review_requests(files, docs, "ctx", size), "`programming_language`", "French")
        light = rq.render_prompts(rq.build_review_requests(files, docs, "ctx", size, rendered=True), "`programming_language`", "French")
        columns = plain.columns
        assert sorted(map(repr, light.select(columns).collect())) == sorted(map(repr, plain.collect()))
        assert light.filter("NOT length(user_prompt) <=> user_chars").isEmpty()
        for timeout in (0, 45, -10):
            expected, got = (sorted(map(repr, rq.estimate_run_budget(x, timeout).select(*columns, "seconds").collect())) for x in (plain, light))
            assert got == expected
            expected, got = (sorted(map(repr, rq.folder_budgets(x, timeout).collect())) for x in (plain, light))
            assert got == expected


def test_derived_columns_of_lists(spark):
    docs = spark.createDataFrame([("a", f"a/{i}.md") for i in range(30)], "folder string, path string")
    files = spark.createDataFrame([("a/x.py",), ("c/z.py",), (None,)], "path string")
    for size in (10**9, 200):
        got = rq.attach_references(files, docs, size, told=lambda x: F.array_join(x, "|"), n=F.size)
        assert got.columns == ["path", "references", "told", "n", "reference_parts"]
        assert got.filter("NOT (told <=> array_join(references, '|') AND n <=> CASE WHEN references IS NOT NULL THEN size(references) END)").isEmpty()


def test_folder_requests_of_any_size_in_pieces(spark):
    folders = spark.createDataFrame([("p",), ("p/q",), ("p/r",), ("e",)], "folder string")
    given = spark.createDataFrame([(f"p/{i}.py", f"r\n{i}\"") for i in range(200)] + [("p/1.py", "older"), ("p/q/c.py", ""), ("p/n.py", None)], "path string, review string")
    stored = spark.createDataFrame([("p", "$lang: Deutsch x\nold"), ("p/q", "old"), ("p/r", "old")], "folder string, report string")
    for refs in (None, spark.createDataFrame([("p", f"p/N{i}.md") for i in range(50)], "folder string, path string")):
        args = (folders, given, stored, refs)
        expected = {r.folder: r.user_prompt for r in rq.render_prompts(pj.build_project_requests(*args, "c"), "t").collect()}
        asked = pj.build_project_requests(*args, "c", part_bytes=300)
        flags = {r.folder: r.pieces for r in asked.collect()}
        assert flags["p"] and not flags["p/q"] and len(expected) == 4
        for size in (1, 300, 10**9):
            assert {k: t for k, (_, t) in whole(pj.project_request_pieces(asked, *args, piece_bytes=size), "folder").items()} == expected


def test_folder_reports_of_requests_in_pieces_read_texts_once(spark, tmp_path):
    from catalog import queries as q

    texts = [(i, "a\nb\nc\nd\ne", "en", "s", 9) for i in range(90)] + [(7, "a\nb", "en", "s", 3), (8, None, None, None, None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    whole = q.review_folders(spark, str(tmp_path))
    expected = sorted(map(repr, whole.collect()))
    assert len(expected) == 20 and "f7" in "".join(expected)
    # Lists that come in pieces are listed too.
    assert sorted(map(repr, q._reviewed_folders(spark, str(tmp_path), 300).select("folder", "report", "err").collect())) == expected
    # Reviews and requests are written, so the last plan cuts no text into lines again.
    assert "documents.parquet" not in "".join(whole.inputFiles())


def test_snapshots_meet_in_one_shuffle_without_texts(spark, tmp_path):
    for side in ("old", "new"):
        snapshot(spark, a_py="x", b_py=side).write.parquet(str(tmp_path / side))
    old, new = (spark.read.parquet(str(tmp_path / side)) for side in ("old", "new"))
    plan = ch.snapshot_changes(old, new)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "content" not in plan.split("Exchange hashpartitioning")[0]


def exchanged(df):
    """The input columns of every exchange of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)


def test_line_changes_exchange_no_texts(spark, tmp_path):
    rows = {"old": {"a.py": "x\ny", "b.py": "same", "c.py": "gone\nsame"}, "new": {"a.py": "x\nz\nz", "b.py": "same", "d.py": "n"}}
    for side, files in rows.items():
        spark.createDataFrame(list(files.items()), "path string, content string").write.parquet(str(tmp_path / side))
    old, new = (spark.read.parquet(str(tmp_path / side)) for side in ("old", "new"))
    changes = ch.line_changes(old, new)
    moved = exchanged(changes)
    assert moved and not any("content" in columns for columns in moved)
    got = sorted(tuple(r) for r in changes.collect())
    assert got == [("a.py", "y", "removed", 1), ("a.py", "z", "added", 2), ("d.py", "n", "added", 1)]


def test_likely_members_lose_no_key(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(3000)] + [(None, -1)], "key string, n int")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)] + [("other",)], "key string")
    got = {r.key for r in likely_members(rows, keys, "key").collect()}
    assert {f"k{i}" for i in range(0, 3000, 7)} <= got and len(got) < 450


def test_project_requests(spark):
    folders = spark.createDataFrame([("p",), ("p/q",), ("p/.h",), ("p",)], "folder string")
    given = spark.createDataFrame([("p/a.py", "ra"), ("p/b.py", None), ("p/q/c.py", "rc")], "path string, review string")
    stored = spark.createDataFrame([("p", "$lang: Deutsch x\nold"), ("p/q", "old"), ("p/.h", "old")], "folder string, report string")
    refs = spark.createDataFrame([("p", "p/N.md")], "folder string, path string")
    got = {r.folder: r for r in pj.build_project_requests(folders, given, stored, refs, "ctx").collect()}
    assert got["p"].request.asDict() == {
        "path": "p", "references": ["p/N.md"], "comment_language": "Deutsch", "prior_review": "", "context": "ctx",
        "reviews": {"p/a.py": "ra"}, "sub_module_reviews": ["p/q/.REVIEW.md"],
    }
    assert got["p/q"].request.reviews == {"p/q/c.py": "rc"} and got["p/q"].request.references == []
    assert got["p/.h"].request.reviews == {} and got["p/.h"].request.comment_language == "English" and len(got) == 3
    many = spark.createDataFrame([(f"p/{i}.py", "r" * 50) for i in range(30)], "path string, review string")
    cut = {r.folder: r for r in pj.build_project_requests(folders, many, stored, part_bytes=500).collect()}
    assert cut["p"].pieces and cut["p"].request.reviews is None and not cut["p/q"].pieces
