"""Files, logs, sinks, prompts and streams."""

import json

import pytest
from pyspark.sql import functions as F

from glosswork.operators import comments as co
from glosswork.operators import requests as rq
from glosswork.operators import runs as ru
from glosswork.sources import files as so
from glosswork.streaming import streams as st


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"x\r\ny\rz\n")
    (tmp_path / "b.JS").write_text("é", encoding="utf-8")
    (tmp_path / "bad.c").write_bytes(b"\xff\xfe")
    for name in ("c.txt", "Makefile", "n.md", "N.REVIEW.md", "sub/d.go", "sub/e.md"):
        (tmp_path / name).write_text("t")
    return str(tmp_path)


def test_scan_sources(spark, folder):
    got = {r.path[len(folder) + 1:]: r for r in so.scan_source_files(spark, folder).collect()}
    assert set(got) == {"a.py", "b.JS", "bad.c"}
    assert got["a.py"].content == "x\ny\nz\n" and got["b.JS"].content == "é"
    assert got["bad.c"].content is None and "not UTF-8" in got["bad.c"].err
    deep = so.scan_source_files(spark, folder, recursive=True)
    assert {r.path[len(folder) + 1:] for r in deep.collect()} == {"a.py", "b.JS", "bad.c", "sub/d.go"}


def test_scan_docs(spark, folder):
    rows = so.scan_reference_docs(spark, folder).collect()
    assert [(r.folder, r.path) for r in rows] == [(folder, f"{folder}/n.md")]
    plan = so.scan_reference_docs(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_events(spark, tmp_path):
    lines = ['{"a":1}', "", "  ", "[1]", "no", '{"a":1} x', ' {"b":2}']
    log = [json.dumps({"request_id": "r", "seq": i, "ts": "2025-01-01T00:00:00Z", "line": x}) for i, x in enumerate(lines)]
    (tmp_path / "log.json").write_text("\n".join([*log, "broken"]))
    got = so.scan_run_events(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.line for r in got] == ['{"a":1}', ' {"b":2}']


def test_run_outputs(spark, tmp_path):
    (tmp_path / "r1.out").write_text("a\nb\n")
    assert [tuple(r) for r in so.scan_run_outputs(spark, str(tmp_path)).collect()] == [("r1", "a\nb\n")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.py", "x")], "path string, content string")
    path = str(tmp_path / "out")
    so.write_annotated_sources(df, path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a.py", "x")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        so.write_annotated_sources(df, path)
    failed = spark.createDataFrame([("r", 1, "x")], "request_id string, attempt int, err_class string")
    for _ in range(2):
        so.write_attempt_failures(failed, str(tmp_path / "failures"))
    assert spark.read.parquet(str(tmp_path / "failures")).count() == 1


def test_prompts(spark):
    files = spark.createDataFrame([("p/a.py", "#\\/ $lang: French\n#\\/ old\n#\\% keep\n\nx = \"é\\n\"\n\n")], "path string, content string")
    docs = spark.createDataFrame([("p", "p/n.md")], "folder string, path string")
    requests = rq.build_review_requests(files, docs, "ctx")
    row = rq.render_prompts(requests, "`programming_language` in `comment_language`").first()
    assert row.system_prompt == "python in French"
    expected = {
        "path": "p", "references": ["p/n.md"], "comment_language": "French", "prior_review": "$lang: French\nold",
        "requirements": "keep", "context": "ctx", "input": 'x = "é\\n"',
    }
    assert row.user_prompt == json.dumps(expected, indent=2, ensure_ascii=False)
    row = rq.render_prompts(requests, "`comment_language`", lang=" German ").first()
    assert row.system_prompt == "German" and json.loads(row.user_prompt)["comment_language"] == "German"


def test_project_prompt_with_map(spark):
    df = spark.sql(
        "SELECT named_struct('path', 'p', 'references', array(), 'comment_language', 'English', 'prior_review', '', "
        "'context', '', 'reviews', map('b', 'x', 'a', 'y\"'), 'sub_module_reviews', array('s')) AS request"
    )
    got = rq.render_prompts(df, "t").first().user_prompt
    expected = {
        "path": "p", "references": [], "comment_language": "English", "prior_review": "", "context": "",
        "reviews": {"a": 'y"', "b": "x"}, "sub_module_reviews": ["s"],
    }
    assert got == json.dumps(expected, indent=2, ensure_ascii=False)


def test_context(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    diffs = spark.createDataFrame([("a", "+x\n")], "path string, diff string")
    get = lambda context: {r.path: r.context for r in rq.build_context(files, diffs, context).collect()}
    dump = lambda x: json.dumps(x, indent=2)
    assert get("") == {"a": dump({"git-diff": "+x\n"}), "b": "{}"}
    assert get("c") == {"a": dump({"git-diff": "+x\n", "context": "c"}), "b": dump({"context": "c"})}


def test_stream_reviews_equal_batch(spark, tmp_path):
    rows = [(f"{i}.py", f"#\\/ ---------- [Review]\n#\\/ r{i}\nx" if i % 2 else "x") for i in range(20)]
    files = spark.createDataFrame(rows, "path string, content string")
    files.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        st.stream_extract_reviews(arriving).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.path, r.review) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = co.extract_reviews(files).filter(F.col("review").isNotNull())
    assert got == {(r.path, r.review) for r in batch.collect()} and len(got) == 10


def test_stream_messages_equal_batch(spark, tmp_path):
    line = '{"msg":{"type":"agent_message","message":"m%d"}}'
    rows = [(f"r{i % 5}", 100 - i, f"2025-01-01 00:{i % 60:02d}:00", line % i if i % 3 else "noise") for i in range(100)]
    events = spark.createDataFrame(rows, "request_id string, seq long, ts string, line string").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        st.stream_first_agent_message(arriving).writeStream.format("memory").queryName("first_messages")
        .outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("first_messages").collect()}
    assert got == {tuple(r) for r in ru.first_agent_message(events).collect()} and len(got) == 5


@pytest.mark.parametrize("n", [1, 8])
def test_results_do_not_depend_on_partitions(spark, n):
    line = '{"msg":{"type":"agent_message","message":"m%d"}}'
    rows = [("hot" if i % 3 else f"r{i}", i, line % i) for i in range(300)]
    events = spark.createDataFrame(rows, "request_id string, seq long, line string").repartition(n)
    got = {r.request_id: r.text for r in ru.first_agent_message(events).collect()}
    assert got["hot"] == "m1" and len(got) == 101


def test_rooted_scans(spark, tmp_path):
    (tmp_path / "w" / "a").mkdir(parents=True)
    (tmp_path / "w" / "a" / "x.py").write_text("x")
    (tmp_path / "w" / "a" / "N.md").write_text("n")
    (tmp_path / "out.py").write_text("y")
    root = str(tmp_path / "w")
    got = {r.path: (r.content, r.err) for r in so.scan_source_files(spark, str(tmp_path), recursive=True, root=root).collect()}
    outside = str(tmp_path / "out.py")
    assert got == {"a/x.py": ("x", None), outside: (None, f"'{outside}' is not in the subpath of '{root}'")}
    docs = so.scan_reference_docs(spark, str(tmp_path), recursive=True, root=root).collect()
    assert [tuple(r) for r in docs] == [("a", "a/N.md", None)]
    other = so.scan_reference_docs(spark, root, recursive=True, root=str(tmp_path / "v")).first()
    assert other.path == f"{root}/a/N.md" and other.err.endswith(f"is not in the subpath of '{tmp_path}/v'")


def test_failures_are_written_once(spark, tmp_path):
    schema = "request_id string, attempt int, err string, err_class string"
    rows = [("a", 1, "e1", "c"), ("a", 2, "e2", "d"), ("b", 1, "e3", "c")]
    path = str(tmp_path / "failures")
    for upto in (2, 2, 3, 3, 1):
        so.write_attempt_failures(spark.createDataFrame(rows[:upto], schema), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("request_id", "attempt", "err", "err_class").collect()) == rows
    so.write_attempt_failures(spark.createDataFrame([], schema), path)
    assert spark.read.parquet(path).count() == 3


def test_stream_with_state_for_open_runs_only(spark, tmp_path):
    told = '{"msg":{"type":"agent_message","message":"m%d"}}'
    ended = '{"type":"turn.completed"}'
    first = [("a", 3, told % 3), ("b", 1, told % 1), ("c", 5, told % 5)]
    second = [("a", 2, told % 2), ("a", 9, ended), ("b", 2, told % 2), ("c", 6, ended), ("d", 1, '{"type":"start"}'), ("e", 1, ended)]
    third = [("b", 0, told % 0), ("c", 7, told % 7), ("d", 4, told % 4)]
    schema = "request_id string, seq long, line string, ts timestamp"
    source = str(tmp_path / "in")
    for i, rows in enumerate((first, second, third)):
        events = spark.createDataFrame([(*r, None) for r in rows], schema).withColumn("ts", F.expr(f"TIMESTAMP'2025-01-01 00:0{i}:00'"))
        events.coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).parquet(source)
        out = st.stream_messages_until_end(arriving, ("turn.completed",), idle_ms=3_600_000)
        st.write_versions(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = st.last_versions(spark, "request_id string, seq long, text string", str(tmp_path / "out"), "request_id", "-seq")
        found = {r.request_id: r.text for r in got.collect()}
        every = spark.read.parquet(source)
        assert found == {r.request_id: r.text for r in ru.first_agent_message(every).collect()}
    assert found == {"a": "m2", "b": "m0", "c": "m5", "d": "m4"}
    left = spark.read.format("statestore").load(str(tmp_path / "state")).select("key.request_id").collect()
    assert {r.request_id for r in left} == {"b", "c", "d"}  # c spoke again after its end
