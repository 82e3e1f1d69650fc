"""Work and memory that must not grow with rows per task, files per folder or steps per plan."""

import datetime as dt
import json

from pyspark.sql import functions as F

from catalog import queries as q
from glosswork.operators import fixing as fx
from glosswork.operators import requests as rq
from glosswork.session import BATCH_LIMITS, ship
from glosswork.sources import files as so
from glosswork.streaming import streams as st


def test_python_batches_stay_small(spark):
    before = {key: spark.conf.get(key) for key in BATCH_LIMITS}
    try:
        for key in BATCH_LIMITS:
            spark.conf.set(key, "100000000")
        ship(spark)
        assert all(int(spark.conf.get(key)) == limit for key, limit in BATCH_LIMITS.items())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        ship(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}.py").write_text("x = 1")
        (tmp_path / f"f{i}.md").write_text("text")
    keys = {"spark.sql.files.openCostInBytes": str(4 << 20), "spark.sql.files.maxPartitionBytes": str(16 << 20)}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        found, docs = so.scan_source_files(spark, str(tmp_path)), so.scan_reference_docs(spark, str(tmp_path))
        assert found.count() == docs.count() == 300
        # With Spark's cost of 4 MB a file, four files make a task.
        assert found.rdd.getNumPartitions() < 40 and docs.rdd.getNumPartitions() < 40
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_passes_of_kept_steps(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "x = 1")], "path string, content string")
    reply = json.dumps({"result": json.dumps({"overview": "o", "review": "r", "output": "x = 1"})})
    runs = spark.createDataFrame(
        [("a.py", 0, "review", "claude", 0, reply), ("a.py", 1, "fix", "claude", 0, reply), ("a.py", 1, "review", "claude", 0, reply)],
        "path string, pass_no int, step string, provider string, returncode int, stdout string",
    )
    kept = []

    def keep(rows, name):
        kept.append(name)
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    asked = rq.build_review_requests(files)
    plain, light = fx.passes_from_runs(asked, runs, "me", "now"), fx.passes_from_runs(asked, runs, "me", "now", keep=keep)
    assert kept == ["played-fixes", "played-reviews"]
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(light) * 5 < size(plain)
    assert sorted(map(repr, light.collect())) == sorted(map(repr, plain.collect()))


def test_replies_of_both_kinds_are_read_in_one_plan(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", "x = 1")], "path string, content string")
    told = lambda **x: json.dumps({"result": json.dumps({"overview": "o", "review": "r"} | x)})
    runs = spark.createDataFrame(
        [("a.py", 0, "review", "claude", 0, told(output="x = 1")), ("a.py", 1, "fix", "claude", 0, told()),
         ("a.py", 2, "fix", "claude", 0, told(output="x = 1")), ("a.py", 2, "review", "claude", 0, told()), ("a.py", 2, "other", "claude", 0, told())],
        "path string, pass_no int, step string, provider string, returncode int, stdout string",
    )
    reads = []
    monkeypatch.setattr(fx.ru, "read_replies", lambda *x, f=fx.ru.read_replies, **more: reads.append(x) or f(*x, **more))
    passes = fx.passes_from_runs(rq.build_review_requests(files), runs, "me", "now")
    assert len(reads) == 1
    # A fix without code is a reply; a review without code is none.
    got = {r.pass_no: (r.fix_ok, r.output_present, r.reviewed, r.review is not None) for r in passes.collect()}
    assert got == {0: (None, None, True, True), 1: (True, False, False, False), 2: (True, True, True, False)}


def test_replies_share_one_table_of_requests(spark, tmp_path, monkeypatch):
    spark.sql("SELECT 1L AS doc_id, 'a' AS text UNION ALL SELECT 12L, 'b'").write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(q, "requests", lambda s, d, f=q.requests: made.append(d) or f(s, d))
    assert q.write_attempt_failures(spark, str(tmp_path)).count() >= 1
    assert len(made) == 1


def test_open_sessions_come_out(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    line = json.dumps({"msg": {"type": "agent_message", "message": "%s"}})
    rows = [("u", i, at + dt.timedelta(hours=h), line % f"m{i}") for i, h in enumerate((0, 1, 40, 41))] + [("v", 9, at + dt.timedelta(hours=41), line % "v")]
    schema = "request_id string, seq long, ts timestamp, line string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    sessions = st.stream_first_agent_message(arriving, gap="12 hours", delay=None)
    st.write_versions(sessions, f"{tmp_path}/table", f"{tmp_path}/state", "complete").awaitTermination()
    got = st.last_batch(spark, "request_id string, started timestamp, text string", f"{tmp_path}/table")
    told = {(r.request_id, r.hours, r.text) for r in got.select("request_id", F.hour("started").alias("hours"), "text").collect()}
    assert {(i, t) for i, _, t in told} == {("u", "m0"), ("u", "m2"), ("v", "v")} and got.count() == 3


def long_list(spark, n=40):
    """A folder whose list of references has over 32 MiB, and a file of it."""
    docs = spark.range(n).selectExpr("'a' AS folder", "concat('a/', id, repeat('x', 1000000), '.md') AS path")
    return spark.createDataFrame([("a/x.py", "x = 1")], "path string, content string"), docs, n * 1_000_005 + sum(len(str(i)) for i in range(n))


def test_attached_lists_are_whole_at_any_size(spark):
    files, docs, chars = long_list(spark)
    got = rq.attach_references(files, docs, told=lambda x: F.array_join(x, "")).select(
        F.size("references").alias("n"), F.length("told").alias("chars"), "reference_parts"
    ).collect()
    assert [tuple(r) for r in got] == [(40, chars, 1)]


def test_run_budgets_count_lists_of_any_size(spark):
    files, docs, chars = long_list(spark)
    few = docs.limit(0)
    budget = lambda refs: rq.estimate_run_budget(rq.render_prompts(rq.build_review_requests(files, refs, "ctx", rendered=True), "t"))
    light = rq.render_prompts(rq.build_review_requests(files, few, "ctx", rendered=True), "t").first()
    # "[]" becomes a line and a comma for each item, and a closing line.
    expected = len(light.system_prompt) + len(light.user_prompt) - 2 + chars + 40 * 6 + 39 * 2 + 5
    assert budget(docs).select("seconds").first().seconds == 60 * (expected >> 10) + 300


def test_folder_budgets_count_lists_of_any_size(spark):
    files, docs, _ = long_list(spark)
    prompts = rq.render_prompts(rq.build_review_requests(files, docs, "ctx", rendered=True), "t")
    [row] = rq.folder_budgets(prompts).collect()
    assert row.folder == "a" and row.runs == 1 and row.total_seconds == row.longest_seconds > 60 * 39000


def test_repeated_lists_are_written_once(spark, tmp_path):
    docs = spark.range(60).selectExpr("'a' AS folder", "concat('a/', id, repeat(sha2(string(id), 256), 1000), '.md') AS path")
    files = spark.range(200).selectExpr("concat('a/', id, '.py') AS path")
    got = rq.attach_references(files, docs, told=lambda x: F.array_join(x, "")).select("path", "told")
    got.coalesce(1).write.parquet(f"{tmp_path}/out")
    # Of 200 copies of a text of 3.8 MB one is stored, which does not compress below 0.9 MB.
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 8_000_000
    back = spark.read.parquet(f"{tmp_path}/out")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "64")
    try:
        assert back.agg(F.count("told"), F.countDistinct("told"), F.min(F.length("told"))).collect()[0][:2] == (200, 1)
    finally:
        spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")
