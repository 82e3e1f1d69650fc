"""The fix loop from recorded runs: one golden for each branch."""

import json

import pytest

from glosswork.functions import comments as c
from glosswork.operators import fixing as fx
from glosswork.operators import requests as rq

OPEN_REVIEW = "#\\/ ---------- [Review]\n#\\/ bad\n#\\/ ---------- [Issues]\n#\\/ left\n"
BUDGET = 2


def fix(output="x = 2", **more):
    return "fix", json.dumps({"overview": "did", "review": "why", **({} if output is None else {"output": output}), **more})


def review(output="x = 2", issues=("left",), impediments=(), **more):
    return "review", json.dumps({"overview": "o", "review": "r", "issues": list(issues), "impediments": list(impediments), "output": output, **more})


FAILED = "not json"
CASES = {
    # name: stored text, runs by pass, outcome, passes used, step that comes next
    "no text": ("\n", {}, "EMPTY", 0, None),
    "comment only": ("# only\n", {}, "OPEN", None, ("review", 0)),
    "no code": (OPEN_REVIEW, {}, "EMPTY", 0, None),
    "never reviewed": ("x = 1", {}, "OPEN", None, ("review", 0)),
    "first review clean": ("x = 1", {0: [review("x = 1", issues=())]}, "RESOLVED", 0, None),
    "first review failed": ("x = 1", {0: [("review", FAILED)]}, "FAILED", 0, None),
    "first review open": ("x = 1", {0: [review("x = 1")]}, "OPEN", 0, ("fix", 1)),
    "stored clean": ("#\\/ ---------- [Review]\n#\\/ ok\nx = 1", {}, "RESOLVED", 0, None),
    "stored blocked": (OPEN_REVIEW + "#\\/ ---------- [Impediments]\nx = 1", {}, "BLOCKED", 0, None),
    "stored open": (OPEN_REVIEW + "x = 1", {}, "OPEN", 0, ("fix", 1)),
    "fix failed": (OPEN_REVIEW + "x = 1", {1: [("fix", FAILED)]}, "OPEN", 1, ("fix", 2)),
    "fix failed to the end": (OPEN_REVIEW + "x = 1", {1: [("fix", FAILED)], 2: [("fix", FAILED)]}, "FAILED", 2, None),
    "fix reports an error": (OPEN_REVIEW + "x = 1", {1: [fix(error="no")]}, "OPEN", 1, ("fix", 2)),
    "no code to the end": (OPEN_REVIEW + "x = 1", {1: [fix(None)], 2: [fix(None)]}, "FAILED", 2, None),
    "fix waits": (OPEN_REVIEW + "x = 1", {1: [fix()]}, "OPEN", 0, ("review", 1)),
    "review failed": (OPEN_REVIEW + "x = 1", {1: [fix(), ("review", FAILED)]}, "FAILED", 1, None),
    "resolved": (OPEN_REVIEW + "x = 1", {1: [fix(), review(issues=())]}, "RESOLVED", 1, None),
    "blocked": (OPEN_REVIEW + "x = 1", {1: [fix(), review(impediments=("stuck",))]}, "BLOCKED", 1, None),
    "open again": (OPEN_REVIEW + "x = 1", {1: [fix(), review()]}, "OPEN", 1, ("fix", 2)),
    "exhausted": (OPEN_REVIEW + "x = 1", {1: [fix(), review()], 2: [fix("x = 3"), review("x = 3")]}, "EXHAUSTED", 2, None),
    "second try": (OPEN_REVIEW + "x = 1", {1: [("fix", FAILED)], 2: [fix("x = 3"), review("x = 3", issues=())]}, "RESOLVED", 2, None),
    "changed code": (OPEN_REVIEW + "x = 1", {1: [fix(), review("x = 9", issues=())]}, "RESOLVED", 1, None),
}


@pytest.fixture(scope="module")
def loops(spark, tmp_path_factory):
    names = list(CASES)
    paths = {n: f"d/{i}.py" for i, n in enumerate(names)}
    files = spark.createDataFrame([(paths[n], CASES[n][0]) for n in names], "path string, content string")
    runs = spark.createDataFrame(
        [(paths[n], k, step, "claude", 2 if text == FAILED else 0, json.dumps({"result": text})) for n in names for k, steps in CASES[n][1].items() for step, text in steps],
        "path string, pass_no int, step string, provider string, returncode int, stdout string",
    )
    table = str(tmp_path_factory.mktemp("fixing") / "passes")
    fx.passes_from_runs(rq.build_review_requests(files), runs, "me", "now").write.parquet(table)
    passes = spark.read.parquet(table)
    of = {p: n for n, p in paths.items()}
    done = {of[r.path]: r for r in fx.apply_fixes(passes, BUDGET).collect()}
    steps = {of[r.path]: r for r in fx.plan_fixes(files, passes, BUDGET, context="start").collect()}
    return done, steps, {(of[r.path], r.pass_no): r for r in passes.collect()}, files


@pytest.mark.parametrize("name", CASES)
def test_branch(loops, name):
    done, steps, _, _ = loops
    _, _, outcome, used, step = CASES[name]
    row = done.get(name)
    assert (row.outcome, row.passes_used) == (outcome, used) if row else (outcome, used) == ("OPEN", None)
    got = steps.get(name)
    assert (got and (got.step, got.pass_no)) == step


def test_texts_that_are_left(loops):
    done, _, passes, _ = loops
    for name in ("stored clean", "stored open", "fix failed to the end", "review failed", "first review failed"):
        assert done[name].content is None
    assert done["resolved"].content.endswith("\nx = 2") and "[Issues]" not in done["resolved"].review
    assert done["second try"].content.endswith("\nx = 3") and done["exhausted"].content.endswith("\nx = 3")
    assert "[Issues]" in done["exhausted"].review and done["review failed"].review is None
    # The reviewer changed the fixed code: its notes stay, the fixed code does too.
    assert done["changed code"].content.endswith("\nx = 2") and done["changed code"].content.startswith("#\\/ ---------- Reviewed by: me @ now")
    assert done["stored blocked"].review.startswith(c.REVIEW_MARK) and done["no code"].review == ""
    assert done["open again"].review is None and done["open again"].content.endswith("\nx = 2")


def test_next_requests(loops):
    _, steps, _, _ = loops
    assert steps["fix waits"].request.input == "x = 2" and steps["fix waits"].request.context == "start\n[Bug fix]\ndid\n[Discussion]\nwhy\n"
    again = steps["open again"].request
    assert again.input == "x = 2" and again.prior_review.startswith("---------- Reviewed by: me @ now") and again.context == "start\n[Bug fix]\ndid\n[Discussion]\nwhy\n"
    assert steps["fix failed"].request.input == "x = 1" and steps["fix failed"].request.context == "start"
    assert steps["never reviewed"].request.prior_review == ""


def test_first_requests_and_prompts(spark, loops):
    files = loops[3]
    steps = fx.plan_fixes(files, None, BUDGET, templates={"review": "R `programming_language`", "fix": "F `comment_language`"}).collect()
    prompts = {r.path: (r.step, r.pass_no, r.system_prompt) for r in steps}
    at = {n: f"d/{i}.py" for i, n in enumerate(CASES)}
    assert prompts[at["never reviewed"]] == ("review", 0, "R python") and prompts[at["stored open"]] == ("fix", 1, "F English")
    assert at["stored clean"] not in prompts and at["no code"] not in prompts
