"""The fix loop as a flow over recorded runs: next requests, played passes, final texts.

``runs(path, pass_no, step, provider, returncode, stdout, ...)`` are recorded runs of two kinds: a ``fix`` of
pass 1 and on changes code, the ``review`` of the same pass checks it; the review of pass 0 is the first one
of a file that has none. All steps are keyed by path and pass; a pass is played by one row, so no
path's history gathers anywhere but in arrays of at most ``budget`` short texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import comments as c
from glosswork.functions.render import fix_summary
from glosswork.operators import attempts as at
from glosswork.operators import comments as co
from glosswork.operators import fingerprint as fg
from glosswork.operators import requests as rq
from glosswork.operators import runs as ru

# Steps of the loop.
REVIEW, FIX = "review", "fix"


def _keyed(rows: DataFrame) -> Column:
    return F.concat_ws("#", F.col("path"), F.col("pass_no").cast("string"))


def played_replies(runs: DataFrame) -> DataFrame:
    """Checked replies of both kinds of run: ``path, pass_no, step, provider, data, err, severity``.

    One plan reads them all; only a review must give code.
    """
    read = ru.read_replies(runs.filter(F.col("step").isin(REVIEW, FIX)), check_output=F.col("step") == REVIEW)
    return read.drop("raw", "aside", "repaired", "used_fallback")


def played_fixes(replies: DataFrame) -> DataFrame:
    """Replies of fix runs as ``path, pass_no, fix_ok, output_present, fixed, fix_overview, fix_review``.

    A reply without an error counts; its code may still be missing.
    """
    good = F.col("err").isNull()
    return replies.filter(F.col("step") == FIX).select(
        "path",
        "pass_no",
        good.alias("fix_ok"),
        (good & F.col("data.output").isNotNull()).alias("output_present"),
        F.when(good, F.col("data.output")).alias("fixed"),
        F.when(good, F.coalesce("data.overview", F.lit(""))).alias("fix_overview"),
        F.when(good, F.coalesce("data.review", F.lit(""))).alias("fix_review"),
    )


def played_reviews(
    requests: DataFrame, fixes: DataFrame, replies: DataFrame, ai: Column | str, ts: Column | str, lang: str = ""
) -> DataFrame:
    """Replies of review runs as ``path, pass_no, review, content``: the header text and the new file text.

    The reply's code is held against the code sent: that of the file in pass 0, the fixed one later.
    Code that may have changed is replaced by the code sent, as each of these runs is the last attempt.
    ``review`` is NULL for failed runs and for fixes that gave no code.
    """
    asked = requests.filter(F.col("request").isNotNull())
    first = asked.select("path", F.lit(0).alias("pass_no"), "language", F.col("request.input").alias("code"))
    later = fixes.filter("output_present").join(asked.select("path", "language"), "path").select(
        "path", "pass_no", "language", F.col("fixed").alias("code")
    )
    sent = first.unionByName(later)
    sent = sent.select(_keyed(sent).alias("request_id"), "language", F.struct(F.col("code").alias("input")).alias("request"))
    given = replies.filter(F.col("step") == REVIEW).drop("step")
    checked = fg.verify_logic_preserved(sent, given.withColumn("request_id", _keyed(given)))
    restored = F.col("data").withField("output", F.col("input"))
    data = F.when(F.col("err").isNull(), F.col("data")).when(F.col("data").isNotNull(), restored)
    rows = checked.select("path", "pass_no", data.alias("data")).join(
        asked.select("path", "request", *co.MARKER_COLUMNS), "path"
    )
    return co.annotate(rows, ai, ts, lang).select("path", "pass_no", "review", "content")


def start_passes(requests: DataFrame) -> DataFrame:
    """Pass 0 of files that need no first review: ``path, pass_no, review``.

    The stored review where there is one; an empty text for files without code.
    """
    request = F.col("request")
    empty = request["input"] == ""
    stored = F.contains(request["prior_review"], F.lit(c.REVIEW_MARK))
    return requests.filter(request.isNotNull() & (empty | stored)).select(
        "path", F.lit(0).alias("pass_no"), F.when(empty, "").otherwise(request["prior_review"]).alias("review")
    )


def passes_from_runs(
    requests: DataFrame, runs: DataFrame, ai: Column | str, ts: Column | str, lang: str = "",
    keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows,
) -> DataFrame:
    """All recorded passes of all files, one row each, for ``resolve_fix_passes`` and ``accumulate_fix_context``.

    ``path, pass_no, fix_ok, output_present, fixed, fix_overview, fix_review, reviewed, review, content``.
    ``requests`` come from ``build_review_requests``. Runs of files that need no first review have no pass 0 of
    their own; ``reviewed`` tells a failed review from one that has not run. ``keep(rows, name)`` may write the fixes (with
    the replies of reviews, read in the same plan) and the reviews, which are read more than once, and give the written rows: one
    plan of all steps reads every reply five times over and takes a driver several times the memory.
    """
    replies = keep(played_replies(runs), "played-fixes")
    fixes = played_fixes(replies)
    reviews = keep(played_reviews(requests, fixes, replies, ai, ts, lang), "played-reviews").withColumn("reviewed", F.lit(True))
    started = start_passes(requests).withColumns({"reviewed": F.lit(True), "content": F.lit(None).cast("string")})
    first = reviews.filter("pass_no = 0").join(started.select("path"), "path", "left_anti")
    zero = first.unionByName(started.select(*first.columns))
    later = fixes.join(reviews.filter("pass_no > 0"), ["path", "pass_no"], "left")
    columns = ["path", "pass_no", "fix_ok", "output_present", "fixed", "fix_overview", "fix_review", "reviewed", "review", "content"]
    rows = later.select(*columns).unionByName(zero, allowMissingColumns=True)
    return rows.withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))


def _open_passes(passes: DataFrame) -> DataFrame:
    """Passes as far as they have ended: a fix that waits for its review is left out."""
    usable = F.coalesce(F.col("fix_ok") & F.col("output_present"), F.lit(False))
    return passes.filter(F.col("reviewed") | ((F.col("pass_no") > 0) & ~usable))


def apply_fixes(passes: DataFrame, budget: int) -> DataFrame:
    """Outcome of each loop and the text it leaves: ``path, outcome, passes_used, review, content``.

    ``review`` is that of the pass that ended the loop, NULL where the loop failed or is open. ``content`` is
    the file text of the last pass that wrote one, NULL where the file stays as it is. The
    passes are chosen by light columns; the texts follow by a join on path and pass.
    """
    outcomes = at.resolve_fix_passes(_open_passes(passes), budget)
    written = passes.filter(F.col("content").isNotNull()).select("path", "pass_no").join(
        outcomes.select("path", "passes_used"), "path"
    ).filter("pass_no <= passes_used").groupBy("path").agg(F.max("pass_no").alias("_written"))
    chosen = outcomes.join(written, "path", "left").select(
        F.col("path").alias("_path"), "outcome", "passes_used", "_written"
    )
    # The passes on the left: a path with very many recorded runs is then the splittable side.
    texts = passes.select("path", "pass_no", "review", "content").join(
        chosen, (F.col("path") == F.col("_path")) & F.col("pass_no").isin(F.col("passes_used"), F.col("_written"))
    )
    closed = ~F.col("outcome").isin("FAILED", "OPEN")
    ended = F.col("pass_no") == F.col("passes_used")
    found = texts.groupBy("path", "outcome", "passes_used").agg(
        F.max(F.when(closed & ended, F.col("review"))).alias("review"),
        F.max(F.when(F.col("pass_no") == F.col("_written"), F.col("content"))).alias("content"),
    )
    return found.select("path", "outcome", "passes_used", "review", "content")


def plan_fixes(
    files: DataFrame,
    passes: DataFrame | None,
    budget: int,
    docs: DataFrame | None = None,
    context: str = "",
    templates: dict[str, str] | None = None,
    lang: str = "",
) -> DataFrame:
    """The next run of each file whose loop is not over: ``path, pass_no, step, request`` and prompts.

    ``passes`` are those recorded so far (``passes_from_runs``). A file that was never reviewed gets
    its first review; one with issues a fix, whose context holds the summaries of earlier passes;
    a fix with code its review, which reads the fixed code. ``templates`` holds the prompt of each step.
    """
    known = co.filter_reviewable(files).select("path", "content")
    if passes is None:
        state = known.select(
            "path", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("text"),
            F.lit(None).cast("string").alias("seen"), F.lit(None).cast("string").alias("fixed"), F.lit(False).alias("waits"),
            F.lit("").alias("told"),
        )
    else:
        ended = at.resolve_fix_passes(_open_passes(passes), budget).select("path", "outcome")
        usable = F.coalesce(F.col("fix_ok") & F.col("output_present"), F.lit(False))
        waits = usable & ~F.col("reviewed")
        summary = F.concat(F.lit("\n"), fix_summary(F.col("fix_overview"), F.col("fix_review")))
        history = passes.filter(F.col("pass_no") <= budget).withColumn("_waits", waits).groupBy("path").agg(
            F.max("pass_no").alias("last"),
            F.max_by("content", F.when(F.col("content").isNotNull(), F.col("pass_no"))).alias("text"),
            F.max_by("review", F.when(F.col("review").isNotNull(), F.col("pass_no"))).alias("seen"),
            F.max_by("fixed", "pass_no").alias("fixed"),
            F.max_by("_waits", "pass_no").alias("waits"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.when(usable, F.struct("pass_no", summary.alias("s"))))), lambda x: x["s"]), ""
            ).alias("told"),
        )
        state = history.join(ended, "path", "left")
    rows = known.join(state.withColumnRenamed("path", "_path"), F.col("path") == F.col("_path"), "left").drop("_path")
    rows = rows.withColumns({
        "content": F.coalesce("text", "content"), "context": F.concat(F.lit(context), F.coalesce("told", F.lit(""))),
    }).filter(F.coalesce(F.col("outcome").isin("OPEN"), F.lit(True)))
    asked = rq.build_review_requests(rows.select("path", "content", "context"), docs)
    steps = asked.filter(F.col("request").isNotNull() & (F.col("request.input") != "")).join(
        rows.select(F.col("path").alias("_path"), "last", "seen", "fixed", "waits"), F.col("path") == F.col("_path")
    )
    # A review that the file's language cannot give back counts as it was recorded.
    review = F.coalesce("seen", "request.prior_review")
    status = F.when(~F.contains(review, F.lit(c.REVIEW_MARK)), "never_reviewed").otherwise(at.needs_fix(review))
    waits = F.coalesce(F.col("waits"), F.lit(False))
    step = F.when(waits | (status == "never_reviewed"), REVIEW).when((status == "to_fix") & (F.coalesce("last", F.lit(0)) < budget), FIX)
    pass_no = F.when(waits, F.col("last")).when(status == "never_reviewed", 0).otherwise(F.coalesce("last", F.lit(0)) + 1)
    request = F.when(waits, F.col("request").withField("input", F.col("fixed"))).otherwise(F.col("request"))
    found = steps.select("path", *co.MARKER_COLUMNS, pass_no.cast("int").alias("pass_no"), step.alias("step"), request.alias("request"))
    found = found.filter(F.col("step").isNotNull())
    if not templates:
        return found.drop(*co.MARKER_COLUMNS)
    parts = [rq.render_prompts(found.filter(F.col("step") == name), text, lang) for name, text in templates.items()]
    rendered = parts[0]
    for part in parts[1:]:
        rendered = rendered.unionByName(part)
    return rendered.drop(*co.MARKER_COLUMNS)
