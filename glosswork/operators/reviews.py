"""Stored reviews: pending files, folder roll-ups, reports, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import comments as c
from glosswork.functions import variants as v
from glosswork.functions.paths import file_name, parent_folder, relative_path, rooted_path
from glosswork.functions.render import LIST_SECTIONS, RULE, md_list, tree_lines
from glosswork.functions.text import py_splitlines
from glosswork.operators.comments import extract_reviews, filter_reviewable, with_language
from glosswork.operators.steps import compute_once
from glosswork.operators.grouping import PART_BYTES, collect_in_parts, place_in_parts

# Fixed value: name of a folder's report.
REPORT_NAME = ".REVIEW.md"


def is_reviewed(review: Column, fix: bool = False) -> Column:
    """Whether a stored review can be kept: it has a review section, and no issues when fixing."""
    done = F.contains(review, F.lit(c.REVIEW_MARK))
    if fix:
        done = done & ~F.contains(review, F.lit(c.ISSUES_MARK))
    return F.coalesce(done, F.lit(False))


def pending_reviews(files: DataFrame, fix: bool = False) -> DataFrame:
    """``path, review, pending``: stored reviews to keep, and files still to be reviewed.

    One narrow pass; filter on ``pending`` for either part.
    """
    reviews = extract_reviews(filter_reviewable(files)).select("path", "review")
    pending = ~is_reviewed(F.col("review"), fix)
    return reviews.select(
        "path", F.when(~pending, F.col("review")).alias("review"), pending.alias("pending")
    )


def unreviewed(files: DataFrame, stored: DataFrame, fix: bool = False) -> DataFrame:
    """Reviewable files without a usable review in the table ``stored(path, review)``."""
    done = stored.filter(is_reviewed(F.col("review"), fix)).select("path")
    return filter_reviewable(files).join(done, "path", "left_anti")


def submodule_reviews(
    folders: DataFrame, reports: DataFrame, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Reports of direct sub-folders: ``folder, part, parts, sub_module_reviews`` (sorted)."""
    return collect_in_parts(
        submodule_rows(folders, reports), ["folder"], ["report_path"], part_bytes=part_bytes
    ).select("folder", "part", "parts", F.col("items.report_path").alias("sub_module_reviews"))


def submodule_rows(folders: DataFrame, reports: DataFrame) -> DataFrame:
    """The same in long form: ``folder, report_path``. Dot-folders are skipped."""
    subs = folders.select("folder").distinct()
    visible = ~F.startswith(file_name(F.col("folder")), F.lit("."))
    return (
        subs.filter(visible & ~F.col("folder").isin("", "/"))
        .join(reports.select("folder"), "folder", "left_semi")
        .select(
            parent_folder(F.col("folder")).alias("folder"),
            F.concat(F.col("folder"), F.lit(f"/{REPORT_NAME}")).alias("report_path"),
        )
    )


def project_reviews(file_reviews: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """File reviews per folder, direct children only: ``folder, part, parts, reviews MAP``.

    A very large folder has several rows whose maps are disjoint. Of several reviews of one path
    the greatest text counts.
    """
    known = file_reviews.filter(F.col("review").isNotNull()).select(
        parent_folder(F.col("path")).alias("folder"), "path", "review"
    )
    groups = collect_in_parts(known, ["folder"], ["path"], ["review"], part_bytes)
    # Items are sorted by path and then review, and rows of one path share a part.
    last = F.filter(
        "items", lambda x, i: ~F.coalesce(F.get(F.col("items"), i + 1)["path"] == x["path"], F.lit(False))
    )
    return groups.select("folder", "part", "parts", F.map_from_entries(last).alias("reviews"))


def review_counts(file_reviews: DataFrame) -> DataFrame:
    """Reviews per folder: ``folder, n``; an empty review counts, a missing one does not."""
    return file_reviews.groupBy(parent_folder(F.col("path")).alias("folder")).agg(
        F.count("review").alias("n")
    )


def project_entries(file_reviews: DataFrame, submodules: DataFrame) -> DataFrame:
    """What a folder report lists: ``folder, kind, path``; kind 0 files, 1 sub-module reports.

    ``submodules`` come from ``submodule_rows``.
    """
    files = file_reviews.filter(F.col("review").isNotNull()).select(
        parent_folder(F.col("path")).alias("folder"),
        F.lit(0).alias("kind"),
        rooted_path(F.col("path")).alias("path"),
    )
    subs = submodules.select("folder", F.lit(1).alias("kind"), F.col("report_path").alias("path"))
    return files.unionByName(subs)


def _report_head(ai: Column | str, ts: Column | str) -> Column:
    ai, ts = (x if isinstance(x, Column) else F.lit(x) for x in (ai, ts))
    folder = F.col("folder")
    return F.concat(
        F.lit(f"{c.LANG_DIRECTIVE} "), F.col("comment_language"),
        F.lit(f"\n{RULE} Reviewed by: "), ai, F.lit(" @ "), ts, F.lit("\n\n"),
        F.when(folder == ".", F.lit(REPORT_NAME)).otherwise(
            F.concat(F.regexp_replace(folder, "^/", ""), F.lit(f"/{REPORT_NAME}"))
        ),
        F.lit("\n"),
    )


def _report_tail(raw: Column, aside: Column | None) -> Column:
    def text(name: str) -> Column:
        value = v.field(raw, name.lower())
        shown = F.when(v.is_falsy(value), "") if name == "Design" else F.when(value.isNull(), "")
        return F.concat(F.lit(f"\n# {name}:\n"), shown.otherwise(v.printed(value, aside)), F.lit("\n"))

    lists = [
        md_list(F.transform(v.items(v.field(raw, title.lower())), lambda x: v.printed(x, aside)), title)
        for title in LIST_SECTIONS
    ]
    return F.concat(text("Overview"), text("Review"), text("Design"), *lists)


def render_project_reports(
    entries: DataFrame,
    payloads: DataFrame,
    ai: Column | str,
    ts: Column | str,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Folder reports: ``folder, part, report, err``; texts in order of ``part`` make a report.

    ``entries`` come from ``project_entries``; ``payloads(folder, raw, comment_language)`` hold
    one checked reply per folder, with ``aside`` where very long strings were set aside. Non-empty ``reviews`` of a reply replace the listed files,
    and a list of ``sub_module_reviews`` the listed sub-modules.

    A report is one row unless its listing exceeds ``part_bytes``; then it is cut into parts
    that are built apart, each sorted, files before sub-modules.
    """
    raw = F.col("raw")
    aside = F.col("aside") if "aside" in payloads.columns else None
    if "comment_language" not in payloads.columns:
        payloads = payloads.withColumn("comment_language", F.lit(c.DEFAULT_LANGUAGE))
    replies = compute_once(
        payloads.filter(raw.isNotNull()),
        _files=v.field(raw, "reviews"),
        _subs=v.field(raw, "sub_module_reviews"),
        _head=_report_head(ai, ts),
        _tail=_report_tail(raw, aside),
    )
    has_files = v.is_object(F.col("_files")) & ~v.is_falsy(F.col("_files"))
    has_subs = v.is_list(F.col("_subs"))
    flags = replies.select("folder", has_files.alias("_files"), has_subs.alias("_subs"))
    no_text = F.lit(None).cast("string").alias("text")
    requested = (
        entries.join(flags, "folder")
        .filter(F.when(F.col("kind") == 0, ~F.col("_files")).otherwise(~F.col("_subs")))
        .select("folder", "kind", "path", no_text)
    )

    # A reply's own lists, and the texts around the listing, are rows of the same form.
    def row(kind: int, path: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), path.alias("path"), text.alias("text"))

    none = F.lit(None).cast("string")
    names = F.map_keys(F.try_variant_get(F.col("_files"), "$", "map<string,variant>"))
    own = [
        F.transform(F.when(has_files, names), lambda p: row(0, p, none)),
        F.transform(F.when(has_subs, v.items(F.col("_subs"))), lambda p: row(1, v.printed(p, aside), none)),
    ]
    frame = F.array(row(-1, none, F.col("_head")), row(2, none, F.col("_tail")))
    rows = F.concat(frame, *[F.coalesce(x, F.slice(frame, 1, 0)) for x in own])
    listed = requested.unionByName(replies.select("folder", F.inline(rows)))
    rel = F.when(F.col("path").isNotNull(), relative_path(F.col("path"), rooted_path(F.col("folder"))))
    outside = F.col("rel").isNull() & F.col("path").isNotNull()
    placed = place_in_parts(
        compute_once(listed, rel=rel),
        ["folder"],
        ["kind", "rel", "path"],
        ["text"],
        part_bytes,
        _last=F.max(F.when(F.col("kind") < 2, F.struct("kind", "rel"))),
        _outside=F.max(outside),
    )
    # In a cut report the head comes first, then files, sub-modules, the last entry with the
    # tail; all rows of a report with a path outside the folder but the head are of no use.
    kind, parts = F.col("kind"), F.col("parts")
    is_last = F.struct("kind", "rel") == F.col("_last")
    part = (
        F.when(parts == 1, 0)
        .when(kind < 0, -1)
        .when((kind == 2) | is_last, 2 * parts)
        .otherwise(kind * parts + F.col("part"))
    )
    groups = (
        placed.withColumn("part", part)
        .filter((F.col("part") <= 0) | ~F.coalesce(F.col("_outside"), F.lit(False)) | (parts == 1))
        .repartition("folder", "part")
        .groupBy("folder", "part", "parts")
        .agg(
            F.array_sort(F.collect_list(F.struct("kind", "rel", "text"))).alias("_items"),
            F.max(outside | F.coalesce(F.col("_outside"), F.lit(False))).alias("_bad"),
        )
    )

    def of_kind(k: int, name: str) -> Column:
        return F.filter(F.col("_items"), lambda e: e["kind"] == k)[name]

    groups = compute_once(
        groups,
        _head=F.array_join(of_kind(-1, "text"), ""),
        _files=of_kind(0, "rel"),
        _subs=of_kind(1, "rel"),
        _tail=F.array_join(of_kind(2, "text"), ""),
    )
    closes = (parts == 1) | (F.col("part") == 2 * parts)
    report = F.concat(
        F.col("_head"),
        tree_lines(F.col("_files"), "", closes & (F.size("_subs") == 0)),
        tree_lines(F.col("_subs"), "──", closes),
        F.col("_tail"),
    )
    return groups.filter(~F.col("_bad") | (F.col("part") == F.when(parts == 1, 0).otherwise(-1))).select(
        "folder",
        "part",
        F.when(~F.col("_bad"), report).alias("report"),
        F.when(
            F.col("_bad"), F.concat(F.lit("Some path is not in the prefix "), F.col("folder"))
        ).alias("err"),
    )


_MARKER = r"^-{10} \[(.+)\]$"


def parse_review_sections(reviews: DataFrame) -> DataFrame:
    """Lines of each section of a stored review: ``path, section, ord, text``.

    Inverse of the rendered header. Sections are cut inside the row, without a shuffle.
    """
    lines = F.col("_lines")
    marks = F.filter(
        F.transform(
            lines,
            lambda line, i: F.struct(
                i.alias("at"),
                F.regexp_extract(line, _MARKER, 1).alias("section"),
                (line == RULE).alias("rule"),
            ),
        ),
        lambda m: (m["section"] != "") | m["rule"],
    )
    ends = F.col("_marks.at")
    items = F.flatten(
        F.transform(
            F.col("_marks"),
            lambda m, k: F.transform(
                F.slice(
                    lines,
                    m["at"] + 2,
                    F.coalesce(F.get(ends, k + 1), F.size(lines)) - m["at"] - 1,
                ),
                lambda text, i: F.struct(
                    m["section"].alias("section"), i.alias("ord"), text.alias("text")
                ),
            ),
        )
    )
    return (
        reviews.filter(F.col("review").isNotNull())
        .withColumn("_lines", F.split("review", "\n", -1))
        .transform(lambda df: compute_once(df, _marks=marks))
        .select("path", F.inline(items))
        .filter(F.col("section") != "")
    )


def parse_review_headers(reviews: DataFrame) -> DataFrame:
    """Who reviewed a file, when and in which language: ``path, ai, reviewed_at, lang``."""
    pattern = r"(?m)^-{10} Reviewed by: (.*) @ (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)$"
    stamp = F.regexp_extract("review", pattern, 2)
    return reviews.filter(F.rlike("review", F.lit(pattern))).select(
        "path",
        F.regexp_extract("review", pattern, 1).alias("ai"),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("reviewed_at"),
        c.comment_language(F.split("review", "\n", -1)).alias("lang"),
    )


def review_rollup(sections: DataFrame, files: DataFrame) -> DataFrame:
    """Section items by folder and language with totals: ``folder, language, section, n``.

    NULL marks a total. Counted per file before the languages are joined in.
    """
    per_file = sections.groupBy("path", "section").agg(F.count("*").alias("_n"))
    tagged = with_language(files.select("path")).select("path", "language")
    joined = per_file.join(tagged, "path").select(
        parent_folder(F.col("path")).alias("folder"), "language", "section", "_n"
    )
    return (
        joined.groupingSets(
            [["folder", "language", "section"], ["folder", "section"], ["section"]],
            "folder", "language", "section",
        )
        .agg(F.sum("_n").alias("n"))
    )


def audit_registry(claims: DataFrame) -> DataFrame:
    """Languages or extensions claimed more than once: ``what, value, n``; empty when sound.

    ``claims(language, extension)``: a language is claimed once per row set of one owner, an
    extension by each distinct language that lists it.
    """
    owners = claims.select("language", F.lower("extension").alias("extension")).distinct()
    by_extension = owners.groupBy("extension").agg(F.count("*").alias("n")).select(
        F.lit("extension").alias("what"), F.col("extension").alias("value"), "n"
    )
    repeated = claims.groupBy("language", F.lower("extension").alias("extension")).agg(
        F.count("*").alias("n")
    ).select(
        F.lit("claim").alias("what"),
        F.concat_ws(" ", "language", "extension").alias("value"),
        "n",
    )
    return by_extension.unionByName(repeated).filter(F.col("n") > 1)
