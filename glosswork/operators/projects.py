"""Review requests of whole folders, and their recorded replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import comments as c
from glosswork.functions.paths import parent_folder
from glosswork.functions.text import json_string
from glosswork.operators.grouping import PART_BYTES, ordered_pieces
from glosswork.operators.requests import folder_references, list_items, request_json
from glosswork.operators.reviews import project_reviews, submodule_reviews, submodule_rows
from glosswork.operators.runs import read_replies


def _whole_lists(parts: DataFrame, value: str) -> DataFrame:
    """One row per folder: the number of parts, and the value where there is only one."""
    return parts.groupBy(F.col("folder").alias("_folder")).agg(
        F.max("parts").alias("_parts"),
        F.first(F.when(F.col("parts") == 1, F.col(value)), ignorenulls=True).alias(value),
    )


def build_project_requests(
    folders: DataFrame,
    file_reviews: DataFrame,
    reports: DataFrame,
    docs: DataFrame | None = None,
    context: Column | str = "",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One request per folder: ``folder, request, pieces``.

    ``file_reviews(path, review)`` are listed for the folder that holds them, ``reports(folder,
    report)`` for its parent; a folder's own stored report only gives the comment language.
    ``docs(folder, path)`` are reference documents. A list that exceeds ``part_bytes`` is NULL,
    ``pieces`` is true, and ``project_request_pieces`` gives the whole request in order.
    """
    asked = folders.select("folder").distinct()
    own = reports.groupBy(F.col("folder").alias("_folder")).agg(F.max("report").alias("_report"))
    rows = asked.join(own, F.col("folder") == F.col("_folder"), "left").drop("_folder")
    texts = "array<string>"
    lists = {
        "reviews": (
            project_reviews(file_reviews, part_bytes),
            F.map_from_arrays(F.array().cast(texts), F.array().cast(texts)),
        ),
        "sub_module_reviews": (submodule_reviews(folders, reports, part_bytes), F.array().cast(texts)),
    }
    if docs is not None:
        lists["references"] = (folder_references(docs, part_bytes), F.array().cast(texts))
    too_long = F.lit(False)
    for name, (parts, none) in lists.items():
        rows = rows.join(_whole_lists(parts, name), F.col("folder") == F.col("_folder"), "left").drop("_folder")
        whole = F.coalesce("_parts", F.lit(1)) == 1
        rows = rows.withColumn(name, F.when(whole, F.coalesce(name, none))).withColumnRenamed("_parts", f"_parts_{name}")
        too_long = too_long | (F.coalesce(f"_parts_{name}", F.lit(1)) > 1)
    request = F.struct(
        F.col("folder").alias("path"),
        (F.col("references") if docs is not None else F.array().cast(texts)).alias("references"),
        c.report_language(F.col("_report")).alias("comment_language"),
        F.lit("").alias("prior_review"),
        (context if isinstance(context, Column) else F.lit(context)).alias("context"),
        F.col("reviews"),
        F.col("sub_module_reviews"),
    )
    return rows.select("folder", request.alias("request"), too_long.alias("pieces"))


def project_request_pieces(
    requests: DataFrame,
    folders: DataFrame,
    file_reviews: DataFrame,
    reports: DataFrame,
    docs: DataFrame | None = None,
    lang: str = "",
    piece_bytes: int = PART_BYTES,
) -> DataFrame:
    """Whole folder requests of any size as JSON text in ordered pieces: ``folder, piece, text``.

    ``requests`` come from ``build_project_requests``, the rest as given to it. Joined by ``piece``, the texts
    of a folder are the ``user_prompt`` that a request of ordinary size has.
    """
    fields = requests.schema["request"].dataType.fields
    marks = F.array(F.lit(""))
    request = F.col("request").withField(
        "comment_language", c.language_override(lang, F.col("request.comment_language"))
    )
    for name, empty in (("references", marks), ("sub_module_reviews", marks), ("reviews", F.create_map(F.lit(""), F.lit("")))):
        request = request.withField(name, empty)
    asked = requests.select("folder", request.alias("request"))
    # The text around the three lists, cut at their one empty item each.
    frame = F.split(request_json(F.col("request"), fields), r'\n    ""(?:: "")?\n  (?=[\]}])', 4)
    kinds = {f.name: i for i, f in enumerate(f for f in fields if f.name in ("references", "reviews", "sub_module_reviews"))}
    known = file_reviews.filter(F.col("review").isNotNull()).groupBy("path").agg(F.max("review").alias("review"))
    given = {
        "reviews": known.select(
            parent_folder(F.col("path")).alias("folder"), F.col("path").alias("item"),
            F.concat(json_string(F.col("path")), F.lit(": "), json_string(F.col("review"))).alias("shown"),
        ),
        "sub_module_reviews": submodule_rows(folders, reports).select(
            "folder", F.col("report_path").alias("item"), json_string(F.col("report_path")).alias("shown")
        ),
    }
    if docs is not None:
        given["references"] = docs.select("folder", F.col("path").alias("item"), json_string(F.col("path")).alias("shown")).distinct()
    listed = None
    for name, rows in given.items():
        own = rows.join(asked.select("folder"), "folder", "left_semi").withColumn("kind", F.lit(2 * kinds[name] + 1))
        listed = own if listed is None else listed.unionByName(own)
    items = list_items(listed, ["folder", "kind"], "item", F.col("shown"))
    filled = listed.groupBy(F.col("folder").alias("_folder")).agg(F.collect_set("kind").alias("_kinds"))
    texts = asked.join(filled, F.col("folder") == F.col("_folder"), "left").select(
        "folder", F.coalesce("_kinds", F.array().cast("array<int>")).alias("_kinds"), F.posexplode(frame).alias("_at", "_text")
    )
    # A list that is not empty closes on a line of its own.
    closing = F.when(F.array_contains("_kinds", F.col("_at") * 2 - 1), F.lit("\n  ")).otherwise(F.lit(""))
    frames = texts.select("folder", (F.col("_at") * 2).alias("kind"), F.lit("").alias("item"), F.concat(closing, "_text").alias("text"))
    return ordered_pieces(frames.unionByName(items.select(*frames.columns)), ["folder"], ["kind", "item"], "text", piece_bytes)


def project_replies(requests: DataFrame, ai_runs: DataFrame, lang: str = "") -> DataFrame:
    """Good replies of recorded folder runs: ``folder, raw, aside, comment_language``.

    The request id of a run is the folder; of several good runs the first attempt counts.
    """
    good = read_replies(ai_runs).filter(F.col("err").isNull())
    first = good.groupBy("request_id").agg(F.min_by(F.struct("raw", "aside"), "attempt").alias("_reply"))
    asked = requests.filter(F.col("request").isNotNull()).select(
        "folder", c.language_override(lang, F.col("request.comment_language")).alias("comment_language")
    )
    return asked.join(first, F.col("folder") == F.col("request_id")).select("folder", "_reply.*", "comment_language")
