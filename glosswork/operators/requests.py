"""Building review requests, prompts, contexts and time budgets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions import comments as c
from glosswork.functions.paths import parent_folder
from glosswork.functions.render import run_budget, run_seconds
from glosswork.functions.text import (
    json_list,
    json_map,
    json_members,
    json_string,
    py_splitlines,
    strip_newlines,
)
from glosswork.operators.comments import MARKER_COLUMNS, with_language
from glosswork.operators.grouping import PART_BYTES, collect_in_parts, ordered_pieces
from glosswork.operators.steps import compute_once
from glosswork.session import write_repeated_texts


def folder_references(docs: DataFrame, part_bytes: int | None = PART_BYTES) -> DataFrame:
    """Reference documents of each folder: ``folder, part, parts, references`` (sorted); one row with ``part_bytes=None``."""
    distinct = docs.select("folder", F.col("path").alias("reference")).distinct()
    return collect_in_parts(distinct, ["folder"], ["reference"], part_bytes=part_bytes).select(
        "folder", "part", "parts", F.col("items.reference").alias("references")
    )


# A folder's files are dealt into so many shares, each with its own copy of the list.
SHARES = 16


def deal_by_folder(files: DataFrame) -> DataFrame:
    """Add ``_folder`` and ``_share`` and deal the files by them into all partitions.

    For joins where few rows make much output: the sizes of the inputs alone would have a few tasks join them all.
    """
    share = F.pmod(F.xxhash64("path"), F.lit(SHARES)).cast("int")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.withColumns({"_folder": parent_folder(F.col("path")), "_share": share}).repartition(tasks, "_folder", "_share")


def join_lists(dealt: DataFrame, lists: DataFrame) -> DataFrame:
    """Files from ``deal_by_folder`` with the rows of ``lists`` of their ``_folder``; NULLs where it has none."""
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = lists.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(tasks, "_folder", "_share")
    # Files on the left: a folder with very many files is then the splittable side.
    return dealt.join(copies, ["_folder", "_share"], "left")


def attach_references(
    files: DataFrame, docs: DataFrame, part_bytes: int | None = None, **derived: Callable[[Column], Column]
) -> DataFrame:
    """Add ``references``, the documents in the file's own folder, and ``reference_parts``.

    The list is whole, whatever its size, and repeats for every file of a folder. A caller that gives ``part_bytes``
    takes larger lists from elsewhere: they are not copied to the files, ``references`` is NULL there and
    ``reference_parts`` says how many rows of ``folder_references`` hold the whole list. ``derived``
    columns are functions of the list, computed once per folder and not once per file.
    """
    write_repeated_texts(files.sparkSession)
    none = F.array().cast("array<string>")
    # One row per folder; the arrays of a list in several parts are not moved at all.
    lists = (
        folder_references(docs, part_bytes)
        .select("folder", "parts", F.when(F.col("parts") == 1, F.col("references")).alias("references"))
        .groupBy(F.col("folder").alias("_folder"))
        .agg(F.max("parts").alias("parts"), F.max("references").alias("references"))
    )
    if derived:
        lists = compute_once(lists, **{name: make(F.col("references")) for name, make in derived.items()})
    by_folder = join_lists(deal_by_folder(files), lists)
    parts = F.coalesce(F.col("parts"), F.lit(0))
    whole = {"references": (F.col("references"), none)} | {name: (F.col(name), make(none)) for name, make in derived.items()}
    return by_folder.select(
        *files.columns,
        *[F.when(parts <= 1, F.coalesce(value, empty)).alias(name) for name, (value, empty) in whole.items()],
        parts.alias("reference_parts"),
    )


def build_context(files: DataFrame, diffs: DataFrame, context: str = "") -> DataFrame:
    """Add ``context``: a JSON object with the file's diff and the caller's text, if any."""
    joined = files.join(diffs.select("path", F.col("diff").alias("_diff")), "path", "left")
    return joined.select(
        *files.columns,
        json_members(
            [
                ("git-diff", json_string(F.nullif(F.col("_diff"), F.lit("")))),
                ("context", json_string(F.nullif(F.lit(context), F.lit("")))),
            ]
        ).alias("context"),
    )


# Columns that stand for a request's list when prompts are made: its JSON text and the characters of that.
LIST_TEXT, LIST_CHARS = "reference_json", "reference_chars"


def build_review_requests(
    files: DataFrame, refs: DataFrame | None = None, context: Column | str = "", part_bytes: int | None = None,
    rendered: bool = False, **derived: Callable[[Column], Column],
) -> DataFrame:
    """One request per file: ``path``, the language columns, ``request`` and ``err``.

    ``refs`` are reference documents (``folder, path``); a ``context`` column of ``files``
    takes precedence over the argument. Files without code give an empty ``request.input``.
    Every list of references is whole. Only where ``part_bytes`` is given, ``request.references`` of a folder that exceeds
    it is NULL, and so is the prompt that ``render_prompts`` makes, for callers of ``request_pieces``, which gives
    the whole request in order. With ``rendered``,
    each folder's list is also given as JSON text, made once per folder, for ``render_prompts``; ``derived``
    are further columns as in ``attach_references``.
    """
    df = with_language(files)
    if refs is not None or "references" not in df.columns:
        df = df.withColumn("references", F.lit(None).cast("array<string>") if refs is not None else F.array().cast("array<string>"))
    if "context" not in df.columns:
        df = df.withColumn("context", context if isinstance(context, Column) else F.lit(context))
    df = compute_once(df, _lines=py_splitlines(F.col("content")))
    df = compute_once(df, _reviews=c.tagged_lines(F.col("_lines"), c.REVIEW_TAG))
    code = F.array_join(
        c.without_tagged_lines(F.col("_lines"), c.REVIEW_TAG, c.REQUIREMENT_TAG), "\n"
    )
    request = F.struct(
        parent_folder(F.col("path")).alias("path"),
        F.col("references"),
        c.comment_language(F.col("_reviews")).alias("comment_language"),
        F.array_join("_reviews", "\n").alias("prior_review"),
        F.array_join(c.tagged_lines(F.col("_lines"), c.REQUIREMENT_TAG), "\n").alias("requirements"),
        F.col("context"),
        strip_newlines(code).alias("input"),
    )
    df = compute_once(df, request=F.when(F.col("language").isNotNull(), request))
    df = df.select("path", *MARKER_COLUMNS, "request", *(["reference_parts"] if refs is None and "reference_parts" in df.columns else []), "err")
    if refs is None:
        return df
    if rendered:
        derived = {LIST_TEXT: json_list, LIST_CHARS: lambda x: F.length(json_list(x)), **derived}
    # The lists come last, so that no step copies them and what is not read of them is not moved.
    listed = attach_references(df, refs, part_bytes, **derived)
    return listed.select(
        "path",
        *MARKER_COLUMNS,
        F.col("request").withField("references", F.col("references")).alias("request"),
        *derived,
        "reference_parts",
        "err",
    )


def request_json(request: Column, fields: list[T.StructField], given: dict[str, Column] | None = None) -> Column:
    """A request as an indented JSON object, members in schema order; ``given`` are members' JSON texts."""
    members = []
    for f in fields:
        value = request[f.name]
        if given and f.name in given:
            text = given[f.name]
        elif isinstance(f.dataType, T.ArrayType):
            text = json_list(value)
        elif isinstance(f.dataType, T.MapType):
            text = json_map(value)
        else:
            text = json_string(value)
        members.append((f.name, text))
    return json_members(members)


def list_items(rows: DataFrame, keys: list[str], item: str, text: Column) -> DataFrame:
    """Rows of indented JSON lists with their text: the first of each key without the comma ahead."""
    first = rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(item).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    comma = F.when(F.col(item) == F.col("_first"), "").otherwise(",")
    return rows.join(first, same).select(*keys, item, F.concat(comma, F.lit("\n    "), text).alias("text"))


def reference_pieces(docs: DataFrame, piece_bytes: int = PART_BYTES) -> DataFrame:
    """The items of each folder's reference list as JSON text in ordered pieces: ``folder, piece, text``."""
    distinct = docs.select("folder", F.col("path").alias("reference")).distinct()
    items = list_items(distinct, ["folder"], "reference", json_string(F.col("reference")))
    return ordered_pieces(items, ["folder"], ["reference"], "text", piece_bytes)


def folder_pieces(docs: DataFrame, piece_bytes: int = PART_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """The pieces of each folder's list for the folder's files: ``_folder, _big, _framed, _list``.

    A list of up to ``part_bytes`` is one row with all its pieces in order. A larger one (``_big``) has a row for
    each piece, and one without pieces (``_framed``) for the text around the list.
    """
    # By the items and not by the pieces, whose cuts may differ from run to run.
    size = F.sum(F.coalesce(F.octet_length("path"), F.lit(0)).cast("long") + 16)
    sizes = docs.select("folder", "path").distinct().groupBy("folder").agg((size > part_bytes).alias("_big"))
    pieces = reference_pieces(docs, piece_bytes).join(sizes, "folder")
    listed = pieces.groupBy("folder", "_big", F.when(F.col("_big"), F.col("piece")).alias("_piece")).agg(
        F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("_list")
    )
    rows = listed.select(F.col("folder").alias("_folder"), "_big", (~F.col("_big")).alias("_framed"), "_list")
    frames = sizes.filter("_big").select(F.col("folder").alias("_folder"), "_big", F.lit(True).alias("_framed"))
    return rows.unionByName(frames, allowMissingColumns=True)


def request_pieces(
    requests: DataFrame, docs: DataFrame, lang: str = "", piece_bytes: int = PART_BYTES, gathered: bool = False,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Whole requests of any size as JSON text in ordered pieces: ``path, piece, text``.

    Joined by ``piece``, the texts of a path are the ``user_prompt`` that a request of ordinary size
    has. The list of a folder is cut once and repeats for each of the given requests, so pass
    those that are about to run.

    With ``gathered``, the same pieces come as arrays, ``path, whole, pieces``: ``whole`` is true where the row holds
    all pieces of its path, in order, so that they need no exchange to be joined. It is not where the list exceeds
    ``part_bytes`` or the path has several requests.
    """
    fields = requests.schema["request"].dataType.fields
    request = F.col("request").withField(
        "comment_language", c.language_override(lang, F.col("request.comment_language"))
    ).withField("references", F.array(F.lit("")))
    asked = requests.filter(F.col("request").isNotNull())
    # The text around the list, cut at its one empty item.
    frame = F.split(request_json(request, fields), '\\n    ""\n  ', 2)
    dealt = deal_by_folder(asked.select("path", frame.alias("_frame")))
    same_path = Window.partitionBy("_folder", "_share", "path")
    counted = dealt.withColumn("_requests", F.count(F.lit(1)).over(same_path))
    framed = join_lists(counted, folder_pieces(docs, piece_bytes, part_bytes))
    closing = F.when(F.col("_big").isNotNull(), F.lit("\n  ")).otherwise(F.lit(""))

    def piece(number: int, text: Column) -> Column:
        return F.array(F.struct(F.lit(number).cast("long").alias("piece"), text.alias("text")))

    opened, closed = piece(-1, F.get("_frame", F.lit(0))), piece(2**63 - 1, F.concat(closing, F.get("_frame", F.lit(1))))
    none = F.slice(opened, 1, 0)
    around = F.concat(opened, F.coalesce(F.col("_list"), none), closed)
    pieces = framed.select(
        "path",
        (~F.coalesce("_big", F.lit(False)) & (F.col("_requests") == 1)).alias("whole"),
        F.when(F.coalesce("_framed", F.lit(True)), around).otherwise(F.col("_list")).alias("pieces"),
    )
    return pieces if gathered else pieces.select("path", F.inline("pieces"))


def piece_budgets(pieces: DataFrame, key: str, system_prompt: Column, timeout: Column | int = 0) -> DataFrame:
    """Time allowed for runs whose requests come in pieces: ``key, seconds``."""
    chars = pieces.groupBy(key).agg(F.sum(F.length("text").cast("long")).alias("_chars"))
    return chars.select(key, run_seconds(F.col("_chars") + F.length(system_prompt), timeout).alias("seconds"))


def render_prompts(requests: DataFrame, template: str, lang: str = "") -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt``.

    ``template`` may hold the placeholders `` `comment_language` `` and, for file requests,
    `` `programming_language` ``. A non-empty ``lang`` replaces the stored comment language. A request
    with a list in pieces has no ``user_prompt`` here. Requests with rendered lists also get ``user_chars``,
    the length of ``user_prompt``.
    """
    fields = requests.schema["request"].dataType.fields
    df = requests.withColumn(
        "request",
        F.col("request").withField(
            "comment_language", c.language_override(lang, F.col("request.comment_language"))
        ),
    )
    system = F.replace(
        F.lit(template), F.lit("`comment_language`"), F.col("request.comment_language")
    )
    if "language" in requests.columns:
        system = F.when(
            F.col("language").isNotNull(),
            F.replace(system, F.lit("`programming_language`"), F.col("language")),
        ).otherwise(system)
    has_request = F.col("request").isNotNull()
    whole = has_request
    for f in fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType)) and not (f.name == "references" and LIST_TEXT in requests.columns):
            whole = whole & F.col("request")[f.name].isNotNull()
    df = df.withColumn("system_prompt", F.when(has_request, system))
    if LIST_TEXT not in requests.columns:
        return df.withColumn("user_prompt", F.when(whole, request_json(F.col("request"), fields)))
    request = F.col("request")
    prompt = request_json(request, fields, {"references": F.col(LIST_TEXT)})
    rest = F.length(request_json(request, fields, {"references": F.lit("")}))
    return df.withColumns(
        {"user_prompt": F.when(whole & F.col(LIST_TEXT).isNotNull(), prompt), "user_chars": F.when(whole, rest + F.col(LIST_CHARS))}
    ).drop(LIST_TEXT, LIST_CHARS)


def estimate_run_budget(prompts: DataFrame, timeout: Column | int = 0) -> DataFrame:
    """Add ``seconds``, the time allowed for each run.

    Where ``render_prompts`` has counted the characters (``user_chars``), the prompt itself is not made.
    """
    if "user_chars" in prompts.columns:
        return prompts.withColumn("seconds", run_seconds(F.length("system_prompt") + F.col("user_chars"), timeout)).drop("user_chars")
    return prompts.withColumn(
        "seconds", run_budget(F.col("system_prompt"), F.col("user_prompt"), timeout)
    )


def folder_budgets(prompts: DataFrame, timeout: Column | int = 0) -> DataFrame:
    """Runs, total and longest budget per folder, for planning."""
    return (
        estimate_run_budget(prompts, timeout)
        .groupBy(F.col("request.path").alias("folder"))
        .agg(
            F.count("*").alias("runs"),
            F.sum("seconds").alias("total_seconds"),
            F.max("seconds").alias("longest_seconds"),
        )
    )
