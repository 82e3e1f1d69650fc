"""Building blocks of the SQL counterparts (DuckDB dialect)."""

from __future__ import annotations

from catalog import corpora as k
from glosswork.functions.text import WHITESPACE
from glosswork.languages import LANGUAGES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = quote(WHITESPACE)
REVIEW, REQUIREMENT = quote("\\/"), quote("\\%")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def lines_of(c: str) -> str:
    return (
        f"CASE WHEN {c} = '' THEN []::VARCHAR[] "
        f"WHEN right({c}, 1) = chr(10) THEN string_split(left({c}, length({c}) - 1), chr(10)) "
        f"ELSE string_split({c}, chr(10)) END"
    )


def tagged(x: str, tag: str) -> str:
    return (
        f"(CASE WHEN lp <> '' THEN starts_with({strip(x)}, lp || {tag}) WHEN bp <> '' "
        f"THEN starts_with({strip(x)}, bp || {tag}) AND ends_with({strip(x)}, bs) ELSE false END)"
    )


def inner(x: str, tag: str) -> str:
    t = strip(x)
    return strip(
        f"CASE WHEN lp <> '' THEN substr({t}, length(lp || {tag}) + 1) ELSE "
        f"substr({t}, length(bp || {tag}) + 1, "
        f"greatest(0, length({t}) - length(bp || {tag}) - length(bs))) END"
    )


def comments_in(lines: str, tag: str) -> str:
    return (
        f"list_transform(list_filter({lines}, lambda x: {tagged('x', tag)}), lambda x: {inner('x', tag)})"
    )


def extension(path: str) -> str:
    name = f"ltrim(string_split({path}, '/')[-1], '.')"
    return (
        f"CASE WHEN contains({name}, '.') THEN lower('.' || string_split({name}, '.')[-1]) ELSE '' END"
    )


def folder(path: str) -> str:
    return (
        f"CASE WHEN NOT contains({path}, '/') THEN '.' "
        f"ELSE left({path}, length({path}) - length(string_split({path}, '/')[-1]) - 1) END"
    )


def js(c: str) -> str:
    """A JSON string literal of a text."""
    return f"CAST(to_json({c}) AS VARCHAR)"


def line_comment(c: str, tag: str) -> str:
    prefixed = (
        f"array_to_string(list_transform(string_split({c}, chr(10)), "
        f"lambda x: CASE WHEN {strip('x')} = '' THEN x ELSE lp || {tag} || ' ' || x END), chr(10))"
    )
    return f"CASE WHEN lp <> '' THEN {prefixed} WHEN bp <> '' THEN {wrapped(c, tag)} END"


def wrapped(c: str, tag: str) -> str:
    space = f"CASE WHEN contains({c}, chr(10)) THEN chr(10) ELSE ' ' END"
    return f"CASE WHEN NOT contains({c}, bs) THEN bp || {tag} || {space} || {c} || {space} || bs END"


def block_comment(c: str, tag: str) -> str:
    return f"CASE WHEN bp <> '' THEN {wrapped(c, tag)} ELSE {line_comment(c, tag)} END"


def comment_error(c: str, block: str = "false") -> str:
    return (
        f"CASE WHEN bp <> '' AND ({block} OR lp = '') AND contains({c}, bs) "
        f"THEN 'Block comment suffix ''' || bs || ''' found in comment' END"
    )


def joined(lines: str) -> str:
    return f"array_to_string({lines}, chr(10))"


REVIEW_TEXT = (
    "CASE WHEN len(list_filter(rv, lambda r: starts_with(r, '---------- [Review]'))) > 0 THEN "
    + joined(
        "list_concat(list_concat(rv, CASE WHEN len(rq) > 0 THEN ['---------- [Requirements]'] "
        "ELSE []::VARCHAR[] END), rq)"
    )
    + " END"
)
_FIRST_LANG = "list_filter(rv, lambda r: starts_with(r, '$lang:'))[1]"
COMMENT_LANGUAGE = (
    f"coalesce(nullif(string_split({strip(f'substr({_FIRST_LANG}, 7)')}, ' ')[1], ''), 'English')"
)

_LANG_ROWS = ", ".join(
    "(" + ", ".join(map(quote, (lang.name, ext, *lang[2:]))) + ")"
    for lang in LANGUAGES
    for ext in lang.extensions
)


def files_ctes(name: str, relation: str) -> list[tuple[str, str]]:
    """CTEs ``name_d`` (language), ``name_l`` (lines), ``name_t`` (tagged comments)."""
    return [
        (
            f"{name}_d",
            f"SELECT s.*, l.language, l.lp, l.bp, l.bs FROM (SELECT *, {extension('path')} AS extension "
            f"FROM {relation}) s LEFT JOIN lang l USING (extension)",
        ),
        (f"{name}_l", f"SELECT *, {lines_of('content')} AS lines FROM {name}_d"),
        (
            f"{name}_t",
            f"SELECT *, CASE WHEN language IS NOT NULL THEN {comments_in('lines', REVIEW)} END AS rv, "
            f"CASE WHEN language IS NOT NULL THEN {comments_in('lines', REQUIREMENT)} END AS rq, "
            f"CASE WHEN language IS NOT NULL THEN list_filter(lines, lambda x: NOT {tagged('x', REVIEW)} "
            f"AND NOT {tagged('x', REQUIREMENT)}) END AS code FROM {name}_l",
        ),
    ]


BASE: list[tuple[str, str]] = [
    ("lang", f"SELECT * FROM (VALUES {_LANG_ROWS}) AS v(language, extension, lp, bp, bs)"),
    ("src", k.sql_steps("documents", k.source_steps(k.SQL_LINES))),
    *files_ctes("f", "src"),
    ("edits", k.sql_steps("src", k.EDIT_STEPS)),
    ("reviews", f"SELECT path, {REVIEW_TEXT} AS review FROM f_t"),
    ("old_s", f"SELECT path, content FROM src WHERE {k.OLD_WHERE}"),
    ("new_s", k.sql_steps("src", k.NEW_STEPS, k.NEW_WHERE)),
    ("html", k.sql_steps("pages", k.HTML_STEPS)),
    ("runs", k.sql_steps("conversations", k.RUN_STEPS)),
    ("ev", k.sql_steps("events", k.EVENT_STEPS)),
    ("listing", k.sql_steps("documents", k.LISTING_STEPS)),
    (
        "docs",
        f"SELECT {folder('path')} AS folder, path FROM listing "
        "WHERE ends_with(path, '.md') AND NOT ends_with(path, '.REVIEW.md')",
    ),
]


def _names_in(text: str, names: set[str]) -> set[str]:
    import re

    return {w for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text) if w in names}


def query(body: str, *ctes: tuple[str, str]) -> str:
    """A statement with the CTEs the body needs, directly or through others."""
    available = [*BASE, *ctes]
    names = {name for name, _ in available}
    needed, todo = set(), _names_in(body, names)
    texts = dict(available)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _names_in(texts[name], names) - needed
    chosen = [f"{name} AS ({text})" for name, text in available if name in needed]
    return (f"WITH {', '.join(chosen)} " if chosen else "") + body


# Token lists, from texts whose comments are gone and whose literals stand in marks. Nothing here is
# taken from the library: which parts are comments and literals is known from how the files are made.
SEP, OPEN, CLOSE = "chr(57344)", *(f"chr({ord(m)})" for m in k.MARKS)
_O, _C = k.MARKS
_LITERAL = f"{_O}[^{_C}]*{_C}"
_NAME = r"[a-zA-Z_$\p{L}][a-zA-Z_$0-9\p{L}\p{N}]*"
_PIECES = rf"{_LITERAL}|{_NAME}|[0-9][a-zA-Z_.0-9]*"
_SHELL_PIECES = rf"{_LITERAL}|[^ \t\r\f\n;&|()<>{_O}]+|[ \t\r\f]+|[^ \t\r\f]"
_IS_SIGN = "({x} IN ('+', '-', '*', '/', '%', '=', '<', '>', '!', '&', '|', '^', '~', '?', ':', '.', '@'))"


def _prose_marks() -> str:
    """Prose as code: strings in double quotes, and what follows a hash in the languages where that is a comment."""
    quoted = f"regexp_replace(x, '(\"[^\"]*\")', '{_O}\\1{_C}', 'g')"
    hashed = "regexp_replace(x, '^((?:[^#\"]|\"[^\"]*\")*)#.*$', '\\1')"
    worded = "regexp_replace(x, '(^|[ \\t;&|()<>])#.*$', '\\1')"
    return (
        f"CASE WHEN ext IN ('.py', '.PY') THEN {quoted.replace('(x,', f'({hashed},', 1)} "
        f"WHEN ext = '.sh' THEN {quoted.replace('(x,', f'({worded},', 1)} WHEN ext = '.html' THEN x ELSE {quoted} END"
    )


def _directives(x: str) -> str:
    """In three languages the line break behind a line that a hash begins is a token."""
    ended = f"regexp_replace({x}, '(?m)^([ \\t]*(?:#|{_O}#include)[^\\n]*)(?:\\n|\\z)', '\\1{_O}\n{_C}', 'g')"
    return f"CASE WHEN language IN ('c', 'cpp', 'c_sharp') THEN {ended} ELSE {x} END"


def token_ctes(name: str, relation: str) -> list[tuple[str, str]]:
    """CTEs ``name_k``: ``id, language, toks`` and ``name_p``: ``fingerprint``, from ``relation(id, language, marked)``."""
    blank, is_sign = "regexp_full_match({x}, '[ \\t\\r\\f\\n]+')", _IS_SIGN.format
    inner = "regexp_full_match({x}, '[ \\t\\r\\f]+')"
    trimmed = "trim(body, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"
    framed = "chr(10) || body || chr(10)"

    def cut(body: str, pieces: str, is_blank: str) -> str:
        pair = f"{is_sign(x='x')} AND {is_blank.format(x='raw[i + 1]')} AND {is_sign(x='raw[i + 2]')}"
        kept = f"list_transform(raw, lambda x, i: CASE WHEN {pair} THEN x || ' ' ELSE x END)"
        return (
            f"list_filter((SELECT {kept} FROM (SELECT regexp_extract_all({body}, '{pieces}') AS raw)), "
            f"lambda x: NOT {is_blank.format(x='x')})"
        )

    plain = cut(trimmed, rf"{_PIECES}|[ \t\r\f\n]+|.", blank)
    breaking = cut(trimmed, rf"{_PIECES}|[ \t\r\f]+|\n|.", inner)
    python = cut(framed, rf"{_PIECES}|\n[ \t]*|[ \t\r\f]+|.", inner)
    markup = f"list_filter(regexp_extract_all({trimmed}, '{_PIECES}|[ \\t\\r\\f\\n]+|.'), lambda x: NOT {blank.format(x='x')})"
    soft = "({x} IN (chr(10), ';', '|'))"
    shell = (
        f"(SELECT list_transform(list_filter(raw, lambda x, i: NOT ({inner.format(x='x')} AND (coalesce({soft.format(x='raw[i - 1]')}, false) "
        f"OR coalesce({soft.format(x='raw[i + 1]')}, false)))), lambda x: CASE WHEN {inner.format(x='x')} THEN ' ' ELSE x END) "
        f"FROM (SELECT regexp_extract_all({framed}, '{_SHELL_PIECES}') AS raw))"
    )
    # Of consecutive line breaks the last counts.
    single = "list_filter(t, lambda x, i: NOT (starts_with(x, chr(10)) AND coalesce(starts_with(t[i + 1], chr(10)), false)))"
    return [
        (f"{name}_m", f"SELECT id, language, {_directives('marked')} AS body FROM {relation} WHERE language IS NOT NULL"),
        (
            f"{name}_t",
            f"SELECT id, language, CASE WHEN language = 'python' THEN {python} WHEN language = 'bash' THEN {shell} "
            f"WHEN language = 'html' THEN {markup} WHEN language IN ('go', 'typescript') THEN {breaking} ELSE {plain} END AS t FROM {name}_m",
        ),
        (f"{name}_k", f"SELECT id, language, CASE WHEN language IN ('python', 'bash', 'go', 'typescript') THEN {single} ELSE t END AS toks FROM {name}_t"),
        (
            f"{name}_p",
            f"SELECT id, language, sha256(language || {SEP} || '1' || "
            f"array_to_string(list_transform(toks, lambda x: {SEP} || x), '')) AS fingerprint FROM {name}_k",
        ),
    ]


MARKED = ("marked", k.sql_steps("documents", k.marked_steps(_prose_marks())))


def page_ctes(name: str, relation: str) -> list[tuple[str, str]]:
    """``name_k`` and ``name_p`` of given pages: raw texts between tags and attribute values are literals."""
    raw = "<(?:title|style|script)>(?s:.*?)</(?:title|style|script)"
    pieces = f"<!--(?s:.*?)-->|{raw}|=\"[^\"]*\"|{_NAME}|[0-9][a-zA-Z_.0-9]*|[^ \\t\\r\\n\\f]"
    body = "regexp_extract(x, '^<[a-z]+>((?s:.*))</[a-z]+$', 1)"
    expanded = (
        f"CASE WHEN regexp_matches(x, '^{raw}$') THEN list_concat(['<', regexp_extract(x, '^<([a-z]+)>', 1), '>'], "
        f"CASE WHEN {body} = '' THEN []::VARCHAR[] ELSE [{OPEN} || {body} || {CLOSE}] END, ['<', '/', regexp_extract(x, '</([a-z]+)$', 1)]) "
        f"WHEN starts_with(x, '=\"') THEN ['=', {OPEN} || substr(x, 2) || {CLOSE}] ELSE [x] END"
    )
    toks = f"flatten(list_transform(list_filter(regexp_extract_all(content, '{pieces}'), lambda x: NOT starts_with(x, '<!--')), lambda x: {expanded}))"
    return [
        (f"{name}_k", f"SELECT id, 'html' AS language, {toks} AS toks FROM {relation}"),
        (
            f"{name}_p",
            f"SELECT id, language, sha256(language || {SEP} || '1' || "
            f"array_to_string(list_transform(toks, lambda x: {SEP} || x), '')) AS fingerprint FROM {name}_k",
        ),
    ]
