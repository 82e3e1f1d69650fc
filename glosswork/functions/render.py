"""Text layouts: review headers, report lists, file trees, fix summaries, run budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosswork.functions.comments import LANG_DIRECTIVE
from glosswork.functions.text import is_blank, let, py_strip

# Sections of a review header, in order, and the rule that closes it.
TEXT_SECTIONS = ("Overview", "Review", "Design")
LIST_SECTIONS = ("Notes", "Issues", "Imperfections", "Impediments")
RULE = "----------"
# Seconds for start-up and for each KB of prompt.
BASE_SECONDS = 300
SECONDS_PER_KB = 60


def _lit(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _section(title: str, text: Column) -> Column:
    return F.when(
        F.coalesce(text, F.lit("")) != "",
        F.concat(F.lit(f"{RULE} [{title}]\n"), text, F.lit("\n")),
    ).otherwise("")


def render_review(payload: Column, ai: Column | str, ts: Column | str, lang: Column | str) -> Column:
    """Review header of a file; empty sections and blank list items are left out."""

    def listed(title: str) -> Column:
        items = F.filter(payload[title.lower()], lambda s: s.isNotNull() & ~is_blank(s))
        return let(py_strip(F.array_join(items, "\n")), lambda text: _section(title, text))

    return F.concat(
        F.lit(f"{RULE} Reviewed by: "), _lit(ai), F.lit(" @ "), _lit(ts),
        F.lit(f"\n{LANG_DIRECTIVE} "), _lit(lang), F.lit("\n"),
        *[_section(title, payload[title.lower()]) for title in TEXT_SECTIONS],
        *[listed(title) for title in LIST_SECTIONS],
        F.lit(f"{RULE}\n"),
    )


def md_list(items: Column, title: str) -> Column:
    """Markdown list under a heading; empty for no items."""
    body = F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.when(
        F.size(F.coalesce(items, F.array().cast("array<string>"))) > 0,
        F.concat(F.lit(f"\n# {title}:\n"), body, F.lit("\n")),
    ).otherwise("")


def tree_lines(entries: Column, mark: str, closes: Column | bool) -> Column:
    """Tree lines of one array; ``closes`` tells whether its last entry ends the tree."""
    closes = closes if isinstance(closes, Column) else F.lit(closes)
    branch = lambda last: F.when(last, "└──").otherwise("├──")
    return F.array_join(
        F.transform(
            entries,
            lambda x, i: F.concat(
                F.lit("    "), branch(closes & (i == F.size(entries) - 1)),
                F.lit(f"{mark} "), x, F.lit("\n"),
            ),
        ),
        "",
    )


def file_tree(files: Column, subs: Column) -> Column:
    """Files first, then sub-modules with a longer branch."""
    return F.concat(
        tree_lines(files, "", F.size(subs) == 0), tree_lines(subs, "──", True)
    )


def fix_summary(overview: Column, review: Column) -> Column:
    """What one fix pass adds to the context of the next."""

    def block(title: str, text: Column) -> Column:
        return F.when(
            F.coalesce(text, F.lit("")) != "",
            F.concat(F.lit(f"[{title}]\n"), text, F.lit("\n")),
        ).otherwise("")

    return F.concat(block("Bug fix", overview), block("Discussion", review))


def run_budget(system_prompt: Column, user_prompt: Column, timeout: Column | int = 0) -> Column:
    """Seconds allowed for a run: a base plus a rate per KB, or the given positive timeout."""
    return run_seconds(F.length(system_prompt) + F.length(user_prompt), timeout)


def run_seconds(chars: Column, timeout: Column | int = 0) -> Column:
    """The same from the number of characters of both prompts."""
    timeout = timeout if isinstance(timeout, Column) else F.lit(timeout)
    kb = F.shiftright(chars, 10)
    rate = F.when(timeout == 0, SECONDS_PER_KB).otherwise(-timeout)
    return F.when(timeout > 0, timeout).otherwise(rate * kb + BASE_SECONDS)


def attempt_text(attempt: Column, err: Column, output: Column) -> Column:
    """Log entry of one failed attempt."""
    block = F.when(
        output.isNotNull(), F.concat(F.lit("<<<\n"), output, F.lit("\n>>>\n"))
    ).otherwise("")
    return F.concat(F.lit("#"), attempt.cast("string"), F.lit(": "), err, F.lit("\n"), block)
