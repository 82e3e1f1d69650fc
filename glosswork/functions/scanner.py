"""Comments and literals of source texts, found by a scanner that keeps state.

What opens a comment or a literal depends on what stands before it: a slash divides or opens
a pattern, a quote may stand in a nested template, a line may belong to a here-document. The
scanner steps from one such place to the next, drops comments, marks literals, and says
where a text can be read in more than one way. All else is left to the token patterns of ``lexer``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Private-use characters: token separator, around literals, and the prefix under which a
# source's own private-use characters are kept apart from these.
SEPARATOR, OPEN, CLOSE, SHIFT = "\ue000", "\ue001", "\ue002", "\ue003"
_SHIFTED = {ord(c): SHIFT + chr(ord(c) + 0x10) for c in (SEPARATOR, OPEN, CLOSE, SHIFT)}
_RESERVED = re.compile(f"[{SEPARATOR}-{SHIFT}]")

# Words of the languages after which a slash opens a pattern or a brace an object, and
# those before the condition in round brackets.
OPERATOR_WORDS = frozenset(
    "return typeof case in of delete void throw new instanceof do else yield await default".split()
)
CONDITION_WORDS = frozenset(("if", "while", "for", "with"))
RAW_TAGS = frozenset(("script", "style", "textarea", "title"))

# Strings whose escapes are skipped in pairs, so that each is one linear scan.
_DOUBLE = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SINGLE = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_DOUBLE_LINES = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"'
_DOLLAR_SINGLE = r"\$'[^'\\]*(?:\\[\s\S][^'\\]*)*'"
_TRIPLE = r'"""[^"\\]*(?:(?:\\[\s\S]|"(?!""))[^"\\]*)*"""'
_TRIPLE_SINGLE = r"'''[^'\\]*(?:(?:\\[\s\S]|'(?!''))[^'\\]*)*'''"
_VERBATIM = r'(?:\$@|@\$|@)"[^"]*(?:""[^"]*)*"'
_LINE_COMMENT = r"//[^\n]*"
_JOINED_LINE_COMMENT = r"//[^\n\\]*(?:\\[\s\S][^\n\\]*)*"
_CPP_NUMBER = r"(?<![A-Za-z0-9_])[0-9](?:'?[0-9A-Za-z_.])*"
_CPP_RAW = r'(?<![A-Za-z0-9_])(?:u8|[uUL])?R"(?P<fence>[^\s()\\"]{0,16})\('
_INCLUDE = r"^[ \t]*\#[ \t]*include[ \t]*<[^>\n]*>"
_RUST_RAW = r'(?<![A-Za-z0-9_])(?:b|c)?r(?P<hashes>\#*)"'
_RUST_CHAR = r"'(?:\\[^\n][^'\n]*|[^\\'\n])'"
_PATTERN = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*(?P<end>`|\$\{)")


def _stops(**groups: str) -> re.Pattern:
    """One pattern of named alternatives, the first that fits counting."""
    return re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in groups.items()), re.MULTILINE)


# A backslash outside of literals takes the next character with it.
_ODD = r"\\."
_C = {
    "include": _INCLUDE, "directive": r"^[ \t]*\#", "joined": r"\\\r?\n", "drop": _JOINED_LINE_COMMENT, "block": r"/\*",
    "raw": _CPP_RAW, "whole": f"{_DOUBLE}|{_SINGLE}", "skip": _CPP_NUMBER, "odd": _ODD, "stray": r"[\"']",
}
STOPS: dict[str, re.Pattern] = {
    "c": _stops(**{k: p for k, p in _C.items() if k != "raw"}),
    "cpp": _stops(**_C),
    "java": _stops(odd=_ODD, drop=_LINE_COMMENT, block=r"/\*", whole=f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}", stray=r"[\"']"),
    "c_sharp": _stops(
        odd=_ODD, directive=r"^[ \t]*\#", drop=_LINE_COMMENT, block=r"/\*", quotes=r'\$*(?P<fence>"{3,})', whole=f"{_VERBATIM}|\\$?{_DOUBLE}|{_SINGLE}",
        stray=r"[\"']",
    ),
    "go": _stops(odd=_ODD, drop=_LINE_COMMENT, block=r"/\*", whole=f"{_DOUBLE}|{_SINGLE}|`[^`]*`", stray=r"[\"'`]"),
    "rust": _stops(
        odd=_ODD, drop=_LINE_COMMENT, nested=r"/\*", hashed=_RUST_RAW, whole=f"{_DOUBLE_LINES}|{_RUST_CHAR}", lifetime=r"'[A-Za-z_]\w*", stray=r"[\"']"
    ),
    "typescript": _stops(
        odd=_ODD, whole=rf"\A\#![^\n]*|{_DOUBLE}|{_SINGLE}", drop=_LINE_COMMENT, block=r"/\*", template="`", bracket=r"[(){}]", slash="/", stray=r"[\"']"
    ),
    "python": _stops(
        drop=r"\#[^\n]*", quoted=r"(?:(?<!\w)[rRbBuUfFtT]{1,2})?(?P<quote>\"\"\"|'''|[\"'])", joined=r"\\\r?\n", odd=_ODD, bracket=r"[()\[\]{}]", line=r"\n"
    ),
    "bash": _stops(
        joined=r"\\\r?\n", escaped=r"\\[\s\S]", drop=r"(?<![^\s;&|()<>])(?<!\\\n)\#[^\n]*", whole=rf"{_DOLLAR_SINGLE}|'[^']*'", quoted='"',
        here=r"<<(?!<)(?<!<<<)(?P<tabs>-?)[ \t]*(?P<word>(?:\\?[^\s;&|()<>'\"\\`$]|'[^'\n]+'|\"[^\"\n]+\")+)", line=r"\n", stray="'",
    ),
    "html": _stops(comment="<!--", tag=r"<[A-Za-z][^\s/>]*", cdata=r"<!\[CDATA\["),
}
_NESTED = re.compile(r"/\*|\*/")
_VALUE = re.compile(r"=[ \t\r\n\f]*(\"[^\"]*\"|'[^']*')|>")
_PYTHON_REST = {
    '"""': re.compile(_TRIPLE[3:]), "'''": re.compile(_TRIPLE_SINGLE[3:]), '"': re.compile(_DOUBLE[1:]), "'": re.compile(_SINGLE[1:])
}
_SHELL_QUOTED = re.compile(r"\\[\s\S]|\$\(|[\"'()`]|(?<=\s)\#")
_LAST_WORD = re.compile(r"(?<![\w$.])[\w$]+\Z")


class Scan:
    """One text on its way: `pieces` made so far, `copied` characters of it, and whether it is `sure`."""

    def __init__(self, text: str):
        self.text, self.pieces, self.copied, self.sure = text, [], 0, True
        self.dead: set[str] = set()  # closings that the rest of the text does not hold

    def put(self, start: int, end: int, instead: str) -> int:
        """Put `instead` in place of a part of the text."""
        self.pieces += (self.text[self.copied : start], instead)
        self.copied = end
        return end

    def literal(self, start: int, end: int) -> int:
        return self.put(start, end, f"{OPEN}{self.text[start:end]}{CLOSE}")

    def drop(self, start: int, end: int) -> int:
        """A comment counts as the line break that it spans, or as a blank."""
        return self.put(start, end, "\n" if "\n" in self.text[start:end] else " ")

    def unsure(self, go_on: int) -> int:
        self.sure = False
        return go_on

    def closing(self, mark: str, start: int) -> int:
        """End of the next `mark`; -1, without another search, where the rest of the text has none."""
        if mark in self.dead:
            return -1
        at = self.text.find(mark, start)
        if at < 0:
            self.dead.add(mark)
            return -1
        return at + len(mark)

    def until(self, mark: str, m: re.Match, take: Callable[[int, int], int], start: int | None = None) -> int:
        """Take all up to the end of `mark`; where there is none, the opening is code and the text unsure."""
        end = self.closing(mark, m.end() if start is None else start)
        return self.unsure(m.end()) if end < 0 else take(m.start(), end)

    def result(self) -> tuple[str, bool]:
        return "".join(self.pieces) + self.text[self.copied :], self.sure


def _balanced(literal: str) -> bool:
    return literal.count("{") == literal.count("}")


def _common(s: Scan, kind: str, m: re.Match) -> int:
    """What the languages with slash comments share."""
    if kind == "drop":
        return s.drop(m.start(), m.end())
    if kind == "block":
        return s.until("*/", m, s.drop)
    if kind in ("whole", "include"):
        if m.group().startswith("$") and not _balanced(m.group()):
            s.sure = False  # a string inside braces inside a string
        return s.literal(m.start(), m.end())
    if kind == "joined":
        return s.put(m.start(), m.end(), "")
    if kind == "raw":
        return s.until(f"){m['fence']}\"", m, s.literal)
    if kind == "quotes":
        return s.until(m["fence"], m, s.literal)
    if kind == "hashed":
        return s.until(f'"{m["hashes"]}', m, s.literal)
    if kind == "stray" or (kind == "odd" and m.group()[1] in "\"'`"):
        return s.unsure(m.end())
    return m.end()


def _scan_plain(s: Scan, stops: re.Pattern) -> None:
    """Languages whose comments and literals need no more than their openings; directives end with their line."""
    at, directive = 0, False
    while m := stops.search(s.text, at):
        if directive and "\n" in s.text[at : m.start()]:
            directive = _end_line(s, s.text.index("\n", at))
        kind = m.lastgroup
        directive = directive or kind in ("directive", "include")
        at = _nested(s, m) if kind == "nested" else _common(s, kind, m)
    if directive and "\n" in s.text[at:]:
        _end_line(s, s.text.index("\n", at))
    elif directive:
        s.put(len(s.text), len(s.text), f"{OPEN}\n{CLOSE}")


def _end_line(s: Scan, at: int) -> bool:
    s.put(at, at + 1, f"{OPEN}\n{CLOSE}")
    return False


def _nested(s: Scan, m: re.Match) -> int:
    """A comment that holds comments."""
    if "*/" in s.dead:
        return s.unsure(m.end())
    depth = 1
    for mark in _NESTED.finditer(s.text, m.end()):
        depth += 1 if mark.group() == "/*" else -1
        if not depth:
            return s.drop(m.start(), mark.end())
    s.dead.add("*/")
    return s.unsure(m.end())


def _scan_script(s: Scan, stops: re.Pattern) -> None:
    """Templates nest code, and a slash divides or opens a pattern by what stands before it."""
    text, at, last = s.text, 0, ""
    open_marks: list[str] = []  # for each open bracket: (, if( for a condition, { of a block, ={ of an object, ${ of a template

    def template(start: int, begin: int) -> int:
        m = _TEMPLATE.match(text, begin) if "`" not in s.dead else None
        if m is None:
            s.dead.add("`")
            return s.unsure(begin)
        if m["end"] == "${":
            open_marks.append("${")
        return s.literal(start, m.end())

    while m := stops.search(text, at):
        kind, code = m.lastgroup, text[at : m.start()].rstrip()
        last = code[-64:] or last  # what stands before, comments left aside; ")", "if)", "}" and so on for what was handled
        end = m.end()
        word = w.group() if (w := _LAST_WORD.search(last)) else ""
        if kind == "drop":
            at = s.drop(m.start(), end)
            continue
        if kind == "block":
            at = s.until("*/", m, s.drop)
            continue
        if kind == "whole":
            at, last = s.literal(m.start(), end), "]"
        elif kind == "odd":
            at, last = _common(s, kind, m), "]"
        elif kind == "template":
            at = template(m.start(), end)
            last = "(" if open_marks[-1:] == ["${"] and text[at - 2 : at] == "${" else "]"
        elif kind == "bracket":
            at, mark = end, m.group()
            if mark == "(":
                open_marks.append("if(" if word in CONDITION_WORDS else "(")
                last = "("
            elif mark == "{":
                value = word in OPERATOR_WORDS - {"do", "else"} or (last and last[-1] in "=([,:?&|+-*!~^%" and not last.endswith("=>"))
                open_marks.append("={" if value else "{")
                last = "{"
            else:
                opened = open_marks.pop() if open_marks else ""
                if opened == "${" and mark == "}":
                    at = template(m.start(), end)
                    last = "(" if text[at - 2 : at] == "${" else "]"
                elif opened.endswith("(" if mark == ")" else "{") and opened != "${":
                    last = {"(": "]", "if(": "if)", "={": "]", "{": "block}"}[opened]
                else:
                    at, last = s.unsure(end), "]"
        elif kind == "slash":
            before = last[-1:]
            opens = not before or before in "([{,;:=!&|?+-*%^~>" and not last.endswith(("++", "--")) or word in OPERATOR_WORDS
            if last == "block}":
                s.sure, opens = False, True  # a block or an object
            if last == "if)":
                opens = True
            if before == "<":
                s.sure = False  # a tag between code
            pattern = _PATTERN.match(text, m.start()) if opens else None
            if opens and pattern is None:
                s.sure = False
            at = s.literal(m.start(), pattern.end()) if pattern else end
            last = "]" if pattern else "/"
        else:
            at, last = s.unsure(end), "]"
    if open_marks:
        s.sure = False


def _scan_python(s: Scan, stops: re.Pattern) -> None:
    """Line breaks inside brackets and after a backslash are blanks."""
    at, depth = 0, 0
    while m := stops.search(s.text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "drop":
            s.put(m.start(), at, "")
        elif kind == "joined":
            s.put(m.start(), at, " ")
        elif kind == "odd":
            s.sure &= m.group()[1] not in "\"'"
        elif kind == "line":
            if depth:
                s.put(m.start(), at, " ")
        elif kind == "bracket":
            depth += 1 if m.group() in "([{" else -1
            if depth < 0:
                depth, s.sure = 0, False
        else:
            quote = m["quote"]
            rest = None if len(quote) == 3 and quote in s.dead else _PYTHON_REST[quote].match(s.text, at)
            if rest is None:
                s.sure = False
                s.dead |= {quote} if len(quote) == 3 else set()
                continue
            if m.group()[0] in "fFtT" or m.group()[1:2] in ("f", "F", "t", "T"):
                s.sure &= _balanced(rest.group())  # a string inside braces inside a string
            at = s.literal(m.start(), rest.end())
    s.sure &= depth == 0


def _shell_quoted(s: Scan, start: int) -> int:
    """End of a text in double quotes, which may hold commands that hold texts; -1 without end."""
    inside = ['"']
    at = start + 1
    while m := _SHELL_QUOTED.search(s.text, at):
        mark, at, quoted = m.group(), m.end(), inside[-1] == '"'
        if mark == '"':
            if quoted:
                inside.pop()
                if not inside:
                    return at
            else:
                inside.append('"')
        elif mark == "$(":
            inside.append("(")
        elif mark == "`":
            s.sure = False
        elif not quoted and mark == "'":
            at = s.text.find("'", at) + 1 or len(s.text)
        elif not quoted and mark == "(":
            inside.append("(")
        elif not quoted and mark == ")":
            inside.pop()
        elif not quoted and mark == "#":
            s.sure = False  # a comment inside a command inside a text
    return -1


def _scan_shell(s: Scan, stops: re.Pattern) -> None:
    """Here-documents are literals; a hash opens a comment only where a word begins."""
    at = 0
    waiting: list[tuple[bool, str]] = []  # here-documents of this line: whether tabs are cut, last line
    while m := stops.search(s.text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "drop":
            s.put(m.start(), at, "")
        elif kind == "joined":
            s.put(m.start(), at, "")
        elif kind in ("escaped", "whole"):
            s.literal(m.start(), at)
        elif kind == "here":
            waiting.append((m["tabs"] == "-", re.sub(r"[\\'\"]", "", m["word"])))
        elif kind == "quoted":
            end = -1 if '"' in s.dead else _shell_quoted(s, m.start())
            if end < 0:
                s.dead.add('"')
                s.sure = False
            else:
                at = s.literal(m.start(), end)
        elif kind == "stray":
            s.sure = False
        else:
            for tabs, word in waiting:
                last = re.compile(rf"^{'\t*' if tabs else ''}{re.escape(word)}$", re.MULTILINE).search(s.text, at) if word not in s.dead else None
                if last is None:
                    s.dead.add(word)
                    s.sure = False
                else:
                    at = s.literal(at, last.end())
            waiting = []
    if waiting:
        s.sure = False


def _scan_markup(s: Scan, stops: re.Pattern) -> None:
    """Comments between tags; values of attributes and the texts of scripts and the like are literals."""
    at = 0
    while m := stops.search(s.text, at):
        if m.lastgroup == "comment":
            at = s.until("-->", m, s.drop, m.start() + 2)
        elif m.lastgroup == "cdata":
            at = s.unsure(m.end())
        else:
            at, value = m.end(), None
            while ">" not in s.dead and (value := _VALUE.search(s.text, at)) and value.group() != ">":
                at = s.literal(value.start(1), value.end(1))
            if value is None:
                s.dead.add(">")
                s.sure = False
                continue
            at = value.end()
            name = m.group()[1:].lower()
            if name in RAW_TAGS:
                end = re.compile(rf"</{name}", re.IGNORECASE).search(s.text, at) if name not in s.dead else None
                if end is None:
                    s.dead.add(name)
                    s.sure = False
                elif end.start() > at:
                    at = s.literal(at, end.start())


_SCANNERS = {"typescript": _scan_script, "python": _scan_python, "bash": _scan_shell, "html": _scan_markup}


def scan(text: str, language: str) -> tuple[str, bool]:
    """The text without comments and with marked literals, and whether it can be read in one way only."""
    if _RESERVED.search(text):
        text = text.translate(_SHIFTED)
    state = Scan(text)
    _SCANNERS.get(language, _scan_plain)(state, STOPS[language])
    return state.result()
