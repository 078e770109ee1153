"""Scanners over code text that expressions cannot state: nested delimiters, tags and quotes.

Each walks the tokens of one linear pattern, never single characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from ..functions.strings import lines

# --- delimiters ---

_DELIMITER = re.compile(
    rb"""//[^\n]*|/\*(?:.*?\*/|.*)|r(\#*)"(?:.*?"\1|.*)|"(?:[^"\\]|\\.)*"?|`(?:[^`\\]|\\.)*`?|'[^\\]'|'\\.'|([{}\[\]()])""",
    re.S,
)
_PARTNER = {b"}": b"{", b"]": b"[", b")": b"("}


def balanced(code: str) -> bool:
    """Whether braces, brackets and parentheses outside of comments, strings and character literals pair up."""
    open_: list[bytes] = []
    for m in _DELIMITER.finditer(code.encode()):
        if mark := m[2]:
            if mark not in _PARTNER:
                open_.append(mark)
            elif not open_ or open_.pop() != _PARTNER[mark]:
                return False
    return not open_


# --- tags ---

_MARKUP = re.compile(
    r"""(?<!\\)(?P<quote>["'`])(?:.*?(?<!\\)(?P=quote)|.*)|//[^\n]*|/\*(?:.*?\*/|.*)|<!--(?:.*?-->|.*)
    |(?P<fragment></?>)|</(?P<close>[A-Za-z0-9_$.-]+)[^>]*>|<(?P<open>[A-Za-z_$][A-Za-z0-9_$.-]*)""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""(?<!\\)(?P<quote>["'`])(?:.*?(?<!\\)(?P=quote)|.*)|[{}]|/>|>""", re.S)
#: Tags without an end (fixed values).
_VOID = frozenset(("img", "input", "br", "hr", "meta", "link", "source"))


def _tag_end(code: str, at: int) -> tuple[int, bool]:
    """Where the opening tag whose attributes start here ends, and whether it closes itself."""
    depth = 0
    for m in _ATTRIBUTE.finditer(code, at):
        mark = m[0]
        if mark == "{":
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
        elif depth == 0 and mark in (">", "/>"):
            return m.end(), mark == "/>"
    return len(code), False


def tag_mismatch(code: str) -> str | None:
    """The first tag or fragment that has no partner, in words; None if all pair up."""
    open_: list[str] = []
    at = 0
    while m := _MARKUP.search(code, at):
        at = m.end()
        if m["open"] is not None:
            at, alone = _tag_end(code, at)
            if not alone and m["open"].lower() not in _VOID:
                open_.append(m["open"])
            continue
        name = m["close"] if m["close"] is not None else "" if m["fragment"] else None
        if name is None:
            continue
        if m["fragment"] == "<>":
            open_.append("")
        elif not open_:
            return f"Closing tag </{name}> closes nothing" if name else "Closing fragment </> closes nothing"
        elif (was := open_.pop()) != name:
            return f"Closing tag </{name}> meets open <{was}>" if name else f"Closing fragment </> meets open <{was}>"
    if open_:
        return f"Tag <{open_[-1]}> is never closed" if open_[-1] else "Fragment <> is never closed"
    return None


# --- unwraps ---

TEST_MARK = "#[cfg(test)]"
_RAW_MARK = re.compile(r'(?=(r\#")|("\#))')  # they may overlap
_UNWRAP = re.compile(r"\.(?:unwrap|expect)\s*\(")


def first_unguarded_unwrap(code: str) -> int | None:
    """The byte of the first unwrap or expect call that no guard on its line covers. Calls behind a test mark or inside a raw
    string do not count."""
    end = min((i for mark in (TEST_MARK, "#[test]") if (i := code.find(mark)) >= 0), default=len(code))
    raw = 0  # raw strings that begin, less those that end, before a place
    marks = _RAW_MARK.finditer(code)
    mark = next(marks, None)
    for m in _UNWRAP.finditer(code, 0):
        if m.start() < end:
            while mark and mark.start() + len(mark[1] or mark[2]) <= m.start():
                raw += 1 if mark[1] else -1
                mark = next(marks, None)
            before = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
            head = before.lstrip()
            if head.startswith(("//", "*", '"')) or any(x in before for x in ("LazyLock", "Regex::new", "is_some()", "is_ok()", "if let")):
                continue
            if raw <= 0:
                return len(code[: m.start()].encode())
    return None


# --- nested quantifiers ---

_QUOTE = re.compile("[\"'`]")
_CLOSER = re.compile(r"\)[+*]")


def _last_quote(code: str, start: int, end: int) -> int:
    return max(code.rfind(q, start, end) for q in "\"'`")


def _nested_from(code: str, start: int, end: int) -> int | None:
    """The end of the match whose opening quote is at start, on the line that ends at end; None if there is none.

    A group needs a repetition right before or (if it has no inner end) anywhere before its closing parenthesis, a
    repetition after it, and a quote later on the line where it closes.
    """
    # Same-line groups: the last closer after a repetition that a quote follows.
    last = None
    final = _last_quote(code, start + 1, end)
    for m in _CLOSER.finditer(code, start + 1, end):
        if m.end() <= final and code[m.start() - 1] in "+*":
            last = m.start()
    at = code.rfind("(", start + 1, end)
    while at >= 0:
        if last is not None and at <= last - 3:
            return final + 1
        close = code.find(")", at + 1)
        if close >= 0 and code[close + 1 : close + 2] in ("+", "*") and any(c in code[at + 1 : close] for c in "+*"):
            line_end = code.find("\n", close)
            line_end = len(code) if line_end < 0 else line_end
            quote = _last_quote(code, close + 2, line_end)
            if quote >= 0:
                return quote + 1
        at = code.rfind("(", start + 1, at)
    return None


def first_nested_quantifier(code: str) -> tuple[int, str] | None:
    """Byte and text (at most 60 bytes, whole characters) of the first quoted pattern with a repeated group that itself ends in or
    holds a repetition; comment lines do not count. Code from the test mark on is not read."""
    if (i := code.find(TEST_MARK)) >= 0:
        code = code[:i]
    if not _CLOSER.search(code):
        return None
    at = 0
    while quote := _QUOTE.search(code, at):
        line_end = code.find("\n", quote.start())
        line_end = len(code) if line_end < 0 else line_end
        end = _nested_from(code, quote.start(), line_end)
        if end is None:
            at = line_end  # a later quote of the line has less of it after it
            continue
        head = code[code.rfind("\n", 0, quote.start()) + 1 : quote.start()].lstrip()
        if not head.startswith(("//", "*")):
            return len(code[: quote.start()].encode()), code[quote.start() : end].encode()[:60].decode("utf-8", "ignore")
        at = end
    return None


# --- deep access ---

_DEEP_ACCESS = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$][a-zA-Z0-9_$]*\.[a-zA-Z_$][a-zA-Z0-9_$]*")
_OPTIONAL_CHAIN = re.compile(r"\?\.[a-zA-Z_$]")


def first_deep_access(code: str) -> tuple[int, str] | None:
    """Byte and text of the first access three names deep, in code that never chains optionally; environment access and comment lines do
    not count."""
    if _OPTIONAL_CHAIN.search(code):
        return None
    for m in _DEEP_ACCESS.finditer(code):
        head = code[code.rfind("\n", 0, m.start()) + 1 : m.start()].lstrip()
        if not m[0].startswith(("process.env", "import.meta")) and not head.startswith(("//", "*")):
            return len(code[: m.start()].encode()), m[0]
    return None


# --- spans of declarations ---

_STRUCTURE = re.compile(r"[\"'`\n(){};]")


def _structure(text: str, start: int) -> tuple[list[int], list[str], list[tuple[int, int]]]:
    """Places and kinds of parentheses, braces and semicolons outside of strings, from a line start on, and where strings in back
    quotes begin and end. Other quotes end at their line; a single quote that begins a lifetime begins no string."""
    at, kinds, strings = [], [], []
    quote, opened, end = "", 0, len(text)
    for m in _STRUCTURE.finditer(text, start):
        i, c = m.start(), m[0]
        if c == "\n":
            if quote != "`":
                quote = ""
        elif c not in "\"'`":
            if not quote:
                at.append(i)
                kinds.append(c)
        elif text[i - 1 : i] == "\\" and i > start:
            pass
        elif quote:
            if c == quote:
                if c == "`":
                    strings.append((opened, i))
                quote = ""
        elif c != "'" or not _lifetime(text, start, i):
            quote, opened = c, i
    if quote == "`":
        strings.append((opened, end))
    return at, kinds, strings


def _lifetime(text: str, start: int, i: int) -> bool:
    """Whether the single quote here begins a lifetime: it stands where a type may, and no character literal ends soon after."""
    if i == start or text[i - 1] not in "&<, (":
        return False
    plain = text[i + 2 : i + 3] == "'" and text[i + 1] != "\\"
    return not plain and not (text[i + 1 : i + 2] == "\\" and text[i + 3 : i + 4] == "'")


class _Run:
    """The structural tokens from a line start on, read with no string open there, and where spans that begin among them end.

    One pass over the tokens from last to first fills two tables: ``begins``, the first brace or semicolon outside of
    parentheses from a token on, and ``closes``, the first brace from a token on that closes one opened before it.
    """

    def __init__(self, text: str, start: int):
        self.start = start
        self.at, self.kinds, self.strings = _structure(text, start)
        n = len(self.at)
        behind = [n] * n  # behind the parenthesis that matches this one
        open_ones: list[int] = []
        for t, c in enumerate(self.kinds):
            if c == "(":
                open_ones.append(t)
            elif c == ")" and open_ones:
                behind[open_ones.pop()] = t + 1
        self.begins, self.closes = [n] * (n + 1), [n] * (n + 1)
        for t in range(n - 1, -1, -1):
            c = self.kinds[t]
            if c == "(":
                self.begins[t], self.closes[t] = self.begins[behind[t]], self.closes[behind[t]]
                continue
            self.begins[t] = t if c in "{;" else self.begins[t + 1]
            if c == "}":
                self.closes[t] = t
            elif c == "{":
                inner = self.closes[t + 1]
                self.closes[t] = self.closes[inner + 1] if inner < n else n
            else:
                self.closes[t] = self.closes[t + 1]


class Structure:
    """Where declarations of a text begin and end, each found without reading the text again.

    A declaration begins with no string open, whatever stands before it. Only back quotes keep a string open over lines, so a run
    serves all later line starts that it finds outside of strings; for one that it does not, there is another run.
    """

    def __init__(self, text: str):
        self.text = text
        self.runs: list[_Run] = []

    def _run(self, start: int) -> _Run:
        for run in self.runs:
            k = bisect_right(run.strings, (start, -1)) - 1
            if run.start <= start and (k < 0 or run.strings[k][1] < start):
                return run
        self.runs.append(_Run(self.text, start))
        return self.runs[-1]

    def closing(self, start: int) -> int:
        """Where a braced declaration that starts here ends: behind its matching brace, or behind a semicolon before any brace; else the
        end of the text. Braces and semicolons within parentheses do not count."""
        run = self._run(start)
        n = len(run.at)
        t = run.begins[bisect_left(run.at, start)]
        if t < n and run.kinds[t] == "{":
            t = run.closes[t + 1]
        return run.at[t] + 1 if t < n else len(self.text)

    def signature(self, start: int, end: int) -> int:
        """The first brace or semicolon outside of parentheses and strings; else the end."""
        run = self._run(start)
        t = run.begins[bisect_left(run.at, start)]
        return min(run.at[t], end) if t < len(run.at) else end


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


class Indents:
    """Where indented declarations of a text end. Each line looks for the first later one, not blank and no comment, that is
    indented no deeper; a stack of such lines from the end of the text on, ever more indented, answers all in one pass."""

    def __init__(self, text: str):
        self.size = len(text)
        own = lines(text)
        self.begins, self.sizes, before = [], [0], 0  # carriage returns before line feeds are in the places, not in the sizes
        for raw in text.split("\n")[: len(own)]:
            self.begins.append(before)
            before += len(raw) + 1
        self.lengths = [len(x) for x in own]
        for n in self.lengths:
            self.sizes.append(self.sizes[-1] + n + 1)
        self.next = [len(own)] * len(own)
        depths: list[int] = []
        places: list[int] = []
        for i in range(len(own) - 1, -1, -1):
            depth = _indent(own[i])
            if (k := bisect_right(depths, depth)) > 0:
                self.next[i] = places[k - 1]
            bare = own[i].lstrip()
            if bare and not bare.startswith("#"):
                while depths and depths[-1] >= depth:
                    depths.pop()
                    places.pop()
                depths.append(depth)
                places.append(i)

    def closing(self, start: int) -> int:
        """Where the declaration on the line that starts here ends: before that later line, else at the end of the text. A carriage
        return before a line feed is not counted."""
        i = bisect_left(self.begins, start)
        if i >= len(self.next) or self.next[i] == len(self.next):
            return self.size
        return start + self.lengths[i] + self.sizes[self.next[i]] - self.sizes[i + 1]
