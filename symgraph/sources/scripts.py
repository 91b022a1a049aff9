"""Call sites of JavaScript and TypeScript, by a lexer and the nesting of brackets; no grammar is installed.

A site is a name, or the last name of a chain of members, in front of an argument list (after type arguments, a `!` or
`?.` at will) or of a constructor's. Declarations, methods in bodies of classes and interfaces, and keywords aren't sites.
A file whose strings or brackets don't close has none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import language_of
from .texts import _per_text

_WORDS = frozenset("if for while switch catch function import return typeof instanceof in of new delete void await yield case do else throw import super class extends export default with async get set static".split())
_TOKEN = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\?\.|\.\.\.|[^\s])",
    re.S,
)
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, offset); templates yield the tokens of their holes between brackets of their own."""
    at, last, holes = 0, "", []
    while at < len(text):
        c = text[at]
        if c == "`" or (c == "}" and holes and holes[-1] == 0):
            if c == "}":
                holes.pop()
                yield "mark", "}", at
            at += 1
            while True:
                if at >= len(text):
                    raise ValueError("a template doesn't close")
                if text[at] == "\\":
                    at += 2
                elif text[at] == "`":
                    at += 1
                    break
                elif text.startswith("${", at):
                    holes.append(0)
                    yield "mark", "{", at + 1
                    at += 2
                    break
                else:
                    at += 1
            last = "`" if not holes or holes[-1] else "{"
            continue
        if c == "/" and text[at : at + 2] not in ("//", "/*") and (last in "(,=:[!&|?{};+-*%<>~^" or last in _WORDS):
            body = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(text, at)
            if not body:
                raise ValueError("a pattern doesn't close")
            at, last = body.end(), "/r"
            continue
        m = _TOKEN.match(text, at)
        if m.lastgroup == "mark" and m[0] in "\"'":
            raise ValueError("a string doesn't close")
        if m.lastgroup != "space":
            if holes and m[0] in "{}":
                holes[-1] += 1 if m[0] == "{" else -1
            yield m.lastgroup, m[0], at
            last = m[0]
        at = m.end()
    if holes:
        raise ValueError("a template doesn't close")


def call_sites(text: str) -> list[tuple[int, int, str]]:
    """(line from 1, UTF-16 column, name)."""
    toks = list(_tokens(text))
    close, stack, bodies, body = {}, [], {}, None
    for i, (kind, t, _) in enumerate(toks):
        if kind != "mark":
            if t in ("class", "interface") and (not i or toks[i - 1][1] not in (".", "?.")):
                body = len(stack)
            continue
        if t in "([{":
            if t == "{" and body == len(stack):
                bodies[i], body = True, None
            stack.append((t, i))
        elif t in _PAIRS:
            if not stack or stack[-1][0] != _PAIRS[t]:
                raise ValueError("brackets don't match")
            close[stack.pop()[1]] = i
    if stack:
        raise ValueError("brackets don't match")
    within: list[bool] = []
    open_: list[int] = []
    for i, (_, t, _) in enumerate(toks):
        if open_ and close[open_[-1]] == i:
            open_.pop()
        within.append(bool(open_) and open_[-1] in bodies)
        if i in close:
            open_.append(i)
    opens = {b: a for a, b in close.items()}
    word = lambda i: toks[i][1] if 0 <= i < len(toks) else ""

    def arguments(i: int) -> int | None:
        """Where the argument list of a name that ends at i opens, past type arguments."""
        j = i + 1
        if word(j) == "!":
            j += 1
        if word(j) == "?." and word(j + 1) in ("(", "<"):
            j += 1
        if word(j) == "<":
            depth, k = 0, j
            while k < len(toks) and k - j < 200:
                t = word(k)
                if t in "(){};=" and t:
                    return None
                depth += {"<": 1, ">": -1}.get(t, 0)
                k += 1
                if not depth:
                    break
            j = k
        return j if word(j) == "(" else None

    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    from bisect import bisect_right

    out = []
    for i, (kind, t, at) in enumerate(toks):
        if kind != "name" or (t in _WORDS and word(i - 1) not in (".", "?.")):
            continue
        member = word(i - 1) in (".", "?.")
        j = arguments(i)
        if j is None and word(i + 1) == ")" and i + 1 in opens and word(i + 2) == "(":
            # a callee in parentheses: nothing but a chain of names
            k = opens[i + 1] + 1
            if all(toks[x][0] == "name" or word(x) in (".", "?.") for x in range(k, i)) and (not word(k - 2) or toks[k - 2][0] != "name" or word(k - 2) in ("await", "return", "new", "void")):
                j = i + 2
        if j is None:
            # a constructor needs no list
            first = i
            while word(first - 1) in (".", "?."):
                first -= 2
            if word(first - 1) != "new" or word(i + 1) in (".", "?.", "["):
                continue
        elif not member:
            if word(i - 1) in ("function", "*") and "function" in (word(i - 1), word(i - 2)) or within[i] and word(i - 1) not in ("=", "=>"):
                continue
            if word(close[j] + 1) == "{" and word(i - 1) != "new":
                continue  # a method of an object
        line = bisect_right(starts, at) - 1
        out.append((line + 1, len(text[starts[line] : at].encode("utf-16-le")) // 2, t))
    return sorted(set(out))


def script_calls(files: DataFrame) -> DataFrame:
    """(rel_path, line, col, name) of call sites of JavaScript and TypeScript files (rel, text); others have none."""
    scripts = files.filter(F.coalesce(language_of("rel").isin("JavaScript", "TypeScript"), F.lit(False)))
    return _per_text(scripts, call_sites, "rel_path string, line long, col long, name string")
