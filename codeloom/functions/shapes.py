"""Tokens of a source with its brackets paired, and over them the shapes of expressions and the extents of loops.

An expression is a name, a literal or a bracketed group, followed by members, calls and subscripts, over as many lines as it takes.
Its shape is what a pattern is held against: names and connectors as they stand, groups as the number of what they
hold, `Path(1).exists(0)`, `new RegExp(2)`, `os.environ[1]`, `["].sort(0)`. Both are rows for Spark: which pattern fits where, and which loop a
site lies in, are joins and windows over them.
"""

from __future__ import annotations

import re

from codeloom.functions import masks

_TOKEN = re.compile(r"[$@]?[^\W\d][\w$]*|\d[\w.]*|([\"'`])\s*\1|\?->|\?\.|===|!==|==|!=|<=|>=|=>|->|::|&&|\|\||\.\.\.?|[-+*/%&|^.]=|\S")
_NAME = re.compile(r"[$@]?[^\W\d]")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_LINKS = frozenset((".", "->", "::", "?.", "?->"))
#: Words that begin no expression.
_WORDS = frozenset("if elif else elseif for foreach while until unless return in of not and or is as await async yield throw raise case match when typeof void delete let const var mut ref move do then del lambda import from use pub where".split())
_DEFINES = frozenset("function fn def class struct enum trait interface module namespace impl type fun".split())
_LITERALS = frozenset("true false null True False None".split())


class Tokens:
    """text, start, end and line of each token; pair: place of the other bracket; holds: how many parts a group has."""

    def __init__(self, text: str, language: str):
        code = masks.mask(text, language)
        self.text, self.language = text, language
        self.token, self.start, self.end, self.line, self.pair, self.holds = [], [], [], [], {}, {}
        line, at, stack = 1, 0, []
        for m in _TOKEN.finditer(code):
            line += code.count("\n", at, m.start())
            at = m.start()
            t = m[1] if m[1] else m[0]
            if language == "Ruby" and t in "?!" and self.end and self.end[-1] == m.start() and code[m.end() : m.end() + 1] == "(" and _NAME.match(self.token[-1]):
                self.token[-1] += t
                self.end[-1] = m.end()
                continue
            n = len(self.token)
            if t == "," and stack:
                stack[-1][1] += stack[-1][2]
                stack[-1][2] = 0
            elif t in _PAIRS:
                while stack and self.token[stack[-1][0]] != _PAIRS[t] and any(self.token[x[0]] == _PAIRS[t] for x in stack):
                    stack.pop()  # left open within
                if stack and self.token[stack[-1][0]] == _PAIRS[t]:
                    o, parts, some = stack.pop()
                    self.pair[o], self.pair[n], self.holds[o] = n, o, parts + some
            elif stack:
                stack[-1][2] = 1
            if t in "([{" and t:
                if stack:
                    stack[-1][2] = 1
                stack.append([n, 0, 0])
            self.token.append(t)
            self.start.append(m.start())
            self.end.append(m.end())
            self.line.append(line)

    def at(self, i: int) -> str:
        return self.token[i] if 0 <= i < len(self.token) else ""

    def skip(self, i: int) -> int:
        """The place after token i, or after the group that it opens."""
        return self.pair.get(i, i) + 1 if self.at(i) in ("(", "[", "{") else i + 1

    def parts(self, i: int, mark: str) -> list[list[str]]:
        """Tokens of the group at i, without nested groups' contents, split at mark."""
        out, j = [[]], i + 1
        while j < self.pair[i]:
            if self.at(j) == mark:
                out.append([])
            else:
                out[-1].append(self.at(j))
            j = self.skip(j)
        return out


def _begins(t: Tokens, i: int) -> bool:
    """Whether token i can begin an expression."""
    x, before = t.at(i), t.at(i - 1)
    if before in _LINKS or before == "\\" or before in _DEFINES:
        return False
    if _NAME.match(x):
        return x not in _WORDS and before != "new"
    if x in ("(", "["):
        called = bool(before) and ((before in (")", "]") or (_NAME.match(before) and before not in _WORDS) or before in "\"'`") and (x == "(" and t.language not in ("Ruby", "Python") or t.end[i - 1] == t.start[i]) or before == ">" and t.end[i - 1] == t.start[i])
        return i in t.pair and not called and not (before == "!" and t.language == "Rust")
    return x in ('"', "'", "`")


def _chain(t: Tokens, i: int) -> list[tuple[int, str, str, bool]]:
    """The expression at i, as each of its beginnings that ends in a member, call, subscript or assignment: (last token, key, shape, whether on a bounded list)."""
    out, j, x = [], i, t.at(i)
    if x == "new":
        shape, j = "new " + t.at(i + 1), i + 2
        last, plain = t.at(i + 1), False
    elif x in ("(", "["):
        shape, last, j, plain = f"{x}{t.holds[i]}{t.at(t.pair[i])}", "", t.pair[i] + 1, False
    else:
        shape, last, j, plain = x, x, i + 1, bool(_NAME.match(x))
    bounded = x == "[" and i in t.pair and all(y in _LITERALS or y in "\"'`," or y[0].isdigit() for y in t.token[i + 1 : t.pair[i]])
    steps = 0
    while True:
        x = t.at(j)
        if x == "::" and t.at(j + 1) == "<":  # type arguments
            depth, k = 0, j + 1
            while k < len(t.token) and k < j + 200:
                depth += (t.at(k) == "<") - (t.at(k) == ">")
                k += 1
                if not depth:
                    break
            j = k
        elif x in _LINKS and _NAME.match(t.at(j + 1)):
            if plain:
                out.append((j + 1, f"{last}.*", shape + x + t.at(j + 1), False))
            shape, last, j, steps = shape + x + t.at(j + 1), t.at(j + 1), j + 2, steps + 1
        elif x == "!" and t.language == "Rust" and t.at(j + 1) in ("(", "[", "{") and j + 1 in t.pair:
            shape, j = f"{shape}!", j + 1
        elif x == "!" and t.language == "TypeScript" and t.at(j + 1) in _LINKS:
            j += 1
        elif x == "?" and t.language == "Rust":
            shape, j = f"{shape}?", j + 1
        elif (x == "(" and (t.language not in ("Ruby", "Python") or t.end[j - 1] == t.start[j]) or x == "[" and t.end[j - 1] == t.start[j] or x == "{" and shape.endswith("!")) and j in t.pair:
            shape, plain = f"{shape}{x}{t.holds[j]}{t.at(t.pair[j])}", False
            j = t.pair[j] + 1
            out.append((j - 1, last, shape, bounded and steps == 1))
        else:
            break
    if t.at(j) == "=" and steps:
        k = j + 1
        while k < len(t.token) and t.at(k) not in (";", ")", "]", "}", ",") and not (k > j + 1 and t.line[k] > t.line[k - 1] and t.at(k) not in _LINKS):
            k = t.skip(k)
        out.append((min(k, len(t.token)) - 1, f"{last}=", f"{shape}=", False))
    return out


def sites(t: Tokens, keys: frozenset[str]) -> list[tuple[int, int, int, str, str, int | None]]:
    """(start, end, line, key, shape, items of the bounded list that it is a call on) of all expressions with one of the keys."""
    out = []
    for i in range(len(t.token)):
        if _begins(t, i):
            out += [(t.start[i], t.end[last], t.line[i], key, shape, t.token[i + 1 : t.pair[i]].count(",") + 1 if bounded else None) for last, key, shape, bounded in _chain(t, i) if key in keys]
    return out


def _brace_loop(t: Tokens, i: int) -> int | None:
    """Last token of the loop at i in a language of braces; None if it isn't of a form with a header and a block."""
    word, j = t.at(i), i + 1
    if t.language == "Rust":
        found = word == "while"
        while j < len(t.token) and t.at(j) not in ("{", ";", "}"):
            found |= t.at(j) == "in"
            j = t.skip(j)
        return t.pair.get(j) if found and word != "foreach" and j > i + 1 and t.at(j) == "{" else None
    if t.at(j) == "await":
        j += 1
    if t.at(j) != "(" or j not in t.pair or t.at(t.pair[j] + 1) != "{":
        return None
    head = t.parts(j, ";")
    if word == "while":
        fit = bool(head[0])
    elif word == "foreach":
        fit = "as" in head[0]
    elif len(head) == 3:
        fit = bool(head[2]) and (t.language != "Php" or all(head))
    else:
        fit = t.language != "Php" and head[0][:1] in (["const"], ["let"]) and ("of" in head[0] or "in" in head[0])
    return t.pair.get(t.pair[j] + 1) if fit else None


def indented(t: Tokens, words: tuple[str, ...]) -> list[tuple[int, int]]:
    """Python's blocks that begin with one of the words (also after `async`): the first token, and where the last one ends."""
    out, stack, depth, n = [], [], 0, len(t.token)
    for i in range(n):
        if not depth and (not i or t.line[i] > t.line[i - 1] and t.at(i - 1) != "\\"):
            column = t.start[i] - t.text.rfind("\n", 0, t.start[i]) - 1
            while stack and column <= stack[-1][1]:
                out.append((stack.pop()[0], t.end[i - 1]))
            if t.at(i) in words or t.at(i) == "async" and t.at(i + 1) in words:
                stack.append((i, column))
        depth = max(0, depth + (t.at(i) in ("(", "[", "{")) - (t.at(i) in _PAIRS))
    return out + [(i, t.end[n - 1]) for i, _ in stack]


def loops(t: Tokens) -> list[tuple[int, int, int]]:
    """(start, end, line) of the loops of a source."""
    out, n = [], len(t.token)
    if t.language == "Python":
        return [(t.start[i], end, t.line[i]) for i, end in indented(t, ("for", "while"))]
    if t.language == "Ruby":
        stack = []
        for i in range(n):
            x, first = t.at(i), not i or t.line[i] > t.line[i - 1] or t.at(i - 1) in (";", "=")
            if t.at(i - 1) in _LINKS or t.at(i - 1) == ":":
                continue
            if x == "do" and stack and stack[-1][1] and t.line[stack[-1][0]] == t.line[i] and not stack[-1][2]:
                stack[-1][2] = True
            elif x in ("class", "module", "def", "begin", "case", "do") or first and x in ("if", "unless", "while", "until", "for"):
                stack.append([i, x in ("while", "for"), False])
            elif x == "end" and stack:
                j, loop, with_do = stack.pop()
                if loop and with_do:
                    out.append((t.start[j], t.end[i], t.line[j]))
        return out
    for i in range(n):
        if t.at(i) in ("for", "foreach", "while") and t.at(i - 1) not in _LINKS and (last := _brace_loop(t, i)) is not None:
            out.append((t.start[i], t.end[last], t.line[i]))
    return out


def compact(text: str, most: int = 160) -> str:
    """White space as single spaces; of over `most` bytes the beginning, and dots."""
    text = " ".join(text.split())
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."
