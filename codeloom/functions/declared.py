"""What a source declares and uses, for the types of receivers: classes, functions with their return types, imports, variables, member calls.

Each fact is a row. Functions are the scopes of variables; a row names the scopes that it lies in, the innermost first, by where they begin, 0 for the
module. What a variable is set to, and what a member is called on, are paths: `$factory->makeUser()` is ["$factory", "makeUser"].
"""

from __future__ import annotations

from codeloom.functions.shapes import _LINKS, _NAME, Tokens, indented

FIELDS = "tag string, name string, owner string, scopes array<int>, steps array<string>, detail string, line int, start int"
#: Words for the object or class that a method belongs to.
OWN = frozenset("this self $this cls static Self".split())
_STARTS = {"JavaScript": ("const", "let", "var"), "TypeScript": ("const", "let", "var"), "Rust": ("let",)}
_NO_NAMES = frozenset("if for foreach while switch catch return function fn match elseif with do else and or not in new await yield throw typeof".split())


def path(t: Tokens, i: int) -> tuple[list[str], int, list[tuple[int, int, int]]] | None:
    """The path at token i, the place after it, and its calls: (steps before the call's name and with it, place of the name)."""
    while t.at(i) in ("await", "&", "mut", "*", "\\", "::"):
        i += 1
    calls: list[tuple[int, int, int]] = []
    if t.at(i) == "(" and i in t.pair:
        inner = path(t, i + 1)
        if inner is None or inner[1] != t.pair[i]:
            return None
        steps, j = list(inner[0]), t.pair[i] + 1
    elif t.at(i) == "new" or _NAME.match(t.at(i)):
        made = t.at(i) == "new"
        j = i + made + (t.at(i + made) == "\\")
        name = t.at(j)
        if not _NAME.match(name) or name in _NO_NAMES:
            return None
        j += 1
        while t.at(j) == "\\" and _NAME.match(t.at(j + 1)):
            name, j = f"{name}\\{t.at(j + 1)}", j + 2
        steps = [name]
        if made and t.at(j) == "(" and j in t.pair:
            j = t.pair[j] + 1
    else:
        return None
    at = j - 1
    while True:
        x = t.at(j)
        if x == "(" and j in t.pair and (t.language != "Python" or t.end[j - 1] == t.start[j]):
            calls.append((len(steps) - 1, len(steps), at))
            j = t.pair[j] + 1
        elif x in _LINKS and _NAME.match(t.at(j + 1)):
            steps.append(t.at(j + 1))
            at, j = j + 1, j + 2
        elif x == "!" and t.language == "TypeScript" and t.at(j + 1) in _LINKS or x == "?" and t.language == "Rust":
            j += 1
        else:
            return steps, j, calls


def _text(t: Tokens, i: int, j: int) -> str:
    return t.text[t.start[i] : t.end[j - 1]] if j > i else ""


def _until(t: Tokens, i: int, stops: tuple[str, ...], line: bool = False) -> int:
    while i < len(t.token) and t.at(i) not in stops and not (line and t.line[i] > t.line[i - 1]):
        i = t.skip(i)
    return min(i, len(t.token))


def _functions(t: Tokens) -> list[tuple[int, int, str | None, int, str]]:
    """(first token, end, name, place of the parameters, return type)."""
    out, n = [], len(t.token)
    if t.language == "Python":
        for i, end in indented(t, ("def",)):
            i += t.at(i) == "async"
            j = i + 2
            if t.at(j) == "(" and j in t.pair:
                k = t.pair[j] + 1
                out.append((i, end, t.at(i + 1), j, _text(t, k + 1, _until(t, k, (":",))) if t.at(k) == "->" else ""))
        return out
    for i in range(n):
        word, name, j = t.at(i), None, None
        if word in ("function", "fn"):
            j = i + 1 + (t.at(i + 1) in ("*", "&"))
            if _NAME.match(t.at(j)):
                name, j = t.at(j), j + 1
            if t.at(j) == "<":  # type parameters
                j = _until(t, j, ("(",))
        elif t.language in ("JavaScript", "TypeScript") and _NAME.match(word) and word not in _NO_NAMES and t.at(i + 1) == "(" and t.at(i - 1) not in (*_LINKS, "new", "function"):
            name, j = word, i + 1
        elif t.language in ("JavaScript", "TypeScript") and word == "(" and i in t.pair:
            k = t.pair[i] + 1
            k = _until(t, k, ("=>", "{", ";", ",", ")", "}"), True) if t.at(k) == ":" else k
            if t.at(k) == "=>":
                back = i - 1 - (t.at(i - 1) == "async")
                name, j = t.at(back - 1) if t.at(back) == "=" and _NAME.match(t.at(back - 1)) else None, i
        if j is None or t.at(j) != "(" or j not in t.pair:
            continue
        k = m = t.pair[j] + 1
        returns = ""
        if t.at(k) in (":", "->"):
            m = _until(t, k + 1, ("{", ";", "=>", "where"))
            returns = _text(t, k + 1, m)
        m = _until(t, m, ("{", ";", ")", "}")) if word in ("function", "fn") or t.at(m) == "=>" else m
        if t.at(m) == "{" and m in t.pair:
            out.append((i, t.end[t.pair[m]], name, j, returns))
        elif t.at(m) == ";" and word in ("function", "fn"):
            out.append((i, t.end[m], name, j, returns))
    return out


def _classes(t: Tokens) -> list[tuple[int, int, str, bool]]:
    """(first token, end, name, whether it is declared here: a Rust impl isn't)."""
    if t.language == "Python":
        return [(i, end, t.at(i + 1), True) for i, end in indented(t, ("class",))]
    out = []
    for i in range(len(t.token)):
        if t.at(i) in ("class", "interface", "trait", "struct", "enum", "impl") and t.at(i - 1) not in _LINKS and (_NAME.match(t.at(i + 1)) or t.at(i) == "impl"):
            j = _until(t, i + 1, ("{", ";"))
            name = t.at(i + 1)
            if t.at(i) == "impl":
                parts = [x for x in range(i + 1, j) if t.at(x) == "for"]
                name = next((t.at(x) for x in range(parts[-1] + 1 if parts else i + 1, j) if _NAME.match(t.at(x))), "")
            out.append((i, t.end[t.pair[j]] if t.at(j) == "{" and j in t.pair else t.end[min(j, len(t.token) - 1)], name, t.at(i) != "impl"))
    return out


def _imports(t: Tokens) -> list[tuple[str, str, str, int]]:
    """(binding, exported name, module, place)."""
    out = []

    def named(tokens: list[str], module: str, i: int) -> None:
        part: list[str] = []
        for x in [*tokens, ","]:
            if x == ",":
                if part:
                    out.append((part[-1], part[0], module, i))
                part = []
            elif x not in ("as", "type"):
                part.append(x)

    for i in range(len(t.token)):
        first = not i or t.line[i] > t.line[i - 1] or t.at(i - 1) in (";", "{")
        if t.language in ("JavaScript", "TypeScript") and t.at(i) == "import" and first:
            j = _until(t, i + 1, ("from", ";"))
            if t.at(j) == "from" and j + 1 < len(t.token):
                module = t.text[t.start[j + 1] + 1 : t.end[j + 1] - 1]
                for k in range(i + 1, j):
                    if t.at(k) == "{" and k in t.pair:
                        named(t.token[k + 1 : t.pair[k]], module, i)
                if _NAME.match(t.at(i + 1)) and t.at(i + 1) != "type":
                    out.append((t.at(i + 1), "default", module, i))
        elif t.language == "Python" and t.at(i) == "from" and first:
            j = _until(t, i + 1, ("import",), True)
            if t.at(j) == "import":
                k = j + 1
                end = t.pair.get(k) if t.at(k) == "(" else _until(t, k + 1, (), True)
                named(t.token[k + (t.at(k) == "(") : end], "".join(t.token[i + 1 : j]), i)
        elif t.language in ("Php", "Rust") and t.at(i) == "use" and (first or t.at(i - 1) == "pub"):
            j = _until(t, i + 1, (";",))
            names = t.token[i + 1 : j]
            if "{" not in names and "(" not in names and names:
                cut = names.index("as") if "as" in names else len(names)
                out.append((names[-1], names[cut - 1], "".join(names[:cut]).lstrip("\\"), i))
    return out


def facts(t: Tokens) -> list[tuple]:
    """Rows of FIELDS."""
    rows: list[tuple] = []
    functions, classes = _functions(t), _classes(t)
    ends = sorted((t.start[i], end, True, None) for i, end, *_ in functions)
    ends = sorted(ends + [(t.start[i], end, False, name) for i, end, name, _ in classes])

    def around(offset: int) -> tuple[list[int], str | None]:
        """Scopes, innermost first, and the innermost class. Intervals are few for a source."""
        inside = [x for x in ends if x[0] < offset < x[1]]
        owners = [x[3] for x in inside if not x[2]]
        return [*[x[0] for x in reversed(inside) if x[2]], 0], owners[-1] if owners else None

    space = ""
    for i in range(len(t.token)):
        if t.language == "Php" and t.at(i) == "namespace" and _NAME.match(t.at(i + 1)):
            space = "".join(t.token[i + 1 : _until(t, i + 1, (";", "{"))]) + "\\"
            break
    for i, _, name, here in classes:
        if here and name:
            rows.append(("class", name, None, [0], None, space + name, t.line[i], t.start[i]))
    for i, end, name, params, returns in functions:
        scopes, owner = around(t.start[i])
        if name:
            rows.append(("fn", name, owner if len(scopes) == 1 else None, scopes, None, returns.strip() or None, t.line[i], t.start[i]))
        within = [t.start[i], *scopes]
        for part in _parts(t, params):
            names = [k for k in part if _NAME.match(t.at(k)) and (t.language != "Php" or t.at(k).startswith("$"))]
            if not names:
                continue
            k = names[0]
            if t.language == "Php":
                kind = _text(t, part[0], k)
            else:
                kind = _text(t, k + 2, _until(t, k + 2, ("=", ",", ")"))) if t.at(k + 1) == ":" else _text(t, k + 3, _until(t, k + 3, ("=", ",", ")"))) if t.at(k + 1) == "?" and t.at(k + 2) == ":" else ""
            if kind.strip():
                rows.append(("bind", t.at(k), None, within, None, kind.strip(), t.line[k], t.start[k]))
    rows += [("import", binding, exported, [0], None, module, t.line[i], t.start[i]) for binding, exported, module, i in _imports(t)]
    own = OWN if t.language != "Php" else OWN | {"parent"}
    for i in range(len(t.token)):
        before = t.at(i - 1)
        first = not i or t.line[i] > t.line[i - 1] or before in (";", "{", "}", ":")
        name = j = None
        if t.at(i) in _STARTS.get(t.language, ()):
            k = i + 1 + (t.at(i + 1) == "mut")
            if _NAME.match(t.at(k)):
                name, j = t.at(k), k + 1
        elif first and _NAME.match(t.at(i)) and t.language in ("Php", "Python", "Ruby") and t.at(i + 1) in ("=", ":") and (t.language != "Php" or t.at(i)[0] == "$") and t.at(i) not in ("else", "try", "finally", "lambda"):
            name, j = t.at(i), i + 1
        if name is not None:
            scopes, owner = around(t.start[i])
            if t.at(j) == ":":
                k = _until(t, j + 1, ("=", ";"), True)
                if _text(t, j + 1, k).strip():
                    rows.append(("bind", name, owner, scopes, None, _text(t, j + 1, k).strip(), t.line[i], t.start[i]))
            elif t.at(j) == "=" and (found := path(t, j + 1)):
                steps, k, _ = found
                if k >= len(t.token) or t.at(k) in (";", "}") or t.line[k] > t.line[k - 1]:
                    if steps[0] in own:
                        steps = [owner, *steps[1:]] if owner else []
                    if steps:
                        rows.append(("bind", name, owner, scopes, steps, None, t.line[i], t.start[i]))
        if (_NAME.match(t.at(i)) or t.at(i) == "(" and not (before and t.line[i - 1] == t.line[i] and (_NAME.match(before) and before not in _NO_NAMES or before in (")", "]")))) and before not in (*_LINKS, "\\", "new") and (found := path(t, i)):
            for n, _, at in found[2]:
                steps = found[0][: n + 1]
                if n:
                    scopes, owner = around(t.start[i])
                    if steps[0] in own:
                        if not owner:
                            continue
                        steps = [owner, *steps[1:]]
                    rows.append(("call", steps[-1], owner, scopes, steps[:-1], None, t.line[at], t.start[at]))
        if t.at(i) == "new" and (found := path(t, i)) and before not in _LINKS:
            for n, _, at in found[2]:
                if n:
                    scopes, owner = around(t.start[i])
                    rows.append(("call", found[0][n], owner, scopes, found[0][:n], None, t.line[at], t.start[at]))
    return rows


def _parts(t: Tokens, i: int) -> list[list[int]]:
    """Places of the tokens of the group at i, split at commas."""
    out, j = [[]], i + 1
    while j < t.pair[i]:
        if t.at(j) == ",":
            out.append([])
        else:
            out[-1].append(j)
        j = t.skip(j)
    return [x for x in out if x]
