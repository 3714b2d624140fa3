"""Scopes of a source as intervals, what names they bind, and where names are used.

Each fact is a row. A use names the scopes that it lies in, the innermost first, 0 for the module; a binding names the one that it belongs to. Which binding a
use means is a join over these rows. Scripts go by paired tokens and a stack of scopes, Python by its own grammar.
"""

from __future__ import annotations

import ast

from codeloom.functions.shapes import _LINKS, _NAME, Tokens


def _named(t: Tokens) -> tuple[list[str], frozenset[str]]:
    """The tokens with nothing before and after them, so that a place beside one needs no check, and which of them are names: looked at once each."""
    return [*t.token, "", "", ""], frozenset(x for x in set(t.token) if _NAME.match(x))


#: tag bind or use; kind of a binding: function, class, import, value; of a use: call, new, name, write; to_name, to_line, to_start: the symbol that is bound.
FIELDS = "tag string, name string, scopes array<int>, kind string, line int, start int, to_name string, to_line int, to_start int"
LANGUAGES = ["JavaScript", "TypeScript", "Python"]
#: Words of scripts that are no names.
_WORDS = frozenset("if else for while do switch case default break continue return throw try catch finally function class extends implements new delete typeof void in of instanceof const let var import export from as async await yield this super null true false undefined static get set public private protected readonly override abstract declare".split())
_WRITES = frozenset("+= -= *= /= %= &= |= ^= =".split())
_LED = _LINKS | {"function"}
_MADE = _LED | {"new"}
#: Words that can bind what follows them.
_BINDERS = frozenset("function class enum interface type namespace import const let var".split())
_MODIFIERS = frozenset("public private protected readonly override ...".split())


def _ends_expression(t: Tokens, i: int) -> bool:
    x = t.at(i)
    return x in (")", "]", "}", '"', "'", "`") or bool(_NAME.match(x)) and (x not in _WORDS or x in ("this", "super", "null", "true", "false", "undefined")) or x[:1].isdigit()


def _end(t: Tokens, i: int) -> int:
    """The place after the block, or the statement or expression, that begins at i."""
    if t.at(i) == "{" and i in t.pair:
        return t.pair[i] + 1
    k = i
    while k < len(t.token) and t.at(k) not in (";", ",", ")", "]", "}"):
        if k > i and t.line[k] > t.line[k - 1] and _NAME.match(t.at(k)) and _ends_expression(t, k - 1):
            break
        k = t.skip(k)
    return k


def _pattern(t: Tokens, i: int, end: int) -> list[int]:
    """Places of the names that the comma-separated patterns from i to end bind."""
    out, todo = [], [(i, end, False)]
    while todo:
        k, stop, keyed = todo.pop()
        while k < stop:
            while t.at(k) in _MODIFIERS or t.at(k) == "." or t.at(k).startswith("@"):
                k = t.pair[k + 1] + 1 if t.at(k).startswith("@") and t.at(k + 1) == "(" and k + 1 in t.pair else k + 1
            if keyed and t.at(k + 1) == ":" and _NAME.match(t.at(k)):
                k += 2
            if t.at(k) in ("{", "[") and k in t.pair:
                todo.append((k + 1, t.pair[k], t.at(k) == "{"))
            elif _NAME.match(t.at(k)) and t.at(k) not in _WORDS:
                out.append(k)
            while k < stop and t.at(k) != ",":
                k = t.skip(k)
            k += 1
    return out


def _types(t: Tokens, names: list[int], end: int) -> list[int]:
    """Places of the types, of one name, that names from a list of parameters are given."""
    out = []
    for k in names:
        j = k + 1 + (t.at(k + 1) == "?")
        if t.at(j) == ":" and j + 1 < end and _NAME.match(t.at(j + 1)) and t.at(j + 2) in (",", "=", ")") and t.at(k - 1) in ("(", ",", *_MODIFIERS):
            out.append(j + 1)
    return out


def _starts(t: Tokens, i: int) -> bool:
    """Whether a statement begins at i."""
    before = t.at(i - 1)
    if before in ("async", "export", "default", "declare", "abstract"):
        return True if before != "async" else _starts(t, i - 1)
    return before in ("", ";", "{", "}", "else", "do") or t.line[i] > t.line[i - 1] and _ends_expression(t, i - 1)


def _type_parameters(t: Tokens, i: int) -> tuple[list[int], int]:
    """Names between angle brackets at i, and the place after them."""
    if t.at(i) != "<":
        return [], i
    names, depth, k = [], 0, i
    while k < len(t.token):
        depth += (t.at(k) == "<") - (t.at(k) == ">")
        if depth == 1 and t.at(k) in ("<", ",") and _NAME.match(t.at(k + 1)):
            names.append(k + 1)
        k = t.skip(k)
        if not depth:
            return names, k
    return [], i


def _script_scopes(t: Tokens) -> tuple[list[tuple], set[int], set[int]]:
    """([begin, end, kind, names that it binds, symbols' places by name], bodies of classes, places of methods' names)."""
    found, bodies, methods, inside = [], set(), set(), []
    (token, names_), pair, until = _named(t), t.pair, len(t.token)

    def function(i: int, params: int, end: int, more: list[int] = ()) -> None:
        found.append((i, end, "function", [*_pattern(t, params + 1, t.pair[params]), *more]))

    for i, x in enumerate(t.token):
        while i >= until:
            inside.pop()
            until = pair[inside[-1]] if inside else len(token)
        if x not in names_:
            if x == "(" and i in pair:
                k = pair[i] + 1
                if token[k] == ":":
                    k += 1
                    while t.at(k) not in ("=>", ";", ",", ")", "]", "}", "?", "=", ""):
                        k = t.skip(k)
                if t.at(k) == "=>":
                    function(i, i, _end(t, k + 1))
            if x in ("(", "[", "{") and i in pair:
                if x == "{":
                    found.append((i, pair[i] + 1, "block", []))
                inside.append(i)
                until = pair[i]
        elif x == "class" and t.at(i - 1) not in _LINKS:
            j = i + 1
            while j < len(t.token) and t.at(j) not in ("{", ";"):
                j = t.skip(j) if t.at(j) in ("(", "[") else j + 1
            if t.at(j) == "{" and j in t.pair:
                bodies.add(j)
                names, _ = _type_parameters(t, i + 2)
                expression = not _starts(t, i) and _NAME.match(t.at(i + 1)) and t.at(i + 1) not in _WORDS
                found.append((i + 1, t.pair[j] + 1, "class", [*names, *([i + 1] if expression else [])]))
        elif x in ("enum", "interface") and _NAME.match(t.at(i + 1)) and _starts(t, i):
            j = i + 2
            while j < len(t.token) and t.at(j) not in ("{", ";"):
                j += 1
            bodies.add(j)
        elif x == "function" and t.at(i - 1) not in _LINKS:
            j = i + 1 + (t.at(i + 1) == "*")
            own = [j] if _NAME.match(t.at(j)) and not _starts(t, i) else []
            j += bool(_NAME.match(t.at(j)))
            names, p = _type_parameters(t, j)
            if t.at(p) == "(" and p in t.pair:
                k = t.pair[p] + 1
                while t.at(k) not in ("{", ";", "}", ""):
                    k = t.skip(k)
                function(j, p, t.pair[k] + 1 if t.at(k) == "{" and k in t.pair else k, [*names, *own])
        elif x in ("for", "catch") and t.at(i - 1) not in _LINKS:
            p = i + 1 + (t.at(i + 1) == "await")
            if t.at(p) == "(" and p in t.pair:
                found.append((p, _end(t, t.pair[p] + 1), "block", _pattern(t, p + 1, t.pair[p]) if x == "catch" else []))
        elif token[i + 1] == "=>":
            found.append((i, _end(t, i + 2), "function", [i]))
        elif token[i + 1] in ("(", "<") and x not in _WORDS and token[i - 1] not in _MADE:
            names, p = _type_parameters(t, i + 1) if inside and inside[-1] in bodies else ([], i + 1)
            if t.at(p) == "(" and p in t.pair:
                k = t.pair[p] + 1
                body = inside and inside[-1] in bodies
                while body and t.at(k) not in ("{", ";", "}", "=", "") and t.line[k] == t.line[k - 1]:
                    k = t.skip(k)
                if t.at(k) == "{" and k in t.pair and (body or t.line[k] == t.line[k - 1]):
                    methods.add(i)
                    function(p, p, t.pair[k] + 1, names)
                elif body:
                    methods.add(i)
    return sorted(found, key=lambda s: (s[0], -s[1])), bodies, methods


def _script(t: Tokens) -> list[tuple]:
    scopes, bodies, methods = _script_scopes(t)
    rows, stack, taken, inside, named, n = [], [], set(), [], {}, 0
    (token, names_), pair, until, left = _named(t), t.pair, len(t.token), len(t.token)
    around, begins = [0], scopes[0][0] if scopes else -1

    def bind(k: int, scope: int, kind: str = "value", symbol: int | None = None) -> None:
        taken.add(k)
        rows.append(("bind", t.at(k), [scope], kind, t.line[k], t.start[k], *((None, None, None) if symbol is None else (t.at(symbol), t.line[symbol], t.start[symbol]))))

    def use(k: int, kind: str) -> None:
        rows.append(("use", token[k], around, kind, t.line[k], t.start[k], None, None, None))

    def used(k: int) -> None:
        before, after = token[k - 1], token[k + 1]
        if before == "new":
            use(k, "new")
        elif after == "(":
            use(k, "call")
        elif before == "extends":
            use(k, "name")
        elif (after in _WRITES or after in ("+", "-") and token[k + 2] == after) and not (inside and inside[-1] in bodies):
            use(k, "write")

    for i, x in enumerate(t.token):
        while i >= until:
            inside.pop()
            until = pair[inside[-1]] if inside else len(token)
        while left <= i:
            stack.pop()
            around, left = around[1:], stack[-1][0] if stack else len(token)
        while begins == i:
            _, end, kind, names = scopes[n]
            n += 1
            begins = scopes[n][0] if n < len(scopes) else -1
            stack.append((min(end, stack[-1][0]) if stack else end, n, kind))
            around, left = [n, *around], stack[-1][0]
            for k in names:
                own = k < i or kind == "class" and k == i  # a function or class expression's own name
                bind(k, n, ("class" if kind == "class" else "function") if own else "value", named.get(k, k) if own else None)
            if kind == "function":
                for k in _types(t, names, end):
                    use(k, "name")
        if x not in names_:
            if x in ("(", "[", "{") and i in pair:
                inside.append(i)
                until = pair[i]
            continue
        if x not in _BINDERS:
            if x not in _WORDS and token[i - 1] not in _LED and i not in taken and i not in methods:
                used(i)
            continue
        first = token[i + 1] in names_ and token[i + 1] not in _WORDS
        j = i + 1 + (token[i + 1] == "*")
        here = around[0]
        if x == "function" and _NAME.match(t.at(j)) and _starts(t, i):
            bind(j, here, "function", j)
        elif x in ("class", "enum", "interface") and first and _starts(t, i):
            bind(i + 1, here, "class", i + 1)
        elif x in ("type", "namespace") and first and _starts(t, i) and t.at(i + 2) in ("=", "<", "{"):
            bind(i + 1, here)
            taken.update(_type_parameters(t, i + 2)[0])
        elif x == "import" and _starts(t, i) and t.at(i + 1) not in ("(", "."):
            k = i + 1
            while k < len(t.token) and t.at(k) not in ("from", ";", '"', "'"):
                if _NAME.match(t.at(k)) and t.at(k + 1) != "as" and t.at(k) not in ("as", "type"):
                    bind(k, here, "import")
                k += 1
        elif x in ("const", "let", "var") and t.at(i - 1) not in _LINKS and t.at(i + 1) != "enum":
            scope = here if x != "var" else next((s[1] for s in reversed(stack) if s[2] == "function"), 0)
            k = i + 1
            while k < len(t.token):
                names = _pattern(t, k, k + 1) if t.at(k) not in ("{", "[") else _pattern(t, k, t.pair.get(k, k) + 1)
                e = k + 1 if t.at(k) not in ("{", "[") else t.pair.get(k, k) + 1
                while t.at(e) == ":" or e > k + 1 and t.at(e) not in ("=", ",", ";", "of", "in", ")", "}", "") and t.line[e] == t.line[e - 1]:
                    e = t.skip(e)
                v = e + 1 + (t.at(e + 1) == "async")
                made = None
                if t.at(e) == "=" and len(names) == 1 and names[0] == k:
                    p = _type_parameters(t, v)[1] if t.at(v) == "<" else v
                    after = t.pair[p] + 1 if t.at(p) == "(" and p in t.pair else v + 1
                    if t.at(after) == ":":
                        while t.at(after) not in ("=>", ";", ",", ")", "}", ""):
                            after = t.skip(after)
                    if t.at(v) in ("function", "class"):
                        made = t.at(v)
                        named[v + 1 + (t.at(v + 1) == "*")] = k
                    elif t.at(after) == "=>" and (t.at(p) == "(" or _NAME.match(t.at(v))):
                        made = "function"
                for m in names:
                    bind(m, scope, made or "value", m if made else None)
                e = _end(t, e + 1) if t.at(e) == "=" else e
                if t.at(e) != ",":
                    break
                k = e + 1
        elif i not in taken and i not in methods and x not in _WORDS and token[i - 1] not in _LED:
            used(i)
    return rows


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _python(text: str) -> list[tuple]:
    """Names of a class are seen in its own statements, not in its methods; defaults, decorators and annotations lie outside of the function."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    offsets, at = [0], 0
    for line in text.split("\n"):
        at += len(line.encode("utf-8", "surrogatepass")) + 1
        offsets.append(at)
    rows, n = [], 0
    outer: dict[tuple[int, str], str] = {}  # (scope, name) → global or nonlocal

    def bind(node, name: str, here: tuple, kind: str = "value") -> None:
        start = offsets[node.lineno - 1] + node.col_offset
        rows.append(("bind", name, list(here), kind, node.lineno, start, *((name, node.lineno, start) if kind in ("function", "class") else (None, None, None))))

    def use(node, name: str, here: tuple, kind: str) -> None:
        rows.append(("use", name, list(here), kind, node.lineno, offsets[node.lineno - 1] + node.col_offset, None, None, None))

    todo = [(x, (0,), (0,)) for x in tree.body]
    while todo:
        node, here, nested = todo.pop()
        go = lambda xs, a=here, b=nested: todo.extend((x, a, b) for x in xs if x is not None)
        if isinstance(node, _DEFS):
            a = node.args
            every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *[v for v in (a.vararg, a.kwarg) if v]]
            go([*a.defaults, *a.kw_defaults])
            n += 1
            own = (n, *nested)
            if not isinstance(node, ast.Lambda):
                bind(node, node.name, here, "function")
                go(node.decorator_list)
                for v in [*[p.annotation for p in every], node.returns]:
                    if isinstance(v, ast.Name):
                        use(v, v.id, here, "name")
            for p in every:
                bind(p, p.arg, own)
            todo.extend((x, own, own) for x in (node.body if isinstance(node.body, list) else [node.body]))
        elif isinstance(node, ast.ClassDef):
            bind(node, node.name, here, "class")
            for v in node.bases:
                if isinstance(v, ast.Name):
                    use(v, v.id, here, "name")
            go([*node.bases, *[k.value for k in node.keywords], *node.decorator_list])
            n += 1
            todo.extend((x, (n, *nested), nested) for x in node.body)
        elif isinstance(node, _COMPREHENSIONS):
            n += 1
            own = (n, *nested)
            go([node.generators[0].iter])
            rest = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            rest += [x for g in node.generators for x in [g.target, *g.ifs]] + [g.iter for g in node.generators[1:]]
            todo.extend((x, own, own) for x in rest)
        elif isinstance(node, (ast.Global, ast.Nonlocal)):
            outer.update({(here[0], x): type(node).__name__ for x in node.names})
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for x in node.names:
                bind(node, x.asname or x.name.split(".")[0], here, "import")
        elif isinstance(node, ast.Name):
            if not isinstance(node.ctx, ast.Load):
                bind(node, node.id, here)
        else:
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
                use(node.func, node.func.id, here, "call")
            name = getattr(node, "name", None) if isinstance(node, (ast.ExceptHandler, ast.MatchAs, ast.MatchStar)) else getattr(node, "rest", None) if isinstance(node, ast.MatchMapping) else None
            if name:
                bind(node, name, here)
            go(ast.iter_child_nodes(node))
    out = []
    for tag, name, scopes, kind, *rest in rows:
        moved = outer.get((scopes[0], name)) if scopes[0] else None
        if moved == "Global":
            scopes = [0]
        elif moved and tag == "bind":  # what encloses it is written
            tag, kind, scopes = "use", "write", scopes[1:]
        out.append((tag, name, scopes[:1] if tag == "bind" else scopes, kind, *rest))
    return out


def facts(text: str | None, language: str) -> list[tuple]:
    """Rows of FIELDS; none for an unparsable Python source, or no text."""
    if text is None or language not in LANGUAGES:
        return []
    return _python(text) if language == "Python" else _script(Tokens(text, language))


def meant(rows: list[tuple]) -> list[tuple]:
    """Facts of one file → its uses as bindings.bound_uses has them: line, name, kind, start, occurrence, target_name, target_line, target_start, target_kind."""
    bound: dict[tuple[int, str], tuple] = {}  # (scope, name) → whether all are imports, whether all are known, the first symbol
    for tag, name, inside, kind, _, _, to_name, to_line, to_start in rows:
        if tag == "bind" and name is not None:
            imported, known, least = bound.get(key := (inside[0], name), (True, True, None))
            symbol = None if to_name is None else (to_start, to_name, to_line, kind)
            least = symbol if least is None or symbol is not None and symbol < least else least
            bound[key] = imported and kind == "import", known and symbol is not None, least
    names = {name for _, name in bound}
    uses: dict[tuple, tuple] = {}  # (line, name, start, kind) → (depth, scope)
    for tag, name, inside, kind, line, start, *_ in rows:
        if tag == "use" and name in names:
            for depth, scope in enumerate(inside):
                if (scope, name) in bound:
                    key = line, name, start, kind
                    if key not in uses or uses[key] > (depth, scope):
                        uses[key] = depth, scope
                    break
    written = {(scope, key[1]) for key, (_, scope) in uses.items() if key[3] == "write"}
    out, places = [], {}
    for key in sorted(uses):
        line, name, start, kind = key
        at = uses[key][1], name
        imported, known, symbol = bound[at]
        if kind == "write" or imported:
            continue
        places[line, name] = place = places.get((line, name), -1) + 1
        to_start, to_name, to_line, to_kind = symbol if known and at not in written else (None, None, None, None)
        out.append((line, name, kind, start, place, to_name, to_line, to_start, to_kind))
    return out
