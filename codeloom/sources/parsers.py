"""Source texts to symbols, references, function bodies and parse outcomes.

One vectorised pass emits tagged rows, which split into relations. Python is parsed by its own grammar; the other languages
by line patterns over masked text, which see declarations, imports, heritage and calls.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.functions import masks

ROW = "tag string, file_path string, kind string, name string, qualified string, parent string, visibility string, params int, required int, start int, end int, target string, binding string, receiver string, form string, arity int, detail string"
FIELDS = [x.split()[0] for x in ROW.split(", ")]
#: Words that look like calls and are none.
KEYWORDS = frozenset("if for while switch catch return function match fn elseif foreach isset empty array list new class print echo unset and or not in is await async yield typeof sizeof super self".split())


def _row(**k) -> tuple:
    return tuple(k.get(f) for f in FIELDS)


def _python(path: str, text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [_row(tag="outcome", file_path=path, kind="python", detail="error", start=getattr(e, "lineno", None) or 1)]
    rows = [_row(tag="outcome", file_path=path, kind="python", detail="ok")]

    def dotted(x) -> str | None:
        if isinstance(x, ast.Name):
            return x.id
        if isinstance(x, ast.Attribute):
            up = dotted(x.value)
            return f"{up}.{x.attr}" if up else x.attr
        return None

    def walk(node, owner: str | None, inside: str | None):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = n.args
                names = [x.arg for x in [*a.posonlyargs, *a.args]]
                own = names[1:] if owner and names[:1] in (["self"], ["cls"]) else names
                q = f"{owner}.{n.name}" if owner else f"{inside}.{n.name}" if inside else n.name
                vis = "Private" if n.name.startswith("__") and not n.name.endswith("__") else "Protected" if n.name.startswith("_") and not n.name.startswith("__") else "Public"
                rows.append(_row(tag="symbol", file_path=path, kind="Method" if owner else "Function", name=n.name, qualified=q, parent=owner, visibility=vis, params=len(own) + len(a.kwonlyargs), required=max(0, len(own) - len(a.defaults)), start=n.lineno, end=n.end_lineno))
                body = [type(x).__name__ for x in ast.walk(n)]
                calls = sorted({c for x in ast.walk(n) if isinstance(x, ast.Call) and (c := dotted(x.func))})
                shape = hashlib.sha1(" ".join(body).encode()).hexdigest()[:12]
                rows.append(_row(tag="body", file_path=path, name=q, params=body.count("If") + body.count("IfExp"), required=body.count("Return"), arity=body.count("For") + body.count("While"), target=",".join(calls), detail=shape, start=n.lineno))
                for d in n.decorator_list:
                    if t := dotted(d.func if isinstance(d, ast.Call) else d):
                        rows.append(_row(tag="ref", file_path=path, kind="Call", target=t.rpartition(".")[2], start=d.lineno, parent=q, form="Free"))
                for x in [*a.args, *a.kwonlyargs]:
                    if x.annotation is not None and (t := dotted(x.annotation)):
                        rows.append(_row(tag="ref", file_path=path, kind="Type", target=t, start=x.lineno, parent=q))
                walk(n, None, q)
                continue
            if isinstance(n, ast.ClassDef):
                rows.append(_row(tag="symbol", file_path=path, kind="Class", name=n.name, qualified=n.name, parent=owner, visibility="Public", start=n.lineno, end=n.end_lineno))
                rows.extend(_row(tag="ref", file_path=path, kind="Extends", target=t, start=b.lineno, parent=n.name) for b in n.bases if (t := dotted(b)))
                walk(n, n.name, n.name)
                continue
            if isinstance(n, ast.Import):
                rows.extend(_row(tag="ref", file_path=path, kind="Import", target=x.name, binding=x.asname or x.name.split(".")[0], start=n.lineno, parent=inside) for x in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                rows.extend(_row(tag="ref", file_path=path, kind="Import", target=f"{base}.{x.name}" if n.module else base + x.name, binding=x.asname or x.name, start=n.lineno, parent=inside) for x in n.names)
            elif isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Attribute):
                    rows.append(_row(tag="ref", file_path=path, kind="Call", target=f.attr, receiver=dotted(f.value), form="Member", arity=len(n.args), start=n.lineno, parent=inside))
                elif isinstance(f, ast.Name):
                    rows.append(_row(tag="ref", file_path=path, kind="Call", target=f.id, form="Free", arity=len(n.args), start=n.lineno, parent=inside))
            walk(n, owner if not isinstance(n, (ast.FunctionDef, ast.Lambda)) else None, inside)

    walk(tree, None, None)
    return rows


#: Line patterns by language: (tag, kind, pattern). Groups: name, target, binding, vis, args.
_L = {
    "Php": [
        ("symbol", "Class", r"^\s*(?:abstract\s+|final\s+|readonly\s+)*class\s+(?P<name>\w+)"), ("symbol", "Interface", r"^\s*interface\s+(?P<name>\w+)"), ("symbol", "Trait", r"^\s*trait\s+(?P<name>\w+)"), ("symbol", "Enum", r"^\s*enum\s+(?P<name>\w+)"),
        ("symbol", "fn", r"^\s*(?:(?:abstract|final|static)\s+)*(?P<vis>public|protected|private)?\s*(?:static\s+)?function\s+&?(?P<name>\w+)\s*\((?P<args>[^)]*)"),
        ("ref", "Import", r"^use\s+(?P<target>[\w\\]+)(?:\s+as\s+(?P<binding>\w+))?\s*;"), ("ref", "Extends", r"\bextends\s+(?P<target>[\w\\]+)"), ("ref", "Implements", r"\bimplements\s+(?P<target>[\w\\, ]+)"),
    ],
    "JavaScript": [
        ("symbol", "Class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("symbol", "Interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("symbol", "Enum", r"^\s*(?:export\s+)?enum\s+(?P<name>\w+)"),
        ("symbol", "fn", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\((?P<args>[^)]*)"), ("symbol", "fn", r"^\s*(?:export\s+)?(?:const|let)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?\((?P<args>[^)]*)\)\s*=>"), ("symbol", "fn", r"^\s+(?P<vis>private |protected |public )?(?:static\s+)?(?:async\s+)?(?P<name>(?!if|for|while|switch|catch|return|function)\w+)\s*\((?P<args>[^)]*)\)\s*\{"),
        ("ref", "TypeImport", r"^\s*import\s+type\s+(?P<binding>[^'\"]*?)\s+from\s+['\"](?P<target>[^'\"]+)"), ("ref", "Import", r"^\s*import\s+(?!type\b)(?:(?P<binding>[^'\"]*?)\s+from\s+)?['\"](?P<target>[^'\"]+)"), ("ref", "Import", r"\b(?:require|import)\s*\(\s*['\"](?P<target>[^'\"]+)"), ("ref", "Extends", r"\bextends\s+(?P<target>[\w.]+)"), ("ref", "Implements", r"\bimplements\s+(?P<target>[\w., ]+)"),
    ],
    "Ruby": [
        ("symbol", "Class", r"^\s*class\s+(?P<name>[A-Z]\w*)"), ("symbol", "Module", r"^\s*module\s+(?P<name>[A-Z]\w*)"), ("symbol", "fn", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)\s*(?:\((?P<args>[^)]*))?"),
        ("ref", "Extends", r"^\s*class\s+[A-Z]\w*\s*<\s*(?P<target>[\w:]+)"), ("ref", "Import", r"^\s*require(?:_relative)?\s+['\"](?P<target>[^'\"]+)"), ("ref", "Implements", r"^\s*(?:include|extend|prepend)\s+(?P<target>[A-Z][\w:]*)"),
    ],
    "Rust": [
        ("symbol", "Struct", r"^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("symbol", "Enum", r"^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("symbol", "Trait", r"^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)"), ("symbol", "Module", r"^\s*(?P<vis>pub\s+)?mod\s+(?P<name>\w+)"),
        ("symbol", "fn", r"^\s*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*\((?P<args>[^)]*)"),
        ("ref", "Import", r"^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+(?:::\{[^}]*\})?(?:::\*)?)(?:\s+as\s+(?P<binding>\w+))?\s*;"), ("ref", "Implements", r"^\s*impl(?:<[^>]*>)?\s+(?P<target>[\w:]+)(?:<[^>]*>)?\s+for\s+\w+"),
    ],
}
_L["TypeScript"] = _L["JavaScript"]
_LINES = {k: [(t, kind, re.compile(p)) for t, kind, p in v] for k, v in _L.items()}
_CALL = re.compile(r"(?:(?P<receiver>[\w$]+(?:(?:->|::|\.)[\w$]+)*)(?P<sep>->|::|\.))?(?P<name>[A-Za-z_]\w*)!?\s*\((?P<args>[^()]*)")
_OWNERS = ("Class", "Interface", "Trait", "Struct", "Enum")


def expand_use(target: str) -> list[str]:
    """A use tree of one level of braces as paths."""
    m = re.match(r"^(.*)::\{(.*)\}$", target)
    if not m:
        return [target.removesuffix("::*")]
    return [m[1] if p.strip() == "self" else f"{m[1]}::{p.strip().split(' as ')[0]}" for p in m[2].split(",") if p.strip()]


def _patterned(path: str, text: str, language: str) -> list[tuple]:
    code = masks.mask(text, language, strings=False) or ""
    plain = masks.mask(text, language) or ""
    rows = [_row(tag="outcome", file_path=path, kind=language.lower(), detail="ok" if plain.count("{") == plain.count("}") or language == "Ruby" else "recovered")]
    owner, owner_depth, inside, depth = None, 0, None, 0
    for no, (line, bare) in enumerate(zip(code.split("\n"), plain.split("\n")), 1):
        declared = False
        if language == "Rust" and (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)", line)):
            owner, owner_depth = m[1], depth
        for tag, kind, pattern in _LINES[language]:
            m = pattern.search(line)
            if not m:
                continue
            g = m.groupdict()
            if tag == "symbol":
                declared = True
                if kind in _OWNERS:
                    owner, owner_depth = g["name"], depth
                    rows.append(_row(tag="symbol", file_path=path, kind=kind, name=g["name"], qualified=g["name"], visibility="Private" if language == "Rust" and not g.get("vis") else "Public", start=no, end=no))
                elif kind == "fn":
                    args = [a for a in (g.get("args") or "").split(",") if a.strip() and a.strip() not in ("self", "&self", "&mut self", "mut self")]
                    vis = (g.get("vis") or "").strip()
                    v = "Private" if vis == "private" or (language == "Rust" and not vis) else "Protected" if vis == "protected" else "Public"
                    inside = f"{owner}::{g['name']}" if owner else g["name"]
                    rows.append(_row(tag="symbol", file_path=path, kind="Method" if owner else "Function", name=g["name"], qualified=inside, parent=owner, visibility=v, params=len(args), required=sum("=" not in a and "?" not in a.split(":")[0] for a in args), start=no, end=no))
                else:
                    rows.append(_row(tag="symbol", file_path=path, kind=kind, name=g["name"], qualified=g["name"], visibility="Public", start=no, end=no))
            else:
                targets = expand_use(g["target"]) if language == "Rust" and kind == "Import" else [t.strip() for t in g["target"].split(",") if t.strip()] if kind == "Implements" else [g["target"]]
                for t in targets:
                    names = [b.strip().split(" as ")[-1].strip() for b in re.sub(r"[{}]", "", g.get("binding") or "").split(",") if b.strip()] or [re.split(r"::|\\|/", t)[-1] if kind == "Import" else None]
                    rows.extend(_row(tag="ref", file_path=path, kind=kind, target=t, binding=b if kind in ("Import", "TypeImport") else None, start=no, parent=owner if kind in ("Extends", "Implements") else inside) for b in names)
        if not declared:
            for m in _CALL.finditer(bare):
                if m["name"] in KEYWORDS:
                    continue
                form = {"->": "Member", ".": "Member", "::": "Associated"}.get(m["sep"] or "", "Free")
                rows.append(_row(tag="ref", file_path=path, kind="Call", target=m["name"], receiver=m["receiver"], form=form, arity=len([a for a in m["args"].split(",") if a.strip()]), start=no, parent=inside))
        depth += bare.count("{") - bare.count("}")
        if owner and depth <= owner_depth and "}" in bare and language != "Ruby":
            owner = inside = None
    return rows


def parse(path: str, text: str | None, language: str | None) -> list[tuple]:
    if text is None or language is None:
        return []
    if path.endswith(".vue"):
        text = masks.vue_script(text) or ""
    return _python(path, text) if language == "Python" else _patterned(path, text, language)


def parsed(sources: DataFrame) -> DataFrame:
    """sources (file_path, text) → tagged rows."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p, t, x in zip(pdf.file_path, pdf.text, pdf.language) for r in parse(p, t, x)], columns=FIELDS)

    return sources.select("file_path", "text", E.language("file_path").alias("language")).mapInPandas(run, ROW)


def symbols(rows: DataFrame) -> DataFrame:
    s = rows.filter("tag = 'symbol'")
    key = F.concat_ws("#", "file_path", "qualified", F.col("start").cast("string"))
    return s.select(F.xxhash64(key).alias("symbol_index"), key.alias("id"), "file_path", "kind", "name", F.col("qualified").alias("qualified_name"), F.col("parent").alias("owner_type_name"), "visibility", F.col("params").alias("parameter_count"), F.col("required").alias("required_parameter_count"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))


def refs(rows: DataFrame) -> DataFrame:
    r = rows.filter("tag = 'ref'")
    return r.select(F.xxhash64("file_path", "start", "kind", "target", "receiver", "binding").alias("ref_index"), "file_path", F.col("parent").alias("enclosing_symbol_id"), "kind", F.col("target").alias("target_name"), F.col("binding").alias("binding_name"), F.col("start").alias("line"), "arity", F.col("receiver").alias("receiver_name"), F.col("form").alias("call_form"))


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.filter("tag = 'outcome'").select("file_path", F.col("kind").alias("parser"), (F.col("detail") != "ok").alias("required_recovery"), F.col("start").alias("diagnostic_line"))


def behaviors(rows: DataFrame) -> DataFrame:
    b = rows.filter("tag = 'body'")
    return b.select("file_path", F.col("name").alias("qualified_name"), F.col("params").alias("branches"), F.col("required").alias("returns"), F.col("arity").alias("loops"), F.split("target", ",").alias("calls"), F.col("detail").alias("shape"), F.col("start").alias("line"))


def input_coverage(files: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of files by how their parse went."""
    x = files.select(F.col("path").alias("file_path")).join(found, "file_path", "left")
    n = lambda c: F.count_if(c)
    return x.agg(F.count(F.lit(1)).alias("files"), n(F.col("required_recovery") == F.lit(False)).alias("complete"), n(F.col("required_recovery")).alias("recovered"), n(F.col("parser").isNull()).alias("unsupported"))
