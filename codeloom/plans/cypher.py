"""A read-only subset of Cypher over one node and one relation table, planned as joins.

MATCH (a[:Label][{k: v}])-[r[:Label]]->(b ...)[, ...] [WHERE ...] RETURN [DISTINCT] x AS y, ... [ORDER BY ...] [SKIP n] [LIMIT n]
with node and relation properties, comparisons, AND/OR/NOT, IN [...], CONTAINS, STARTS WITH, ENDS WITH, IS NULL, count(*), count([DISTINCT] x),
min, max, sum, avg, collect; and (a)-[:Label*1..3]->(b) of bounded length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOPS = 8
_node = re.compile(r"\(\s*(\w*)\s*(?::\s*(\w+))?\s*(\{[^}]*\})?\s*\)")
_edge = re.compile(r"(<)?-\s*(?:\[\s*(\w*)\s*(?::\s*(\w+))?\s*(\*\s*(\d*)\s*(?:\.\.\s*(\d+))?)?\s*(\{[^}]*\})?\s*\])?\s*-(>)?")


class CypherError(ValueError):
    pass


def _split(text: str, mark: str = ",") -> list[str]:
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == mark and not depth:
            out.append(text[at:i].strip())
            at = i + 1
    return [*out, text[at:].strip()]


def _expression(text: str) -> str:
    """A Cypher expression as Spark SQL; quoted text is left as it is."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", text)
    for i in range(0, len(parts), 2):
        p = parts[i]
        p = re.sub(r"\b(\w+)\.(\w+)\b", r"`\1.\2`", p)
        p = re.sub(r"\[", "(", p).replace("]", ")")
        p = re.sub(r"<>", "!=", p)
        p = re.sub(r"(?i)\bcollect\s*\(", "collect_list(", p)
        parts[i] = p
    out = "".join("'" + x[1:-1].replace("'", "\\'") + "'" if i % 2 else x for i, x in enumerate(parts))
    lit = r"('(?:[^'\\]|\\.)*'|`[^`]+`)"
    for word, function in (("CONTAINS", "contains"), ("STARTS\\s+WITH", "startswith"), ("ENDS\\s+WITH", "endswith")):
        out = re.sub(rf"(?i)(`[^`]+`)\s+{word}\s+{lit}", rf"{function}(\1, \2)", out)
    return out


def _props(text: str | None, name: str) -> list[str]:
    return [f"`{name}.{k.strip()}` = {v.strip()}" for k, _, v in (p.partition(":") for p in _split(text[1:-1]))] if text else []


def _renamed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in df.columns])


def _walks(relations: DataFrame, least: int, most: int) -> DataFrame:
    """(from, to) over least to most relations."""
    step = relations.select(F.col("from").alias("f"), F.col("to").alias("t")).distinct()
    front, out = step, None
    for n in range(1, most + 1):
        if n >= least:
            out = front if out is None else out.unionByName(front)
        front = front.join(step.select(F.col("f").alias("t"), F.col("t").alias("t2")), "t").select("f", F.col("t2").alias("t")).distinct()
    return out.distinct().select(F.col("f").alias("from"), F.col("t").alias("to"))


def run(nodes: DataFrame, relations: DataFrame, query: str) -> DataFrame:
    text = query.strip().rstrip(";").strip()
    if ";" in re.sub(r"'[^']*'|\"[^\"]*\"", "", text):
        raise CypherError("one statement only")
    if re.search(r"(?i)\b(create|merge|delete|set|remove|drop|copy|load|call|install|alter)\b", re.sub(r"'[^']*'|\"[^\"]*\"", "", text)):
        raise CypherError("read-only statements only")
    m = re.match(r"(?is)^(?:match\s+(.*?))?(?:\s*where\s+(.*?))?\s*return\s+(distinct\s+)?(.*?)(?:\s+order\s+by\s+(.*?))?(?:\s+skip\s+(\d+))?(?:\s+limit\s+(\d+))?$", text)
    if not m:
        raise CypherError("expected MATCH ... RETURN ...")
    patterns, where, distinct, returns, order, skip, limit = m.groups()
    rows, seen, fresh = None, set(), 0
    conditions = []
    for pattern in _split(patterns) if patterns else []:
        at = _node.match(pattern)
        if not at:
            raise CypherError(f"not a pattern: {pattern}")
        steps, left = [], at
        pos = at.end()
        while pos < len(pattern) and pattern[pos:].strip():
            while pattern[pos].isspace():
                pos += 1
            e = _edge.match(pattern, pos)
            right = e and _node.match(pattern[e.end() :].lstrip())
            if not right:
                raise CypherError(f"not a pattern: {pattern}")
            steps.append((e, right))
            pos = e.end() + (len(pattern[e.end() :]) - len(pattern[e.end() :].lstrip())) + right.end()
        names = []
        for part in (left, *[r for _, r in steps]):
            fresh += 1
            names.append(part[1] or f"_n{fresh}")
            conditions += _props(part[3], names[-1])
        if names[0] not in seen:
            own = _renamed(nodes, names[0])
            if rows is not None:
                raise CypherError("patterns must share a variable")
            rows, _ = own, seen.add(names[0])
        for (e, _), a, b in zip(steps, names, names[1:]):
            fresh += 1
            r = e[2] or f"_r{fresh}"
            rel = relations
            if e[4]:
                least, most = int(e[5] or 1), int(e[6] or e[5] or MOST_HOPS)
                if most > MOST_HOPS:
                    raise CypherError(f"at most {MOST_HOPS} steps")
                rel = _walks(relations, least, most)
            conditions += _props(e[7], r)
            head, tail = ("to", "from") if e[1] else ("from", "to")
            rows = rows.join(_renamed(rel, r), F.col(f"`{a}.id`") == F.col(f"`{r}.{head}`"))
            if b in seen:
                rows = rows.filter(F.col(f"`{r}.{tail}`") == F.col(f"`{b}.id`"))
            else:
                rows = rows.join(_renamed(nodes, b), F.col(f"`{r}.{tail}`") == F.col(f"`{b}.id`"))
                seen.add(b)
    if rows is None:
        rows = nodes.sparkSession.range(1).select()
    for c in [*conditions, *([where] if where else [])]:
        rows = rows.filter(F.expr(_expression(c) if not c.startswith("`") else c))
    columns, keys, totals = [], [], []
    for item in _split(returns):
        a = re.match(r"(?is)^(.*?)\s+as\s+(\w+)$", item)
        body, name = (a[1], a[2]) if a else (item, item)
        if name in columns:
            raise CypherError(f"duplicate column {name}")
        columns.append(name)
        (totals if re.match(r"(?i)\s*(count|sum|min|max|avg|collect)\s*\(", body) else keys).append(F.expr(_expression(body)).alias(name))
    out = rows.groupBy(*keys).agg(*totals).select(*[F.col(f"`{c}`") for c in columns]) if totals else rows.select(*keys)
    if distinct:
        out = out.distinct()
    if order:
        by = []
        for item in _split(order):
            body, _, way = item.partition(" ")
            column = F.col(f"`{body.strip()}`")
            by.append(column.desc() if way.strip().lower().startswith("desc") else column.asc())
        out = out.orderBy(*by)
    if skip:
        out = out.offset(int(skip))
    return out.limit(int(limit)) if limit else out
