"""Lexical masks: strings and comments blanked, positions kept."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_QUOTES = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
#: By language: pattern of comments (group c) and strings (group s), the first that starts wins.
PATTERNS = {
    "Python": re.compile(rf"(?P<c>\#[^\n]*)|(?P<s>{_STRINGS})", re.S),
    "Ruby": re.compile(rf"(?P<c>^=begin\b.*?^=end\b|\#[^\n]*)|(?P<s>{_QUOTES})", re.S | re.M),
    "Php": re.compile(rf"(?P<c>//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{_QUOTES})", re.S),
    "JavaScript": re.compile(rf"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>{_QUOTES})", re.S),
    "Rust": re.compile(r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>r(#*)\".*?\"\3|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])')", re.S),
}
PATTERNS["TypeScript"] = PATTERNS["JavaScript"]


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def mask(text: str | None, language: str | None, strings: bool = True) -> str | None:
    """Comments, and with `strings` what stands within quotes, as blanks; line breaks stay. Other languages as they are."""
    if text is None or language not in PATTERNS:
        return text

    def put(m: re.Match) -> str:
        if m["c"] is not None:
            return _blank(m[0])
        if not strings:
            return m[0]
        return m[0][0] + _blank(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0]

    return PATTERNS[language].sub(put, text)


@F.pandas_udf(T.StringType())
def mask_code(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([mask(t, x) for t, x in zip(text, language)])


@F.pandas_udf(T.StringType())
def mask_comments(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([mask(t, x, strings=False) for t, x in zip(text, language)])


_SFC = re.compile(r"<script\b[^>]*>(.*?)(?:</script\s*>|\Z)", re.S | re.I)


def vue_script(text: str | None) -> str | None:
    """All of a single-file component but its scripts as blanks, lines kept."""
    if text is None:
        return None
    out, at = [], 0
    for m in _SFC.finditer(text):
        out += [_blank(text[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join(out) + _blank(text[at:])


@F.pandas_udf(T.StringType())
def vue_scripts(text: pd.Series) -> pd.Series:
    return text.map(vue_script)


def test_ranges(text: str | None) -> list[tuple[int, int]]:
    """1-based line ranges of inline Rust test modules, by balance of braces."""
    out, lines, i = [], (text or "").split("\n"), 0
    while i < len(lines):
        if lines[i].lstrip().startswith("#[cfg(test)]"):
            depth, opened, j = 0, False, i
            while j < len(lines):
                depth += lines[j].count("{") - lines[j].count("}")
                opened |= "{" in lines[j]
                if opened and depth <= 0:
                    break
                j += 1
            out.append((i + 1, min(j, len(lines) - 1) + 1))
            i = j + 1
        else:
            i += 1
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def rust_test_ranges(text: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in test_ranges(t)] for t in text])
