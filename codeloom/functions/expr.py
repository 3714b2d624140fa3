"""Scalar functions over paths, names, literals and millis, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a path that make a file an entry by default.
ENTRY_PATTERNS = ["/main.", "/lib.", "/mod.", "/index.", "/__init__.", "/config/", "/controllers/", "/Controllers/", "/routes/", "/migrations/", "/seeders/", "/factories/", "/tests/"]
#: File name conventions of tests; the first row is case-sensitive.
TEST_SUFFIXES_EXACT = ["Test.php", "Spec.php"]
TEST_SUFFIXES = ["_test.rs", "_test.go", "_test.py", "_test.php", "_spec.php", "-test.php", "-spec.php"]
TEST_NAMES = ["test.php", "spec.php"]
TEST_FOLDERS = ["tests", "test", "spec", "__tests__"]
#: Languages by extension.
EXTENSIONS = {"JavaScript": ["js", "jsx", "mjs", "cjs"], "TypeScript": ["ts", "tsx", "mts", "cts", "vue"], "Php": ["php", "phtml", "php3", "php4", "php5", "php8"], "Python": ["py"], "Ruby": ["rb", "rake"], "Rust": ["rs"]}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def contains_any(x: Column, parts: list[str]) -> Column:
    return any_of(*[x.contains(p) for p in parts])


def normalised(path: str | Column) -> Column:
    return F.translate(_c(path), "\\", "/")


def first_segment(path: str | Column) -> Column:
    """Module of a path: what stands before the first slash."""
    return F.split_part(_c(path), F.lit("/"), F.lit(1))


def zone(path: str | Column) -> Column:
    """First segment, '.' for files of the root."""
    return F.when(_c(path).contains("/"), first_segment(path)).otherwise(F.lit("."))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def directory(path: str | Column) -> Column:
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def language(path: str | Column) -> Column:
    """Language by extension, null where the file isn't a source."""
    return F.create_map(*[F.lit(v) for name, ext in EXTENSIONS.items() for e in ext for v in (e, name)])[extension(path)]


def _either(parts: list[str]) -> str:
    return "(?:" + "|".join(map(re.escape, parts)) + ")"


# One pattern each, so that a path that is itself an expression is worked out once.
_TEST = "|".join(
    [
        f"(?:^|/)(?i:{_either(TEST_FOLDERS)})(?:/|\\z)",
        r"(?:^|/)(?i:test_)[^/]*\z",
        r"(?i:\.test\.|\.spec\.)[^/]*\z",
        f"(?:^|/)(?i:{_either(TEST_NAMES)})\\z",
        f"{_either(TEST_SUFFIXES_EXACT)}\\z",
        f"(?i:{_either(TEST_SUFFIXES)})\\z",
    ]
)
_ENTRY = "(?:^|/)" + _either([p[1:] for p in ENTRY_PATTERNS])


def is_test_path(path: str | Column) -> Column:
    return normalised(path).rlike(_TEST)


def is_default_entry(path: str | Column) -> Column:
    return normalised(path).rlike(_ENTRY)


def is_config_like(path: str | Column) -> Column:
    low = F.lower(_c(path))
    return low.contains("config") | low.endswith("build.rs")


def identity_key(*parts: str | Column) -> Column:
    """Fingerprint: parts joined by |, which is escaped in them."""
    return F.concat_ws("|", *[F.replace(F.coalesce(_c(p).cast("string"), F.lit("")), F.lit("|"), F.lit("%7C")) for p in parts])


def millis(ratio: Column) -> Column:
    return F.round(ratio * 1000).cast("int")


def leaf_name(name: str | Column) -> Column:
    r"""What stands after the last ::, \, . or /."""
    return F.regexp_extract(_c(name), r"([^:\\./]*)$", 1)


def line_of(text: Column, before: Column) -> Column:
    """1-based line of a place, given the text before it."""
    return F.size(F.split(before, "\n", -1))


def is_comment_line(trimmed: Column) -> Column:
    return any_of(*[trimmed.startswith(p) for p in ("//", "*", "/*", "#")])


def is_constant_shaped(value: Column) -> Column:
    """A literal that looks like a constant: no blanks around, no marks of code, and an upper-case letter, digit or separator."""
    return (F.trim(value) == value) & ~value.rlike(r"""['"$()%<>={}]""") & value.rlike("[A-Z0-9./:@]")


def is_printf(value: Column) -> Column:
    return value.rlike(r"^(%\d+\$[bcdeEufFgGosxX]|%[bcdeEufFgGosxX])+$")


def is_control_escape(value: Column) -> Column:
    return value.rlike(r"^(\\[rnt]|\\u\{[0-9A-Fa-f]+\}|&#1[03];)+$")


def is_css_classes(value: Column) -> Column:
    return value.rlike(r"^\s*[a-z0-9:/.\[\]%!_#,@-]+(\s+[a-z0-9:/.\[\]%!_#,@-]+)*\s*$") & (value.rlike("[-:]") | value.rlike(r"\S\s+\S"))


def redacted(text: Column) -> Column:
    """Bearer tokens and keys in error texts, masked."""
    out = F.regexp_replace(text, r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 [redacted]")
    return F.regexp_replace(out, r"(?i)\b(api[-_]?key|token|secret|password)(\"?\s*[:=]\s*\"?)[^\s\",]+", "$1$2[redacted]")


def name_words(name: Column) -> Column:
    """Lower-case words of an identifier of any style."""
    return F.transform(F.regexp_extract_all(name, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), F.lit(1)), F.lower)


def name_style(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "constant")
        .when(name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z]+[A-Z][A-Za-z0-9]*$"), "camel")
        .otherwise("other")
    )


def glob_regex(glob: str) -> str:
    """A path glob (* within a segment, ** over segments, ?) as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or (c if c.isalnum() or c in "_/-" else "\\" + c)
            i += 1
    return f"^{out}$"
