"""Inputs: repository scans, admission, fingerprints, structure, reuse, configuration and tool reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import expr as E

#: Directories that are never scanned; files that make the semantic environment.
IGNORED = [".git", "vendor", "node_modules", "storage", "__pycache__", "tmp", "dist", "build", "target", "coverage"]
ENVIRONMENT = ["composer.json", "composer.lock", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "tsconfig.json", "jsconfig.json", "Cargo.toml", "Cargo.lock", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile", "Pipfile.lock", "poetry.lock", "Gemfile", "Gemfile.lock", ".ruby-version", "rust-toolchain.toml"]


def scan(spark: SparkSession, root: str, ignored: list[str] | None = None, hidden: bool = False) -> DataFrame:
    """(relative_path, size_bytes, modified_at, content_hash, content) of all files below root, on any store Spark reads."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return pruned(below(raw, root), IGNORED if ignored is None else ignored, hidden)


def below(raw: DataFrame, root: str) -> DataFrame:
    """Rows of the binary file source with paths relative to root."""
    base = re.sub(r"/+$", "", root)
    plain = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    bare = re.sub("^[a-z0-9]+:(//[^/]*)?", "", base)
    return raw.select(F.substring(plain, len(bare) + 2, 1 << 30).alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.xxhash64("content").alias("content_hash"), "content")


def empty(spark: SparkSession) -> DataFrame:
    """No files."""
    return spark.createDataFrame([], "relative_path string, size_bytes long, modified_at timestamp, content_hash long, content binary")


def pruned(files: DataFrame, ignored: list[str] = IGNORED, hidden: bool = False) -> DataFrame:
    """Without ignored directories and, unless asked for, hidden ones."""
    parts = F.split("relative_path", "/")
    drop = F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(ignored) if ignored else F.lit(False))
    if not hidden:
        drop = drop | F.exists(parts, lambda p: p.startswith("."))
    return files.filter(~drop)


def prefixes_of(path: str) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def included(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Paths that are, or lie under, one of the prefixes; all if there is none."""
    if not prefixes:
        return files
    return files.filter(F.arrays_overlap(prefixes_of("relative_path"), F.array(*[F.lit(p.rstrip("/")) for p in prefixes])))


def scan_config(text: str | None, defaults: dict | None = None) -> dict:
    """Repository settings over the caller's. Generated prefixes must be relative, without '..'."""
    out = {"include": [], "ignore": list(IGNORED), "generated": [], "hidden": False} | (defaults or {}) | (json.loads(text) if text else {})
    for p in out["generated"]:
        if p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"generated prefix {p!r} must be relative and stay inside")
    return out


def boundary_truth(root: str, top_level: str | None, prefixes: list[str]) -> str:
    return "TruncatedSlice" if prefixes or (top_level is not None and top_level.rstrip("/") != root.rstrip("/")) else "CompleteRepository"


def sources(files: DataFrame) -> DataFrame:
    """(file_path, text) of admitted files."""
    return admitted(files).select(F.col("relative_path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def admitted(files: DataFrame) -> DataFrame:
    return files.withColumn("language", E.language("relative_path")).filter("language is not null")


def language_coverage(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(E.language("relative_path"), F.lit("Unsupported")).alias("language")).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def structure(files: DataFrame) -> DataFrame:
    """(parent, child, is_file): directories and files with what contains them; the root is ''."""
    parts = F.split("relative_path", "/")
    steps = F.explode(F.sequence(F.lit(1), F.size(parts)))
    x = files.select(parts.alias("p"), steps.alias("i"))
    return x.select(F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "/").alias("parent"), F.array_join(F.slice("p", F.lit(1), F.col("i")), "/").alias("child"), (F.col("i") == F.size("p")).alias("is_file")).distinct()


def _digest(rows: DataFrame, order: str, part) -> DataFrame:
    """One digest over ordered rows. Each of 256 shares by hash of the key is digested by itself, so no task holds all of them."""
    x = rows.select(F.col(order).alias("o"), part.alias("p"), F.pmod(F.xxhash64(order), F.lit(256)).alias("k"))
    share = x.groupBy("k").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]), "\n"), 256).alias("h"))
    return share.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), "\n"), 256).alias("fingerprint"))


def input_fingerprint(files: DataFrame) -> DataFrame:
    return _digest(files, "relative_path", F.concat_ws("|", "relative_path", F.col("content_hash").cast("string")))


def environment_fingerprint(files: DataFrame) -> DataFrame:
    names = files.sparkSession.createDataFrame([(x,) for x in ENVIRONMENT], "relative_path string")
    x = names.join(files.select("relative_path", "size_bytes", "content_hash"), "relative_path", "left")
    return _digest(x, "relative_path", F.concat_ws("|", "relative_path", F.col("size_bytes").isNotNull().cast("string"), F.col("size_bytes").cast("string"), F.col("content_hash").cast("string")))


def reuse(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """(relative_path, status): what of a saved analysis still holds; missing files decline it."""
    m = manifest.select("relative_path", F.col("content_hash").alias("__h"))
    status = F.when(F.col("__h").isNull(), "new").when(F.col("content_hash").isNull(), "gone").when(F.col("__h") == F.col("content_hash"), "reused").otherwise("changed")
    return now.select("relative_path", "content_hash").join(m, "relative_path", "full").select("relative_path", status.alias("status"))


def can_load(now: DataFrame, manifest: DataFrame, identity: dict, saved: dict) -> bool:
    """Whether a saved graph may stand in: the same identities, and every file the same. Any doubt declines."""
    return identity == saved and not reuse(now, manifest).filter("status != 'reused'").head(1)


def is_stable(before: DataFrame, after: DataFrame) -> bool:
    """Whether the inputs stayed as they were during an analysis."""
    cols = ["relative_path", "size_bytes", "content_hash"]
    a, b = before.select(*cols), after.select(*cols)
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def supplemental(files: DataFrame, inside: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Texts outside the slice that may mention what is inside, and the gaps: files too large to read."""
    out = files.join(inside.select("relative_path"), "relative_path", "left_anti")
    return out.filter(F.col("size_bytes") <= most), out.filter(F.col("size_bytes") > most).select("relative_path", F.lit("too_large").alias("gap"))


def module_symbols(files: DataFrame) -> DataFrame:
    """One Module symbol for each file."""
    return files.select(F.concat(F.lit("module:"), "path").alias("id"), F.col("path").alias("file_path"), F.lit("Module").alias("kind"), F.regexp_replace(E.file_name("path"), r"\.[^.]+$", "").alias("name"), F.col("path").alias("qualified_name"))


def jsonc(text: str) -> str:
    """JSON with comments and trailing commas as JSON."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out, flags=re.S)


def path_aliases(configs: dict[str, str], start: str = "tsconfig.json") -> dict[str, list[str]]:
    """compilerOptions.paths of a chain of configurations (path → text), nearer ones first."""
    seen: set[str] = set()
    out: dict[str, list[str]] = {}
    at: str | None = start
    while at and at in configs and at not in seen:
        seen.add(at)
        spec = json.loads(jsonc(configs[at]))
        folder = at.rpartition("/")[0]
        base = spec.get("compilerOptions", {}).get("baseUrl", ".")
        for alias, goals in spec.get("compilerOptions", {}).get("paths", {}).items():
            out.setdefault(alias, ["/".join(p for p in (folder, base.strip("./"), g.removeprefix("./")) if p) for g in goals])
        up = spec.get("extends")
        at = None if not up else "/".join(p for p in (folder, up.removeprefix("./")) if p)
        if at and not at.endswith(".json"):
            at += ".json"
    return out


def namespaces(composer: str) -> dict[str, list[str]]:
    """PSR-4 prefixes of a composer file."""
    spec, out = json.loads(composer), {}
    for part in ("autoload", "autoload-dev"):
        for prefix, dirs in spec.get(part, {}).get("psr-4", {}).items():
            out.setdefault(prefix, []).extend([dirs] if isinstance(dirs, str) else dirs)
    return out


#: Outside tools, where their reports keep findings, and which fields say what.
TOOLS = {
    "ruff": ("[]", "filename", "location.row", "code", "message", "Low"),
    "gitleaks": ("[]", "File", "StartLine", "RuleID", "Description", "High"),
    "pip-audit": ("dependencies[].vulns[]", None, None, "id", "description", "High"),
    "osv-scanner": ("results[].packages[].vulnerabilities[]", None, None, "id", "summary", "High"),
    "composer-audit": ("advisories{}[]", None, None, "advisoryId", "title", "High"),
    "npm-audit": ("vulnerabilities{}", None, None, "name", "title", "Medium"),
    "cargo-deny": ("[]", None, None, "fields.code", "fields.message", "Medium"),
    "cargo-clippy": ("[]", "message.spans.0.file_name", "message.spans.0.line_start", "message.code.code", "message.message", "Low"),
}


def tool_findings(spark: SparkSession, tool: str, report: str | None, complete: bool = True) -> DataFrame:
    """A tool's JSON report as findings. A run that didn't complete gives one row that blocks a clean verdict."""
    rows: list[tuple] = []
    where, path, line, rule, message, severity = TOOLS[tool]

    def get(x, name):
        for key in (name or "").split(".") if name else ():
            x = x[int(key)] if isinstance(x, list) and key.isdigit() and int(key) < len(x) else x.get(key) if isinstance(x, dict) else None
        return x if name else None

    def walk(x, steps):
        if not steps:
            yield x
            return
        name, many = re.match(r"^([^\[{]*)(\[\]|\{\})?(.*)$", steps[0]).group(1, 2)
        x = get(x, name) if name else x
        parts = [x] if not many else list(x.values()) if many == "{}" and isinstance(x, dict) else x if isinstance(x, list) else []
        rest = steps[0][len(name) + len(many or "") :]
        for p in parts:
            yield from walk(p, ([rest] if rest else []) + steps[1:])

    if complete and report is not None:
        for f in walk(json.loads(report), where.split(".")):
            rows.append((tool, get(f, path), get(f, line), str(get(f, rule)), get(f, message), severity, True))
    else:
        rows.append((tool, None, None, "incomplete", "the tool did not complete", "High", False))
    return spark.createDataFrame(rows, "tool string, file_path string, line int, rule string, message string, severity string, complete boolean")
