"""Text detectors over lines of code: literals, networks, environments, dangerous calls, inputs, contracts, loop costs."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.functions import masks
from codeloom.operators.graph import dealt

#: Patterns of literals in a line.
MAGIC = r'(?:==|!=)\s*"([^"\n]{3,})"'
NETWORK = r'"(https?://[^"\s]+)"'
ENV_CALL = r"env::(var|var_os)\("
QUOTED = r'"([^"\n]+)"'

#: Dangerous calls by language, category and label; the first that matches a line counts.
DANGEROUS = [
    ("Php", "CommandExecution", "php-command-exec", r"(^|[^A-Za-z0-9_>:$\\])(exec|system|passthru|shell_exec|proc_open|popen)\s*\("),
    ("Php", "CodeInjection", "php-eval", r"(^|[^A-Za-z0-9_>:$\\])eval\s*\("),
    ("Php", "UnsafeDeserialization", "php-unserialize", r"(^|[^A-Za-z0-9_>:$\\])unserialize\s*\("),
    ("Python", "CommandExecution", "python-command-exec", r"\bos\.system\s*\(|\bsubprocess\.(Popen|call|run|check_call|check_output)\s*\("),
    ("Python", "CodeInjection", "python-eval", r"(^|[^A-Za-z0-9_.])(eval|exec)\s*\("),
    ("Python", "UnsafeDeserialization", "python-deserialize", r"\bpickle\.(load|loads)\s*\(|\byaml\.load\s*\("),
    ("Ruby", "CommandExecution", "ruby-command-exec", r"\b(system|exec)\s*\(|\bIO\.popen\s*\("),
    ("Ruby", "CodeInjection", "ruby-eval", r"\b(eval|instance_eval|class_eval)\s*\("),
    ("Ruby", "UnsafeDeserialization", "ruby-deserialize", r"\b(Marshal|YAML)\.load\s*\("),
    ("JavaScript", "CommandExecution", "javascript-command-exec", r"\bchild_process\.(exec|execSync)\s*\("),
    ("JavaScript", "CodeInjection", "javascript-eval", r"\beval\s*\(|\bnew\s+Function\s*\("),
    ("JavaScript", "UnsafeHtmlOutput", "javascript-html-output", r"\.\s*(innerHTML|outerHTML)\s*=|\bdocument\.write\s*\("),
]
#: Hardened forms that don't count, seen in the unmasked line.
HARDENED = {"php-unserialize": r"['\"]allowed_classes['\"]\s*=>\s*false\b", "python-deserialize": r"SafeLoader", "javascript-html-output": r"\.(innerHTML|outerHTML)\s*=\s*(''|\"\"|``)"}

#: Marks of boundary input by language and kind, in order; those with an upper-case letter are case-sensitive.
INPUTS = [
    ("Php", "RequestQuery", ["$_get[", "->query("]),
    ("Php", "RequestBody", ["$_post[", "->post(", "->json(", "->getcontent("]),
    ("Php", "RequestInput", ["$_request[", "->input("]),
    ("Php", "RequestParams", ["->route("]),
    ("Php", "CliArgument", ["$argv"]),
    ("Python", "RequestQuery", ["request.GET", "request.args"]),
    ("Python", "RequestBody", ["request.POST", "request.body", "request.data", "request.form", "request.get_json("]),
    ("Python", "RequestParams", ["request.query_params"]),
    ("Python", "CliArgument", ["sys.argv"]),
    ("JavaScript", "RequestQuery", ["req.query", "request.query"]),
    ("JavaScript", "RequestBody", ["req.body", "request.body"]),
    ("JavaScript", "RequestParams", ["req.params", "request.params", "ctx.params"]),
    ("JavaScript", "CliArgument", ["process.argv"]),
    ("Ruby", "RequestQuery", ["request.query_parameters"]),
    ("Ruby", "RequestBody", ["request.request_parameters", "request.body"]),
    ("Ruby", "RequestParams", ["params[", "params.fetch(", "request.params"]),
    ("Ruby", "CliArgument", ["ARGV"]),
]
INPUT_RANK = ["RequestQuery", "RequestBody", "RequestParams", "RequestInput", "CliArgument"]
SEVERITIES = ["Low", "Medium", "High"]


def lines_of(sources: DataFrame, text: str = "text") -> DataFrame:
    """sources → (file_path, line, content), lines from 1."""
    return sources.select("file_path", F.posexplode(F.split(text, "\r?\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


def code_lines(lines: DataFrame, test_ranges: DataFrame | None = None) -> DataFrame:
    """Lines that are code: no comments, no tests by path, none inside test_ranges (file_path, start, end)."""
    out = lines.filter(~E.is_comment_line(F.trim("content")) & ~E.is_test_path("file_path"))
    if test_ranges is not None:
        r = test_ranges.select(F.col("file_path").alias("f"), "start", "end")
        out = out.join(r, (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("start"), F.col("end")), "left_anti")
    return out


def _found(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.filter(F.col("content").rlike(pattern)).select("file_path", "line", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(1))).alias("value"))


def magic_strings(lines: DataFrame) -> DataFrame:
    return _found(lines, MAGIC).select(F.lit("MagicString").alias("category"), "file_path", "line", "value")


def is_non_endpoint(value: Column, content: Column) -> Column:
    """Schemas, namespaces and links of markup: addresses that nothing connects to."""
    low, line = F.lower(value), F.lower(content)
    host = F.regexp_replace(low, "^https?://", "")
    schema = low.endswith(".xsd") | low.endswith(".dtd") | low.contains("/xmlschema") | host.rlike("^(www\\.)?w3\\.org/") | host.startswith("schemas.")
    before = F.lower(F.split_part(content, F.concat(F.lit('"'), value), F.lit(1)))
    attribute = F.regexp_extract(before, r"([a-z0-9]*)[\"'=\s]*$", 1)
    return schema | E.contains_any(line, ["xmlns", "<!doctype", "schemalocation"]) | attribute.isin("href", "src", "canonical")


def hardcoded_networks(lines: DataFrame) -> DataFrame:
    return _found(lines, NETWORK).filter(~is_non_endpoint(F.col("value"), F.col("content"))).select(F.lit("HardcodedNetwork").alias("category"), "file_path", "line", "value")


def env_outside_config(lines: DataFrame) -> DataFrame:
    """Environment reads outside configuration, where the call isn't within a string (an even number of quotes before it)."""
    before = F.regexp_extract("content", r"^(.*?)env::(?:var|var_os)\(", 1)
    quotes = F.length(F.regexp_replace(F.regexp_replace(before, r"\\.", ""), '[^"]', ""))
    return lines.filter(F.col("content").rlike(ENV_CALL) & (quotes % 2 == 0) & ~E.is_config_like("file_path")).select(F.lit("EnvOutsideConfig").alias("category"), "file_path", "line", F.trim("content").alias("value"))


def repeated_literals(lines: DataFrame, contracts: DataFrame | None = None, least_files: int = 2) -> DataFrame:
    """Every place of a constant-shaped literal that at least two files have. A common literal's files are counted first and joined back."""
    found = _found(lines, QUOTED)
    value, context = F.col("value"), F.lower("content")
    css = E.contains_any(context, ["class=", "classname=", "class:", "classname:"]) & E.is_css_classes(value)
    found = found.filter((F.octet_length("value") >= 4) & ~F.lower(value).rlike("^https?://") & E.is_constant_shaped(value) & ~E.is_printf(value) & ~E.is_control_escape(value) & ~css & ~value.contains("\\u{") & ~value.contains("\\x") & ~F.col("content").contains("e.g."))
    if contracts is not None:
        found = found.join(contracts.select("value").distinct(), "value", "left_anti")
    files = found.select("value", "file_path").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") >= least_files)
    return found.join(files, "value").select(F.lit("RepeatedLiteral").alias("category"), "file_path", "line", "value", "files")


def dangerous_calls(lines: DataFrame, masked: str = "content") -> DataFrame:
    """(file_path, line, language, category, label). `masked`: the column that holds the line with strings and comments blanked."""
    def of(lang: str) -> Column:
        chosen = None
        for own, category, label, pattern in DANGEROUS:
            if own == lang:
                hit = F.col(masked).rlike(pattern)
                if label in HARDENED:
                    hit &= ~F.col("content").rlike(HARDENED[label])
                found = F.lit(f"{category}/{label}")
                chosen = F.when(hit, found) if chosen is None else chosen.when(hit, found)
        return chosen

    found = _by_language(of).alias("c")
    out = _spoken(lines).select("*", found).filter("c is not null")
    return out.select("file_path", "line", "language", F.split_part("c", F.lit("/"), F.lit(1)).alias("category"), F.split_part("c", F.lit("/"), F.lit(2)).alias("label"), "content")


def _spoken(lines: DataFrame) -> DataFrame:
    """Lines of the languages that have rules, without comment lines."""
    language = F.replace(E.language("file_path"), F.lit("TypeScript"), F.lit("JavaScript"))
    x = lines.withColumn("language", language).filter(F.col("language").isin("Php", "Python", "JavaScript", "Ruby"))
    return x.filter(F.when(F.col("language").isin("Python", "Ruby"), ~F.ltrim("content").startswith("#")).otherwise(~F.col("content").rlike(r"^\s*(//|/\*|\*)")))


def _by_language(of) -> Column:
    out = None
    for lang in ("Php", "Python", "JavaScript", "Ruby"):
        out = F.when(F.col("language") == lang, of(lang)) if out is None else out.when(F.col("language") == lang, of(lang))
    return out


def boundary_inputs(lines: DataFrame) -> DataFrame:
    """(file_path, line, kind, evidence): lines that read what comes from outside."""

    def of(lang: str) -> Column:
        kind = None
        for own, name, marks in INPUTS:
            if own == lang:
                hit = E.any_of(*[F.col("content").contains(m) if m != m.lower() else F.lower("content").contains(m) for m in marks])
                kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        return kind

    return _spoken(lines).select("*", _by_language(of).alias("kind")).filter("kind is not null").select("file_path", "line", "kind", F.trim("content").alias("evidence"))


def severities(calls: DataFrame, reachable: DataFrame, inputs: DataFrame) -> DataFrame:
    """calls with severity, contexts and the inputs that flow into them: of the same file, not below the call; first four by line and kind."""
    reach = reachable.select("path", F.lit(True).alias("__r")).distinct()
    x = calls.join(reach, calls.file_path == reach.path, "left").drop("path")
    i = inputs.select(F.col("file_path").alias("f"), F.col("line").alias("il"), "kind", "evidence")
    place = F.array_position(F.array(*map(F.lit, INPUT_RANK)), F.col("kind"))
    # Of a file's inputs only the first four can be among a call's first four, so each call meets one row with four inputs at most.
    few = i.distinct().withColumn("n", F.row_number().over(Window.partitionBy("f").orderBy("il", place, "evidence"))).filter("n <= 4")
    few = few.groupBy(F.col("f").alias("file_path")).agg(F.array_sort(F.collect_list(F.struct("n", "il", "kind"))).alias("few"))
    above = F.filter("few", lambda s: s["il"] <= F.col("line"))
    flows = F.when(F.size(above) > 0, F.transform(above, lambda s: F.concat_ws(":", s["il"].cast("string"), s["kind"])))
    x = x.join(few, "file_path", "left").withColumn("inputs", flows)
    base = F.when(F.col("category") == "UnsafeHtmlOutput", F.when(F.col("__r"), "Medium").otherwise("Low")).otherwise(F.when(F.col("__r"), "High").otherwise("Medium"))
    raised = F.when(F.col("inputs").isNull(), base).when(F.col("category") == "UnsafeHtmlOutput", "Medium").otherwise("High")
    p = F.lower(E.normalised("file_path"))
    contexts = F.array_compact(
        F.array(
            F.when(F.col("__r"), "ExternallyReachable"),
            F.when(p.contains("/management/commands/") | p.endswith("/shell.py"), "InteractiveExecution"),
            F.when((F.col("category") == "UnsafeDeserialization") & p.contains("/cache/"), "CacheStorage"),
            F.when(p.contains("/db/backends/"), "DatabaseTooling"),
            F.when(p.contains("/migrations/"), "MigrationSupport"),
            F.when(p.contains("/autoreload") | p.endswith("/version.py") | p.contains("/management/utils.py"), "DevelopmentRuntime"),
        )
    )
    return x.select("file_path", "line", "language", "category", "label", raised.alias("severity"), contexts.alias("contexts"), F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"))


def cross_file_flows(calls: DataFrame, reachable: DataFrame, inputs: DataFrame, ways: DataFrame) -> DataFrame:
    """severities, and for calls without an input above them in their own file the inputs of the file that the best way leads from (ways: path, way, see scanners.causal_ways).

    Such a call is rated as if the input stood in its file, with the context BoundaryInputReachableViaGraph (BoundaryInputInSameFile otherwise). flow: the first input,
    the files on the way, and the call.
    """
    x = severities(calls, reachable, inputs)
    place = F.array_position(F.array(*map(F.lit, INPUT_RANK)), F.col("kind"))
    few = inputs.select(F.col("file_path").alias("root"), "line", "kind", "evidence").distinct().withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("line", place, "evidence"))).filter("n <= 4")
    few = few.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line", "kind"))), lambda s: F.concat_ws(":", s["line"].cast("string"), s["kind"])).alias("theirs"))
    far = ways.select(F.col("path").alias("file_path"), "way", F.col("way")[0].alias("root")).join(few, "root")
    x = x.join(far.select("file_path", "way", "theirs"), "file_path", "left")
    own = F.size("inputs") > 0
    other = ~own & F.col("theirs").isNotNull()
    html = F.col("category") == "UnsafeHtmlOutput"
    first = F.when(own, F.concat_ws(":", "file_path", F.col("inputs")[0])).otherwise(F.concat_ws(":", F.col("way")[0], F.col("theirs")[0]))
    sink = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    return x.select(
        "file_path", "line", "language", "category", "label", F.when(other, F.when(html, "Medium").otherwise("High")).otherwise(F.col("severity")).alias("severity"),
        F.when(own, F.array_append("contexts", F.lit("BoundaryInputInSameFile"))).when(other, F.array_append("contexts", F.lit("BoundaryInputReachableViaGraph"))).otherwise(F.col("contexts")).alias("contexts"),
        F.when(other, F.col("theirs")).otherwise(F.col("inputs")).alias("inputs"), F.when(other, F.col("way")).otherwise(F.array().cast("array<string>")).alias("input_path"),
        F.when(own, F.array(first, sink)).when(other, F.concat(F.array(first), F.col("way"), F.array(sink))).otherwise(F.array().cast("array<string>")).alias("flow"),
    )


_VALUE = r"['\"`]([A-Za-z0-9_./:>?&=~%${}+-]+)['\"`]"
_CHANNEL = r"['\"`]([A-Za-z0-9_.:/${}-]+)['\"`]"
#: Contract patterns by category; group 1 is the value. A text without any of the words has no match (small letters, where case doesn't count).
CONTRACTS = [
    ("routes", r"#\[\s*Route\s*\([^]]*?\bpath\s*:\s*['\"](/[^'\"]*)['\"]", ("Route",)),
    ("routes", r"#\[\s*Route\s*\(\s*['\"](/[^'\"]*)['\"]", ("Route",)),
    ("routes", r"\b(?:Route|Router)(?:::|->)(?:get|post|put|patch|delete|options|any|match|resource|apiResource|view|redirect|prefix|group)\s*\(\s*['\"](/[^'\"]*)['\"]", ("Route",)),
    ("routes", r"\brouter\.(?:get|post|put|patch|delete|use|all)\s*\(\s*['\"`](/[^'\"`]*)['\"`]", ("router.",)),
    ("routes", r"\b(?:get|post|put|patch|delete|match)\s+['\"](/[^'\"]*)['\"]", ("get", "post", "put", "patch", "delete", "match")),
    ("routes", r"\bmount\s+[A-Z][A-Za-z0-9_:]+\s*=>\s*['\"](/[^'\"]*)['\"]", ("mount",)),
    ("hooks", r"\b(?:add_action|add_filter|do_action|apply_filters|register_activation_hook|register_deactivation_hook|register_uninstall_hook)\s*\(\s*['\"]([A-Za-z0-9_.:-]+)['\"]", ("_action", "_filter", "_hook")),
    ("registered_keys", r"(?i)\b(?:register_[A-Za-z0-9_]+|bind|singleton|alias|command|schedule)\s*\(\s*['\"]([A-Za-z0-9_.:-]+)['\"]", ("register_", "bind", "singleton", "alias", "command", "schedule")),
    ("env_keys", r"\benv\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]", ("env",)),
    ("env_keys", r"\bgetenv\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]", ("getenv",)),
    ("env_keys", r"\b(?:(?:std::)?env::(?:var|var_os)\s*\(\s*|(?:std::)?env!\s*\(\s*|option_env!\s*\(\s*)[\"']([A-Z][A-Z0-9_]*)[\"']", ("env::", "env!")),
    ("env_keys", r"\$_(?:ENV|SERVER)\s*\[\s*['\"]([A-Z][A-Z0-9_]*)['\"]\s*\]", ("$_ENV", "$_SERVER")),
    ("env_keys", r"\bos\.environ(?:\.get)?\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]", ("os.environ",)),
    ("env_keys", r"\bos\.environ\s*\[\s*['\"]([A-Z][A-Z0-9_]*)['\"]\s*\]", ("os.environ",)),
    ("env_keys", r"\bENV\.fetch\s*\(\s*['\"]([A-Z][A-Z0-9_]*)['\"]", ("ENV.fetch",)),
    ("env_keys", r"\bENV\s*\[\s*['\"]([A-Z][A-Z0-9_]*)['\"]\s*\]", ("ENV",)),
    ("env_keys", r"\bprocess\.env\.([A-Z][A-Z0-9_]*)", ("process.env.",)),
    ("env_keys", r"\bprocess\.env\s*\[\s*['\"]([A-Z][A-Z0-9_]*)['\"]\s*\]", ("process.env",)),
    ("env_keys", r"\bimport\.meta\.env\.([A-Z][A-Z0-9_]*)", ("import.meta.env.",)),
    ("config_keys", r"\bconfig\s*\(\s*['\"]([A-Za-z0-9_.:-]+)['\"]", ("config",)),
    ("config_keys", r"\b(?:get_option|update_option|add_option|delete_option|register_setting)\s*\(\s*['\"]([A-Za-z0-9_.:-]+)['\"]", ("_option", "register_setting")),
    ("channels", r"\bsocket\s*\.\s*(?:emit|send)\s*\(\s*" + _CHANNEL, ("socket",)),
    ("channels", r"\b(?:socket|io|ws)\s*\.\s*on\s*\(\s*" + _CHANNEL, ("socket", "io", "ws")),
    ("channels", r"\bEcho\s*\.\s*(?:channel|private|join|listen)\s*\(\s*" + _CHANNEL, ("Echo",)),
    ("channels", r"\bBroadcast::channel\s*\(\s*" + _CHANNEL, ("Broadcast::channel",)),
    ("channels", r"\bnew\s+(?:PrivateChannel|PresenceChannel|Channel)\s*\(\s*" + _CHANNEL, ("Channel",)),
    ("channels", r"(?:->|\.)publish\s*\(\s*" + _CHANNEL, ("publish",)),
    ("channels", r"(?:->|\.)p?subscribe\s*\(\s*" + _CHANNEL, ("subscribe",)),
    ("channels", r"(?:->|\.)trigger\s*\(\s*" + _CHANNEL, ("trigger",)),
    ("http_calls", r"\bHttp::(?:get|post|put|patch|delete|head)\s*\(\s*" + _VALUE, ("Http::",)),
    ("http_calls", r"\bfetch\s*\(\s*" + _VALUE, ("fetch",)),
    ("http_calls", r"\baxios\s*\.\s*(?:get|post|put|patch|delete|head)\s*\(\s*" + _VALUE, ("axios",)),
    ("http_calls", r"\baxios\s*\(\s*\{[^}]{0,200}?url\s*:\s*" + _VALUE, ("axios",)),
    ("http_calls", r"->request\s*\(\s*['\"](?:GET|POST|PUT|PATCH|DELETE|HEAD)['\"]\s*,\s*" + _VALUE, ("->request",)),
    ("http_calls", r"\bcurl_setopt\s*\([^,]+,\s*CURLOPT_URL\s*,\s*" + _VALUE, ("curl_setopt",)),
    ("http_calls", r"\bwp_remote_(?:get|post|request)\s*\(\s*" + _VALUE, ("wp_remote_",)),
    ("symbolic_literals", r"\bnew\s+CustomEvent\s*\(\s*['\"`]([^'\"`]+)['\"`]", ("CustomEvent",)),
    ("symbolic_literals", r"\bdata-controller\s*=\s*['\"]([A-Za-z0-9_:. -]+)['\"]", ("data-controller",)),
]
#: Build-tool constants that are no contract; categories of which changes are compared; packs of framework rules.
BUILD_CONSTANTS = ["MODE", "DEV", "PROD", "SSR", "BASE_URL"]
COMPARED = ["routes", "hooks", "registered_keys", "symbolic_literals", "env_keys", "config_keys"]
PACKS = [
    ("django_routes", "routes", r"\b(?:path|re_path)\s*\(\s*r?['\"]([^'\"]+)['\"]", ("path",)),
    ("django_signals", "hooks", r"\b([a-z_]+)\.(?:connect|send|send_robust)\s*\(", (".connect", ".send")),
    ("django_settings", "config_keys", r"\bsettings\.([A-Z][A-Z0-9_]*)", ("settings.",)),
    ("php_hook_maps", "hooks", r"['\"](?:hook|action|filter)['\"]\s*=>\s*['\"]([A-Za-z0-9_.:-]+)['\"]", ("hook", "action", "filter")),
    ("wordpress_rest_routes", "routes", r"\bregister_rest_route\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]", ("register_rest_route",)),
]


#: What holds several values: category, languages (none: all), the whole and each value in it, and words as above.
_WORDS = r"['\"][A-Za-z0-9_.:/-]+['\"]"
GROUPED = [
    ("symbolic_literals", ["TypeScript", "JavaScript"], rf"\btype\s+[A-Za-z0-9_<>,\s]+\s*=\s*\|?\s*((?:{_WORDS}\s*\|\s*)+{_WORDS})", r"['\"]([A-Za-z0-9_.:/-]+)['\"]", ("type",)),
    ("symbolic_literals", ["TypeScript", "JavaScript"], rf"[(:]\s*((?:{_WORDS}\s*\|\s*)+{_WORDS})\s*[;,)]", r"['\"]([A-Za-z0-9_.:/-]+)['\"]", ("|",)),
    ("symbolic_literals", ["TypeScript", "JavaScript"], rf"\[((?:\s*{_WORDS}\s*,?)+)\]\s+as\s+const", r"['\"]([A-Za-z0-9_.:/-]+)['\"]", ("const",)),
    ("registered_keys", ["Php"], r"(?is)\bregister_[A-Za-z0-9_]+\s*\(\s*array\s*\((.{0,2000}?)\)\s*\)", r"['\"]([A-Za-z0-9_.:-]+)['\"]\s*=>", ("register_",)),
    ("symbolic_literals", [], r"(?i)data-action\s*=\s*['\"]([^'\"]+)['\"]", r"(?:->)?([A-Za-z0-9_-]+)#", ("data-action",)),
]
#: A controller's file, which names it.
_BREAK = re.compile("\n")
_CONTROLLER = re.compile(r"(?i)/controllers/(.+)_controller\.(?:js|ts|jsx|tsx|vue)$")


def controller_of(path: str) -> str | None:
    """The identifier that markup uses for the controller of a file."""
    m = _CONTROLLER.search(path.replace("\\", "/"))
    return "--".join(x.replace("_", "-") for x in m[1].split("/") if x) or None if m else None


def contract_hits(sources: DataFrame, packs: bool = True) -> DataFrame:
    """(category, value, file_path, line, pack_id) over comment-masked texts; lines of matches over several lines need offsets, so a vectorised function finds them."""
    rules = [(c, None, re.compile(p), w) for c, p, w in CONTRACTS] + ([(c, pack, re.compile(p), w) for pack, c, p, w in PACKS] if packs else [])
    grouped = [(c, languages, re.compile(whole), re.compile(each), w) for c, languages, whole, each, w in GROUPED]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text, language in zip(pdf.file_path, pdf.text, pdf.language):
                code = masks.mask(text, language, strings=False)
                if named := controller_of(path or ""):
                    rows.append(("symbolic_literals", named, path, 1, None))
                if not code:
                    continue
                low = code.lower() if code.isascii() else None
                breaks: list[int] = []  # of the text, with one beyond it, found once

                def line(at: int) -> int:
                    if not breaks:
                        breaks.extend([*(m.start() for m in _BREAK.finditer(code)), len(code)])
                    return bisect_left(breaks, at) + 1

                def may(pattern: re.Pattern, words: tuple[str, ...]) -> bool:
                    within = low if pattern.flags & re.I else code
                    return within is None or any(w in within for w in words)

                for category, pack, pattern, words in rules:
                    if category == "routes" and language == "Python" and pack is None or not may(pattern, words):
                        continue
                    for m in pattern.finditer(code):
                        value = m[1].strip()
                        if value and value not in BUILD_CONSTANTS:
                            rows.append((category, value, path, line(m.start(1)), pack))
                for category, languages, whole, each, words in grouped:
                    if languages and language not in languages or not may(whole, words):
                        continue
                    for m in whole.finditer(code):
                        rows += [(category, v[1], path, line(m.start(1) + v.start(1)), None) for v in each.finditer(m[1])]
            yield pd.DataFrame(rows, columns=["category", "value", "file_path", "line", "pack_id"])

    x = sources.select("file_path", "text", E.language("file_path").alias("language"))
    return dealt(x).mapInPandas(run, "category string, value string, file_path string, line int, pack_id string")


def contract_inventory(hits: DataFrame, top: int = 50, samples: int = 5) -> DataFrame:
    """Per category the commonest values, with the first places. Places are numbered before they are gathered, so a value of very many places makes a short list."""
    w = Window.partitionBy("category", "value").orderBy("file_path", "line")
    first = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= samples).groupBy("category", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "file_path", "line"))), lambda s: F.concat_ws(":", s["file_path"], s["line"].cast("string"))).alias("locations"))
    counts = hits.groupBy("category", "value").agg(F.count(F.lit(1)).alias("count"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("count"), "value"))).filter(F.col("rank") <= top)
    return ranked.join(first, ["category", "value"])


def contract_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("category").agg(F.count_distinct("value").alias("unique_values"), F.count(F.lit(1)).alias("occurrences"))


def contract_delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """(category, value, change): added or removed values of the compared categories."""
    a, b = (x.filter(F.col("category").isin(COMPARED)).select("category", "value").distinct() for x in (before, now))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), ["category", "value"], "full")
    return both.filter("a is null or b is null").select("category", "value", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"))


#: What costs inside a loop, by subtype.
LOOP_COSTS = [
    ("sort", r"\b(sort|sorted|usort|uasort|uksort|ksort|rsort|sort_by|sort_unstable|sort_by_key)\s*\(|\.sort\s*\("),
    ("regex_compile", r"\bre\.compile\s*\(|\bnew\s+RegExp\s*\(|\bRegex::new\s*\(|\bRegexp\.new\s*\("),
    ("json_decode", r"\bjson_decode\s*\(|\bjson\.loads\s*\(|\bJSON\.parse\s*\(|\bserde_json::from_\w+\s*\("),
    ("filesystem_read", r"\bfile_get_contents\s*\(|\bopen\s*\(|\breadFileSync\s*\(|\bfs::read\w*\s*\(|\bFile\.read\s*\("),
    ("collection_scan", r"\bin_array\s*\(|\barray_search\s*\(|\.includes\s*\(|\.indexOf\s*\(|\.find\s*\("),
]
_LOOP = re.compile(r"^\s*(?:for|foreach|while|loop)\b")
_SMALL_SET = re.compile(r"[\[(]\s*(?:(?:'[^']*'|\"[^\"]*\"|\d+)\s*,?\s*){1,16}[\])]")


def loop_costs(sources: DataFrame) -> DataFrame:
    """(file_path, line, subtype, token): costs within loops, and loops within loops. Loop state runs over a file's lines: by indentation for Python, by braces elsewhere."""
    costs = [(n, re.compile(p)) for n, p in LOOP_COSTS]

    def scan(text: str, language: str) -> list[tuple[int, str, str]]:
        out, stack, depth = [], [], 0
        for no, line in enumerate((masks.mask(text, language) or "").split("\n"), 1):
            if not line.strip():
                continue
            level = len(line) - len(line.lstrip()) if language == "Python" else depth
            while stack and (level <= stack[-1]):
                stack.pop()
            is_loop = bool(_LOOP.match(line))
            if is_loop and stack:
                out.append((no, "nested_loop", line.strip()))
            if stack and not is_loop:
                for name, p in costs:
                    m = p.search(line)
                    if m and not (name == "collection_scan" and _SMALL_SET.search(text.split("\n")[no - 1])):
                        out.append((no, name, m[0].strip()))
            if is_loop:
                stack.append(level)
            depth += line.count("{") - line.count("}")
        return out

    def run(batches):
        for pdf in batches:
            rows = [(p, *r) for p, t, x in zip(pdf.file_path, pdf.text, pdf.language) if t and x for r in scan(t, x)]
            yield pd.DataFrame(rows, columns=["file_path", "line", "subtype", "token"])

    x = sources.select("file_path", "text", E.language("file_path").alias("language"))
    return x.mapInPandas(run, "file_path string, line int, subtype string, token string")
