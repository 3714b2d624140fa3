"""Structural rules: patterns with holes over the shapes of expressions, in loops or anywhere, by language and framework.

A vectorised pass turns each source into rows of sites and loops. All else is Spark: the rules are a small table that is
broadcast and met by language and last name, the pattern is a regular expression over the shape, and the loop that a site lies in is found by a window
over the file, since brackets make intervals either nested or apart: a site lies in a loop where the furthest end of the loops that began before it is not before its own.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.functions import masks, shapes
from codeloom.operators.graph import dealt

#: What is repeated in a loop, by language, subtype and patterns; `$$$ARGS` stands for any arguments, `$X` for one expression.
IN_LOOPS = [
    ("php", "collection_scan_in_loop", "in_array($$$ARGS)", "array_search($$$ARGS)"),
    ("php", "sort_in_loop", "sort($$$ARGS)", "usort($$$ARGS)", "ksort($$$ARGS)", "asort($$$ARGS)"),
    ("php", "json_decode_in_loop", "json_decode($$$ARGS)"),
    ("php", "filesystem_read_in_loop", "file_get_contents($$$ARGS)", "file_exists($$$ARGS)"),
    ("python", "sort_in_loop", "sorted($$$ARGS)", "$TARGET.sort()"),
    ("python", "regex_compile_in_loop", "re.compile($$$ARGS)"),
    ("python", "json_decode_in_loop", "json.loads($$$ARGS)", "json.load($$$ARGS)"),
    ("python", "filesystem_read_in_loop", "os.path.exists($$$ARGS)", "Path($$$ARGS).exists()", "Path($$$ARGS).read_text($$$ARGS)", "Path($$$ARGS).read_bytes()"),
    ("javascript", "collection_scan_in_loop", "$ARRAY.includes($$$ARGS)", "$ARRAY.find($$$ARGS)", "$ARRAY.some($$$ARGS)"),
    ("javascript", "sort_in_loop", "$ARRAY.sort($$$ARGS)"),
    ("javascript", "regex_compile_in_loop", "new RegExp($$$ARGS)"),
    ("javascript", "json_decode_in_loop", "JSON.parse($$$ARGS)"),
    ("javascript", "filesystem_read_in_loop", "fs.readFileSync($$$ARGS)", "fs.readFile($$$ARGS)", "fs.existsSync($$$ARGS)"),
    ("rust", "sort_in_loop", "$TARGET.sort()", "$TARGET.sort_by($$$ARGS)", "$TARGET.sort_unstable()", "$TARGET.sort_unstable_by($$$ARGS)"),
    ("rust", "regex_compile_in_loop", "Regex::new($$$ARGS)"),
    ("rust", "json_decode_in_loop", "serde_json::from_str($$$ARGS)", "serde_json::from_slice($$$ARGS)", "serde_json::from_reader($$$ARGS)"),
    ("rust", "filesystem_read_in_loop", "std::fs::read($$$ARGS)", "std::fs::read_to_string($$$ARGS)", "std::fs::metadata($$$ARGS)", "fs::read($$$ARGS)", "fs::read_to_string($$$ARGS)", "fs::metadata($$$ARGS)"),
]
#: The same by framework: language, framework, subtype, rule, patterns.
FRAMEWORK_LOOPS = [
    ("php", "laravel", "database_query_in_loop", "laravel_db_query_in_loop", "DB::select($$$ARGS)", "DB::insert($$$ARGS)", "DB::update($$$ARGS)", "DB::delete($$$ARGS)", "DB::statement($$$ARGS)", "DB::unprepared($$$ARGS)", "DB::table($$$ARGS)->get()", "DB::table($$$ARGS)->first()"),
    ("php", "laravel", "http_call_in_loop", "laravel_http_call_in_loop", "Http::get($$$ARGS)", "Http::post($$$ARGS)", "Http::put($$$ARGS)", "Http::patch($$$ARGS)", "Http::delete($$$ARGS)", "Http::send($$$ARGS)"),
    ("php", "laravel", "cache_lookup_in_loop", "laravel_cache_lookup_in_loop", "Cache::get($$$ARGS)", "Cache::has($$$ARGS)", "Cache::remember($$$ARGS)", "Cache::rememberForever($$$ARGS)", "Cache::many($$$ARGS)"),
    ("python", "django", "database_query_in_loop", "django_db_query_in_loop", "$MODEL.objects.get($$$ARGS)", "$MODEL.objects.filter($$$ARGS)", "$MODEL.objects.exists()", "$MODEL.objects.count()", "connection.cursor().execute($$$ARGS)"),
    ("python", "django", "http_call_in_loop", "django_http_call_in_loop", "requests.get($$$ARGS)", "requests.post($$$ARGS)", "requests.put($$$ARGS)", "requests.delete($$$ARGS)", "requests.request($$$ARGS)"),
    ("python", "django", "cache_lookup_in_loop", "django_cache_lookup_in_loop", "cache.get($$$ARGS)", "cache.get_many($$$ARGS)", "cache.has_key($$$ARGS)", "cache.get_or_set($$$ARGS)"),
    ("ruby", "rails", "database_query_in_loop", "rails_db_query_in_loop", "$MODEL.find($$$ARGS)", "$MODEL.find_by($$$ARGS)", "$MODEL.where($$$ARGS)", "$MODEL.exists?($$$ARGS)", "$MODEL.count($$$ARGS)"),
    ("ruby", "rails", "http_call_in_loop", "rails_http_call_in_loop", "Net::HTTP.get($$$ARGS)", "Net::HTTP.post($$$ARGS)", "Faraday.get($$$ARGS)", "Faraday.post($$$ARGS)"),
    ("ruby", "rails", "cache_lookup_in_loop", "rails_cache_lookup_in_loop", "Rails.cache.read($$$ARGS)", "Rails.cache.fetch($$$ARGS)", "Rails.cache.exist?($$$ARGS)"),
]
#: Dangerous calls by language, category, rule, name of the API and patterns.
DANGEROUS = [
    ("php", "command_execution", "command_exec", "php-command-exec", "exec($$$ARGS)", "system($$$ARGS)", "passthru($$$ARGS)", "shell_exec($$$ARGS)", "proc_open($$$ARGS)", "popen($$$ARGS)"),
    ("php", "code_injection", "eval", "php-eval", "eval($$$ARGS)", "assert($$$ARGS)"),
    ("php", "unsafe_deserialization", "unserialize", "php-unserialize", "unserialize($$$ARGS)"),
    ("python", "command_execution", "command_exec", "python-command-exec", "os.system($$$ARGS)", "subprocess.run($$$ARGS)", "subprocess.call($$$ARGS)", "subprocess.check_call($$$ARGS)", "subprocess.check_output($$$ARGS)", "subprocess.Popen($$$ARGS)"),
    ("python", "code_injection", "eval", "python-eval", "eval($$$ARGS)", "exec($$$ARGS)"),
    ("python", "unsafe_deserialization", "deserialize", "python-deserialize", "pickle.load($$$ARGS)", "pickle.loads($$$ARGS)", "yaml.load($$$ARGS)"),
    ("javascript", "command_execution", "command_exec", "javascript-command-exec", "child_process.exec($$$ARGS)", "child_process.execSync($$$ARGS)"),
    ("javascript", "code_injection", "eval", "javascript-eval", "eval($$$ARGS)", "new Function($$$ARGS)"),
    ("javascript", "unsafe_html_output", "html_output", "javascript-html-output", "document.write($$$ARGS)", "$TARGET.innerHTML = $VALUE", "$TARGET.outerHTML = $VALUE"),
    ("ruby", "command_execution", "command_exec", "ruby-command-exec", "system($$$ARGS)", "exec($$$ARGS)", "IO.popen($$$ARGS)"),
    ("ruby", "code_injection", "eval", "ruby-eval", "eval($$$ARGS)", "instance_eval($$$ARGS)", "class_eval($$$ARGS)"),
    ("ruby", "unsafe_deserialization", "deserialize", "ruby-deserialize", "Marshal.load($$$ARGS)", "YAML.load($$$ARGS)"),
]
#: Raw reads of the environment by language, and lookups in a framework's container.
RAW_ENV = [
    ("php", "env($$$ARGS)", "getenv($$$ARGS)", "$_ENV[$$$ARGS]"),
    ("python", "os.environ[$$$ARGS]", "os.environ.get($$$ARGS)", "os.getenv($$$ARGS)"),
    ("javascript", "process.env.$NAME", "process.env[$$$ARGS]"),
    ("ruby", "ENV[$$$ARGS]", "ENV.fetch($$$ARGS)"),
    ("rust", "std::env::var($$$ARGS)", "std::env::var_os($$$ARGS)", "env::var($$$ARGS)", "env::var_os($$$ARGS)", "env!($$$ARGS)", "option_env!($$$ARGS)"),
]
CONTAINER = ["app($CLASS)", "app()->make($CLASS)", "resolve($CLASS)", "App::make($CLASS)", "Container::getInstance()->make($CLASS)", "$this->app->make($CLASS)", "$app->make($CLASS)"]
#: What tells a framework's files, in paths and in lower-cased texts, by language.
FRAMEWORKS = {
    "laravel": ("php", ["/app/", "/routes/", "/bootstrap/", "/config/"], [], ["illuminate\\", "serviceprovider", "app(", "$this->app", "resolve(", "config("]),
    "django": ("python", ["/management/commands/"], ["/settings.py"], ["django.conf import settings", "django.core.cache", "settings.", "django.apps", "django.db"]),
    "rails": ("ruby", ["/config/environments/", "/config/initializers/", "/app/"], ["/config/application.rb"], ["rails.", "activesupport", "railtie"]),
}
#: Parts and ends of paths where the environment is read, and where a container is asked.
CONFIGURED = (["/config/", "/settings/"], ["/settings.py", "/wp-config.php", "/config.php"])
BORDER = (["/providers/", "/bootstrap/", "/config/", "/settings/", "/initializers/", "/dependencyinjection/", "/container/"], ["serviceprovider.php", "/container.php", "/container.rs"])
#: Languages of files → languages of rules.
RULED = {"Php": "php", "Python": "python", "JavaScript": "javascript", "TypeScript": "javascript", "Ruby": "ruby", "Rust": "rust"}
_HOLE = re.compile(r"\$\$\$[A-Z]+|\$[A-Z]+\b")


def _lies_in(place: tuple[list[str], list[str]]):
    path = F.concat(F.lit("/"), F.lower(E.normalised("file_path")))
    return E.contains_any(path, place[0]) | E.any_of(*[path.endswith(x) for x in place[1]])


def compiled(pattern: str) -> tuple[str, str]:
    """The name by which a pattern's sites are found, and its regular expression over shapes."""
    p = pattern.replace(" = $VALUE", "=")
    names = re.findall(r"[$@]?\w+[?!]?", _HOLE.sub(" ", p))
    name = names[-1].rstrip("!") if not names[-1].endswith("?") else names[-1]
    key = f"{name}.*" if re.search(r"\.\$[A-Z]+$", p) else f"{name}=" if p.endswith("=") else name
    out, at = "", 0
    for m in re.finditer(r"\(\$\$\$[A-Z]+\)|\[\$\$\$[A-Z]+\]|\(\$[A-Z]+\)|\(\)|\$[A-Z]+\b", p):
        out += re.escape(p[at : m.start()])
        hole = m[0]
        out += r"\(\d+\)" if hole.startswith("($$$") else r"\[\d+\]" if hole.startswith("[$$$") else r"\(0\)" if hole == "()" else r"\(1\)" if hole.startswith("($") else ".+" if not m.start() else r"[\w$]+"
        at = m.end()
    return key, f"^{out}{re.escape(p[at:])}$"


def rule_rows() -> list[tuple]:
    """(rules' language, framework, rule_id, family, subtype, api_name, looped, key, shape), one row for each pattern."""
    rows = []
    for language, subtype, *patterns in IN_LOOPS:
        rows += [(language, None, f"complexity/{language}/{subtype}", "algorithmic_complexity", subtype, None, True, *compiled(p)) for p in patterns]
    for language, framework, subtype, rule, *patterns in FRAMEWORK_LOOPS:
        rows += [(language, framework, f"complexity/{language}/framework/{rule}", "algorithmic_complexity", subtype, None, True, *compiled(p)) for p in patterns]
    for language, category, rule, api, *patterns in DANGEROUS:
        rows += [(language, None, f"security/{language}/{rule}", "security_dangerous_api", category, api, False, *compiled(p)) for p in patterns]
    for language, *patterns in RAW_ENV:
        rows += [(language, None, f"framework_misuse/{language}/raw_env_outside_config", "framework_misuse", "raw_env_outside_config", None, False, *compiled(p)) for p in patterns]
    return rows + [("php", "laravel", "framework_misuse/php/raw_container_lookup_outside_boundary", "framework_misuse", "raw_container_lookup_outside_boundary", None, False, *compiled(p)) for p in CONTAINER]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "ruled string, framework string, rule_id string, family string, subtype string, api_name string, looped boolean, key string, fits string")


def spans(sources: DataFrame) -> DataFrame:
    """sources (file_path, text) → sites and loops of the languages that have rules: file_path, language, is_loop, start, stop, line, key, shape, token, max_items.

    Only sites whose last name some pattern ends in are listed. Sources of null text and of other languages give nothing.
    """
    keys = frozenset(r[7] for r in rule_rows())

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text, language in zip(pdf.file_path, pdf.text, pdf.language):
                t = shapes.Tokens(masks.vue_script(text) if path.endswith(".vue") else text, language)
                found = shapes.sites(t, keys)
                if found:
                    rows += [(path, language, True, a, b, line, None, None, None, None) for a, b, line in shapes.loops(t)]
                    rows += [(path, language, False, a, b, line, key, shape, shapes.compact(t.text[a:b]), items) for a, b, line, key, shape, items in found]
            yield pd.DataFrame(rows, columns=["file_path", "language", "is_loop", "start", "stop", "line", "key", "shape", "token", "max_items"]).astype({"max_items": "Int32"})

    x = sources.select("file_path", "text", E.language("file_path").alias("language")).filter(F.col("language").isin(*RULED) & F.col("text").isNotNull())
    return dealt(x).mapInPandas(run, "file_path string, language string, is_loop boolean, start int, stop int, line int, key string, shape string, token string, max_items int")


def in_loops(found: DataFrame) -> DataFrame:
    """Sites, with whether a loop of their file holds them."""
    before = Window.partitionBy("file_path").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    furthest = F.max(F.when(F.col("is_loop"), F.col("stop"))).over(before)
    return found.withColumn("in_loop", F.coalesce(furthest >= F.col("stop"), F.lit(False))).filter(~F.col("is_loop")).drop("is_loop")


def frameworks(sources: DataFrame) -> DataFrame:
    """(file_path, framework) of files that show a framework's marks."""
    path, text = F.lower(E.normalised("file_path")), F.lower("text")
    language = F.col("ruled")
    marks = [F.when((language == lang) & (E.contains_any(path, inside) | (E.any_of(*[path.endswith(x) for x in ends]) if ends else F.lit(False)) | E.contains_any(text, words)), F.lit(name)) for name, (lang, inside, ends, words) in FRAMEWORKS.items()]
    ruled = F.create_map(*[F.lit(x) for pair in RULED.items() for x in pair])[E.language("file_path")]
    return sources.withColumn("ruled", ruled).select("file_path", F.explode(F.array_compact(F.array(*marks))).alias("framework"))


def structural_findings(sources: DataFrame) -> DataFrame:
    """sources (file_path, text) → rule_id, family, language, provenance, file_path, line, token, subtype, api_name, loop_family, max_items.

    Framework rules hold in files of the framework. Misuse is not reported where it belongs: environment reads in configuration, container
    lookups at the border. One finding for each file, rule, line and token.
    """
    spark = sources.sparkSession
    ruled = F.create_map(*[F.lit(x) for pair in RULED.items() for x in pair])[F.col("language")]
    sites = in_loops(spans(sources)).withColumn("ruled", ruled)
    met = sites.join(F.broadcast(rule_table(spark)), ["ruled", "key"]).filter(F.expr("shape RLIKE fits") & (~F.col("looped") | F.col("in_loop")))
    misuse = F.col("family") == "framework_misuse"
    allowed = ~(misuse & (((F.col("subtype") == "raw_env_outside_config") & _lies_in(CONFIGURED)) | ((F.col("subtype") == "raw_container_lookup_outside_boundary") & _lies_in(BORDER))))
    own = frameworks(sources).groupBy("file_path").agg(F.collect_set("framework").alias("of"))  # three at most
    met = met.filter(allowed).join(own, "file_path", "left").filter(F.col("framework").isNull() | F.coalesce(F.array_contains("of", F.col("framework")), F.lit(False)))
    # Environment reads in a framework's file are found by the framework's own rules, which are the same patterns.
    by = F.coalesce("framework", F.when(misuse, F.array_min("of")))
    loop_family = F.when(F.col("looped"), F.when(F.col("language") == "Python", "indent_loop").otherwise("brace_loop"))
    return met.select(
        "rule_id", "family", F.lower("language").alias("language"), F.concat_ws(".", F.lit("ast_grep.pattern"), by).alias("provenance"), "file_path", "line", "token", "subtype", "api_name", loop_family.alias("loop_family"),
        F.when(F.col("subtype") == "collection_scan_in_loop", F.col("max_items")).alias("max_items"),
    ).dropDuplicates(["file_path", "rule_id", "line", "token"])


def findings_by_family(findings: DataFrame) -> DataFrame:
    return findings.groupBy("family").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("file_path").alias("files"))
