"""What a reader sees first: overview, highlights, zones, wiring, state flows and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators import graph as gr

#: Prefixes of methods by what they do to a slot of state.
WRITERS, READERS, RESETTERS, DERIVERS = ["add", "set", "push", "register"], ["get", "has", "is", "all"], ["reset", "clear", "remove"], ["build", "compile", "make"]


def is_config_boundary(path: str | Column) -> Column:
    p = F.lower(E.normalised(path))
    return p.rlike(r"(^|/)config(s|uration)?(/|\.)") | E.file_name(p).rlike(r"^(settings|env|environment)\b")


def is_container_boundary(path: str | Column) -> Column:
    p = F.lower(E.normalised(path))
    return p.rlike(r"(^|/)(providers?|bootstrap|container|factories|factory|di)(/|\.)") | p.rlike(r"(serviceprovider|factory|container|kernel)\.php$")


def is_non_runtime(path: str | Column) -> Column:
    """Migrations, seeders, fixtures and tests: code that doesn't run in production."""
    p = F.lower(E.normalised(path))
    return E.is_test_path(path) | p.rlike(r"(^|/)(migrations?|seeders?|seeds|fixtures|factories|stubs|examples?)/")


def is_generated(text: str | Column) -> Column:
    head = F.lower(F.substring(F.col(text) if isinstance(text, str) else text, 1, 600))
    return head.rlike(r"@generated|do not edit|auto-?generated|code generated by")


def effective_entries(nodes: DataFrame, links: DataFrame, routes: DataFrame) -> dict[str, DataFrame]:
    """Entries by default and by declared routes (routes: file_path), and the orphans that are none."""
    z = gr.zero_inbound(nodes, links)
    entries = z.filter("status = 'runtime_entry'").select("path").union(routes.select(F.col("file_path").alias("path"))).distinct()
    return {"entries": entries, "orphans": z.filter("status = 'orphan'").select("path").join(entries, "path", "left_anti")}


def overview(files: DataFrame, symbols: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of counters. Each is an aggregate of one row before they meet."""
    parts = [
        files.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("language").alias("languages")),
        symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("kind") == "Class").alias("classes")),
        edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("layer") == "Structural").alias("structural_edges"), F.count_if(F.col("kind") == "Overrides").alias("overrides"), F.count_if(F.col("strength") == "Inferred").alias("inferred_edges")),
        findings.agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("path").alias("files_with_findings")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def highlights(findings: DataFrame, top: int = 5) -> DataFrame:
    """The worst findings of each family. At most `top` of a family go on from each task's share of it."""
    w = Window.partitionBy("family", "salt").orderBy(F.desc("severity_millis"), "path", "fingerprint")
    few = findings.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(64))).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= top)
    again = few.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("severity_millis"), "path", "fingerprint")))
    return again.filter(F.col("rank") <= top).select("family", "rank", "fingerprint", "path", "severity_millis")


def zones(files: DataFrame, findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Per zone: files, bytes, languages, entries, findings. files: path, language, size_bytes."""
    f = files.groupBy(E.zone("path").alias("zone")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    n = findings.groupBy(E.zone("path").alias("zone")).agg(F.count(F.lit(1)).alias("findings"))
    e = entries.groupBy(E.zone("path").alias("zone")).agg(F.count(F.lit(1)).alias("entries"))
    return f.join(n, "zone", "full").join(e, "zone", "full").na.fill(0, ["files", "bytes", "findings", "entries"])


def wiring(symbols: DataFrame, edges: DataFrame, registrations: DataFrame) -> DataFrame:
    """Per class or interface: who registers, implements and calls it. registrations: symbol_id."""
    c = symbols.filter(F.col("kind").isin("Class", "Interface", "Trait", "Struct")).select("id", "kind", "file_path")
    to = edges.groupBy(F.col("target_symbol_id").alias("id")).agg(F.count_if(F.col("relation_kind") == "Implements").alias("implementers"), F.count_if(F.col("relation_kind") == "Extends").alias("subclasses"), F.count_if(F.col("relation_kind") == "Call").alias("calls"), F.count_if(F.col("relation_kind") == "ContainerResolution").alias("resolutions"))
    reg = registrations.groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("registrations"))
    return c.join(to, "id", "left").join(reg, "id", "left").na.fill(0)


def state_flows(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Writers and readers of one slot of a carrier class: add/set X with get/has X; the closest pair of each slot."""
    word = F.regexp_extract("name", r"^([a-z]+)", 1)
    slot = F.lower(F.regexp_replace("name", r"^[a-z]+_?", ""))
    role = F.when(word.isin(WRITERS), "writer").when(word.isin(READERS), "reader").when(word.isin(RESETTERS), "reset").when(word.isin(DERIVERS), "deriver")
    m = symbols.filter("kind = 'Method' and parent_symbol_id is not null").select(F.col("parent_symbol_id").alias("carrier"), "id", "name", role.alias("role"), F.regexp_replace(slot, "s$", "").alias("slot"), "start_line").filter("role is not null and slot != ''")
    used = edges.filter("kind = 'Call'").groupBy(F.col("target_symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("uses"))
    m = m.join(used, "id", "left").na.fill(0, ["uses"])
    w, r = m.filter("role = 'writer'"), m.filter("role = 'reader'")
    # Of a slot's writers and readers only the most used of each can be the pair.
    best = lambda x, p: x.groupBy("carrier", "slot").agg(F.max(F.struct("uses", (-F.col("start_line")).alias("l"), "id")).alias(p))
    pair = best(w, "w").join(best(r, "r"), ["carrier", "slot"])
    confidence = F.least(F.lit(780), 560 + F.when((F.col("w.uses") > 0) & (F.col("r.uses") > 0), 120).otherwise(0) + F.when(F.abs(F.col("w.l") - F.col("r.l")) <= 40, 60).otherwise(0))
    return pair.select("carrier", "slot", F.col("w.id").alias("writer"), F.col("r.id").alias("reader"), confidence.cast("int").alias("confidence_millis"))


def packets(reviewed: DataFrame, centrality: DataFrame, budget: int = 8) -> DataFrame:
    """Work packets: visible findings by file, the weightiest files first, as many as the budget allows."""
    x = reviewed.filter("status = 'Visible'").groupBy("path").agg(F.count(F.lit(1)).alias("findings"), F.max("severity_millis").alias("worst"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    x = x.join(centrality, "path", "left").na.fill(0, ["centrality_millis"])
    return x.withColumn("weight", F.col("worst") + 40 * F.least("findings", F.lit(10)) + F.least(F.floor(F.col("centrality_millis") / 10), F.lit(300))).orderBy(F.desc("weight"), "path").limit(budget)


#: Framework calls that cost when repeated, by catalog; and container lookups that belong at the border.
CATALOGS = {
    "laravel": [("laravel_db_query_in_loop", r"\bDB::(?:table|select|query)\s*\(|->(?:where|find|first|get)\s*\("), ("laravel_http_call_in_loop", r"\bHttp::\w+\s*\("), ("laravel_cache_lookup_in_loop", r"\bCache::(?:get|remember|has)\s*\(")],
    "django": [("django_db_query_in_loop", r"\.objects\.(?:get|filter|all|create)\s*\("), ("django_http_call_in_loop", r"\brequests\.\w+\s*\("), ("django_cache_lookup_in_loop", r"\bcache\.(?:get|get_or_set)\s*\(")],
    "rails": [("rails_db_query_in_loop", r"\b[A-Z]\w*\.(?:find|where|find_by|first)\b"), ("rails_http_call_in_loop", r"\bNet::HTTP\b|\bFaraday\b"), ("rails_cache_lookup_in_loop", r"\bRails\.cache\.(?:read|fetch)\b")],
}
CONTAINER_LOOKUP = r"\bapp\s*\(\s*['\"\w]|\bresolve\s*\(\s*['\"\w]|->make\s*\(|container\.get\s*\("
RAW_ENV = {"Php": r"\benv\s*\(|\bgetenv\s*\(|\$_ENV\b", "Python": r"\bos\.(?:environ|getenv)\b", "JavaScript": r"\bprocess\.env\b", "TypeScript": r"\bprocess\.env\b", "Ruby": r"\bENV\b", "Rust": r"\benv::var(?:_os)?\b"}


def catalogs_for(manifests: list[str]) -> list[str]:
    """Catalogs by what a repository's manifests name."""
    text = " ".join(manifests).lower()
    return [name for name, mark in (("laravel", "laravel/framework"), ("django", "django"), ("rails", "rails")) if mark in text]


def misuse(lines: DataFrame) -> DataFrame:
    """(file_path, line, rule): raw environment reads outside configuration, container lookups away from the border."""
    language = E.language("file_path")
    env = F.coalesce(*[F.when((language == k) & F.col("content").rlike(p), F.lit(f"framework_misuse/{k.lower()}/raw_env_outside_config")) for k, p in RAW_ENV.items()])
    look = F.when((language == "Php") & F.col("content").rlike(CONTAINER_LOOKUP) & ~is_container_boundary("file_path"), F.lit("framework_misuse/php/raw_container_lookup_outside_boundary"))
    x = lines.filter(~E.is_comment_line(F.trim("content")) & ~E.is_test_path("file_path"))
    rules = F.array_compact(F.array(F.when(~is_config_boundary("file_path"), env), look))
    return x.select("file_path", "line", F.explode(rules).alias("rule"))
