"""A repository's analysis from its sources to its verdict, as lazy frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.functions import masks
from codeloom.operators import assess, bindings, deadcode, edges, graph, receivers, resolution, review, scanners, text
from codeloom.operators import rules as structural
from codeloom.sources import parsers, scan


@dataclass
class Analysis:
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["frames"][name]
        except KeyError:
            raise AttributeError(name) from None


def analyze(sources: DataFrame, before: DataFrame | None = None, rules: DataFrame | None = None, pivots: int | None = None, outside: DataFrame | None = None) -> Analysis:
    """sources (file_path, text), and texts `outside` that may mention what is in them: symbols, references, edges, graph metrics, findings, review and verdict. Bottlenecks are exact, or estimated from so many `pivots`."""
    rows = graph.cut(parsers.parsed(sources))
    files = sources.select(F.col("file_path").alias("path"), E.language("file_path").alias("language")).distinct()
    scoped = bindings.facts(sources)
    uses = graph.cut(bindings.bound_uses(scoped))
    symbols, outcomes = bindings.with_bound_symbols(parsers.symbols(rows), scoped), parsers.outcomes(rows)
    refs = edges.admitted_refs(bindings.with_bound_calls(parsers.refs(rows), uses))
    wanted = refs.filter("kind = 'Import'").select("file_path", F.col("target_name").alias("target"), "binding_name").join(files.select(F.col("path").alias("file_path"), "language"), "file_path")
    # An import may name a module or something in it.
    both = wanted.unionByName(wanted.withColumn("target", F.regexp_replace("target", r"(::|[.\\])[^.:\\]+$", "")))
    reached = resolution.import_targets(both.select("file_path", "language", "target").distinct(), files)
    imported = reached.select("file_path", "imported_path").distinct()
    none = symbols.select("file_path", F.col("name").alias("binding"), F.col("id").alias("qualified")).limit(0)
    calls = refs.filter("kind not in ('Import', 'TypeImport')").withColumn("target_name", E.leaf_name("target_name")).dropDuplicates(["ref_index"])
    resolved = resolution.resolve(calls, bindings.open_symbols(symbols, scoped), none, imported)
    # What the type of its receiver proves goes before what a name alone suggests.
    proven = receivers.member_calls(sources, files).select("file_path", "line", F.col("member").alias("target_name"), F.col("target_file_path").alias("tf"), F.col("target_line").alias("tl"))
    named = symbols.select(F.col("file_path").alias("tf"), F.col("start_line").alias("tl"), F.col("name").alias("target_name"), F.col("id").alias("target_symbol_id"))
    typed = calls.filter("call_form in ('Member', 'Associated')").join(proven, ["file_path", "line", "target_name"]).join(named, ["tf", "tl", "target_name"]).groupBy("ref_index").agg(F.min("target_symbol_id").alias("target_symbol_id"))
    typed = graph.cut(typed).select("ref_index", "target_symbol_id", F.lit("ImportScoped").alias("resolution_tier"), F.lit(900).alias("confidence_millis"))
    resolved = resolved.join(typed.select("ref_index"), "ref_index", "left_anti").select(*typed.columns).unionByName(typed)
    # The scopes of a file go before both.
    lexical = bindings.lexical_targets(calls, uses, symbols, scoped)
    resolved = resolution.with_lexical(resolved, calls, lexical).join(lexical.select("ref_index").distinct().withColumn("lexical", F.lit(True)), "ref_index", "left")
    s = symbols.select(F.col("id").alias("target_symbol_id"), F.col("file_path").alias("target_file_path"))
    made = calls.join(resolved, "ref_index").join(s, "target_symbol_id")
    found = made.select(
        F.xxhash64("ref_index", "target_symbol_id").alias("edge_index"), F.col("file_path").alias("source_file_path"), F.col("enclosing_symbol_id").alias("source_symbol_id"), "target_file_path", "target_symbol_id", F.col("target_name").alias("reference_target_name"), "kind",
        edges.relation_of(F.col("kind")).alias("relation_kind"), F.lit("Structural").alias("layer"), edges.strength_of(F.col("resolution_tier")).alias("strength"), F.lit("Resolver").alias("origin"), "resolution_tier", "confidence_millis", F.when(F.col("lexical"), F.concat(F.when(F.col("kind") == "Call", "call").otherwise("reference"), F.lit(":lexical-binding"))).otherwise(F.lower(F.concat_ws(":", "kind", "resolution_tier"))).alias("reason"), "line",
    )
    links = imported.select(F.xxhash64("file_path", "imported_path").alias("edge_index"), F.col("file_path").alias("source_file_path"), F.lit(None).cast("string").alias("source_symbol_id"), F.col("imported_path").alias("target_file_path"), F.concat(F.lit("module:"), "imported_path").alias("target_symbol_id"), F.col("imported_path").alias("reference_target_name"), F.lit("Import").alias("kind"), F.lit("Import").alias("relation_kind"), F.lit("Structural").alias("layer"), F.lit("Hard").alias("strength"), F.lit("Resolver").alias("origin"), F.lit("ImportScoped").alias("resolution_tier"), F.lit(900).alias("confidence_millis"), F.lit("import:path").alias("reason"), F.lit(1).alias("line"))
    e = graph.cut(edges.recovery_downgrade(edges.admitted_edges(edges.filled(found.unionByName(links))), outcomes))
    nodes, pairs = graph.file_graph(e)
    components = graph.strong_components(pairs)
    sources = sources.withColumn("text", F.when(F.col("file_path").endswith(".vue"), masks.vue_scripts("text")).otherwise(F.col("text")))
    ranges = sources.filter(F.col("file_path").endswith(".rs")).select("file_path", F.explode(masks.rust_test_ranges("text")).alias("r")).select("file_path", "r.start", "r.end")
    lines = text.lines_of(sources)
    code = text.code_lines(lines, ranges)
    masked = text.lines_of(sources.select("file_path", masks.mask_code("text", E.language("file_path")).alias("text"))).withColumnRenamed("content", "masked")
    calls_at = text.dangerous_calls(lines.join(masked, ["file_path", "line"]), "masked")
    entries = nodes.filter(E.is_default_entry("path"))
    inputs = graph.cut(text.boundary_inputs(lines))
    security = text.cross_file_flows(calls_at, entries, inputs, scanners.causal_ways(e, inputs.select(F.col("file_path").alias("path"))))
    literals = text.magic_strings(code).unionByName(text.hardcoded_networks(code)).unionByName(text.env_outside_config(code)).unionByName(text.repeated_literals(code).drop("files"))
    unused = deadcode.unused_symbols(symbols, e, outcomes).select("category", "file_path", F.col("start_line").alias("line"), F.col("name").alias("value"))
    imports = deadcode.unused_imports(refs, e).select("category", "file_path", "line", F.col("binding_name").alias("value"))
    hits = graph.cut(text.contract_hits(sources))
    wired = hits.filter(F.col("category").isin("routes", "hooks", "registered_keys"))
    orphans = deadcode.orphan_backend_modules(sources, symbols.withColumn("parent_symbol_id", F.col("owner_type_name")), e, wired, outside).select("category", F.col("path").alias("file_path"), "line", F.col("name").alias("value"))
    severity = F.create_map(F.lit("Low"), F.lit(300), F.lit("Medium"), F.lit(600), F.lit("High"), F.lit(900))
    findings = (
        security.select(F.lit("security").alias("family"), F.col("label").alias("category"), "file_path", "line", F.col("label").alias("value"), severity[F.col("severity")].alias("severity_millis"))
        .unionByName(literals.select(F.lit("hardwiring").alias("family"), "category", "file_path", "line", "value", F.lit(300).alias("severity_millis")))
        .unionByName(unused.unionByName(imports).unionByName(orphans).select(F.lit("dead_code").alias("family"), "category", "file_path", "line", "value", F.lit(400).alias("severity_millis")))
        .select(E.identity_key("category", "file_path", "value", F.col("line").cast("string")).alias("fingerprint"), F.col("file_path").alias("path"), "family", "category", "line", "value", "severity_millis", F.lit(800).alias("confidence_millis"))
    )
    findings = graph.cut(findings.distinct())
    no_rules = findings.sparkSession.createDataFrame([], "rule_id string, source string, family string, path_regex string, value string, below int")
    reviewed = review.suppressed(findings, no_rules if rules is None else rules)
    delta = review.convergence(before, findings)
    worse = F.col("status").isin("New", "Worsened")
    coverage = parsers.input_coverage(files.filter("language is not null"), outcomes)
    counters = delta.agg(F.count_if(worse & (F.col("now_severity") >= 900)).alias("security_regressions"), F.count_if(F.col("status") == "New").alias("visible_delta"))
    counters = counters.join(F.broadcast(coverage.select(F.col("recovered").alias("incomplete_parses"))))  # one row each
    return Analysis(
        {
            "files": files, "symbols": symbols, "refs": refs, "outcomes": outcomes, "edges": e, "nodes": nodes, "links": pairs, "components": components,
            "coupling": graph.coupling(nodes, pairs), "bottlenecks": graph.bottlenecks(graph.betweenness(nodes, pairs, pivots=pivots)), "zero_inbound": graph.zero_inbound(nodes, pairs),
            "contracts": text.contract_inventory(hits), "complexity": assess.complexity_groups(text.loop_costs(sources)), "security": security,
            "structural": structural.structural_findings(sources), "findings": findings, "reviewed": reviewed, "review_summary": review.review_summary(reviewed), "delta": delta, "verdict": review.guard(counters), "coverage": coverage,
        }
    )


def analyze_folder(spark, root: str, **options) -> Analysis:
    files = scan.scan(spark, root)
    beyond, _ = scan.supplemental(files, scan.admitted(files))
    return analyze(scan.sources(files), outside=beyond.select(F.decode("content", "UTF-8").alias("text")), **options)
