"""Architectural assessments: each returns findings of one kind with severity in millis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators.graph import cut

#: Weights of findings by family.
WEIGHTS = {"dead_code": 1, "literal": 1, "hardwiring": 2, "network": 2, "env": 2, "external_high": 3, "external_medium": 2, "external_low": 1, "security": 3}


#: A key that so large a share of all rows has is hot; there are no more than 1 / HOT_KEYS such keys.
HOT_KEYS = 1e-4


def _bounded(x: Column, top: int = 1000) -> Column:
    return F.least(x, F.lit(top)).cast("int")


def warning_hotspots(findings: DataFrame, centrality: DataFrame) -> DataFrame:
    """Central files with many warnings of several families."""
    weight = F.create_map(*[v for k, w in WEIGHTS.items() for v in (F.lit(k), F.lit(w))])[F.col("family")]
    n = findings.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.sum(F.coalesce(weight, F.lit(1))).alias("weight"), F.array_sort(F.collect_set("family")).alias("families"))
    x = n.join(centrality, "path").filter("centrality_millis >= 250 and count >= 3 and weight >= 4 and (size(families) >= 2 or weight >= 6)")
    tops = x.agg(F.max("centrality_millis").alias("mc"), F.max("weight").alias("mw"))
    severity = (F.col("centrality_millis") * 1000 / F.col("mc") + F.col("weight") * 1000 / F.col("mw")) / 2
    return x.join(F.broadcast(tops)).select("path", "count", "weight", F.array_join("families", ",").alias("families"), F.round(severity).cast("int").alias("severity_millis"))


def layered(paths: DataFrame, layers: dict[str, list[str]], column: str = "path") -> DataFrame:
    """paths with their layer: that of the longest prefix. Paths are cut into their own prefixes, so it is an equi join."""
    spark = paths.sparkSession
    table = spark.createDataFrame([(p.rstrip("/"), n) for n, ps in layers.items() for p in ps], "prefix string, layer string")
    parts = F.split(column, "/")
    own = paths.select(column).distinct().select(column, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("prefix"))
    return own.join(table, "prefix").groupBy(column).agg(F.max_by("layer", F.length("prefix")).alias("layer"))


def layer_violations(edges: DataFrame, layers: dict[str, list[str]], allowed: dict[str, list[str]]) -> DataFrame:
    """Pairs of files whose edges go to a layer that the source's may not depend on; with the first five places."""
    spark = edges.sparkSession
    may = spark.createDataFrame([(a, b) for a, bs in allowed.items() for b in [a, *bs]], "source_layer string, target_layer string")
    ends = edges.select(F.explode(F.array("source_file_path", "target_file_path")).alias("path"))
    at = cut(layered(ends, layers))
    x = edges.join(at.select(F.col("path").alias("source_file_path"), F.col("layer").alias("source_layer")), "source_file_path").join(at.select(F.col("path").alias("target_file_path"), F.col("layer").alias("target_layer")), "target_file_path")
    x = x.join(may, ["source_layer", "target_layer"], "left_anti")
    keys = ["source_file_path", "target_file_path", "source_layer", "target_layer"]
    first = x.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("edge_index"))).filter("n <= 5").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"].cast("string")), ",").alias("sample_lines"))
    count = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("edge_count"))
    return count.join(first, keys).withColumn("severity_millis", 700 + 10 * F.least("edge_count", F.lit(28)).cast("int"))


def broad_interfaces(symbols: DataFrame, edges: DataFrame, least_methods: int = 25, least_files: int = 10) -> DataFrame:
    """Classes with very many public methods (accessors aside) that many other files use; with the five most used."""
    accessor = F.col("name").rlike("^(get|set|is|has)[A-Z_]")
    m = symbols.filter(F.col("kind").isin("Method") & (F.col("visibility") == "Public") & ~F.col("name").startswith("__") & F.col("parent_symbol_id").isNotNull())
    size = m.groupBy("parent_symbol_id").agg(F.count_if(~accessor).alias("methods"), F.min("file_path").alias("file_path"))
    use = edges.join(m.select(F.col("id").alias("target_symbol_id"), "parent_symbol_id", "name"), "target_symbol_id").filter("source_file_path != target_file_path")
    files = use.select("parent_symbol_id", "source_file_path").distinct().groupBy("parent_symbol_id").agg(F.count(F.lit(1)).alias("dependents"))
    per = use.groupBy("parent_symbol_id", "name").agg(F.count(F.lit(1)).alias("u")).withColumn("r", F.row_number().over(Window.partitionBy("parent_symbol_id").orderBy(F.desc("u"), "name"))).filter("r <= 5")
    top = per.groupBy("parent_symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ",").alias("top_methods"))
    x = size.filter(F.col("methods") >= least_methods).join(files.filter(F.col("dependents") >= least_files), "parent_symbol_id").join(top, "parent_symbol_id", "left")
    raw = 8 * F.least("methods", F.lit(80)) + 4 * F.least("dependents", F.lit(100))
    return x.select(F.col("parent_symbol_id").alias("class_id"), "file_path", "methods", "dependents", "top_methods", F.round(raw * 1000 / 1040).cast("int").alias("severity_millis"))


def split_identity(names: DataFrame, least: int = 5) -> DataFrame:
    """names (file_path, name): concepts spelled in several ways, with a file that mixes styles."""
    stem = F.array_join(E.name_words(F.col("name")), "")
    x = names.select("file_path", "name", stem.alias("stem"), E.name_style(F.col("name")).alias("style")).filter("stem != '' and style != 'other'")
    per_file = x.groupBy("stem", "file_path").agg(F.count_distinct("style").alias("styles"), F.count(F.lit(1)).alias("n"))
    files = per_file.groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.max("styles").alias("mixed"), F.sum("n").alias("occurrences"))
    variants = x.select("stem", "name").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("variants"))
    out = files.join(variants, "stem").filter((F.col("variants") >= 2) & (F.col("occurrences") >= least) & (F.col("mixed") >= 2) & (F.col("files") >= 2))
    return out.select("stem", "variants", "occurrences", "files", _bounded(300 + 60 * F.least("variants", F.lit(5)) + 10 * F.least("occurrences", F.lit(40))).alias("severity_millis"))


def compatibility_scars(splits: DataFrame, lines: DataFrame) -> DataFrame:
    """Files with two or more split names (splits: file_path) or two or more lines that speak of old ways."""
    words = r"(?i)\b(legacy|deprecated|backward[s]?[ -]?compat\w*|fallback|shim|polyfill|workaround)\b"
    k = lines.filter(F.col("content").rlike(words)).groupBy("file_path").agg(F.count(F.lit(1)).alias("keyword_hits"))
    n = splits.groupBy("file_path").agg(F.count(F.lit(1)).alias("split_names"))
    x = k.join(n, "file_path", "full").na.fill(0).filter("keyword_hits >= 2 or split_names >= 2")
    return x.select("file_path", "keyword_hits", "split_names", _bounded(350 + 80 * F.col("keyword_hits") + 100 * F.col("split_names")).alias("severity_millis"))


#: Families of dispatch by what a line says.
DISPATCH = {"queue_jobs": r"\bdispatch\s*\(|->onQueue\(|\bdelay\s*\(", "events": r"\bevent\s*\(|\.emit\s*\(|\bfire\s*\(", "direct_notifications": r"\bnotify\s*\(|Mail::|\bsend_mail\s*\(", "hooks": r"\bdo_action\s*\(|\bapply_filters\s*\(", "signals": r"\.send\s*\(|\.connect\s*\("}


def duplicate_mechanisms(lines: DataFrame, centrality: DataFrame) -> DataFrame:
    """Concepts (words of file names) whose files dispatch in two or more ways, some file in two by itself."""
    family = F.explode(F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in DISPATCH.items()])))
    hit = lines.select("file_path", family.alias("family")).distinct()
    stem = F.regexp_replace(E.file_name("file_path"), r"\.[^.]+$", "")
    x = hit.select("file_path", "family", F.explode(F.array_distinct(E.name_words(stem))).alias("concept")).filter("length(concept) >= 4")
    per = x.groupBy("concept", "file_path").agg(F.count(F.lit(1)).alias("n"))
    over = x.select("concept", "family").distinct().groupBy("concept").agg(F.array_sort(F.collect_set("family")).alias("families"))
    exempt = F.col("families") == F.array(F.lit("direct_notifications"), F.lit("queue_jobs"))
    good = over.filter((F.size("families") >= 2) & ~exempt)
    c = per.join(centrality.select(F.col("path").alias("file_path"), "centrality_millis"), "file_path", "left").na.fill(0)
    best = c.groupBy("concept").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("files"), F.min(F.struct((-F.col("centrality_millis")).alias("c"), (-F.col("n")).alias("k"), "file_path")).alias("b"))
    y = good.join(best.filter("most >= 2"), "concept")
    raw = 320 + 140 * F.least(F.size("families"), F.lit(4)) + 90 * F.least("files", F.lit(4)) + F.least(F.floor(-F.col("b.c") / 250), F.lit(180))
    y = y.select("concept", F.col("b.file_path").alias("file_path"), "families", "files", F.round(raw * 1000 / 1420).cast("int").alias("severity_millis"))
    return y.groupBy("file_path").agg(F.array_sort(F.collect_set("concept")).alias("concepts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"), F.max("files").alias("files"), F.max("severity_millis").alias("severity_millis"))


def sanctioned_bypass(raw: DataFrame, lines: DataFrame, marker: str, boundary: str, centrality: DataFrame) -> DataFrame:
    """Files that know the sanctioned way (marker) and still go round it: raw (file_path, line) outside boundary paths."""
    knows = lines.filter(F.col("content").rlike(marker)).select("file_path").distinct()
    n = raw.filter(~F.col("file_path").rlike(boundary)).groupBy("file_path").agg(F.count_distinct("line").alias("n")).join(knows, "file_path", "left_semi")
    c = n.join(centrality.select(F.col("path").alias("file_path"), "centrality_millis"), "file_path", "left").na.fill(0)
    return c.select("file_path", "n", _bounded(520 + 70 * F.least("n", F.lit(4)) + F.least(F.floor(F.col("centrality_millis") / 200), F.lit(180))).alias("severity_millis"))


#: Words of a path that name a role, and what shows by hand written parsing; least scores by role.
PARSE_ROLES = {"parser": 3, "lexer": 3, "tokenizer": 3, "compiler": 2, "expression": 2, "contract": 1, "definition": 2}
PARSE_SIGNS = [r"\bsubstr\s*\(|\bcharAt\s*\(", r"\bpreg_match\s*\(|\bre\.match\s*\(|\.match\s*\(", r"\bexplode\s*\(|\.split\s*\(", r"\bstrpos\s*\(|\.indexOf\s*\(|\.find\s*\("]


def hand_rolled_parsing(lines: DataFrame, least: int = 8, least_special: int = 5) -> DataFrame:
    """Directories with two or more role files that parse by hand."""
    role = F.coalesce(*[F.when(F.lower("file_path").contains(r), F.lit(r)) for r in PARSE_ROLES])
    score = sum((F.col("content").rlike(p).cast("int") for p in PARSE_SIGNS), F.lit(0))
    floor = F.create_map(*[v for k, n in PARSE_ROLES.items() for v in (F.lit(k), F.lit(n))])[F.col("role")]
    per = lines.withColumn("role", role).filter("role is not null").groupBy("file_path", "role").agg(F.sum(score).alias("score")).filter(F.col("score") >= floor)
    out = per.groupBy(E.directory("file_path").alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("score").alias("score"), F.array_sort(F.collect_set("role")).alias("roles"))
    special = F.arrays_overlap("roles", F.array(F.lit("contract"), F.lit("definition")))
    return out.filter((F.col("files") >= 2) & (F.col("score") >= F.when(special, least_special).otherwise(least))).withColumn("severity_millis", _bounded(400 + 20 * F.col("score")))


#: Stacks that one finding stands for: words of paths and signs in lines, least files.
STACKS = {
    "scheduler": (r"(?i)schedul|cron|queue|worker", r"\bsleep\s*\(|\bsetInterval\s*\(|\bsetTimeout\s*\(|\bflock\s*\(", 2),
    "page_resolution": (r"(?i)page|route|slug|resolver", r"\bpreg_match\s*\(|\bparse_url\s*\(|\bnew URL\s*\(", 2),
    "manifest_policy": (r"(?i)manifest|policy|registry", r"\bjson_decode\s*\(|\bJSON\.parse\s*\(|\bjson\.loads\s*\(", 2),
}


def stacks(lines: DataFrame) -> DataFrame:
    """One cluster over the whole repository for each home-made stack."""
    out = None
    for name, (words, signs, least) in STACKS.items():
        per = lines.filter(F.col("file_path").rlike(words) & F.col("content").rlike(signs)).groupBy("file_path").agg(F.count(F.lit(1)).alias("score"))
        one = per.agg(F.count(F.lit(1)).alias("files"), F.sum("score").alias("score"), F.min("file_path").alias("file_path")).filter(F.col("files") >= least).select(F.lit(name).alias("stack"), "file_path", "files", "score", _bounded(450 + 40 * F.least("files", F.lit(8)) + 5 * F.least("score", F.lit(40))).alias("severity_millis"))
        out = one if out is None else out.unionByName(one)
    return out


def forwarder_chains(forwards: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """forwards (source, target): each forwarder's only target. Chains from those nothing forwards to; cycles and chains cut off at `most` drop out."""
    single = forwards.groupBy("source").agg(F.min("target").alias("target"), F.max("target").alias("most")).filter("target = most").select("source", "target")
    # Spark takes a table for as small as its file, in which keys lie packed, and would send all forwards to the driver for each round.
    single = cut(single).hint("merge")
    start = single.join(single.select(F.col("target").alias("source")).distinct().hint("merge"), "source", "left_anti")
    front = start.select(F.array("source", "target").alias("chain"))
    done = None
    for _ in range(most - 1):
        last = F.element_at("chain", -1)
        step = front.withColumn("at", last).join(single.withColumnRenamed("source", "at").hint("merge"), "at", "left")
        over = step.filter("target is null").select("chain")
        done = over if done is None else done.unionByName(over)
        front = cut(step.filter(F.col("target").isNotNull() & ~F.array_contains("chain", F.col("target"))).select(F.concat("chain", F.array("target")).alias("chain")))
        if not front.head(1):
            break
    return done.filter(F.size("chain") > least).select(F.element_at("chain", 1).alias("start"), F.size("chain").alias("length"), F.array_join("chain", " -> ").alias("chain"), F.lit(650).alias("severity_millis"))


def complexity_groups(costs: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """loop costs per file and subtype, with up to four tokens; pressure from the graph (reach: path, depth, relation)."""
    base = F.when(F.col("subtype") == "nested_loop", 500).when(F.col("subtype") == "filesystem_read", 560).when(F.col("subtype") == "collection_scan", 460).otherwise(520)
    w = Window.partitionBy("file_path", "subtype").orderBy("line", "token")
    few = costs.withColumn("n", F.row_number().over(w)).filter("n <= 4").groupBy("file_path", "subtype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda s: s["token"]), "|").alias("tokens"))
    x = costs.groupBy("file_path", "subtype").agg(F.count(F.lit(1)).alias("count")).join(few, ["file_path", "subtype"])
    severity = base + F.least(30 * (F.col("count") - 1), F.lit(150))
    if reach is not None:
        x = x.join(reach.select(F.col("path").alias("file_path"), "depth", "relation"), "file_path", "left")
        severity = severity + F.when(F.col("depth") == 0, 60).when(F.col("depth") > 0, 80).otherwise(0) + F.when(F.col("relation") == "Call", 40).otherwise(0)
    return x.select("file_path", "subtype", "count", "tokens", _bounded(severity).alias("severity_millis"))


def behavior_pairs(behaviors: DataFrame, most_bucket: int = 64, most_keys: int = 8, least_millis: int = 500) -> DataFrame:
    """behaviors (id, keys array, selectors array): pairs that share a key, compared by their selectors.

    Keys of more than `most_bucket` bodies say nothing and are skipped; up to `most_keys` keys count for each body. Which bodies' search
    that cut short is told by `truncated_searches`.
    """
    x = behaviors.select("id", F.array_sort(F.array_distinct("selectors")).alias("sel"), F.explode(F.slice(F.array_sort(F.array_distinct("keys")), 1, most_keys)).alias("key"))
    n = cut(x.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    # The keys of very many bodies are few; they go before bodies are dealt out by key.
    crowded = n.filter(F.col("n") > max(most_bucket, HOT_KEYS * (n.agg(F.sum("n")).first()[0] or 0)))
    kept = x.join(F.broadcast(crowded.select("key")), "key", "left_anti").join(n.filter((F.col("n") >= 2) & (F.col("n") <= most_bucket)).select("key").hint("merge"), "key")
    y = kept.groupBy("id", "sel").agg(F.collect_set("key").alias("keys")).withColumn("key", F.explode("keys"))
    # A pair counts at the least of the keys that both have, so that no pairs are gathered to be told apart.
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    pair = y.alias("a").join(y.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))).filter(once).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.sel").alias("sa"), F.col("b.sel").alias("sb"))
    both, either = F.size(F.array_intersect("sa", "sb")), F.size(F.array_union("sa", "sb"))
    pair = pair.withColumn("similarity_millis", F.when(either == 0, 0).otherwise(E.millis(both / either)))
    kind = F.when(F.col("similarity_millis") == 1000, "Identical").when(F.size(F.array_except("sa", "sb")) == 0, "Subset").when(F.size(F.array_except("sb", "sa")) == 0, "Superset").when(F.col("similarity_millis") >= least_millis, "Similar").otherwise("Divergent")
    return pair.select("a", "b", "similarity_millis", kind.alias("relation"))


def truncated_searches(behaviors: DataFrame, most_bucket: int = 64, most_keys: int = 8) -> DataFrame:
    """behaviors (id, keys array) → (id, keys_skipped, keys_left_out): bodies of which behavior_pairs doesn't see all candidates, by keys of too many bodies or beyond the first `most_keys`."""
    keys = F.array_sort(F.array_distinct("keys"))
    x = behaviors.select("id", keys.alias("keys"))
    first = x.select("id", F.explode(F.slice("keys", 1, most_keys)).alias("key"))
    crowded = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_bucket).select("key")
    skipped = first.join(crowded, "key").groupBy("id").agg(F.count(F.lit(1)).alias("keys_skipped"))
    out = x.join(skipped, "id", "left").select("id", F.coalesce("keys_skipped", F.lit(0)).cast("int").alias("keys_skipped"), F.greatest(F.size("keys") - most_keys, F.lit(0)).alias("keys_left_out"))
    return out.filter("keys_skipped > 0 or keys_left_out > 0")


def unwired(files: DataFrame, orphans: DataFrame, mentions: DataFrame, suffixes: list[str], inherited: DataFrame | None = None) -> DataFrame:
    """Files whose stem has a role suffix that no other file mentions (mentions: name, file_path)."""
    stem = F.regexp_replace(E.file_name("path"), r"\.[^.]+$", "")
    role = F.coalesce(*[F.when(F.col("stem").endswith(s) & (F.col("stem") != s), F.lit(s)) for s in suffixes])
    x = files.select("path", stem.alias("stem")).withColumn("role", role).filter(F.col("role").isNotNull() & ~E.is_test_path("path")).join(orphans.select("path"), "path", "left_anti")
    if inherited is not None:
        x = x.join(inherited.select("path"), "path", "left_anti")
    m = mentions.select(F.col("name").alias("stem"), F.col("file_path").alias("by")).distinct()
    return x.join(m.select("stem", "by"), (x.stem == m.stem) & (x.path != m.by), "left_anti").select("path", "role", F.lit(620).alias("severity_millis"))


def counts_by_kind(*parts: tuple[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
