"""What nothing uses: private symbols, imports, modules. Anti joins throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators.graph import put_by

#: Names that a runtime calls by itself.
MAGIC_NAMES = ["main", "setUp", "tearDown", "boot", "register", "handle", "initialize"]


def unused_symbols(symbols: DataFrame, edges: DataFrame, outcomes: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """Private and protected functions and methods that no call or override reaches, outside tests and magic names; where given, only in files whose parse proves the scope (outcomes) and that no other line mentions (mentions: name)."""
    s = symbols.filter(F.col("kind").isin("Function", "Method") & F.col("visibility").isin("Private", "Protected") & ~F.col("name").startswith("__") & ~F.col("name").isin(MAGIC_NAMES) & ~E.is_test_path("file_path"))
    called = edges.filter("kind in ('Call', 'Overrides') and not (source_symbol_id <=> target_symbol_id)").select(F.col("target_symbol_id").alias("id")).distinct()
    out = s.join(called, "id", "left_anti")
    if outcomes is not None:
        out = out.join(outcomes.filter("required_recovery").select("file_path").distinct(), "file_path", "left_anti")
    if mentions is not None:
        out = out.join(mentions.select("name").distinct(), "name", "left_anti")
    tier = F.when(F.col("visibility") == "Private", "Certain").otherwise("Strong")
    return out.select(F.lit("UnusedPrivateFunction").alias("category"), "file_path", "start_line", "name", "id", tier.alias("tier"))


def unused_imports(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """Imports with a binding, to whose target no other kind of reference of the file goes, and whose name none of its receivers has."""
    imports = refs.filter("kind in ('Import', 'TypeImport') and binding_name is not null")
    used = refs.filter("kind not in ('Import', 'TypeImport')").select("file_path", F.col("target_name").alias("binding_name")).distinct()
    out = imports.join(used, ["file_path", "binding_name"], "left_anti")
    if "receiver_name" in refs.columns:
        out = out.join(refs.filter("receiver_name is not null").select("file_path", F.col("receiver_name").alias("binding_name")).distinct(), ["file_path", "binding_name"], "left_anti")
    e = edges.filter("kind not in ('Import', 'TypeImport')").select(F.col("source_file_path").alias("file_path"), F.col("reference_target_name").alias("binding_name")).distinct()
    return out.join(e, ["file_path", "binding_name"], "left_anti").select(F.lit("UnusedImport").alias("category"), "file_path", "line", "binding_name", "ref_index")


def orphan_modules(files: DataFrame, edges: DataFrame, literals: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Files without an edge from another, non-test file; whose stem no path literal ends with; that are no entries."""
    inbound = edges.filter((F.col("source_file_path") != F.col("target_file_path")) & ~E.is_test_path("source_file_path")).select(F.col("target_file_path").alias("path")).distinct()
    out = files.filter(~E.is_test_path("path") & ~E.is_default_entry("path")).join(inbound, "path", "left_anti")
    stem = F.regexp_replace(E.file_name("path"), r"\.[^.]+$", "")
    if literals is not None:
        tails = literals.select(F.regexp_replace(F.element_at(F.split("value", "/"), -1), r"\.[^.]+$", "").alias("stem")).distinct()
        out = out.withColumn("stem", stem).join(tails, "stem", "left_anti").drop("stem")
    if entries is not None:
        out = out.join(entries.select("path"), "path", "left_anti")
    return out.select(F.lit("OrphanModule").alias("category"), "path")


def identifier_mentions(lines: DataFrame) -> DataFrame:
    """(name, file_path): inverted index of identifiers, once for each file."""
    return lines.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name")).distinct()


#: Kinds of symbols that an autoloader finds by name.
CONTAINER_KINDS = ["Class", "Interface", "Trait", "Struct", "Enum"]
#: Folders and file stems that a backend framework reaches by itself.
FRAMEWORK_FOLDERS = ["migrations", "seeders", "seeds", "database", "config", "routes", "bootstrap", "public", "views", "resources", "tests", "__tests__", "vendor", "storage", "stubs", "bin", "commands"]
FRAMEWORK_STEMS = ["index", "artisan", "server", "bootstrap", "autoload"]
#: Calls that look a class up by a string, a quoted path, and quoted class names that are joined to a variable.
LOOKUP_CALL = r"\b(?:class_exists|interface_exists|trait_exists|is_a|is_subclass_of|app|resolve|make|call_user_func|call_user_func_array|new)\s*\("
LOOKUP_ARGUMENTS = LOOKUP_CALL + r"([^;]{0,400})"
QUOTED_PATH = r"""['"`]([A-Za-z0-9_@$.\-]*/[A-Za-z0-9_@$./\-]+)['"`]"""
QUOTED_CLASS = r"""['"]([A-Z][A-Za-z0-9]+)['"]"""
JOINED_CLASS = r"""\.\s*(?:\w+\s*\([^)]*\)\s*\.\s*)?['"]([A-Z][A-Za-z0-9]+)['"]"""


def _nothing() -> Column:
    return F.array().cast("array<string>")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def built_class_suffixes(text: Column) -> Column:
    """Ends of class names that a source joins to a variable and looks up, as an array."""
    by_call = F.flatten(F.transform(F.filter(_all(text, LOOKUP_ARGUMENTS), lambda a: a.contains("$") & a.contains(".")), lambda a: _all(a, QUOTED_CLASS)))
    by_variable = F.when(text.rlike(LOOKUP_CALL + r"\s*\$"), _all(text, JOINED_CLASS)).otherwise(_nothing())
    found = F.filter(F.concat(by_call, by_variable), lambda s: F.length(s) >= 4)
    return F.when(text.contains("(") & text.contains("$") & text.contains("."), found).otherwise(_nothing())


def _told(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("channel"), v.alias("value")))


def _shapes(path: Column) -> Column:
    """What a file's name may share with those of other folders: several dots, or the folder's name with an ending."""
    name, folder = E.file_name(path), E.directory(path)
    dots, inner = F.lower(F.regexp_extract(name, r"^[^.]*\.(.*)$", 1)), E.file_name(folder)
    ending = F.lower(F.substr(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.length(inner) + 1))
    both = F.array(
        F.when(dots.contains("."), F.struct(F.lit("dots").alias("channel"), dots.alias("value"))),
        F.when((folder != "") & name.startswith(inner) & (ending != ""), F.struct(F.lit("ending").alias("channel"), ending.alias("value"))),
    )
    return F.filter(both, lambda x: x.isNotNull())


def orphan_backend_modules(sources: DataFrame, symbols: DataFrame, edges: DataFrame, contracts: DataFrame | None = None, outside: DataFrame | None = None, extensions: tuple[str, ...] = ("php",)) -> DataFrame:
    """Backend files with classes that nothing leads to: → category, path, name, line, tier.

    sources (file_path, text), symbols and edges as elsewhere; contracts (file_path): files with routes, hooks or registered keys; outside (text): texts
    beyond the slice, which can only take findings away. A file is let off by an edge from another file that is no test, a contract, a quoted path that
    ends with its name, a shape of name that several folders share (several dots: two; the folder's name with an ending: three), a class name that ends
    with what some source builds a name with, a name under four bytes, and a mention of one of its classes in another file. Files without classes are
    never found. Null texts count as empty, a repeated path as one file.

    All texts are read once for the three channels that look into them; a row for each distinct hint, with the least and the greatest file that has it, is all
    that meets the candidates, so a hint that every file has costs no more than another. Texts are dealt out by file before they are searched, and paths are
    kept, for tables of short rows are read by few tasks.
    """
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = F.col("path")
    texts = sources.select(F.col("file_path").alias("path"), F.coalesce("text", F.lit("")).alias("text")).repartition(n, "path")
    s = put_by(sources.select(F.col("file_path").alias("path")).distinct()).filter(~E.is_test_path("path"))
    text = F.col("text")
    # An identifier is a run of ASCII word characters; names with other letters go by runs that hold those too.
    words = F.array_union(_all(text, "([A-Za-z0-9_]+)"), F.when(F.octet_length(text) == F.length(text), _nothing()).otherwise(F.filter(_all(text, r"([A-Za-z0-9_\x{80}-\x{10FFFF}]+)"), lambda w: ~w.rlike("^[A-Za-z0-9_]+$"))))
    tails = F.when(text.contains("/"), F.transform(_all(text, QUOTED_PATH), lambda p: F.lower(E.file_name(F.rtrim(p, F.lit("/")))))).otherwise(_nothing())
    seen = F.concat(_told("word", words), _told("built", built_class_suffixes(text)))
    # As a condition of the hints and not of the texts, tests are left out after the dealing.
    told = texts.select("path", F.lit(False).alias("beyond"), F.explode(F.when(~E.is_test_path("path"), F.array_distinct(F.concat(seen, _told("tail", tails))))).alias("h"))
    if outside is not None:
        told = told.unionByName(outside.select(F.coalesce("text", F.lit("")).alias("text")).select(F.lit(None).cast("string").alias("path"), F.lit(True).alias("beyond"), F.explode(F.array_distinct(seen)).alias("h")))
    hints = told.groupBy("h.channel", "h.value").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.bool_or("beyond").alias("beyond"))
    places = s.select(E.directory(path).alias("folder"), F.explode(_shapes(path)).alias("h")).select("h.*", "folder").distinct()
    shared = places.groupBy("channel", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= F.when(F.col("channel") == "dots", 2).otherwise(3))
    hints = hints.unionByName(shared.select("channel", "value", F.lit(None).cast("string").alias("low"), F.lit(None).cast("string").alias("high"), F.lit(True).alias("beyond")))

    name = E.file_name(path)
    first = F.lower(F.split_part(name, F.lit("."), F.lit(1)))
    reached = F.arrays_overlap(F.split(F.lower(E.normalised(path)), "/"), F.array(*map(F.lit, FRAMEWORK_FOLDERS))) | F.lower(name).endswith(".blade.php") | first.isin(FRAMEWORK_STEMS)
    files = s.filter(F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*extensions) & ~reached).select("path").distinct()
    led = edges.filter((F.col("source_file_path") != F.col("target_file_path")) & ~E.is_test_path("source_file_path")).select(F.col("target_file_path").alias("path"))
    if contracts is not None:
        led = led.unionByName(contracts.select(F.col("file_path").alias("path")))
    classes = symbols.filter(F.col("parent_symbol_id").isNull() & F.col("kind").isin(CONTAINER_KINDS)).select(F.col("file_path").alias("path"), F.col("name").alias("class"))
    found = files.join(led.distinct(), "path", "left_anti").join(classes.distinct(), "path")
    ends = F.transform(F.sequence(F.lit(1), F.length("class") - 3), lambda k: F.substr(F.col("class"), k))
    wanted = F.concat(
        _told("word", F.array("class")), _told("tail", F.array(F.lower(name))), _shapes(path),
        _told("built", F.when(F.length("class") >= 4, F.filter(ends, lambda e: e.rlike("^[A-Z]"))).otherwise(F.array().cast("array<string>"))),
    )
    asked = found.select("path", F.explode(wanted).alias("h")).select("path", "h.*").distinct()
    met = asked.join(hints, ["channel", "value"]).filter((F.col("channel") != "word") | F.col("beyond") | (F.col("low") != path) | (F.col("high") != path)).select("path")
    short = found.filter(F.octet_length("class") < 4).select("path")
    left = found.select("path").distinct().join(met.unionByName(short).distinct(), "path", "left_anti")
    return left.select(F.lit("OrphanModule").alias("category"), "path", F.split_part(name, F.lit("."), F.lit(1)).alias("name"), F.lit(1).alias("line"), F.lit("Heuristic").alias("tier"))
