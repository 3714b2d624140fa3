"""The command line: python -m codeloom COMMAND ROOT [options].

ROOT is any folder that Spark reads. Settings of a scan come from --config or, where it exists, ROOT/.codeloom/scan.json;
they go over the options of the call. Exit codes: 0, the checks are complete; 1, the call is wrong; 2, some file was
parsed by recovery, so that what was found may not be all.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators import plugins, review, surface, text
from codeloom.plans import cypher
from codeloom.plans.analyze import Analysis, analyze
from codeloom.sources import scan, sinks

INCOMPLETE = 2
#: What `analyze --out` publishes.
MEMBERS = ["files", "symbols", "edges", "findings", "reviewed", "delta", "coupling", "contracts", "verdict"]


def scanned(spark: SparkSession, root: str, config: str | None = None, defaults: dict | None = None) -> DataFrame:
    """Files of a root under the settings that hold for it."""
    named = sinks.get_text(spark, config or f"{root.rstrip('/')}/.codeloom/scan.json")
    if config and named is None:
        raise ValueError(f"no settings at {config}")
    settings = scan.scan_config(named, defaults)
    files = scan.included(scan.scan(spark, root, settings["ignore"], settings["hidden"]), settings["include"])
    made = [F.lit(p.rstrip("/")) for p in settings["generated"]]
    return files.filter(~F.arrays_overlap(scan.prefixes_of("relative_path"), F.array(*made))) if made else files


def code_graph(done: Analysis) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind, name, file_path; relations: from, to, type, line). An end that is no known symbol is its file."""
    inner = done.symbols.select("id", F.upper("kind").alias("kind"), "name", "file_path")
    outer = done.files.select(F.col("path").alias("id"), F.lit("FILE").alias("kind"), E.file_name("path").alias("name"), F.col("path").alias("file_path"))
    known = done.symbols.select("id").distinct()
    a, b = known.select(F.col("id").alias("a")), known.select(F.col("id").alias("b"))
    met = done.edges.join(a, F.col("source_symbol_id") == F.col("a"), "left").join(b, F.col("target_symbol_id") == F.col("b"), "left")
    relations = met.select(F.coalesce("a", "source_file_path").alias("from"), F.coalesce("b", "target_file_path").alias("to"), F.upper("kind").alias("type"), "line")
    return outer.unionByName(inner.dropDuplicates(["id"])), relations


def rules_of(spark: SparkSession, path: str | None) -> DataFrame | None:
    """{"accept": [...], "rules": [...]} of a file."""
    found = json.loads(sinks.get_text(spark, path) or "{}") if path else None
    return None if found is None else review.policy_rules(spark, found, found.get("rules", []))


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="codeloom")
    commands = made.add_subparsers(dest="command", required=True)
    for name in ("analyze", "report", "surface", "graph", "cypher", "info", "plugins", "tune"):
        c = commands.add_parser(name)
        c.add_argument("root")
        c.add_argument("--config")
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--hidden", action="store_true")
        if name in ("analyze", "graph"):
            c.add_argument("--out", required=name == "graph")
        if name in ("analyze", "report"):
            c.add_argument("--rules")
            c.add_argument("--before", help="folder of an earlier `analyze --out`")
        if name == "cypher":
            c.add_argument("query")
    commands.add_parser("version")
    return made


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    try:
        call = parser().parse_args(argv)
    except SystemExit as ended:
        return 1 if ended.code else 0
    if call.command == "version":
        from codeloom import __version__

        print(f"codeloom {__version__}", file=out)
        return 0
    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    try:
        files = scanned(spark, call.root, call.config, {"include": call.include, "hidden": call.hidden})
        return run(call, spark, files, out)
    except (ValueError, cypher.CypherError) as wrong:
        print(f"codeloom: {wrong}", file=sys.stderr)
        return 1


def run(call: argparse.Namespace, spark: SparkSession, files: DataFrame, out) -> int:
    if call.command == "info":
        print(sinks.report("Files", {"languages": scan.language_coverage(files)}, 100), file=out)
        return 0
    sources = scan.sources(files)
    if call.command == "plugins":
        lines = text.lines_of(sources)
        found = {}
        for name, (subscribers, publishers) in (("hooks", plugins.hooks(lines)), ("signals", plugins.signals(lines))):
            found[name] = plugins.published(publishers, subscribers).select("source_file_path", "target_file_path", "target_symbol_id")
        print(sinks.report("Plugins", found), file=out)
        return 0
    if call.command == "tune":
        literals = text.repeated_literals(text.code_lines(text.lines_of(sources))).select("value", "files")
        print(sinks.report("Thresholds", {"repeated literals": review.tuning(literals, 2)}, 100), file=out)
        return 0
    before = sinks.current(spark, call.before).get("findings") if getattr(call, "before", None) else None
    done = analyze(sources, before=before, rules=rules_of(spark, getattr(call, "rules", None)))
    if call.command == "surface":
        zones = surface.zones(scan.admitted(files).withColumnRenamed("relative_path", "path"), done.findings, done.nodes.filter(E.is_default_entry("path")))
        shown = {"overview": surface.overview(done.files, done.symbols, done.edges, done.findings), "highlights": surface.highlights(done.findings), "zones": zones.orderBy("zone")}
        print(sinks.report("Surface", shown), file=out)
    elif call.command == "graph":
        sinks.export_graph(*code_graph(done), call.out)
        print(call.out, file=out)
    elif call.command == "cypher":
        for line in cypher.run(*code_graph(done), call.query).toJSON().toLocalIterator():
            print(line, file=out)
    else:
        if getattr(call, "out", None):
            print(sinks.publish(spark, call.out, {m: done.frames[m] for m in MEMBERS}), file=out)
        shown = {"verdict": done.verdict, "review": done.review_summary, "attention": review.attention(done.delta), "triage": review.triage(done.reviewed), "bottlenecks": done.bottlenecks}
        print(sinks.report("Analysis", shown), file=out)
    return INCOMPLETE if done.coverage.first().recovered else 0


if __name__ == "__main__":
    sys.exit(main())
