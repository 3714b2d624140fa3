"""Questions that agents ask of an analysed graph, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators import graph as gr


def find_symbol(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Exact names first, then ends of qualified names, then any that contain the query."""
    if kind:
        symbols = symbols.filter(F.col("kind") == kind)
    low = query.lower()
    tier = F.when((F.col("name") == query) | (F.col("qualified_name") == query), 0).when(F.col("qualified_name").endswith("::" + query), 1).when(F.lower("name").contains(low) | F.lower("qualified_name").contains(low), 2)
    return symbols.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "file_path", "start_line", "id").limit(max(1, min(limit, 100)))


def usage_candidates(symbols: DataFrame, name: str) -> DataFrame:
    """What a name may mean; more than one row is a question for the caller, never a guess."""
    return symbols.filter((F.col("id") == name) | (F.col("name") == name)).select("id", "kind", "file_path", "start_line").orderBy("file_path", "start_line", "id").limit(20)


def symbol_usages(edges: DataFrame, symbol_id: str, limit: int = 25) -> DataFrame:
    e = edges.filter(F.col("target_symbol_id") == symbol_id)
    out = e.groupBy(F.col("source_file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("usages"), F.array_join(F.slice(F.array_sort(F.collect_set("line")), 1, 20), ",").alias("lines"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return out.orderBy(F.desc("usages"), "file_path").limit(limit)


def list_findings(findings: DataFrame, limit: int = 100, prefix: str | None = None, least_severity: int | None = None, **equal) -> tuple[DataFrame, int]:
    """A page of findings and how many there are in all; every given filter must hold."""
    out = findings
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    if prefix:
        out = out.filter(F.col("path").startswith(prefix))
    if least_severity is not None:
        out = out.filter(F.col("severity_millis") >= least_severity)
    return out.orderBy(F.desc("severity_millis"), "path", "fingerprint").limit(limit), out.count()


def module_design(symbols: DataFrame, edges: DataFrame, prefix: str) -> dict[str, DataFrame]:
    """Containers with their members, and what crosses the module's border."""
    inside = F.col("file_path").startswith(prefix)
    s = symbols.filter(inside)
    containers = s.filter(F.col("kind").isin("Class", "Interface", "Struct", "Enum", "Trait"))
    members = s.filter("parent_symbol_id is not null").groupBy("parent_symbol_id").agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("visibility") == "Public").cast("int")).alias("public_members"))
    a, z = F.col("source_file_path").startswith(prefix), F.col("target_file_path").startswith(prefix)
    crossing = edges.filter(a != z).groupBy(F.when(a, "out").otherwise("in").alias("direction"), F.when(a, E.zone("target_file_path")).otherwise(E.zone("source_file_path")).alias("zone")).agg(F.count(F.lit(1)).alias("edges"))
    return {"containers": containers.join(members, containers.id == members.parent_symbol_id, "left").select("id", "name", "kind", "file_path", "members", "public_members"), "crossing": crossing}


def verify_change(delta: DataFrame, paths: list[str]) -> DataFrame:
    """Changes of findings in the touched files, as regressions and fixes."""
    kind = F.when(F.col("status").isin("New", "Worsened"), "regression").when(F.col("status").isin("Resolved", "Improved"), "fix")
    return delta.filter(F.col("path").isin(paths)).withColumn("kind", kind).filter("kind is not null")


def convention_for(clauses: DataFrame, question: str, top: int = 3) -> DataFrame:
    """Clauses (id, text) that share words of three letters and more with the question."""
    words = sorted({w for w in question.lower().replace("_", " ").split() if len(w) >= 3})
    score = sum((F.lower("text").contains(w).cast("int") for w in words), F.lit(0))
    return clauses.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "id").limit(top)


def impact(links: DataFrame, target: str, most: int = 3) -> dict[str, DataFrame]:
    radius = gr.impact_radius(links, target, most)
    return {"dependents": radius.orderBy("depth", "path"), "modules": gr.impact_modules(radius)}


def hotspots(findings: DataFrame, centrality: DataFrame, counts: DataFrame, top: int = 20) -> DataFrame:
    """Files with findings: by number, then by place in the graph. counts: path, out_edges, in_edges."""
    n = findings.groupBy("path").agg(F.count(F.lit(1)).alias("finding_count"))
    out = n.join(centrality, "path", "left").join(counts, "path", "left").na.fill(0)
    return out.withColumn("edges", F.col("out_edges") + F.col("in_edges")).orderBy(F.desc("finding_count"), F.desc("centrality_millis"), F.desc("edges"), "path").limit(top)


def explain_finding(reviewed: DataFrame, fingerprint: str) -> DataFrame:
    """A finding with its review status, how many others stand in its file, and how many of its family are worse."""
    one = reviewed.filter(F.col("fingerprint") == fingerprint)
    others = one.select(F.col("path").alias("p"), F.col("family").alias("f"), F.col("severity_millis").alias("s")).limit(1)
    met = reviewed.join(F.broadcast(others), (F.col("path") == F.col("p")) | (F.col("family") == F.col("f")))
    counts = met.agg(F.count_if((F.col("path") == F.col("p")) & (F.col("fingerprint") != fingerprint)).alias("beside"), F.count_if((F.col("family") == F.col("f")) & (F.col("severity_millis") > F.col("s"))).alias("worse"))
    return one.join(F.broadcast(counts)).select("fingerprint", "path", "family", "severity_millis", "status", "rule_id", "beside", "worse")


def repository_topology(edges: DataFrame) -> DataFrame:
    """Zones with their files and the relations within them, out of them and into them."""
    a, z = E.zone("source_file_path"), E.zone("target_file_path")
    ends = edges.select(F.explode(F.array(F.struct(a.alias("zone"), F.col("source_file_path").alias("path"), (a == z).alias("inner"), F.lit(True).alias("out")), F.struct(z.alias("zone"), F.col("target_file_path").alias("path"), (a == z).alias("inner"), F.lit(False).alias("out")))).alias("x"))
    # Counts of each file first, so that a zone's files are counted from few rows.
    per = ends.groupBy("x.zone", "x.path").agg(F.count_if(F.col("x.inner") & F.col("x.out")).alias("i"), F.count_if(~F.col("x.inner") & F.col("x.out")).alias("o"), F.count_if(~F.col("x.inner") & ~F.col("x.out")).alias("n"))
    return per.groupBy("zone").agg(F.count(F.lit(1)).alias("files"), F.sum("i").alias("inner_relations"), F.sum("o").alias("outgoing"), F.sum("n").alias("incoming"))


def quality_evaluation(reviewed: DataFrame) -> DataFrame:
    """Per family: all findings, the visible ones, their worst and their files, and the share that rules and policies hide."""
    seen = F.col("status") == "Visible"
    out = reviewed.groupBy("family").agg(F.count(F.lit(1)).alias("total"), F.count_if(seen).alias("visible"), F.coalesce(F.max(F.when(seen, F.col("severity_millis"))), F.lit(0)).cast("int").alias("worst"), F.count_distinct(F.when(seen, F.col("path"))).alias("files"))
    return out.withColumn("suppressed_millis", E.millis((F.col("total") - F.col("visible")) / F.col("total")).cast("int"))
