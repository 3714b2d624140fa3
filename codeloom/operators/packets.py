"""Work packets for a reviewer: what to look at first, why, how far around, and when it is done.

Findings and assessments become packets of a focus, by file; a budget takes the first of each focus before a second of any. Nothing is gathered by
file or focus: packets carry counts, and their findings and radius are tables of their own for those that were chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of a focus, and from which severity on an assessment of it is of high priority (None: as below); from three files on it is too where `many` says so.
FOCUS_RANK = {"security_hotspot": 7, "reviewed_architecture": 6, "dead_code_proof": 5, "semantic_decision": 5, "hand_rolled_parsing": 5, "algorithmic_complexity_hotspot": 5, "sanctioned_path_bypass": 4, "duplicate_mechanism": 4, "abstraction_sprawl": 3, "compatibility_scar": 2, "split_identity_model": 1, "warning_heavy_hotspot": 0}
HIGH_FROM = {"hand_rolled_parsing": 700, "algorithmic_complexity_hotspot": 820, "sanctioned_path_bypass": 700, "duplicate_mechanism": 700, "compatibility_scar": 700, "split_identity_model": 700}
MANY_FILES = ["hand_rolled_parsing", "duplicate_mechanism", "compatibility_scar", "split_identity_model"]
#: Contexts of a security finding that make its packet one of high priority.
EXPOSED = ["ExternallyReachable", "EntryReachableViaGraph"]
PRIORITY = {"high": 3, "medium": 2, "low": 1}
#: What is to be done, and when it is done, by focus; § stands for the packet's file.
OBLIGATIONS = {
    "security_hotspot": [("Follow every input that reaches § and take the dangerous call out, or put one checked boundary around it.", "No unchecked input reaches the call."), ("Write down who owns the boundary and why the call stays.", "Owner and reason can be read in the code.")],
    "dead_code_proof": [("Prove for § that nothing binds, dispatches to or registers it by name; then remove the least that is proven.", "Effects of imports and discovery by a framework are kept or ruled out.")],
    "hand_rolled_parsing": [("Compare the parsing in § with what a library offers, and move it there where inputs allow.", "What stays has a reason and tests of its odd inputs.")],
    "algorithmic_complexity_hotspot": [("Take the repeated work in § out of its loop, by an index or a single pass.", "Work grows with the input's size, not its square."), ("Measure before and after at the sizes to be expected.", "Both figures are in the change.")],
    "sanctioned_path_bypass": [("Let § read its settings by the way the rest of the code uses.", "No raw read is left but at start-up.")],
    "duplicate_mechanism": [("Choose one of the ways by which § does the same thing and lead new work there.", "The others are gone or fenced off.")],
    "abstraction_sprawl": [("List what each forwarding layer around § adds.", "Layers that add nothing are merged, the others have a named duty.")],
    "compatibility_scar": [("Move the callers of § to one form of the data.", "Translation is left at the border alone, with a date for its end.")],
    "split_identity_model": [("Choose one form of the concept around § and turn the others into it at the border.", "No code between borders converts.")],
    "warning_heavy_hotspot": [("Split what § does by concern before single warnings are mended.", "Its warnings fall without new ones elsewhere.")],
    "semantic_decision": [("Feed the same inputs to the implementations linked to § and compare.", "Differences are named, and one owner is left or both are justified.")],
    "reviewed_architecture": [("Carry out the reviewed decision about §.", "Changed files are reviewed again.")],
}
COLUMNS = ["id", "priority", "focus", "primary_file", "target_files", "confidence_millis", "findings", "labels"]


def _picked(table: dict, key: Column, kind: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(None).cast(kind))


def _labels(*marks: Column) -> Column:
    return F.array_compact(F.array(*marks))


def of_findings(reviewed: DataFrame, centrality: DataFrame, cyclic: DataFrame, hotspots: DataFrame) -> DataFrame:
    """Packets of visible findings: security by file, warnings by file where `hotspots` (path) names it and they are not mainly literals, dead code by finding.

    reviewed (fingerprint, path, family, severity_millis, status[, contexts][, precision]); centrality (path, centrality_millis); cyclic (path): files of strong cycles.
    """
    seen = reviewed.filter("status = 'Visible'")
    if "contexts" not in seen.columns:
        seen = seen.withColumn("contexts", F.array().cast("array<string>"))
    if "precision" not in seen.columns:
        seen = seen.withColumn("precision", F.lit("modeled"))
    known = sorted(EXPOSED)
    safe, literal, outer = F.col("family").isin("security", "external"), F.col("family") == "hardwiring", F.col("family") == "security"
    by_file = seen.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(safe).alias("guarded"), F.count_if(literal).alias("literals"), F.count_if(outer).alias("security"),
        F.coalesce(F.bool_or(outer & ((F.col("severity_millis") >= 900) | F.arrays_overlap("contexts", F.array(*map(F.lit, EXPOSED))))), F.lit(False)).alias("exposed"),
        *[F.coalesce(F.bool_or(outer & F.array_contains("contexts", c)), F.lit(False)).alias(c) for c in known],
    )
    at = by_file.join(centrality.groupBy("path").agg(F.max("centrality_millis").alias("central")), "path", "left").join(cyclic.select("path").distinct().withColumn("cycle", F.lit(True)), "path", "left")
    at = at.join(hotspots.select("path").distinct().withColumn("hot", F.lit(True)), "path", "left").na.fill(False, ["cycle", "hot"]).na.fill(0, ["central"])
    around = [F.when(F.col("central") > 0, F.concat(F.lit("bottleneck:"), F.col("central").cast("string"))), F.when(F.col("cycle"), F.lit("strong_cycle"))]
    security = F.struct(
        F.lit("security_hotspot").alias("focus"), F.when(F.col("exposed"), "high").otherwise("medium").alias("priority"), F.when(F.col("exposed"), 870).otherwise(760).alias("confidence_millis"),
        F.col("security").alias("findings"), _labels(*[F.when(F.col(c), F.lit(c)) for c in known], *around).alias("labels"),
    )
    other = F.col("n") - F.col("literals")
    mostly = (F.col("literals") >= F.col("n") - 1) | ((F.col("literals") > other * 2) & (F.col("guarded") == 0))
    warning = F.struct(
        F.lit("warning_heavy_hotspot").alias("focus"), F.when((F.col("guarded") > 0) | F.col("cycle") | (F.col("central") >= 700), "high").otherwise("medium").alias("priority"), F.when(F.col("guarded") > 0, 760).otherwise(640).alias("confidence_millis"),
        F.col("n").alias("findings"), _labels(*around).alias("labels"),
    )
    made = at.select("path", F.explode(F.array_compact(F.array(F.when(F.col("security") > 0, security), F.when(F.col("hot") & ~mostly, warning)))).alias("p"))
    files = made.select(F.concat_ws(":", "p.focus", "path").alias("id"), "p.priority", "p.focus", F.col("path").alias("primary_file"), F.array("path").alias("target_files"), "p.confidence_millis", "p.findings", "p.labels")
    dead = seen.filter("family = 'dead_code'").select(
        F.concat(F.lit("dead_code_proof:"), "fingerprint").alias("id"), F.when(F.col("precision") == "heuristic", "medium").otherwise("high").alias("priority"), F.lit("dead_code_proof").alias("focus"), F.col("path").alias("primary_file"),
        F.array("path").alias("target_files"), F.lit(800).alias("confidence_millis"), F.lit(1).cast("long").alias("findings"), F.array().cast("array<string>").alias("labels"),
    )
    return files.select(*COLUMNS).unionByName(dead.select(*COLUMNS))


def of_assessments(assessments: DataFrame) -> DataFrame:
    """Packets of assessments (focus, path, severity_millis, related: other files): one for each focus and file, of its severest; unknown focuses are an error of the caller's and give none."""
    x = assessments.filter(F.col("focus").isin(list(FOCUS_RANK))).withColumn("files", F.array_sort(F.array_union(F.array("path"), F.coalesce("related", F.array().cast("array<string>")))))
    x = x.groupBy("focus", "path").agg(F.max_by("files", F.struct("severity_millis", F.array_join("files", "\n"))).alias("target_files"), F.max("severity_millis").alias("worst"), F.count(F.lit(1)).alias("findings"))
    focus = F.col("focus")
    high = F.coalesce(F.col("worst") >= _picked(HIGH_FROM, focus, "int"), F.lit(False)) | (focus.isin(MANY_FILES) & (F.size("target_files") >= 3)) | ((focus == "algorithmic_complexity_hotspot") & (F.col("findings") >= 2)) | (focus == "reviewed_architecture")
    priority = F.when(focus == "abstraction_sprawl", "low").when(high, "high").otherwise("medium")
    return x.select(F.concat_ws(":", "focus", "path").alias("id"), priority.alias("priority"), "focus", F.col("path").alias("primary_file"), "target_files", F.col("worst").cast("int").alias("confidence_millis"), "findings", F.array().cast("array<string>").alias("labels"))


def chosen(packets: DataFrame, budget: int = 8) -> DataFrame:
    """Within the budget: the first packet of each focus, then the rest, by priority, focus and files → with rank and obligations.

    Two combining passes leave a row for each focus and the first `budget` of all, and the choice is made among those.
    """
    order = F.struct((-_picked(PRIORITY, F.col("priority"), "int")).alias("p"), (-_picked(FOCUS_RANK, F.col("focus"), "int")).alias("f"), "target_files", "focus", "id")
    x = packets.withColumn("place", order)
    first = x.groupBy("focus").agg(F.min_by(F.struct(*x.columns), "place").alias("r")).select("r.*")
    few = first.unionByName(x.orderBy("place").limit(budget)).dropDuplicates(["id"])  # at most a row a focus and `budget`
    few = few.withColumn("again", F.row_number().over(Window.partitionBy("focus").orderBy("place")) > 1)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("again", "place"))).filter(F.col("rank") <= budget)
    told = F.create_map(*[v for k, rows in OBLIGATIONS.items() for v in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(d).alias("acceptance")) for a, d in rows]))])
    filled = F.transform(told[F.col("focus")], lambda o: F.struct(F.replace(o["action"], F.lit("§"), F.col("primary_file")).alias("action"), o["acceptance"].alias("acceptance")))
    return few.select("rank", *COLUMNS, filled.alias("obligations"))


def radius(packets: DataFrame, links: DataFrame) -> DataFrame:
    """(id, path, incoming, outgoing): files one link (src, dst) away from a chosen packet's files, without these."""
    files = packets.select("id", F.explode("target_files").alias("path")).distinct()
    to = links.join(files.withColumnRenamed("path", "src"), "src").select("id", F.col("dst").alias("path"), F.lit(False).alias("incoming"))
    back = links.join(files.withColumnRenamed("path", "dst"), "dst").select("id", F.col("src").alias("path"), F.lit(True).alias("incoming"))
    return to.unionByName(back).groupBy("id", "path").agg(F.bool_or("incoming").alias("incoming"), F.bool_or(~F.col("incoming")).alias("outgoing")).join(files, ["id", "path"], "left_anti")


def members(packets: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(id, fingerprint): visible findings of the chosen packets of findings."""
    p = packets.filter(F.col("focus").isin("security_hotspot", "warning_heavy_hotspot", "dead_code_proof")).select("id", "focus", F.col("primary_file").alias("path"))
    f = reviewed.filter("status = 'Visible'").select("fingerprint", "path", "family")
    mine = (F.col("focus") == "warning_heavy_hotspot") | ((F.col("focus") == "security_hotspot") & (F.col("family") == "security")) | (F.col("id") == F.concat(F.lit("dead_code_proof:"), "fingerprint"))
    return p.join(f, "path").filter(mine).select("id", "fingerprint").distinct()
