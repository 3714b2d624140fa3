"""Policies over findings, baseline differences, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E

#: Order of statuses in reports; rise of confidence that counts as worse.
STATUS_ORDER = ["FirstObserved", "NotCompared", "New", "Worsened", "Improved", "Unchanged", "Resolved"]
CONFIDENCE_STEP = 75


def suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings with status and rule: the first rule that matches, policies before exclusion rules.

    rules: rule_id, source (Policy or Rule), family, path_regex (of a glob), value, below (severity in millis). A null
    field matches anything. Rules without a value have no key to join on; they are few and are broadcast only if counted so.
    """
    order = F.when(F.col("source") == "Policy", 0).otherwise(1)
    r = rules.select(F.struct(order.alias("o"), "rule_id").alias("r"), F.col("family").alias("rf"), F.col("path_regex").alias("rp"), F.col("value").alias("rv"), F.col("below").alias("rb"))
    f = findings.select("fingerprint", "path", "family", "value", "severity_millis")
    rest = (F.col("rf").isNull() | (F.col("rf") == F.col("family"))) & (F.col("rp").isNull() | F.expr("path rlike rp")) & (F.col("rb").isNull() | (F.col("severity_millis") < F.col("rb")))
    keyed = f.join(r.filter("rv is not null"), (F.col("rv") == F.col("value")) & rest)
    # Rules are hand-written: a bounded table. Those by family are joined on it, the rest tested one by one.
    by_family = f.join(r.filter("rv is null and rf is not null"), (F.col("rf") == F.col("family")) & rest)
    hits = keyed.select("fingerprint", "r").unionByName(by_family.select("fingerprint", "r"))
    free = [x.asDict() for x in rules.filter("value is null and family is null").limit(1001).collect()]
    if len(free) > 1000:
        raise ValueError("more than 1000 rules without value and family")
    for x in free:
        cond = F.lit(True)
        if x["path_regex"] is not None:
            cond &= F.col("path").rlike(x["path_regex"])
        if x["below"] is not None:
            cond &= F.col("severity_millis") < x["below"]
        hits = hits.unionByName(f.filter(cond).select("fingerprint", F.struct(F.lit(0 if x["source"] == "Policy" else 1).alias("o"), F.lit(x["rule_id"]).alias("rule_id")).alias("r")))
    best = hits.groupBy("fingerprint").agg(F.min("r").alias("r"))
    return findings.join(best, "fingerprint", "left").select(*findings.columns, F.when(F.col("r").isNull(), "Visible").when(F.col("r.o") == 0, "AcceptedByPolicy").otherwise("SuppressedByRule").alias("status"), F.col("r.rule_id").alias("rule_id"))


def policy_rules(spark, policy: dict, exclusions: list[dict] | dict) -> DataFrame:
    """Policy and exclusion JSON as rules: globs become regular expressions."""
    rows = [(str(p.get("id", f"policy-{i}")), "Policy", p.get("family"), E.glob_regex(p["path"]) if p.get("path") else None, p.get("value"), p.get("below")) for i, p in enumerate(policy.get("accept", []))]
    listed = exclusions.get("rules", []) if isinstance(exclusions, dict) else exclusions
    rows += [(str(r.get("id", f"rule-{i}")), "Rule", r.get("type"), E.glob_regex(r["path"]) if r.get("path") else None, r.get("value") or r.get("symbol"), r.get("below")) for i, r in enumerate(listed)]
    return spark.createDataFrame(rows, "rule_id string, source string, family string, path_regex string, value string, below int")


def review_summary(reviewed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return reviewed.agg(F.count(F.lit(1)).alias("total"), n("Visible").alias("visible"), n("AcceptedByPolicy").alias("accepted"), n("SuppressedByRule").alias("suppressed"))


def convergence(before: DataFrame | None, now: DataFrame, comparable: bool = True) -> DataFrame:
    """(fingerprint, status, counts, severities): findings of one fingerprint are counted together and compared by their worst."""

    def grouped(x: DataFrame, p: str) -> DataFrame:
        return x.groupBy("fingerprint").agg(F.count(F.lit(1)).alias(f"{p}_count"), F.max("severity_millis").alias(f"{p}_severity"), F.max("confidence_millis").alias(f"{p}_confidence"), F.min("path").alias(f"{p}_path"))

    new = grouped(now, "now")
    if before is None or not comparable:
        return new.select("fingerprint", F.lit("FirstObserved" if before is None else "NotCompared").alias("status"), F.lit(None).cast("long").alias("before_count"), "now_count", F.lit(None).cast("int").alias("before_severity"), "now_severity", F.col("now_path").alias("path"))
    both = grouped(before, "before").join(new, "fingerprint", "full")
    worse = (F.col("now_severity") > F.col("before_severity")) | (F.col("now_confidence") > F.col("before_confidence") + CONFIDENCE_STEP)
    better = (F.col("now_severity") < F.col("before_severity")) | (F.col("now_confidence") < F.col("before_confidence") - CONFIDENCE_STEP)
    status = F.when(F.col("before_count").isNull(), "New").when(F.col("now_count").isNull(), "Resolved").when(worse, "Worsened").when(better, "Improved").otherwise("Unchanged")
    return both.select("fingerprint", status.alias("status"), "before_count", "now_count", "before_severity", "now_severity", F.coalesce("now_path", "before_path").alias("path"))


def convergence_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def attention(delta: DataFrame, bar: int = 700, limit: int = 20) -> DataFrame:
    """New or worse findings above a bar, worst first."""
    return delta.filter(F.col("status").isin("New", "Worsened") & (F.col("now_severity") >= bar)).orderBy(F.desc("now_severity"), "fingerprint").limit(limit)


#: Triggers of the verdict, worst first: name, verdict, condition over the counters.
TRIGGERS = [
    ("incomplete_input_coverage", "Block", "incomplete_inputs > 0"),
    ("incomplete_parse_coverage", "Block", "incomplete_parses > 0"),
    ("incomplete_scanner_coverage", "Block", "incomplete_scanners > 0"),
    ("incomplete_external_checks", "Block", "incomplete_tools > 0"),
    ("security_regression", "Block", "security_regressions > 0"),
    ("cycle_regression", "Block", "cycle_regressions > 0"),
    ("high_risk_attention", "Block", "high_attention > 0"),
    ("contract_change", "Warn", "contract_changes > 0"),
    ("new_smell", "Warn", "smell_regressions > 0"),
    ("new_bottleneck", "Warn", "bottleneck_regressions > 0"),
    ("assessment_regression", "Warn", "assessment_regressions > 0"),
    ("visible_findings_grew", "Warn", "visible_delta > 0"),
    ("wide_radius", "Warn", "radius > 50"),
]


def guard(counters: DataFrame) -> DataFrame:
    """One row of counters → verdict, its reason (the first trigger that fires) and all triggers. Missing counters are 0."""
    names = {w for *_, c in TRIGGERS for w in [c.split()[0]]}
    x = counters.select(*[F.coalesce(F.col(n), F.lit(0)).alias(n) if n in counters.columns else F.lit(0).alias(n) for n in sorted(names)])
    fired = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(f"{v}:{n}")) for n, v, c in TRIGGERS]))
    x = x.select(fired.alias("triggers"))
    first = F.get("triggers", F.lit(0))
    return x.select(F.when(first.isNull(), "Allow").otherwise(F.split_part(first, F.lit(":"), F.lit(1))).alias("verdict"), F.split_part(first, F.lit(":"), F.lit(2)).alias("reason"), F.array_join("triggers", ",").alias("triggers"))


def tuning(literals: DataFrame, least: int = 3) -> DataFrame:
    """How many repeated literals each threshold of files would leave, and the least threshold that leaves under a tenth."""
    per = literals.groupBy("files").agg(F.count_distinct("value").alias("values_"))
    total = F.sum("values_").over(Window.partitionBy())
    above = F.sum("values_").over(Window.orderBy(F.desc("files")))
    return per.select(F.col("files").alias("threshold"), above.alias("kept"), (above * 10 <= total).alias("suggested")).filter(F.col("threshold") >= least)


def triage(reviewed: DataFrame, top: int = 10) -> DataFrame:
    """Clusters of visible findings by zone and family, the weightiest first: where to start."""
    x = reviewed.filter("status = 'Visible'").groupBy(E.zone("path").alias("zone"), "family").agg(F.count(F.lit(1)).alias("findings"), F.max("severity_millis").alias("worst"), F.sum("severity_millis").alias("weight"))
    return x.orderBy(F.desc("weight"), F.desc("worst"), "zone", "family").limit(top)


def comparable(before: dict, now: dict) -> bool:
    """Whether two analyses may be compared: the same scope, policy, environment and rules."""
    return all(before.get(k) == now.get(k) for k in ("scope", "policy", "environment", "rules"))


def adopted(decisions: list[dict], findings: set[str]) -> list[dict]:
    """Reviewed decisions that name a present finding, a reason and a reviewer; others are refused."""
    for d in decisions:
        missing = [k for k in ("fingerprint", "reason", "reviewer", "decision") if not d.get(k)]
        if missing or d["decision"] not in ("accept", "reject", "defer"):
            raise ValueError(f"decision lacks {missing or 'a known decision'}")
    return [d for d in decisions if d["fingerprint"] in findings]
