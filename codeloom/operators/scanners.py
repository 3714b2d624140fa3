"""What scanners find: where it meets the graph, how it is merged and counted, in which order it is told, and how outside input gets there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import model as M
from codeloom.operators.graph import ENTRY_RELATIONS, RELATION_RANK, cut
from codeloom.operators.text import SEVERITIES

#: Rule families by what their rule ids begin with.
FAMILIES = {"complexity": "complexity/", "security": "security/", "misuse": "framework_misuse/"}


def edges_at(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges that start at given places (file_path, line, target_name; a null name means any edge of that line)."""
    p = places.select(F.col("file_path").alias("__f"), F.col("line").alias("__l"), F.col("target_name").alias("__t")).distinct()
    met = edges.join(p, (F.col("source_file_path") == F.col("__f")) & (F.col("line") == F.col("__l")) & (F.col("__t").isNull() | (F.col("reference_target_name") == F.col("__t"))), "left_semi")
    return met


def merged(native: DataFrame, structural: DataFrame) -> DataFrame:
    """Findings (fingerprint, file_path, line, category, scanner) of two scanners as one row for each fingerprint, with all that support it; the native one's fields win."""

    def one(x: DataFrame, prefix: str) -> DataFrame:
        return x.groupBy("fingerprint").agg(F.min(F.struct("file_path", "line", "category")).alias(f"{prefix}_at"), F.array_sort(F.collect_set("scanner")).alias(f"{prefix}_by"))

    both = one(native, "n").join(one(structural, "s"), "fingerprint", "full")
    at = F.coalesce("n_at", "s_at")
    none = F.array().cast("array<string>")
    by = F.array_union(F.coalesce("n_by", none), F.coalesce("s_by", none))
    return both.select("fingerprint", at["file_path"].alias("file_path"), at["line"].alias("line"), at["category"].alias("category"), by.alias("scanners"))


def family_counts(matches: DataFrame) -> DataFrame:
    """One row: matches (rule) of each family."""
    return matches.agg(*[F.count_if(F.col("rule").startswith(start)).alias(f"{name}_matches") for name, start in FAMILIES.items()])


def security_order() -> list[Column]:
    """Worst first, then by place and text."""
    return [F.desc(M.rank("severity", SEVERITIES)), F.col("file_path"), F.col("line"), F.col("message")]


def literal_order(value: str = "value") -> list[Column]:
    return [F.col("file_path"), F.col("line"), F.col(value)]


def match_order() -> list[Column]:
    return [F.col("file_path"), F.col("line"), F.col("rule"), F.col("token")]


def told(found: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first `most` of an order, with their rank. Each task hands on its first ones only."""
    first = found.orderBy(*order).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def security_reach(edges: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """(path, depth, score, way) of what roots (path) reach within `most` links, themselves left out: depth of the first
    arrival, and the best-scored of the ways that best lead to each file at each number of links.

    A way scores the ranks of its relations less its length; a link counts by its best relation and needn't be sure.
    No way visits a file twice. Of ways of equal score the first in order stays, so that a file has one at each number of links.
    """
    rank = F.create_map(*[v for r, n in RELATION_RANK.items() for v in (F.lit(r), F.lit(n))])[F.col("relation_kind")]
    use = edges.filter(F.col("relation_kind").isin(ENTRY_RELATIONS) & (F.col("source_file_path") != F.col("target_file_path")))
    step = cut(use.groupBy(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).agg(F.max(rank).alias("r")))
    start = roots.select("path").distinct()
    front = cut(start.select("path", F.lit(0).alias("score"), F.array("path").alias("way")))
    found = None
    for depth in range(1, most + 1):
        got = front.join(step, F.col("path") == F.col("src")).filter(~F.array_contains("way", F.col("dst")))
        got = got.select(F.col("dst").alias("path"), (F.col("score") + F.col("r") - 1).alias("score"), F.concat("way", F.array("dst")).alias("way"))
        front = cut(got.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "way")).alias("b")).select("path", (-F.col("b.s")).alias("score"), "b.way"))
        if not front.head(1):
            break
        here = front.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
    if found is None:
        return front.select("path", F.lit(0).alias("depth"), "score", "way").limit(0)
    best = found.groupBy("path").agg(F.min("depth").alias("depth"), F.min(F.struct((-F.col("score")).alias("s"), "depth", "way")).alias("b"))
    return best.join(start, "path", "left_anti").select("path", "depth", (-F.col("b.s")).alias("score"), F.col("b.way").alias("way"))


def causal_ways(edges: DataFrame, roots: DataFrame, most: int = 8) -> DataFrame:
    """(path, score, way) of what roots (path) reach within `most` links, themselves left out: the way that says most about cause.

    A way is better by the sum of its relations' ranks, then by links that name symbols at both ends, by links with a known occurrence or name, and by being
    short; the first in order of equal ones stays. Labels are corrected: a file whose way has become better goes on again, with only those files in a round's join. No way visits a
    file twice, or a root but the one that it starts from. score: these four numbers.
    """
    rank = F.create_map(*[v for r, n in RELATION_RANK.items() for v in (F.lit(r), F.lit(n))])[F.col("relation_kind")]
    use = edges.filter(F.col("relation_kind").isin(ENTRY_RELATIONS) & (F.col("source_file_path") != F.col("target_file_path")))
    symbols = (F.col("source_symbol_id").isNotNull() & F.col("target_symbol_id").isNotNull()).cast("int")
    named = ((F.col("occurrence_index") > 0) | F.col("reference_target_name").isNotNull()).cast("int")
    point = F.struct(rank.alias("r"), symbols.alias("s"), F.coalesce(named, F.lit(0)).alias("o"))
    step = use.groupBy(F.col("source_file_path").alias("src"), F.col("target_file_path").alias("dst")).agg(F.max(point).alias("e"))
    start = roots.select("path").distinct()
    step = cut(step.join(start.select(F.col("path").alias("dst")), "dst", "left_anti"))
    none = F.struct(*[F.lit(0).alias(c) for c in ("r", "s", "o", "l")])
    front = cut(start.select("path", none.alias("score"), F.array("path").alias("way")))
    best = front
    for _ in range(most):
        got = front.join(step, F.col("path") == F.col("src")).filter(~F.array_contains("way", F.col("dst")))
        more = F.struct((F.col("score.r") + F.col("e.r")).alias("r"), (F.col("score.s") + F.col("e.s")).alias("s"), (F.col("score.o") + F.col("e.o")).alias("o"), (F.col("score.l") - 1).alias("l"))
        got = got.select(F.col("dst").alias("path"), more.alias("score"), F.concat("way", F.array("dst")).alias("way"))
        top = got.groupBy("path").agg(F.max("score").alias("score"))
        got = got.join(top, ["path", "score"]).groupBy("path", "score").agg(F.min("way").alias("way"))
        known = best.select("path", F.col("score").alias("had"))
        front = cut(got.join(known, "path", "left").filter(F.col("had").isNull() | (F.col("score") > F.col("had"))).select("path", "score", "way"))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("path"), "path", "left_anti").unionByName(front))
    return best.join(start, "path", "left_anti")
