"""Edge views, admission, projections and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import model as M
from codeloom.functions import expr as E

TEST_NOTE = "; target matches test-source conventions, production visibility is unproven"
RECOVERY_NOTE = "; parser_recovery: endpoint file required syntax recovery"


def structural_view(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("layer") == "Structural")


def runtime_view(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("layer").isin(M.LAYERS[1:]))


def dependency_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("kind").isin(M.DEPENDENCY_KINDS))


def strong_edges(edges: DataFrame) -> DataFrame:
    return dependency_edges(edges).filter(~F.col("kind").isin("Type", "TypeImport") & (F.col("strength") != "Inferred"))


def admitted_refs(refs: DataFrame) -> DataFrame:
    """References whose target is a name and not a piece of code."""
    left = F.ltrim("target_name")
    return refs.filter(~(left.startswith("{") | left.startswith("(") | left.contains("\n")))


def relation_of(kind: Column) -> Column:
    return F.when(kind.isin("Type", "TypeImport"), "TypeUse").otherwise(kind)


def strength_of(tier: Column) -> Column:
    return F.when(tier.isin("SameFile", "ImportScoped"), "Hard").otherwise("Inferred")


def filled(edges: DataFrame) -> DataFrame:
    """Defaults for what older graphs lack."""
    defaults = {"relation_kind": relation_of(F.col("kind")), "layer": F.lit("Structural"), "strength": strength_of(F.col("resolution_tier")), "origin": F.lit("Resolver"), "occurrence_index": F.lit(0)}
    return edges.withColumns({c: F.coalesce(F.col(c), v) if c in edges.columns else v for c, v in defaults.items()})


def admitted_edges(edges: DataFrame) -> DataFrame:
    """Production edges into test code are inferred; a symbol doesn't extend, implement or override itself."""
    doubt = (F.col("origin") != "Policy") & ~E.is_test_path("source_file_path") & E.is_test_path("target_file_path")
    out = edges.withColumns(
        {
            "strength": F.when(doubt, "Inferred").otherwise(F.col("strength")),
            "confidence_millis": F.when(doubt, F.least("confidence_millis", F.lit(500))).otherwise(F.col("confidence_millis")),
            "reason": F.when(doubt, F.concat("reason", F.lit(TEST_NOTE))).otherwise(F.col("reason")),
        }
    )
    itself = F.col("relation_kind").isin("Extends", "Implements", "Overrides") & F.col("source_symbol_id").eqNullSafe(F.col("target_symbol_id"))
    return out.filter(~itself)


def recovery_downgrade(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Edges at files whose parse needed recovery are inferred; policy edges excepted."""
    bad = outcomes.filter("required_recovery").select("file_path").distinct()
    a, b = bad.select(F.col("file_path").alias("source_file_path"), F.lit(True).alias("__a")), bad.select(F.col("file_path").alias("target_file_path"), F.lit(True).alias("__b"))
    hit = (F.col("origin") != "Policy") & (F.col("__a").isNotNull() | F.col("__b").isNotNull())
    joined = edges.join(a, "source_file_path", "left").join(b, "target_file_path", "left")
    return joined.withColumns(
        {
            "strength": F.when(hit, "Inferred").otherwise(F.col("strength")),
            "confidence_millis": F.when(hit, F.least("confidence_millis", F.lit(500))).otherwise(F.col("confidence_millis")),
            "reason": F.when(hit & ~F.col("reason").contains("parser_recovery"), F.concat("reason", F.lit(RECOVERY_NOTE))).otherwise(F.col("reason")),
        }
    ).select(*edges.columns)


def export_id(symbol: Column, known: Column, kind: Column, path: Column) -> Column:
    """A symbol's id, or its file's where it is null, unknown or a module."""
    return F.when(symbol.isNull() | known.isNull() | (kind == "Module"), F.concat(F.lit("file:"), path)).otherwise(symbol)


def graph_nodes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files and symbols but modules as nodes; of equal ids a file, then the first symbol, wins."""
    cols = ["id", "kind", "name", "qualified_name", "file_path", "parent_symbol_id", "owner_type_name", "visibility", "parameter_count", "required_parameter_count", "start_line", "end_line"]
    f = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("FILE").alias("kind"), F.col("path").alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"), "language", F.lit(0).alias("__o"), F.lit(0).cast("long").alias("symbol_index"))
    s = symbols.filter("kind != 'Module'").select(*[F.upper("kind").alias("kind") if c == "kind" else c for c in cols], F.lit(1).alias("__o"), "symbol_index")
    first = F.row_number().over(Window.partitionBy("id").orderBy("__o", "symbol_index"))
    out = f.unionByName(s, allowMissingColumns=True).withColumn("__n", first).filter("__n = 1")
    language = files.select(F.col("path").alias("file_path"), F.col("language").alias("__l"))
    return out.join(language, "file_path", "left").withColumn("language", F.coalesce("language", "__l")).select("id", "kind", "name", "qualified_name", "file_path", "language", *[c for c in cols if c not in ("id", "kind", "name", "qualified_name", "file_path")])


def with_export_ids(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    known = symbols.groupBy("id").agg(F.min_by("kind", "symbol_index").alias("k"))
    s, t = known.select(F.col("id").alias("source_symbol_id"), F.col("k").alias("__sk")), known.select(F.col("id").alias("target_symbol_id"), F.col("k").alias("__tk"))
    out = edges.join(s, "source_symbol_id", "left").join(t, "target_symbol_id", "left")
    call = (F.col("relation_kind") == "Call") & (F.col("kind") == "Call")
    relation = F.when(call & F.col("__tk").isin("Class", "Struct"), "INSTANTIATE").when(call & F.col("source_symbol_id").isNull(), "TOP_LEVEL_CALL").otherwise(snake(F.col("relation_kind"), upper=True))
    return out.withColumns(
        {
            "from": export_id(F.col("source_symbol_id"), F.col("__sk"), F.col("__sk"), F.col("source_file_path")),
            "to": export_id(F.col("target_symbol_id"), F.col("__tk"), F.col("__tk"), F.col("target_file_path")),
            "type": relation,
        }
    )


def snake(name: Column, upper: bool = False) -> Column:
    out = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.upper(out) if upper else F.lower(out)


#: How edges of a pair and reason are merged, and how many a task merges at once.
MERGED = {"n": "sum", "at": "min", "line": "min", "c": "max", "s": "max", "t": "max", "o1": "min", "o2": "max"}
MERGED_AT_ONCE = 200_000


def _merged(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys merged within some batches of a task."""

    def merged() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        got = table.group_by(keys, use_threads=False).aggregate(list(MERGED.items()))
        columns = {c: got[f"{c}_{MERGED[c]}" if c in MERGED else c] for c in table.column_names}
        yield from pa.table(columns).cast(table.schema).to_batches()

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= MERGED_AT_ONCE:
            yield from merged()
            held, rows = [], 0
    if rows:
        yield from merged()


def dependency_rollup(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges per (from, to, type, kinds, layer): counts, the least line, the best confidence, strength and tier, reasons, origin.

    Each task merges its edges of a pair and reason before they are dealt out by pair, once: so a pair with very many edges makes few rows, and distinct
    reasons are folded where they lie, so that its list is short.
    """
    e = with_export_ids(edges, symbols)
    keys = ["from", "to", "type", "reference_kind", "layer"]
    e = e.select(
        "from", "to", "type", snake(F.col("kind")).alias("reference_kind"), snake(F.col("layer")).alias("layer"), "reason", F.lit(1).cast("long").alias("n"), F.col("edge_index").alias("at"), "line", F.col("confidence_millis").alias("c"),
        M.rank("strength", M.STRENGTHS).alias("s"), M.rank("resolution_tier", M.TIERS).alias("t"), F.col("origin").alias("o1"), F.col("origin").alias("o2"),
    )
    dealt = e.mapInArrow(lambda batches: _merged(batches, [*keys, "reason"]), e.schema).repartition(*keys)
    once = dealt.groupBy(*keys, "reason").agg(*[getattr(F, how)(c).alias(c) for c, how in MERGED.items()])
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "reason"))), F.lit(None).cast("string"),
        lambda acc, x: F.when(acc.isNull(), x["reason"]).when(F.contains(acc, x["reason"]), acc).otherwise(F.concat(acc, F.lit(" | "), x["reason"])),
    )
    out = once.groupBy(*keys).agg(F.sum("n").alias("occurrence_count"), F.min("line").alias("line"), F.max("c").alias("confidence_millis"), F.max("s").alias("s"), F.max("t").alias("t"), F.min("o1").alias("o1"), F.max("o2").alias("o2"), fold.alias("reason"))
    out = out.select("from", "to", "type", "reference_kind", F.lower("type").alias("relation_kind"), "layer", *out.columns[5:])
    keys = out.columns[:6]
    return out.select(
        *keys, snake(M.named(F.col("s"), M.STRENGTHS)).alias("strength"), F.when(F.col("o1") == F.col("o2"), F.lower("o1")).otherwise("mixed").alias("origin"),
        snake(M.named(F.col("t"), M.TIERS)).alias("resolution_tier"), "confidence_millis", "reason", "line", "occurrence_count",
    )


def evidence(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row for each edge, with its positional id."""
    e = with_export_ids(edges, symbols)
    return e.select(F.concat(F.lit("evidence:"), "edge_index").alias("evidence_id"), "from", "to", "type", F.col("kind").alias("reference_kind"), "layer", "strength", "origin", "resolution_tier", "confidence_millis", "reason", "line", "occurrence_index")


def atlas(edges: DataFrame) -> DataFrame:
    """Per pair of files: edges, kinds, the surest tier, the truncated mean confidence. Self pairs stay."""
    return edges.groupBy("source_file_path", "target_file_path").agg(
        F.count(F.lit(1)).alias("edge_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        M.named(F.max(M.rank("resolution_tier", M.TIERS)), M.TIERS).alias("strongest_tier"), F.expr("sum(confidence_millis) div count(1)").cast("int").alias("average_confidence"),
    )


def inout_edge_counts(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("source_file_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target_file_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("path").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


def inout_file_counts(edges: DataFrame) -> DataFrame:
    pairs = edges.filter("source_file_path != target_file_path").select("source_file_path", "target_file_path").distinct()
    both = pairs.select(F.col("source_file_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("target_file_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("path").agg(F.sum("o").alias("out_files"), F.sum("i").alias("in_files"))


def neighbours(edges: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Files around one: edges, truncated mean confidence, direction, relation counts."""
    out_ = edges.filter((F.col("source_file_path") == path) & (F.col("target_file_path") != path)).select(F.col("target_file_path").alias("path"), F.lit("out").alias("d"), "confidence_millis", "relation_kind")
    in_ = edges.filter((F.col("target_file_path") == path) & (F.col("source_file_path") != path)).select(F.col("source_file_path").alias("path"), F.lit("in").alias("d"), "confidence_millis", "relation_kind")
    both = out_.unionByName(in_)
    found = both.groupBy("path").agg(F.count(F.lit(1)).alias("edge_count"), F.expr("sum(confidence_millis) div count(1)").cast("int").alias("average_confidence"), F.when(F.min("d") == F.max("d"), F.min("d")).otherwise("mixed").alias("direction"))
    order = [F.desc("edge_count"), F.desc("average_confidence"), "path"]
    return found.orderBy(*order).limit(limit) if limit else found


def relation_histogram(edges: DataFrame, path: str) -> DataFrame:
    other = F.when(F.col("source_file_path") == path, F.col("target_file_path")).otherwise(F.col("source_file_path"))
    at = edges.filter(((F.col("source_file_path") == path) | (F.col("target_file_path") == path)) & (F.col("source_file_path") != F.col("target_file_path")))
    return at.select(other.alias("path"), "relation_kind").groupBy("path", "relation_kind").agg(F.count(F.lit(1)).alias("n"))
