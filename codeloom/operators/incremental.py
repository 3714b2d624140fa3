"""Resolution kept from run to run: only files whose references have changed are resolved again.

The state is a published generation: a fingerprint of each file's references, and the best that each name and number of arguments means in it, so that it doesn't depend on
how references are numbered. References are read once a run and kept in columns; what they resolve to is joined to them when it is asked for. It holds for one context, that of all symbols and imports: when that changes, the whole state is dropped. Fingerprints are
sums and exclusive ors of row hashes, which tasks combine; of the context a row for each table comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import resolution, tiers
from codeloom.operators.graph import put_by
from codeloom.sources import sinks

KEPT = ["target_symbol_id", "resolution_tier", "confidence_millis"]


def context_fingerprint(*tables: DataFrame) -> str:
    """The same for the same rows, in any order and partitioning."""
    parts = []
    for t in tables:
        h = [F.xxhash64(F.lit(seed), *[F.struct(c) for c in sorted(t.columns)]) for seed in (1, 2)]
        r = t.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x.cast("decimal(38,0)")).alias(f"s{k}") for k, x in enumerate(h)]).first()
        parts.append(f"{r.n}:{r.s0}:{r.s1}")
    return "|".join(parts)


def reference_prints(rows: DataFrame) -> DataFrame:
    """References → (file_path, print, n): a 128-bit fingerprint of a file's references without their numbers, in any order, added up in four parts that don't overflow."""
    fields = [F.struct(c) for c in sorted(rows.columns) if c != "ref_index"]
    part = lambda seed, by: F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *fields), by).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return rows.groupBy("file_path").agg(F.concat_ws(":", F.count(F.lit(1)), *[F.hex(part(seed, by)) for seed in (1, 2) for by in (0, 32)]).alias("print"), F.count(F.lit(1)).alias("n"))


def resolve_incrementally(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame, root: str) -> tuple[DataFrame, dict]:
    """resolution.resolve, with the state in the folder `root` → (ref_index, target_symbol_id, resolution_tier, confidence_millis, reused), and how much was reused."""
    spark = refs.sparkSession
    context = f"best:{context_fingerprint(symbols, imports, imported_files)}"
    rows = put_by(refs)
    prints = put_by(reference_prints(rows))
    valid = sinks.identity(spark, root).get("context") == context
    state = sinks.current(spark, root) if valid else {}
    same = prints.select("file_path", "print", "n").join(state["files"].select("file_path", "print"), ["file_path", "print"], "left_semi") if state else prints.limit(0)
    same = put_by(same.select("file_path", "n"))
    files = same.select("file_path")
    best = tiers.best_asks(rows.join(files, "file_path", "left_anti"), symbols, imports, imported_files)
    if state:
        best = best.unionByName(state["best"].join(files, "file_path", "left_semi"))
    name = sinks.publish(spark, root, {"files": prints.select("file_path", "print"), "best": best}, {"context": context})
    every, kept = (x.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("refs")).first() for x in (prints, same))
    work = {"context_changed": not valid, "files_reused": kept.files, "references_reused": kept.refs, "files_processed": every.files - kept.files, "references_processed": every.refs - kept.refs}
    asked = rows.select("ref_index", "file_path", "target_name", F.col("arity").cast("int").alias("arity")).join(files.withColumn("reused", F.lit(True)), "file_path", "left").withColumn("reused", F.col("reused").isNotNull())
    b = spark.read.schema(best.schema).parquet(f"{root}/{name}/best").select(*[F.col(c).alias(f"__{c}") for c in tiers.ASKED], "rank", "symbol_index", "id", "n")
    on = F.col("file_path").eqNullSafe(F.col("__file_path")) & (F.col("target_name") == F.col("__target_name")) & F.col("arity").eqNullSafe(F.col("__arity"))
    found = asked.join(b, on, "left").select("ref_index", "rank", "symbol_index", "id", "n", "reused")
    # A number that files of both kinds have is told of both.
    out = resolution.chosen(found, F.min("reused").alias("least"), F.max("reused").alias("most"))
    return out.select("ref_index", *KEPT, F.explode(F.array_distinct(F.array("least", "most"))).alias("reused")), work
