"""What the scopes of a source bind: each use of a name to the declaration that it means.

A use meets the bindings of the scopes that it lies in by (file, scope, name), and the innermost that has one counts. Several symbols bound to one name of a
scope mean the first; a parameter, a variable without a known function, or a name that is written anywhere else means nothing known, so nothing in
other files is guessed for it. Imports are left to the tiers. The rows of a use are its nesting, and both sides of the join are spread by file and name.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.functions import masks, scopes
from codeloom.operators.graph import cut, dealt

KEY = ["file_path", "scope", "name"]


def facts(sources: DataFrame, keep: bool = True) -> DataFrame:
    """sources (file_path, text) → file_path and the columns of scopes.FIELDS, read once and kept for several uses unless told otherwise. Vue files by their scripts; null texts have no rows."""

    def run(batches):
        names = [f.split()[0] for f in scopes.FIELDS.split(", ")]
        for pdf in batches:
            rows = [(p, *r) for p, t, x in zip(pdf.file_path, pdf.text, pdf.language) for r in scopes.facts(masks.vue_script(t) if p.endswith(".vue") else t, x)]
            out = pd.DataFrame(rows, columns=["file_path", *names])
            yield out.astype({"to_line": "Int32", "to_start": "Int32"})

    x = sources.select("file_path", "text", E.language("file_path").alias("language")).filter(F.col("language").isin(scopes.LANGUAGES) & F.col("text").isNotNull())
    found = x.mapInPandas(run, f"file_path string, {scopes.FIELDS}")
    return cut(found) if keep else found


def bound_uses(found: DataFrame) -> DataFrame:
    """Facts → uses that a scope of their file binds, imports left out: file_path, line, name, kind, start, occurrence (from 0, of the name in its line) and target_*, null where what is bound isn't known.

    Facts are spread by file and name once; all that follows (each scope's meaning of a name, the innermost that a use lies in, writes, places in a line) goes by keys that hold these two.
    """
    bound = F.col("tag") == "bind"
    x = found.filter("tag in ('bind', 'use') and name is not null").select("tag", "file_path", "name", "kind", "line", "start", "scopes", "to_name", "to_line", "to_start").repartition("file_path", "name")
    x = x.select("*", F.posexplode(F.when(bound, F.slice("scopes", 1, 1)).otherwise(F.col("scopes"))).alias("depth", "scope")).drop("scopes")
    named = F.when(bound & F.col("to_name").isNotNull(), F.struct(F.col("to_start").alias("target_start"), F.col("to_name").alias("target_name"), F.col("to_line").alias("target_line"), F.col("kind").alias("target_kind")))
    scope = Window.partitionBy(*KEY)
    meaning = [F.min(named).over(scope).alias("s"), F.min(F.when(bound, F.col("kind") == "import")).over(scope).alias("imported"), F.min(F.when(bound, F.col("to_name").isNotNull())).over(scope).alias("known")]
    met = x.select("tag", "file_path", "name", "kind", "line", "start", "depth", "scope", *meaning).filter("tag = 'use' and imported is not null")
    inner = F.min_by(F.struct("scope", "imported", "known", "s"), "depth").alias("d")
    meant = met.groupBy("file_path", "name", "kind", "line", "start").agg(inner).select("file_path", "name", "kind", "line", "start", "d.scope", "d.imported", "d.known", "d.s.*")
    out = meant.withColumn("written", F.max(F.col("kind") == "write").over(scope)).filter("kind <> 'write' and not imported")
    sure = F.col("known") & ~F.col("written")
    place = Window.partitionBy("file_path", "line", "name").orderBy("start", "kind")
    targets = [F.when(sure, F.col(c)).alias(c) for c in ("target_name", "target_line", "target_start", "target_kind")]
    return out.select("file_path", "line", "name", "kind", "start", (F.row_number().over(place) - 1).alias("occurrence"), *targets)


def meant_uses(sources: DataFrame) -> DataFrame:
    """As bound_uses(facts(sources)), for callers that need no facts: what a name means lies in its file, so it is found where the file is parsed, and no facts are written or shuffled."""
    schema = pa.schema([("file_path", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("occurrence", pa.int32()), ("target_name", pa.string()), ("target_line", pa.int32()), ("target_start", pa.int32()), ("target_kind", pa.string())])

    def run(batches):
        path, known = None, []  # a file's texts stand one after the other, over the ends of batches too

        def columns(rows):
            cols = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            rows = []
            for p, t, x in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    rows += [(path, *r) for r in scopes.meant(known)]
                    path, known = p, []
                known += scopes.facts(masks.vue_script(t) if p.endswith(".vue") else t, x)
            yield columns(rows)
        yield columns([(path, *r) for r in scopes.meant(known)])

    x = sources.select("file_path", "text", E.language("file_path").alias("language")).filter(F.col("language").isin(scopes.LANGUAGES) & F.col("text").isNotNull())
    types = {"string": "string", "int32": "int"}
    return dealt(x).mapInArrow(run, ", ".join(f"{f.name} {types[str(f.type)]}" for f in schema))


def scoped_symbols(found: DataFrame) -> DataFrame:
    """Facts → symbols bound within a function or block: file_path, start_line, name. No other scope can mean them."""
    b = found.filter("tag = 'bind' and to_name is not null and scopes[0] <> 0")
    return b.select("file_path", F.col("to_line").alias("start_line"), F.col("to_name").alias("name")).distinct()


def with_bound_symbols(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols, and those that scopes bind which a parser has not seen: functions held by variables, several declared in one line."""
    b = found.filter("tag = 'bind' and to_name is not null and name = to_name").select("file_path", F.col("to_line").alias("start_line"), F.col("to_name").alias("name"), F.col("to_start").alias("start"), F.initcap("kind").alias("kind"))
    place = F.row_number().over(Window.partitionBy("file_path", "start_line", "name").orderBy("start"))
    seen = symbols.groupBy("file_path", "start_line", "name").agg(F.count_distinct("id").alias("n"))
    more = b.withColumn("place", place).join(seen, ["file_path", "start_line", "name"], "left").filter(F.col("place") > F.coalesce("n", F.lit(0)))
    key = F.concat_ws("#", "file_path", "name", F.col("start_line").cast("string"), F.when(F.col("place") > 1, F.col("place").cast("string")))
    more = more.select(F.xxhash64(key).alias("symbol_index"), key.alias("id"), "file_path", "kind", "name", F.col("name").alias("qualified_name"), F.lit("Public").alias("visibility"), "start_line", F.col("start_line").alias("end_line"))
    return symbols.unionByName(more, allowMissingColumns=True)


def with_bound_calls(refs: DataFrame, uses: DataFrame) -> DataFrame:
    """References, and calls that scopes bind which a parser has not seen, as those in a line that declares something."""
    known = refs.select("file_path", "line", F.col("target_name").alias("name")).distinct()
    more = uses.filter("kind in ('call', 'new') and target_name is not null").select("file_path", "line", "name").distinct().join(known, ["file_path", "line", "name"], "left_anti")
    more = more.select(F.xxhash64("file_path", "line", F.lit("Call"), "name").alias("ref_index"), "file_path", F.lit("Call").alias("kind"), F.col("name").alias("target_name"), "line", F.lit("Free").alias("call_form"))
    return refs.unionByName(more, allowMissingColumns=True)


def open_symbols(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols without those that only a scope of their own file can mean."""
    return symbols.join(scoped_symbols(found), ["file_path", "start_line", "name"], "left_anti").select(*symbols.columns)


def lexical_targets(refs: DataFrame, uses: DataFrame, symbols: DataFrame, found: DataFrame) -> DataFrame:
    """(ref_index, target_symbol_id): for references that scopes bind, the symbols that uses of their name in their line mean; null where none of them means a known one."""
    r = refs.filter("call_form = 'Free' or kind in ('Extends', 'Implements', 'Type')").select("ref_index", "file_path", "line", F.col("target_name").alias("name"), (F.col("kind") == "Call").alias("called"))
    u = uses.select("file_path", "line", "name", (F.col("kind") != "name").alias("called"), "target_name", "target_line", "target_start").distinct()
    # Symbols of one line and name stand in the order of their bindings.
    by = ["file_path", "target_line", "target_name"]
    bound = found.filter("tag = 'bind' and to_name is not null").select("file_path", F.col("to_line").alias("target_line"), F.col("to_name").alias("target_name"), F.col("to_start").alias("target_start"))
    targets = bound.distinct().withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("target_start")))
    s = symbols.select("file_path", F.col("start_line").alias("target_line"), F.col("name").alias("target_name"), F.col("id").alias("target_symbol_id"))
    s = s.distinct().withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.length("target_symbol_id"), "target_symbol_id")))
    named = targets.join(s, [*by, "place"], "left").select(*by, "target_start", "target_symbol_id")
    met = r.join(u, ["file_path", "line", "name", "called"]).join(named, [*by, "target_start"], "left").select("ref_index", "target_symbol_id").distinct()
    some = met.filter("target_symbol_id is not null")
    return cut(some.unionByName(met.join(some.select("ref_index"), "ref_index", "left_anti")))
