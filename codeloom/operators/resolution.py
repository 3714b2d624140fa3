"""From references to edges: tiers, picks, imports, overrides."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import model as M
from codeloom.functions import expr as E
from codeloom.operators import tiers
from codeloom.operators.graph import cut


def occurrence_index(refs: DataFrame) -> DataFrame:
    """0-based ordinal of each reference among those of its file, line and target."""
    w = Window.partitionBy("file_path", "line", "target_name").orderBy("ref_index")
    return refs.withColumn("occurrence_index", F.row_number().over(w) - 1)


def fits(arity, required, total):
    """A call with that many arguments may mean a symbol with these parameters; unknown numbers always may."""
    return arity.isNull() | total.isNull() | ((F.coalesce(required, F.lit(0)) <= arity) & (arity <= total))


def candidates(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame) -> DataFrame:
    """(ref_index, tier_rank, symbol_index, id, n, fit) of every tier.

    imports: file_path, binding, qualified. imported_files: file_path, imported_path. Global candidates are grouped
    by signature first, so that a name that very many symbols share makes a few rows for each reference, not one for each symbol.
    """
    s = symbols.select("symbol_index", "id", F.col("file_path").alias("sf"), "name", "parameter_count", "required_parameter_count")
    r = refs.select("ref_index", "file_path", "target_name", "arity")
    fit = fits(F.col("arity"), F.col("required_parameter_count"), F.col("parameter_count")).alias("fit")
    cols = ["ref_index", "tier_rank", "symbol_index", "id", "n", "fit"]

    def tier(df: DataFrame, rank: int) -> DataFrame:
        n = F.col("n") if "n" in df.columns else F.lit(1)
        return df.select("ref_index", F.lit(rank).alias("tier_rank"), "symbol_index", "id", n.cast("long").alias("n"), fit)[cols]

    same = r.join(s, (F.col("file_path") == F.col("sf")) & (F.col("target_name") == F.col("name")))
    declared = imports.select("file_path", F.col("binding").alias("target_name"), F.col("qualified").alias("q")).distinct()
    through = r.join(declared, ["file_path", "target_name"]).join(s, F.col("q") == F.col("id"))
    free = r.join(declared.select("file_path", "target_name").distinct(), ["file_path", "target_name"], "left_anti")  # a declared import that leads nowhere stops here
    near = free.join(imported_files.distinct(), "file_path").join(s, (F.col("imported_path") == F.col("sf")) & (F.col("target_name") == F.col("name")))
    signed = s.groupBy("name", "parameter_count", "required_parameter_count").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("symbol_index", "id")).alias("f")).select("name", "parameter_count", "required_parameter_count", "n", "f.*")
    wide = free.join(signed, F.col("target_name") == F.col("name"))
    return tier(same, 0).unionByName(tier(through, 1)).unionByName(tier(near, 2)).unionByName(tier(wide, 3))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, imported_files: DataFrame) -> DataFrame:
    """(ref_index, target_symbol_id, resolution_tier, confidence_millis, reason): the best tier; parameter counts narrow where any fits; the first symbol, but of the whole repository only a single one."""
    return chosen(tiers.best_rows(refs, symbols, imports, imported_files))


def chosen(found: DataFrame, *more: Column) -> DataFrame:
    """(ref_index, rank, symbol_index, id, n) → what resolve says; rows that repeat a number are one reference. more: aggregates beside it."""
    several = [F.sum(F.when(F.col("rank") == k, F.col("n"))).alias(f"n{k}") for k in (6, 7)]
    first = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "symbol_index", "id"))).alias("b")
    grouped = found.groupBy("ref_index").agg(first, *several, *more)
    kept = grouped.columns[4:]
    best = grouped.filter("b is not null").select("ref_index", "b.*", "n6", "n7", *kept)
    tier = F.when(F.col("rank") < 2, "SameFile").when(F.col("rank") < 6, "ImportScoped").otherwise("Global")
    sole = (F.col("rank") < 6) | (F.coalesce("n6", "n7") == 1)
    out = best.filter(sole).select("ref_index", F.col("id").alias("target_symbol_id"), tier.alias("resolution_tier"), *kept)
    return out.withColumn("confidence_millis", F.create_map(*[v for t, c in M.TIER_CONFIDENCE.items() for v in (F.lit(t), F.lit(c))])[F.col("resolution_tier")])


def with_lexical(resolved: DataFrame, refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """What the scopes of a file bind goes before the tiers: bindings (ref_index, target_symbol_id); a null target is shadowed and resolves to nothing."""
    b = bindings.select("ref_index", F.col("target_symbol_id").alias("__t"), F.lit(True).alias("__b"))
    known = refs.select("ref_index").join(b, "ref_index").filter("__t is not null")
    lexical = known.select("ref_index", F.col("__t").alias("target_symbol_id"), F.lit("SameFile").alias("resolution_tier"), F.lit(950).alias("confidence_millis"))
    return resolved.join(b.select("ref_index"), "ref_index", "left_anti").unionByName(lexical.select(*resolved.columns))


def unresolved_sites(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """References no edge stands for; a missing enclosing symbol equals a missing one."""
    e = edges.select(F.col("source_file_path").alias("f"), F.col("kind").alias("k"), F.col("line").alias("l"), F.col("source_symbol_id").alias("s")).distinct()
    on = (F.col("file_path") == F.col("f")) & (F.col("kind") == F.col("k")) & (F.col("line") == F.col("l")) & F.col("enclosing_symbol_id").eqNullSafe(F.col("s"))
    return refs.join(e, on, "left_anti")


def suffix_match(files: DataFrame, targets: DataFrame, fold: bool = False) -> DataFrame:
    """(target, path): files whose path ends with the target at a segment. Suffixes are exploded, so it is an equi join."""
    parts = F.split("path", "/")
    suffixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    f = files.select("path", suffixes.alias("suffix"))
    key = (lambda c: F.lower(c)) if fold else (lambda c: c)
    return targets.select("target").distinct().join(f, key(F.col("target")) == key(F.col("suffix"))).select("target", "path")


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports (file_path, language, target) → (…, candidate, place): paths an import may mean, in the order they are tried."""
    directory = E.directory("file_path")
    relative = F.concat_ws("/", F.when(directory != "", directory), F.col("target"))
    stem = joined(F.when(F.col("target").startswith("."), relative).otherwise(F.col("target")))
    js = [F.concat(stem, F.lit(x)) for x in ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", "/index.ts", "/index.js")]
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    dotted = F.translate(F.regexp_replace("target", r"^\.+", ""), ".", "/")
    base = joined(F.concat(directory, F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0)))))
    py = F.when(dots > 0, F.concat_ws("/", F.when(base != "", base), F.when(dotted != "", dotted))).otherwise(dotted)
    pys = [F.concat(py, F.lit(x)) for x in (".py", "/__init__.py")]
    module = F.translate(F.regexp_replace("target", "^(crate|self)::", ""), "", "")
    rust = F.concat(F.lit("src/"), F.regexp_replace(module, "::", "/"))
    rusts = [F.concat(rust, F.lit(x)) for x in (".rs", "/mod.rs")] + [F.concat(F.regexp_replace(rust, "/[^/]*$", ""), F.lit(x)) for x in (".rs", "/mod.rs")]
    php = F.translate("target", "\\", "/")
    phps = [F.concat(php, F.lit(".php")), F.concat(F.lit("src/"), F.regexp_replace(php, "^[^/]*/", ""), F.lit(".php"))]
    rubies = [F.concat(joined(F.when(F.col("target").startswith("."), relative).otherwise(F.concat(F.lit(p), F.col("target")))), F.lit(".rb")) for p in ("", "lib/", "app/models/")]
    chosen = F.when(F.col("language").isin("JavaScript", "TypeScript"), F.array(*js)).when(F.col("language") == "Python", F.array(*pys)).when(F.col("language") == "Rust", F.array(*rusts)).when(F.col("language") == "Php", F.array(*phps)).otherwise(F.array(*rubies))
    return imports.select("*", F.posexplode(chosen).alias("place", "candidate"))


def joined(path):
    """A path with its . and .. segments worked out."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(acc, p):
        return F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports → (file_path, target, imported_path): the first candidate that is a file."""
    # As large as the repository, whatever it is estimated at: not through the driver.
    hit = import_candidates(imports).join(files.select(F.col("path").alias("candidate")).hint("merge"), "candidate")
    return hit.groupBy("file_path", "target").agg(F.min_by("candidate", "place").alias("imported_path"))


def ancestors(heritage: DataFrame) -> DataFrame:
    """heritage (child, parent, place) → (child, ancestor, depth, place): breadth first, each once at its nearest, as far up as there is anything new."""
    h = heritage.groupBy("child", "parent").agg(F.min("place").alias("place"))
    seen = front = cut(h.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("place").alias("place")))
    for depth in itertools.count(2):
        up = h.select(F.col("child").alias("ancestor"), "parent", F.col("place").alias("p2"))
        got = front.join(up, "ancestor").filter("child != parent").groupBy("child", F.col("parent").alias("ancestor")).agg(F.min(F.concat("place", F.array("p2"))).alias("place"))
        front = cut(got.join(seen, ["child", "ancestor"], "left_anti").select("child", "ancestor", F.lit(depth).alias("depth"), "place"))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    return seen


def linearised(heritage: DataFrame) -> DataFrame:
    """heritage (child, parent, place, root: the hierarchy's name) → (child, ancestor, depth): C3 order in each hierarchy; breadth first where it is inconsistent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents: dict[str, list[str]] = {}
        for c, p in pdf.sort_values("place")[["child", "parent"]].itertuples(index=False):
            parents.setdefault(c, []).append(p)

        def merge(lists: list[list[str]]) -> list[str] | None:
            out, lists = [], [x for x in lists if x]
            while lists:
                head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
                if head is None:
                    return None
                out.append(head)
                lists = [r for x in lists if (r := [v for v in x if v != head])]
            return out

        known: dict[str, list[str] | None] = {}

        def order(c: str, above: tuple = ()) -> list[str] | None:
            if c in above:
                return None
            if c not in known:
                own = parents.get(c, [])
                parts = [order(p, (*above, c)) for p in own]
                tail = None if None in parts else merge([[p, *x] for p, x in zip(own, parts)] + [own])
                known[c] = tail
            return known[c]

        rows = []
        for c in parents:
            found = order(c)
            if found is None:
                found, todo = [], list(parents[c])
                while todo:
                    x = todo.pop(0)
                    if x not in found and x != c:
                        found.append(x)
                        todo += parents.get(x, [])
            rows += [(c, a, i + 1) for i, a in enumerate(found)]
        return pd.DataFrame(rows, columns=["child", "ancestor", "depth"])

    return heritage.groupBy("root").applyInPandas(run, "child string, ancestor string, depth int")


def override_edges(symbols: DataFrame, lineage: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Methods that override one of the same name of the nearest ancestor. lineage: child, ancestor (class ids), depth.

    Of the methods of a name in a class, and of those that a class finds above it, the two first are kept, the second for a method that is the first itself;
    so methods meet their class's choice, not each other.
    """
    m = symbols.filter("kind = 'Method' and parent_symbol_id is not null").select("id", "name", "symbol_index", F.col("parent_symbol_id").alias("owner"), "file_path", "start_line")
    method = F.struct(F.col("symbol_index").alias("ti"), F.col("id").alias("target_symbol_id"), F.col("file_path").alias("target_file_path"))
    up = _two_least(m.select(F.col("owner").alias("ancestor"), "name", F.col("id").alias("key"), method.alias("x")), ["ancestor", "name"])
    above = m.select(F.col("owner").alias("child"), "name").distinct().join(lineage.select("child", "ancestor", "depth"), "child").join(up, ["ancestor", "name"])
    above = _two_least(above.select(F.col("child").alias("owner"), "name", F.col("x.target_symbol_id").alias("key"), F.struct("depth", "x.*").alias("x")), ["owner", "name"])
    two = above.groupBy("owner", "name").agg(F.array_sort(F.collect_list("x")).alias("two"))
    hit = m.join(two, ["owner", "name"]).withColumn("b", F.get(F.filter("two", lambda x: x["target_symbol_id"] != F.col("id")), F.lit(0))).filter("b is not null")
    best = hit.groupBy(F.col("id").alias("source_symbol_id"), F.col("file_path").alias("source_file_path"), F.col("start_line").alias("line")).agg(F.min("b").alias("b"))
    out = best.select("source_symbol_id", "source_file_path", "line", "b.target_symbol_id", "b.target_file_path", F.lit("Overrides").alias("kind"), F.lit(950).alias("confidence_millis"))
    if existing is not None:
        out = out.join(existing.filter("kind = 'Overrides'").select("source_symbol_id", "target_symbol_id"), ["source_symbol_id", "target_symbol_id"], "left_anti")
    return out


def _two_least(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by, key, x) → for each `by` the least x of the two keys whose least are smallest."""
    each = rows.groupBy(*by, "key").agg(F.min("x").alias("x"))
    return each.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("x"))).filter("n <= 2").select(*by, "x")
