"""Types of receivers, to a fixpoint: which method a member call means, through variables, factories, chains, awaits and aliases.

A call's receiver is a path: a name, and the members that are called on it. First the name is replaced by what the variable of the innermost scope was
set to last, until it is no variable; what was set lies before its use, so this ends. Then paths of the same file are one
state (file, name, rest), however many calls have them. A round looks up only the names and states that the round before has made: a class with nothing left is a
result, with members left it leads to the method's return type, seen from the method's file; a function leads to its own.
States that were met before aren't followed again, so cycles end, and no number of rounds is set.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import declared, shapes
from codeloom.functions import expr as E
from codeloom.functions import masks
from codeloom.operators import resolution
from codeloom.operators.graph import cut, dealt

#: Words of types that name no class of a repository, and wrappers of which the content counts.
PRIMITIVES = "null undefined none void never mixed any unknown string number boolean bool int integer float double str array object callable iterable resource true false parent".split()
WRAPPERS = "Promise Option Optional Result Array Vec List Dict Map Set Tuple Iterable Iterator Sequence Mapping Union Literal Awaitable".split()
#: Return types that stand for the method's own class.
OWN_TYPES = ["self", "static", "this", "$this", "Self"]
LANGUAGES = ["JavaScript", "TypeScript", "Python", "Php", "Rust"]


def _spread(x: DataFrame) -> DataFrame:
    """For joins: facts made in Python are taken for as small as the table that their sources come from, and would go through the driver to all tasks."""
    return x.hint("merge")


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, r"\\|::|\."), -1)


def type_names(text: Column) -> Column:
    """The names in a type that may be classes: wrappers and primitives left out."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z_\\][A-Za-z0-9_:\\.]*)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\\+", ""))
    return F.array_distinct(F.filter(found, lambda x: (x != "") & ~leaf(x).isin(WRAPPERS) & ~F.lower(leaf(x)).isin(PRIMITIVES)))


def facts(sources: DataFrame) -> DataFrame:
    """sources (file_path, text) → file_path, language and the columns of declared.FIELDS, each fact of a file once.

    Sources come dealt out by file, so that a task knows by itself which facts it has given, and keeps those of one file only.
    """

    def run(batches):
        names = [f.split()[0] for f in declared.FIELDS.split(", ")]
        at, given = None, set()
        for pdf in batches:
            rows = []
            for p, t, x in zip(pdf.file_path, pdf.text, pdf.language):
                if p != at:
                    at, given = p, set()
                for r in declared.facts(shapes.Tokens(masks.vue_script(t) if p.endswith(".vue") else t, x)):
                    if (fact := repr(r)) not in given:
                        given.add(fact)
                        rows.append((p, x, *r))
            yield pd.DataFrame(rows, columns=["file_path", "language", *names])

    x = sources.select("file_path", "text", E.language("file_path").alias("language")).filter(F.col("language").isin(LANGUAGES) & F.col("text").isNotNull())
    return dealt(x, x.count()).mapInPandas(run, f"file_path string, language string, {declared.FIELDS}")


def substituted(found: DataFrame) -> DataFrame:
    """Calls → (site, file_path, name, rest): their receivers without variables.

    One window finds, for each call and each setting, the last setting before it of the name that it begins with, in the innermost scope that has one. Settings
    then point at settings, and pointers are doubled: each round a setting takes over what the one that it points at has.
    """
    key = F.xxhash64("file_path", "start", "name")
    rest = F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0)))
    all_ = found.filter("tag in ('call', 'bind')").select(key.alias("id"), (F.col("tag") == "bind").alias("sets"), "file_path", "name", F.col("steps")[0].alias("first"), rest.alias("rest"), "detail", "scopes", "start")
    uses = all_.filter("first is not null").select("id", "file_path", F.col("first").alias("name"), F.posexplode("scopes").alias("far", "scope"), "start", F.lit(None).cast("long").alias("set"), F.lit(None).cast("int").alias("at"))
    sets = all_.filter("sets").select(F.lit(None).cast("long").alias("id"), "file_path", "name", F.lit(None).cast("int").alias("far"), F.col("scopes")[0].alias("scope"), "start", F.col("id").alias("set"), F.col("start").alias("at"))
    before = Window.partitionBy("file_path", "name", "scope").orderBy("start", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = uses.unionByName(sets).withColumn("last", F.last(F.when(F.col("set").isNotNull(), F.struct("set", "at")), ignorenulls=True).over(before)).filter("id is not null and last.at < start")
    pointed = cut(all_.join(_spread(last.groupBy("id").agg(F.min_by("last.set", "far").alias("next"))), "id", "left").select("id", "sets", "file_path", F.col("first").alias("name"), "rest", "detail", "next"))
    known = pointed.filter("sets").select("id", "name", "rest", "detail", "next")
    while not known.filter("next is not null").isEmpty():
        known = cut(_followed(known, known))
    out = _followed(pointed.filter("not sets"), known)
    names = F.when(F.col("detail").isNotNull(), type_names(F.col("detail"))).otherwise(F.array("name"))
    return out.select(F.col("id").alias("site"), "file_path", F.explode(names).alias("name"), "rest")


def _followed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with what they point at in the place of themselves."""
    n = known.select(F.col("id").alias("next"), F.struct("name", "rest", "detail", "next").alias("n"))
    kept = [c for c in rows.columns if c not in ("name", "rest", "detail", "next")]
    met, there = rows.join(_spread(n), "next", "left"), F.col("n").isNotNull()
    # A typed variable has no steps of its own.
    more = F.concat(F.coalesce("n.rest", F.array().cast("array<string>")), F.coalesce("rest", F.array().cast("array<string>")))
    return met.select(*kept, F.when(there, F.col("n.name")).otherwise(F.col("name")).alias("name"), more.alias("rest"), F.when(there, F.col("n.detail")).otherwise(F.col("detail")).alias("detail"), F.col("n.next").alias("next"))


def symbols_of(found: DataFrame) -> DataFrame:
    """Classes and functions: sid, kind, file_path, language, name, owner, detail (qualified name of a class, return type of a function), leads (names in that type), line."""
    return found.filter("tag in ('class', 'fn')").select(F.xxhash64("file_path", "start").alias("sid"), F.col("tag").alias("kind"), "file_path", "language", "name", "owner", "detail", F.when(F.col("tag") == "fn", type_names(F.col("detail"))).alias("leads"), "line")


def imports_of(found: DataFrame, files: DataFrame) -> DataFrame:
    """Named imports: file_path, binding, exported, module, imported_path."""
    i = found.filter("tag = 'import'").select("file_path", "language", F.col("name").alias("binding"), F.col("owner").alias("exported"), F.col("detail").alias("target"))
    reached = resolution.import_targets(i.select("file_path", "language", "target").distinct(), files)
    return i.join(_spread(reached), ["file_path", "target"], "left").withColumnRenamed("target", "module")


def visible(symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What names mean: in a file (file_path, short, sid, ...), its own symbols before what it imports by name, before what imported files have; a null sid is an import
    that leads nowhere, and ends the search. And anywhere (key, lang, sid, ...): the only symbol of a name in a language, and classes by their qualified names."""
    s = symbols.filter("owner is null")
    what = F.struct("sid", "kind", F.col("file_path").alias("sf"), F.col("name").alias("sn"), "leads").alias("s")
    top = s.select(F.col("file_path").alias("sf"), F.col("name").alias("sn"), what)
    same = s.select("file_path", F.col("name").alias("short"), F.lit(0).alias("rank"), what)
    wanted = F.when(F.col("exported") == "default", F.col("binding")).otherwise(F.col("exported"))
    i = imports.select("file_path", F.col("binding").alias("short"), wanted.alias("sn"), F.col("imported_path").alias("sf"), "module")
    named = i.join(_spread(top), ["sf", "sn"]).select("file_path", "short", F.lit(1).alias("rank"), "s")
    classes = s.filter("kind = 'class' and detail like '%\\\\\\\\%'").select(F.col("detail").alias("module"), what)
    spaced = i.join(_spread(classes), "module").select("file_path", "short", F.lit(1).alias("rank"), "s")
    nowhere = i.select("file_path", "short", F.lit(2).alias("rank"), F.lit(None).cast(top.schema["s"].dataType).alias("s"))
    near = i.filter("sf is not null").select("file_path", "sf").distinct().join(_spread(top), "sf").select("file_path", F.col("sn").alias("short"), F.lit(3).alias("rank"), "s")
    every = same.unionByName(named).unionByName(spaced).unionByName(nowhere).unionByName(near).distinct()
    best = Window.partitionBy("file_path", "short")
    here = every.withColumn("least", F.min("rank").over(best)).filter("rank = least").select("file_path", "short", F.lit(True).alias("here"), "s")
    # A repository's only symbol of a name: counted first, so a common name makes one row.
    sole = s.groupBy(F.col("name").alias("key"), F.col("language").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(what).alias("s")).filter("n = 1").select("key", "lang", "s")
    return cut(here), cut(sole.unionByName(classes.select(F.col("module").alias("key"), F.lit("Php").alias("lang"), "s")))


def members_of(symbols: DataFrame, lineage: DataFrame | None) -> DataFrame:
    """(sid of a class, member, mf, mo, leads, own, line): its methods, or those of the nearest ancestor."""
    m = symbols.filter("kind = 'fn' and owner is not null").select(F.col("file_path").alias("mf"), F.col("owner").alias("mo"), F.col("name").alias("member"), "leads", F.coalesce(F.col("detail").isin(OWN_TYPES), F.lit(False)).alias("own"), "line")
    every = _with_ancestors(symbols, lineage).join(_spread(m), ["mf", "mo"])
    least = Window.partitionBy("sid", "member").orderBy("depth", "mf", "line")
    return cut(every.withColumn("n", F.row_number().over(least)).filter("n = 1").drop("n", "depth"))


def closed(states: DataFrame, here: DataFrame, anywhere: DataFrame, members: DataFrame) -> DataFrame:
    """states (root, file_path, name, rest) → (root, sid): the classes that they come to."""
    seen = front = cut(states.distinct())
    key, results = ["root", "file_path", "name", "rest"], []
    while True:
        asked = front.withColumns({"short": leaf(F.col("name")), "key": F.when(F.col("name").contains("\\"), F.col("name")).otherwise(leaf(F.col("name"))), "lang": E.language("file_path")})
        met = asked.join(_spread(here), ["file_path", "short"], "left").join(_spread(anywhere.withColumnRenamed("s", "a")), ["key", "lang"], "left")
        met = cut(met.select("root", "rest", F.when(F.col("here"), F.col("s")).otherwise(F.col("a")).alias("s")).filter("s is not null").select("root", "rest", "s.*"))
        results.append(met.filter("kind = 'class' and size(rest) = 0").select("root", "sid"))
        left = met.filter("kind = 'class' and size(rest) > 0").select("root", "sid", "sf", "sn", F.col("rest")[0].alias("member"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
        stepped = left.join(_spread(members), ["sid", "member"])
        place = F.when(F.col("own"), F.struct(F.col("sf").alias("file_path"), F.array("sn").alias("names"))).otherwise(F.struct(F.col("mf").alias("file_path"), F.col("leads").alias("names")))
        after = stepped.select("root", place.alias("p"), "rest").unionByName(met.filter("kind = 'fn'").select("root", F.struct(F.col("sf").alias("file_path"), F.col("leads").alias("names")).alias("p"), "rest"))
        front = cut(after.select("root", "p.file_path", F.explode("p.names").alias("name"), "rest").distinct().join(_spread(seen), key, "left_anti").select(*key))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out.distinct()


def _with_ancestors(symbols: DataFrame, lineage: DataFrame | None) -> DataFrame:
    """(sid of a class, mf, mo, depth): where its methods stand, its own at depth 0. lineage: child, ancestor (sids), depth."""
    c = symbols.filter("kind = 'class'").select("sid", F.col("file_path").alias("mf"), F.col("name").alias("mo"))
    own = c.withColumn("depth", F.lit(0))
    if lineage is None:
        return own
    return own.unionByName(lineage.select(F.col("child").alias("sid"), F.col("ancestor"), "depth").join(_spread(c.withColumnRenamed("sid", "ancestor")), "ancestor").select("sid", "mf", "mo", "depth"))


def member_calls(sources: DataFrame, files: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """sources (file_path, text), files (path) → file_path, line, member, start, target_file_path, target_owner, target_line: member calls whose receiver's class is found, the method of several classes that comes first by file and line."""
    found = cut(facts(sources))
    symbols = symbols_of(found)
    here, anywhere = visible(symbols, imports_of(found, files))
    members = members_of(symbols, lineage)
    sites = cut(substituted(found).withColumn("root", F.xxhash64("file_path", "name", "rest")))
    types = closed(sites.select("root", "file_path", "name", "rest").distinct(), here, anywhere, members)
    calls = found.filter("tag = 'call'").select(F.xxhash64("file_path", "start", "name").alias("site"), "file_path", "line", F.col("name").alias("member"), "start")
    hit = calls.join(_spread(sites.select("site", "root").distinct()), "site").join(_spread(types), "root").join(_spread(members.withColumnRenamed("line", "target_line")), ["sid", "member"])
    best = hit.groupBy("site", "file_path", "line", "member", "start").agg(F.min(F.struct("mf", "target_line", "mo")).alias("b"))
    return best.select("file_path", "line", "member", "start", F.col("b.mf").alias("target_file_path"), F.col("b.mo").alias("target_owner"), F.col("b.target_line").alias("target_line"))


def class_lineage(sources: DataFrame, heritage: DataFrame) -> DataFrame:
    """heritage (file_path, child, parent: names) → (child, ancestor, depth) of sids, by names as their files know them."""
    found = cut(facts(sources))
    symbols = symbols_of(found)
    here, anywhere = visible(symbols, imports_of(found, sources.select(F.col("file_path").alias("path")).distinct()))
    asked = heritage.select("file_path", "parent").distinct().withColumns({"short": leaf(F.col("parent")), "key": F.when(F.col("parent").contains("\\"), F.col("parent")).otherwise(leaf(F.col("parent"))), "lang": E.language("file_path")})
    met = asked.join(_spread(here), ["file_path", "short"], "left").join(_spread(anywhere.withColumnRenamed("s", "a")), ["key", "lang"], "left").withColumn("s", F.when(F.col("here"), F.col("s")).otherwise(F.col("a")))
    parents = met.filter("s.kind = 'class'").select("file_path", "parent", F.col("s.sid").alias("ancestor"))
    children = symbols.filter("kind = 'class'").select("file_path", F.col("name").alias("child"), F.col("sid"))
    edges = heritage.join(_spread(parents), ["file_path", "parent"]).join(_spread(children), ["file_path", "child"]).select(F.col("sid").alias("child"), F.col("ancestor").alias("parent"), F.lit(0).alias("place"))
    return resolution.ancestors(edges).select("child", "ancestor", "depth")
