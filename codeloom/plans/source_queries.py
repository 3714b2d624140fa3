"""Queries over whole sources: structural rules, receiver types, resolution of changed files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.operators import bindings, deadcode, graph, incremental, receivers, rules, scanners
from codeloom.operators import text as tx
from codeloom.plans import bindings as b
from codeloom.plans import text_queries as tq
from codeloom.plans.bindings import duck, frame

Q, O = {}, {}


def add(name: str, oracle: str | None = None):
    def put(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return put


#: A source for each order: its path, its text (¦ stands for a line break, « and » for braces) and what is found in it: rule, line, token, provenance, items.
KEY = "' || CAST(o_orderkey AS STRING) || '"
FILES = [
    (f"src/o{KEY}.php", f"<?php¦foreach ($ids as $id) «¦  $x = in_array($id,¦    $all{KEY});¦»", [("complexity/php/collection_scan_in_loop", 3, f"in_array($id, $all{KEY})", "", None)]),
    (f"src/app/o{KEY}.php", f"<?php¦for ($i = 0; $i < 9; $i++) «¦  DB::select(\"x{KEY}\", [$i]);¦»¦env(\"K\");¦$app->make(\"a\", 2);¦app(X::class)->run();", [("complexity/php/framework/laravel_db_query_in_loop", 3, f'DB::select("x{KEY}", [$i])', ".laravel", None), ("framework_misuse/php/raw_env_outside_config", 5, 'env("K")', ".laravel", None), ("framework_misuse/php/raw_container_lookup_outside_boundary", 7, "app(X::class)", ".laravel", None)]),
    (f"src/o{KEY}.js", f"for (const g of gs) «¦  g.items{KEY}¦    .sort();¦»¦el.innerHTML = g;¦el.innerHTML += g;", [("complexity/javascript/sort_in_loop", 2, f"g.items{KEY} .sort()", "", None), ("security/javascript/html_output", 5, "el.innerHTML = g", "", None)]),
    (f"src/o{KEY}.ts", f"while (x) y.sort();¦new RegExp(p);¦for (var k in ks) « a.sort(); »¦f(process.env.KEY_{KEY});", [("framework_misuse/javascript/raw_env_outside_config", 4, f"process.env.KEY_{KEY}", "", None)]),
    (f"src/o{KEY}.rs", f"impl From<A> for B « fn f() « v.sort(); » »¦for k in ks.iter() «¦  let r = Regex::new(k{KEY});¦  v.sort_by(|a, b| a.cmp(b));¦  v.sort_by_key(k);¦»", [("complexity/rust/regex_compile_in_loop", 3, f"Regex::new(k{KEY})", "", None), ("complexity/rust/sort_in_loop", 4, "v.sort_by(|a, b| a.cmp(b))", "", None)]),
    (f"config/o{KEY}.rs", "fn f() « env::var(\"A\"); »", []),
    (f"src/o{KEY}.py", f"for a in b:¦    if a:¦        x = json.loads(a{KEY})¦¦    c = 1¦y = json.loads(b)¦os.system(¦    y)", [("complexity/python/json_decode_in_loop", 3, f"json.loads(a{KEY})", "", None), ("security/python/command_exec", 7, "os.system( y)", "", None)]),
    (f"web/o{KEY}.py", f"from django.core.cache import cache¦while q:¦    r = cache.get(q{KEY})¦os.getenv(r)", [("complexity/python/framework/django_cache_lookup_in_loop", 3, f"cache.get(q{KEY})", ".django", None), ("framework_misuse/python/raw_env_outside_config", 4, "os.getenv(r)", ".django", None)]),
    (f"lib/o{KEY}.rb", f"system(\"ls {KEY}\")¦x.system(\"a\")¦system \"b\"¦ENV[\"K\"]", [("security/ruby/command_exec", 1, f'system("ls {KEY}")', "", None), ("framework_misuse/ruby/raw_env_outside_config", 4, 'ENV["K"]', "", None)]),
    (f"src/n{KEY}.php", f"<?php¦// exec($a)¦$s = \"exec({KEY})\";¦function exec($a) «»¦$o->exec($a);¦new exec($a);", []),
    (f"src/i{KEY}.js", f"for (let i = 0; i < 3; i++) « [\"a\", \"b\"].includes(x{KEY}); »", [("complexity/javascript/collection_scan_in_loop", 1, f'["a", "b"].includes(x{KEY})', "", 2)]),
    (f"doc/o{KEY}.md", "for a in b:¦    sorted(a)", []),
]
_CASE = lambda k: f"CASE o_orderkey % {len(FILES)} " + " ".join(f"WHEN {n} THEN '{x[k]}'" for n, x in enumerate(FILES)) + " END"
SOURCES = f"SELECT {_CASE(0)} AS file_path, replace(replace(replace({_CASE(1)}, '¦', chr(10)), '«', chr(123)), '»', chr(125)) AS text FROM {{orders}}"
FOUND = " UNION ALL ".join(
    f"SELECT '{path}' AS file_path, '{rule}' AS rule_id, {line} AS line, '{token}' AS token, 'ast_grep.pattern{by}' AS provenance, {'NULL' if items is None else items} AS max_items FROM orders WHERE o_orderkey % {len(FILES)} = {n}"
    for n, (path, _, found) in enumerate(FILES)
    for rule, line, token, by, items in found
)


@add("structural_findings", duck(FOUND))
def _(s, d):
    return rules.structural_findings(frame(s, d, SOURCES)).select("file_path", "rule_id", "line", "token", "provenance", "max_items")


@add("structural_families", f"WITH f AS ({duck(FOUND)}) SELECT CASE split_part(rule_id, '/', 1) WHEN 'complexity' THEN 'algorithmic_complexity' WHEN 'security' THEN 'security_dangerous_api' ELSE 'framework_misuse' END AS family, count(*) AS findings, count(DISTINCT file_path) AS files FROM f GROUP BY 1")
def _(s, d):
    return rules.findings_by_family(rules.structural_findings(frame(s, d, SOURCES)))


#: For each customer a class whose method leads to the next one's, in a file of its own, and a caller that goes on from class to class over variables and chains.
CHAIN = """SELECT 'm/c' || CAST(c_custkey AS STRING) || '.ts' AS file_path, 'import « C' || CAST(c_custkey + 1 AS STRING) || ' » from "./c' || CAST(c_custkey + 1 AS STRING) || '";¦export class C' || CAST(c_custkey AS STRING) || ' «¦  next(): Promise<C' || CAST(c_custkey + 1 AS STRING) || '> « return x; »¦  save() «»¦»' AS text FROM {customer}
 UNION ALL SELECT 's/c' || CAST(c_custkey AS STRING) || '.ts', 'import « C' || CAST(c_custkey AS STRING) || ' as K » from "../m/c' || CAST(c_custkey AS STRING) || '";¦async function run() «¦  const a = new K();¦  const b = (await a.next()).next();¦  const d = b;¦  const e = d;¦  const f = e;¦  f.next()¦    .next().save();¦  other.save();¦»' FROM {customer}"""


@add("receiver_calls", "SELECT 's/c' || c.c_custkey || '.ts' AS file_path, line, member, 'm/c' || t.c_custkey || '.ts' AS target_file_path, 'C' || t.c_custkey AS target_owner FROM customer c, (VALUES (4, 'next', 0), (4, 'next', 1), (8, 'next', 2), (9, 'next', 3), (9, 'save', 4)) v(line, member, k) JOIN customer t ON t.c_custkey = c.c_custkey + k")
def _(s, d):
    x = frame(s, d, CHAIN).withColumn("text", F.translate("text", "¦«»", "\n{}"))
    return receivers.member_calls(x, x.select(F.col("file_path").alias("path"))).select("file_path", "line", "member", "target_file_path", "target_owner")


@add("incremental_resolution", f"WITH q AS ({tq.O['tiered_resolution']}) SELECT DISTINCT ref_index, target_symbol_id, resolution_tier, CAST(regexp_extract(file_path, 's([0-9]+)[.]py$', 1) AS INT) % 7 <> 0 AS reused FROM q JOIN ({duck(b.REFS)}) USING (ref_index)")
def _(s, d):
    """Two snapshots: in the second the references of every seventh file have other targets."""
    from codeloom.operators.edges import admitted_refs

    now = admitted_refs(frame(s, d, b.REFS))
    changed = F.regexp_extract("file_path", r"s([0-9]+)\.py$", 1).cast("int") % 7 == 0
    before = now.withColumn("target_name", F.when(changed, F.concat("target_name", F.lit("_old"))).otherwise(F.col("target_name")))
    others = frame(s, d, b.TARGETS), frame(s, d, tq.IMPORTS), frame(s, d, tq.IMPORTED)
    graph.cut(s.range(1))  # sees to the shared folder
    root = f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/resolution-{uuid.uuid4().hex}"
    incremental.resolve_incrementally(before, *others, root)
    return incremental.resolve_incrementally(now, *others, root)[0].select("ref_index", "target_symbol_id", "resolution_tier", "reused")


_RANK = "CASE relation_kind WHEN 'Call' THEN 5 WHEN 'Dispatch' THEN 4 WHEN 'ContainerResolution' THEN 3 WHEN 'EventPublish' THEN 2 WHEN 'Import' THEN 1 ELSE 0 END"
_STEPS = f"""c AS MATERIALIZED (FROM ({duck(b.CYCLES)}) WHERE source_file_path <> target_file_path),
sq AS (SELECT source_file_path AS src, target_file_path AS dst, relation_kind AS rel, confidence_millis AS c, (-{_RANK}) * 1000000 - confidence_millis * 100 + CASE layer WHEN 'Structural' THEN 0 ELSE 1 END AS e FROM c QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY e, rel) = 1),
st AS MATERIALIZED (FROM sq QUALIFY row_number() OVER (PARTITION BY src ORDER BY e, rel, dst) <= 12),
zl AS (SELECT split_part(source_file_path, '/', 1) AS a, split_part(target_file_path, '/', 1) AS z, count(*) AS n FROM c WHERE a <> z GROUP BY ALL ORDER BY n DESC, a, z LIMIT 40),
zf AS (SELECT split_part(path, '/', 1) AS zone, arg_min(path, (-n, path)) AS path FROM (SELECT path, count(*) AS n FROM (SELECT source_file_path AS path FROM c UNION ALL SELECT target_file_path FROM c) GROUP BY path) GROUP BY zone),
l0 AS (SELECT a, z, r.rev, CASE WHEN r.rev THEN y.path ELSE x.path END AS here, CASE WHEN r.rev THEN x.path ELSE y.path END AS target, [here] AS path, []::VARCHAR[] AS rels, 1000 AS conf FROM zl JOIN zf x ON x.zone = a JOIN zf y ON y.zone = z, (VALUES (false), (true)) r(rev))"""
_LEVELS = ", ".join(
    f"l{k} AS MATERIALIZED (SELECT a, z, rev, dst AS here, target, list_append(path, dst) AS path, list_append(rels, rel) AS rels, least(conf, c) AS conf FROM l{k - 1} l JOIN st ON src = here WHERE here <> target AND NOT list_contains(path, dst)"
    + (f" AND NOT EXISTS (SELECT 1 FROM f{k - 1} f WHERE f.a = l.a AND f.z = l.z AND f.rev = l.rev GROUP BY f.a HAVING count(*) >= 2)" if k > 1 else "")
    + f" QUALIFY row_number() OVER (PARTITION BY a, z, rev, dst ORDER BY least(conf, c) DESC, list_append(path, dst)) <= 2), f{k} AS MATERIALIZED (FROM l{k} WHERE here = target" + (f" UNION ALL FROM f{k - 1}" if k > 1 else "") + ")"
    for k in range(1, 5)
)


@add("zone_support_paths", f"WITH {_STEPS}, {_LEVELS}, g AS (SELECT *, row_number() OVER (PARTITION BY a, z, rev ORDER BY len(rels), conf DESC, path) AS rank FROM f4) SELECT a AS source_zone, z AS target_zone, rev AS reversed, rank::INT AS rank, array_to_string(path, ' > ') AS path, array_to_string(rels, ',') AS relations, conf AS confidence_millis FROM g WHERE rank <= 2 AND (NOT rev OR NOT EXISTS (SELECT 1 FROM g h WHERE h.a = g.a AND h.z = g.z AND NOT h.rev))")
def _(s, d):
    found = graph.zone_support_paths(frame(s, d, b.CYCLES))
    return found.withColumns({"path": F.array_join("path", " > "), "relations": F.array_join("relations", ",")})


#: For each customer a file with an input (every third), one between, and one with a dangerous call, every seventh of which has an input of its own.
FLOW_LINES = """SELECT 'in/c' || CAST(c_custkey AS STRING) || '.py' AS file_path, 3 AS line, CASE WHEN c_custkey % 3 = 0 THEN 'x = request.GET' ELSE 'x = 1' END AS content FROM {customer}
 UNION ALL SELECT 'sink/c' || CAST(c_custkey AS STRING) || '.py', 9, 'os.system(x)' FROM {customer} UNION ALL SELECT 'sink/c' || CAST(c_custkey AS STRING) || '.py', 4, CASE WHEN c_custkey % 7 = 0 THEN 'y = request.GET' ELSE 'y = 2' END FROM {customer}"""
_LINK = "SELECT '{}/c' || CAST(c_custkey AS STRING) || '.py' AS source_file_path, 'a' AS source_symbol_id, '{}/c' || CAST(c_custkey AS STRING) || '.py' AS target_file_path, 'b' AS target_symbol_id, {} AS relation_kind, CAST(NULL AS STRING) AS reference_target_name, 0 AS occurrence_index FROM {{customer}} WHERE {}"
FLOW_EDGES = " UNION ALL ".join(_LINK.format(*x) for x in (("in", "mid", "'Call'", "TRUE"), ("mid", "sink", "CASE WHEN c_custkey % 2 = 0 THEN 'Import' ELSE 'Dispatch' END", "TRUE"), ("in", "sink", "'Call'", "c_custkey % 5 = 0")))
_WAY = "CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 7 = 0 THEN '' ELSE 'in/c' || c_custkey || '.py > mid/c' || c_custkey || '.py > sink/c' || c_custkey || '.py' END"


@add("cross_file_flows", f"""SELECT 'sink/c' || c_custkey || '.py' AS file_path, 9 AS line, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN c_custkey % 7 = 0 THEN 'BoundaryInputInSameFile' WHEN c_custkey % 3 = 0 THEN 'BoundaryInputReachableViaGraph' ELSE '' END AS contexts,
 CASE WHEN c_custkey % 7 = 0 THEN '4:RequestQuery' WHEN c_custkey % 3 = 0 THEN '3:RequestQuery' ELSE '' END AS inputs, {_WAY} AS input_path FROM customer""")
def _(s, d):
    lines = frame(s, d, FLOW_LINES)
    inputs = tx.boundary_inputs(lines)
    ways = scanners.causal_ways(frame(s, d, FLOW_EDGES), inputs.select(F.col("file_path").alias("path")))
    nobody = s.createDataFrame([], "path string")
    out = tx.cross_file_flows(tx.dangerous_calls(lines), nobody, inputs, ways)
    return out.select("file_path", "line", "severity", F.array_join("contexts", ",").alias("contexts"), F.array_join("inputs", ",").alias("inputs"), F.array_join("input_path", " > ").alias("input_path"))


#: Backend files: a source for each order, whose class other sources may name, build, quote or share the shape of.
_PATH = f"""CASE o_orderkey % 10 WHEN 0 THEN 'app/m' || CAST(o_custkey % 20 AS STRING) || '/Order{KEY}.php' WHEN 1 THEN 'app/h' || CAST(o_custkey % 90 AS STRING) || '/U{KEY}.hooks' || CAST(o_orderkey % 400 AS STRING) || '.php'
 WHEN 2 THEN 'app/Mod{KEY}/Mod{KEY}Kind' || CAST(o_custkey % 80 AS STRING) || '.php' WHEN 3 THEN 'app/database/M{KEY}.php' WHEN 4 THEN 'app/s/Svc{KEY}.php' WHEN 5 THEN 'lib/legacy{KEY}.php' WHEN 6 THEN 'lib/Fn{KEY}.php'
 WHEN 7 THEN 'lib/Ab{KEY}.php' WHEN 8 THEN 'tests/T{KEY}.php' ELSE 'app/run/run{KEY}.php' END"""
_CLASS = f"""CASE o_orderkey % 10 WHEN 0 THEN 'Order{KEY}' WHEN 1 THEN 'Hook{KEY}' WHEN 2 THEN 'Shape{KEY}' WHEN 3 THEN 'Moved{KEY}' WHEN 4 THEN 'Svc{KEY}Cust' || CAST(o_custkey AS STRING) WHEN 5 THEN 'Legacy{KEY}' WHEN 7 THEN 'Abc' WHEN 8 THEN 'Tested{KEY}' ELSE 'Run{KEY}' END"""
BACKEND = f"""SELECT {_PATH} AS file_path, CASE o_orderkey % 10 WHEN 6 THEN 'function f() «»' ELSE 'class ' || {_CLASS} || ' «»' END || CASE o_orderkey % 10
 WHEN 8 THEN ' Order' || CAST(o_orderkey - 8 AS STRING) || '::go();' WHEN 9 THEN ' Order' || CAST(o_orderkey - 9 - 10 * (o_custkey % 3) AS STRING) || '::go(); require "x/Legacy' || CAST(o_orderkey - 4 - 10 * (o_custkey % 5) AS STRING) || '.php"; return app("A" . $t . "Cust' || CAST(o_custkey AS STRING) || '");' ELSE '' END AS text FROM {{orders}}"""
BACKEND_SYMBOLS = f"SELECT {_PATH} AS file_path, CASE o_orderkey % 10 WHEN 6 THEN 'Function' ELSE 'Class' END AS kind, {_CLASS} AS name, CAST(NULL AS STRING) AS parent_symbol_id FROM {{orders}}"
BACKEND_EDGES = f"SELECT CASE o_orderkey % 3 WHEN 0 THEN {_PATH} WHEN 1 THEN 'tests/x.php' ELSE 'app/main.php' END AS source_file_path, {_PATH} AS target_file_path FROM {{orders}} WHERE o_orderkey % 7 = 0"
BACKEND_WIRED = f"SELECT {_PATH} AS file_path FROM {{orders}} WHERE o_custkey % 11 = 0"


@add("orphan_backend_modules", f"""WITH o AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 10 AS r, o_orderkey % 7 = 0 AND o_orderkey % 3 = 2 OR o_custkey % 11 = 0 AS led, {duck(_PATH)} AS path FROM orders),
run AS (SELECT k - 9 - 10 * (c % 3) AS named, k - 4 - 10 * (c % 5) AS quoted, c FROM o WHERE r = 9), hooks AS (SELECT k % 400 AS h FROM o WHERE r = 1 GROUP BY h HAVING count(DISTINCT c % 90) >= 2), kinds AS (SELECT c % 80 AS kind FROM o WHERE r = 2 GROUP BY kind HAVING count(*) >= 3)
SELECT 'OrphanModule' AS category, path, regexp_extract(path, '([^/.]*)[.][^/]*$', 1) AS name, 1 AS line, 'Heuristic' AS tier FROM o WHERE NOT led AND CASE r WHEN 0 THEN k NOT IN (SELECT named FROM run) WHEN 1 THEN k % 400 NOT IN (FROM hooks) WHEN 2 THEN c % 80 NOT IN (FROM kinds)
 WHEN 4 THEN c NOT IN (SELECT c FROM run) WHEN 5 THEN k NOT IN (SELECT quoted FROM run) WHEN 9 THEN TRUE ELSE FALSE END""")
def _(s, d):
    x = frame(s, d, BACKEND).withColumn("text", F.translate("text", "«»", "{}"))
    return deadcode.orphan_backend_modules(x, frame(s, d, BACKEND_SYMBOLS), frame(s, d, BACKEND_EDGES), frame(s, d, BACKEND_WIRED))


#: For each order a script of nested blocks, one for each line item, which binds one of three names to a function or a value and calls all of them; some write the first.
NESTED = "SELECT l_orderkey AS k, l_partkey % 3 AS f, l_returnflag = 'R' AS unknown, l_quantity > 45 AS writes, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS INT) AS n FROM {lineitem}"
BLOCKS = f"""SELECT CASE WHEN k % 2 = 0 THEN 'src/o' || CAST(k AS STRING) || '.js' ELSE 'src/o' || CAST(k AS STRING) || '.ts' END AS file_path,
 'function f0() «»¦' || array_join(transform(array_sort(collect_list(struct(n, CASE WHEN unknown THEN '« let f' || CAST(f AS STRING) || ' = given' ELSE '« const f' || CAST(f AS STRING) || ' = (a) => a' END || '; f0(); f1(1); x.f2(); f2(f0);' || CASE WHEN writes THEN ' f0 = x;' ELSE '' END AS line))), x -> x.line), '¦') || '¦' || repeat('»', CAST(count(*) AS INT)) AS text
 FROM ({NESTED}) AS l GROUP BY k"""


@add("lexical_bindings", f"""WITH l AS ({duck(NESTED)}), u AS (SELECT k, n, v, writes, max(CASE WHEN f = v THEN n WHEN v = 0 THEN 0 END) OVER (PARTITION BY k, v ORDER BY n) AS scope FROM l, (VALUES (0), (1), (2)) t(v)),
b AS (SELECT k, n AS scope, f AS v, unknown FROM l UNION ALL SELECT DISTINCT k, 0, 0, false FROM l), w AS (SELECT DISTINCT k, scope FROM u WHERE writes AND v = 0)
SELECT 'src/o' || k || CASE WHEN k % 2 = 0 THEN '.js' ELSE '.ts' END AS file_path, n + 1 AS line, 'f' || v AS name, 0 AS occurrence, CASE WHEN unknown OR v = 0 AND (k, scope) IN (FROM w) THEN NULL ELSE scope + 1 END AS target_line FROM u JOIN b USING (k, scope, v)""")
def _(s, d):
    x = frame(s, d, BLOCKS).withColumn("text", F.translate("text", "¦«»", "\n{}"))
    return bindings.meant_uses(x).select("file_path", "line", "name", "occurrence", "target_line")
