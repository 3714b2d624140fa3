"""Registered queries over references, texts and dead code, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import expr as E
from codeloom.operators import deadcode as dc
from codeloom.operators import resolution as rs
from codeloom.operators import text as tx
from codeloom.operators.graph import cut
from codeloom.plans import bindings as b
from codeloom.plans.bindings import duck, frame
from codeloom.sources import scan as sc

Q, O = {}, {}
R_, T_, E_, S_, CODE_, SRC_, PG_, SCAN_, FI_, C_ = (f"({duck(x)})" for x in (b.REFS, b.TARGETS, b.EDGES, b.SYMBOLS, b.CODE, b.SOURCES, b.PAGES, b.SCAN, b.FILES, b.CYCLES))


def add(name, oracle=None):
    def put(f):
        Q[name] = f
        if oracle:
            O[name] = oracle
        return f

    return put


def at(sql):
    return lambda s, d: frame(s, d, sql)


refs, targets, code = at(b.REFS), at(b.TARGETS), at(b.CODE)

ADMITTED = "ltrim(target_name) NOT LIKE '(%' AND ltrim(target_name) NOT LIKE '{%' AND NOT contains(target_name, chr(10))"


@add("admitted_references", f"SELECT ref_index, target_name FROM {R_} WHERE {ADMITTED}")
def _(s, d):
    from codeloom.operators.edges import admitted_refs

    return admitted_refs(refs(s, d)).select("ref_index", "target_name")


@add("occurrence_index", f"SELECT ref_index, (row_number() OVER (PARTITION BY file_path, line, target_name ORDER BY ref_index) - 1)::INT AS occurrence_index FROM {R_}")
def _(s, d):
    return rs.occurrence_index(refs(s, d)).select("ref_index", "occurrence_index")


IMPORTS = "SELECT DISTINCT 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(l_suppkey AS STRING) || '.py' AS file_path, p_name || CAST(l_partkey % 97 AS STRING) AS binding, CASE WHEN l_partkey % 2 = 0 THEN 'p' || CAST(l_partkey AS STRING) ELSE 'missing' END AS qualified FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 37 = 0"
IMPORTED = "SELECT DISTINCT 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(l_suppkey AS STRING) || '.py' AS file_path, 'n' || CAST(p_size % 25 AS STRING) || '/s' || CAST(p_partkey % 100 AS STRING) || '.py' AS imported_path FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey WHERE l_orderkey % 11 = 0"
FITS = "(arity IS NULL OR parameter_count IS NULL OR (coalesce(required_parameter_count, 0) <= arity AND arity <= parameter_count))"


@add("tiered_resolution", f"""WITH r AS (SELECT * FROM {R_} WHERE {ADMITTED}), t AS (SELECT * FROM {T_}), im AS ({duck(IMPORTS)}), fi AS ({duck(IMPORTED)}),
c AS (SELECT ref_index, 0 AS k, symbol_index, id, {FITS} AS fit FROM r JOIN t ON r.file_path = t.file_path AND target_name = name
 UNION ALL SELECT ref_index, 1, symbol_index, id, {FITS} FROM r JOIN im ON r.file_path = im.file_path AND target_name = binding JOIN t ON qualified = id
 UNION ALL SELECT ref_index, 2, symbol_index, id, {FITS} FROM r JOIN fi ON r.file_path = fi.file_path JOIN t ON imported_path = t.file_path AND target_name = name WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.file_path = r.file_path AND binding = target_name)
 UNION ALL SELECT ref_index, 3, symbol_index, id, {FITS} FROM r JOIN t ON target_name = name WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.file_path = r.file_path AND binding = target_name)),
m AS (SELECT * FROM c WHERE (ref_index, k) IN (SELECT (ref_index, min(k)) FROM c GROUP BY ref_index)), f AS (SELECT * FROM m x WHERE fit OR NOT EXISTS (SELECT 1 FROM m y WHERE y.ref_index = x.ref_index AND y.fit)),
p AS (SELECT ref_index, k, arg_min(id, symbol_index) AS id, count(*) AS n FROM f GROUP BY ALL)
SELECT ref_index, id AS target_symbol_id, CASE WHEN k = 0 THEN 'SameFile' WHEN k < 3 THEN 'ImportScoped' ELSE 'Global' END AS resolution_tier, CASE WHEN k = 0 THEN 950 WHEN k < 3 THEN 900 ELSE 500 END AS confidence_millis FROM p WHERE k < 3 OR n = 1""")
def _(s, d):
    from codeloom.operators.edges import admitted_refs

    return rs.resolve(admitted_refs(refs(s, d)), targets(s, d), frame(s, d, IMPORTS), frame(s, d, IMPORTED))


@add("arity_filtered_candidates", f"SELECT ref_index, count(*) AS candidates, sum({FITS}::INT)::BIGINT AS fitting FROM {R_} r JOIN {T_} t ON target_name = name GROUP BY ref_index")
def _(s, d):
    empty = s.createDataFrame([], "file_path string, binding string, qualified string")
    found = rs.candidates(refs(s, d), targets(s, d), empty, s.createDataFrame([], "file_path string, imported_path string")).filter("tier_rank = 3")
    return found.groupBy("ref_index").agg(F.sum("n").alias("candidates"), F.sum(F.when(F.col("fit"), F.col("n")).otherwise(0)).alias("fitting"))


@add("unresolved_sites", f"SELECT ref_index FROM {R_} r WHERE NOT EXISTS (SELECT 1 FROM {E_} e WHERE e.source_file_path = r.file_path AND e.kind = r.kind AND e.line = r.line AND e.source_symbol_id IS NOT DISTINCT FROM r.enclosing_symbol_id AND e.layer = 'Runtime')")
def _(s, d):
    e = frame(s, d, b.EDGES).filter("layer = 'Runtime'")
    return rs.unresolved_sites(refs(s, d), e).select("ref_index")


SUFFIX = "SELECT DISTINCT 's' || CAST(o_custkey % 300 AS STRING) || '.py' AS target FROM {orders} UNION SELECT 'p' || CAST(o_custkey AS STRING) || '.py' FROM {orders}"


@add("import_suffix_match", f"WITH t AS ({duck(SUFFIX)}), f AS (SELECT path FROM {FI_}) SELECT target, path FROM t JOIN f ON path = target OR ends_with(path, '/' || target)")
def _(s, d):
    return rs.suffix_match(frame(s, d, b.FILES), frame(s, d, SUFFIX))


HERITAGE = "SELECT 'k' || CAST(p_partkey % 60 AS STRING) AS child, 'k' || CAST(p_partkey % 60 - p_partkey % 60 % 7 - 1 AS STRING) AS parent, CAST(min(p_size) AS INT) AS place FROM {part} WHERE p_partkey % 60 >= 1 GROUP BY 1, 2"
METHODS = "SELECT CAST(p_partkey AS BIGINT) AS symbol_index, 'p' || CAST(p_partkey AS STRING) AS id, p_name AS name, 'k' || CAST(p_partkey % 60 AS STRING) AS parent_symbol_id, 'Method' AS kind, 'f' || CAST(p_partkey % 60 AS STRING) AS file_path, CAST(p_size AS INT) AS start_line FROM {part}"


@add("override_edges", f"""WITH RECURSIVE h AS (SELECT DISTINCT child, parent FROM ({duck(HERITAGE)})), an(c, a, k) AS (SELECT child, parent, 1 FROM h UNION SELECT c, parent, k + 1 FROM an JOIN h ON h.child = a WHERE k < 16),
nn AS (SELECT c, a, min(k) AS k FROM an GROUP BY ALL), m AS (SELECT * FROM ({duck(METHODS)}))
SELECT x.id AS source_symbol_id, arg_min(y.id, nn.k * 10000000 + y.symbol_index) AS target_symbol_id FROM m x JOIN nn ON nn.c = x.parent_symbol_id JOIN m y ON y.parent_symbol_id = nn.a AND y.name = x.name WHERE x.id <> y.id GROUP BY x.id""")
def _(s, d):
    return rs.override_edges(frame(s, d, METHODS), rs.ancestors(frame(s, d, HERITAGE))).select("source_symbol_id", "target_symbol_id")


CL = f"c AS (SELECT * FROM {CODE_}), k AS (SELECT * FROM c WHERE NOT regexp_matches(trim(content), '^(//|\\*|/\\*|#)') AND NOT regexp_matches(lower(file_path), '_test\\.py$'))"


@add("magic_strings", f"WITH {CL} SELECT 'MagicString' AS category, file_path, line, unnest(regexp_extract_all(content, '(?:==|!=)\\s*\"([^\"\\n]{{3,}})\"', 1)) AS value FROM k")
def _(s, d):
    return tx.magic_strings(tx.code_lines(code(s, d)))


@add("hardcoded_urls", f"WITH {CL} SELECT 'HardcodedNetwork' AS category, file_path, line, value FROM (SELECT *, unnest(regexp_extract_all(content, '\"(https?://[^\"\\s]+)\"', 1)) AS value FROM k) WHERE value NOT LIKE '%//www.w3.org/%'")
def _(s, d):
    return tx.hardcoded_networks(tx.code_lines(code(s, d)))


@add("env_outside_config", f"WITH {CL} SELECT 'EnvOutsideConfig' AS category, file_path, line, trim(content) AS value FROM k WHERE content LIKE '%env::var(%' AND file_path NOT LIKE '%config%'")
def _(s, d):
    return tx.env_outside_config(tx.code_lines(code(s, d)))


@add("repeated_literals", f"""WITH {CL}, v AS (SELECT *, unnest(regexp_extract_all(content, '"([^"\\n]+)"', 1)) AS value FROM k), w AS (SELECT * FROM v WHERE strlen(value) >= 4 AND value NOT LIKE 'http%' AND regexp_matches(value, '[A-Z0-9./:@]') AND NOT regexp_matches(value, '[''"$()%<>={{}}]') AND trim(value) = value)
SELECT 'RepeatedLiteral' AS category, file_path, line, value, files FROM w JOIN (SELECT value, count(DISTINCT file_path) AS files FROM w GROUP BY value HAVING count(DISTINCT file_path) >= 2) USING (value)""")
def _(s, d):
    return tx.repeated_literals(tx.code_lines(code(s, d)))


LANG = "CASE WHEN file_path LIKE '%.php' THEN 'Php' WHEN file_path LIKE '%.py' THEN 'Python' WHEN file_path LIKE '%.rb' THEN 'Ruby' WHEN file_path LIKE '%.js' THEN 'JavaScript' END"
DANGER = f"""c AS (SELECT *, {LANG} AS language FROM {CODE_}), k AS (SELECT * FROM c WHERE NOT (language IN ('Python','Ruby') AND ltrim(content) LIKE '#%') AND NOT (language IN ('Php','JavaScript') AND regexp_matches(ltrim(content), '^(//|/\\*|\\*)'))),
dg AS (SELECT *, CASE WHEN language = 'Php' AND regexp_matches(content, '(^|[^A-Za-z0-9_>:$\\\\])(exec|system|passthru|shell_exec|proc_open|popen)\\s*\\(') THEN 'CommandExecution' WHEN language = 'Php' AND regexp_matches(content, '(^|[^A-Za-z0-9_>:$\\\\])eval\\s*\\(') THEN 'CodeInjection'
 WHEN language = 'Python' AND regexp_matches(content, '\\bos\\.system\\s*\\(') THEN 'CommandExecution' WHEN language = 'Python' AND regexp_matches(content, '(^|[^A-Za-z0-9_.])(eval|exec)\\s*\\(') THEN 'CodeInjection'
 WHEN language = 'Ruby' AND regexp_matches(content, '\\b(system|exec)\\s*\\(') THEN 'CommandExecution' WHEN language = 'Ruby' AND regexp_matches(content, '\\beval\\s*\\(') THEN 'CodeInjection' WHEN language = 'Ruby' AND regexp_matches(content, '\\b(Marshal|YAML)\\.load\\s*\\(') THEN 'UnsafeDeserialization'
 WHEN language = 'JavaScript' AND regexp_matches(content, '\\bchild_process\\.exec\\s*\\(') THEN 'CommandExecution' WHEN language = 'JavaScript' AND regexp_matches(content, '\\beval\\s*\\(') THEN 'CodeInjection' END AS category FROM k),
inp AS (SELECT file_path, line, CASE WHEN language = 'Php' AND contains(lower(content), '$_get[') THEN 'RequestQuery' WHEN language = 'Python' AND contains(content, 'request.GET') THEN 'RequestQuery' WHEN language = 'JavaScript' AND contains(lower(content), 'req.query') THEN 'RequestQuery' WHEN language = 'Ruby' AND contains(lower(content), 'params[') THEN 'RequestParams' END AS kind, trim(content) AS evidence FROM k)"""


@add("dangerous_api_lines", f"WITH {DANGER} SELECT file_path, line, language, category FROM dg WHERE category IS NOT NULL")
def _(s, d):
    return tx.dangerous_calls(code(s, d)).select("file_path", "line", "language", "category")


@add("boundary_inputs", f"WITH {DANGER} SELECT file_path, line, kind, evidence FROM inp WHERE kind IS NOT NULL")
def _(s, d):
    return tx.boundary_inputs(code(s, d))


@add("security_severity", f"""WITH {DANGER}, r AS (SELECT DISTINCT file_path FROM c WHERE file_path LIKE 'app/e1%'), four AS (SELECT * FROM (SELECT DISTINCT file_path, line, kind, evidence FROM inp WHERE kind IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY line, kind, evidence) <= 4)
SELECT file_path, line, category, CASE WHEN category = 'UnsafeHtmlOutput' THEN 'Low' WHEN EXISTS (SELECT 1 FROM inp WHERE kind IS NOT NULL AND inp.file_path = dg.file_path AND inp.line <= dg.line) OR file_path IN (FROM r) THEN 'High' ELSE 'Medium' END AS severity,
 CASE WHEN file_path IN (FROM r) THEN 'ExternallyReachable' ELSE '' END AS contexts,
 coalesce((SELECT string_agg(q.line || ':' || q.kind, ',' ORDER BY q.line, q.kind) FROM four q WHERE q.file_path = dg.file_path AND q.line <= dg.line), '') AS inputs FROM dg WHERE category IS NOT NULL""")
def _(s, d):
    # Else a line is made anew for each mark that it is searched for, by the few tasks that read the tables.
    c = cut(code(s, d).repartition(int(s.conf.get("spark.sql.shuffle.partitions"))))
    out = tx.severities(tx.dangerous_calls(c), c.filter("file_path like 'app/e1%'").select(F.col("file_path").alias("path")), tx.boundary_inputs(c))
    return out.select("file_path", "line", "category", "severity", F.array_join("contexts", ",").alias("contexts"), F.array_join("inputs", ",").alias("inputs"))


def code_files(s, d):
    """CODE as whole sources: lines joined in order."""
    per = code(s, d).groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("x"))
    return per.select("file_path", F.array_join(F.transform("x", lambda l: l["content"]), "\n").alias("text"))


ENVS = f"h AS (SELECT file_path, line, unnest(regexp_extract_all(content, 'env::var\\(\"([A-Z][A-Z0-9_]*)\"', 1)) AS value FROM {CODE_} WHERE NOT (content LIKE '//%' AND file_path LIKE '%.rs'))"


#: For each customer three sources with contracts of every category, several of them in one place or over several lines (¦ stands for a line break): category, value.
_CUSTOMER = lambda n: f"' || CAST(c_custkey % {n} AS STRING) || '"
CONTRACTED = [
    ("routes/c", ".php", f"<?php¦Route::get(\"/u{_CUSTOMER(40)}\", \"C@i\");¦do_action(\"init{_CUSTOMER(7)}\");¦config(\"mail.d{_CUSTOMER(5)}\");¦register_post_type(array(\"k{_CUSTOMER(9)}\" => 1,¦ \"shared\" => 2));¦// env(\"OFF\")", [("routes", f"/u{_CUSTOMER(40)}"), ("hooks", f"init{_CUSTOMER(7)}"), ("config_keys", f"mail.d{_CUSTOMER(5)}"), ("registered_keys", f"k{_CUSTOMER(9)}"), ("registered_keys", "shared")]),
    ("web/c", ".ts", f"type S =¦  | \"draft{_CUSTOMER(6)}\"¦  | \"done\";¦const k = [\"al\", \"be{_CUSTOMER(4)}\"] as const;¦const e = new CustomEvent(\"p.{_CUSTOMER(3)}\");¦fetch(\"/api/x{_CUSTOMER(8)}\");¦socket.emit(\"ch{_CUSTOMER(2)}\", 1);¦f(process.env.MODE_{_CUSTOMER(11)});", [("symbolic_literals", f"draft{_CUSTOMER(6)}"), ("symbolic_literals", "done"), ("symbolic_literals", "al"), ("symbolic_literals", f"be{_CUSTOMER(4)}"), ("symbolic_literals", f"p.{_CUSTOMER(3)}"), ("http_calls", f"/api/x{_CUSTOMER(8)}"), ("channels", f"ch{_CUSTOMER(2)}"), ("env_keys", f"MODE_{_CUSTOMER(11)}")]),
    ("view/c", ".vue", f"<div data-controller=\"sp{_CUSTOMER(5)}\"¦ data-action=\"click->sa{_CUSTOMER(5)}#open\"></div>", [("symbolic_literals", f"sp{_CUSTOMER(5)}"), ("symbolic_literals", f"sa{_CUSTOMER(5)}")]),
]
CONTRACT_FILES = " UNION ALL ".join(f"SELECT '{folder}' || CAST(c_custkey AS STRING) || '{end}' AS file_path, '{text}' AS text FROM {{customer}}" for folder, end, text, _ in CONTRACTED)
HITS = f"h AS (SELECT 'env_keys' AS category, unnest(regexp_extract_all(content, 'env::var\\(\"([A-Z][A-Z0-9_]*)\"', 1)) AS value FROM {CODE_} WHERE NOT (content LIKE '//%' AND file_path LIKE '%.rs') UNION ALL " + " UNION ALL ".join(f"SELECT '{category}', '{value}' FROM customer" for *_, found in CONTRACTED for category, value in found) + ")"


def contract_sources(s, d):
    """CODE's files and those of the customers."""
    return code_files(s, d).unionByName(frame(s, d, CONTRACT_FILES).withColumn("text", F.translate("text", "¦", "\n")))


@add("contract_inventory_top50", f"WITH {duck(HITS)} SELECT category, value, count(*) AS count FROM h GROUP BY category, value QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, value) <= 50")
def _(s, d):
    return tx.contract_inventory(tx.contract_hits(contract_sources(s, d))).select("category", "value", "count")


@add("contract_summary", f"WITH {duck(HITS)} SELECT category, count(DISTINCT value) AS unique_values, count(*) AS occurrences FROM h GROUP BY category")
def _(s, d):
    return tx.contract_summary(tx.contract_hits(contract_sources(s, d)))


COMPARED = ", ".join(f"'{c}'" for c in tx.COMPARED)


@add("contract_delta", f"WITH {duck(HITS)}, z AS (SELECT DISTINCT category, regexp_replace(value, '^(KEY_|init|draft|k)1', '\\1N') AS value FROM h WHERE category IN ({COMPARED})), a AS (SELECT DISTINCT category, value FROM h WHERE category IN ({COMPARED})) SELECT category, value, 'removed' AS change FROM a WHERE (category, value) NOT IN (SELECT (category, value) FROM z) UNION ALL SELECT category, value, 'added' FROM z WHERE (category, value) NOT IN (SELECT (category, value) FROM a)")
def _(s, d):
    x = contract_sources(s, d)
    return tx.contract_delta(tx.contract_hits(x), tx.contract_hits(x.withColumn("text", F.regexp_replace("text", '"(KEY_|init|draft|k)1', '"$1N'))))


LOOPS = "SELECT 'src/l' || CAST(o_orderkey AS STRING) || '.py' AS file_path, 'for a in b:' || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN '    sorted(a)' WHEN 1 THEN '    for c in a:' || chr(10) || '        json.loads(c)' ELSE 'sorted(a)' END AS text FROM {orders}"
LC = "SELECT 'src/l' || o_orderkey || '.py' AS file_path, {0} AS line, '{1}' AS subtype FROM orders WHERE o_orderkey % 3 = {2}"


@add("loop_costs", " UNION ALL ".join(LC.format(*x) for x in ((2, "sort", 0), (2, "nested_loop", 1), (3, "json_decode", 1))))
def _(s, d):
    return tx.loop_costs(frame(s, d, LOOPS)).select("file_path", "line", "subtype")


ID_ = f"({duck(b.IDLE)})"
COLUMNS = "symbol_index, id, file_path, kind, name, visibility, start_line"


@add("unused_symbols", f"SELECT 'UnusedPrivateFunction' AS category, file_path, start_line, name, id, CASE visibility WHEN 'Private' THEN 'Certain' ELSE 'Strong' END AS tier FROM (SELECT {COLUMNS} FROM {S_} UNION ALL FROM {ID_}) s WHERE kind IN ('Function','Method') AND visibility IN ('Private','Protected') AND file_path NOT LIKE 'tests/%' AND NOT EXISTS (SELECT 1 FROM {E_} e WHERE e.kind IN ('Call','Overrides') AND e.target_symbol_id = s.id)")
def _(s, d):
    symbols = frame(s, d, b.SYMBOLS).select(*COLUMNS.split(", ")).unionByName(frame(s, d, b.IDLE))
    return dc.unused_symbols(symbols, frame(s, d, b.EDGES))


BOUND = "CASE WHEN ref_index % 7 = 0 THEN 'x ' || binding_name ELSE binding_name END"


@add("unused_imports", f"WITH r AS (SELECT * REPLACE ({BOUND} AS binding_name) FROM {R_}), e AS (SELECT * FROM {E_}) SELECT 'UnusedImport' AS category, file_path, line, binding_name, ref_index FROM r WHERE kind = 'Import' AND binding_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r q WHERE q.kind <> 'Import' AND q.file_path = r.file_path AND q.target_name = r.binding_name) AND NOT EXISTS (SELECT 1 FROM e WHERE e.kind NOT IN ('Import','TypeImport') AND e.source_file_path = r.file_path AND e.reference_target_name = r.binding_name)")
def _(s, d):
    return dc.unused_imports(refs(s, d).withColumn("binding_name", F.expr(BOUND)), frame(s, d, b.EDGES))


@add("orphan_modules", f"SELECT 'OrphanModule' AS category, path FROM (SELECT path FROM {FI_} UNION SELECT file_path FROM {ID_}) f WHERE path NOT LIKE 'tests/%' AND NOT EXISTS (SELECT 1 FROM {E_} e WHERE e.target_file_path = f.path AND e.source_file_path <> f.path) AND regexp_extract(path, '([^/]*)\\.py$', 1) NOT IN (SELECT 'c' || o_custkey FROM orders)")
def _(s, d):
    literals = frame(s, d, "SELECT 'pages/c' || CAST(o_custkey AS STRING) || '.html' AS value FROM {orders}")
    files = frame(s, d, b.FILES).unionByName(frame(s, d, b.IDLE).select(F.col("file_path").alias("path"), F.lit("Python").alias("language")).distinct())
    return dc.orphan_modules(files, frame(s, d, b.EDGES), literals)


@add("identifier_mentions", f"SELECT DISTINCT file_path, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM {CODE_}")
def _(s, d):
    return dc.identifier_mentions(code(s, d)).select("file_path", "name")


@add("page_link_graph", f"SELECT file_path, target, count(*) AS n FROM (SELECT file_path, unnest(regexp_extract_all(text, 'href=\"(/[^\"]*)\"', 1)) AS target FROM {PG_}) GROUP BY ALL")
def _(s, d):
    p = frame(s, d, b.PAGES)
    return p.select("file_path", F.explode(F.regexp_extract_all("text", F.lit(r'href="(/[^"]*)"'), F.lit(1))).alias("target")).groupBy("file_path", "target").agg(F.count(F.lit(1)).alias("n"))


@add("quoted_literals", f"SELECT value, count(DISTINCT file_path) AS files FROM (SELECT file_path, unnest(regexp_extract_all(text, '\"([^\"\\n]{{4,60}})\"', 1)) AS value FROM {PG_}) GROUP BY value HAVING count(DISTINCT file_path) >= 2")
def _(s, d):
    p = frame(s, d, b.PAGES)
    v = p.select("file_path", F.explode(F.regexp_extract_all("text", F.lit(r'"([^"\n]{4,60})"'), F.lit(1))).alias("value")).distinct()
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("files")).filter("files >= 2")


@add("scan_filter", f"SELECT relative_path, size_bytes, content_hash FROM {SCAN_} WHERE relative_path NOT LIKE 'src3/%' AND (relative_path LIKE 'src1/%' OR relative_path LIKE 'src2/en/%')")
def _(s, d):
    return sc.included(sc.pruned(frame(s, d, b.SCAN), ignored=["src3"]), ["src1", "src2/en"])


@add("source_admission", f"SELECT relative_path, CASE WHEN relative_path LIKE '%.py' THEN 'Python' WHEN relative_path LIKE '%.rs' THEN 'Rust' WHEN relative_path LIKE '%.php' THEN 'Php' ELSE 'TypeScript' END AS language FROM {SCAN_} WHERE relative_path NOT LIKE '%.md'")
def _(s, d):
    return sc.admitted(frame(s, d, b.SCAN)).select("relative_path", "language")


@add("structure_graph", f"""WITH p AS (SELECT string_split(relative_path, '/') AS w FROM {SCAN_}), n AS (SELECT DISTINCT array_to_string(w[1:i], '/') AS child, CASE WHEN i = 1 THEN '' ELSE array_to_string(w[1:i-1], '/') END AS parent, i = len(w) AS is_file FROM p, unnest(range(1, len(w) + 1)) t(i)) SELECT parent, child, is_file FROM n""")
def _(s, d):
    return sc.structure(frame(s, d, b.SCAN))


@add("language_coverage", f"SELECT CASE WHEN relative_path LIKE '%.py' THEN 'Python' WHEN relative_path LIKE '%.rs' THEN 'Rust' WHEN relative_path LIKE '%.php' THEN 'Php' WHEN relative_path LIKE '%.ts' THEN 'TypeScript' ELSE 'Unsupported' END AS language, count(*) AS files FROM {SCAN_} GROUP BY 1")
def _(s, d):
    return sc.language_coverage(frame(s, d, b.SCAN))


@add("env_fingerprint")
def _(s, d):
    return sc.environment_fingerprint(frame(s, d, b.SCAN))


@add("input_fingerprint")
def _(s, d):
    return sc.input_fingerprint(frame(s, d, b.SCAN))


@add("incremental_reuse", f"WITH c AS (SELECT * FROM {SCAN_}), m AS (SELECT relative_path, content_hash + CASE WHEN size_bytes % 7 = 0 THEN 1 ELSE 0 END AS content_hash FROM c WHERE size_bytes % 11 <> 0) SELECT c.relative_path, CASE WHEN m.relative_path IS NULL THEN 'new' WHEN m.content_hash = c.content_hash THEN 'reused' ELSE 'changed' END AS status FROM c LEFT JOIN m USING (relative_path)")
def _(s, d):
    now = frame(s, d, b.SCAN)
    return sc.reuse(now, now.filter("size_bytes % 11 != 0").select("relative_path", F.expr("content_hash + CASE WHEN size_bytes % 7 = 0 THEN 1 ELSE 0 END").alias("content_hash")))


@add("symbol_search", f"""SELECT CASE WHEN name = 'red bolt' OR qualified_name = 'red bolt' THEN 0 WHEN ends_with(qualified_name, '::red bolt') THEN 1 ELSE 2 END AS tier, file_path, start_line, id FROM {S_} WHERE name = 'red bolt' OR contains(lower(name), 'red bolt') ORDER BY tier, file_path, start_line, id LIMIT 20""")
def _(s, d):
    from codeloom.plans.api import find_symbol

    return find_symbol(frame(s, d, b.SYMBOLS), "red bolt").select("tier", "file_path", "start_line", "id")


@add("symbol_usages", f"SELECT source_file_path AS file_path, count(*) AS usages, array_to_string(list_sort(list(DISTINCT line))[1:20], ',') AS lines, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM {E_} WHERE target_symbol_id = 'p5' GROUP BY 1 ORDER BY usages DESC, file_path LIMIT 25")
def _(s, d):
    from codeloom.plans.api import symbol_usages

    return symbol_usages(frame(s, d, b.EDGES), "p5")
