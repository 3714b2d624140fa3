"""Inputs for the registered queries: the relations of a code graph, drawn from the test tables.

Each binding is one SELECT that Spark and DuckDB both run; operators and their oracles start from it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

KIND = "CASE {x} WHEN 0 THEN 'Import' WHEN 1 THEN 'Call' WHEN 2 THEN 'Type' WHEN 3 THEN 'TypeImport' WHEN 4 THEN 'Extends' WHEN 5 THEN 'Implements' ELSE 'Overrides' END"

#: Bipartite, many rows: roll-ups, views, admission, resolution.
EDGES = """SELECT CAST(((((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 1009 + l_suppkey) * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS BIGINT) AS edge_index,
 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(l_suppkey AS STRING) || '.py' AS source_file_path,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 's' || CAST(l_suppkey AS STRING) END AS source_symbol_id,
 CASE WHEN l_partkey % 9 = 0 THEN 'tests/p' ELSE 'b' || CAST(p_size AS STRING) || '/p' END || CAST(l_partkey AS STRING) || '.py' AS target_file_path,
 CASE WHEN l_partkey % 50 = l_suppkey % 50 THEN 's' || CAST(l_suppkey AS STRING) ELSE 'p' || CAST(l_partkey AS STRING) END AS target_symbol_id,
 p_name AS reference_target_name,
 """ + KIND.format(x="l_linenumber % 7") + """ AS kind,
 CASE l_linenumber % 7 WHEN 0 THEN 'Import' WHEN 1 THEN 'Call' WHEN 2 THEN 'TypeUse' WHEN 3 THEN 'TypeUse' WHEN 4 THEN 'Extends' WHEN 5 THEN 'Implements' ELSE 'Overrides' END AS relation_kind,
 CASE l_returnflag WHEN 'A' THEN 'Structural' WHEN 'N' THEN 'Runtime' ELSE 'Framework' END AS layer,
 CASE WHEN l_quantity < 17 THEN 'Hard' WHEN l_quantity < 34 THEN 'Dynamic' ELSE 'Inferred' END AS strength,
 CASE WHEN l_partkey % 10 = 0 THEN 'Plugin' WHEN l_partkey % 10 = 1 THEN 'Policy' ELSE 'Resolver' END AS origin,
 CASE WHEN l_quantity < 17 THEN 'SameFile' WHEN l_quantity < 34 THEN 'ImportScoped' ELSE 'Global' END AS resolution_tier,
 CAST(CASE WHEN l_quantity < 17 THEN 950 WHEN l_quantity < 34 THEN 900 ELSE 500 END AS INT) AS confidence_millis,
 CASE l_suppkey % 3 WHEN 0 THEN 'call:global' WHEN 1 THEN 'call' ELSE 'import:named' END || CASE WHEN l_returnflag = 'R' THEN ':late' ELSE '' END AS reason,
 CAST(l_linenumber AS INT) AS line, CAST(0 AS INT) AS occurrence_index
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""

#: Files and modules with cycles: metrics and graph walks. A file for each supplier and part, a module for each remainder; links lead to the module of
#: the greater number, within a module either way.
CYCLES = """SELECT CAST(((((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 1009 + l_suppkey) * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS BIGINT) AS edge_index,
 CASE WHEN forth THEN sfile ELSE pfile END AS source_file_path, CAST(NULL AS STRING) AS source_symbol_id,
 CASE WHEN forth THEN pfile ELSE sfile END AS target_file_path, CASE WHEN forth THEN 'f' || CAST(l_partkey AS STRING) ELSE 's' || CAST(l_suppkey AS STRING) END AS target_symbol_id,
 """ + KIND.format(x="(l_suppkey + l_partkey) % 6") + """ AS kind,
 CASE (l_suppkey + l_partkey) % 6 WHEN 0 THEN 'Import' WHEN 1 THEN 'Call' WHEN 2 THEN 'TypeUse' WHEN 3 THEN 'TypeUse' WHEN 4 THEN 'Extends' ELSE 'Implements' END AS relation_kind,
 CASE WHEN l_suppkey % 7 = 0 THEN 'Runtime' ELSE 'Structural' END AS layer,
 CASE WHEN l_partkey % 4 = 0 THEN 'Inferred' ELSE 'Hard' END AS strength, 'Resolver' AS origin,
 CASE WHEN l_partkey % 4 = 0 THEN 'Global' ELSE 'ImportScoped' END AS resolution_tier, CAST(CASE WHEN l_partkey % 4 = 0 THEN 500 ELSE 900 END AS INT) AS confidence_millis,
 'import:named' AS reason, CAST(l_linenumber AS INT) AS line, CAST(0 AS INT) AS occurrence_index
 FROM (SELECT *, 'm' || CAST(l_suppkey % 20 AS STRING) || '/s' || CAST(l_suppkey AS STRING) AS sfile, 'm' || CAST(l_partkey % 20 AS STRING) || '/f' || CAST(l_partkey AS STRING) AS pfile,
  l_suppkey % 20 < l_partkey % 20 OR (l_suppkey % 20 = l_partkey % 20 AND l_linenumber % 2 = 1) AS forth FROM {lineitem}) AS l"""

SYMBOLS = """SELECT CAST(p_partkey AS BIGINT) AS symbol_index, 'p' || CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 9 = 0 THEN 'tests/p' ELSE 'b' || CAST(p_size AS STRING) || '/p' END || CAST(p_partkey AS STRING) || '.py' AS file_path,
 CASE p_partkey % 4 WHEN 0 THEN 'Class' WHEN 1 THEN 'Function' WHEN 2 THEN 'Method' ELSE 'Module' END AS kind, p_name AS name, p_brand || '::' || p_name AS qualified_name,
 CASE WHEN p_partkey % 4 = 2 THEN 'p' || CAST(p_partkey - 2 AS STRING) ELSE NULL END AS parent_symbol_id, p_brand AS owner_type_name, CAST(NULL AS STRING) AS return_type_name,
 CASE p_type WHEN 'ECONOMY' THEN 'Private' WHEN 'SMALL' THEN 'Protected' ELSE 'Public' END AS visibility, CAST(p_size % 5 AS INT) AS parameter_count, CAST(p_size % 5 - p_size % 2 AS INT) AS required_parameter_count, CAST(p_size AS INT) AS start_line, CAST(p_size + 5 AS INT) AS end_line
 FROM {part}
 UNION ALL SELECT CAST(1000000 + s_suppkey AS BIGINT), 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(s_suppkey AS STRING) || '.py', 'Class', s_name, 'suppliers::' || s_name, NULL, NULL, NULL, 'Public', NULL, NULL, 1, 50 FROM {supplier}"""

FILES = "SELECT DISTINCT file_path AS path, CASE WHEN file_path LIKE 'n1%' THEN 'Php' ELSE 'Python' END AS language FROM (" + SYMBOLS + ") AS s"

REFS = """SELECT CAST((((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 1009 + l_suppkey) * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS BIGINT) AS ref_index,
 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(l_suppkey AS STRING) || '.py' AS file_path, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 's' || CAST(l_suppkey AS STRING) END AS enclosing_symbol_id,
 """ + KIND.format(x="l_linenumber % 3") + """ AS kind, CASE WHEN l_orderkey % 41 = 0 THEN '  (anonymous' WHEN l_orderkey % 43 = 0 THEN s_name ELSE p_name || CAST(l_partkey % 97 AS STRING) END AS target_name,
 CASE WHEN l_linenumber % 3 = 0 THEN p_name ELSE NULL END AS binding_name, CAST(l_linenumber AS INT) AS line, CAST(CAST(l_quantity AS INT) % 5 AS INT) AS arity
 FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""

#: Symbols that REFS can name: part names with a number, in files of suppliers.
TARGETS = """SELECT CAST(p_partkey AS BIGINT) AS symbol_index, 'p' || CAST(p_partkey AS STRING) AS id, 'n' || CAST(p_size % 25 AS STRING) || '/s' || CAST(p_partkey % 100 AS STRING) || '.py' AS file_path, 'Method' AS kind, p_name || CAST(p_partkey % 97 AS STRING) AS name, CAST(p_size % 5 AS INT) AS parameter_count, CAST(p_size % 5 - p_size % 2 AS INT) AS required_parameter_count FROM {part}
 UNION ALL SELECT CAST(1000000 + s_suppkey AS BIGINT), 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) || '/s' || CAST(s_suppkey AS STRING) || '.py', 'Class', s_name, NULL, NULL FROM {supplier}"""

#: Lines of code made from rows, some as comments or under tests, so that detectors and their exclusions have something to find.
CODE = """SELECT 'src/m' || CAST(o_orderkey % 50 AS STRING) || '/o' || CAST(o_orderkey % 700 AS STRING) || CASE WHEN o_orderkey % 11 = 0 THEN '_test.py' ELSE '.rs' END AS file_path, CAST(o_orderkey AS INT) AS line,
 CASE WHEN o_orderkey % 13 = 0 THEN '// ' ELSE '' END || CASE o_orderkey % 5 WHEN 0 THEN 'if (mode == "' || o_orderpriority || '") do' WHEN 1 THEN 'let url = "http://' || lower(o_orderstatus) || '.internal/x' || CAST(o_orderkey % 9 AS STRING) || '";' WHEN 2 THEN 'let k = env::var("KEY_' || CAST(o_custkey % 30 AS STRING) || '");' WHEN 3 THEN 'call("Order/' || CAST(o_custkey % 200 AS STRING) || '", "x");' ELSE 'let s = "http://www.w3.org/2000/svg";' END AS content FROM {orders}
 UNION ALL SELECT 'app/e' || CAST(user_id % 40 AS STRING) || CASE event_type WHEN 'click' THEN '.php' WHEN 'view' THEN '.js' WHEN 'error' THEN '.rb' ELSE '.py' END, CAST(event_id AS INT),
 CASE WHEN event_id % 17 = 0 THEN '# ' ELSE '' END || CASE event_id % 6 WHEN 0 THEN 'eval(' || event_type || ')' WHEN 1 THEN 'os.system(' || event_type || ')' WHEN 2 THEN 'x = request.GET' WHEN 3 THEN 'child_process.exec(req.query)' WHEN 4 THEN 'exec($_GET[k])' ELSE 'Marshal.load(params[1])' END FROM {events}"""

#: Symbols that nothing refers to beside those of SYMBOLS: a private function for each customer, in a file of its own.
IDLE = "SELECT CAST(2000000 + c_custkey AS BIGINT) AS symbol_index, 'c' || CAST(c_custkey AS STRING) AS id, 'k' || CAST(c_nationkey AS STRING) || '/c' || CAST(c_custkey AS STRING) || '.py' AS file_path, 'Function' AS kind, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'Public' WHEN 1 THEN 'Private' ELSE 'Protected' END AS visibility, CAST(1 AS INT) AS start_line FROM {customer}"

SOURCES = "SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS file_path, text FROM {documents}"
PAGES = "SELECT url AS file_path, html AS text FROM {pages}"

#: Findings of two analyses: the second rates a fifth higher and has those of open orders under another fingerprint.
BEFORE = "SELECT 'c' || CAST(o_custkey AS STRING) || '|' || o_orderpriority AS fingerprint, CAST(floor(o_totalprice / 1000) AS INT) AS severity_millis, CAST(o_orderkey % 900 AS INT) AS confidence_millis, 'c' || CAST(o_custkey AS STRING) || '/f.py' AS path FROM {orders}"
NOW = "SELECT 'c' || CAST(o_custkey AS STRING) || '|' || CASE WHEN o_orderstatus = 'P' THEN 'moved' ELSE o_orderpriority END AS fingerprint, CAST(floor(o_totalprice / 1000) AS INT) + CAST(CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 0 END AS INT) AS severity_millis, CAST(o_orderkey % 900 AS INT) AS confidence_millis, 'c' || CAST(o_custkey AS STRING) || '/f.py' AS path FROM {orders}"

#: Findings with a family, for counts and policies.
FINDINGS = """SELECT 'f' || CAST(o_orderkey AS STRING) AS fingerprint, 'm' || CAST(o_custkey % 20 AS STRING) || '/f' || CAST(o_custkey AS STRING) AS path, CASE o_orderstatus WHEN 'F' THEN 'dead_code' WHEN 'O' THEN 'hardwiring' ELSE 'security' END AS family,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity, o_orderpriority AS value, CAST(floor(o_totalprice / 1000) AS INT) AS severity_millis FROM {orders}"""

SCAN = "SELECT source || '/' || lang || '/' || CAST(doc_id AS STRING) || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.php' WHEN 3 THEN '.ts' ELSE '.md' END AS relative_path, CAST(n_chars AS BIGINT) AS size_bytes, CAST(n_chars * 7 + doc_id % 3 AS BIGINT) AS content_hash FROM {documents}"


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The binding over the tables of a folder."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(sql: str) -> str:
    """The binding as DuckDB text."""
    return re.sub(r"\{(\w+)\}", r"\1", sql).replace("AS STRING)", "AS VARCHAR)")
